"""Guards over model- or user-written text: unsafe prose, numbers, redaction, contracts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom import fixed
from weekloom.functions.text import SPACE, WORD, is_blank, nfkc, squeeze


def matches(col: Column, pattern: str) -> Column:
    """Search with Unicode-aware classes and boundaries."""
    return col.rlike("(?U)" + pattern)


#: what a text must hold for a pattern to match, by plain search or a cheap class; the patterns'
#: look-behinds and Unicode classes cost much more
_WEB = r"://|[wW]{3}\."
_HOME, _DOTS, _DRIVE = "[~/]", r"\.[\\/]", r"[A-Za-z]:[\\/]"
_MARKS = "[`$&|<;]"
#: letters that a search with Unicode case takes for i, s or k
_FOLDED = "[\u0130\u0131\u017f\u212a]"
_WORDING = ("(?i)ignore|prompt|developer|jailbreak|disregard|forget|follow|execute|run |curl|wget"
            "|sudo|-rf|" + _FOLDED)
_ORDERS = ("(?i)ignore|prompt|developer|jailbreak|run|execute|-rf|sudo|curl|wget|powershell"
           "|<script|忽略|执行|系统提示|" + _FOLDED)
#: a command's name behind what is no letter or digit of ASCII
_COMMANDS = (r"(?i)(?:^|[^A-Za-z0-9])(?:sudo|rm|cp|mv|ch(?:mod|own)|curl|wget|python|pip|bash|zsh"
             r"|powershell|cmd\.exe|osascript)|" + _FOLDED)
GATES = {
    **dict(zip((p for p, _ in fixed.UNSAFE_PROSE),
               (_WEB, _HOME, _DOTS, _DRIVE, _MARKS, _WORDING, "[忽系开提越执运]"))),
    fixed.INJECTION: _ORDERS,
    fixed.URL_TEXT: _WEB, fixed.POSIX_PATH: _HOME, fixed.RELATIVE_PATH: _DOTS,
    fixed.WINDOWS_PATH: _DRIVE,
    fixed.SHELL_COMMAND: _COMMANDS,
}


def gated(col: Column, pattern: str) -> Column:
    """``matches``, tried only on texts that pass the pattern's gate."""
    if pattern not in GATES:
        return matches(col, pattern)
    return col.rlike(GATES[pattern]) & matches(col, pattern)


def unsafe_prose(col: Column) -> Column:
    """Why a text must not be shown: the first reason that applies, or null."""
    reason = F.when(col.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "control characters")
    for pattern, name in fixed.UNSAFE_PROSE:
        reason = reason.when(gated(col, pattern), name)
    return reason


def claims_number(col: Column) -> Column:
    """Percent signs, number words of either language, or digits outside ASCII."""
    words = rf"(?i)(?<![{WORD}])(?:{fixed.NUMBER_WORDS})(?![{WORD}])"
    return (col.contains("%") | col.rlike(words) | col.rlike(fixed.NUMBER_WORDS_ZH)
            | col.rlike(r"[\p{Nd}&&[^0-9]]"))


def digit_tokens(col: Column) -> Column:
    return F.transform(F.regexp_extract_all(col, F.lit(fixed.DIGIT_TOKEN), F.lit(0)),
                       lambda t: F.lower(t))


def name_tokens(col: Column) -> Column:
    """Digit-bearing tokens that hold a letter, as entity names may lend them to prose."""
    return F.filter(digit_tokens(col), lambda t: t.rlike("[a-z]"))


def stray_tokens(text: Column, allowed: Column) -> Column:
    """Digit tokens of a text that no referenced entity name contains."""
    tokens = F.array_distinct(digit_tokens(text))
    return F.filter(tokens, lambda t: ~t.rlike("[a-z]") | ~F.array_contains(allowed, t))


def finding_problems(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """(report_id, finding_no, problem) of findings that break the contract.

    ``findings(report_id, finding_no, finding_code, fact_ids, priority, title_zh, title_en,
    summary_zh, summary_en)`` meet ``facts(report_id, fact_id, names)``, the candidate facts
    with the text of their entities.
    """
    ident = ["report_id", "finding_no"]
    # per-report counts join back instead of a window, so a report may have any size
    total = findings.groupBy("report_id").agg(F.count("*").alias("n_findings"))
    twice = findings.groupBy("report_id", "finding_code").agg(F.count("*").alias("n_code"))
    counted = findings.join(total, "report_id").join(twice, ["report_id", "finding_code"], "left")
    size = F.size("fact_ids")
    shape = F.array_compact(F.array(
        F.when(F.col("n_findings") > 3, "too_many_findings"),
        F.when(F.col("finding_code").isNull()
               | ~F.col("finding_code").rlike(fixed.FINDING_CODE), "finding_code"),
        F.when(F.col("n_code") > 1, "duplicate_code"),
        F.when(F.col("priority").isNull()
               | ~F.col("priority").isin(fixed.FINDING_PRIORITIES), "priority"),
        F.when(F.col("fact_ids").isNull() | (size < 1) | (size > 3)
               | (F.size(F.array_distinct("fact_ids")) < size), "fact_ids"),
        *[F.when(F.col(f).isNull() | is_blank(F.col(f)) | (F.length(f) > n), f)
          for f, n in fixed.FINDING_LIMITS.items()]))
    own = counted.select(*ident, F.explode(shape).alias("problem"))
    cited = findings.select(*ident, F.explode(F.array_distinct("fact_ids")).alias("fact_id"))
    unknown = cited.join(facts, ["report_id", "fact_id"], "left_anti").select(
        *ident, F.lit("unknown_fact").alias("problem")).distinct()
    return own.unionByName(unknown)


def prose_problems(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """(report_id, finding_no, field, problem): numbers, unsafe text and stray digits."""
    ident = ["report_id", "finding_no"]
    fields = list(fixed.FINDING_LIMITS)
    cited = findings.select(*ident, F.explode(F.array_distinct("fact_ids")).alias("fact_id"))
    lent = cited.join(facts, ["report_id", "fact_id"]).groupBy(*ident).agg(
        F.array_distinct(F.flatten(F.collect_list(name_tokens(F.col("names"))))).alias("lent"))
    long = findings.select(*ident, F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("p"))
    long = long.select(*ident, "p.field", nfkc(F.col("p.text")).alias("text")).join(
        lent, ident, "left")
    none = F.array().cast("array<string>")
    found = long.withColumns({
        "claims": claims_number(F.col("text")), "unsafe": unsafe_prose(F.col("text")),
        "stray": F.size(stray_tokens(F.col("text"), F.coalesce("lent", none))) > 0})
    problem = (F.when(F.col("claims"), "numerical_claim")
               .when(F.col("unsafe").isNotNull(), F.concat(F.lit("unsafe "), "unsafe"))
               .when(F.col("stray"), "stray_number"))
    return found.select(*ident, "field", problem.alias("problem")).where("problem is not null")


def _instruction(col: Column) -> Column:
    return (gated(col, fixed.INJECTION) | gated(col, fixed.SHELL_COMMAND)
            | col.contains("`") | col.contains("&&") | col.contains("||"))


def _path(col: Column) -> Column:
    return (gated(col, fixed.WINDOWS_PATH) | gated(col, fixed.POSIX_PATH)
            | gated(col, fixed.RELATIVE_PATH))


def _reference(col: Column) -> Column:
    return gated(col, fixed.URL_TEXT) | _path(col)


def forbidden(col: Column) -> Column:
    return _instruction(col) | _reference(col)


def cleaned(normalized: Column) -> Column:
    clean = squeeze(F.regexp_replace(normalized, r"[\x00-\x1f\x7f]+", " "))
    return F.regexp_replace(clean, r"\A[ \t\r\n,;:]+|[ \t\r\n,;:]+\z", "")


def judged(normalized: Column) -> Column:
    """What ``shown`` needs of a whole NFKC text: why it is withheld, or else its cleaned form."""
    withheld = (F.when(_instruction(normalized), "instruction")
                .when(gated(normalized, fixed.URL_TEXT), "url").when(_path(normalized), "path"))
    # bound to a name, so that the patterns are searched once
    found = F.transform(F.array(withheld), lambda w: F.struct(
        w.alias("withheld"), F.when(w.isNull(), cleaned(normalized)).alias("clean")))
    return found[0]


def shown(verdict: Column, item: bool = False) -> Column:
    """The neutral phrase, or the shortened text, of a ``judged`` column."""
    i = 1 if item else 0
    phrase = {k: v[i] for k, v in fixed.REDACTED.items()}
    limit = fixed.ITEM_LIMIT if item else fixed.MESSAGE_LIMIT
    result = F.coalesce(F.nullif(F.substring(verdict["clean"], 1, limit), F.lit("")),
                        F.lit(phrase["empty"]))
    for reason in ("path", "url", "instruction"):
        result = F.when(verdict["withheld"] == reason, phrase[reason]).otherwise(result)
    return result


def redact(normalized: Column, item: bool = False) -> Column:
    """Replace a whole NFKC text by a neutral phrase, or clean and shorten it."""
    return F.transform(F.array(judged(normalized)), lambda v: shown(v, item))[0]


def blank(col: Column) -> Column:
    return ~col.rlike(f"[^{SPACE}]")
