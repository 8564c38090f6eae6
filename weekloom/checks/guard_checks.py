"""Text guards over documents, pages and conversations."""

from pyspark.sql import functions as F

from weekloom import fixed
from weekloom.checks.registry import check, spread, table
from weekloom.functions.text import nfkc
from weekloom.operators import diagnostics as D
from weekloom.operators import guards as G

TAIL = r"[^\s<>\]\[{}]"
# the same patterns for an engine without look-behind
RE2_UNSAFE = [
    (fixed.UNSAFE_PROSE[0][0], "URL"),
    (rf"(^|[^A-Za-z0-9_:])(?:~|/){TAIL}", "filesystem path"),
    (rf"(^|[^A-Za-z0-9_])\.\.?[\\/]{TAIL}", "filesystem path"),
    (fixed.UNSAFE_PROSE[3][0], "filesystem path"),
    (fixed.UNSAFE_PROSE[4][0], "command syntax"),
    (fixed.UNSAFE_PROSE[5][0], "instruction or command wording"),
    (fixed.UNSAFE_PROSE[6][0], "instruction or command wording")]


def quoted(pattern):
    return "'" + pattern.replace("'", "''") + "'"


def unsafe_sql(col):
    arms = "".join(f" when regexp_matches({col}, {quoted(p)}) then '{r}'" for p, r in RE2_UNSAFE)
    return (f"case when regexp_matches({col}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') "
            f"then 'control characters'{arms} end")


def redact_sql(col, item=False):
    i = 1 if item else 0
    m = lambda p: f"regexp_matches({col}, {quoted(p)})"
    limit = fixed.ITEM_LIMIT if item else fixed.MESSAGE_LIMIT
    clean = (f"regexp_replace(regexp_replace(regexp_replace({col}, '[\\x00-\\x1f\\x7f]+', ' ', "
             f"'g'), '\\s+', ' ', 'g'), '^[ \\t\\r\\n,;:]+|[ \\t\\r\\n,;:]+$', '', 'g')")
    return (
        f"case when {m(fixed.INJECTION)} or {m(fixed.SHELL_COMMAND)} or contains({col}, '`') "
        f"or contains({col}, '&&') or contains({col}, '||') "
        f"then '{fixed.REDACTED['instruction'][i]}' "
        f"when {m(fixed.URL_TEXT)} then '{fixed.REDACTED['url'][i]}' "
        f"when {m(rf'(?i)(^|[^A-Za-z0-9_])[A-Z]:[\\/]{TAIL}')} or {m(RE2_UNSAFE[1][0])} "
        f"or {m(RE2_UNSAFE[2][0])} then '{fixed.REDACTED['path'][i]}' "
        f"else coalesce(nullif(substr({clean}, 1, {limit}), ''), "
        f"'{fixed.REDACTED['empty'][i]}') end")


def all_texts(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf, "pages").select(
        F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    urls = table(spark, sf, "pages").select(
        F.lit("urls").alias("origin"), F.col("page_id").alias("id"), F.col("url").alias("text"))
    turns = table(spark, sf, "conversations").select(
        F.lit("conversations").alias("origin"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return docs.unionByName(pages).unionByName(urls).unionByName(turns)


TEXTS = """
with texts as (
  select 'documents' as origin, doc_id as id, text from documents
  union all select 'pages', page_id, html from pages
  union all select 'urls', page_id, url from pages
  union all select 'conversations', conv_id * 1000 + turn, text from conversations)
"""


@check("unsafe_prose", TEXTS + f"select origin, id, {unsafe_sql('text')} as reason from texts")
def unsafe_prose(spark, sf):
    return all_texts(spark, sf).select("origin", "id",
                                       G.unsafe_prose(F.col("text")).alias("reason"))


@check("redact_text", TEXTS + f"""
select origin, id, sha256({redact_sql('text')}) as message, {redact_sql('text', True)} as item
from texts""")
def redact_text(spark, sf):
    texts = spread(all_texts(spark, sf)).withColumn("n", nfkc(F.col("text")))
    # one verdict serves both forms
    both = texts.select("origin", "id", F.transform(F.array(G.judged(F.col("n"))), lambda v: (
        F.struct(F.sha2(G.shown(v), 256).alias("message"),
                 G.shown(v, item=True).alias("item"))))[0].alias("x"))
    return both.select("origin", "id", "x.message", "x.item")


@check("number_free_prose", rf"""
with f as (
  select doc_id, unnest(['title_zh', 'title_en', 'summary_zh', 'summary_en']) as field,
         unnest([lang, source || ' and P' || doc_id % 10, '周报', text]) as t
  from documents),
x as (
  select doc_id, field, t,
         contains(t, '%') or regexp_matches(t, {quoted(
             r"(?i)(^|[^\p{L}\p{N}_])(?:" + fixed.NUMBER_WORDS + r")($|[^\p{L}\p{N}_])")})
         or regexp_matches(t, {quoted(fixed.NUMBER_WORDS_ZH)}) as claims,
         {unsafe_sql('t')} as unsafe,
         len(list_filter(list_distinct(list_transform(
               regexp_extract_all(t, {quoted(fixed.DIGIT_TOKEN)}), lambda s: lower(s))),
             lambda s: not regexp_matches(s, '[a-z]') or (s <> 'p' || doc_id % 7 and s <> 'src1')))
           > 0 as stray
  from f)
select doc_id, field,
       case when claims then 'numerical_claim' when unsafe is not null then 'unsafe ' || unsafe
            else 'stray_number' end as problem
from x where claims or unsafe is not null or stray""")
def number_free_prose(spark, sf):
    docs = table(spark, sf, "documents")
    findings = docs.select(
        F.col("doc_id").alias("report_id"), F.lit(1).alias("finding_no"),
        F.array(F.lit("a"), F.lit("b")).alias("fact_ids"), F.col("lang").alias("title_zh"),
        F.concat("source", F.lit(" and P"), (F.col("doc_id") % 10).cast("string"))
        .alias("title_en"), F.lit("周报").alias("summary_zh"), F.col("text").alias("summary_en"))
    facts = docs.select(F.col("doc_id").alias("report_id"), F.explode(F.array(
        F.struct(F.lit("a").alias("fact_id"),
                 F.concat(F.lit("Robo P"), (F.col("doc_id") % 7).cast("string"))
                 .alias("names")),
        F.struct(F.lit("b").alias("fact_id"), F.lit("SRC1 2024").alias("names")))).alias("f")) \
        .select("report_id", "f.fact_id", "f.names")
    return G.prose_problems(findings, facts).select(F.col("report_id").alias("doc_id"), "field",
                                                    "problem")


CODES = ["COST_UP", "ROAS_DOWN", "bad code", "CLICKS", "X"]


@check("finding_contract", f"""
with f as (
  select l_orderkey as report_id, l_linenumber as finding_no,
         ['COST_UP', 'ROAS_DOWN', 'bad code', 'CLICKS', 'X'][l_partkey % 5 + 1] as code,
         case when l_suppkey % 9 = 0 then cast([] as varchar[])
              else ['f' || l_partkey % 4, 'f' || l_suppkey % 4] end as ids,
         case when l_quantity > 45 then 'URGENT' else 'LOW' end as priority,
         repeat('t', cast(l_quantity * 3 as int)) as title, ' ' as blank
  from lineitem),
c as (select *, count(*) over (partition by report_id) as n,
             count(*) over (partition by report_id, code) as nc from f)
select report_id, finding_no, problem from (
  select report_id, finding_no, unnest(list_filter([
    case when n > 3 then 'too_many_findings' end,
    case when code in ('bad code', 'X') then 'finding_code' end,
    case when nc > 1 then 'duplicate_code' end,
    case when priority = 'URGENT' then 'priority' end,
    case when len(ids) = 0 or (len(ids) = 2 and ids[1] = ids[2]) then 'fact_ids' end,
    case when len(title) > 80 then 'title_zh' end,
    case when len(title) > 120 then 'title_en' end,
    'summary_en'], lambda x: x is not null)) as problem from c)
union all
select distinct report_id, finding_no, 'unknown_fact'
from (select report_id, finding_no, unnest(ids) as id from f) where id = 'f3'""")
def finding_contract(spark, sf):
    lines = table(spark, sf, "lineitem")
    name = lambda c: F.concat(F.lit("f"), (F.col(c) % 4).cast("string"))
    title = F.repeat(F.lit("t"), (F.col("l_quantity") * 3).cast("int"))
    findings = lines.select(
        F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("finding_no"),
        F.element_at(F.array(*[F.lit(c) for c in CODES]),
                     (F.col("l_partkey") % 5 + 1).cast("int")).alias("finding_code"),
        F.when(F.col("l_suppkey") % 9 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(name("l_partkey"), name("l_suppkey"))).alias("fact_ids"),
        F.when(F.col("l_quantity") > 45, "URGENT").otherwise("LOW").alias("priority"),
        title.alias("title_zh"), title.alias("title_en"), F.lit("概要").alias("summary_zh"),
        F.lit(" ").alias("summary_en"))
    facts = lines.select(F.col("l_orderkey").alias("report_id"), F.explode(F.array(
        F.lit("f0"), F.lit("f1"), F.lit("f2"))).alias("fact_id")).distinct()
    return G.finding_problems(findings, facts)


CATEGORIES = [*fixed.EXPLANATIONS, "other"]


def diagnostics(spark, sf):
    """Diagnostics made of conversation turns: words as items, the whole turn as message."""
    turns = table(spark, sf, "conversations")
    words = F.split("text", " ")
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit("none"))
    k = (F.col("conv_id") + F.col("turn")) % 9
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("diag_id"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (k + 1).cast("int"))
        .alias("category"),
        F.array(word(0), word(1), word(0), F.lit("/tmp/x"), F.lit("~/y"),
                F.lit("see www.example.com")).alias("missing"),
        F.map_from_arrays(
            F.array(F.concat(F.lit("a "), word(0)), F.lit("../p"), F.lit("../q")),
            F.array(F.array(word(1), word(2), word(1)), F.array(F.lit("sudo x"), word(0)),
                    F.array(word(3), word(0)))).alias("duplicates"),
        F.col("role").alias("error_type"), F.col("text").alias("message"))


DIAG = f"""
with w as (select conv_id * 1000 + turn as diag_id, text, role,
                  {"[" + ", ".join(quoted(c) for c in CATEGORIES) + "]"}
                    [(conv_id + turn) % 9 + 1] as category,
                  string_split(text, ' ') as s from conversations),
v as (select *, coalesce(s[1], 'none') as w0, coalesce(s[2], 'none') as w1,
             coalesce(s[3], 'none') as w2, coalesce(s[4], 'none') as w3 from w),
pr as (select *, list_filter([
         case when category = 'other' then 'category' end,
         case when greatest(len(w0), len(w1)) > 160 then 'missing' end,
         case when greatest(len(w0) + 2, len(w1), len(w2), len(w3)) > 160
              then 'duplicates' end,
         case when len(text) > 1200 then 'message' end], lambda x: x is not null) as problems
       from v),
n as (select diag_id, category, {redact_sql('role')} as error_type,
             {redact_sql('text')} as message,
             {redact_sql("('a ' || w0)", True)} as k0, {redact_sql('w0', True)} as r0,
             {redact_sql('w1', True)} as r1, {redact_sql('w2', True)} as r2,
             {redact_sql('w3', True)} as r3
      from pr where len(problems) = 0),
m as (select *, list_filter([r0, r1, 'local file', 'external reference'],
                            lambda x, i: list_position([r0, r1, 'local file',
                                                     'external reference'], x) = i) as missing,
             list_filter([r1, r2], lambda x, i: list_position([r1, r2], x) = i) as d0,
             list_filter(['untrusted item', r0, r3],
                         lambda x, i: list_position(['untrusted item', r0, r3], x) = i) as d1
      from n)
"""


@check("diagnostic_contract", DIAG + """
select diag_id, '' as problems, error_type, sha256(message) as message,
       array_to_string(missing, '|') as missing,
       k0 || '=' || array_to_string(d0, '|') || ';local file=' || array_to_string(d1, '|')
         as groups
from m
union all
select diag_id, array_to_string(problems, ','), null, null, null, null
from pr where len(problems) > 0""")
def diagnostic_contract(spark, sf):
    good, bad = D.normalize(diagnostics(spark, sf))
    groups = F.concat_ws(";", F.transform("groups", lambda g: F.concat(
        g["name"], F.lit("="), F.concat_ws("|", g["items"]))))
    shown = good.select("diag_id", F.lit("").alias("problems"), "error_type",
                        F.sha2("message", 256).alias("message"),
                        F.concat_ws("|", "missing").alias("missing"), groups.alias("groups"))
    return shown.unionByName(bad.select("diag_id", F.concat_ws(",", "problems")
                                        .alias("problems")), allowMissingColumns=True)


def keyword_sql(col):
    arms = " ".join("when " + " or ".join(f"contains({col}, '{w}')" for w in ws)
                    + f" then '{c}'" for c, ws in fixed.CATEGORY_KEYWORDS)
    return f"case {arms} else 'generation' end"


@check("diagnostic_category", f"""
select doc_id, {keyword_sql("lower(source || ' ' || text)")} as category,
       case when n_chars % 3 = 0 then 'missing_sources' when n_chars % 3 = 1
            then 'duplicate_sources' else 'unknown' end as discovered
from documents""")
def diagnostic_category(spark, sf):
    docs = table(spark, sf, "documents")
    only = lambda i: F.when(F.col("n_chars") % 3 == i, F.array(F.lit("x"))) \
        .otherwise(F.array().cast("array<string>"))
    return docs.select(
        "doc_id", D.generation_category(F.col("source"), F.col("text")).alias("category"),
        D.discovery_category(only(0), only(1)).alias("discovered"))


@check("diagnostic_explain", DIAG + f"""
select diag_id, category, case category {" ".join(
    f"when '{c}' then {quoted(row[1])}" for c, row in fixed.EXPLANATIONS.items())} end
         as title_en,
       case category {" ".join(f"when '{c}' then {len(row[4])}"
                               for c, row in fixed.EXPLANATIONS.items())} end as n_steps,
       array_to_string(case category when 'missing_sources' then missing
            when 'duplicate_sources' then [k0, 'local file']
            when 'period_conflict' then ['{fixed.PERIOD_ITEM}']
            else list_concat(missing, [k0, 'local file']) end, '|') as affected
from m""")
def diagnostic_explain(spark, sf):
    good, _ = D.normalize(diagnostics(spark, sf))
    return D.explain(good).select("diag_id", "category", "title_en",
                                  F.size("steps").alias("n_steps"),
                                  F.concat_ws("|", "affected_items").alias("affected"))


@check("explanation_contract", f"""
with t as (select conv_id * 1000 + turn as id, text, conv_id, turn, len(text) as n,
                  {unsafe_sql("''")} as nothing from conversations)
select id, array_to_string(list_filter([
  case when conv_id % 7 = 0 then 'shape' end, case when turn % 4 = 3 then 'category' end,
  case when n > 80 then 'title_en' end, case when n > 300 then 'summary_en' end,
  case when conv_id % 5 = 4 or n > 200 then 'steps' end,
  case when conv_id % 3 = 0 then 'affected_items' end,
  case when {redact_sql('text')} in ('{fixed.REDACTED["instruction"][0]}',
                                     '{fixed.REDACTED["url"][0]}') then 'forbidden' end],
  lambda x: x is not null), ',') as problems
from t""")
def explanation_contract(spark, sf):
    turns = table(spark, sf, "conversations")
    names = ["category", "title_zh", "title_en", "summary_zh", "summary_en", "steps",
             "affected_items"]
    keys = F.array(*[F.lit(n) for n in names])
    step = F.array(F.struct(F.lit("步骤").alias("zh"), F.col("text").alias("en")))
    rows = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.when(F.col("conv_id") % 7 == 0, F.concat(keys, F.array(F.lit("more"))))
        .otherwise(keys).alias("keys"),
        F.when(F.col("turn") % 4 == 3, "generation").otherwise("validation").alias("category"),
        F.lit("validation").alias("expected_category"), F.lit("标题").alias("title_zh"),
        F.col("text").alias("title_en"), F.lit("概要").alias("summary_zh"),
        F.col("text").alias("summary_en"),
        F.array_repeat(step[0], F.when(F.col("conv_id") % 5 == 4, 4).otherwise(2)).alias("steps"),
        F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("b"))).otherwise(F.array(F.lit("a")))
        .alias("affected_items"), F.array(F.lit("a")).alias("expected_items"))
    return rows.select("id", F.concat_ws(",", D.explanation_problems()).alias("problems"))


@check("review_verdict", """
with t as (select conv_id * 1000 + turn as id, conv_id, turn, len(text) as n from conversations)
select id, case when turn % 5 = 4 then 'MAYBE' when conv_id % 2 = 0 and turn % 3 > 0 then 'REVIEW'
                when conv_id % 2 = 0 then 'PASS' else 'REVIEW' end as verdict,
       array_to_string(list_filter([
         case when conv_id % 11 = 0 then 'shape' end,
         case when conv_id % 13 = 0 then 'schema_version' end,
         case when turn % 5 = 4 then 'verdict' end, case when n > 300 then 'summary' end,
         case when turn > 3 or (turn > 0 and n > 240) then 'anomalies' end],
         lambda x: x is not null), ',') as problems
from t""")
def review_verdict(spark, sf):
    turns = table(spark, sf, "conversations")
    keys = F.array(*[F.lit(k) for k in ("verdict", "summary", "schema_version", "anomalies")])
    level = F.element_at(F.array(F.lit("INFO"), F.lit("WARNING"), F.lit("ERROR")),
                         (F.col("turn") % 3 + 1).cast("int"))
    anomaly = F.struct(level.alias("severity"), F.lit("CODE").alias("code"),
                       F.col("text").alias("message"), F.lit("$.x").alias("path"),
                       F.lit("look").alias("recommended_action"),
                       F.array(F.lit("e")).alias("evidence"))
    rows = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.when(F.col("conv_id") % 11 == 0, F.slice(keys, 1, 3)).otherwise(keys).alias("keys"),
        F.when(F.col("conv_id") % 13 == 0, "2").otherwise("1.0.0").alias("schema_version"),
        F.when(F.col("turn") % 5 == 4, "MAYBE").when(F.col("conv_id") % 2 == 0, "PASS")
        .otherwise("REVIEW").alias("verdict"), F.col("text").alias("summary"),
        F.array_repeat(anomaly, F.col("turn").cast("int")).alias("anomalies"))
    return rows.select("id", D.final_verdict().alias("verdict"),
                       F.concat_ws(",", D.review_problems()).alias("problems"))
