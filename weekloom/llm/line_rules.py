"""Quality rules: word and symbol counts of a text, and cross-document line frequency.

Lines are normalised (lower case, runs of digits to 0, white space squeezed) and hashed. A line is
above the limit at a host when more than ``LINE_LIMIT`` distinct documents of the host hold it,
copies of one text under several ids included. Such lines are removed, and a document is depleted
when less than ``MIN_KEPT`` of its characters in lines remain.

All of it is DataFrame code. Documents with the same host and text share one verdict, so joins
run on these and not on the id. The hot side of a join is a plain scan, which adaptive execution
can split; counts are combined before each shuffle.

Defined cases: a null text counts as empty (no words, so it fails); a null host is a host of its
own; empty lines are never counted; repeated rows (equal id, host and text) repeat and count as
one document, a null id being an id of its own; an id with several texts is a document for each;
further columns are not looked at; an empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import documents, stage, text_key

WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20
LINE_LIMIT = 20
MIN_KEPT = 0.3


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns, with ``text`` not null) with the base counts in place of text."""
    kept = [c for c in docs.columns if c != "text"]
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    split = docs.select(*kept, "text", words.alias("w"), lines.alias("lines"))
    counts = split.select(
        *kept, "w", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    kept += ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    starts = F.when(F.col("n_words") >= WINDOW,
                    F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")))
    hashed = counts.select(*kept, F.transform(starts, lambda i: F.xxhash64(
        *[F.get("w", i + k) for k in range(WINDOW)])).alias("h"))
    # only texts with a repeated window sort theirs
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    ordered = hashed.select(*kept, F.when(repeated, F.sort_array(F.transform(
        "h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("z"))
    same = lambda s, k: F.coalesce(F.get("z", k)["h"] == s["h"], F.lit(False))
    places = ordered.select(*kept, F.sort_array(F.transform(
        F.filter("z", lambda s, k: same(s, k - 1) | same(s, k + 1)), lambda s: s["i"])).alias("at"))
    covered = F.aggregate(
        "at", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"),
                              i.alias("last")), lambda a: a["n"])
    return places.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def normalised(text: Column) -> Column:
    """The lines of a text, normalised; still as many as before."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"),
                            "[\\x20\\x09\\x0B-\\x0D]+", " ")
    return F.transform(F.split(flat, "\n", -1), lambda x: F.trim(x))


def line_table(docs: DataFrame) -> DataFrame:
    """(host, key, line, n_chars): distinct lines of distinct texts of each host.

    ``docs`` has ``host``, ``key`` and ``text``.
    """
    found = docs.select("host", "key", F.explode(F.filter(
        normalised(F.col("text")), lambda x: x != "")).alias("text"))
    hashed = found.select("host", "key", F.xxhash64("text").alias("line"),
                          F.length("text").cast("long").alias("n_chars"))
    # a copy's lines are the same rows again; repeats inside a text keep their characters once
    return hashed.groupBy("host", "key", "line").agg(F.max("n_chars").alias("n_chars"))


def copied(docs: DataFrame) -> DataFrame:
    """(host, key, n_docs) of the texts that several documents (``doc_id``) of a host hold."""
    ids = docs.select("host", "key", "doc_id").distinct()
    return ids.groupBy("host", "key").agg(F.count("*").alias("n_docs")).where("n_docs > 1")


def frequent_lines(lines: DataFrame, copies: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """(host, line, n_docs) of lines that more than ``limit`` documents of a host hold; a text's
    lines stand in ``lines`` once, and ``copies`` has the texts held by several."""
    c = copies.select(F.col("host").alias("c_host"), F.col("key").alias("c_key"), "n_docs")
    held = lines.join(c, F.col("host").eqNullSafe(F.col("c_host"))
                      & (F.col("key") == F.col("c_key")), "left")
    return (held.groupBy("host", "line").agg(F.sum(F.coalesce("n_docs", F.lit(1))).alias("n_docs"))
            .where(F.col("n_docs") > limit))


def depleted(lines: DataFrame, frequent: DataFrame, min_kept: float = MIN_KEPT) -> DataFrame:
    """(host, key) of documents of which too little remains."""
    f = frequent.select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))
    marked = lines.join(f, F.col("host").eqNullSafe(F.col("f_host"))
                        & (F.col("line") == F.col("f_line")), "left")
    share = marked.groupBy("host", "key").agg(
        F.sum("n_chars").alias("n"),
        F.sum(F.when(F.col("f_line").isNull(), F.col("n_chars")).otherwise(0)).alias("left"))
    return share.where(F.col("left") < min_kept * F.col("n")).select("host", "key")


def prepared(docs: DataFrame, host: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.col(host).alias("host"), text.alias("text"),
                       text_key(text).alias("key"))


def line_rules(docs: DataFrame, host: str = "source", limit: int = LINE_LIMIT,
               min_kept: float = MIN_KEPT) -> DataFrame:
    """Base counts, ``base_failed``, ``depleted`` and ``kept`` of every document."""
    ready = prepared(docs, host)
    lines = stage(line_table(ready), "lines")
    frequent = stage(frequent_lines(lines, stage(copied(ready), "copies"), limit), "frequent")
    gone = stage(depleted(lines, frequent, min_kept), "depleted").select(
        F.col("host").alias("g_host"), F.col("key").alias("g_key"))
    counts = base_counts(ready)
    found = counts.join(gone, F.col("host").eqNullSafe(F.col("g_host"))
                        & (F.col("key") == F.col("g_key")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.col("g_key").isNotNull().alias("depleted"),
        (~failed & F.col("g_key").isNull()).alias("kept"))


def cleaned(docs: DataFrame, host: str = "source", limit: int = LINE_LIMIT) -> DataFrame:
    """(host, key, text): each distinct text of a host without its lines above the limit."""
    ready = prepared(docs, host)
    lines, copies = stage(line_table(ready), "lines"), stage(copied(ready), "copies")
    frequent = stage(frequent_lines(lines, copies, limit), "frequent")
    f = frequent.select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))
    texts = ready.groupBy("host", "key").agg(F.first("text").alias("text"))
    both = F.arrays_zip(F.split("text", "\n", -1).alias("raw"),
                        normalised(F.col("text")).alias("flat"))
    parts = texts.select("host", "key", F.posexplode(both).alias("pos", "p"))
    left = parts.join(f, F.col("host").eqNullSafe(F.col("f_host"))
                      & (F.xxhash64("p.flat") == F.col("f_line")), "left_anti")
    back = left.groupBy("host", "key").agg(F.sort_array(
        F.collect_list(F.struct("pos", "p.raw"))).alias("parts"))
    return back.select("host", "key", F.array_join(F.col("parts.raw"), "\n").alias("text"))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(documents(spark, sf_dir))


OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, source, coalesce(text, '') t FROM documents),
w AS (SELECT rid, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') w,
             list_filter(string_split(t, chr(10)),
                         lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') s
        FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) n FROM win)
        WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) n FROM (SELECT rid, unnest(range(i, i + 5)) p FROM dup)
        GROUP BY rid),
lines AS (SELECT DISTINCT source, t, trim(l, ' ') l FROM (
    SELECT source, t, unnest(string_split(regexp_replace(regexp_replace(
        lower(t), '[0-9]+', '0', 'g'), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), chr(10))) l FROM d)
    WHERE trim(l, ' ') <> ''),
freq AS (SELECT source, l FROM lines GROUP BY source, l HAVING count(*) > {LINE_LIMIT}),
gone AS (SELECT a.source, a.t FROM lines a
         LEFT JOIN freq f ON a.source IS NOT DISTINCT FROM f.source AND a.l = f.l
         GROUP BY a.source, a.t
         HAVING sum(CASE WHEN f.l IS NULL THEN length(a.l) ELSE 0 END)
                < {MIN_KEPT} * sum(length(a.l))),
b AS (SELECT d.doc_id, len(w.w)::BIGINT n_words,
             length(array_to_string(w.w, ''))::BIGINT word_chars,
             len(regexp_extract_all(d.t, '{SYMBOLS}'))::BIGINT n_symbols,
             (len(w.ls) - len(list_distinct(w.ls)))::BIGINT n_dup_lines,
             coalesce(rep.n, 0)::BIGINT n_repeat_words, g.t IS NOT NULL depleted
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid)
      LEFT JOIN gone g ON d.source IS NOT DISTINCT FROM g.source AND d.t = g.t)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)
       AND NOT depleted AS kept
FROM b
"""
