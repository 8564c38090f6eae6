"""Filter interaction audit: what each filter removes in every order, alone and after others.

The removal game of a part of the corpus gives a coalition of filters the number of documents
that fail any of them. Its Hart-Mas-Colell potential is computed recursively over the coalitions;
a filter's Shapley value is the potential of all filters minus the potential without it. A step
of an order is the difference of two coalitions. So one count per set of failed filters is all
that is read from the corpus, and the orders cost nothing but output rows.

All of it is DataFrame code. Copies are found by a hash of the text: counts of (text, part) are
combined before they meet, so a text that a third of all rows share is a few rows of a join.

Defined cases: a null or empty text has no words and no characters, and fails only the filter on
few words (and the one on copies, as any text); a null id is no smaller or greater than any, so
it neither fails as a copy nor makes others fail; rows that share an id and a text are no copies
of each other; ids with several label rows take the greatest label; very long texts count whole;
further columns are not looked at; an empty table gives an empty result.
"""

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import WORD_BREAK, documents, stage, text_key

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
ORDERS = 120
MIN_WORDS = 100
DISTINCT_SHARE = 80
UPPER_SHARE = 10
SIGNS = "[#$%&*|]"


def own_failures(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` (not null) replaced by its key and a mask of the filters A to D
    that it fails; bit 0 is A."""
    kept = [c for c in docs.columns if c != "text"]
    words = F.filter(F.split("text", WORD_BREAK, -1), lambda w: w != "")
    split = docs.select(*kept, "text", words.alias("w"))
    n, distinct = F.size("w").cast("long"), F.size(F.array_distinct("w")).cast("long")
    letters = F.length("text").cast("long")
    upper = letters - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = [n < MIN_WORDS, 100 * distinct < DISTINCT_SHARE * n,
             100 * upper > UPPER_SHARE * letters, F.col("text").rlike(SIGNS)]
    mask = sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    return split.select(*kept, text_key(F.col("text")).alias("key"), mask.alias("mask"))


def failure_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail."""
    marks = labels.groupBy(F.col("doc_id").alias("l_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"),
        F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    text = F.coalesce("text", F.lit(""))
    rows = own_failures(docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit(""))
                                    .alias("part"), text.alias("text")))
    sums = lambda of="": [F.sum(c).alias(c + of) for c in ("n", "good", "toxic")]
    by_id = rows.groupBy("key", "part", "mask", "doc_id").agg(F.count("*").alias("n"))
    marked = by_id.join(marks, F.col("doc_id") == F.col("l_id"), "left").select(
        "key", "part", "mask", "doc_id", "n",
        *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    counted = F.struct("n", "good", "toxic")
    # rows at the least id, and rows without an id, are no copies
    groups = stage(marked.groupBy("key", "part", "mask").agg(
        *sums(), F.min("doc_id").alias("least"), F.min_by(counted, "doc_id").alias("first"),
        *[F.sum(F.when(F.col("doc_id").isNull(), F.col(c)).otherwise(0)).alias(f"{c}_0")
          for c in ("n", "good", "toxic")]), "texts")
    least = groups.groupBy(F.col("key").alias("t_key")).agg(F.min("least").alias("t_least"))
    both = groups.join(least, F.col("key") == F.col("t_key"))
    here = F.col("least") == F.col("t_least")
    single = {c: F.col(f"{c}_0") + F.when(here, F.col(f"first.{c}")).otherwise(0)
              for c in ("n", "good", "toxic")}
    sides = F.explode(F.array(
        F.struct(F.col("mask"), *[v.alias(c) for c, v in single.items()]),
        F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"),
                 *[(F.col(c) - v).alias(c) for c, v in single.items()]))).alias("s")
    return both.select("part", sides).select("part", "s.*").groupBy("part", "mask").agg(*sums())


def potential(game: Column) -> Column:
    """The potential of every coalition times 120, exact in whole numbers.

    ``game`` is an array of a value per coalition, by its bits. A coalition's potential is its
    value plus the potentials of it without each member, over its size; coalitions come in the
    order of their bits, so smaller ones are known.
    """
    def after(known: Column, s: Column) -> Column:
        rest = [F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, s.bitwiseXOR(
            F.lit(1 << i)))).otherwise(0) for i in range(len(FILTERS))]
        total = sum(rest, ORDERS * F.get(game, s))
        return F.concat(known, F.array(
            F.call_function("div", total, F.bit_count(s).cast("long"))))

    none = F.array(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), none, after)


def coalitions(counts: DataFrame) -> DataFrame:
    """(part, total, removed, good, toxic, q): per part its size, and arrays by coalition of what
    the coalition removes and of the potential of ``removed``."""
    totals = counts.groupBy("part").agg(F.sum("n").alias("total"))
    spread = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("s"))
    hit = F.col("mask").bitwiseAND(F.col("s")) != 0
    games = spread.groupBy("part", "s").agg(*[
        F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")])
    # 32 rows a part
    listed = games.groupBy("part").agg(F.sort_array(F.collect_list(
        F.struct("s", "n", "good", "toxic"))).alias("g"))
    arrays = listed.select("part", F.col("g.n").alias("removed"), F.col("g.good").alias("good"),
                           F.col("g.toxic").alias("toxic"))
    return arrays.withColumn("q", potential(F.col("removed"))).join(totals, "part")


def steps(games: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    bits = [*range(len(FILTERS))]
    names = F.array(*[F.lit(f) for f in FILTERS])
    orders = F.array(*[F.array(*[F.lit(i) for i in order]) for order in permutations(bits)])
    rows = games.select("*", F.explode(orders).alias("order")).select(
        "*", F.posexplode("order").alias("at", "i"))
    bit = F.call_function("shiftleft", F.lit(1), F.col("i"))
    earlier = F.aggregate(F.slice("order", F.lit(1), F.col("at")), F.lit(0),
                          lambda a, i: a + F.call_function("shiftleft", F.lit(1), i))
    rows = rows.withColumns({"bit": bit, "before": earlier}).withColumn(
        "now", F.col("before").bitwiseOR(F.col("bit")))
    gain = lambda c: F.get(c, "now") - F.get(c, "before")
    rest = F.lit(ALL).bitwiseXOR(F.col("bit"))
    return rows.select(
        "part", F.array_join(F.transform("order", lambda i: F.get(names, i)), "")
        .alias("filter_order"), (F.col("at") + 1).alias("step"),
        (F.col("total") - F.get("removed", "now")).alias("kept"),
        gain("removed").alias("removed"),
        (F.get("removed", "bit") - gain("removed")).alias("redundant"),
        (F.get("removed", F.lit(ALL)) - F.get("removed", rest)).alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"),
        (F.get("q", F.lit(ALL)) - F.get("q", rest)).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Every step of every order of the filters, for each part."""
    return steps(coalitions(failure_counts(docs, labels, part)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = f"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) good,
                  max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') t,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w FROM documents),
least AS (SELECT t, min(doc_id) least FROM t GROUP BY t),
f AS (SELECT t.part, coalesce(l.good, 0) good, coalesce(l.toxic, 0) toxic,
             [len(w) < {MIN_WORDS}, 100 * len(list_distinct(w)) < {DISTINCT_SHARE} * len(w),
              100 * len(regexp_extract_all(t.t, '[A-Z]')) > {UPPER_SHARE} * length(t.t),
              regexp_matches(t.t, '{SIGNS}'), coalesce(t.doc_id > least.least, false)] fails
      FROM t JOIN least ON t.t = least.t LEFT JOIN l ON t.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) n, sum(good) good, sum(toxic) toxic FROM f GROUP BY ALL),
i AS (SELECT unnest(range(1, 6)) i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] o FROM i a, i b, i c, i d, i e
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
r AS (SELECT part, o, step, n, good, toxic, fails[o[step]] own,
             list_contains([fails[k] FOR k IN o[1:step - 1]], true) gone,
             len([x FOR x IN fails IF x]) n_fails
      FROM g, o, (SELECT i AS step FROM i)),
s AS (SELECT part, o, step,
             coalesce(sum(n) FILTER (NOT gone AND NOT own), 0) kept,
             coalesce(sum(n) FILTER (NOT gone AND own), 0) removed,
             coalesce(sum(n) FILTER (gone AND own), 0) redundant,
             coalesce(sum(n) FILTER (own AND n_fails = 1), 0) unique_fails,
             coalesce(sum(good) FILTER (NOT gone AND own), 0) good_lost,
             coalesce(sum(toxic) FILTER (NOT gone AND own), 0) toxic_lost
      FROM r GROUP BY ALL)
SELECT part, array_to_string([substr('{FILTERS}', k, 1) FOR k IN o], '') filter_order,
       step::INTEGER step, kept::BIGINT kept, removed::BIGINT removed,
       redundant::BIGINT redundant, unique_fails::BIGINT unique_fails,
       good_lost::BIGINT good_lost, toxic_lost::BIGINT toxic_lost,
       (sum(removed) OVER (PARTITION BY part, o[step]))::BIGINT shapley
FROM s
"""
