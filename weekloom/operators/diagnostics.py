"""Diagnostics: contract, category, fixed explanations, and contracts on written answers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom import fixed
from weekloom.functions.text import is_blank, nfkc
from weekloom.operators.guards import forbidden, redact


def discovery_category(missing: Column, duplicates: Column) -> Column:
    return (F.when(F.size(missing) > 0, "missing_sources")
            .when(F.size(duplicates) > 0, "duplicate_sources").otherwise("unknown"))


def generation_category(*texts: Column) -> Column:
    """Category of a failed run from its error type and message, by keyword."""
    line = F.lower(F.concat_ws(" ", *texts))
    chain = F.when(F.lit(False), "")
    for category, words in fixed.CATEGORY_KEYWORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | line.contains(word)
        chain = chain.when(hit, category)
    return chain.otherwise("generation")


def contract_problems() -> Column:
    """Names of the limits a diagnostic row breaks.

    Rows are ``(diag_id, category, missing array<string>, duplicates map<string,array<string>>,
    error_type, message)``.
    """
    long = lambda xs: F.exists(xs, lambda x: F.length(x) > fixed.RAW_ITEM_LIMIT)
    keys, lists = F.map_keys("duplicates"), F.map_values("duplicates")
    return F.array_compact(F.array(
        F.when(F.col("category").isNull()
               | ~F.col("category").isin(list(fixed.EXPLANATIONS)), "category"),
        F.when((F.size("missing") > fixed.MAX_MISSING) | long("missing"), "missing"),
        F.when((F.size(keys) > fixed.MAX_DUPLICATE_GROUPS) | long(keys) | F.exists(
            lists, lambda xs: (F.size(xs) > fixed.MAX_DUPLICATE_ITEMS) | long(xs)),
            "duplicates"),
        F.when(F.length("error_type") > fixed.RAW_ERROR_TYPE_LIMIT, "error_type"),
        F.when(F.length("message") > fixed.MESSAGE_LIMIT, "message")))


def normalize(diagnostics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(normalised, problems): redacted diagnostics, and rows outside the contract.

    List items are redacted as rows of their own; lists come back together only for rows that
    met the limits, so at most a few dozen items gather per diagnostic.
    """
    checked = diagnostics.withColumn("problems", contract_problems())
    good = checked.where(F.size("problems") == 0)
    missing = good.select("diag_id", F.posexplode("missing").alias("pos", "raw")).select(
        "diag_id", F.lit("missing").alias("role"), F.lit(0).alias("at"), "pos", "raw")
    groups = good.select("diag_id", F.posexplode(F.map_entries("duplicates")).alias("at", "g"))
    keys = groups.select("diag_id", F.lit("group").alias("role"), "at", F.lit(0).alias("pos"),
                         F.col("g.key").alias("raw"))
    items = groups.select("diag_id", "at", F.posexplode("g.value").alias("pos", "raw")).select(
        "diag_id", F.lit("item").alias("role"), "at", "pos", "raw")
    safe = (missing.unionByName(keys).unionByName(items)
            .withColumn("nfkc", nfkc(F.col("raw")))
            .withColumn("safe", redact(F.col("nfkc"), item=True)))

    def ordered(df, by, pos):
        first = df.groupBy(*by, "safe").agg(F.min(pos).alias("pos"))
        return first.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(
            F.struct("pos", "safe"))), lambda s: s["safe"]).alias("list"))

    missing_list = ordered(safe.where("role = 'missing'"), ["diag_id"], F.col("pos"))
    named = safe.where("role = 'group'").select("diag_id", "at", F.col("safe").alias("name"))
    # groups whose names became equal merge, in order of first appearance
    first = named.groupBy("diag_id", "name").agg(F.min("at").alias("first_at"))
    members = safe.where("role = 'item'").join(named, ["diag_id", "at"])
    merged = ordered(members, ["diag_id", "name"], F.struct("at", "pos"))
    merged = first.join(merged, ["diag_id", "name"], "left").groupBy("diag_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("first_at", "name", F.slice(
            F.coalesce("list", F.array().cast("array<string>")), 1, fixed.MAX_DUPLICATE_ITEMS)
            .alias("items")))), lambda s: F.struct(s["name"].alias("name"),
                                                   s["items"].alias("items")))
        .alias("groups"))
    text = good.select("diag_id", "category", nfkc(F.coalesce("error_type", F.lit("")))
                       .alias("_type"), nfkc(F.coalesce("message", F.lit(""))).alias("_message"))
    result = (text.select("diag_id", "category", redact(F.col("_type")).alias("error_type"),
                          redact(F.col("_message")).alias("message"))
              .join(missing_list.withColumnRenamed("list", "missing"), "diag_id", "left")
              .join(merged, "diag_id", "left"))
    empty = F.array().cast("array<string>")
    result = result.withColumn("missing", F.coalesce("missing", empty)).withColumn(
        "groups", F.coalesce("groups", F.array().cast("array<struct<name:string,"
                                                      "items:array<string>>>")))
    return result, checked.where(F.size("problems") > 0).select("diag_id", "problems")


def affected_items() -> Column:
    names = F.transform("groups", lambda g: g["name"])
    items = (F.when(F.col("category") == "missing_sources", F.col("missing"))
             .when(F.col("category") == "duplicate_sources", names)
             .when(F.col("category") == "period_conflict", F.array(F.lit(fixed.PERIOD_ITEM)))
             .otherwise(F.concat("missing", names)))
    return F.slice(items, 1, fixed.MAX_AFFECTED)


def explanations(spark) -> DataFrame:
    """The fixed explanation of every category, one row each."""
    rows = [(c, tz, te, sz, se, [{"zh": z, "en": e} for z, e in steps])
            for c, (tz, te, sz, se, steps) in fixed.EXPLANATIONS.items()]
    return spark.createDataFrame(
        rows, "category string, title_zh string, title_en string, summary_zh string, "
              "summary_en string, steps array<struct<zh:string,en:string>>")


def explain(normalized: DataFrame) -> DataFrame:
    """Attach the explanation; eight rows of copy are broadcast by their fixed number."""
    copy = F.broadcast(explanations(normalized.sparkSession))
    return (normalized.withColumn("affected_items", affected_items()).join(copy, "category")
            .withColumn("ai_participated", F.lit(False)))


def explanation_problems() -> Column:
    """Broken rules of a written explanation row.

    Rows are ``(keys, category, title_zh, title_en, summary_zh, summary_en,
    steps array<struct<zh,en>>, affected_items, expected_category, expected_items)``.
    """
    keys = ["affected_items", "category", "steps", "summary_en", "summary_zh", "title_en",
            "title_zh"]
    poor = lambda text, n: text.isNull() | is_blank(text) | (F.length(text) > n)
    texts = [F.col(f) for f in fixed.EXPLANATION_LIMITS]
    outlaw = F.lit(False)
    for text in texts:
        outlaw = outlaw | F.coalesce(forbidden(text), F.lit(False))
    outlaw = (outlaw | F.exists("affected_items", forbidden)
              | F.exists("steps", lambda s: forbidden(s["zh"]) | forbidden(s["en"])))
    size = F.size("steps")
    return F.array_compact(F.array(
        F.when(~F.array_sort("keys").eqNullSafe(F.array(*[F.lit(k) for k in keys])), "shape"),
        F.when(~F.col("category").eqNullSafe(F.col("expected_category")), "category"),
        *[F.when(poor(F.col(f), n), f) for f, n in fixed.EXPLANATION_LIMITS.items()],
        F.when(F.col("steps").isNull() | (size < 1) | (size > 3) | F.exists(
            "steps", lambda s: poor(s["zh"], fixed.STEP_LIMIT) | poor(s["en"],
                                                                       fixed.STEP_LIMIT)),
            "steps"),
        F.when(~F.col("affected_items").eqNullSafe(F.col("expected_items"))
               | F.exists("affected_items", lambda i: F.length(i) > fixed.ITEM_LIMIT),
               "affected_items"),
        F.when(F.coalesce(outlaw, F.lit(False)), "forbidden")))


def review_problems() -> Column:
    """Broken rules of a review row ``(keys, schema_version, verdict, summary, anomalies)``."""
    keys = ["anomalies", "schema_version", "summary", "verdict"]

    def bad(a):
        cond = F.coalesce(~a["severity"].isin("INFO", "WARNING", "ERROR"), F.lit(True))
        for field, n in fixed.ANOMALY_LIMITS.items():
            cond = cond | a[field].isNull() | (F.length(a[field]) > n)
        evidence = a["evidence"]
        return cond | evidence.isNull() | (F.size(evidence) > fixed.MAX_EVIDENCE) | F.exists(
            evidence, lambda e: F.length(e) > fixed.EVIDENCE_LIMIT)

    return F.array_compact(F.array(
        F.when(~F.array_sort("keys").eqNullSafe(F.array(*[F.lit(k) for k in keys])), "shape"),
        F.when(~F.col("schema_version").eqNullSafe(F.lit(fixed.REVIEW_VERSION)),
               "schema_version"),
        F.when(~F.coalesce(F.col("verdict").isin("PASS", "REVIEW"), F.lit(False)), "verdict"),
        F.when(F.col("summary").isNull() | is_blank(F.col("summary"))
               | (F.length("summary") > fixed.REVIEW_SUMMARY_LIMIT), "summary"),
        F.when(F.col("anomalies").isNull() | (F.size("anomalies") > fixed.MAX_ANOMALIES)
               | F.exists("anomalies", bad), "anomalies")))


def final_verdict() -> Column:
    """A PASS that lists a warning or an error becomes REVIEW."""
    serious = F.exists("anomalies", lambda a: a["severity"].isin("WARNING", "ERROR"))
    return F.when((F.col("verdict") == "PASS") & serious, "REVIEW").otherwise(F.col("verdict"))
