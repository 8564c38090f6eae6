"""Sample catalog: migration to the current layout, and the rules of a valid catalog."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom import fixed
from weekloom.functions.text import strip

REFERENCE = ("kind:string,path:string,sha256:string,archive_path:string,archive_sha256:string,"
             "member_name:string,member_sha256:string,selectors:array<string>,"
             "member_sha256s:array<string>,ingestion_profile:string,sample_id:string")
SAMPLE_SCHEMA = (
    "struct<sample_id:string,market:string,period_start:string,period_end:string,"
    "review_status:string,workflow_status:string,"
    f"source:struct<{REFERENCE}>,deck:struct<{REFERENCE}>,golden_json:struct<{REFERENCE}>,"
    f"previous_source:struct<{REFERENCE}>,"
    "bundle:struct<path:string,sha256:string,period_start:string,period_end:string>,"
    "reviewed_deck:struct<path:string,sha256:string>,"
    "review:struct<reviewer:string,approved_at:string,notes:string>,tags:array<string>>")


def parse(text) -> DataFrame:
    """One parsed sample per JSON text."""
    return F.from_json(text, SAMPLE_SCHEMA)


def _reference(kind, path, sha256, profile=None):
    values = {"kind": kind, "path": path, "sha256": sha256}
    if profile:
        values["ingestion_profile"] = F.lit(profile)
    fields = [f.split(":")[0] for f in REFERENCE.split(",")]
    return F.struct(*[values.get(f, F.lit(None).cast(
        "array<string>" if f in ("selectors", "member_sha256s") else "string")).alias(f)
        for f in fields])


def normalize(raw: DataFrame) -> DataFrame:
    """Fill defaults and legacy fields; ``problems`` lists what makes a sample invalid.

    ``raw`` has the columns of ``SAMPLE_SCHEMA`` (others pass through).
    """
    c = F.col
    first = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    df = raw.withColumns({
        "sample_id": strip(F.coalesce("sample_id", F.lit(""))),
        "market": strip(F.upper(F.coalesce("market", F.lit("")))),
        "period_start": first(c("period_start"), c("bundle.period_start")).try_cast("date"),
        "period_end": first(c("period_end"), c("bundle.period_end")).try_cast("date"),
        "source": F.coalesce("source", F.when(c("bundle").isNotNull(), _reference(
            F.lit("zip_bundle"), c("bundle.path"), c("bundle.sha256"), fixed.BUNDLE_PROFILE))),
        "deck": F.coalesce("deck", F.when(c("reviewed_deck").isNotNull(), _reference(
            F.lit("file"), c("reviewed_deck.path"), c("reviewed_deck.sha256")))),
        "tags": F.coalesce("tags", F.array().cast("array<string>")),
        "workflow_status": F.coalesce("workflow_status", F.lit("reference_only"))})
    df = df.withColumn("review_status", F.coalesce("review_status", F.when(
        c("deck").isNotNull(), "historical_reference").otherwise("candidate")))
    same_id = df.groupBy("sample_id").agg(F.count("*").alias("n_id"))
    period = ["market", "period_start", "period_end"]
    same_period = df.groupBy(*period).agg(F.count("*").alias("n_period"))
    df = df.join(same_id, "sample_id").join(same_period, period, "left")
    problems = F.array_compact(F.array(
        F.when(c("sample_id") == "", "missing_sample_id"),
        F.when((c("sample_id") != "") & (c("n_id") > 1), "duplicate_sample_id"),
        F.when(c("market") == "", "missing_market"),
        F.when(c("period_start").isNull() | c("period_end").isNull(), "invalid_period"),
        F.when(c("period_end") < c("period_start"), "inverted_period"),
        F.when(c("n_period") > 1, "duplicate_market_period"),
        F.when(~c("review_status").isin(fixed.REVIEW_STATUSES), "review_status"),
        F.when(~c("workflow_status").isin(fixed.WORKFLOW_STATUSES), "workflow_status"),
        F.when(c("source").isNull(), "missing_source")))
    return df.withColumn("problems", problems).drop("n_id", "n_period")


def status_counts(samples: DataFrame, minimum: int = fixed.CATALOG_MINIMUM,
                  target: int = fixed.CATALOG_TARGET) -> DataFrame:
    n = lambda col, value: F.count_if(F.col(col) == value)
    counts = samples.agg(
        F.count("*").alias("inventory_count"), n("review_status", "approved")
        .alias("approved_count"),
        *[n("workflow_status", s).alias(f"{s}_count") for s in fixed.WORKFLOW_STATUSES],
        *[n("review_status", s).alias(f"{s}_count") for s in fixed.REVIEW_STATUSES
          if s != "approved"])
    left = lambda bound, col: F.greatest(F.lit(0), bound - F.col(col))
    return counts.select(
        "*", left(minimum, "inventory_count").alias("remaining_inventory_to_minimum"),
        left(target, "inventory_count").alias("remaining_inventory_to_target"),
        (F.col("inventory_count") >= minimum).alias("inventory_minimum_met"),
        left(minimum, "approved_count").alias("remaining_approved_to_minimum"),
        (F.col("approved_count") >= minimum).alias("approved_minimum_met"))


def registration_problems(incoming: DataFrame, existing: DataFrame, replace: bool = False
                          ) -> DataFrame:
    """Why a new sample may not enter the catalog.

    Both sides hold ``sample_id, market, period_start, period_end, source_sha256, content``,
    where content is everything that makes two registrations equal. New samples are held against
    each other too: of one period or source, only the first id of the batch may enter.
    """
    c = F.col
    first = lambda keys: incoming.where(" and ".join(
        f"{k} is not null" for k in keys)).groupBy(*keys).agg(
        F.min("sample_id").alias(f"first_{keys[-1]}"))
    old = existing.select("sample_id", c("content").alias("old_content"))
    df = incoming.join(old, "sample_id", "left")
    others = lambda keys, name: existing.groupBy(*keys).agg(
        F.count("*").alias(f"n_{name}"), F.min("sample_id").alias(f"lo_{name}"),
        F.max("sample_id").alias(f"hi_{name}"))
    period = ["market", "period_start", "period_end"]
    df = df.join(others(period, "p"), period, "left").join(
        others(["source_sha256"], "s"), "source_sha256", "left")
    # an entry of the same id is the one being replaced, so it does not count as another
    foreign = lambda name: c(f"n_{name}").isNotNull() & (
        (c(f"lo_{name}") != c("sample_id")) | (c(f"hi_{name}") != c("sample_id")))
    df = df.join(first(period), period, "left").join(
        first(["source_sha256"]), "source_sha256", "left")
    later = lambda key: c(f"first_{key}") < c("sample_id")
    same = c("old_content").eqNullSafe(c("content")) & c("old_content").isNotNull()
    problem = (F.when(same, F.lit(None).cast("string"))
               .when(c("old_content").isNotNull() & F.lit(not replace), "different_metadata")
               .when(foreign("p"), "duplicate_market_period")
               .when(foreign("s"), "duplicate_source")
               .when(later("period_end"), "duplicate_market_period")
               .when(later("source_sha256"), "duplicate_source"))
    return df.select("sample_id", same.alias("unchanged"), problem.alias("problem"))


