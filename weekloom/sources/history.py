"""Report history: seeds, guarded upserts, snapshots and the previous period."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom import fixed
from weekloom.issues import issue
from weekloom.session import cut

IDENTITY = ["market", "period_start", "period_end"]
SEED_FIELDS = [*IDENTITY, *fixed.OVERALL_METRICS]
INTEGERS = {"purchases", "adds_to_cart", "link_clicks"}
SEED_SCHEMA = "array<struct<market:string,period_start:date,period_end:date," + ",".join(
    f"{m}:{'bigint' if m in INTEGERS else 'double'}" for m in fixed.OVERALL_METRICS) + ">>"


def parse_seeds(text: Column) -> Column:
    """Seed objects of a JSON array; fields that are not part of a record are dropped."""
    return F.from_json(text, SEED_SCHEMA)


def seed_records(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, incomplete): seeds of ``files(file, text)`` split by required fields."""
    rows = files.select("file", F.posexplode(parse_seeds(F.col("text"))).alias("position", "r"))
    rows = rows.select("file", "position", *[F.col(f"r.{f}").alias(f) for f in SEED_FIELDS])
    lacking = F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in SEED_FIELDS]))
    rows = rows.withColumn("missing", lacking)
    return (rows.where(F.size("missing") == 0).drop("missing"),
            rows.where(F.size("missing") > 0).select("file", "position", "missing"))


def write_guards(reports: DataFrame) -> DataFrame:
    """Errors that keep a report out of history."""
    low = F.least(*[F.col(m).cast("double") for m in fixed.OVERALL_METRICS])
    code = (F.when(F.col("overall_market") != F.col("market"), "HISTORY_MARKET_MISMATCH")
            .when((F.col("overall_start") != F.col("period_start"))
                  | (F.col("overall_end") != F.col("period_end")), "HISTORY_PERIOD_MISMATCH")
            .when(F.col("period_end") < F.col("period_start"), "HISTORY_PERIOD_INVERTED")
            .when(low < 0, "HISTORY_NEGATIVE_METRIC"))
    return issue(reports.withColumn("_code", code).where("_code is not null"), "ERROR",
                 F.col("_code"), "history")


def upsert(existing: DataFrame, incoming: DataFrame, order: str = "load_ts") -> DataFrame:
    """One row per market and period; the latest load wins, and of equal loads the greatest row.

    ``max_by`` combines before the shuffle, so repeated loads of one week never meet in one task.
    """
    both = existing.unionByName(incoming)
    row = F.struct(*[c for c in both.columns if c not in IDENTITY])
    kept = both.groupBy(*IDENTITY).agg(F.max_by(row, F.struct(
        F.col(order), *[c for c in sorted(both.columns) if c not in IDENTITY])).alias("r"))
    return kept.select(*IDENTITY, "r.*")


def commit(spark, path: str, incoming: DataFrame) -> None:
    """Merge into the Parquet history at ``path``, replacing only the touched markets.

    The merged rows are staged first, since a table cannot be overwritten while it is read.
    """
    staged_in = cut(incoming)
    try:
        old = spark.read.schema(incoming.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = incoming.limit(0)
    # one value per market of this run, so that only their folders are listed
    markets = [r["market"] for r in staged_in.select("market").distinct().collect()]
    merged = upsert(old.where(F.col("market").isin(markets)), staged_in)
    staged = cut(merged)
    (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("market").parquet(path))


def snapshot_issues(snapshots: DataFrame) -> DataFrame:
    """Stored snapshots whose payload names another market or period, or cannot be read."""
    wrong = F.col("report.market").isNull() | ~(
        F.col("market").eqNullSafe(F.col("report.market"))
        & F.col("period_start").eqNullSafe(F.col("report.period_start"))
        & F.col("period_end").eqNullSafe(F.col("report.period_end")))
    code = F.when(F.col("report.market").isNull(), "SNAPSHOT_INVALID").otherwise(
        "SNAPSHOT_IDENTITY_MISMATCH")
    return issue(snapshots.where(wrong), "ERROR", code, "snapshot")


def previous_period(current: DataFrame, history: DataFrame) -> DataFrame:
    """As-of join: for each (market, period_start) the latest record ending before it.

    Both sides shrink to one row per market and day before the window, so its partitions are
    bounded by the calendar whatever the number of reports.
    """
    fields = [c for c in history.columns if c != "market"]
    ties = ["period_start", "is_db", *(["bundle_id"] if "bundle_id" in fields else [])]
    best = history.groupBy("market", F.col("period_end").alias("t")).agg(
        F.max_by(F.struct(*fields), F.struct(*ties)).alias("h"))
    asked = current.select("market", F.col("period_start").alias("t")).distinct()
    line = best.withColumn("turn", F.lit(1)).unionByName(
        asked.withColumn("turn", F.lit(0)), allowMissingColumns=True)
    up_to = W.partitionBy("market").orderBy("t", "turn").rowsBetween(W.unboundedPreceding, 0)
    found = (line.withColumn("previous", F.last("h", ignorenulls=True).over(up_to))
             .where("turn = 0").select("market", F.col("t").alias("period_start"), "previous"))
    return current.join(found, ["market", "period_start"], "left")


def adjacent(previous_end: Column, start: Column) -> Column:
    return previous_end == F.date_sub(start, 1)


