"""Publishing: a run's outcome per bundle, issues, reports, mart and history records, committed
together.

Tables are versioned (``sources.versions``). Outcomes and issues are replaced by bundle: a bundle
of the run loses all it had before, so a mended one keeps no old error. Reports and mart rows of
a bundle of the run are replaced too, and are gone if it does not pass any more. Records (the
metrics and entities of one market and period, history and snapshot in one row) stay until a
report of the same market and period passes.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weekloom import KEY, fixed
from weekloom.functions.text import report_stem
from weekloom.issues import FIELDS, issue, publishable
from weekloom.operators import marts
from weekloom.operators import wow as X
from weekloom.plans.weekly import change_report
from weekloom.session import cut, cut_all
from weekloom.sources import history as H
from weekloom.sources import versions as V

ENTITY = ("array<struct<scope:string,product_id:string,name:string,idx:bigint,row_name:string,"
          "metrics:array<struct<key:string,value:double>>>>")
METRICS = ", ".join(f"{m} {'bigint' if m in H.INTEGERS else 'double'}"
                    for m in fixed.OVERALL_METRICS)
DATES = "period_start date, period_end date"
RECORD = (f"market string, {DATES}, load_ts bigint, bundle_id string, "
          f"source_bundle_sha256 string, currency string, {METRICS}, entities {ENTITY}")
OUTCOME = (f"bundle_id string, market string, {DATES}, passed boolean, errors bigint, "
           "warnings bigint, source_sha256 string, files_sha256 string, load_ts bigint")
ISSUE = (f"bundle_id string, market string, {DATES}, severity string, code string, path string, "
         "actual string, expected string, tolerance double, message string")
REPORT = f"bundle_id string, market string, {DATES}, file_stem string, report_json string"
MART = (f"bundle_id string, market string, {DATES}, slide int, slot string, category string, "
        "series string, value double")
OF_BUNDLE = V.part_of("bundle_id")
OF_PERIOD = V.part_of("market", year="period_start")
#: table: (columns, part of a row)
TABLES = {"outcomes": (OUTCOME, OF_BUNDLE), "issues": (ISSUE, OF_BUNDLE),
          "reports": (REPORT, OF_PERIOD), "mart": (MART, OF_PERIOD),
          "records": (RECORD, OF_PERIOD)}


def columns(table: str) -> list[str]:
    return StructType.fromDDL(TABLES[table][0]).names


def records(result: dict, reports: DataFrame, load_ts: int) -> DataFrame:
    """One row per published report. A report's entities are bounded by its rules."""
    item = F.struct("scope", "product_id", "name", "idx", "row_name",
                    F.map_entries("metrics").alias("metrics"))
    own = (X.entities(result["facts"]).join(reports.select(*KEY), KEY, "left_semi")
           .groupBy(*KEY).agg(F.sort_array(F.collect_list(item)).alias("entities")))
    rows = with_digests(reports.join(own, KEY), result).withColumns({
        "load_ts": F.lit(load_ts).cast("bigint"), "source_bundle_sha256": F.col("source_sha256")})
    kinds = StructType.fromDDL(RECORD)
    return rows.select(*[F.col(f.name).cast(f.dataType) if f.name != "entities" else "entities"
                         for f in kinds])


def with_digests(df: DataFrame, result: dict) -> DataFrame:
    """The digests of each bundle's sources, where the run knows them."""
    for part, digest in (("sources", "source_sha256"), ("prints", "files_sha256")):
        known = result.get(part)
        df = (df.withColumn(digest, F.lit(None).cast("string")) if known is None else
              df.join(known.select("bundle_id", digest), "bundle_id", "left"))
    return df


def stored(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table as of the last committed run; empty where nothing was published yet."""
    return V.read(spark, folder, V.state(spark, folder), table, TABLES[table][0])


def stored_records(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "records")


def stored_history(stored: DataFrame) -> DataFrame:
    """Records as the history that ``weekly_report`` looks back to."""
    return stored.select(*H.SEED_FIELDS, "bundle_id", F.lit(True).alias("is_db"),
                         F.lit("history").alias("source_file"))


def stored_entities(stored: DataFrame) -> DataFrame:
    """Records as the entity rows of change facts."""
    rows = stored.select(*KEY, F.explode("entities").alias("e"))
    return rows.select(*KEY, *[f"e.{c}" for c in (*X.IDENT, "idx", "row_name")],
                       F.map_from_entries("e.metrics").alias("metrics"))


def guarded_issues(result: dict) -> DataFrame:
    """All issues of a run with those that keep a report out of history: what may not be written,
    and two bundles of one market and period that would both be published."""
    issues = result["issues"].unionByName(H.write_guards(result["reports"]))
    passing = publishable(result["reports"], issues).select(*KEY)
    twice = passing.groupBy(*H.IDENTITY).agg(F.count("*").alias("n")).where("n > 1")
    return issues.unionByName(issue(
        passing.join(twice, H.IDENTITY), "ERROR", "DUPLICATE_MARKET_PERIOD", "history",
        actual=F.col("n"), expected=F.lit(1)).select(*KEY, *FIELDS))


def outcomes(result: dict, issues: DataFrame, load_ts: int) -> DataFrame:
    """One row per bundle of the run, whether it could be keyed or not."""
    keyed = result["found"]["per_kind"].select(*KEY).distinct()
    bundles = result.get("bundles", keyed).select("bundle_id").distinct()
    count = lambda kind: F.count_if(F.col("severity") == kind)
    counts = issues.groupBy("bundle_id").agg(count("ERROR").alias("errors"),
                                             count("WARNING").alias("warnings"))
    rows = bundles.join(keyed, "bundle_id", "left").join(counts, "bundle_id", "left")
    none = F.lit(0).cast("bigint")
    rows = with_digests(rows, result).withColumns({
        "errors": F.coalesce("errors", none), "warnings": F.coalesce("warnings", none),
        "load_ts": F.lit(load_ts).cast("bigint")})
    return rows.withColumn("passed", F.col("market").isNotNull() & (F.col("errors") == 0)).select(
        *columns("outcomes"))


def report_rows(nested: DataFrame) -> DataFrame:
    """Nested reports as indented JSON, each with the stem of its file's name."""
    stem = report_stem(F.col("market"), F.col("period_start"), F.col("period_end"))
    return nested.select(*KEY, stem.alias("file_stem"), F.to_json(
        F.struct(*nested.columns), {"pretty": "true"}).alias("report_json"))


def publish(spark: SparkSession, result: dict, folder: str, load_ts: int) -> dict[str, DataFrame]:
    """Write what a run changes and commit it by one row. A run that stops before that, or is
    repeated, leaves or gives the same tables."""
    at = V.state(spark, folder)
    run = f"{load_ts}-{uuid.uuid4().hex[:12]}"
    parts = [guarded_issues(result), *[result[k] for k in ("unkeyed", "source_issues")
                                       if k in result]]
    issues = parts[0].select(*columns("issues"))
    for part in parts[1:]:
        issues = issues.unionByName(part.select(*columns("issues")))
    issues = cut(issues)
    reports = cut(publishable(result["reports"], issues))
    facts = {name: publishable(f, issues) for name, f in result["facts"].items()}
    rows = {"outcomes": outcomes(result, issues, load_ts), "issues": issues,
            "reports": report_rows(marts.canonical_report(facts, reports)),
            "mart": marts.report_mart(facts, reports), "records": records(result, reports, load_ts)}
    # written first, as old parts are read to write the new ones
    rows = cut_all({name: df.select(*columns(name)) for name, df in rows.items()})
    done = rows["outcomes"].select("bundle_id")
    periods = reports.select(*H.IDENTITY)
    before = V.read(spark, folder, at, "outcomes", OUTCOME).join(done, "bundle_id", "left_semi")
    of_bundle = V.touched(done, OF_BUNDLE)
    of_new = V.touched(periods, OF_PERIOD)
    of_old = V.touched(before.where("market is not null"), OF_PERIOD)

    def by_bundle(name):
        return lambda old: old.join(done, "bundle_id", "left_anti").unionByName(rows[name])

    def by_both(name):
        return lambda old: (old.join(done, "bundle_id", "left_anti")
                            .join(periods, H.IDENTITY, "left_anti").unionByName(rows[name]))

    plan = {"outcomes": (of_bundle, by_bundle("outcomes")),
            "issues": (of_bundle, by_bundle("issues")),
            "reports": (sorted({*of_new, *of_old}), by_both("reports")),
            "mart": (sorted({*of_new, *of_old}), by_both("mart")),
            "records": (of_new, lambda old: H.upsert(old, rows["records"]))}
    places = {name: V.rewrite(spark, folder, at, run, name, *TABLES[name], touched, merge)
              for name, (touched, merge) in plan.items()}
    V.commit(spark, folder, at, run, load_ts, places)
    return {"issues": issues, "reports": reports}


def export_reports(spark: SparkSession, folder: str, path: str) -> None:
    """The published reports as JSON text, apart by market and period."""
    rows = stored(spark, folder, "reports").select(
        "market", "period_start", "period_end", F.col("report_json").alias("value"))
    (rows.write.mode("overwrite").option("lineSep", "\n\n")
     .partitionBy("market", "period_start", "period_end").text(path))


def stored_change_report(result: dict, stored: DataFrame) -> DataFrame:
    """Change facts of this run's publishable bundles against published weeks, of this run or
    of earlier ones."""
    return change_report({**result, "issues": guarded_issues(result)}, stored.select(
        *KEY, "currency"), stored_entities(stored))
