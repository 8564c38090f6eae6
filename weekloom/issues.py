"""Rows of the issues table: (key, severity, code, path, actual, expected, tolerance, message)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom import KEY

FIELDS = ["severity", "code", "path", "actual", "expected", "tolerance", "message"]


def issue_struct(severity, code, path, actual=None, expected=None, tolerance=None,
                 message=None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(severity).cast("string").alias("severity"),
        as_col(code).cast("string").alias("code"), as_col(path).cast("string").alias("path"),
        as_col(actual).cast("string").alias("actual"),
        as_col(expected).cast("string").alias("expected"),
        as_col(tolerance).cast("double").alias("tolerance"),
        as_col(message).cast("string").alias("message"))


def issue(df: DataFrame, severity, code, path, **more) -> DataFrame:
    row = issue_struct(severity, code, path, **more)
    return df.select(*KEY, row.alias("i")).select(*KEY, *[f"i.{f}" for f in FIELDS])


def emit(df: DataFrame, *rules: tuple[Column, Column]) -> DataFrame:
    """All (condition, issue struct) rules of a row at once, without a scan per rule."""
    found = F.array(*[F.when(cond, row) for cond, row in rules])
    return (df.select(*KEY, F.explode(F.filter(found, lambda r: r.isNotNull())).alias("i"))
            .select(*KEY, *[f"i.{f}" for f in FIELDS]))


def verdict(bundles: DataFrame, issues: DataFrame) -> DataFrame:
    """Error and warning counts of every bundle; a bundle passes without errors."""
    counts = issues.groupBy(*KEY).agg(
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (bundles.select(*KEY).distinct().join(counts, KEY, "left")
            .select(*KEY, zero("errors"), zero("warnings"))
            .withColumn("passed", F.col("errors") == 0))


def publishable(df: DataFrame, issues: DataFrame) -> DataFrame:
    """Rows of bundles that have no error."""
    return df.join(issues.where("severity = 'ERROR'").select(*KEY), KEY, "left_anti")
