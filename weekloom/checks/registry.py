"""Registry of named queries and their SQL twins."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores, for work that costs far more than reading them: a table of few
    bytes comes in one part, and all of that work would be one task."""
    return rows.repartition(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)


#: parts of a core in ``spread``, so that slow ones even out
TASKS_A_CORE = 4
KEPT: dict[tuple, object] = {}


def once(fn):
    """Keep a staged result per session and folder, for queries that start from the same one."""
    def staged(spark, sf):
        key = (fn.__module__, fn.__name__, spark.sparkContext.applicationId, sf)
        if key not in KEPT:
            KEPT[key] = fn(spark, sf)
        return KEPT[key]

    return staged


def forget():
    """Drop all staged results, so that the next query starts from the tables."""
    KEPT.clear()
