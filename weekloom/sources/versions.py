"""Versioned tables on plain Parquet with one commit point.

A run writes what it changes to a folder of its own, ``runs/<run>/<table>``. Nothing of that is
seen before one row is appended to ``manifest``: it says, for every part of every table, in which
run the part's rows lie. Readers take the greatest version and look nowhere else, so a run that
stops between any two writes leaves the tables as they were, and all tables move together.

A table is cut into parts (``part_of``); a run rewrites the parts it touches and leaves the
others where they are. One writer at a time is assumed: a commit that finds a newer version than
the one it started from is refused.
"""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 64
MANIFEST = "version bigint, run string, load_ts bigint, places map<string,map<string,string>>"


@dataclass
class State:
    """Where the rows of a version lie: {table: {part: run}}."""

    version: int = 0
    places: dict[str, dict[str, str]] = field(default_factory=dict)


def state(spark: SparkSession, folder: str) -> State:
    """The latest committed version; version 0 has no rows."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return State()
    last = rows.orderBy(F.col("version").desc()).first()
    return State(last["version"], last["places"]) if last else State()


def part_of(*columns: str, year: str | None = None) -> str:
    """The part of a row, as an expression: a slot by a hash of ``columns``, and the year of a
    date beside it."""
    slot = f"cast(pmod(xxhash64({', '.join(columns)}), {SLOTS}) as string)"
    return f"concat_ws('-', {slot}, cast(year({year}) as string))" if year else slot


def read(spark: SparkSession, folder: str, at: State, table: str, schema: str,
         parts: list[str] | None = None) -> DataFrame:
    """Rows of a table as of a version; ``parts`` limits what is listed and read."""
    places = at.places.get(table, {})
    paths = [f"{folder}/runs/{run}/{table}/part={part}" for part, run in sorted(places.items())
             if parts is None or part in parts]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def touched(rows: DataFrame, part: str) -> list[str]:
    """The parts of rows: a slot and a year each, so few by nature."""
    return sorted(r["part"] for r in rows.select(F.expr(part).alias("part")).distinct().collect())


def write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("part").parquet(path)


def rewrite(spark: SparkSession, folder: str, at: State, run: str, table: str, schema: str,
            part: str, parts: list[str], merge: Callable[[DataFrame], DataFrame]
            ) -> dict[str, str]:
    """Write the touched parts of a table anew, ``merge`` making the new rows of the old ones.
    Returns where the parts of the table lie then."""
    path = f"{folder}/runs/{run}/{table}"
    write(merge(read(spark, folder, at, table, schema, parts)).withColumn(
        "part", F.expr(part)), path)
    filled = touched(spark.read.schema("part string").parquet(path), "part")
    kept = {name: where for name, where in at.places.get(table, {}).items() if name not in parts}
    return {**kept, **{name: run for name in filled}}


def commit(spark: SparkSession, folder: str, at: State, run: str, load_ts: int,
           places: dict[str, dict[str, str]]) -> State:
    """Make a run's tables the current ones, by one row."""
    if state(spark, folder).version != at.version:
        raise RuntimeError("another run committed meanwhile")
    row = [(at.version + 1, run, load_ts, {**at.places, **places})]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(
        f"{folder}/manifest")
    return State(at.version + 1, {**at.places, **places})
