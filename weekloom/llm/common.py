"""Helpers that the operators share: tables, staged results, ranks without hot groups."""

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weekloom.session import checkpoint_root

WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


SPREAD = 64
SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Folders staged inside are removed at the end, but for those staged with ``keep``, which
    are the surrounding scope's. Frames built on the others must be written by then."""
    SCOPES.append([])
    try:
        yield
    finally:
        for path in SCOPES.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that later steps start there."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    if len(SCOPES) > keep:
        SCOPES[-1 - keep].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def schema_after(df: DataFrame, kept: list[str], more: str) -> StructType:
    """Columns passed through as they are, then new ones."""
    return StructType([StructField(c, df.schema[c].dataType) for c in kept]
                      + StructType.fromDDL(more).fields)


#: of rows that pass between Spark and Python at once; both sides hold several batches for a task
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def through_python(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` in batches of about ``BATCH_BYTES``; Spark's own limit lets whole input
    splits through as one. The session keeps that limit, or a smaller one that it had."""
    spark = df.sparkSession
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get(BATCH_SETTING))
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id's text leaves no remainder by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_key(text: Column) -> Column:
    """A 192-bit identity of a text, two hashes and its length, in one struct."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(7)).alias("b"),
                    F.octet_length(text).alias("n"))


def spread_sample(rows: DataFrame, group: str, n: int) -> DataFrame:
    """At most ``n`` rows (``group``, doc_id, h, nth) of each group: distinct ones in the order of
    their hashes, of each id the first before the second of any. ``h`` is a hash of the text.

    A group is first dealt over ``SPREAD`` parts by the id, so that no task ranks all of it."""
    order = ["turn", F.xxhash64("doc_id"), "doc_id", "h"]
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    of_id = W.partitionBy(group, "part", "doc_id").orderBy("h")
    dealt = rows.select(group, "doc_id", "h").withColumn(
        "part", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))).distinct()
    return (dealt.repartition(group, "part")
            .withColumn("turn", F.row_number().over(of_id)).where(F.col("turn") <= n)
            .withColumn("nth", rank(group, "part")).where(F.col("nth") <= n)
            .withColumn("nth", rank(group)).where(F.col("nth") <= n).drop("turn", "part"))


def ranked(df: DataFrame, group: str, ids: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 0 without ever sorting a whole group in one task.

    A group of n rows is dealt over about sqrt(n) buckets by a hash of ``ids``; rows are numbered
    inside a bucket, and the bucket starts come from a running sum over sqrt(n) counts.
    ``df`` is read three times, so it should be a staged frame. The groups must be few by nature
    (lengths up to a capacity, shards), as their counts are broadcast. Rows equal in all ``ids``
    take neighbouring numbers in any order.
    """
    n = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    wide = n.select("_g", F.ceil(F.sqrt("_n")).cast("long").alias("_w"))
    dealt = df.join(F.broadcast(wide), F.col(group).eqNullSafe(F.col("_g"))).withColumn(
        "_b", F.pmod(F.xxhash64(*ids), F.col("_w")))
    counts = dealt.groupBy("_g", "_b").agg(F.count("*").alias("_c"))
    starts = counts.select("_g", "_b", (F.sum("_c").over(
        W.partitionBy("_g").orderBy("_b")) - F.col("_c")).alias("_s"))
    inner = F.row_number().over(W.partitionBy("_g", "_b").orderBy(*ids)) - 1
    numbered = dealt.withColumn("_i", inner)
    found = numbered.join(starts.withColumnsRenamed({"_g": "_g2", "_b": "_b2"}),
                          F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_b") == F.col("_b2")))
    return found.withColumn(out, F.col("_s") + F.col("_i")).drop(
        "_g", "_w", "_b", "_i", "_g2", "_b2", "_s")
