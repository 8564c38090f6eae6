"""Session settings and lineage cuts."""

import os
import re
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "weekloom", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder. Without one, a local session takes a folder of its own and a
    cluster is refused, as its executors could not read each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"weekloom-checkpoints-{os.getpid()}")
    return folder


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write the frame to the shared folder once, so that later stages read it back.

    With ``by``, a column of few values, rows lie apart by its value, and a stage that asks for
    one of them reads no others. Stages are Parquet: compressed, and read by column and filter. They live as long as the
    folder, whose lifetime is the cluster's to set.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_all(frames: dict, at_once: int = 4) -> dict:
    """``cut`` of several frames at a time: small ones share the cluster, and plans are made side
    by side."""
    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(frames, pool.map(cut, frames.values())))
