"""Tables written in the folder that a cluster shares, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (at most two) numbers that may be broadcast; a larger table is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own if all runs in this process, else an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share: intermediate tables go there")
    return (set_dir or f"file://{tempfile.gettempdir()}/lumenframe-{os.getpid()}").rstrip("/") + "/stages"


class Stages:
    """Intermediate tables of one run. They cut lineage, survive lost executors and can be dropped when read for the last time."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._stage_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._stage_path)
            path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has no more than limit rows, else df for a shuffled join. rows: its count, if known."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def text_lower(text):
    """text with A-Z in lower case and nothing else changed; null is the empty text."""
    t = F.coalesce(text, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, upper, lower))
