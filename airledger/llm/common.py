"""Small helpers that the operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder; one of our own is set only where the session names none and runs on one machine (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The same rows from a table in the checkpoint folder, and a function that deletes it; smaller than a checkpoint."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    return spark.read.schema(df.schema).parquet(path), drop


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of ``spark.checkpoint.dir``: executors may be lost afterwards without recomputing what stands before."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the driver drop what nothing refers to any more, so that Spark's cleaner removes its shuffle and checkpoint files now."""
    for _ in range(2):  # what the first round frees on the Python side is garbage to the driver only then
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of the table has it (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a long, b long)``.

    Returns ``(node, label)`` for every node of an edge; the label is the smallest
    node of its component. Each round takes the least label among neighbours (a
    grouped minimum, combined before the shuffle) and then jumps to the label of the
    label, so long chains halve. Rounds end when no label changes; each is cut from
    its lineage. Self-loops are kept as single nodes; no edges give no rows.
    """
    both = durable(
        edges.select("a", "b")
        .unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a is not null and b is not null")
        .distinct()
    )
    labels = durable(
        both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label"))
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("mid")
        )
        hop = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        moved = durable(
            step.join(hop, "mid").select("node", "old", F.least("mid", "far").alias("label"))
        )
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels
