"""Broadcasts of a checked size, and partitions of a bounded one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a broadcast table has at most: cells, sensors, maps, columns and settings of one study.
MOST = 1_000_000
#: Rows of a partition, about, that spread() aims at.
ROWS = 250_000


def few(df: DataFrame, most: int = MOST) -> DataFrame:
    """The same rows, marked for broadcast; the job fails, naming the number, where there are more than ``most``.

    One row more than allowed is taken at most, so nothing larger is ever gathered.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    too_many = F.raise_error(F.concat(F.lit(f"more than {most} rows where at most so many are broadcast: "), F.col("_few_n").cast("string")))
    return F.broadcast(df.limit(most + 1).withColumn("_few_n", n).where(F.when(F.col("_few_n") > most, too_many.cast("boolean")).otherwise(True)).drop("_few_n"))


def spread(df: DataFrame, *keys: str, rows: int = ROWS) -> DataFrame:
    """The same rows dealt by a hash of ``keys`` to as many partitions as keep each at about ``rows``.

    Groups, windows and broadcast joins by these and more keys follow without another shuffle,
    and rows that are nearly all different are not first held by their key where they are read.
    What a task holds stays the same however many rows there are; a key of many rows stays
    whole. The rows are counted for it, which for Parquet files takes their footers.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(tasks, -(-df.count() // rows)), *keys)
