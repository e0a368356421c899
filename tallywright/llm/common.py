"""Helpers of the operators: the shared folder, written intermediate tables, projections without name clashes."""
from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, below ``spark.checkpoint.dir``.

    Only a local session, where both are one process, may do without that setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tallywright-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: computed once, safe when executors are lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Just these columns under these names, whatever other columns there are."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 1 in the order of all of them.

    The rows are sorted over all partitions and written with their place inside their partition; the rows before each partition, one number
    for a partition, are added afterwards. No task holds more than its own range.
    """
    place = F.monotonically_increasing_id()
    rows = saved(df.orderBy(*order).withColumn("_place", place), "ordered")
    part = F.shiftright("_place", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    out = rows.withColumn("_part", part).join(before, "_part")
    return out.withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_before", "_place")


FILTER_BITS = 1 << 27


class HashFilter:
    """A Bloom filter of one function over 64-bit hashes, 16 MB whatever the number of rows.

    It saves shuffling rows that a join would drop anyway. Where it is full it lets all pass, and the join decides as before.
    """

    def __init__(self, rows: DataFrame, column: str):
        bit = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1))
        word, place = F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int")
        # One row for each word of the filter at most.
        got = rows.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("b")).groupBy("word").agg(F.bit_or("b").alias("b")).toArrow()
        words = np.zeros(FILTER_BITS >> 6, np.uint64)
        words[got["word"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
        self.words = rows.sparkSession.sparkContext.broadcast(words)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes.view(np.uint64) & np.uint64(FILTER_BITS - 1)
        return (self.words.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
