"""Running a stream over what is available and reading its result back.

Results and offsets live below the shared folder named in ``spark.checkpoint.dir``, so a lost executor is no loss. A stream that is
to go on after a restart of the driver is given a ``resume`` name: it then finds its own offsets and results again.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.ordered import latest_by
from tallywright.session import shared_root
from tallywright.streaming.stateful import CLOSE


def work_folder(spark: SparkSession, name: str, resume: str | None = None) -> str:
    """The folder of one stream: a fresh one, or the one that belongs to ``resume``."""
    return f"{shared_root(spark)}/{name}-{resume or uuid.uuid4().hex}"


def stream_files(spark: SparkSession, folder: str, glob: str, schema=None, files_per_trigger: int | None = None) -> DataFrame:
    """A file source over a folder. ``files_per_trigger`` bounds a micro-batch and with it what one key can bring at once."""
    reader = spark.readStream.schema(schema or spark.read.option("pathGlobFilter", glob).parquet(folder).schema).option("pathGlobFilter", glob)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A file source over one table of a folder, be it a single file or a folder of part files.

    The path is a pattern that fits this one name: a source over a plain path takes folders only.
    """
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(f"{folder}/[{name[0]}]{name[1:]}")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, as processors with timers need; a running stream has its own copy of the setting."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def to_the_end(job: Callable[[DataFrame], DataFrame], spark: SparkSession, folder: str) -> DataFrame:
    """Runs ``job(close)``, an append stream with timers, over what is available, then closes it: a row of a far time passes the watermark
    over all that still waits. A closed stream takes no more rows."""
    schema, marks = "ts timestamp", f"{folder}/close"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(marks)
    df = job(spark.readStream.schema(schema).parquet(marks))
    with keyed_state(spark):
        append_to_table(df, folder)
        spark.createDataFrame([(CLOSE,)], schema).write.mode("append").parquet(marks)
        return append_to_table(df, folder)


def append_to_table(df: DataFrame, folder: str) -> DataFrame:
    """Runs an append stream into a Parquet sink, which writes every row exactly once, and returns the table."""
    spark, schema = df.sparkSession, df.schema
    df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


def each_batch(df: DataFrame, folder: str, fn: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs ``fn`` on every micro-batch."""
    df.writeStream.foreachBatch(fn).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def update_to_table(df: DataFrame, keys: Sequence[str], folder: str) -> DataFrame:
    """Runs an updating aggregate; every micro-batch writes its changed rows under its number, so that a repeated batch
    overwrites itself. The table is the newest row per key."""
    spark, schema = df.sparkSession, df.schema

    def write(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={no}")

    each_batch(df, folder, write, "update")
    table = spark.read.schema(schema.add("batch", "long")).parquet(f"{folder}/out")
    return latest_by(table, list(keys), ["batch"]).drop("batch")


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The event time as an instant, as watermarks want it."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))
