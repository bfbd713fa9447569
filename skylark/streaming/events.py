"""Incremental runs over files that arrive: each call takes what is new since the last, with its place kept in a folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylark.session import checkpoint_folder
from skylark.streaming.state import keyed_state


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def arriving(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """A stream of a table's files, a file or a folder of them: a pattern, as a plain path would have to be a folder. files: how many make a batch at most."""
    reader = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{sf_dir}/{name}.parque[t]")


def drained(stream: DataFrame, place: str, progress: list | None = None) -> DataFrame:
    """All that has arrived so far, run in the append mode to the end and read back; a lost run resumes from its place. progress: takes the batches' reports."""
    out, schema = f"{place}/rows", stream.schema
    with keyed_state(stream.sparkSession):
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{place}/place").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    if progress is not None:
        progress += run.recentProgress
    return stream.sparkSession.read.schema(schema).parquet(out)


def keep_first(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key that comes within the time; state of older keys is let go."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, time: str, *keys: str, late: str = "1 day") -> DataFrame:
    """Counts by day and keys in the update mode's shape (day, keys, n); a day is final once it is older than the latest time less `late`."""
    day = F.window(time, "1 day")
    return stream.withWatermark(time, late).groupBy(day, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), *keys, "n")
