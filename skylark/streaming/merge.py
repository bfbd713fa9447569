"""Incremental merging: what each batch of a stream adds is stored once under its number, and a table is the fold of all that is stored.

A store is a folder with `parts` (what each batch brought, pre-aggregated, in a folder per batch: a batch that runs again replaces its own), `done` (a row for each batch that is complete, with its rows and
times, which is the progress table) and `bases` (folds of all batches up to one). A batch never rewrites what others stored, so its cost follows what came; `compact` folds what has gathered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NONE = -1


@dataclass(frozen=True)
class Sums:
    """Additive upsert: counts or sums by keys. late rows are added to the group they belong to."""

    keys: tuple[str, ...]
    values: tuple[str, ...]

    def fold(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[F.sum(v).alias(v) for v in self.values])


@dataclass(frozen=True)
class OneRow:
    """One row of each key: the last by an order without ties (replace), or the first (insert or ignore)."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    last: bool = True

    def fold(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        pick = F.max_by if self.last else F.min_by
        best = rows.groupBy(*self.keys).agg(pick(F.struct(*rest), F.struct(*self.order)).alias("_row"))
        return best.select(*self.keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*rows.columns)


@dataclass(frozen=True)
class Store:
    """A table that batches are merged into. shape: DDL of its rows; rule: how rows of equal keys become one."""

    spark: SparkSession
    folder: str
    shape: str
    rule: Sums | OneRow

    def _read(self, part: str, shape: str) -> DataFrame:
        return self.spark.read.schema(shape).option("ignoreMissingFiles", "true").parquet(f"{self.folder}/{part}")

    def _exists(self, part: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _kept(self, part: str, column: str) -> DataFrame:
        if not self._exists(part):
            return self.spark.createDataFrame([], f"{self.shape}, {column} bigint")
        return self._read(part, f"{self.shape}, {column} bigint")

    def merge(self, rows: DataFrame, batch: int, time: str | None = None) -> None:
        """Takes a batch in. The same number again replaces what it brought before; what was folded into a base already is left alone."""
        if batch <= self.base():
            return
        self.rule.fold(rows).write.mode("overwrite").parquet(f"{self.folder}/parts/batch={batch}")
        first, last = (F.min(time), F.max(time)) if time else (F.lit(None), F.lit(None))
        report = rows.agg(F.count(F.lit(1)).alias("rows"), first.cast("timestamp").alias("first"), last.cast("timestamp").alias("last"))
        report.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/done/batch={batch}")

    def progress(self) -> DataFrame:
        """(rows, first, last, batch): every batch that is complete."""
        shape = "rows bigint, first timestamp, last timestamp, batch bigint"
        return self._read("done", shape) if self._exists("done") else self.spark.createDataFrame([], shape)

    def base(self) -> int:
        """The last batch that the newest base holds."""
        if not self._exists("bases"):
            return NONE
        return self._read("bases_done", "upto bigint").agg(F.max("upto")).first()[0] if self._exists("bases_done") else NONE

    def table(self) -> DataFrame:
        """The merged rows: the newest base and the complete batches after it."""
        base = self.base()
        complete = self.progress().select("batch")
        later = self._kept("parts", "batch").where(F.col("batch") > base).join(complete, "batch", "left_semi").drop("batch")
        held = later if base == NONE else later.unionByName(self._kept("bases", "upto").where(F.col("upto") == base).drop("upto"))
        return self.rule.fold(held)

    def compact(self) -> None:
        """Folds all complete batches into a new base, which counts once it is written whole. Batches are complete in the order of their numbers."""
        upto = self.progress().agg(F.max("batch")).first()[0]
        if upto is None or upto <= self.base():
            return
        self.table().write.mode("overwrite").parquet(f"{self.folder}/bases/upto={upto}")
        self.spark.createDataFrame([(upto,)], "upto bigint").coalesce(1).write.mode("append").parquet(f"{self.folder}/bases_done")


def merging(stream: DataFrame, store: Store, place: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, time: str | None = None) -> Store:
    """Runs the stream to the end of what has arrived, each batch merged into the store; the place remembers what was taken. A lost run takes its batch again, under the same number."""

    def take(rows: DataFrame, batch: int) -> None:
        store.merge(prepare(rows), batch, time)

    stream.writeStream.foreachBatch(take).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    return store


def grouped(*keys: Column, **values: Column) -> Callable[[DataFrame], DataFrame]:
    """What each row adds: its keys, and columns to be added up."""
    return lambda df: df.select(*keys, *[v.alias(k) for k, v in values.items()])
