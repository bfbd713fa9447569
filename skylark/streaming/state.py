"""Streams that decide row by row with keyed state: rows wait until the watermark has passed them, are then given to a rule in order of time, and what the rule remembers is let go when it is too old to matter."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that such streams need, while a stream runs; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class InOrder(StatefulProcessor):
    """One key's rows under a rule. `waiting` holds rows that the watermark hasn't passed, `memory` what the rule remembers. Timers: for the earliest row that waits, and for the end of the memory."""

    def __init__(self, rule, row: str):
        self.rule = rule
        self.row, self.kept = StructType.fromDDL(row), StructType.fromDDL(rule.memory)  # only the driver reads DDL
        self.fields, self.said = self.row.names, StructType.fromDDL(rule.out).names

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.memory = handle.getListState("memory", self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  names of the interface
        came = [tuple(r[f] for f in self.fields) for r in rows]
        self.waiting.appendList(came)
        self.handle.registerTimer(min(r[0] for r in came) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        due, later = [r for r in rows if r[0] // 1000 <= now], [r for r in rows if r[0] // 1000 > now]
        memory, out = [tuple(m) for m in self.memory.get()], []
        for r in due:
            memory, said = self.rule.step(memory, dict(zip(self.fields, r, strict=True)))
            out.append(Row(key=key[0], t=r[0], id=r[1], **dict(zip(self.said, said, strict=True))))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] // 1000)
        else:
            self.waiting.clear()
        if memory and self.rule.keeps is not None:
            kept = int(self.rule.keeps * 3_600_000) + 1
            memory = [m for m in memory if m[0] // 1000 + kept > now]
            if memory:
                self.handle.registerTimer(max(m[0] for m in memory) // 1000 + kept)
        if memory:
            self.memory.put(memory)
        else:
            self.memory.clear()
        return iter(out)

    def close(self) -> None:
        pass


def settled(stream: DataFrame, rule, row: str, late: str = "1 hour") -> DataFrame:
    """(key, t, id, what the rule says): a stream (key, ts, id, ...) under a rule (`operators.rules`), each key by itself. row: DDL of t (microseconds), id and what the rule reads.

    A row is settled once the latest time is `late` or more past it, so files may come in any order within that. State is kept by key, in the checkpoint: a run that is lost resumes there.
    """
    rows = stream.withColumn("t", F.unix_micros("ts")).withWatermark("ts", late)
    kind = stream.schema["key"].dataType.simpleString()
    held = rows.select("key", "ts", *StructType.fromDDL(row).names)
    id_kind = StructType.fromDDL(row)["id"].dataType.simpleString()
    return held.groupBy("key").transformWithState(InOrder(rule, row), f"key {kind}, t bigint, id {id_kind}, {rule.out}", "Append", "EventTime")
