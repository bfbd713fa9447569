"""Signal-shaped views of the given tables, and the same views as SQL for the oracle.

No table has coordinates; these come from integer arithmetic on ids that both engines do alike. Two thirds of the signals lie about a place of their actor, the others anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(factor: int, width: int, start: float) -> Column:
    """A coordinate in hundredths of a degree."""
    about = (F.col("user_id") * factor + F.col("event_id") * 31 % 40) % width
    return F.lit(start) + F.when(F.col("event_id") % 3 == 0, F.col("event_id") * factor % width).otherwise(about) / F.lit(100.0)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stream = F.when(F.col("event_type") == "error", "CRIME_INTEL").when(F.col("event_type") == "purchase", "PRIORITY").when(F.col("event_type") == "signup", "INFRASTRUCTURE").otherwise("GLOBAL")
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.when(F.col("event_id") % 7 == 0, "dismissed").when(F.col("event_id") % 5 == 0, "promoted").otherwise("raw")
    return e.select(
        F.col("event_id").alias("signal_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("source"),
        F.col("user_id").alias("actor_id"),
        F.col("value"),
        k.alias("k"),
        F.when(F.col("value") >= 100, 1).otherwise(0).alias("is_priority"),
        stream.alias("stream"),
        status.alias("status"),
        F.when(F.col("event_id") % 10 == 0, "seed").otherwise("live").alias("source_type"),
        place(7919, 1300, -35.0).alias("lat"),
        place(104729, 1700, 16.0).alias("lng"),
    )


SIGNALS = """signals AS (SELECT event_id AS signal_id, ts, event_type AS source, user_id AS actor_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
CASE WHEN value >= 100 THEN 1 ELSE 0 END AS is_priority,
CASE event_type WHEN 'error' THEN 'CRIME_INTEL' WHEN 'purchase' THEN 'PRIORITY' WHEN 'signup' THEN 'INFRASTRUCTURE' ELSE 'GLOBAL' END AS stream,
CASE WHEN event_id % 7 = 0 THEN 'dismissed' WHEN event_id % 5 = 0 THEN 'promoted' ELSE 'raw' END AS status,
CASE WHEN event_id % 10 = 0 THEN 'seed' ELSE 'live' END AS source_type,
CAST(-35 AS DOUBLE) + CAST(CASE WHEN event_id % 3 = 0 THEN event_id * 7919 % 1300 ELSE (user_id * 7919 + event_id * 31 % 40) % 1300 END AS DOUBLE) / CAST(100 AS DOUBLE) AS lat,
CAST(16 AS DOUBLE) + CAST(CASE WHEN event_id % 3 = 0 THEN event_id * 104729 % 1700 ELSE (user_id * 104729 + event_id * 31 % 40) % 1700 END AS DOUBLE) / CAST(100 AS DOUBLE) AS lng FROM events)"""


#: Lines of orders in a task that joins them.
LINES_EACH = 200_000


def actor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(actor_id, event_id): suppliers of orders, as often as they come."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("actor_id"), F.col("l_orderkey").alias("event_id"))


def actor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(actor_id, event_id): suppliers of orders."""
    return actor_links(spark, sf_dir).distinct()


ACTOR_EVENTS = "actor_events AS (SELECT DISTINCT l_suppkey AS actor_id, l_orderkey AS event_id FROM lineitem)"


def part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(actor_id, event_id): parts of orders, as often as they come. Both tables are dealt to so many tasks as keep each of a fixed size."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), li.count() // LINES_EACH + 1)
    li, o = li.select("l_partkey", "l_orderkey").repartition(tasks, "l_orderkey"), o.select("o_orderkey").repartition(tasks, "o_orderkey")
    return li.join(o, li.l_orderkey == o.o_orderkey, "left_semi").select(F.col("l_partkey").alias("actor_id"), F.col("l_orderkey").alias("event_id"))


def part_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(actor_id, event_id, day): parts of orders, a sparser graph, with the order's day."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("l_partkey").alias("actor_id"), F.col("l_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("day")).distinct()


PART_ORDERS = "part_orders AS (SELECT DISTINCT l_partkey AS actor_id, l_orderkey AS event_id, CAST(o_orderdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


#: Characters of a report's title and of its summary, which are fields of bounded length.
TITLE, SUMMARY = 80, 200


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with text: a document, with time, place, actor and status of the event of its number."""
    s = signals(spark, sf_dir).select("signal_id", "ts", "actor_id", "stream", "status", "is_priority", "value", "lat", "lng")
    line = F.split("text", "\n", 2)[0]
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("signal_id"), "source", "text", F.substring(line, 1, TITLE).alias("title"), F.substring("text", 1, SUMMARY).alias("summary"))
    return d.join(s, "signal_id")


REPORTS = f"""{SIGNALS}, reports AS (SELECT s.signal_id, d.source, d.text, substr(split_part(d.text, chr(10), 1), 1, {TITLE}) AS title, substr(d.text, 1, {SUMMARY}) AS summary, s.ts, s.actor_id, s.stream, s.status, s.is_priority, s.value, s.lat, s.lng
FROM documents d JOIN signals s ON s.signal_id = d.doc_id WHERE d.text IS NOT NULL)"""
