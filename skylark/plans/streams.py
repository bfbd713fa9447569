"""Streams over the given tables, run to the end of what has arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.adapters import place
from skylark.operators import rules
from skylark.plans.registry import query
from skylark.plans.flags import story_words
from skylark.plans.ledger import outbreaks_sql
from skylark.streaming import events as streams
from skylark.streaming.merge import OneRow, Store, Sums, grouped, merging
from skylark.streaming.state import settled


@query("SELECT event_id, event_type FROM events")
def r02_stream_keep_first(spark, sf):
    """Every event comes twice, the second time an hour later; one of each stays, and keys are let go after a day."""
    e = streams.arriving(spark, sf, "events").select("event_id", "event_type", F.explode(F.array(F.col("ts").cast("timestamp"), F.col("ts").cast("timestamp") + F.expr("interval 1 hour"))).alias("ts"))
    kept = streams.keep_first(e, "event_id", "ts")
    return streams.drained(kept, streams.shared_folder(spark, "keep-first")).select("event_id", "event_type")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING epoch_us(CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP)) <= (SELECT max(epoch_us(ts)) - 86400000000 FROM events)")
def r03_stream_daily_counts(spark, sf):
    """Counts of the days that are final: a day or more before the latest event."""
    e = streams.arriving(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return streams.drained(streams.daily_counts(e, "ts", "event_type"), streams.shared_folder(spark, "daily-counts"))


def event_stream(spark, sf, files=None):
    """Events as they arrive, with what the rules below read of them."""
    e = streams.arriving(spark, sf, "events", files).where("user_id is not null")
    return e.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), place(7919, 1300, -35.0).alias("lat"), place(104729, 1700, 16.0).alias("lng"))


def outbreaks(rows):
    """(key, ts, id, tier): reports on the same outbreak, here of an actor, with the authority of who reports."""
    return rows.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), (F.col("event_id") % 3 + 1).cast("int").alias("tier"))


#: What a stream settles: all that is an hour or more older than the latest.
FINAL = "epoch_ms(ts) <= (SELECT max(epoch_ms(ts)) FROM events WHERE user_id IS NOT NULL) - 3600000"


@query(outbreaks_sql(f"SELECT user_id::VARCHAR AS key, epoch_us(ts) AS t, event_id AS signal_id, event_id % 3 + 1 AS tier FROM events WHERE user_id IS NOT NULL AND {FINAL}"))
def r05_stream_outbreaks(spark, sf):
    """Reports opened, chained or blocked as they arrive; what stands is let go after 72 hours."""
    found = settled(outbreaks(event_stream(spark, sf)), rules.Outbreak(), "t bigint, id bigint, tier int")
    return streams.drained(found, streams.shared_folder(spark, "outbreaks")).select(F.col("id").alias("signal_id"), "outcome", "parent", "surge")




@query(f"""WITH d AS (
  SELECT user_id AS actor_id, ts, event_id, CASE WHEN value >= 100 THEN 0.25 WHEN value >= 50 THEN 0.12 ELSE -0.05 END AS step
  FROM events WHERE user_id IS NOT NULL AND {FINAL})
SELECT actor_id, count(*) AS steps,
  round(list_reduce(list_prepend(CAST(1.0 AS DOUBLE), list(CAST(step AS DOUBLE) ORDER BY ts, event_id)), lambda x, y: greatest(0.2, least(5.0, x + y))), 6) AS weight
FROM d GROUP BY 1""")
def r06_stream_weights(spark, sf):
    """Actors' weights after each event, as the events arrive; the last of each actor."""
    step = F.when(F.col("value") >= 100, 0.25).when(F.col("value") >= 50, 0.12).otherwise(-0.05)
    rows = event_stream(spark, sf).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), step.alias("step"))
    found = streams.drained(settled(rows, rules.Weights(), "t bigint, id bigint, step double"), streams.shared_folder(spark, "weights"))
    return found.groupBy(F.col("key").alias("actor_id")).agg(F.count(F.lit(1)).alias("steps"), F.round(F.max_by("weight", F.struct("t", "id")), 6).alias("weight"))


def cell_alerts(rows):
    """(key, ts, id, n, confidence): an alert for each event, by its type and cell of a degree."""
    cell = lambda c: F.floor(c).cast("string")
    confidence = F.round(F.least(F.lit(1.0), 0.3 + F.coalesce("value", F.lit(0.0)) / 400), 3)
    return rows.select(F.concat_ws(":", "event_type", cell(F.col("lat")), cell(F.col("lng"))).alias("key"), "ts", F.col("event_id").alias("id"), F.lit(1).cast("long").alias("n"), confidence.alias("confidence"))


@query()
def r08_stream_alerts(spark, sf):
    """Alerts merged as they arrive: within six hours of one of their kind and cell that stands."""
    found = settled(cell_alerts(event_stream(spark, sf)), rules.CellAlerts(), "t bigint, id bigint, n bigint, confidence double")
    return streams.drained(found, streams.shared_folder(spark, "alerts")).select(F.col("id").alias("signal_id"), "alert_id", "signals", F.round("confidence", 3).alias("confidence"))


def titles(documents):
    """(key, ts, id, words): a document's first line as a title, by source; documents arrive in order of their ids, a minute apart."""
    line = F.substring(F.split("text", "\n", 2)[0], 1, 80)
    return documents.where("text is not null").select(F.coalesce("source", F.lit("")).alias("key"), F.timestamp_seconds(1_700_000_000 + F.col("doc_id") * 60).alias("ts"), F.col("doc_id").alias("id"), F.array_distinct(story_words(line)).alias("words"))


@query()
def r04_stream_titles(spark, sf):
    """Titles blocked, tagged or new as they arrive, each source by itself; a title is remembered for a day."""
    found = settled(titles(streams.arriving(spark, sf, "documents")), rules.Titles(), "t bigint, id bigint, words array<string>")
    return streams.drained(found, streams.shared_folder(spark, "titles")).select(F.col("id").alias("signal_id"), "outcome")


#: Files that a table's rows arrive in, one a batch.
ARRIVALS = 4


def in_parts(spark, sf, name: str, *order: str):
    """A stream of a table's rows, which arrive in several files, one a batch."""
    folder = streams.shared_folder(spark, "arrivals")
    spark.read.parquet(f"{sf}/{name}.parquet").repartitionByRange(ARRIVALS, *order).write.parquet(f"{folder}/{name}.parquet")
    return streams.arriving(spark, folder, name, files=1), streams.shared_folder(spark, "merged")


def merged_counts(stream, folder: str):
    """Counts by day and type of event, merged batch by batch."""
    store = Store(stream.sparkSession, folder, "day date, event_type string, n bigint", Sums(("day", "event_type"), ("n",)))
    each = grouped(F.to_date("ts").alias("day"), F.col("event_type"), n=F.lit(1).cast("long"))
    return merging(stream, store, f"{folder}/place", each)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def r03_merged_counts(spark, sf):
    """Daily counts kept up to date as files arrive, with late rows added to their day; here in the order of users, so that every batch has rows of every day."""
    stream, folder = in_parts(spark, sf, "events", "user_id", "event_id")
    store = merged_counts(stream, folder)
    store.compact()
    return store.table()


@query("""SELECT user_id, event_id, event_type, epoch_us(ts) AS t FROM events WHERE user_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def k01_merged_upserts(spark, sf):
    """The latest event of each user, replaced as later ones arrive, in whatever order the files come."""
    stream, folder = in_parts(spark, sf, "events", "event_type", "event_id")
    shape = "user_id bigint, event_id bigint, event_type string, t bigint"
    store = Store(spark, folder, shape, OneRow(("user_id",), ("t", "event_id")))
    rows = lambda df: df.where("user_id is not null").select(F.col("user_id").cast("long").alias("user_id"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return merging(stream, store, f"{folder}/place", rows).table()


@query("SELECT CASE WHEN value >= 100 THEN 1 ELSE 0 END AS is_priority, event_id AS signal_id FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0")
def r01_processed_once(spark, sf):
    """Unprocessed signals as they arrive, each marked once: what a batch takes is what no batch has taken; a progress table tells how far the run is."""
    stream, folder = in_parts(spark, sf, "events", "ts", "event_id")
    store = Store(spark, folder, "signal_id bigint, is_priority int", OneRow(("signal_id",), ("is_priority",), last=False))
    raw = lambda df: df.where("event_id % 7 <> 0 and event_id % 5 <> 0").select(F.col("event_id").alias("signal_id"), F.when(F.col("value") >= 100, 1).otherwise(0).alias("is_priority"))
    return merging(stream, store, f"{folder}/place", raw).table()
