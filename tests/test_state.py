"""Streams with keyed state and incremental merging: equal to plain loops and to whole runs, through restarts, repeated batches and files in any order."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from skylark import queries as own
from skylark.operators import ordered, rules
from skylark.plans import streams as plans
from skylark.streaming import events as streams
from skylark.streaming.merge import OneRow, Store, Sums
from skylark.streaming.state import settled

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000_000


def plain_outbreaks(rows, hours=72, surge=5, surge_hours=24):
    """rows: (key, t, id, tier)."""
    out, of = {}, {}
    for key, t, i, tier in sorted(rows):
        before = of.setdefault(key, [])
        stand = [(b_tier, -b_t, -b_id) for b_t, b_id, b_tier, stands in before if stands and t - b_t <= hours * HOUR]
        outcome, parent = "opens", None
        if stand:
            outcome = "chained" if tier < min(stand)[0] else "blocked"
            parent = -min(stand)[2] if outcome == "chained" else None
        out[i] = (outcome, parent, sum(t - b[0] < surge_hours * HOUR for b in before) + 1 >= surge)
        before.append((t, i, tier, outcome != "blocked"))
    return out


def events(spark, sf=SF):
    return [r for r in spark.read.parquet(f"{sf}/events.parquet").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).collect() if r.user_id is not None]


def final(rows):
    """Those that a stream settles: an hour or more before the latest, in milliseconds."""
    end = max(r.t for r in rows) // 1000 - 3_600_000
    return [r for r in rows if r.t // 1000 <= end]


def test_stream_of_outbreaks_equals_a_loop(spark):
    got = {r.signal_id: (r.outcome, r.parent, r.surge) for r in own.queries()["r05_stream_outbreaks"](spark, SF).collect()}
    want = plain_outbreaks((r.user_id, r.t, r.event_id, r.event_id % 3 + 1) for r in final(events(spark)))
    assert got == want and {o for o, *_ in got.values()} == {"opens", "chained", "blocked"}


def test_stream_of_alerts_equals_a_loop(spark):
    rows = {r.id: r for r in plans.cell_alerts(spark.read.parquet(f"{SF}/events.parquet").where("user_id is not null").withColumns({"ts": F.col("ts").cast("timestamp"), "lat": plans.place(7919, 1300, -35.0), "lng": plans.place(104729, 1700, 16.0)})).withColumn("t", F.unix_micros("ts")).collect()}
    heads, want = {}, {}
    for r in sorted(final(rows.values()), key=lambda r: (r.t, r.id)):
        standing = [h for h in heads.setdefault(r.key, []) if r.t - h[0] <= 6 * HOUR]
        if standing:
            standing[0][2] += r.n
            want[r.id] = (standing[0][1], standing[0][2], pytest.approx(min(1.0, r.confidence + 0.15)))
        else:
            heads[r.key].append([r.t, r.id, r.n])
            want[r.id] = (r.id, r.n, pytest.approx(r.confidence))
    got = {r.signal_id: (r.alert_id, r.signals, r.confidence) for r in own.queries()["r08_stream_alerts"](spark, SF).collect()}
    assert got == want


def test_stream_of_titles_equals_a_loop(spark):
    rows = plans.titles(spark.read.parquet(f"{SF}/documents.parquet")).withColumn("t", F.unix_micros("ts")).collect()
    held, want = {}, {}
    for r in sorted(final(rows), key=lambda r: (r.t, r.id)):
        words, said = set(r.words), "new"
        if len(words) >= 3:
            alike = max((len(words & w) / len(words | w) for t, w in held.get(r.key, []) if r.t - t <= 24 * HOUR), default=0)
            said = "blocked" if alike >= 0.9 else "tagged" if alike >= 0.7 else "new"
            if said != "blocked":
                held.setdefault(r.key, []).append((r.t, words))
        want[r.id] = said
    got = {r.signal_id: r.outcome for r in own.queries()["r04_stream_titles"](spark, SF).collect()}
    assert got == want and "blocked" in got.values()


def arrivals(spark, folder, rows, part):
    frame = spark.createDataFrame(rows, "key string, ts timestamp, id long, tier int")
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return part


def test_restart_files_in_any_order_and_state_that_leaves(spark, tmp_path):
    rng, start = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [("ab"[rng.random() < 0.5], start + dt.timedelta(minutes=rng.randrange(60 * 24 * 8)), k, rng.randrange(1, 4)) for k in range(300)]
    rows.sort(key=lambda r: r[1])
    parts = [rows[k : k + 60] for k in range(0, 300, 60)]
    for part in parts:
        rng.shuffle(part)
    source = lambda: spark.readStream.schema("key string, ts timestamp, id long, tier int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = lambda seen=None: streams.drained(settled(source(), rules.Outbreak(), "t bigint, id bigint, tier int"), str(tmp_path / "run"), seen)
    for part in parts[:2]:
        arrivals(spark, tmp_path, part, 0)
    first = {r.id for r in run().collect()}
    for part in parts[2:]:
        arrivals(spark, tmp_path, part, 0)
    # A key that comes once, long before the end: what is known of it is let go.
    arrivals(spark, tmp_path, [("c", start + dt.timedelta(days=9), 1_000, 1)], 0)
    arrivals(spark, tmp_path, [("d", start + dt.timedelta(days=30), 1_001, 1)], 0)
    seen = []
    got = {r.id: (r.outcome, r.parent, r.surge) for r in run(seen).collect()}
    micros = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    want = plain_outbreaks((k, micros(t), i, tier) for k, t, i, tier in [*rows, ("c", start + dt.timedelta(days=9), 1_000, 1)])
    assert got == want and first and first < set(got)
    totals = [p["stateOperators"][0]["numRowsTotal"] if isinstance(p, dict) else json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in seen]
    assert totals[-1] < max(totals)


@pytest.mark.parametrize("rule,row", [(rules.RateLimit(), {}), (rules.RateLimit(1, 0.05), {}), (rules.Outbreak(), {"tier": 1}), (rules.Weights(), {"step": 0.1})])
def test_walks_over_ranges_equal_a_loop(spark, rule, row):
    rng = random.Random(9)
    rows = [(rng.choice("aaaab"), rng.randrange(40 * HOUR // 60) * 60, k) for k in range(3_000)]
    frame = spark.createDataFrame(rows, "key string, t long, id long").withColumns({k: (F.col("id") % 3 + 1).cast("int") if k == "tier" else F.lit(v) * (F.col("id") % 5 - 2) for k, v in row.items()})
    got = {r["id"]: tuple(r)[2:] for r in ordered.walked(frame, rule).collect()}
    want, state = {}, {}
    for r in sorted(frame.collect(), key=lambda r: (r.key, r.t, r.id)):
        state[r.key], want[r["id"]] = rule.step(state.get(r.key, []), r)
    assert got == want


def test_rate_limit_without_any_pause_equals_a_plain_loop(spark):
    rng = random.Random(2)
    times = sorted(rng.randrange(90 * 60) * 1_000_000 + k for k in range(4_000))
    frame = spark.createDataFrame([("all", t, k) for k, t in enumerate(times)], "key string, t long, id long")
    admitted, want = [], {}
    for k, t in enumerate(times):
        want[k] = sum(t - a <= 600 * 1_000_000 for a in admitted) < 5
        admitted += [t] * want[k]
    assert {r.id: r.admitted for r in ordered.walked(frame, rules.RateLimit(5, 1 / 6)).collect()} == want and sum(want.values()) > 20


def test_row_numbers_over_ranges(spark):
    frame = spark.range(5_000).select(F.col("id"), F.xxhash64("id").alias("h"))
    found = ordered.numbered(frame, [F.desc("h"), "id"])
    order = sorted((r for r in frame.collect()), key=lambda r: (-r.h, r.id))
    assert {r.id: r.seq for r in found.collect()} == {r.id: k + 1 for k, r in enumerate(order)}
    assert ordered.numbered(frame.where("false"), ["h"]).count() == 0


def test_merging_in_parts_equals_the_whole_and_repeated_batches_change_nothing(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    counts = lambda rows: sorted((str(r.day), r.event_type, r.n) for r in rows.collect())
    want = counts(e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n")))
    late, early = e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0")
    folder = str(tmp_path / "store")
    early.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    plans.merged_counts(streams.arriving(spark, str(tmp_path), "events", 1), folder)
    late.repartition(2).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    store = plans.merged_counts(streams.arriving(spark, str(tmp_path), "events", 1), folder)
    assert counts(store.table()) == want
    progress = {r.batch: r.rows for r in store.progress().collect()}
    assert sorted(progress) == [0, 1, 2] and sum(progress.values()) == e.count()
    # A batch again, whole or in part of what it was: its number has what came last.
    again = late.select(F.to_date("ts").alias("day"), "event_type", F.lit(1).cast("long").alias("n"))
    two = Store(spark, str(tmp_path / "two"), store.shape, store.rule)
    for batch, rows in ((0, again), (1, again), (1, again), (0, again)):
        two.merge(rows, batch)
    once = {(d, t): n for d, t, n in counts(two.table())}
    assert {k: v for k, v in once.items()} == {(str(r.day), r.event_type): 2 * r["count"] for r in again.groupBy("day", "event_type").count().collect()}
    two.compact()
    two.merge(again, 1)  # it is in the base already
    two.merge(again, 2)
    assert sum(n for *_, n in counts(two.table())) == 3 * again.count()
    assert two.base() == 1


def test_a_batch_that_is_not_complete_does_not_count(spark, tmp_path):
    store = Store(spark, str(tmp_path), "k string, n bigint", Sums(("k",), ("n",)))
    assert store.table().count() == 0 and store.progress().count() == 0 and store.base() == -1
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 5)], "k string, n bigint")
    store.merge(rows, 0)
    rows.write.parquet(f"{tmp_path}/parts/batch=1")  # its report is missing
    assert {(r.k, r.n) for r in store.table().collect()} == {("a", 3), (None, 5)}
    first = Store(spark, str(tmp_path / "first"), "k string, t bigint, v string", OneRow(("k",), ("t",), last=False))
    first.merge(spark.createDataFrame([("a", 2, "x"), ("b", 1, "y")], first.shape), 0)
    first.merge(spark.createDataFrame([("a", 1, "z"), ("b", 2, "w")], first.shape), 1)
    assert {(r.k, r.v) for r in first.table().collect()} == {("a", "z"), ("b", "y")}
