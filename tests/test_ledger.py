"""Stateful rules in batch form, and the register of scorers, against plain versions."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from skylark import queries as own
from skylark.adapters import signals
from skylark.plans import ledger
from skylark.plugins import Registry
from test_flags import told, words
from test_state import plain_outbreaks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("block", "tag", "hours"), [(0.9, 0.7, 24), (0.5, 0.2, 100)])
def test_title_duplicates(spark, block, tag, hours):
    cache, want = [], {}
    for r in told(spark):
        mine = set(words(r.title))
        near = [len(mine & t) / len(mine | t) for ts, t in cache if r.ts - ts <= timedelta(hours=hours)] if len(mine) >= 3 else []
        best = max(near, default=0)
        want[r.signal_id] = "blocked" if best >= block else "tagged" if best >= tag else "new"
        if best < block and len(mine) >= 3:
            cache.append((r.ts, mine))
    frame = spark.createDataFrame([(r.signal_id, r.ts, sorted(set(words(r.title)))) for r in told(spark)], "id long, ts timestamp, words array<string>")
    got = {r.id: r.outcome for r in ledger.title_duplicates(frame, hours, block, tag).collect()}
    assert got == want and set(want.values()) >= {"blocked", "new"}


def test_titles_that_block_each_other_for_months_take_few_rounds(spark):
    """A title every 13 hours: each stands or is blocked by whether the one before stands, once a round of joins for each of them."""
    frame = spark.range(120).selectExpr("id", "timestamp_seconds(id * 46800) ts", "array('gold', 'price', 'rises') words")
    spark.sparkContext.setJobGroup("titles", "titles")
    got = {r.id: r.outcome for r in ledger.title_duplicates(frame, 24.0).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("titles"))
    assert got == {i: "blocked" if i % 2 else "new" for i in range(120)} and jobs < 150


def test_outbreaks_by_authority(spark):
    rows = signals(spark, SF).where("actor_id is not null").withColumn("t", F.unix_micros("ts")).collect()
    want = plain_outbreaks((f"{r.actor_id}:{r.source}", r.t, r.signal_id, r.signal_id % 3 + 1) for r in rows)
    got = {r.signal_id: (r.outcome, r.parent, r.surge) for r in own.queries()["r05_outbreak_admissions"](spark, SF).collect()}
    assert got == want


def test_failing_scorers_leave_the_others_alone(spark):
    r = Registry()
    ok = lambda g: F.struct(F.array(F.lit("e")).alias("entities"), F.lit("x").alias("intent"), F.lit(g).alias("gravity"), F.lit(0.5).alias("confidence"))
    r.register("one", "id")(lambda: ok(0.2))
    r.register("two", "id")(lambda: F.when(F.col("id") > 0, ok(0.6)))
    r.register("wrong", "id")(lambda: F.col("nowhere"))
    r.register("raises", "id")(lambda: 1 / 0)
    r.register("asks", "picture")(lambda: ok(1.0))
    got = {x.id: x.result for x in r.scored(spark.range(2)).collect()}
    assert got[0].gravity == 0.2 and got[1].gravity == pytest.approx(0.4) and got[1].entities == ["e"]
    assert set(r.failures) == {"wrong", "raises", "asks"}
    r.detach("one")
    assert {x.id: x.result and x.result.gravity for x in r.scored(spark.range(2)).collect()} == {0: None, 1: 0.6}
    assert Registry().scored(spark.range(1)).first().result is None
    with pytest.raises(ValueError, match="already"):
        r.register("two")(lambda: None)
