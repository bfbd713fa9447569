"""Flags, alerts and escalation against plain sequential versions."""

import hashlib
import re
from collections import defaultdict

import pytest

from skylark import queries as own
from skylark.adapters import reports, signals
from skylark.operators import joins
from skylark.plans import flags
from skylark.plans.engines import gravity
from skylark.plans.texts import COMMON

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.findall(r"[^\W]{3,}", text.lower()) if w not in COMMON]


def told(spark):
    return sorted(reports(spark, SF).collect(), key=lambda r: (r.ts, r.signal_id))


def plain_print(tokens):
    votes = [0] * 64
    for w in tokens:
        h = int.from_bytes(hashlib.md5(w.encode()).digest()[8:], "big")
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] > 0)


def test_bots(spark):
    prints = {r.signal_id: plain_print(w) for r in told(spark) if len(w := words(r.title + " " + r.text)) >= 4}
    for least in (1, 5):
        want = {}
        for i, a in prints.items():
            n = sum((a ^ b).bit_count() <= 3 for b in prints.values()) - 1
            if n >= least:
                want[i] = (n, pytest.approx(min(0.55 + 0.05 * (n - least), 0.95), abs=1e-3))
        got = {r.signal_id: (r.alike, r.confidence) for r in flags.bot_flags(spark, SF, least=least).collect()}
        assert got == want and (want or least > 1)


def plain_campaigns(rows, hours=6.0, share=0.75, min_sources=3):
    flagged, out = set(), {}
    titles = [set(words(r.title)) for r in rows]
    for i, r in enumerate(rows):
        if i in flagged or len(titles[i]) < 4:
            continue
        members = [i]
        for j in range(i + 1, len(rows)):
            if (rows[j].ts - r.ts).total_seconds() > hours * 3600:
                break
            if len(titles[j]) >= 4 and len(titles[i] & titles[j]) / min(len(titles[i]), len(titles[j])) >= share:
                members.append(j)
        sources = {rows[k].source for k in members}
        if len(sources) >= min_sources:
            flagged |= set(members)
            for k in members:
                out[rows[k].signal_id] = (r.signal_id, len(sources), len(members))
    return out


@pytest.mark.parametrize(("hours", "share", "min_sources"), [(6.0, 0.75, 3), (24.0, 0.4, 2)])
def test_campaigns(spark, hours, share, min_sources):
    want = plain_campaigns(told(spark), hours, share, min_sources)
    got = {r.signal_id: (r.campaign, r.sources, r.members) for r in flags.campaign_flags(spark, SF, hours, share, min_sources=min_sources).collect()}
    assert got == want and want


def test_copies_of_a_title_make_no_pairs(spark, monkeypatch):
    """Three thousand reports of one title within an hour: over four million pairs, which were once written. What finds them sees sets of words, one each."""
    n = 3000
    frame = spark.range(n).selectExpr("id signal_id", "timestamp_seconds(id) ts", "concat('s', id % 4) source", "'gold price rises sharply' title")
    monkeypatch.setattr(flags, "reports", lambda *_: frame)
    alike = []
    monkeypatch.setattr(flags.engines, "alike_sets", lambda sets, *a, find=flags.engines.alike_sets: alike.append(find(sets, *a)) or alike[0])
    got = flags.campaign_flags(spark, SF).collect()
    assert alike[0].count() == 0 and {(r.campaign, r.sources, r.members) for r in got} == {(0, 4, n)} and len(got) == n


def test_alerts_are_merged_in_order(spark):
    rows = [(1, "a", 0, 10.0, 10.0), (2, "a", 1, 10.9, 10.0), (3, "a", 2, 11.5, 10.0), (4, "b", 2, 10.0, 10.0), (5, "a", 6, 10.1, 10.1), (6, "a", 7, 10.0, 10.0), (7, "a", 7, None, None), (8, "a", 7, None, None), (9, "a", 0, 10.0, 10.0)]
    frame = spark.createDataFrame([(i, k, h * 3600, la, ln, 1, 0.9 if i == 5 else 0.5) for i, k, h, la, ln in rows], "id long, kind string, s long, lat double, lng double, n long, confidence double")
    got = {r.alert_id: (r.alerts, r.confidence) for r in flags.merged_alerts(frame.selectExpr("*", "timestamp_seconds(s) ts")).collect()}
    heads = {}
    for i, kind, h, la, ln in sorted(rows, key=lambda r: (r[2], r[0])):
        near = [k for k, v in sorted(heads.items(), key=lambda x: (x[1][1], x[0])) if la is not None and v[2] is not None and v[0] == kind and h - v[1] <= 6 and abs(la - v[2]) < 1 and abs(ln - v[3]) < 1]
        c = 0.9 if i == 5 else 0.5
        if near:
            heads[near[0]][4:] = [heads[near[0]][4] + 1, min(c + 0.15, 1.0)]
        else:
            heads[i] = [kind, h, la, ln, 1, c]
    assert got == {k: (v[4], pytest.approx(v[5])) for k, v in heads.items()}


def test_merged_alerts_of_one_place_make_no_pairs(spark):
    """A hundred thousand alerts in one place within a day: five billion pairs, which were once written."""
    n = 100_000
    frame = spark.range(n).selectExpr("id", "'x' kind", "timestamp_millis(id * 864) ts", "5.0 lat", "7.0 lng", "1L n", "0.5D confidence").selectExpr("id", "kind", "ts", "double(lat) lat", "double(lng) lng", "n", "confidence")
    got = {r.alert_id: r.alerts for r in flags.merged_alerts(frame).collect()}
    # One stands, and the next is the first of more than six hours later.
    assert got == {0: 25_001, 25_001: 25_001, 50_002: 25_001, 75_003: 24_997}


def test_merged_alerts_of_signals_lose_none(spark):
    got = own.queries()["g20_merged_alerts"](spark, SF)
    assert got.agg({"signals": "sum"}).first()[0] == signals(spark, SF).where("status = 'promoted'").count()


def test_admission_by_rate(spark):
    times = [0, 1, 2, 3, 4, 5, 3599, 3600, 3601, 3602, 7000, 7201, 7202, 20000, 20001] + list(range(30000, 45000, 100))
    frame = spark.createDataFrame(list(enumerate(times)), "id long, s long").selectExpr("id", "timestamp_seconds(s) ts")
    last, want = [], {}
    for k, t in enumerate(times):
        want[k] = sum(t - x <= 3600 for x in last) < 5
        if want[k]:
            last.append(t)
    assert {r.id: r.admitted for r in flags.admitted(frame).collect()} == want


def test_escalations(spark):
    rows = signals(spark, SF).where("value is not null").select("signal_id", "ts", gravity().alias("g")).collect()
    last, want = [], {}
    for r in sorted(rows, key=lambda r: (r.ts, r.signal_id)):
        if r.g >= 0.55:
            if sum((r.ts - x).total_seconds() <= 3600 for x in last) < 5:
                last.append(r.ts)
                want[r.signal_id] = "case"
        elif r.g >= 0.35:
            want[r.signal_id] = "event"
    assert {r.signal_id: r.outcome for r in own.queries()["g07_escalations"](spark, SF).collect()} == want


def test_top_share_cut(spark):
    for values in ([5.0, 1.0, 3.0, 3.0, 3.0, 2.0, None], [1.0], [None], [float(k % 7) for k in range(100)]):
        frame = spark.createDataFrame([(v,) for v in values], "v double")
        for share in (0.1, 0.75, 1.0):
            order = sorted((v is not None, v or 0.0) for v in values)[::-1]
            there, v = order[max(0, int(len(values) * share) - 1)]
            assert joins.top_share_cut(frame, "v", share) == (v if there else None)


def test_flags_of_clusters_count(spark):
    got = {r.flag: r for r in own.queries()["g32_flag_summary"](spark, "/root/testdata/sf0.01").collect()}
    assert got["information_campaign"].flags >= got["information_campaign"].clusters >= 1
    assert defaultdict(int, {k: v.flags for k, v in got.items()})["bot_pattern"] == own.queries()["g30_bot_patterns"](spark, "/root/testdata/sf0.01").count()
