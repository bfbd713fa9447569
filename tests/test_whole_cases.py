"""Case suggestions from all events against a plain version, case by case."""

from collections import defaultdict

import oracle
from skylark import queries as own
from test_whole import SF, rows


def test_case_suggestions_of_all_events(spark):
    db = oracle.connect(SF)
    pinned, known, met, lines = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(list)
    for case, event in db.execute("SELECT c_nationkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey").fetchall():
        pinned[case].add(event)
    for case, actor in db.execute("SELECT s_nationkey, s_suppkey FROM supplier").fetchall():
        known[case].add(actor)
    for event, actor, line, day, flag in db.execute("SELECT l_orderkey, l_suppkey, l_linenumber, l_shipdate, l_returnflag FROM lineitem").fetchall():
        met[event].add(actor)
        lines[event].append((event * 10 + line, day, flag))
    want = set()
    for case in set(pinned) | set(known):
        hidden = [(len(met[e] & known[case]), len(lines[e]), e) for e in met if e not in pinned[case] and met[e] & known[case]]
        hidden = sorted(hidden, key=lambda x: (-x[0], -x[1], x[2]))[:20]
        leads = [("event", e, n, round(n / hidden[0][0] * 100)) for n, _, e in hidden]
        seen = defaultdict(int)
        for e in pinned[case]:
            for a in met[e] - known[case]:
                seen[a] += 1
        leads += [("actor", a, n, round(n / len(pinned[case]) * 100)) for a, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:15]]
        loose = [x for e in pinned[case] for x in lines[e] if x[2] != "R"]
        loose = sorted(sorted(loose), key=lambda x: x[1], reverse=True)[:10]
        leads += [("artifact", x[0], 1, 85) for x in loose]
        leads.sort(key=lambda x: (-x[3], -x[2]))
        want |= {(case, k + 1, *x, "HIGH" if x[3] >= 67 else "MEDIUM" if x[3] >= 34 else "LOW") for k, x in enumerate(leads[:12])}
    assert {x[2] for x in want} >= {"event", "artifact"}
    assert set(rows(spark, "g38_case_suggestions_all", SF)) == want
