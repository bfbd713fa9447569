"""Narrative clusters over all documents against a plain version, one document after the other."""

import math
import re
from collections import Counter, defaultdict

import oracle
from skylark import queries as own
from skylark.plans.texts import COMMON
from test_whole import SF, rows, stored


def clusters(docs):
    docs = sorted((k, s, [w for w in re.findall(r"\w{3,}", t.lower()) if w not in COMMON]) for k, s, t in docs if t is not None)
    df = Counter(w for _, _, ws in docs for w in set(ws))
    unit = {}
    for k, _, ws in docs:
        v = {w: n / len(ws) * (math.log((len(docs) + 1) / (df[w] + 1)) + 1) for w, n in Counter(ws).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        unit[k] = {w: x / norm for w, x in v.items()}
    of, members = {}, defaultdict(list)
    for k, s, ws in docs:
        if not ws:
            continue
        # The first seed that is alike takes it.
        of[k] = next((i for i in members if sum(x * unit[i].get(w, 0.0) for w, x in unit[k].items()) >= 0.82), k)
        members[of[k]].append((k, s))
    out = set()
    for seed, got in members.items():
        sources = len({s for _, s in got})
        if len(got) >= 3 and sources >= 2:
            out |= {(k, seed, len(got), sources, round(min(0.5 + 0.08 * (len(got) - 3), 0.95), 3)) for k, _ in got}
    return out


def test_narrative_clusters(spark, tmp_path):
    base = [f"base{k}" for k in range(60)]
    # A chain of texts, each with one word more changed, so that clusters depend on the seeds; copies, one of a single source, and an empty text.
    docs = [(k, f"s{k % 3}", " ".join(base[: 60 - k] + [f"word{j}" for j in range(k)])) for k in range(16)]
    docs += [(20 + k, f"s{k}", "one two three four copies") for k in range(4)] + [(30 + k, "only", "five six seven copied texts") for k in range(4)] + [(40, "s1", ""), (41, "s2", "")]
    folder = stored(spark, tmp_path, documents=(docs, "doc_id long, source string, text string"))
    want = clusters(docs)
    assert len({c for _, c, *_ in want}) >= 2
    assert set(rows(spark, "g29_narrative_clusters", folder)) == want
    given = oracle.connect(SF).execute("SELECT doc_id, source, text FROM documents").fetchall()
    assert set(rows(spark, "g29_narrative_clusters", SF)) == clusters(given)


def test_corpus_queries_read_documents(spark):
    n = oracle.connect(SF).execute("SELECT count(*) FROM documents WHERE regexp_matches(lower(text), '[a-z]{3,}')").fetchone()[0]
    assert own.queries()["t15_tfidf_documents"](spark, SF).select("doc_id").distinct().count() == n


def test_simhash_shuffles_nothing(spark):
    from skylark import queries as own

    plan = own.queries()["t16_md5_simhash"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
