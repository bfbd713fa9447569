"""Texts alike by the cosine of their words: blocks against the join of all terms."""

import random

from pyspark.sql import functions as F

from skylark.operators import cosine
from skylark.operators import text as engines


def test_blocks_equal_the_join_of_all_terms(spark, monkeypatch):
    """Small blocks and small lots of pairs; terms of one text alone, rows that stand for copies, and a term of all texts."""
    draw = random.Random(8)
    base = [[f"w{draw.randrange(60)}" for _ in range(draw.randrange(3, 30))] for _ in range(25)]
    rows = []
    for k in range(150):
        words = list(draw.choice(base)) + ["all"]
        for _ in range(draw.randrange(4)):
            words[draw.randrange(len(words))] = draw.choice(["w1", f"own{k}", "w59"])
        rows.append((1_000 - k, draw.choice([1, 1, 3]), words))
    once = spark.createDataFrame(rows, "doc_id long, copies long, w array<string>")
    n = sum(r[1] for r in rows)
    terms = once.select("doc_id", "copies", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("doc_id", "copies", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = terms.groupBy("term").agg(F.sum("copies").alias("df"))
    weight = F.col("tf") / F.col("len") * (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1)
    weights = terms.join(df, "term").select("doc_id", "term", "df", weight.alias("weight"))
    want = {(r.a, r.b): round(r.cosine, 9) for r in engines.cosine_pairs(weights, 0.7).collect()}
    assert len(want) > 100
    monkeypatch.setattr(cosine, "MET", 40)
    for words, few in ((600, 500_000), (10_000_000, 0)):
        monkeypatch.setattr(cosine, "FEW_TERMS", few)
        assert {(r.a, r.b): round(r.cosine, 9) for r in cosine.alike(once, n, 0.7, words).collect()} == want


def test_no_rows_of_pairs_and_terms(spark, monkeypatch):
    """The search of narratives makes no join of candidates with their words, which took more disk than the texts many times over."""
    import pytest

    from skylark import queries as own

    monkeypatch.setattr(engines, "cosine_pairs", lambda *_: pytest.fail("pairs were joined with terms"))
    assert own.queries()["g29_narrative_clusters"](spark, "/root/testdata/sf0.001").columns
