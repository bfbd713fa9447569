"""The positional index against plain search of word lists."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skylark.operators import search


def holds(words, phrase):
    return any(tuple(words[k : k + len(phrase)]) == phrase for k in range(len(words)))


def test_phrases_and_boolean_terms(spark, tmp_path):
    draw = random.Random(4)
    docs = [(k, " ".join(draw.choice(["a", "b", "c", "A", "b,", "d"]) for _ in range(draw.randrange(12)))) for k in range(200)] + [(900, None), (901, ""), (902, "a " * 20_000 + "b z")]
    search.write_index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    words = {i: re.findall("[a-z]+", t.lower()) for i, t in docs if t is not None}
    for s in (
        search.Search((((("a",)),),)),
        search.Search(((("a", "b"),), (("c",), ("d", "d")))),
        search.Search(((("a", "a", "b"), ("b", "c", "a")),), (("d",), ("c", "c"))),
        search.Search(((("nowhere",), ("z",)),)),
        search.Search(((("nowhere",),),)),
    ):
        got = {r.doc_id: r.score for r in search.found(spark, str(tmp_path), s).collect()}
        want = {i for i, w in words.items() if all(any(holds(w, p) for p in group) for group in s.all_of) and not any(holds(w, p) for p in s.none_of)}
        assert set(got) == want
    one = search.found(spark, str(tmp_path), search.Search(((("a", "b"),),)))
    assert all(r.score > 0 for r in one.collect())
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=|INSET)", plan)


def test_rarer_phrases_and_shorter_texts_score_higher(spark, tmp_path):
    docs = [(1, "red sun"), (2, "red sun over a very long line of other words"), (3, "blue sun"), (4, "red moon red moon")]
    search.write_index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    scores = {r.doc_id: r.score for r in search.found(spark, str(tmp_path), search.Search(((("red",), ("sun",)),))).collect()}
    assert scores[1] > scores[2] > 0 and set(scores) == {1, 2, 3, 4}
    with_phrase = search.found(spark, str(tmp_path), search.Search(((("red", "moon"),),))).collect()
    assert [r.doc_id for r in with_phrase] == [4] and with_phrase[0].score == pytest.approx(with_phrase[0].score)
    assert search.found(spark, str(tmp_path), search.Search(((("moon", "red"),),))).select(F.count("*")).first()[0] == 1


def test_a_batch_of_texts_is_not_held_as_objects():
    """Five thousand texts of 200 words in one batch, which took 264 MB of Python objects at once."""
    import tracemalloc

    import pyarrow as pa

    from skylark.operators import search

    batch = pa.array([[f"w{(k * 7 + n) % 150}" for k in range(200)] for n in range(5000)] + [None, []], pa.list_(pa.string()))
    tracemalloc.start()
    got = search.places(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 5002 and len(got[0]) == 150 and got[5000].as_py() == [] and got[3][0].as_py() == {"term": "w3", "positions": [0, 150]}
    assert peak < 20e6
