"""Subject, verb and object by nearest spans, on sentences whose triples are known."""

import pytest

from skylark.operators import triples

ENTITIES = [(1, "Hawks"), (2, "Gupta Holdings"), (3, "Jane Moloi"), (4, "the State"), (5, "Head Office"), (6, "Transnet")]
LEXICON = [("investigate", "INVESTIGATES"), ("arrest", "INVESTIGATES"), ("award", "CONTRACTED"), ("pay", "CONTRACTED"), ("appoint", "CONTRACTED"), ("head", "MEMBER_OF"), ("accuse", "ACCUSED_OF"), ("bid", "CONTRACTED")]


@pytest.fixture(scope="module")
def verbs(spark):
    irregular = spark.createDataFrame([("pay", "paid", True)], "lemma string, form string, participle boolean")
    return triples.forms(spark.createDataFrame(LEXICON, "lemma string, relation string"), irregular)


def found(spark, verbs, *texts, generic=()):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = triples.triples(docs, spark.createDataFrame(ENTITIES, "name_id long, name string"), verbs, generic=generic)
    return sorted((r.doc_id, r.subject, r.relation, r.object, r.passive, r.sentence) for r in got.collect() if r.approximate)


def test_forms(verbs):
    got = {r.form: (r.relation, r.participle) for r in verbs.collect()}
    for form in ("accuse", "accuses", "accused", "accusing", "pays", "paid", "awarded", "bids", "bidding"):
        assert form in got
    assert got["arrested"] == ("INVESTIGATES", True) and got["arrests"] == ("INVESTIGATES", False) and got["paid"] == ("CONTRACTED", True)


def test_active_and_passive(spark, verbs):
    texts = [
        "The Hawks arrested Jane Moloi on Friday.",
        "Jane Moloi was arrested by the Hawks.",
        "Jane Moloi was later arrested by the Hawks!",
        "Jane Moloi was arrested. The Hawks left.",
        "Jane Moloi was arrested near Transnet.",
        "Transnet PAID Gupta Holdings, and Transnet paid Gupta Holdings again.",
    ]
    assert found(spark, verbs, *texts) == [
        (0, 1, "INVESTIGATES", 3, False, 0),
        (1, 1, "INVESTIGATES", 3, True, 0),
        (2, 1, "INVESTIGATES", 3, True, 0),
        (5, 6, "CONTRACTED", 2, False, 0),
    ]


def test_sentences_bound_the_spans(spark, verbs):
    assert found(spark, verbs, "The Hawks met. They arrested Jane Moloi.", "Hawks said so\nTransnet awarded\nGupta Holdings won", "Nothing here. Transnet appointed Jane Moloi. Transnet appointed Jane Moloi.") == [(2, 6, "CONTRACTED", 3, False, 1)]


def test_names_hold_no_verbs_and_generic_subjects_fall(spark, verbs):
    assert found(spark, verbs, "Transnet left Head Office with Jane Moloi.") == []
    text = "The State accused Jane Moloi. Hawks investigate the State."
    assert found(spark, verbs, text) == [(0, 1, "INVESTIGATES", 4, False, 1), (0, 4, "ACCUSED_OF", 3, False, 0)]
    assert found(spark, verbs, text, generic=["the state"]) == [(0, 1, "INVESTIGATES", 4, False, 1)]


def test_odd_texts(spark, verbs):
    long = "word " * 50_000 + "Hawks arrested Transnet " + "word " * 50_000
    assert found(spark, verbs, None, "", "...", "arrested", "Hawks arrested", "arrested Hawks", "Hawks arrested Hawks", long) == [(7, 1, "INVESTIGATES", 6, False, 0)]


def test_no_nested_loop_and_no_words_shuffled(spark, verbs):
    docs = spark.createDataFrame([(1, "Hawks arrested Transnet")], "doc_id long, text string")
    plan = triples.triples(docs, spark.createDataFrame(ENTITIES, "name_id long, name string"), verbs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("Exchange hashpartitioning") <= 2
