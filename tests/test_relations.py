"""Links of a signal's actors by verb patterns, on rows whose links are known."""

from skylark.operators import relations

SIGNALS = "signal_id long, title string, content string"
ACTORS = "signal_id long, actor_id long, name string, confidence double"


def links(spark, signals, actors, **more):
    got = relations.verb_links(spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(actors, ACTORS), **more)
    return sorted((r.subject, r.object, r.relation, r.confidence, r.signal_id) for r in got.collect())


def test_first_pattern_weight_and_orientation(spark):
    signals = [(1, "Police ARRESTED him", "who leads the board"), (2, "The board", "appointed her"), (3, "Nothing said", None), (4, None, "x" * 300 + " murder"), (5, None, "y" * 290 + " murder"), (6, None, None)]
    actors = [(s, a, n, c) for s in range(1, 7) for a, n, c in ((7, "SAPS Durban", 0.9), (8, "Jane Moloi", 0.8), (9, "Low", 0.2))]
    assert links(spark, signals, actors) == [(7, 8, "LEADS", 0.48, 2), (7, 8, "TARGETED_BY", 0.56, 5), (8, 7, "INVESTIGATED_BY", 0.52, 1)]


def test_enforcers_stay_where_both_are_or_neither(spark):
    signals = [(1, "raid", ""), (2, "raid", "")]
    actors = [(1, 1, "Hawks", 0.9), (1, 2, "NPA", 0.9), (2, 3, "A", 0.9), (2, 4, "B", 0.9)]
    assert links(spark, signals, actors) == [(1, 2, "INVESTIGATED_BY", 0.495, 1), (3, 4, "INVESTIGATED_BY", 0.495, 2)]


def test_weak_links_noise_nulls_and_repeats(spark):
    signals = [(2, "member", ""), (1, "member", "")]
    actors = [(1, 1, "A", 0.35), (1, 2, "B", 0.36), (2, 1, "A", 0.5), (2, 2, "B", 0.9), (2, 2, "B", 0.9), (2, 3, " Unknown ", 0.9), (2, 4, None, 0.9), (2, 5, "C", None)]
    assert links(spark, signals, actors, noise=["unknown"]) == [(1, 2, "AFFILIATED_WITH", 0.2, 2)]
    assert links(spark, [], actors) == [] and links(spark, signals, []) == []
