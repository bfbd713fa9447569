"""Names: mentions, resolution and containment against plain versions."""

import random
import re

from skylark.functions import align
from skylark.operators import automaton, names


def plain_mentions(text, known):
    words, out, k = re.findall(r"\w+", text.lower()), [], 0
    while k < len(words):
        found = max((n for n in known if words[k : k + len(n)] == list(n)), key=len, default=None)
        if found:
            out.append((k, known[found]))
        k += len(found) if found else 1
    return out


def test_mentions(spark):
    draw = random.Random(2)
    vocabulary = ["an", "öl", "der", "ring", "sun", "sea"]
    texts = [(k, " ".join(draw.choice(vocabulary) + draw.choice(["", "", ",", "-x"]) for _ in range(draw.randrange(30)))) for k in range(40)] + [(90, None), (91, ""), (92, "AN an An")]
    listed = [(1, "an öl"), (2, "Ring"), (3, "an öl der"), (4, "der an"), (5, "ring"), (6, "!!"), (7, "an an"), (8, "An  ÖL")]
    known = {}
    for i, n in listed:
        if w := tuple(re.findall(r"\w+", n.lower())):
            known[w] = min(i, known.get(w, i))
    got = names.mentions(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(listed, "name_id long, name string")).collect()
    want = [(i, place, n) for i, t in texts if t for place, n in plain_mentions(t, known)]
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 40
    none = names.mentions(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(listed[5:6], "name_id long, name string"))
    assert none.count() == 0
    # More names than are sent to the workers: the same by joins.
    joined = names.mentions(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(listed, "name_id long, name string"), most=3).collect()
    assert sorted(tuple(r) for r in joined) == sorted(want)


def test_mentions_shuffle_no_words(spark):
    found = names.mentions(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "b")], "name_id long, name string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_names_held_anywhere(spark):
    texts = [(1, "Unter Öltank und Tankwart"), (2, None), (3, ""), (4, "x" * 50_000 + "TANK")]
    for many in (1, 1_500):
        listed = [("tank",), ("Tankwart",), ("öl",), ("",), (None,), ("wart",)] + [(f"none{k}",) for k in range(many)]
        got = automaton.held_by(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(listed, "name string")).collect()
        assert sorted(tuple(r) for r in got) == sorted((i, n) for i, t in texts if t for n in {n.lower() for n, in listed if n} if n in t.lower())


def normal(n):
    return re.sub("[^a-z0-9]+", " ", n.lower()).strip()


def plain_resolved(q, actors, least=0.92):
    raws, norms = {}, {}
    for i, n in actors:
        if n.strip():
            raws[n.strip().lower()] = min(i, raws.get(n.strip().lower(), i))
            if normal(n):
                norms[normal(n)] = min(i, norms.get(normal(n), i))
    if q.strip().lower() in raws:
        return raws[q.strip().lower()], "exact"
    n = normal(q)
    if n in norms:
        return norms[n], "normal"
    best, w = (0.0, 0), n.split()
    if len(n) < 5:
        return None
    for other, i in norms.items():
        o = other.split()
        if set(o) & set(w):
            score = align.winkler(n, other, whole=False)
            if len(w) >= 2 and len(w[0]) <= 2 and align.winkler(w[-1], o[-1], whole=False) >= 0.98 and o[0].startswith(w[0][0]):
                score = max(score, 0.95)
            best = max(best, (score, -i))
    return (-best[1], "fuzzy") if best[0] >= least else None


def test_resolved(spark):
    draw = random.Random(4)
    first, last = ["johann", "johanna", "peter", "petra", "alexandria constance"], ["smith", "smyth", "van der merwe", "mervin", "li"]
    actors = [(k, f"{draw.choice(first)} {draw.choice(last)}".title()) for k in range(12)] + [(50, ""), (51, "Johann-Smith")]
    asked = [(k, n) for k, n in enumerate(["J Smith", "johan smith", "JOHANN SMITH", "johann/smith", "p. van der merwe", "pter van der merwe", "a li", "x", "", "zz top", "alexandria constanze li", *[draw.choice(first)[:-1] + " " + draw.choice(last) for _ in range(30)]])]
    for least in (0.92, 0.8):
        rows = names.resolved(spark.createDataFrame(asked, "query_id long, name string"), spark.createDataFrame(actors, "actor_id long, name string"), least=least).collect()
        want = {k: v for k, n in asked if (v := plain_resolved(n, actors, least))}
        assert {r.query_id: (r.actor_id, r.how) for r in rows} == want and {h for _, h in want.values()} == {"exact", "normal", "fuzzy"}


def test_odd_transpositions_count_half():
    assert align.jaro("abcdefgh", "abdecfgh", whole=False) < align.jaro("abcdefgh", "abdecfgh")
    assert round(align.jaro("martha", "marhta", whole=False), 4) == 0.9444


def test_names_of_the_same_digits_do_not_all_meet(spark):
    """720 names of the same six digits in every order: fewer than a tenth of their pairs are made, and none is missed."""
    import itertools

    listed = [(k, f"customer 000{''.join(p)}") for k, p in enumerate(itertools.permutations("123456"))]
    found = names.alike(spark.createDataFrame(listed, "id long, norm string"))
    got = {(r.a, r.b) for r in found.collect()}
    assert got == {(a, b) for (a, x), (b, y) in itertools.combinations(listed, 2) if align.winkler(x, y) >= 0.98} and got
    pairs = len(listed) * (len(listed) - 1) // 2
    assert names.made_pairs(spark.createDataFrame(listed, "id long, norm string")).count() < pairs / 10


def test_pairs_aligned_together_are_those_aligned_alone():
    draw = random.Random(8)
    a, b = ([None if draw.random() < 0.02 else "".join(draw.choices("ab\0é\U0001f600", k=draw.choice([0, 1, 3, 8, 19]))) for _ in range(2_000)] for _ in range(2))
    for whole in (True, False):
        assert align.winklers(a, b, whole) == [None if x is None or y is None else align.winkler(x, y, whole=whole) for x, y in zip(a, b)]
