"""The operators against plain versions, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skylark.llm import attribution, bpe, chat, decontaminate, html, langid, mixing, packing, quality, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (5, "one two"), (None, "one two three four"), (7, "wörd " * 30_000), (8, "!!! 123")]


def odd_docs(spark, rows=ODD):
    names = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, taken long, coverage double, llr double, fp string"
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, None if k % 3 else "a", 1, 99, 0.5, 7, 0.1, 0.2, "x") for k, (i, t) in enumerate(rows)], names)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Smallest id reachable over links of two bits or less; prints: {id: fingerprint}."""
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {k: find(k) for k in prints}


def test_op9_equals_brute_force(spark):
    prints = {i: plain_fingerprint(t) for i, t in documents(spark)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash_dedup(spark, SF).collect()}
    groups = plain_groups(prints)
    assert got == {i: (f"{f:016x}", groups[i]) for i, f in prints.items()}


def test_simhash_links_in_crowded_cells(spark):
    draw = random.Random(1)
    base = draw.getrandbits(64)
    fps = {base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(1, 64, 5)} | {draw.getrandbits(64) for _ in range(200)}
    fps |= {draw.choice(sorted(fps)) ^ (1 << draw.randrange(64)) for _ in range(50)}
    prints = dict(enumerate(sorted(fps)))
    signed = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = simhash.links(signed, dense=8)
    assert all((a ^ b) & (1 << 64) - 1 and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in edges.collect())
    comp = {r.node: r.component for r in simhash.components(edges).collect()}
    want, number = plain_groups(prints), {f - (1 << 64) if f >> 63 else f: k for k, f in prints.items()}
    got = {}
    for f, k in number.items():
        got.setdefault(comp.get(f, f), set()).add(k)
    expected = {}
    for k, g in want.items():
        expected.setdefault(g, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_simhash_odd_rows(spark):
    found = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(found) == len(ODD)
    assert {r.component_id for r in found if r.doc_id in (1, 2, 3)} == {1}
    kept = simhash.one_of_each_group(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8]
    assert simhash.near_duplicates(odd_docs(spark, ODD[:1]).where("false")).count() == 0


def test_op1_statistics_equal_brute_force(spark):
    got = {r.doc_id: r for r in queries.op1_quality_rules(spark, SF).collect()}
    docs = documents(spark)
    assert len(got) == len(docs)
    for i, t in docs:
        words = WORD.findall(t or "")
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        seen = {w: windows.count(w) for w in set(windows)} if len(windows) < 3000 else None
        if seen is None:
            continue
        marked = {j for k, w in enumerate(windows) if seen[w] > 1 for j in range(k, k + 8)}
        lines, dup, before = (t or "").split("\n"), 0, set()
        for line in lines:
            if WORD.search(line):
                dup += line in before
                before.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(marked))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_op1_counts_cover_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sum((np.bincount(quality.hashed(t), minlength=quality.BUCKETS) for _, t in documents(spark)), np.zeros(quality.BUCKETS, int))
    assert (quality.bucket_counts(docs) == want).all()
    junk, good = [(k, "\n".join(f"{w}###" for w in "abc def ghi".split() * 9)) for k in range(9)], [(k + 100, f"plain words of text number {k} go on and on in this line of many different words, as they do here") for k in range(9)]
    frame = spark.createDataFrame(junk + good, "doc_id long, text string")
    kept = {r.doc_id: r.llr for r in quality.quality(frame, frame.where("doc_id >= 100")).collect()}
    assert max(v for k, v in kept.items() if k < 100) < min(v for k, v in kept.items() if k >= 100)


def test_quality_odd_rows(spark):
    docs = odd_docs(spark)
    rows = quality.quality(docs, docs.where("false")).collect()
    assert len(rows) == len(ODD) and all(r.llr == 0 for r in rows)
    assert quality.quality(docs.where("false"), docs.where("false")).count() == 0
    ids = spark.createDataFrame([(5,), (None,), (99,)], "doc_id long")
    assert sorted(r.doc_id for r in quality.documents_of(docs, ids.where("doc_id is not null")).collect()) == [5, 5]


def plain_targets(sizes, cycle=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    weight, budget = {k: cycle[i % len(cycle)] for i, k in enumerate(order)}, share * sum(sizes.values())
    full = set()
    while True:
        left = budget - sum(cap * sizes[k] for k in full)
        total = sum(weight[k] for k in sizes if k not in full) or 1
        target = {k: cap * sizes[k] if k in full else left * weight[k] / total for k in sizes}
        over = {k for k in sizes if k not in full and target[k] > cap * sizes[k]}
        if not over:
            return target
        full |= over


def test_op3_targets_and_taken_words(spark):
    rows = queries.op3_source_mixing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    sizes, taken = {}, {}
    words = {d.doc_id: len(WORD.findall(d.text or "")) for d in docs}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + words[d.doc_id]
    want = plain_targets(sizes)
    for r in rows:
        assert r["size"] == words[r.doc_id] and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 2 * r["size"] and r.taken == r.whole * r["size"] + r.part
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(rows) == sorted(queries.op3_source_mixing(spark, SF).collect())


def test_mixing_odd_rows(spark):
    docs = odd_docs(spark)
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(ODD) and sum(r.taken for r in plan) == pytest.approx(1.5 * sum(r["size"] for r in plan), abs=2)
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    taken, meant, cut = ({} for _ in range(3))
    for r in mix.collect():
        taken[r.source] = taken.get(r.source, 0) + len(WORD.findall(r.text))
    for r in plan:
        meant[r.source] = meant.get(r.source, 0) + r.taken
        cut[r.source] = cut.get(r.source, 0) + (r["size"] / 2 if r.part else 0)
    # Texts are whole, so that a source differs from its plan by half of the document that the plan takes in part.
    assert {r.text for r in mix.collect()} <= {t for _, t in ODD}
    assert all(abs(taken.get(k, 0) - n) <= cut[k] for k, n in meant.items())
    assert mixing.mix_plan(docs.where("false")).count() == 0 and mixing.mixed(docs.where("false")).count() == 0
    table = spark.createDataFrame([("a", 1.0), (None, 3.0)], "source string, weight double")
    assert mixing.mix_plan(docs, weights=table).count() == len(ODD)


def test_op4_finds_toxic_documents(spark):
    rows = {r.doc_id: r for r in queries.op4_toxicity(spark, "/root/testdata/sf0.01").collect()}
    slurs = re.compile(r"\b(idiot|scum|moron|trash|stupid|clown|loser|pathetic|worthless|disgusting)\b", re.I)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    toxic = [rows[d.doc_id].toxic for d in docs if len(set(slurs.findall(d.text.lower()))) > 1]
    assert len(toxic) > 10 and np.mean(toxic) > 0.95
    clean = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("toxic = 0").collect()}
    assert np.mean([rows[i].toxic for i in clean if i in rows]) < 0.02


def test_toxicity_equals_a_plain_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = queries.toxicity_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    chain = toxicity.fit(docs, labels, queries.CATEGORIES)
    for r in toxicity.classify(docs, chain, queries.CATEGORIES).collect():
        keys, earlier = set(toxicity.word_keys(r.text)), []
        for name, link in zip(queries.CATEGORIES, chain, strict=True):
            x = [float(int(k) in keys) for k in link.words] + earlier + [1.0]
            earlier.append(1 / (1 + np.exp(-sum(a * b for a, b in zip(x, link.weights, strict=True)))))
            assert r[f"p_{name}"] == pytest.approx(earlier[-1], abs=1e-9)


def test_toxicity_trains_on_out_of_fold_probabilities(monkeypatch):
    """The later model's training column holds, for every row, the probability by a model fitted without that row's fold."""
    seen, own = [], toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda x, y, ridge: seen.append((x, y)) or own(x, y, ridge))
    draw = random.Random(8)
    keys = [np.array(sorted({draw.randrange(6), 20 + draw.randrange(6)}), np.uint64) for _ in range(80)]
    first = np.array([float(0 in k or draw.random() < 0.2) for k in keys])
    toxicity.fit_chain(np.concatenate(keys), np.array(list(map(len, keys))), np.stack([first, first], 1), words=8)
    rows, fold = toxicity.Rows(np.concatenate(keys), np.array(list(map(len, keys)))), toxicity.folds(80, toxicity.FOLDS)
    want = np.zeros(80)
    for f in range(toxicity.FOLDS):
        use = fold != f
        x = rows.present(rows.chosen(first, use, 8))
        w = own(x[use], first[use], toxicity.RIDGE)
        want[~use] = 1 / (1 + np.exp(-(x[~use] @ w[:-1] + w[-1])))
    column = seen[-1][0][:, -1]
    assert column == pytest.approx(want) and ((0 < column) & (column < 1)).all()


def test_toxicity_chain_feeds_earlier_categories_and_odd_rows(spark):
    keys = [np.array(sorted({k % 7, 50 + k % 3}), np.uint64) for k in range(60)]
    y = np.array([[k % 7 == 0, k % 7 == 0 and k % 3 == 0] for k in range(60)], float)
    chain = toxicity.fit_chain(np.concatenate(keys), np.array(list(map(len, keys))), y, words=10)
    assert len(chain[1].weights) == len(chain[1].words) + 1 + 1 and chain[1].weights[-2] > 0
    docs, labels = odd_docs(spark), spark.createDataFrame([(4, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels, ["toxic"])
    assert toxicity.classify(docs, chain, ["toxic"]).count() == len(ODD)
    none = toxicity.fit(docs.where("false"), labels, ["toxic"])
    assert toxicity.classify(docs, none, ["toxic"]).where("p_toxic is null").count() == 0


def plain_tiles(a, b, least):
    """Greedy tiling by trying every pair of places."""
    ua, ub, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ua[i + n] and not ub[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        ua[i : i + n] = ub[j : j + n] = [True] * n
        total += n


def test_tiling_equals_brute_force():
    draw = random.Random(4)
    for _ in range(60):
        b = [draw.choice("abcdefgh") for _ in range(draw.randrange(1, 25))]
        cut = draw.randrange(len(b) + 1)
        a = [draw.choice("xyz") for _ in range(5)] + b[cut:] + [draw.choice("abcxyz") for _ in range(draw.randrange(6))] + b[:cut]
        tiles = decontaminate.tile(a, b, 3)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in tiles)
        for side, text in ((0, a), (1, b)):
            used = [k for t in tiles for k in range(t[side], t[side] + t[2])]
            assert len(used) == len(set(used)) and all(k < len(text) for k in used)
        assert [t[2] for t in tiles] == sorted((t[2] for t in tiles), reverse=True)
        if tiles:
            assert sum(t[2] for t in tiles) == plain_tiles(a, b, 3)


def test_tiling_ends_on_sequences_that_hash_alike():
    """A Thue-Morse block and its complement have equal polynomial hashes modulo powers of two."""
    block, around = [bin(k).count("1") % 2 for k in range(2048)], [f"w{k}" for k in range(3000)]
    a, b = (around + [names[t] for t in block] + around[::-1] for names in ("pq", "qp"))
    tiles = decontaminate.tile(a, b)
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in tiles) and sum(n for _, _, n in tiles) >= 6000


def test_tiling_goes_on_below_a_length_at_which_only_hashes_agree(monkeypatch):
    monkeypatch.setattr(decontaminate.KarpRabin, "windows", lambda self, n: np.zeros(max(0, len(self.parts[0][1]) - n), np.uint64))
    a, b = "a b c d e f g".split(), "x a b c d y e f g".split()
    assert decontaminate.tile(a, b, 3) == [(0, 1, 4), (4, 6, 3)]


def test_op5_equals_brute_force_and_catches_reordered_passages(spark):
    items = [(r.item_id, decontaminate.tokens(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in queries.op5_decontamination(spark, SF).collect()}
    docs = documents(spark)
    assert len(got) == len(docs)
    for i, t in docs:
        words = decontaminate.tokens(t)
        if len(words) < 400:
            grams = {tuple(words[k : k + 4]) for k in range(len(words))}
            near = [w for _, w in items if any(tuple(w[k : k + 4]) in grams for k in range(len(w) - 3))]
            best = max((plain_tiles(words, w, 4) / len(w) for w in near), default=0)
            assert got[i].coverage == pytest.approx(best, abs=1e-12) and got[i].contaminated == (got[i].coverage >= 0.5)
    item = "the quick brown fox jumps over a lazy dog while seven wizards mix potions by the old mill stream"
    w = item.split()
    texts = [(1, "zz " * 50 + " ".join(w[9:]) + " yy " * 30 + " ".join(w[:9]).upper()), (2, "nothing to see here at all in this text"), (3, None), (4, " ".join(w[:5]))]
    frame = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(9, item), (8, item), (7, None), (6, "a b")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.decontaminate(frame, bench).collect()}
    assert [rows[k].contaminated for k in (1, 2, 3, 4)] == [True, False, False, False] and rows[1].item_id == 8
    # A table so small that it lets every stretch through changes nothing; nor do repeated rows and ids of another type.
    named = bench.withColumn("item_id", F.concat(F.lit("n"), "item_id"))
    many = decontaminate.decontaminate(frame.unionAll(frame), named, bits=32).collect()
    assert sorted((r.doc_id, r.contaminated, r.coverage, r.item_id) for r in many if r.item_id) == sorted((k, r.contaminated, r.coverage, f"n{r.item_id}") for k, r in rows.items() if r.item_id for _ in "ab")
    assert len(many) == 8
    assert decontaminate.decontaminate(frame, bench.where("false")).where("contaminated").count() == 0


#: Turns that may follow each other; "" is the beginning.
FOLLOWS = {("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}


def plain_cost(roles, costs=chat.Costs()):
    """The cheapest path over (turns read, last role) to an end after an assistant's turn, by relaxing every edge until nothing changes."""
    names = ["system", "user", "assistant"]
    edges = []
    for k in range(len(roles) + 1):
        edges += [((k, a), (k, b), costs.insert) for a, b in FOLLOWS]
        if k < len(roles):
            given = (roles[k] or "").strip().lower()
            for label in names:
                price = 0 if label == given else costs.relabel if given in names else costs.name
                edges += [((k, a), (k + 1, label), price) for a, b in FOLLOWS if b == label] + [((k, label), (k + 1, label), price + costs.merge)]
    cost, moved = {(0, ""): 0.0}, True
    while moved:
        moved = False
        for a, b, price in edges:
            if cost.get(a, float("inf")) + price < cost.get(b, float("inf")) - 1e-12:
                cost[b], moved = cost[a] + price, True
    return cost[len(roles), "assistant"]


def test_op6_repairs_at_least_cost_for_any_costs(spark):
    assert plain_cost(["user", "user", "assistant"], chat.Costs(5, 1, 9)) == 1
    draw = random.Random(7)
    for _ in range(400):
        costs = chat.Costs(*(draw.choice([0.25, 0.5, 1, 2, 5, 9]) for _ in range(4)))
        roles = [draw.choice(["user", "assistant", "system", "User", None, "tool"]) for _ in range(draw.randrange(1, 9))]
        repair = chat.Repair(costs, {})
        chosen = repair.chosen(roles, chat.START, None)
        assert sum(s[2] for s in chosen) + chat.end_cost(chosen[-1][1], costs) == pytest.approx(plain_cost(roles, costs)), (roles, costs)
    turns = spark.createDataFrame([(1, k, r, r) for k, r in enumerate(["user", "user", "assistant"])], "conv_id long, turn long, role string, text string")
    fixed = chat.repair_roles(turns, chat.Costs(5, 1, 9))
    assert [(r.op, r.opens) for r in fixed.orderBy("place").collect()] == [("keep", 1), ("insert", 2), ("keep", 1)]
    assert LEGAL.match(chat.render(fixed).first().text)


LEGAL = re.compile(r"^(<\|im_start\|>system\n.*?<\|im_end\|>\n)?(<\|im_start\|>user\n.*?<\|im_end\|>\n<\|im_start\|>assistant\n.*?<\|im_end\|>\n)+$", re.S)


def test_op6_repairs_at_least_cost(spark):
    draw, rows, want = random.Random(2), [], {}
    for conv in range(40):
        roles = [draw.choice(["user", "assistant", "system", "User", None, "tool"]) for _ in range(draw.randrange(1, 7))]
        rows += [(conv, k, r, f"t{k}", 1) for k, r in enumerate(roles)]
        want[conv] = plain_cost(roles)
    rows += [(None, 0, "user", None, 1), (100, None, "user", "x", 1), (100, 1, "assistant", "y", 1), (100, 1, "assistant", "y", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, op int")
    fixed = chat.repair_roles(frame)
    got = fixed.collect()
    assert len(got) == len(rows)
    cost = {}
    for r in got:
        cost[r.conv_id] = cost.get(r.conv_id, 0) + r.cost
    assert {k: v for k, v in cost.items() if k in want} == pytest.approx(want)
    assert all(LEGAL.match(r.text) for r in chat.render(fixed).collect())
    assert chat.repair_roles(frame.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_chat_keeps_ids_as_they_are(spark, kind):
    big = [9007199254740993, 9007199254740994]
    ids = {"long": [*big, None], "string": ["x1", "\u00fc", None]}[kind]
    rows = [(c, t, r, "y" * 100_000) for c in ids for t, r in ((big[0], "user"), (big[1], "assistant"))]
    got = chat.repair_roles(spark.createDataFrame(rows, f"conv_id {kind}, turn long, role string, text string"), partitions=1).collect()
    assert sorted((r.conv_id or "", r.turn, r.role) if kind == "string" else (r.conv_id or 0, r.turn, r.role) for r in got) == sorted((c or ("" if kind == "string" else 0), t, r) for c, t, r, _ in rows)
    assert {(r.op, r.cost) for r in got} == {("keep", 0.0)}


def test_chat_conversation_over_many_partitions(spark):
    roles = ["user", "user", "assistant", "system", None, "assistant"] * 200
    frame = spark.createDataFrame([(1, k, r, f"t{k}") for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    fixed = chat.repair_roles(frame, partitions=5)
    assert fixed.select(F.spark_partition_id()).distinct().count() > 1
    now, _ = chat.cheapest(roles, chat.START, chat.Costs(), {})
    assert sum(r.cost for r in fixed.collect()) == pytest.approx(min(c + chat.end_cost(s, chat.Costs()) for s, c in enumerate(now)))
    assert LEGAL.match(chat.render(fixed).first().text)


def test_op6_whole_table(spark):
    got = queries.op6_chat_roles(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/conversations.parquet").count()
    assert all(LEGAL.match(r.text) for r in chat.render(got.withColumn("text", F.lit(""))).collect())


def test_best_fit_decreasing_equals_brute_force():
    draw = random.Random(3)
    for _ in range(50):
        lengths = [draw.randrange(1, 17) for _ in range(draw.randrange(40))]
        rows, free = [], []
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            fits = [f for f in free if f >= lengths[k]]
            if fits:
                free[free.index(min(fits))] -= lengths[k]
            else:
                free.append(16 - lengths[k])
        rows = packing.best_fit_decreasing(lengths, 16)
        assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
        assert all(sum(lengths[k] for k in r) <= 16 for r in rows)
        assert sorted(16 - sum(lengths[k] for k in r) for r in rows) == sorted(free)


def test_op7_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    encode = bpe.tokenizer(bpe.vocabulary_path()).encoding
    parts = {}
    for r in packing.pack(docs, row_tokens=256, block_tokens=5000).collect():
        assert len(r.input_ids) == r.n_tokens == r.cu_seqlens[-1] <= 256 and r.cu_seqlens[0] == 0
        for a, b, doc, start in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:], r.doc_ids, r.doc_starts, strict=True):
            assert r.position_ids[a:b] == list(range(b - a))
            parts.setdefault(doc, {})[start] = r.input_ids[a:b]
    want = {i: encode.encode_ordinary(t) + [bpe.END_OF_TEXT] for i, t in documents(spark)}
    assert {i: [t for s in sorted(p) for t in p[s]] for i, p in parts.items()} == want
    assert packing.pack(docs.where("false")).count() == 0 and packing.pack(odd_docs(spark)).count() > 0


def test_write_matrix(spark, tmp_path):
    packing.write_matrix(packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), row_tokens=64), str(tmp_path / "m"), row_tokens=64)
    row = spark.read.parquet(str(tmp_path / "m")).first()
    ids = np.frombuffer(row.input_ids, "<u2")
    assert len(ids) == 64 and row.cu_seqlens[-1] == row.n_tokens


LONG_RUNS = [" ", "\n", "\t", "a", " \n\t", "ab ", "\u3000\xa0", "\r\n"]


@pytest.mark.parametrize("run", LONG_RUNS)
def test_encoding_of_long_runs_is_that_of_the_whole_text(run):
    e = bpe.tokenizer(bpe.vocabulary_path())
    for before, after in itertools.product(["", "word", "x \n", "12"], ["", "word", "\nword", " word", "!", "\xa0x"]):
        for n in (1, 2, 5_000, bpe.LONG_SPACE // len(run), bpe.LONG_SPACE + 1, 30_000):
            text = before + run * n + after
            assert e.encode(text) == e.encoding.encode_ordinary(text)


@pytest.mark.parametrize("run", LONG_RUNS)
def test_texts_of_two_million_characters(spark, run):
    text = "start" + run * (2_000_000 // len(run)) + "end"
    e = bpe.tokenizer(bpe.vocabulary_path())
    assert e.encoding.decode(e.encode(text)) == text
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    tokens = {r.doc_id: r.n for r in packing.pack(docs).select(F.explode(F.arrays_zip("doc_ids", F.slice("cu_seqlens", F.lit(2), F.size("doc_ids")), F.slice("cu_seqlens", F.lit(1), F.size("doc_ids")))).alias("p")).groupBy(F.col("p.doc_ids").alias("doc_id")).agg(F.sum(F.col("p.1") - F.col("p.2")).alias("n")).collect()}
    assert tokens == {1: len(e.encode(text)) + 1, 2: 2}
    assert attribution.section_tokens(docs).where("doc_id = 1").agg(F.sum("n_tokens")).first()[0] == pytest.approx(len(e.encode(text)))


def plain_attribution(ids, token_bytes, text, sections, rule):
    """Character by character: each belongs to the token of its first byte."""
    owner, raw = [], [k for k, i in enumerate(ids) for _ in range(token_bytes[i])]
    for c, at in zip(text, np.cumsum([0] + [len(c.encode()) for c in text])[:-1], strict=True):
        owner.append(raw[at])
    counts = [0.0] * len(sections)
    for k in range(len(ids)):
        chars = [c for c, o in enumerate(owner) if o == k]
        shared = [sum(a <= c < b for c in chars) for a, b in sections]
        if not chars:
            before = [c for c, o in enumerate(owner) if o < k]
            at = len(before)
            counts[min(next((n for n, (a, b) in enumerate(sections) if a <= at < b), len(sections) - 1), len(sections) - 1)] += 1
        elif rule == "share":
            counts = [c + s / len(chars) for c, s in zip(counts, shared, strict=True)]
        else:
            touched = [n for n, s in enumerate(shared) if s]
            counts[{"most": shared.index(max(shared)), "start": touched[0], "end": touched[-1]}[rule]] += 1
    return counts


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_equals_brute_force(rule):
    e, draw = bpe.tokenizer(bpe.vocabulary_path()), random.Random(5)
    for text in ("plain words here\n\n\nand more words\nend", "ünï ☃ 日本語 text 😀 mixed\nlines ☃☃", "internationalization of everything"):
        ids = e.encode(text)
        for _ in range(8):
            cuts = sorted(draw.sample(range(1, len(text)), 3))
            sections = list(zip([0, *cuts], [*cuts, len(text)], strict=True))
            got, _ = attribution.attribute(attribution.token_spans(e, text), sections, rule)
            assert got.tolist() == pytest.approx(plain_attribution(ids, e.token_bytes, text, sections, rule))


def test_op2_counts_add_up(spark):
    rows = queries.op2_token_counts(spark, SF)
    sums = rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("t"), F.max("end").alias("e")).collect()
    length = {i: len(t) for i, t in documents(spark)}
    assert len(sums) == len(length) and all(r.n == r.t and r.e == length[r.doc_id] for r in sums if length[r.doc_id])
    odd = attribution.section_tokens(odd_docs(spark)).collect()
    assert {r.doc_id for r in odd} == {i for i, _ in ODD} and all(r.section is None for r in odd if r.doc_id in (1, 2))


PAGE = "<html><head><title>t</title><style>x{}</style></head><body><div class='cookie-notice'>We use cookies</div><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav><main><h1>Head &amp; line</h1><p>First   paragraph of the <b>text</b>, with some words in it.<p>Second &eacute; paragraph, which goes on for a while, as it should.<div class=ad>Buy now</div><p>Third paragraph closes the text in the end.</main><aside><h3>Related</h3><a href=#>Other</a></aside><section id=comments><p>Nice one, I like it very much indeed, thanks for that.</p></section><footer>&copy; 2024</footer><script>var a='</p>';</script></body></html>"


def test_op8_extracts_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in queries.op8_html_text(spark, SF).collect()}
    for r in pages.collect():
        body = re.sub(r"<br>", " ", re.search(r"(?s)<article>(.*)</article>", r.html)[1])
        import html as h

        blocks = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", body)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)
    model = html.fit(pages)
    assert html.extract(PAGE, model) == "Head & line\n\nFirst paragraph of the text, with some words in it.\n\nSecond é paragraph, which goes on for a while, as it should.\n\nThird paragraph closes the text in the end."
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "<div><p>a<div", "z"), (None, "<p>" * 3000 + "deep", "z"), (4, "&#xD800;", "z")], "page_id long, html string, text string")
    rows = html.main_text(odd, model).collect()
    assert len(rows) == 5 and all(r.text == "" for r in rows if r.page_id in (1, 2))
    assert html.fit(odd) is None and html.main_text(odd, None).count() == 5 and html.main_text(odd.where("false"), model).count() == 0


UNCLOSED = {
    "<html><head><title>t</title><h1>Head</h1><p>Text": ["Head", "Text"],
    "<head><meta charset=x><style>a{}</style>Text": ["Text"],
    "<title>t</title><script>x<y</script><p>a": ["a"],
    "<head><title>t</title></head>\n<p>a<p>b": ["a", "b"],
    "<div>a<button>Go<p>b</div>c": ["a", "b", "c"],
    "<div>a<button>Go</div>b": ["a", "b"],
    "<div>a<button><div>Go</div></button>b</div>": ["ab"],
    "<p>a<select><option>x<option>y<p>b": ["a", "b"],
    "<p>a<select><option>x<option>y</select><p>b": ["a", "b"],
    "<p>a<svg><g><p>b<svg><text>x</text></svg>c": ["a", "bc"],
    "<p>a<noscript><p>x</noscript><p>b": ["a", "b"],
    "<p>a<script>x <p>y": ["a"],
    "<head><noscript><p>x</p></noscript></head><body><p>a": ["a"],
}


def test_omitted_and_unclosed_tags_lose_no_text():
    for page, runs in UNCLOSED.items():
        assert [" ".join(t.split()) for t in html.Tree(page).text if t] == runs, page


@pytest.mark.parametrize("end", ["<!-- <div>hidden promo", '<div class="ad', "<!-- x --", "</di", "<!doctype", "<?php echo", "<a href='x>y</a>"])
def test_unclosed_comments_and_tags_give_no_text(end):
    tree = html.Tree("<article><p>Main text.</p></article>" + end)
    assert [t for t in tree.text if t] == ["Main text."]


def test_markup_signs_in_text_stay():
    assert [t for t in html.Tree("<p>1 < 2 & 3 <= 4 &lt;b&gt; AT&T").text if t] == ["1 < 2 & 3 <= 4 <b> AT&T"]


@pytest.mark.parametrize("make", [lambda n: "<a " * n, lambda n: "<div>" * n + "</p>" * n, lambda n: "<td><ul>" + "<div>" * n + "<td></td>" * n, lambda n: "<li>" * n, lambda n: "<!--" * n, lambda n: "<button>" * n, lambda n: "<title>" + "</div>" * n, lambda n: "<" * n, lambda n: "&" * n + "<p>", lambda n: "<p " + "a=1 " * n + ">x"])
def test_broken_pages_take_linear_time(make):
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        html.Tree(make(n))
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * max(took[0], 0.05) and took[1] < 20


def test_items_close_their_like_within_a_list():
    tree = html.Tree("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul><table><tr><td>1<td>2<tr><td>3</table>")
    depth = lambda k: 0 if k <= 0 else 1 + depth(tree.parent[k])
    assert {t: depth(k) for k, t in enumerate(tree.text) if t} == {"a": 3, "b": 5, "c": 5, "d": 3, "e": 3, "1": 4, "2": 4, "3": 4}


def test_op8_fits_without_articles_and_on_repeated_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plain = pages.withColumn("html", F.regexp_replace("html", "(?i)<(/?)article", "<$1div"))
    model = html.fit(plain.unionAll(plain), sample=20)
    assert html.extract("<div><p>" + "A paragraph that is long enough to be the main text, as it seems. " * 4 + "</p></div><nav><a href=x>menu</a></nav>", model).endswith("seems.")
    assert html.fit(plain.where("false")) is None


def test_decoding_is_consistent():
    draw = random.Random(6)
    tree = html.Tree(PAGE)
    for _ in range(20):
        odds = np.array([draw.uniform(-3, 3) for _ in tree.tag])
        kept = html.decode(tree, odds)
        assert all(kept[p] for k, p in enumerate(tree.parent) if k and kept[k])
    small = html.Tree("<div><p>a</p><ul><li>b</li></ul></div>")
    odds = np.array([draw.uniform(-3, 3) for _ in small.tag])
    n = len(odds)
    legal = [s for s in itertools.product((0, 1), repeat=n) if s[0] and all(not s[k] or s[small.parent[k]] for k in range(1, n))]
    assert sum(odds[html.decode(small, odds)]) == pytest.approx(max(sum(o for o, x in zip(odds, s, strict=True) if x) for s in legal))


def test_op10_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op10_language_id(spark, sf).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([docs[r.doc_id] == r.lang_pred for r in rows if r.held_out]) > 0.98


def test_language_odd_rows(spark):
    docs = odd_docs(spark)
    model = langid.fit(docs)
    rows = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3, 8))
    none = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.where("false"), model).count() == 0
    assert langid.family_of("pt-BR") == "romance" and langid.family_of("xx") == "xx"


def test_samples_hold_a_repeated_row_once(spark):
    many = spark.range(3_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same words again").alias("text"), F.lit("en").alias("lang"))
    some = spark.createDataFrame([(k, f"ein Satz mit Wort {'x' * k}", "de") for k in range(2, 30)], "doc_id long, text string, lang string")
    docs = many.unionByName(some)
    rows = langid.sample_of(docs, "lang", "text", "doc_id", 4_000, 7)
    assert sum(r.lang == "en" for r in rows) == 1 and sum(r.lang == "de" for r in rows) == 28
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)], "doc_id long, toxic int")
    table = toxicity.labelled_sample(docs.select("doc_id", "text"), labels, ["toxic"], 2_000, "text", "doc_id", 3)
    assert sorted(table["doc_id"].to_pylist()) == list(range(1, 30))
