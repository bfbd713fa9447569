"""Prefix BPE, tokenizer alignment and spelling variants against the libraries themselves and plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skylark.llm import aligned, chunks, prefix_bpe, queries, variants
from skylark.llm.bpe import vocabulary_path

SF = "/root/testdata/sf0.001"
A, B = vocabulary_path(None, aligned.VOCABULARY_A), vocabulary_path(None, aligned.VOCABULARY_B)
PARTS = [*" \n\t\r\xa0a'bcst.é日𓀀1½A!<\x00\x1cǅßµ-_{})\";/*", "<|endoftext|>", "   ", "the", "ing", " of", "aaaa", "\r\n", ").\r", "▁", "</s>", "\n\n", "don't", "it's.", "naïve", "ﬁn", "foo.bar(1)", "Ᲊ", "՘"]
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (5, "one two"), (None, "one two three four"), (7, "wörd " * 3_000), (8, "!!! 123"), (9, "a▁b"), (10, "x<|endoftext|>y"), (11, "e" * 20_000), (12, " " * 20_000)]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) if rng.random() < 0.95 else chr(rng.randrange(1, 0xD7FF)) for _ in range(rng.randrange(25))) for _ in range(n)]


def odd_docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, 1, "x", "y", 7, "z") for i, t in rows], "doc_id long, text string, n_tokens long, ids string, word string, n long, groups string")


def test_chunks_are_the_text_and_a_vocabulary_is_proved():
    for text in odd_texts(2_000):
        assert "".join(chunks.chunks(text)) == text
    assert chunks.chunks(' It\'s "x".\nOne, two\n\nthree  end.\r\nlast ') == [" It", "'s", ' "x".', "\n", "One", ",", " two", "\n\nthree", "  end", ".\r\nlast", " "]
    assert not chunks.may_cut(["word."]) and not chunks.may_cut(["a b"]) and not chunks.may_cut(["\nx"]) and chunks.may_cut([" word", ".\r", "..", "  ", "1."])


def test_prefix_bpe_equals_the_library():
    library, own = Tokenizer.from_file(A), prefix_bpe.PrefixBpe(A)
    for text in odd_texts(4_000):
        want = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_each_prefix_has_one_last_token():
    own = prefix_bpe.PrefixBpe(A)
    for word in ["internationalization", "aaaaaaa", " wörter", "bébébé", "ndthingerent"]:
        raw = word.encode()
        for end in range(1, len(raw) + 1):
            before = {at: own.piece_ids(raw[:at])[-1] if at else own.start for at in range(end)}
            fits = [k for _, (k, n) in own.automaton.iter(raw[:end].decode("latin-1")) if _ == end - 1 and own.may_follow(before[end - n], k)]
            assert len(fits) == 1


def test_pairs_may_follow_as_the_library_encodes_them():
    library, own, rng = Tokenizer.from_file(A), prefix_bpe.PrefixBpe(A), random.Random(4)
    words = [k for k in range(50_000) if own.token[k].isalpha()]
    short = [k for k in words if len(own.token[k]) <= 3]
    for _ in range(3_000):
        a, b = rng.choice(words), rng.choice(short)
        text = (own.token[a] + own.token[b]).decode()
        assert own.may_follow(a, b) == (library.encode(text, add_special_tokens=False).ids == [a, b])


@pytest.mark.parametrize("text", ["a" * 1_000_000, " " * 1_000_000, "x" + "\n" * 1_000_000 + "y", "é" * 300_000])
def test_prefix_bpe_of_long_runs(text):
    own, began = prefix_bpe.PrefixBpe(A), time.time()
    assert own.decode(own.encode(text)) == text
    assert time.time() - began < 30
    assert np.frombuffer(own.encode(text[:3_000]), "<u4").tolist() == Tokenizer.from_file(A).encode(text[:3_000], add_special_tokens=False).ids


def test_query_of_codec_equals_the_library(spark):
    library = Tokenizer.from_file(A)
    rows = {r.doc_id: r for r in queries.op11_bpe_codec(spark, SF).collect()}
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert len(rows) == len(texts)
    for doc, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[doc].n_tokens == len(ids)
        assert rows[doc].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[doc].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_codec_of_odd_rows(spark):
    got = prefix_bpe.encode(odd_docs(spark)).withColumn("back", prefix_bpe.decoded(F.col("ids"))).collect()
    assert sorted((r.doc_id or 0, r.back) for r in got) == sorted((i or 0, t or "") for i, t in ODD)
    assert {r.doc_id: r.n_tokens for r in got}[1] == 0 and all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert prefix_bpe.encode(odd_docs(spark, [])).count() == 0


class Plain:
    """Alignment of whole texts, each pair of tokens compared."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        of = prefix_bpe.byte_alphabet()
        self.bytes_a = {k: bytes(of[c] for c in t) for t, k in self.a.get_vocab().items() if t != "<|endoftext|>"}

    def bytes_b(self, k):
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    def __call__(self, text):
        """(ids of A, of B, groups, links), or None."""
        if not text:
            return None
        ids_a, ids_b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw_a, raw_b = [self.bytes_a[k] for k in ids_a], [self.bytes_b(k) for k in ids_b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return None
        ends_a, ends_b = (np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b))
        groups, before = [], 0
        for cut in sorted({*ends_a} & {*ends_b}):
            sides = [",".join(str(k) for k, e in zip(ids, ends, strict=True) if before < e <= cut) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))]
            groups.append("|".join(sides))
            before = cut
        spans_a, spans_b = ([(e - len(x), e, k) for e, x, k in zip(ends, raw, ids, strict=True)] for ends, raw, ids in ((ends_a, raw_a, ids_a), (ends_b, raw_b, ids_b)))
        links, j = [], 0
        for start, end, k in spans_a:
            while spans_b[j][1] <= start:
                j += 1
            at = j
            while at < len(spans_b) and spans_b[at][0] < end:
                links.append((k, spans_b[at][2]))
                at += 1
        return ids_a, ids_b, groups, links

    def rows(self, texts):
        found = [(i, self(t)) for i, t in texts]
        counts = Counter(x for _, f in found if f for x in f[3])
        most = Counter()
        for (_, b), n in counts.items():
            most[b] = max(most[b], n)
        for i, f in found:
            if f is None:
                yield i, 0, 0, 0, 0, 0, 0, ""
            else:
                yield i, len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(counts[x] == most[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_alignment_by_chunks_is_that_of_whole_texts():
    own, plain = aligned.Aligner(A, B), Plain()
    assert own.cuts
    for text in odd_texts(3_000, seed=8):
        want, parts = plain(text), list(own.align(own.chunks(text))) if text else [None]
        if want is None:
            assert None in parts
            continue
        assert ";".join(p[0] for p in parts) == ";".join(want[2])
        assert sorted(x for p in parts for x in p[4]) == sorted(a * aligned.RADIX + b for a, b in want[3])


def test_spans_are_refined_by_bytes():
    assert aligned.byte_ends([(0, 1), (1, 4), (1, 4), (1, 4), (4, 6)], [b"a", b"x", b"y", b"z", b"bc"]) == [1, 2, 3, 4, 6]
    assert aligned.byte_ends([(0, 0), (0, 2)], [b"a", b"bc"]) == [1, 3]
    assert aligned.grouped([1, 2, 3], [2, 3, 7], [8, 9, 7], [3, 5, 7]) == ("1,2|8;3|9,7", 2, [1 * aligned.RADIX + 8, 2 * aligned.RADIX + 8, 3 * aligned.RADIX + 9, 3 * aligned.RADIX + 7])


def test_query_of_alignment_equals_whole_texts(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_tokenizer_alignment(spark, SF).select(*COLUMNS).collect()
    assert sorted_rows(got) == sorted_rows(Plain().rows(texts))


def test_alignment_of_odd_rows_and_small_blocks(spark):
    texts = ODD + [(100 + k, t) for k, t in enumerate(odd_texts(200))]
    want = sorted_rows(Plain().rows(texts))
    assert sorted_rows(aligned.align(odd_docs(spark, texts)).select(*COLUMNS).collect()) == want
    assert sorted_rows(aligned.align(odd_docs(spark, texts), block_chars=100, remembered=20).select(*COLUMNS).collect()) == want
    assert aligned.align(odd_docs(spark, [])).count() == 0
    groups = {r.doc_id: r.groups for r in aligned.groups(odd_docs(spark)).collect()}
    assert groups[1] == [] and groups[9] is None
    assert [(list(g.a), list(g.b)) for g in groups[4]] == [([int(x) for x in g.split("|")[0].split(",")], [int(x) for x in g.split("|")[1].split(",")]) for g in Plain()("one")[2]]


def plain_variants(docs, least_length, least_count, every):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]

    found = {w: [o for o in words if near(w, o)] for w in words}
    form = {w: min(o, key=lambda x: (-words[x], x)) if (o := found[w]) else None for w in words}
    form = {w: f if f and words[f] >= 2 * words[w] else None for w, f in form.items()}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        yield w, words[w], len(found[w]), form[w], words[form[w]] if form[w] else None, root


@pytest.mark.parametrize("least,every", [(5, 97), (2, None), (3, 7)])
def test_variants_equal_all_pairs(spark, least, every):
    rng = random.Random(least)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(150)] + ["Straße", "strasse", "STRASSE", "aaaaa", "aaaaaa", "aaaaaaa", "ÀÉÿ÷×"]
    docs = [(k if k % 9 else None, " ".join(rng.choice(words) + rng.choice(["", ",", "1", "\n"]) for _ in range(60))) for k in range(40)] + ODD
    got = variants.variants(odd_docs(spark, docs), least, 3, every).collect()
    assert sorted_rows(got) == sorted_rows(plain_variants(docs, least, 3, every))


def test_variants_of_no_rows(spark):
    assert variants.variants(odd_docs(spark, [])).count() == 0
    assert variants.variants(odd_docs(spark, ODD[:3])).count() == 0


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(str(k), str(k + 1)) for k in range(40)], "word string, form string")
    assert {(r.word, r.root) for r in variants.rooted(forms).collect()} == {(str(k), "40") for k in range(40)}
