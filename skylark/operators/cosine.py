"""Texts alike by the TF-IDF cosine of their words: bags of words packed to a few bytes a word, two blocks of which meet in a task."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from skylark.operators.ordered import numbered
from skylark.session import checkpointed

#: Different terms up to which their numbers are sent to all tasks, words of a block, and pairs of a task's index that are looked at together.
FEW_TERMS, BLOCK_WORDS, MET = 500_000, 10_000_000, 1 << 21
#: The number of a term that no other text has.
OWN = -1


@F.arrow_udf(BinaryType())
def packed(numbers: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """For each text its terms by number (ascending), how often they come, and in how many texts they are."""
    for terms, times, df in numbers:
        out = []
        ends = terms.offsets.to_numpy()
        t, n, d = (x.flatten().to_numpy(zero_copy_only=False) for x in (terms, times, df))
        ends = ends - ends[0]
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            out.append(zlib.compress(np.concatenate([np.diff(t[lo:hi], prepend=0), n[lo:hi], -np.diff(d[lo:hi], prepend=0)]).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1))
        yield pa.array(out, pa.binary())


def _unpacked(bag: bytes) -> np.ndarray:
    """Three rows: terms, how often, in how many texts."""
    flat = np.frombuffer(zlib.decompress(bag), np.uint8).reshape(8, -1).T.copy().view("<i8").reshape(3, -1)
    return np.stack([np.cumsum(flat[0]), flat[1], -np.cumsum(flat[2])])


def bags(once: DataFrame) -> DataFrame:
    """(doc_id, words, bag) from texts (doc_id, copies, w): w the words in order, copies the number of texts that the row stands for. Terms are numbered by falling number of texts, then by name;
    those of one row alone, which are most, aren't told apart, as nothing else shares them.

    Texts that come dealt by doc_id are counted and gathered where they are.
    """
    df = once.select("copies", F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.sum("copies").alias("df"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
    known = checkpointed(numbered(df.drop("texts"), [F.desc("df"), F.desc("term")], "n"))
    few = F.broadcast(known) if known.count() <= FEW_TERMS else known
    rows = once.select("doc_id", "copies", F.explode("w").alias("term")).groupBy("doc_id", "copies", "term").agg(F.count(F.lit(1)).alias("tf"))
    numbers = F.struct(F.coalesce("n", F.lit(OWN)).alias("n"), "tf", F.coalesce("df", "copies").alias("df"))
    whole = rows.join(few, "term", "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(numbers)).alias("x"))
    part = lambda c: F.transform("x", lambda e: e[c].cast("long"))
    return whole.select("doc_id", F.size("x").alias("words"), packed(part("n"), part("tf"), part("df")).alias("bag"))


def alike(once: DataFrame, documents: int, least: float, words: int = BLOCK_WORDS) -> DataFrame:
    """(a, b, cosine) for a < b of texts (doc_id, copies, w) whose cosine is at least `least`; exact. A term weighs tf / len times ln((N + 1) / (df + 1)) + 1.

    Texts are dealt to blocks of so many words, and two blocks meet in a task: a bag is sent once for each block, and neither pairs that may be alike nor their words are ever rows.
    """
    held = checkpointed(bags(once))
    session = once.sparkSession
    total = held.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    blocks = max(-(-total // words), math.isqrt(2 * session.sparkContext.defaultParallelism) + 1)
    own, other = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = held.select("doc_id", "bag", own.alias("own"), other.alias("other"))
    sent = sent.select("doc_id", "bag", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    kind = once.schema["doc_id"].dataType.simpleString()
    met = sent.repartition(blocks * (blocks + 1) // 2, "p", "q").groupBy("p", "q")
    return met.applyInPandas(lambda both: pairs(both, documents, least), f"a {kind}, b {kind}, cosine double")


class Block:
    """Texts in order of id: their terms and weights one after the other, with what is left of the length from the most frequent term up to each."""

    def __init__(self, rows: pd.DataFrame, documents: int):
        rows = rows.sort_values("doc_id")
        self.ids = rows["doc_id"].to_numpy()
        bags = [_unpacked(b) for b in rows["bag"]]
        self.sizes = np.array([(x[0] != OWN).sum() for x in bags], np.int64)
        self.begun = np.concatenate([[0], np.cumsum(self.sizes)])
        self.terms, self.u, self.rest = np.empty(self.begun[-1], np.int32), np.empty(self.begun[-1]), np.empty(self.begun[-1])
        for at, n, (terms, tf, df) in zip(self.begun, self.sizes, bags, strict=False):
            weight = tf / tf.sum() * (np.log((documents + 1) / (df + 1)) + 1)
            # Terms of its own count for its length, and come after all others.
            square, cut, shared = (weight * weight).sum(), slice(at, at + n), terms != OWN
            self.terms[cut], self.u[cut] = terms[shared], weight[shared] / np.sqrt(square)
            self.rest[cut] = np.sqrt(np.cumsum(self.u[cut] * self.u[cut]))

    def first(self, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, rest) of the rarer terms, one of which a text shares with every text alike."""
        rows = np.flatnonzero(self.rest >= least)
        return np.repeat(np.arange(len(self.ids)), self.sizes)[rows], self.terms[rows], self.rest[rows]


def _expanded(lo: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from each lo on, so many of them, one after the other."""
    return np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)


def pairs(both: pd.DataFrame, documents: int, least: float) -> pd.DataFrame:
    """(a, b, cosine) of the texts of two blocks (doc_id, bag, own, p, q), or of one with itself.

    With terms in order of rarity, the first term that two texts share leaves each of them so much length from there on that the product reaches the threshold: only such terms are met, and the
    texts that share one are then compared whole.
    """
    slack, p, q = 1e-9, both["p"].iloc[0], both["q"].iloc[0]
    one = Block(both[both["own"] == p], documents)
    two = one if p == q else Block(both[both["own"] == q], documents)
    text, term, rest = one.first(least - slack)
    other, key, left = two.first(least - slack)
    order = np.argsort(key, kind="stable")
    other, key, left = other[order], key[order], left[order]
    lo, hi = np.searchsorted(key, term, "left"), np.searchsorted(key, term, "right")
    full = np.zeros(int(max(one.terms.max(initial=0), two.terms.max(initial=0))) + 1)
    found = []
    ends = np.searchsorted(text, np.arange(len(one.ids) + 1))
    many = np.concatenate([[0], np.cumsum(hi - lo)])[ends]
    begin = 0
    while begin < len(one.ids):
        # So many texts at once as meet a bounded number of others, but one at least.
        end = max(begin + 1, int(np.searchsorted(many, many[begin] + MET, "right")) - 1)
        cut = slice(ends[begin], ends[end])
        count = hi[cut] - lo[cut]
        at = _expanded(lo[cut], count)
        a, b = np.repeat(text[cut], count), other[at]
        ok = np.repeat(rest[cut], count) * left[at] >= least - slack
        if p == q:
            ok &= a < b
        met = np.unique(a[ok] * np.int64(len(two.ids)) + b[ok])
        a, b = np.divmod(met, len(two.ids))
        for k, there in zip(*np.unique(a, return_index=True), strict=True):
            few = b[there : np.searchsorted(a, k, "right")]
            mine = slice(one.begun[k], one.begun[k + 1])
            full[one.terms[mine]] = one.u[mine]
            for some in np.array_split(few, max(1, two.sizes[few].sum() // MET)):
                rows = _expanded(two.begun[some], two.sizes[some])
                cosine = np.add.reduceat(full[two.terms[rows]] * two.u[rows], np.cumsum(two.sizes[some]) - two.sizes[some])
                good = np.flatnonzero(cosine >= least)
                if len(good):
                    found.append((np.full(len(good), k), some[good], cosine[good]))
            full[one.terms[mine]] = 0.0
        begin = end
    k, b, cosine = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    x, y = one.ids[k], two.ids[b]
    return pd.DataFrame({"a": np.where(x < y, x, y), "b": np.where(x < y, y, x), "cosine": cosine})
