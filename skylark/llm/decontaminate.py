"""Benchmark decontamination by greedy string tiling.

Documents and test items become words (lower case, letters and digits only). Seeds, runs of min_match words that a document
shares with an item, pick the pairs to compare: an equi-join of seed hashes. Each pair is tiled: the longest common run of words that are not yet covered
is marked in both, again and again, the runs being found by Karp-Rabin hashes of windows that shrink as no longer run is
left. Tiles may lie in any order, so that a reordered passage counts. A document whose tiles cover the given share of an item is contaminated.

Seeds, items and pairs are tables. A bit table of the items' seeds, of a fixed size, goes to the tasks that read the documents; only the
stretches of documents that it lets through are shuffled, equal texts once, and what it lets through by chance finds no partner in the join.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylark.llm.common import checkpointed, fresh, small_batches, unfold

#: Words of a seed, and the least length of a tile.
MIN_MATCH = 4
#: Share of an item's words that the tiles must cover.
COVERAGE = 0.5
#: Bits of the table of seeds, a power of two; the bound on what is sent to the tasks.
SEED_BITS = 1 << 24
#: Words whose hashes a worker remembers; then it starts afresh.
REMEMBERED = 200_000
TOKEN = re.compile(r"[^\W_]+")
#: Multiplier of seed hashes, modulo 2**64; a seed that is equal by chance only costs a comparison of words.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Windows of any length are hashed modulo this prime twice, with two multipliers and their inverses.
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_013)
#: Between two stretches of a document; no word holds it.
GAP = "|"


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def rolling(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of a few values, modulo 2**64."""
    if len(values) < length:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(values) - length + 1, np.uint64)
    for k in range(length):
        out = out * BASE + values[k : k + len(out)]
    return out


class KarpRabin:
    """Hashes of all windows of one length, for any length, from sums over the sequence's beginnings."""

    def __init__(self, codes: np.ndarray):
        self.parts = []
        for base in BASES:
            up, down = (_powers(b, len(codes) + 1) for b in (base, pow(base, -1, PRIME)))
            sums = np.concatenate([[0], np.cumsum(codes % np.uint64(PRIME) * down[: len(codes)] % np.uint64(PRIME))]).astype(np.uint64)
            self.parts.append((up, sums))

    def windows(self, length: int) -> np.ndarray:
        out = np.zeros(0, np.uint64)
        for up, sums in self.parts:
            if len(sums) <= length:
                return out
            part = (sums[length:] - sums[:-length]) % np.uint64(PRIME) * up[: len(sums) - length] % np.uint64(PRIME)
            out = part if not len(out) else out << np.uint64(31) | part
        return out


def _powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo the prime."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:n]


def tile(a: list, b: list, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (start in a, start in b, length): longest first, no word of either side twice, none under min_match.

    Among equally long tiles the first in a, then in b, is taken first. Equal hashes only propose: words decide, and a length at which no words agree
    is not tried again.
    """
    free_a, free_b, tiles = np.ones(len(a), bool), np.ones(len(b), bool), []
    codes: dict = {}
    ha, hb = (KarpRabin(np.array([codes.setdefault(w, len(codes) + 1) for w in x], np.uint64)) for x in (a, b))
    size = min(len(a), len(b))
    while (size := _longest_common(ha, hb, free_a, free_b, min_match, size)) >= min_match:
        spots = defaultdict(list)
        wb, wa = hb.windows(size), ha.windows(size)
        for j in _open(free_b, size).tolist():
            spots[int(wb[j])].append(j)
        before = len(tiles)
        for i in _open(free_a, size).tolist():
            for j in spots.get(int(wa[i]), ()):
                if free_a[i : i + size].all() and free_b[j : j + size].all() and a[i : i + size] == b[j : j + size]:
                    tiles.append((i, j, size))
                    free_a[i : i + size] = free_b[j : j + size] = False
                    break
        size -= len(tiles) == before
    return tiles


def _open(free: np.ndarray, n: int) -> np.ndarray:
    """Starts of windows of n free words."""
    sums = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(sums[n:] - sums[:-n] == n)


def _longest_common(ha: KarpRabin, hb: KarpRabin, free_a: np.ndarray, free_b: np.ndarray, low: int, high: int) -> int:
    """The longest length, from low to high, of windows of free words with equal hashes; below low if there is none."""

    def common(n: int) -> bool:
        return bool(np.isin(ha.windows(n)[_open(free_a, n)], hb.windows(n)[_open(free_b, n)]).any())

    if high < low or not common(low):
        return low - 1
    while low < high:  # a common run contains shorter ones
        mid = (low + high + 1) // 2
        low, high = (mid, high) if common(mid) else (low, mid - 1)
    return low


class Seeds:
    """The hashes of a text's seeds, with the hashes of the words met so far."""

    def __init__(self, min_match: int):
        self.min_match, self.known = min_match, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        codes = []
        for w in words:
            code = known.get(w)
            if code is None:
                code = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 11)
            codes.append(code)
        return rolling(np.array(codes, np.uint64), self.min_match)


def stretches(words: list[str], starts: list[int], length: int) -> str:
    """The words within the windows at these starts, with a gap between stretches that don't meet."""
    out, end = [], -1
    for i in starts:
        if i > end >= 0:
            out.append(GAP)
        out += words[max(i, end) : i + length]
        end = i + length
    return " ".join(out)


def covered(stretch: str, item: str, min_match: int) -> float:
    """Share of the item's words in tiles. Only words within seeds can be in a tile; each gap is a barrier that equals no word."""
    words, own = stretch.split(" "), item.split(" ")
    return sum(n for _, _, n in tile([k if w == GAP else w for k, w in enumerate(words)], own, min_match)) / len(own)


def seed_table(seeds: DataFrame, bits: int) -> np.ndarray:
    """Which of the given number of places some seed falls on; only the table reaches the driver."""
    place = F.col("seed").bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(31)).cast("int"))
    words = seeds.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
    table = np.zeros(max(1, bits // 32), np.uint32)
    table[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    return np.unpackbits(table.view(np.uint8), bitorder="little")[:bits].astype(bool) if len(words) else np.zeros(bits, bool)


def items_of(benchmark: DataFrame, min_match: int, text: str, item_id: str) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, words), each distinct sequence of words once with its least id, and (item, seed)."""

    @F.arrow_udf("string")
    def flat(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([" ".join(tokens(t)) for t in batch.to_pylist()], pa.string())

    @F.arrow_udf("array<long>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seeds = Seeds(min_match)
        for batch in batches:
            yield pa.array([np.unique(seeds(t.split(" "))).view(np.int64).tolist() for t in batch.to_pylist()], pa.list_(pa.int64()))

    once = benchmark.select(F.col(item_id).alias("item_id"), flat(F.col(text)).alias("words")).groupBy("words").agg(F.min("item_id").alias("item_id"))
    items = checkpointed(once.where(F.size(F.split("words", " ")) >= min_match).select(text_key(F.col("words")).alias("item"), "item_id", "words"))
    return items, checkpointed(items.select("item", F.explode(hashed(F.col("words"))).alias("seed")))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def coverage(docs: DataFrame, benchmark: DataFrame, min_match: int, text: str, item_text: str, item_id: str, bits: int) -> DataFrame:
    """(key, item_id, covered) for each distinct text of docs and each item that it shares a seed with; key: text_key."""
    items, seeds = items_of(benchmark, min_match, item_text, item_id)
    table = docs.sparkSession.sparkContext.broadcast(np.packbits(seed_table(seeds, bits)))

    @F.arrow_udf("stretch string, seeds array<long>")
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashed, known, low = Seeds(min_match), np.unpackbits(table.value).astype(bool), np.uint64(bits - 1)
        for batch in batches:
            found, seeds_of = [], []
            for t in batch.to_pylist():
                words = tokens(t)
                windows = hashed(words)
                at = np.flatnonzero(known[windows & low]) if len(windows) else windows
                found.append(stretches(words, at.tolist(), min_match) if len(at) else None)
                seeds_of.append(np.unique(windows[at]).view(np.int64).tolist() if len(at) else [])
            yield pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(seeds_of, pa.list_(pa.int64()))], ["stretch", "seeds"])

    @F.arrow_udf("double")
    def tiled(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array([covered(x, y, min_match) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    held = docs.where(F.col(text).isNotNull()).select(text_key(F.col(text)).alias("key"), hits(F.col(text)).alias("h")).where(F.col("h.stretch").isNotNull())
    held = checkpointed(held.groupBy("key").agg(F.any_value("h").alias("h")))
    pairs = held.select("key", F.explode("h.seeds").alias("seed")).join(seeds, "seed").select("key", "item").distinct()
    pairs = pairs.join(items, "item").join(held.select("key", F.col("h.stretch").alias("stretch")), "key")
    return pairs.select("key", "item_id", tiled(F.col("stretch"), F.col("words")).alias("covered"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = COVERAGE, text: str = "text", item_text: str = "text", item_id: str = "item_id", bits: int = SEED_BITS) -> DataFrame:
    """docs with coverage (of the most covered item), item_id (that item, the least of equals), n_items (items covered enough) and contaminated.

    Null and empty texts, and texts without a seed, have coverage 0, no item and are clean; items of fewer than min_match words match
    nothing. Equal items count once, by their least id, which keeps its type. These columns replace docs' columns of the same names; every row stays.
    """
    small_batches(docs.sparkSession)
    found = coverage(docs.select(text), benchmark, min_match, text, item_text, item_id, bits).where("covered > 0")
    first = F.min_by("item_id", F.struct(-F.col("covered"), F.col("item_id").isNull(), "item_id"))
    best = found.groupBy("key").agg(F.max("covered").alias("coverage"), first.alias("item_id"), F.count_if(F.col("covered") >= min_coverage).alias("n_items"))
    key, mine = fresh(docs, "_text_key"), fresh(docs, "_best")
    best = checkpointed(best).select(F.col("key").alias(key), F.struct("coverage", "item_id", "n_items").alias(mine))
    out = docs.withColumn(key, text_key(F.col(text))).join(best, key, "left").drop(key)
    none = F.struct(F.lit(0.0).alias("coverage"), F.lit(None).cast(benchmark.schema[item_id].dataType).alias("item_id"), F.lit(0).cast("long").alias("n_items"))
    out = out.withColumn(mine, F.coalesce(F.col(mine), none))
    out = out.withColumn("contaminated", F.col(f"{mine}.coverage") >= min_coverage)
    return unfold(out, mine, ["coverage", "item_id", "n_items"])
