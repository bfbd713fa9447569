"""Names in texts by an automaton over the names, which walks each text once where it is read: no word is shuffled.

The automaton is built in each worker from a list of patterns whose number the caller has checked.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns that are sent to the workers: names beyond so many are found by joins.
MOST_PATTERNS = 200_000
WORDS = regex.compile(r"[\p{L}\p{N}_]+")
#: Words are joined by two blanks and patterns have one at either end, so that neighbours don't share any.
BETWEEN = "  "
HITS = "array<struct<place:int,n:int,pattern:int>>"


def as_words(words: list[str]) -> str:
    return f" {BETWEEN.join(words)} "


@lru_cache(maxsize=4)
def automaton(held) -> ahocorasick.Automaton:
    """One per worker and broadcast list."""
    out = ahocorasick.Automaton()
    for k, p in enumerate(held.value):
        out.add_word(p, (k, len(p)))
    if len(out):
        out.make_automaton()
    return out


def leftmost_longest(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, end, pattern) those that are taken from left to right, of equal starts the longest, none within another."""
    out, end = [], 0
    for hit in sorted(hits, key=lambda h: (h[0], -h[1])):
        if hit[0] >= end:
            out.append(hit)
            end = hit[1]
    return out


def whole_words(text: str, names: ahocorasick.Automaton) -> list[dict]:
    """Names at whole words: place in words, length in words, pattern."""
    words = WORDS.findall(text)
    line = as_words(words)
    hits = leftmost_longest([(at + 1 - n, at + 1, k) for at, (k, n) in names.iter(line)])
    if not hits:
        return []
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + len(BETWEEN)
    return [{"place": bisect_left(starts, a), "n": line.count(BETWEEN, a, b) + 1, "pattern": k} for a, b, k in hits]


def substrings(text: str, names: ahocorasick.Automaton) -> list[dict]:
    """Each pattern that the text holds anywhere, once, with the place of its first character."""
    first: dict[int, tuple[int, int]] = {}
    for at, (k, n) in names.iter(text):
        first.setdefault(k, (at + 1 - n, n))
    return [{"place": a, "n": n, "pattern": k} for k, (a, n) in first.items()]


def hits(docs: DataFrame, text: Column, patterns: list[str], find=whole_words) -> DataFrame:
    """docs with hit (place, n, pattern: its number), a row for each; docs without hits have none."""
    held = docs.sparkSession.sparkContext.broadcast(patterns)
    kind = pa.list_(pa.struct([("place", pa.int32()), ("n", pa.int32()), ("pattern", pa.int32())]))

    @F.arrow_udf(HITS)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = automaton(held)
        for batch in batches:
            yield pa.array([find(t, names) if t and len(names) else [] for t in batch.to_pylist()], kind)

    return docs.withColumn("hit", F.explode(found(text)))


def held_by(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, name): distinct names (name) that texts (doc_id, text) hold anywhere, case aside. Names are few enough to be sent."""
    patterns = sorted({r.name for r in names.select(F.lower("name").alias("name")).where("name <> ''").distinct().limit(MOST_PATTERNS + 1).collect()})
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} names: find them in parts")
    found = hits(docs.where(F.col("text").isNotNull()).select("doc_id", F.lower("text").alias("_text")), F.col("_text"), patterns, substrings)
    number = F.array(*[F.lit(p) for p in patterns]) if len(patterns) < 1000 else None
    if number is not None:
        return found.select("doc_id", F.get(number, F.col("hit.pattern")).alias("name"))
    table = docs.sparkSession.createDataFrame(list(enumerate(patterns)), "pattern int, name string")
    return found.select("doc_id", F.col("hit.pattern").alias("pattern")).join(table, "pattern").select("doc_id", "name")
