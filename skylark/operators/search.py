"""Phrase and boolean search over a positional index, ranked by BM25.

The index is a table of postings (term, doc_id, len, positions) in folders by the term's bucket: a search reads the folders of its terms only, and of these the row groups that may hold them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
WORD = "[a-z]+"
#: Texts that a worker holds as Python objects.
TEXTS_AT_ONCE = 32
PLACES = pa.list_(pa.struct([("term", pa.string()), ("positions", pa.list_(pa.int32()))]))
Phrase = tuple[str, ...]


@dataclass(frozen=True)
class Search:
    """Texts that hold, for each of all_of, any of its phrases, and none of none_of. A phrase is one or more words in a row, in lower case."""

    all_of: tuple[tuple[Phrase, ...], ...]
    none_of: tuple[Phrase, ...] = ()

    def wanted(self) -> list[Phrase]:
        return list(dict.fromkeys(p for group in self.all_of for p in group))

    def phrases(self) -> list[Phrase]:
        return list(dict.fromkeys([*self.wanted(), *self.none_of]))


def places(batch: pa.Array) -> pa.Array:
    """Of each list of words its different words with their places. A batch may hold thousands of texts; few of them are Python objects at a time."""
    done = []
    for start in range(0, len(batch), TEXTS_AT_ONCE):
        out = []
        for words in batch.slice(start, TEXTS_AT_ONCE).to_pylist():
            at: dict[str, list[int]] = {}
            for k, w in enumerate(words or ()):
                at.setdefault(w, []).append(k)
            out.append([{"term": w, "positions": p} for w, p in at.items()])
        done.append(pa.array(out, PLACES))
    return pa.concat_arrays(done) if done else pa.array([], PLACES)


def postings(docs: DataFrame, word: str = WORD) -> DataFrame:
    """(doc_id, len, term, positions): where each word of the lower-cased texts (doc_id, text) is, counted from 0."""

    @F.arrow_udf("array<struct<term:string,positions:array<int>>>")
    def placed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return map(places, batches)

    words = docs.where(F.col("text").isNotNull()).select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(0)).alias("w"))
    return words.select("doc_id", F.size("w").alias("len"), F.inline(placed("w")))


def bucket_of(term: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(term.encode()) % buckets


def write_index(docs: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Writes postings by bucket, sorted by term, and the texts' number and mean length beside them. Ranges of (bucket, term, doc_id) are tasks, so that a common word is spread over many."""
    rows = postings(docs).withColumn("bucket", (F.crc32(F.encode("term", "UTF-8")) % buckets).cast("int"))
    order = ["bucket", "term", "doc_id"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{folder}/postings")
    words = F.regexp_count(F.lower("text"), F.lit(WORD))
    docs.where(F.col("text").isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(words).alias("mean")).write.parquet(f"{folder}/figures")


def moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


def found(spark: SparkSession, folder: str, search: Search, k1: float = 1.2, b: float = 0.75, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, score): the texts that fulfil the search. A phrase counts as a unit: how often it occurs in a text, and in how many texts."""
    terms = sorted({w for p in search.phrases() for w in p})
    kept = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(sorted({bucket_of(t, buckets) for t in terms})) & F.col("term").isin(terms))
    n, mean = spark.read.parquet(f"{folder}/figures").first()
    of = lambda t: F.max(F.when(F.col("term") == t, F.col("positions")))
    docs = kept.groupBy("doc_id", "len").agg(*[of(t).alias(f"_{k}") for k, t in enumerate(terms)])
    place = {t: F.col(f"_{k}") for k, t in enumerate(terms)}

    def times(phrase: Phrase) -> Column:
        """How often the phrase is there: its words' positions, each moved to where the phrase begins, intersected."""
        starts = place[phrase[0]]
        for k, w in enumerate(phrase[1:], 1):
            starts = F.array_intersect(starts, moved(place[w], k))
        return F.greatest(F.coalesce(F.size(starts), F.lit(0)), F.lit(0))

    number = {p: f"_n{k}" for k, p in enumerate(search.phrases())}
    hits = docs.select("doc_id", "len", *[times(p).alias(c) for p, c in number.items()])
    wanted = search.wanted()
    df = hits.agg(*[F.count_if(F.col(number[p]) > 0).alias(f"_d{k}") for k, p in enumerate(wanted)])
    fits = F.lit(True)
    for group in search.all_of:
        any_of = F.lit(False)
        for p in group:
            any_of |= F.col(number[p]) > 0
        fits &= any_of
    for p in search.none_of:
        fits &= F.col(number[p]) == 0
    score = F.lit(0.0)
    for k, p in enumerate(wanted):
        idf, tf = F.log(1 + (F.lit(n) - F.col(f"_d{k}") + 0.5) / (F.col(f"_d{k}") + 0.5)), F.col(number[p])
        score += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.lit(float(mean or 1))))
    return hits.where(fits).crossJoin(F.broadcast(df)).select("doc_id", score.alias("score"))  # df is one row
