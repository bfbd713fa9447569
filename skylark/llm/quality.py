"""Quality rules: text statistics, and a log-likelihood ratio between trusted documents and the raw corpus.

Each text becomes hashed counts of its byte n-grams. Two multinomials over the hash buckets, one of the trusted documents and one of all
documents, give each n-gram a log ratio; a document's mean ratio per n-gram is held against a fixed threshold. The counts are summed per task before they are
shuffled, and cover every document; the only thing sent to the tasks is one number a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylark.llm.common import fresh, small_batches, unfold

BUCKETS = 1 << 16
#: Lengths of the byte n-grams.
SIZES = (2, 4)
#: Mean log ratio (nats per n-gram) below which a document is rejected.
MIN_RATIO = -0.6
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
FIELDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "llr": pa.float64()}


def hashed(text: str | None, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every n-gram of the whole text."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out = []
    for n in sizes:
        if len(b) >= n:
            h = np.full(len(b) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ b[k : k + len(h)]) * np.uint32(0x01000193)
            out.append((h ^ (h >> np.uint32(15))) % np.uint32(buckets))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words within windows that occur twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    span = 1
    while span < window:  # numbers of runs of one, two, four, ... words
        step = min(span, window - span)
        pairs = ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        if 2 * span >= window:
            counts = np.unique(pairs, return_inverse=True, return_counts=True)
            twice = counts[2][counts[1]] > 1
            if not twice.any():
                return 0
            marks = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + window, -1)
            return int((np.cumsum(marks) > 0).sum())
        ids = np.unique(pairs, return_inverse=True)[1]
        span += step
    return 0


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            repeats += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), repeats, repeated_words(words)


#: Buckets of one row of partial counts.
BLOCK = 256
BLOCKS = "block int, counts array<bigint>"


def block_rows(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
    values = pa.array(np.concatenate([*totals.values(), np.zeros(0, np.int64)]))
    rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, BLOCK), pa.int32()), values)
    return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), rows], ["block", "counts"])


@dataclass
class Counts:
    """Counts of n-grams by bucket, summed over what a task reads: one row for each block of buckets that has any."""

    sizes: tuple[int, ...]
    buckets: int

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((-(-self.buckets // BLOCK), BLOCK), np.int64)
        flat = total.reshape(-1)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and len(t) > 4096:
                    flat += np.bincount(hashed(t, self.sizes, self.buckets), minlength=len(flat))
                elif t:
                    np.add.at(flat, hashed(t, self.sizes, self.buckets), 1)
        yield block_rows({k: total[k] for k in np.flatnonzero(total.any(1)).tolist()})


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each block; all rows of a block are in one partition, and one row per block is held."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).values.to_numpy(zero_copy_only=False).reshape(-1, BLOCK), strict=True):
            totals[k] = totals.get(k, 0) + counts
    yield block_rows(totals)


def bucket_counts(texts: DataFrame, text: str = "text", sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> np.ndarray:
    """Corpus counts of every bucket; as many numbers as buckets reach the driver, however large the corpus."""
    small_batches(texts.sparkSession)
    parts = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(Counts(sizes, buckets), BLOCKS)
    out = np.zeros((-(-buckets // BLOCK), BLOCK), np.int64)
    for r in parts.repartition("block").mapInArrow(summed, BLOCKS).collect():
        out[r.block] = r.counts
    return out.reshape(-1)[:buckets]


def log_ratio(trusted: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log P(bucket | trusted) - log P(bucket | raw), each count raised by the smoothing; 0 everywhere without trusted documents."""
    if not trusted.sum():
        return np.zeros(len(raw), np.float32)
    p, q = (np.log(c + smoothing) - np.log(c.sum() + smoothing * len(c)) for c in (trusted, raw))
    return (p - q).astype(np.float32)


def measured(text: Column, ratio: np.ndarray, sizes: tuple[int, ...] = SIZES) -> Column:
    """A struct of the statistics and llr, the mean log ratio (0 without n-grams)."""
    kind = ", ".join(f"{k} {'double' if v == pa.float64() else 'long'}" for k, v in FIELDS.items())

    @F.arrow_udf(kind)
    def rows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                at = hashed(t, sizes, len(ratio))
                out.append((*statistics(t), float(ratio[at].mean(dtype=np.float64)) if len(at) else 0.0))
            columns = list(zip(*out, strict=True)) or [()] * len(FIELDS)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, FIELDS.values(), strict=True)], list(FIELDS))

    return rows(text)


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Ids whose labels all say 1."""
    return labels.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(F.coalesce(F.col(quality), F.lit(0))).alias("_q")).where("_q = 1").select(doc_id)


#: Bits of the filter that spares most texts of unlabelled documents a shuffle; a bound on what is sent to the tasks.
FILTER_BITS = 1 << 23


def documents_of(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id", bits: int = FILTER_BITS) -> DataFrame:
    """The rows of docs whose id is in ids, an exact semi-join.

    A bit table of hashed ids, of a fixed size, first takes out most other rows where they are read, so their texts aren't shuffled; what passes by chance goes in
    the join.
    """
    place = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(bits))
    words = ids.select(place.alias("p")).groupBy(F.floor(F.col("p") / 32).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(32)).cast("int"))).alias("b")).collect()
    table = np.zeros(bits // 32, np.uint32)
    table[[r.w for r in words]] = [r.b for r in words]

    @F.arrow_udf("boolean")
    def maybe(places: pa.Array) -> pa.Array:
        p = places.to_numpy(zero_copy_only=False)
        return pa.array((table[p >> 5] >> (p & 31).astype(np.uint32) & 1).astype(bool))

    return docs.where(F.col(doc_id).isNotNull()).where(maybe(place)).join(ids.hint("merge"), doc_id, "left_semi")


def quality(docs: DataFrame, trusted: DataFrame, min_ratio: float = MIN_RATIO, text: str = "text", sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed and kept; trusted: documents (rows with the text column) of the target.

    base_failed: fewer than 20 words, or over 30% of the words in repeated 8-word windows. kept: not base_failed, and llr at least min_ratio. Null and empty texts
    have statistics 0, llr 0 and fail. Without trusted documents every llr is 0. Repeated rows count each time and get equal results. The new columns replace docs' columns
    of these names; every row stays.
    """
    small_batches(docs.sparkSession)
    ratio = log_ratio(bucket_counts(trusted, text, sizes, buckets), bucket_counts(docs, text, sizes, buckets))
    out = fresh(docs, "_quality")
    found = unfold(docs.withColumn(out, measured(F.col(text), ratio, sizes)), out, list(FIELDS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= min_ratio))
