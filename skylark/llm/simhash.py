"""SimHash near-duplicates: fingerprints, exact links within a few bits, and the groups that links join.

Links are found by a segment-popcount embedding. A fingerprint of 64 bits becomes the vector of its segments' bit
counts; two fingerprints that differ in d bits lie within Manhattan distance d of each other there. Each distinct
fingerprint goes to all grid cells within half the distance of its vector, so that any two vectors within the distance meet
in a cell (half way between them); candidates of a cell are kept if the vectors are close enough, then verified by
the bits themselves.

A cell which holds very many fingerprints (a large group of near copies) isn't paired off: its fingerprints go to
all 64-bit values within one bit, and those that share such a value get a link to its smallest fingerprint. Two
fingerprints share one exactly if they differ in two bits or less, so no connection is lost and none is invented, and
the work stays in proportion to the number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylark.llm.common import checkpointed, fresh, small_batches
from skylark.operators.graph import components

BITS = 64
#: Bits of a segment of the embedding.
SEGMENT_BITS = 4
#: Fingerprints of a cell from which on links go through shared one-bit neighbours instead of pairs.
DENSE_CELL = 24

BYTE_AT = (256 * np.arange(8)).astype(np.uint16)
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 8).astype(np.int64)


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the whole text as an unsigned number; 0 if there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
    starts = [0, *ends]
    if len(words) <= shingle:
        values = np.array([hashed(line, seed)], np.uint64)
    else:
        values = np.fromiter((hashed(line[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)), np.uint64, len(words) - shingle + 1)
    # A histogram of each of the eight bytes tells how often each bit is set.
    seen = np.bincount((values.astype(">u8").view(np.uint8).reshape(-1, 8) + BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits(2 * (seen @ BITS_OF_BYTE).ravel() > len(values)).tobytes(), "big")


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """SimHash of a text column as a long with the same bits."""

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint_of(t, shingle, seed) for t in batch.to_pylist()], np.uint64).view(np.int64))

    return simhash(text)


def hex_digits(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def segment_counts(fp: Column) -> Column:
    """The embedding: bit counts of the 16 segments of four bits, each in the segment's own four bits of a long."""

    bits = [F.shiftrightunsigned(fp, k).bitwiseAND(F.lit(0x1111111111111111)) for k in range(SEGMENT_BITS)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def ball(vec: Column) -> Column:
    """The vector and those of the grid at distance one, as an array."""
    segments = F.sequence(F.lit(0), F.lit(4 * (BITS // SEGMENT_BITS - 1)), F.lit(4))
    count = lambda at: F.call_function("shiftrightunsigned", vec, at).bitwiseAND(F.lit(15))
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at)
    more = F.transform(F.filter(segments, lambda at: count(at) < SEGMENT_BITS), lambda at: vec + one(at))
    less = F.transform(F.filter(segments, lambda at: count(at) > 0), lambda at: vec - one(at))
    return F.concat(F.array(vec), more, less)


def manhattan(a: Column, b: Column, segments: int = BITS // SEGMENT_BITS) -> Column:
    """Distance of two packed vectors."""
    distance = F.lit(0).cast("long")
    for k in range(segments):
        x, y = (F.shiftrightunsigned(v, 4 * k).bitwiseAND(F.lit(15)) for v in (a, b))
        distance = distance + F.abs(x - y)
    return distance


def links(fps: DataFrame, max_bits: int = 2, dense: int = DENSE_CELL) -> DataFrame:
    """(a, b) with a < b: links between distinct fingerprints fp of fps whose transitive closure is that of all pairs
    within max_bits (0 to 2) bits. Every row is a true link; pairs in crowded cells are joined through shared ones.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    # Two vectors at distance two or less share a vector of their balls of radius one.
    cells = fps.select("fp", segment_counts(F.col("fp")).alias("vec")).select("fp", "vec", F.explode(ball(F.col("vec"))).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    inside = checkpointed(cells.join(sizes, "cell"))
    few = inside.where(F.col("n") <= dense).select("cell", "fp", "vec")
    left, right = (few.select("cell", F.col("fp").alias(x), F.col("vec").alias(f"v{x}")) for x in "ab")
    pairs = left.join(right, "cell").where("a < b").where(manhattan(F.col("va"), F.col("vb")) <= max_bits).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")

    many = inside.where(F.col("n") > dense).select("fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(BITS)])
    near = many.select("fp", F.explode(near).alias("key"))
    if max_bits == 2:
        stars = near.join(near.groupBy("key").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "key").where("a < fp").select("a", F.col("fp").alias("b"))
    else:
        stars = near.join(many.select(F.col("fp").alias("key")), "key").where("key < fp").select(F.col("key").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def _fingerprints(docs: DataFrame, text: str, doc_id: str, shingle: int, seed: int) -> DataFrame:
    small_batches(docs.sparkSession)
    return checkpointed(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle, seed).alias("fp")))


def _groups(held: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component, component_id) of every fingerprint: component is the group's least fingerprint."""
    fps = held.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    joined = components(links(checkpointed(fps.select("fp")), max_bits)).withColumnRenamed("node", "fp")
    named = fps.join(joined, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    first = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return named.select("fp", "component").join(first, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs: its fingerprint and the smallest id of its group.

    Null and empty texts have fingerprint 0, which links like any other. Repeated rows are returned each time. A null id
    is returned as null and never names a group that has another id; a group of null ids only has component_id null.
    Other columns of docs are not read. An empty table gives an empty one.
    """
    held = _fingerprints(docs, text, doc_id, shingle, seed)
    return held.join(_groups(held, max_bits), "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """docs, but of each near-duplicate group only one row, with all its columns: that of the smallest id.

    Of rows that share this id and group (repeated rows), one stays, by the least text. Rows of null id stay only if the
    group has no other id, and then one of them. Null and empty texts form a group.
    """
    held = _fingerprints(docs, text, doc_id, shingle, seed)
    groups = checkpointed(_groups(held, max_bits))
    if not held.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        keep = held.join(groups, "fp").where("doc_id = component_id").select(F.col("doc_id").alias(doc_id))
        return docs.join(keep, doc_id, "left_semi").select(docs.columns)
    # Ids are repeated or null: rows are told apart by their groups; each input partition first settles its own.
    fp, group, first, part, nth = (fresh(docs, f"_{x}") for x in ("fp", "group", "first", "part", "nth"))
    marked = docs.withColumns({fp: fingerprint(F.col(text), shingle, seed), part: F.spark_partition_id()})
    marked = marked.join(groups.select(F.col("fp").alias(fp), F.col("component").alias(group), F.col("component_id").alias(first)), fp)
    marked = marked.where(F.col(doc_id).eqNullSafe(F.col(first)))
    for keys in ([group, part], [group]):
        marked = marked.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(text)))).where(F.col(nth) == 1).drop(nth)
    return marked.select(docs.columns)
