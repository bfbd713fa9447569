"""Packed token matrices: whole documents become token ids, overlong ones are split without loss, and the pieces are packed
into rows of a fixed length by best-fit decreasing.

Each task packs the documents that it reads in blocks of a bounded number of tokens, so no row is shuffled and memory is bounded; a lost task
is done again from its input split with the same result. In a block, pieces go from the longest to the shortest into the fullest
row that still has room, found by a segment tree over the capacities.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylark.llm.common import small_batches
from skylark.llm.bpe import END_OF_TEXT, tokenizer, vocabulary_path

#: Tokens of a packed row.
ROW_TOKENS = 2048
#: Tokens that a task packs at a time.
BLOCK_TOKENS = 2_000_000
SCHEMA = "input_ids array<int>, cu_seqlens array<int>, doc_ids array<{}>, doc_starts array<bigint>, n_tokens int"


class Capacities:
    """Rows by free capacity, and a segment tree that finds the least capacity of at least n with a row."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = [False] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        at = self.size + capacity
        while at and not self.any[at]:
            self.any[at] = True
            at >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(capacity, row), the row that was put last, or None."""
        at, tree = self.size + n, self.any
        while not tree[at]:
            while at & 1:  # a right child: go up until there is a right sibling
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if tree[2 * at] else 2 * at + 1
        capacity = at - self.size
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            tree[at] = False
            while (at := at >> 1) and not (tree[2 * at] or tree[2 * at + 1]):
                tree[at] = False
        return capacity, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; equally long pieces keep their order. No length is over the capacity."""
    rows: list[list[int]] = []
    tree = Capacities(capacity)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.take(lengths[k])
        free, row = found or (capacity, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(k)
        if free > lengths[k]:
            tree.put(free - lengths[k], row)
    return rows


@dataclass
class Packer:
    path: str | None
    row_tokens: int
    block_tokens: int
    end: int | None

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary_path(self.path))
        held, ids, starts, size, kind = [], [], [], 0, pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                encoded = array("i", bpe.encode(text))
                if self.end is not None:
                    encoded.append(self.end)
                tokens = np.frombuffer(encoded, np.int32)
                for at in range(0, len(tokens), self.row_tokens):
                    held.append(tokens[at : at + self.row_tokens])
                    ids.append(doc)
                    starts.append(at)
                size += len(tokens)
                if size >= self.block_tokens:
                    yield from self.packed(held, ids, starts, kind)
                    held, ids, starts, size = [], [], [], 0
        yield from self.packed(held, ids, starts, kind)

    def packed(self, pieces: list[np.ndarray], ids: list, starts: list[int], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        rows = best_fit_decreasing([len(p) for p in pieces], self.row_tokens)
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            order = [k for row in part for k in row]
            lengths = np.array([len(pieces[k]) for k in order], np.int64)
            counts = np.array([len(row) for row in part])
            ends = np.concatenate([[0], np.cumsum(lengths)])
            bounds = np.concatenate([[0], np.cumsum(counts)])
            totals = ends[bounds[1:]] - ends[bounds[:-1]]
            cumulative = np.concatenate([ends[a : b + 1] - ends[a] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            lists = lambda values, offsets, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
            tokens = np.concatenate([[0], np.cumsum(totals)])
            yield pa.RecordBatch.from_arrays(
                [
                    lists(np.concatenate([pieces[k] for k in order]), tokens, pa.int32()),
                    lists(cumulative, np.concatenate([[0], np.cumsum(counts + 1)]), pa.int32()),
                    lists([ids[k] for k in order], bounds, kind),
                    lists([starts[k] for k in order], bounds, pa.int64()),
                    pa.array(totals, pa.int32()),
                ],
                ["input_ids", "cu_seqlens", "doc_ids", "doc_starts", "n_tokens"],
            )


def pack(docs: DataFrame, row_tokens: int = ROW_TOKENS, block_tokens: int = BLOCK_TOKENS, end: int | None = END_OF_TEXT, tokenizers: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Packed rows of docs: input_ids (at most row_tokens), cu_seqlens (0 and the end of each piece), position_ids (from 0 again in each piece),
    doc_ids and doc_starts (of each piece: its document and the first token's place in it) and n_tokens.

    A document's tokens are those of its whole text and the end token. Null and empty texts have none and are in no row. Repeated rows are packed each
    time; doc_ids have the type of the id column, and a null id is null there. Pieces that are cut from a document start anew at position 0; doc_starts puts them together again. No padding is written:
    n_tokens tells how much of row_tokens a row fills. An empty table gives an empty one; other columns are not read.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = narrow.mapInArrow(Packer(tokenizers, row_tokens, block_tokens, end), SCHEMA.format(docs.schema[doc_id].dataType.simpleString()))
    # Positions follow from the segments' lengths: they are counted on the JVM's side, so that only half of the numbers come from Python.
    lengths = F.transform(F.slice("cu_seqlens", F.lit(2), F.size("cu_seqlens") - 1), lambda e, k: e - F.get("cu_seqlens", k))
    positions = F.flatten(F.transform(lengths, lambda n: F.sequence(F.lit(0), n - 1)))
    return rows.select("input_ids", "cu_seqlens", positions.alias("position_ids"), "doc_ids", "doc_starts", "n_tokens")


def write_matrix(packed: DataFrame, folder: str, row_tokens: int = ROW_TOKENS, pad: int = END_OF_TEXT) -> None:
    """Binary form: one Parquet column per array, ids as one little-endian 16-bit string of the full row length where they fit (else 32-bit)."""

    @F.arrow_udf("binary")
    def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for ids in batch.to_pylist():
                row = np.full(row_tokens, pad, "<u4")
                row[: len(ids)] = ids
                out.append(row.astype("<u2" if row.max() < 1 << 16 else "<u4").tobytes())
            yield pa.array(out, pa.binary())

    packed.withColumn("input_ids", raw("input_ids")).write.mode("errorifexists").parquet(folder)
