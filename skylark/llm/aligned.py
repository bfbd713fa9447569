"""Alignment of two tokenizers over the same bytes: groups of tokens between common ends, and links between tokens that overlap.

Tokenizer A is a byte-level file of the tokenizers library, B a SentencePiece model with byte fallback. The spans of both are coarse cuts: A's character offsets, B's spans of the encoded text's proto. Where
a span is no whole number of characters (tokens within a character, byte-fallback pieces, the blank that B puts before a text) the tokens' decoded bytes refine it.

Texts are cut into chunks that no token of A or B crosses (`chunks`, proved for B's pieces when the model is read), so groups and links lie within chunks, and a worker aligns each different chunk
once. Each task gathers whole texts into blocks of bounded size; a block keeps its texts as chunk numbers, and lists its different id pairs once with their counts. Counts
over the corpus are sums over blocks; they return to the blocks by the pair, and so to the texts. No text and no single link is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skylark.llm.bpe import vocabulary_path
from skylark.llm.chunks import CHUNK, may_cut
from skylark.llm.common import checkpointed, fresh, small_batches
from skylark.llm.prefix_bpe import byte_alphabet

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a block's texts, and chunks that a worker remembers; a block ends where either is reached.
BLOCK_CHARS, REMEMBERED = 12_000_000, 600_000
#: Characters of texts that are cut before their new chunks are aligned, and chunks that are given to the tokenizers together.
PENDING_CHARS, TOGETHER = 2_000_000, 500
#: Links of a chunk that are given with it, and the block's table, in one row per block.
BLOCKS = "block bigint, doc_id {}, place bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, codes binary, pairs array<bigint>, counts array<bigint>, ends binary, links binary"
RESULT = "doc_id {}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
#: An id pair as one number: A's id times this, and B's.
RADIX = 1 << 24
#: What is put before a chunk for B: a line break is always a token, and never part of another.
GUARD = "\n"


def byte_ends(spans: list[tuple[int, int]], tokens: list[bytes]) -> list[int]:
    """Where each token ends, in bytes. spans: coarse byte spans by the library; tokens: decoded.

    A span is taken as it is where its length is that of the decoded token and it begins where the token before ended; the bytes decide elsewhere.
    """
    out, at = [], 0
    for (start, end), token in zip(spans, tokens, strict=True):
        n = len(token)
        at = end if start == at and end - start == n else at + n
        out.append(at)
    return out


def grouped(ids_a: list[int], ends_a: list[int], ids_b: list[int], ends_b: list[int]) -> tuple[str, int, list[int]]:
    """The groups `a1,a2|b1;a3|b2,b3`, how many, and the linked id pairs, one for each two tokens that overlap. Both end at the same byte."""
    groups, links, i, j, first, other = [], [], 0, 0, 0, 0
    while i < len(ids_a):
        links.append(ids_a[i] * RADIX + ids_b[j])
        end_a, end_b = ends_a[i], ends_b[j]
        if end_a == end_b:
            i, j = i + 1, j + 1
            if i - first == j - other == 1:
                groups.append(f"{ids_a[first]}|{ids_b[other]}")
            else:
                groups.append(",".join(map(str, ids_a[first:i])) + "|" + ",".join(map(str, ids_b[other:j])))
            first, other = i, j
        elif end_a < end_b:
            i += 1
        else:
            j += 1
    return ";".join(groups), len(groups), links


class Aligner:
    """Aligns chunks by two vocabulary files. A chunk's result: (groups, tokens of A, of B, groups, links), or None where a tokenizer's bytes aren't the chunk's."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        byte_of = byte_alphabet()
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes_a = {k: bytes(byte_of[c] for c in token) for token, k in vocabulary.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = range(self.b.get_piece_size())
        self.bytes_b = [bytes([int(self.b.id_to_piece(k)[1:-1], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode() for k in pieces]
        plain = [self.bytes_b[k].decode() for k in pieces if not (self.b.is_byte(k) or self.b.is_control(k) or self.b.is_unknown(k))]
        #: Without this proof a text is one chunk.
        self.cuts = may_cut(plain) and not any(GUARD in p for p in plain)

    def chunks(self, text: str) -> list[str]:
        """The parts of the blank and the text."""
        return CHUNK.findall(" " + text) if self.cuts else [" " + text]

    def tokens_a(self, chunks: list[str]) -> Iterator[tuple[list[int], list[tuple[int, int]]]]:
        """Ids and byte spans of each chunk. Chunks are given together, as words that are cut already."""
        found = self.a.encode(chunks, is_pretokenized=True, add_special_tokens=False)
        ids, offsets, ends = found.ids, found.offsets, np.searchsorted(found.word_ids, np.arange(len(chunks)), "right").tolist()
        for chunk, start, end in zip(chunks, [0, *ends], ends, strict=False):
            spans = offsets[start:end]
            if not chunk.isascii():
                at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in chunk])]).tolist()
                spans = [(at[s], at[e]) for s, e in spans]
            yield ids[start:end], spans

    def tokens_b(self, chunks: list[str]) -> Iterator[tuple[list[int], list[tuple[int, int]]]]:
        """Ids and byte spans of each chunk. Before each chunk the model is given a line break, so that the blank it adds is no part of a chunk, and chunks stay apart."""
        if not self.cuts:
            for found in self.b.encode([c[1:] for c in chunks], return_type="proto", num_threads=1):
                yield [p.id for p in found.pieces], [(p.begin + (k > 0), p.end + 1) for k, p in enumerate(found.pieces)]
            return
        tokens = [(p.id, p.begin, p.end) for p in self.b.encode("".join([GUARD + c for c in chunks]), return_type="proto", num_threads=1).pieces]
        at, start = 0, 1  # the model's own blank
        for chunk in chunks:
            at += len(GUARD)
            start += 1
            size = len(chunk) if chunk.isascii() else len(chunk.encode())
            end = start
            while end < len(tokens) and tokens[end][2] <= at + size and (tokens[end][1] < at + size or tokens[end][2] == tokens[end][1]):
                end += 1
            part = tokens[start:end]
            yield [t[0] for t in part], [(t[1] - at, t[2] - at) for t in part]
            at, start = at + size, end

    def align(self, chunks: list[str]) -> Iterator[tuple[str, int, int, int, list[int]] | None]:
        for at in range(0, len(chunks), TOGETHER):
            part = chunks[at : at + TOGETHER]
            for chunk, (ids_a, spans_a), (ids_b, spans_b) in zip(part, self.tokens_a(part), self.tokens_b(part), strict=True):
                raw_a, raw_b, raw = [self.bytes_a[k] for k in ids_a], [self.bytes_b[k] for k in ids_b], chunk.encode()
                if b"".join(raw_a) != raw or b"".join(raw_b) != raw:
                    yield None
                elif len(ids_a) == len(ids_b) == 1:
                    yield f"{ids_a[0]}|{ids_b[0]}", 1, 1, 1, [ids_a[0] * RADIX + ids_b[0]]
                else:
                    groups, n, links = grouped(ids_a, byte_ends(spans_a, raw_a), ids_b, byte_ends(spans_b, raw_b))
                    yield groups, len(ids_a), len(ids_b), n, links


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker and pair of files."""
    return Aligner(path_a, path_b)


class Chunks:
    """Numbered chunks and what was found of each; number 0 is a chunk that can't be aligned."""

    def __init__(self, by: Aligner):
        self.by, self.number, self.groups, self.sizes, self.links = by, {}, [""], array("q", [0] * 4), [b""]

    def learn(self, new: list[str]) -> None:
        for chunk, found in zip(new, self.by.align(new), strict=True):
            if found is None:
                self.number[chunk] = 0
                continue
            self.number[chunk] = len(self.groups)
            self.groups.append(found[0])
            self.sizes.extend((*found[1:4], len(found[4])))
            self.links.append(array("q", found[4]).tobytes())

    def numbers(self, texts: list[list[str]]) -> list[list[int]]:
        """The numbers of each text's chunks; those that are new are aligned together."""
        get, found = self.number.get, [list(map(self.number.get, parts)) for parts in texts]
        new = {c for parts, ks in zip(texts, found, strict=True) if None in ks for c, k in zip(parts, ks, strict=True) if k is None}
        if new:
            self.learn(list(new))
        return [list(map(get, parts)) if None in ks else ks for parts, ks in zip(texts, found, strict=True)]


def summed(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts, of which some may be empty. ends: where each part ends."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.concatenate([[0], ends])])


class Blocks:
    """One task's texts as blocks: a row for each text, and one more with the block's table (doc_id null, place -1)."""

    def __init__(self, files: tuple[str | None, str, str], block_chars: int, remembered: int):
        self.files, self.block_chars, self.remembered = files, block_chars, remembered

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, a, b = self.files
        self.chunks = Chunks(aligner(vocabulary_path(folder, a), vocabulary_path(folder, b)))
        self.kind, self.block = pa.int64(), TaskContext.get().partitionId() << 32
        ids, held, pending, chars, waiting = [], ([], []), [], 0, 0
        for batch in batches:
            self.kind = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                pending.append(self.chunks.by.chunks(text) if text else [])
                waiting += len(text or "")
                if waiting < PENDING_CHARS and waiting + chars < self.block_chars:
                    continue
                self.taken(pending, *held)
                chars, waiting, pending = chars + waiting, 0, []
                if chars >= self.block_chars or len(self.chunks.groups) >= self.remembered:
                    yield from self.ended(ids, *held)
                    ids, held, chars = [], ([], []), 0
        if ids:
            self.taken(pending, *held)
            yield from self.ended(ids, *held)

    def taken(self, texts: list[list[str]], shas: list[str], codes: list[np.ndarray]) -> None:
        """Adds the digest of each text's groups and the numbers of its chunks, none if it can't be aligned."""
        for found in self.chunks.numbers(texts):
            if not found or 0 in found:
                shas.append("")
                codes.append(np.zeros(0, np.int32))
            else:
                shas.append(hashlib.sha256(";".join(map(self.chunks.groups.__getitem__, found)).encode()).hexdigest())
                codes.append(np.array(found, np.int32))

    def ended(self, ids: list, shas: list[str], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The block's rows."""
        ends = np.cumsum([len(c) for c in codes])
        used, local, times = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        sizes = np.frombuffer(self.chunks.sizes, np.int64).reshape(-1, 4)[used]
        sums = [summed(sizes[local, c], ends) for c in range(4)]
        flat = np.frombuffer(b"".join([self.chunks.links[k] for k in used.tolist()]), np.int64)
        pairs, place = np.unique(flat, return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, place, np.repeat(times, sizes[:, 3]))
        local = local.astype("<i4")
        starts = np.concatenate([[0], ends])
        step = max(1, len(ids) * 4_000_000 // max(1, len(local)))  # rows of about 16 MB at most, or one
        for at in range(0, len(ids), step):
            to = min(len(ids), at + step)
            own = [local[starts[k] : starts[k + 1]].tobytes() for k in range(at, to)]
            yield self.rows(pa.array(ids[at:to], self.kind), np.arange(at, to), [s[at:to] for s in sums], shas[at:to], own, None)
        table = ([pairs], [counts], [np.cumsum(sizes[:, 3]).astype("<i8").tobytes()], [place.astype("<i4").tobytes()])
        yield self.rows(pa.nulls(1, self.kind), [-1], [[0]] * 4, [""], [b""], table)
        self.block += 1
        if len(self.chunks.groups) >= self.remembered:
            self.chunks = Chunks(self.chunks.by)

    def rows(self, ids: pa.Array, places, sums: list, shas: list[str], codes: list[bytes], table: tuple | None) -> pa.RecordBatch:
        n, long = len(ids), pa.list_(pa.int64())
        last = [pa.array(x, k) if table else pa.nulls(n, k) for x, k in zip(table or [None] * 4, (long, long, pa.binary(), pa.binary()), strict=True)]
        columns = [pa.array([self.block] * n, pa.int64()), ids, pa.array(places, pa.int64()), *[pa.array(s, pa.int64()) for s in sums], pa.array(shas, pa.string()), pa.array(codes, pa.binary()), *last]
        return pa.RecordBatch.from_arrays(columns, ["block", "doc_id", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "pairs", "counts", "ends", "links"])


def returned(block: pa.Table, counted: pa.Table) -> pa.Table:
    """A block's texts with n_best and count_sum. counted: (place, n, best) of the block's pairs."""
    places = np.array(block.column("place"))
    table = block.slice(int(np.flatnonzero(places == -1)[0]), 1)
    ends, links = (np.frombuffer(table.column(c)[0].as_py(), k) for c, k in (("ends", "<i8"), ("links", "<i4")))
    pair = np.zeros((2, counted.num_rows), np.int64)
    pair[:, np.array(counted.column("place"))] = np.array(counted.column("best")).astype(np.int64), np.array(counted.column("n"))
    chunk = [summed(x[links], ends) for x in pair]
    texts = block.filter(pa.array(places >= 0))
    codes = [np.frombuffer(c, "<i4") for c in texts.column("codes").to_pylist()]
    flat, bounds = np.concatenate([*codes, np.zeros(0, np.int32)]).astype(np.int64), np.cumsum([len(c) for c in codes])
    best, total = (summed(x[flat], bounds) for x in chunk)
    kept = [texts.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*kept, pa.array(best), pa.array(total), texts.column("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def alignment_blocks(docs: DataFrame, tokenizers: str | None, a: str, b: str, text: str, doc_id: str, block_chars: int, remembered: int) -> DataFrame:
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return checkpointed(narrow.mapInArrow(Blocks((tokenizers, a, b), block_chars, remembered), BLOCKS.format(kind)))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold each id pair, and whether no pair of the same id of B is linked more often. Ids of B are no more than its vocabulary."""
    sums = blocks.where("place = -1").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    sums = checkpointed(sums)
    most = sums.groupBy((F.col("pair") % RADIX).alias("b")).agg(F.max("n").alias("most"))
    return sums.join(F.broadcast(most), F.col("pair") % RADIX == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, tokenizers: str | None = None, a: str = VOCABULARY_A, b: str = VOCABULARY_B, text: str = "text", doc_id: str = "doc_id", block_chars: int = BLOCK_CHARS, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row for each of docs.

    A reads a blank and the text, B the text, to which it adds the blank; special tokens' strings are plain text. Groups lie between bytes where tokens of both end. A link is a token of A and one of B whose bytes overlap; the
    count of its id pair is how many links of all docs have that pair; n_best counts links whose pair is the most frequent of its id of B, ties included; count_sum adds up the counts. groups_sha256 is
    the digest of `a1,a2|b1;a3|b2,b3`. Texts that are null, empty or not reproduced by the bytes of A or B have no tokens: zeros and an empty digest.
    Repeated rows count each time; ids keep their type, and a null id stays null; other columns are not read; an empty table gives an empty one.
    """
    blocks = alignment_blocks(docs, tokenizers, a, b, text, doc_id, block_chars, remembered)
    back = blocks.where("place = -1").select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair")).join(pair_counts(blocks), "pair").select("of", "place", "n", "best")
    kind = docs.schema[doc_id].dataType.simpleString()
    return blocks.drop("pairs", "counts").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(returned, RESULT.format(kind))


def groups(docs: DataFrame, tokenizers: str | None = None, a: str = VOCABULARY_A, b: str = VOCABULARY_B, text: str = "text") -> DataFrame:
    """docs with groups (array of (a: ids of A, b: ids of B)), the alignment itself, which replaces a column of that name; null where a text can't be aligned, empty for null and empty texts."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<struct<a:array<int>,b:array<int>>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by = aligner(vocabulary_path(tokenizers, a), vocabulary_path(tokenizers, b))
        side = pa.list_(pa.int32())
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                parts = list(by.align(by.chunks(text))) if text else []
                whole = None if None in parts else [g.split("|") for p in parts for g in p[0].split(";")]
                out.append(whole if whole is None else [{k: [int(x) for x in ids.split(",")] for k, ids in zip("ab", g, strict=True)} for g in whole])
            yield pa.array(out, pa.list_(pa.struct([("a", side), ("b", side)])))

    name = fresh(docs, "_groups")
    return docs.withColumn(name, found(F.col(text).cast("string"))).drop(*[c for c in docs.columns if c.lower() == "groups"]).withColumnRenamed(name, "groups")
