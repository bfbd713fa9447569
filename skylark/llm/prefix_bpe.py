"""Byte-level BPE, encoded exactly by dynamic programming over prefixes.

Every prefix of a piece has one encoding, so one last token. An automaton over the vocabulary gives all tokens that are suffixes of a prefix; the last token is the one which
covers the whole prefix or may stand after the last token of what it leaves. Following these back from the end gives the ids. Two tokens may stand side by side if encoding their joined bytes
gives them back: undoing the merges of both shows all pairs of parts that ever touch, and none of these may have been merged before its parts were used up otherwise.

Work is linear in a piece. The pieces of the byte-level pattern are found within chunks of a text (`chunks`), whose ids a worker remembers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skylark.llm.bpe import vocabulary_path
from skylark.llm.chunks import CHUNK
from skylark.llm.common import fresh, small_batches, unfold

VOCABULARY = "byte_bpe_50k.json"
#: Chunks, and pairs of tokens, that a worker remembers; then it starts afresh. Longer chunks aren't remembered.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 64
#: Fixed value: the pattern over kinds of characters (see `Kinds`).
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
NEVER = float("inf")


def byte_alphabet() -> dict[str, int]:
    """Bytes by the characters that stand for them in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Kinds(dict):
    """For str.translate: ASCII stays, other letters become Q, other numbers 0, other white space a tab, anything else '!'. The kind of a character is
    what the tokenizer's own rule does with it, asked once for each, so that both know the same Unicode."""

    def __init__(self, splitter):
        super().__init__({k: k for k in range(128)} | {k: ord("!") for k in (0x1C, 0x1D, 0x1E, 0x1F)})
        self.splitter = splitter

    def __missing__(self, code: int) -> int:
        alone = lambda before: len(self.splitter.pre_tokenize_str(before + chr(code))) > 1
        self[code] = kind = ord("Q" if not alone("a") else "0" if not alone("1") else "!" if not alone("!") else "\t")
        return kind


class Remembered(dict):
    """A bounded memory of a function's results; long texts aren't kept."""

    def __init__(self, make, most: int = REMEMBERED, longest: int = REMEMBERED_LENGTH):
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = found
        return found


class PrefixBpe:
    """Ids of a vocabulary file of the tokenizers library: byte-level BPE with its pattern and special tokens, without normalizer or added prefix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_alphabet()
        raw = lambda token: bytes(byte_of[c] for c in token)
        ids = {raw(token): k for token, k in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.token: list[bytes] = [b""] * size
        for b, k in ids.items():
            self.token[k] = b
        for text, k in self.special.items():
            self.token[k] = text.encode()
        # Spines: the parts of a token at its right or left end, each with the rank of the merge that uses it up.
        self.start = size
        self.right = [[(k, NEVER)] for k in range(size + 1)]
        self.left = [[(k, NEVER)] for k in range(size)]
        self.rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (ids[raw(part)] for part in (merge.split(" ") if isinstance(merge, str) else merge))
            made = ids[self.token[a] + self.token[b]]
            self.rank[a, b] = rank
            self.right[made] += [(b, rank), *self.right[b][1:]]
            self.left[made] += [(a, rank), *self.left[a][1:]]
        self.automaton = ahocorasick.Automaton()
        for b, k in ids.items():
            self.automaton.add_word(b.decode("latin-1"), (k, len(b)))
        self.automaton.make_automaton()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kinds = Kinds(Tokenizer.from_file(path).pre_tokenizer)
        self.compatible = Remembered(lambda pair: self.may_follow(*pair), 4 * REMEMBERED)
        self.known = Remembered(self.chunk_ids)

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the two tokens' joined bytes are encoded as these two. Of merges of equal rank the left one comes first."""
        rank = self.rank
        for x, used_x in self.right[a]:
            for y, used_y in self.left[b]:
                merged = rank.get((x, y))
                if merged is not None and merged < used_x and merged <= used_y:
                    return False
        return True

    def piece_ids(self, piece: bytes) -> list[int]:
        """The ids of one piece of the pattern. Before its first byte stands the start, which any token may follow."""
        last, compatible, done = [0] * len(piece) + [self.start], self.compatible, -1
        for at, (k, length) in self.automaton.iter(piece.decode("latin-1")):
            if at != done and compatible[last[at - length], k]:
                last[at], done = k, at
        out, at = [], len(piece) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(self.token[last[at]])
        return out[::-1]

    def chunk_ids(self, chunk: str) -> bytes:
        """The ids of a chunk, as little-endian unsigned 32-bit integers."""
        if chunk.isascii() and (chunk.isalpha() or chunk[0] == " " and chunk[1:].isalpha()):
            ids = self.piece_ids(chunk.encode())
        else:
            ids = []
            for m in PIECE.finditer(chunk.translate(self.kinds)):
                ids += self.piece_ids(chunk[m.start() : m.end()].encode())
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of the whole text, special tokens' strings as special tokens, as little-endian unsigned 32-bit integers."""
        known, out = self.known.__getitem__, []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += map(known, CHUNK.findall(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def prefix_bpe(path: str) -> PrefixBpe:
    """One per worker and file."""
    return PrefixBpe(path)


def decoded(ids: Column, tokenizers: str | None = None) -> Column:
    """The text of ids as `encode` returns them; null stays null."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = prefix_bpe(vocabulary_path(tokenizers, VOCABULARY))
        for batch in batches:
            yield pa.array([None if b is None else bpe.decode(b) for b in batch.to_pylist()], pa.string())

    return texts(ids)


def encode(docs: DataFrame, tokenizers: str | None = None, text: str = "text") -> DataFrame:
    """docs with ids (little-endian unsigned 32-bit integers, as binary) and n_tokens; these replace columns of the same names.

    The whole text is encoded, of any length and in time linear in it. Null texts are encoded as empty ones: no ids, 0 tokens. Repeated rows get equal results; other columns are not looked at; an
    empty table gives an empty one.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = prefix_bpe(vocabulary_path(tokenizers, VOCABULARY))
        for batch in batches:
            yield pa.array([bpe.encode(t or "") for t in batch.to_pylist()], pa.binary())

    out = fresh(docs, "_ids")
    found = docs.withColumn(out, ids(F.col(text).cast("string")))
    found = found.withColumn(out, F.struct(F.col(out).alias("ids"), F.floor(F.octet_length(out) / 4).cast("long").alias("n_tokens")))
    return unfold(found, out, ["ids", "n_tokens"])
