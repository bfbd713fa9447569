"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole. Tokens of a byte-level vocabulary follow each other without gaps, so their byte
lengths give each token's character span. Spans of tokens and of sections are then joined as sorted intervals, and a token that lies in
more than one section goes by an explicit rule.

Rules: `most` (default): the section with most of the token's characters, the earlier of equals; `start`: the section of its first character; `end`: that
of its last; `share`: split in proportion to the characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylark.llm.common import small_batches
from skylark.llm.bpe import ByteBpe, tokenizer, vocabulary_path

RULES = ("most", "start", "end", "share")
SECTIONS = "array<struct<section:int,start:long,end:long,n_tokens:double,n_crossing:long>>"
LINES = re.compile(r"[^\n]*\n|[^\n]+\Z")


def line_sections(text: str) -> list[tuple[int, int]]:
    """Lines with their line breaks: character spans that cover the text."""
    return [m.span() for m in LINES.finditer(text)]


def token_spans(bpe: ByteBpe, text: str) -> np.ndarray:
    """Character where each token starts, and the text's length at the end.

    A token that starts within a character's bytes starts at that character if it holds the character's first byte, else after it: a
    character belongs to the token with its first byte, and a token without one has an empty span.
    """
    ends = np.concatenate([[0], np.cumsum(bpe.token_bytes[np.array(bpe.encode(text), np.int64)])])
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) == len(text):
        return ends
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[ends]


def attribute(bounds: np.ndarray, sections: list[tuple[int, int]], rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of those that touch it cross a boundary.

    bounds: token starts and the end; sections: sorted spans without overlaps, which may leave gaps. Tokens that touch no section count
    nowhere; a token of an empty span belongs to the section at its place (that before, at the end of the text).
    """
    tokens, crossing = np.zeros(len(sections)), np.zeros(len(sections), np.int64)
    if not len(sections) or len(bounds) < 2:
        return tokens, crossing
    start, end = np.array(sections, np.int64).T
    a, b = bounds[:-1], bounds[1:]
    first = np.searchsorted(end, a, "right")  # the first section that ends after the token's start
    last = np.searchsorted(start, np.maximum(b - 1, a), "right") - 1  # the last that starts before its end
    empty = a == b
    first = np.where(empty, np.minimum(first, len(sections) - 1), first)
    last = np.where(empty, np.where(start[first] <= a, first, -1), last)
    one = first == last
    tokens += np.bincount(first[one], minlength=len(sections))
    for k in np.flatnonzero(first < last):
        touched = np.arange(first[k], last[k] + 1)
        shared = np.minimum(end[touched], b[k]) - np.maximum(start[touched], a[k])
        crossing[touched] += 1
        if rule == "share":
            tokens[touched] += shared / shared.sum()
        elif rule == "most":
            tokens[touched[shared.argmax()]] += 1
        elif rule == "start":
            tokens[touched[0]] += start[touched[0]] <= a[k]
        else:
            tokens[touched[-1]] += end[touched[-1]] >= b[k]
    return tokens, crossing


def section_tokens(docs: DataFrame, rule: str = "most", sections: Callable[[str], list[tuple[int, int]]] = line_sections, tokenizers: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, doc_tokens, section, start, end, n_tokens, n_crossing): one row for each section of each text, in characters.

    With sections that cover the text, n_tokens of a document add up to doc_tokens. Null and empty texts have no section: one row with
    section null and 0 tokens. Repeated rows come each time; a null id stays null; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)

    @F.arrow_udf(f"doc_tokens long, sections {SECTIONS}")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(vocabulary_path(tokenizers))
        for batch in batches:
            totals, offsets, columns = [], [0], [[], [], [], [], []]
            for t in batch.to_pylist():
                if not t:
                    totals.append(0)
                    offsets.append(offsets[-1])
                    continue
                bounds, spans = token_spans(bpe, t), sections(t)
                tokens, crossing = attribute(bounds, spans, rule)
                totals.append(len(bounds) - 1)
                offsets.append(offsets[-1] + len(spans))
                for column, values in zip(columns, (range(len(spans)), [s[0] for s in spans], [s[1] for s in spans], tokens.tolist(), crossing.tolist()), strict=True):
                    column.extend(values)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            rows = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["section", "start", "end", "n_tokens", "n_crossing"])
            yield pa.StructArray.from_arrays([pa.array(totals, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)], ["doc_tokens", "sections"])

    out = docs.select(F.col(doc_id).alias("doc_id"), counted(F.col(text)).alias("_c"))
    out = out.select("doc_id", F.col("_c.doc_tokens").alias("doc_tokens"), F.explode_outer("_c.sections").alias("_s"))
    return out.select("doc_id", "doc_tokens", *[F.col(f"_s.{c}").alias(c) for c in ("section", "start", "end")], F.coalesce("_s.n_tokens", F.lit(0.0)).alias("n_tokens"), F.coalesce("_s.n_crossing", F.lit(0)).alias("n_crossing"))
