"""Tokenizers from public vocabulary files; nothing is trained here. The files' folder is a parameter."""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from functools import lru_cache

import numpy as np
import tiktoken

from skylark.llm.chunks import SPACE

#: Fixed value: how byte-level BPE of this vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
#: White space from so many characters on is given to the tokenizer without the pattern, which goes back through such a run step by step and runs out of stack.
LONG_SPACE = 10_000
LONG_RUN = re.compile(f"[{SPACE}]{{{LONG_SPACE},}}")


def vocabulary_path(folder: str | None = None, name: str = VOCABULARY) -> str:
    """The file in the folder, or in the package of public tokenizers if none is given; each task looks on its own machine."""
    if folder is None:
        folder = os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)
    return os.path.join(folder, name)


class ByteBpe:
    """Byte-level BPE whose tokens, put together, are the text's bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.token_bytes[list(ranks.values())] = [len(k) for k in ranks]

    def encode(self, text: str) -> list[int]:
        """The token ids of the whole text.

        Of a run of white space the pattern makes one piece, less the last character if something follows; that character begins what follows.
        """
        if len(text) < LONG_SPACE:
            return self.encoding.encode_ordinary(text)
        out, at = [], 0
        for run in LONG_RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self.encoding.encode_ordinary(text[at : run.start()])
            out += self.piece.encode_ordinary(text[run.start() : end])
            at = end
        return out + self.encoding.encode_ordinary(text[at:])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    """One per worker and file."""
    return ByteBpe(path)
