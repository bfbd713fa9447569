"""Cuts of a text at which no tokenizer of the given vocabularies has a token across, so that repeated parts are tokenized once.

A chunk is white space and what follows it up to the next white space; a run of Latin letters ends where ASCII punctuation or a digit begins, and a single line break before
a word stands alone. A carriage return stays with the punctuation before it, for which there are pieces. The byte-level pattern never takes a letter and such a character, nor a character and the white space after it, into one piece. A vocabulary of pieces has no token
across a cut if none of its pieces holds the two characters side by side: `may_cut` proves that for a vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

#: The white space of Unicode, as the byte-level pattern knows it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u02af"
MARKS = "!-@\\[-`{-~"
CHUNK = re.compile(f"\n(?=[^{SPACE}])|[{SPACE}]*+[{LETTERS}]++(?=[{MARKS}{SPACE}]|\\Z)|[{SPACE}]*+[^{SPACE}]++(?:\r[{SPACE}]*+[^{SPACE}]*+)*+|[{SPACE}]++")
_CUTS = re.compile(f"[{LETTERS}][{MARKS}{SPACE}]|[^{SPACE}](?!\r)[{SPACE}]|\n[^{SPACE}]")


def chunks(text: str) -> list[str]:
    """The text in parts; put together they are the text."""
    return CHUNK.findall(text)


def may_cut(pieces: Iterable[str]) -> bool:
    """Whether no piece (with blanks as blanks) holds a cut."""
    return not any(_CUTS.search(p) for p in pieces)
