"""Kernels that read fields out of text: money, parties, coordinates, exhibit marks, dates, names; and those that clean it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Beginnings of database commands that a text should not carry.
PROBES = r"(?i)(union\s+select|drop\s+table|insert\s+into|delete\s+from|or\s+1=1)"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composed form; Spark has no function for it."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def sanitised(text: Column, longest: int = 4000) -> Column:
    """Composed, without control characters and tags, probes replaced, white space collapsed, cut to the longest a field may be."""
    plain = F.regexp_replace(nfc(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"<[^>]*>", " "), PROBES, "[REDACTED]")
    return F.substring(F.trim(F.regexp_replace(plain, r"[ \t\r\n]+", " ")), 1, longest)


def money(text: Column) -> Column:
    """Millions of an amount such as `R 1 234,56`, `R12.5 bn` or `R3,400.00 m`; null outside 0.01 to 999,000.

    A comma with two digits behind it at the end is a decimal sign, any other comma and blanks part thousands. Without a unit
    the amount is in whole units.
    """
    number = F.regexp_extract(text, r"R\s?([0-9][0-9 ,.]*)", 1)
    number = F.regexp_replace(F.trim(number), r",([0-9]{2})$", r".$1")
    value = F.regexp_replace(number, r"[ ,]", "").try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"R\s?[0-9][0-9 ,.]*\s*(bn|billion|m|million|k)\b", 1))
    millions = value * F.when(unit.isin("bn", "billion"), 1000.0).when(unit.isin("m", "million"), 1.0).when(unit == "k", 1e-3).otherwise(1e-6)
    return F.when((millions >= 0.01) & (millions <= 999000), millions)


@F.pandas_udf(StringType())
def tenths(value: pd.Series) -> pd.Series:
    """A number to one decimal, rounded by its exact binary value; format_string rounds by the digits it would print, so 1.25 comes out as 1.3."""
    return value.map(lambda v: f"{v:.1f}", na_action="ignore")


def money_label(amount: Column) -> Column:
    """An amount as R1.2B, R3.4M or R5K."""
    scaled = tenths(amount / F.when(amount >= 1e9, 1e9).otherwise(1e6))
    return (
        F.when(amount >= 1e9, F.concat(F.lit("R"), scaled, F.lit("B")))
        .when(amount >= 1e6, F.concat(F.lit("R"), scaled, F.lit("M")))
        .when(amount >= 1e3, F.format_string("R%.0fK", F.floor(amount / 1e3).cast("double")))
        .otherwise(F.format_string("R%.0f", F.floor(amount).cast("double")))
    )


def parties(title: Column) -> Column:
    """The parties of a case title, parted by v, vs, versus, and, & or a semicolon."""
    return F.filter(F.transform(F.split(title, r"(?i)\s+(?:versus|vs?\.?|and|&)\s+|\s*;\s*"), lambda x: F.trim(x)), lambda x: x != "")


def degrees(degree: Column, minute: Column, second: Column, side: Column) -> Column:
    """Decimal degrees; south and west are negative."""
    size = degree + minute / F.lit(60.0) + second / F.lit(3600.0)
    return F.when(F.upper(side).isin("S", "W"), -size).otherwise(size)


def exhibit_mark(hash_: Column, moment: Column, device: Column, case: Column) -> Column:
    """`moment | device | case | first 16 digits of the hash of all`."""
    body = F.concat_ws(" | ", moment, device, case)
    return F.concat_ws(" | ", body, F.substring(F.sha2(F.concat_ws("\n", body, hash_), 256), 1, 16))


def exhibit_holds(mark: Column, hash_: Column) -> Column:
    """Whether a mark was made of this hash."""
    body = F.regexp_extract(mark, r"^(.* \| .* \| .*) \| [0-9a-f]{16}$", 1)
    return (body != "") & (F.substring_index(mark, " | ", -1) == F.substring(F.sha2(F.concat_ws("\n", body, hash_), 256), 1, 16))


def snippet(text: Column, found: Column, longest: int = 250) -> Column:
    """The sentence around a string (case aside): what lies between the full stops or line ends about it, cut to the longest; null if not found."""
    # Found in the text itself: its lower case may have another length.
    at = F.char_length(F.split(text, F.concat(F.lit(r"(?iu)\Q"), found, F.lit(r"\E")), 2)[0]) + 1
    at = F.when(at <= F.char_length(text), at).otherwise(0)
    before, after = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.char_length(text))
    start = F.element_at(F.split(before, r"[.\n]"), -1)
    return F.when(at > 0, F.substring(F.trim(F.concat(start, F.element_at(F.split(after, r"[.\n]", 2), 1))), 1, longest))


def title_runs(text: Column, generic: list[str]) -> Column:
    """Distinct runs of two or three capitalised words, without those that are generic."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}"), F.lit(0)))
    return F.filter(runs, lambda x: ~x.isin(generic))


# Initials that are names by themselves.
ACRONYMS = ["EFF", "ANC", "SAPS", "NPA"]


def entity_refusal(name: Column) -> Column:
    """Why a string isn't a name, by the first of the ordered gates that stops it; null if none does."""
    bare = F.trim(name)
    digits = F.regexp_count(bare, F.lit("[0-9]"))
    return (
        F.when(bare.isNull() | (bare == ""), "empty")
        .when(bare.isin(ACRONYMS), F.lit(None).cast("string"))
        .when(F.char_length(bare) < 4, "short")
        .when(F.char_length(bare) > 80, "long")
        .when(digits * 10 > F.char_length(bare) * 6, "digits")
        .when(bare.rlike(r"(?i)(home page|\| |\.com$|log in)"), "site title")
        .when(~bare.rlike(r"[A-Z]"), "lower case")
        .when(~bare.rlike(r"[ #]"), "one word")
    )


def counter_cosine(a: Column, b: Column) -> Column:
    """Cosine of the word counts of two arrays: 1 if both are empty, 0 if one is."""

    def dot(x: Column, y: Column) -> Column:
        # The sum over x's items of how often each is in y is the product of the counts.
        return F.aggregate(x, F.lit(0.0), lambda s, w: s + F.size(F.filter(y, lambda v: v == w)))

    some = dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(some)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two short strings; for titles and names, not for whole texts, as it grows with the product of lengths."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


# Titles before names; first words of headings in records; what is no person's name.
TITLES = ["adv. ", "adv ", "dr. ", "dr ", "mr. ", "mr ", "mrs. ", "mrs ", "ms. ", "ms ", "miss ", "prof. ", "prof ", "hon. ", "hon ", "judge ", "justice ", "commissioner "]
HEADINGS = ["schedule", "statute", "gazette", "annex", "annexure", "appendix", "section", "clause", "chapter", "part", "exhibit", "regulation", "proclamation", "notice"]
NO_NAME = [r"^\d", r"(?i)Magnitude\s", r"^M\d+\.\d", r"(?i)Depth:", r"(?i)FURNFIT", r"(?i)OEQUIP", r"^Bag X\d", r"^\w\.\s+[A-Z]", r"(?i)\bBuilding\b", r"(?i)\bBay\b", r"(?i)\bMunicip", r"^[A-Z]{2,6}$", r"^[A-Z]{2,}\s+[A-Z0-9]{2,}$", r"(?i)&amp;|&nbsp;", r"[<>{}|\\]", r"\d{3,}", r"^\s*-[\d.]", r"\.{3,}"]


def person_name(raw: Column) -> Column:
    """A name as found in a scan: its first line, joined with the second if it is one short word, with single blanks, without punctuation at its end or a title before it."""
    lines = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    halved = (F.size(lines) >= 2) & (F.char_length(first) <= 15) & ~first.contains(" ")
    name = F.trim(F.regexp_replace(F.regexp_replace(F.when(halved, F.concat_ws(" ", first, F.get(lines, F.lit(1)))).otherwise(first), r"\s{2,}", " "), r"[^\p{L}\p{N}_\s]+$", ""))
    return F.trim(F.regexp_replace(name, "(?i)^(?:" + "|".join(t.replace(".", r"\.") for t in TITLES) + ")", ""))


def is_person_name(name: Column, refused: list[str] | None = None, shortest: int = 4, longest: int = 80) -> Column:
    """Whether a cleaned name may be a person's: two words or more, of fitting length, in no list of what is none; null is none."""
    low = F.lower(name)
    fits = F.char_length(name).between(shortest, longest) & name.contains(" ") & ~low.isin(list(refused or [""])) & ~F.element_at(F.split(low, " "), 1).isin(HEADINGS) & name.rlike(r"\p{Ll}")
    for pattern in NO_NAME:
        fits = fits & ~name.rlike(pattern)
    return F.coalesce(fits, F.lit(False))


def dossier_html(markdown: Column) -> Column:
    """Headings of two levels and paragraphs, one for each line with text."""
    lines = F.filter(F.transform(F.split(markdown, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    wrap = lambda x: F.when(x.startswith("# "), F.concat(F.lit("<h1>"), F.substr(x, F.lit(3)), F.lit("</h1>"))).when(x.startswith("## "), F.concat(F.lit("<h2>"), F.substr(x, F.lit(4)), F.lit("</h2>"))).otherwise(F.concat(F.lit("<p>"), x, F.lit("</p>")))
    return F.array_join(F.transform(lines, wrap), "\n")
