"""Text kernels as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic.
STOP_WORDS = "about after again also been before being between both from have into more most only other over same some such than that their them then there these they this those through under very were what when where which while will with your".split()


def refine(text: Column) -> Column:
    """Tags out (up to 500 characters each), entities and URL escapes decoded, white space collapsed."""
    plain = F.regexp_replace(text, r"<[^>]{0,500}>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    # A sign that begins no escape stands for itself and doesn't keep the others from being decoded.
    plain = F.url_decode(F.regexp_replace(plain, r"%(?![0-9A-Fa-f]{2})", "%25"))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def keywords(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Distinct lower-case words of four or more letters a-z that aren't stop words; null gives none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z]{4,}"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in stop]))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two sets."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Jaccard of two sets; the value for two empty ones is a parameter, as rules differ."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def normal_name(name: Column) -> Column:
    """Lower case, anything but a-z and 0-9 as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def first_match(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The first class any of whose keywords is within the lower-cased text."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def word_ngrams(words: Column, n: int) -> Column:
    """Runs of n words of an array, blank-joined."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def md5_bits(token: Column) -> Column:
    """The low 64 bits of a token's MD5 as a string of 0 and 1."""
    return F.lpad(F.conv(F.right(F.md5(token), F.lit(16)), 16, 2), 64, "0")


def caps_ratio(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(letters > 0, F.regexp_count(text, F.lit("[A-Z]")) / letters).otherwise(0.0)


def timestamp_of(text: Column) -> Column:
    """Timestamps in the formats feeds use; null if none fits."""
    formats = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "EEE, dd MMM yyyy HH:mm:ss Z", "yyyy-MM-dd")
    clean = F.regexp_replace(F.trim(text), r"(\+00:00)Z$", "$1")
    return F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in formats[:3]], F.try_to_timestamp(F.regexp_replace(clean, "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(clean, F.lit(formats[-1])))
