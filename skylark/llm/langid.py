"""Language identification in two levels: first the language family, then one-versus-one linear support vector machines
between the languages within it.

Texts become hashed counts of byte bigrams and trigrams of the lower-cased letters, square-rooted and scaled to length one.
Both levels are fitted on a bounded sample of labelled rows; every text is then read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylark.llm.common import fresh, small_batches, unfold
from skylark.llm.linear import linear_svm, sigmoid

#: Hash buckets of byte n-grams.
BUCKETS = 4096
#: Labelled rows that the models are fitted on, of each language at most (about).
SAMPLE_PER_LANGUAGE = 400
#: Languages that are learned: the most frequent ones, so that a column of anything else than languages is no model without bound.
MOST_LANGUAGES = 400
#: Families of ISO 639-1 codes; any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt uz",
    "indic": "as bn gu hi mr ne pa sa si ur",
    "semitic": "am ar he mt ti",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "austronesian": "id jv ms su tl",
}
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def family_of(lang: str) -> str:
    base = re.split("[-_]", lang.lower())[0]
    return next((name for name, codes in FAMILIES.items() if base in codes.split()), lang)


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray | None:
    """The text's vector; None if it has no letter."""
    if not text or not LETTER.search(text):
        return None
    b = np.frombuffer(f" {NOT_LETTERS.sub(' ', text.lower())} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(65599) + b[2:] * np.uint32(2654435761)
    mixed = np.concatenate([two * np.uint32(2654435761), three * np.uint32(2246822519)]) >> np.uint32(7)
    counts = np.sqrt(np.bincount(mixed % np.uint32(buckets), minlength=buckets)).astype(np.float32)
    return counts / np.sqrt(counts @ counts)


class Hierarchy:
    """A linear machine per family against the rest; within each family, one per pair of languages."""

    def __init__(self, x: np.ndarray, langs: list[str], c: float = 4.0):
        if not len(langs):
            x = np.zeros((0, BUCKETS), np.float32)
        names = np.array([family_of(k) for k in langs], object)
        self.families = sorted(set(names))
        self.members = {f: sorted({k for k, n in zip(langs, names, strict=True) if n == f}) for f in self.families}
        tongues = np.array(langs, object)
        self.family = np.array([linear_svm(x, np.where(names == f, 1, -1), c) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {(a, b): linear_svm(x[m], np.where(tongues[m] == a, 1, -1), c) for f in self.families for a, b in combinations(self.members[f], 2) if (m := (tongues == a) | (tongues == b)).any()}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score (0 to 1) of each vector: the family's share of the margins times that of the language's duels."""
        if not self.families:
            return np.full(len(x), UNKNOWN, object), np.zeros(len(x))
        x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
        p = np.ones((len(x), 1)) if self.family is None else sigmoid(2 * (x1 @ self.family.T))
        best, out, score = p.argmax(1), np.full(len(x), UNKNOWN, object), p.max(1)
        for k, f in enumerate(self.families):
            rows, tongues = np.flatnonzero(best == k), self.members[f]
            votes = np.zeros((len(rows), len(tongues)))
            for i, j in combinations(range(len(tongues)), 2):
                win = sigmoid(2 * (x1[rows] @ self.pairs[tongues[i], tongues[j]]))
                votes[:, i] += win
                votes[:, j] += 1 - win
            duels = max(1, len(tongues) - 1)
            out[rows] = np.array(tongues, object)[votes.argmax(1)] if len(rows) else []
            score[rows] *= votes.max(1, initial=0) / duels if len(tongues) > 1 else 1
        return out, score


def sample_of(labelled: DataFrame, lang: str, text: str, doc_id: str, each: int, seed: int) -> list[tuple]:
    """About `each` rows (lang, vector as bytes, place) of every language, by a seeded hash of the id and the text; repeated rows are one."""
    order = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), F.lit(1 << 40))
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MOST_LANGUAGES).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int((1 << 40) * min(1.0, each / n))))])
    # A vector travels as the bytes of its floats: a list of numbers would be many times as large on the driver.
    hashed = F.arrow_udf(lambda v: pa.array([None if (f := features(t)) is None else f.tobytes() for t in v.to_pylist()], pa.binary()), "binary")
    few = labelled.where(order < share[F.col(lang)]).groupBy(F.col(lang).alias("lang"), order.alias("o")).agg(F.min(text).alias("_text"))
    rows = few.select("lang", hashed(F.col("_text")).alias("x"), "o").where("x is not null")
    return sorted(rows.collect(), key=lambda r: (r.lang, r.o, bytes(r.x)))


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", each: int = SAMPLE_PER_LANGUAGE, seed: int = 7) -> Hierarchy:
    """The models, from a sample of about `each` different rows of every language (the MOST_LANGUAGES most frequent); rows without lang, text or letters are no use."""
    small_batches(labelled.sparkSession)
    rows = sample_of(labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), lang, text, doc_id, each, seed)
    return Hierarchy(np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(len(rows), BUCKETS), [r.lang for r in rows])


def language(text: Column, model: Hierarchy) -> Column:
    """A struct (lang_pred, score) for a text column."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            vectors = [features(t) for t in batch.to_pylist()]
            found = np.array([v is not None for v in vectors], bool)
            langs, scores = np.full(len(vectors), UNKNOWN, object), np.zeros(len(vectors))
            if found.any():
                langs[found], scores[found] = model.predict(np.array([v for v in vectors if v is not None]))
            yield pa.StructArray.from_arrays([pa.array(langs.tolist(), pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame, model: Hierarchy, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1); these replace columns of the same names.

    Null texts and texts without letters are `und` with score 0, and so are all if the model has seen no language. Repeated rows get equal results; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    out = fresh(docs, "_language")
    return unfold(docs.withColumn(out, language(F.col(text), model)), out, ["lang_pred", "score"])


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
