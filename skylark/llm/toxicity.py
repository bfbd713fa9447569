"""Toxicity by a classifier chain: categories are predicted one after the other, each linear model also being given the probabilities
of the categories before it.

The models are fitted on a bounded sample of labelled rows. For training, the earlier probabilities are out of fold: each row's come from models that haven't
seen it. Features are the presence of words and of word beginnings (which inflected and compound words share), chosen per category by a chi-squared
statistic on the rows a model is fitted on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylark.llm.common import fresh, small_batches, unfold
from skylark.llm.linear import folds, logistic, sigmoid, with_one

#: Labelled rows that the models are fitted on: at most about so many of the first category, and of the rest.
SAMPLE_EACH = 2000
#: Words and beginnings of a model.
WORDS = 150
#: Bytes of a word's beginnings.
BEGINNINGS = (4, 5, 6, 7)
#: Words whose features a worker remembers; then it starts afresh.
REMEMBERED = 200_000
#: Labelled documents that a word must occur in.
MIN_DOCUMENTS = 4
FOLDS = 5
RIDGE = 0.3
THRESHOLD = 0.35
TOKEN = re.compile(r"[^\W\d_]+")


def distinct_words(text: str | None) -> set[str]:
    """The words of the whole text, lower-cased."""
    return set(TOKEN.findall((text or "").lower()))


def keys_of(word: str) -> list[int]:
    """A 64-bit key of the word, and one of each of its beginnings."""
    b = word.encode("utf-8", "surrogatepass")
    return [xxhash.xxh64_intdigest(b), *(n << 56 | int.from_bytes(b[:n], "big") for n in BEGINNINGS if len(b) >= n)]


def word_keys(text: str | None) -> list[int]:
    return list({k for w in distinct_words(text) for k in keys_of(w)})


@dataclass
class Link:
    """One category's model: its words' weights, those of earlier categories' probabilities, and the intercept."""

    words: np.ndarray
    weights: np.ndarray

    def odds(self, present: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return with_one(np.hstack([present, earlier])) @ self.weights


class Rows:
    """The sample's words as a sparse table of rows and word numbers."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        """flat: the keys of all rows one after the other; lengths: how many each row has. Only keys of MIN_DOCUMENTS rows or more are kept."""
        self.n = len(lengths)
        every, counts = np.unique(flat, return_counts=True)
        self.words = every[counts >= MIN_DOCUMENTS]
        at = np.searchsorted(self.words, flat).astype(np.int32)
        known = at < len(self.words)
        known[known] = self.words[at[known]] == flat[known]
        self.word, self.row = at[known], np.repeat(np.arange(self.n, dtype=np.int32), lengths)[known]

    def chosen(self, y: np.ndarray, use: np.ndarray, most: int) -> np.ndarray:
        """Word numbers with the highest chi-squared statistic on the rows in use."""
        inside = use[self.row]
        with_word = np.bincount(self.word[inside], minlength=len(self.words)).astype(float)
        positive = np.bincount(self.word[inside], weights=y[self.row[inside]], minlength=len(self.words))
        n, p = use.sum(), y[use].sum()
        expected = with_word * p / max(n, 1)
        spread = with_word * (n - with_word) * p * (n - p) / max(n, 1) ** 3 + 1e-9
        score = (positive - expected) ** 2 / spread
        return np.sort(np.argsort(-score, kind="stable")[:most])

    def present(self, words: np.ndarray) -> np.ndarray:
        place = np.full(len(self.words) + 1, -1)
        place[words] = np.arange(len(words))
        at = place[self.word]
        out = np.zeros((self.n, len(words)))
        out[self.row[at >= 0], at[at >= 0]] = 1
        return out


def fit_chain(flat: np.ndarray, lengths: np.ndarray, y: np.ndarray, words: int = WORDS, ridge: float = RIDGE) -> list[Link]:
    """The chain's models; flat, lengths: the rows' keys; y: a 0/1 column per category, in the chain's order."""
    n = len(lengths)
    rows, fold, earlier, chain = Rows(flat, lengths), folds(n, FOLDS), np.zeros((n, 0)), []
    for c in range(y.shape[1]):
        out_of_fold = np.zeros(n)
        for f in [*range(FOLDS), None]:
            use = np.ones(n, bool) if f is None else fold != f
            chosen = rows.chosen(y[:, c], use, words)
            x = np.hstack([rows.present(chosen), earlier])
            link = Link(rows.words[chosen], logistic(x[use], y[use, c], ridge) if use.any() else np.zeros(x.shape[1] + 1))
            if f is None:
                chain.append(link)
            else:
                out_of_fold[~use] = sigmoid(link.odds(x[~use][:, : len(chosen)], earlier[~use]))
        earlier = np.hstack([earlier, out_of_fold[:, None]])
    return chain


class Predictor:
    """A chain applied to texts, with the features of the words met so far."""

    def __init__(self, chain: list[Link]):
        self.chain = chain
        self.vocabulary = {k: i for i, k in enumerate(sorted({int(k) for link in chain for k in link.words}))}
        self.places = [[self.vocabulary[int(k)] for k in link.words] for link in chain]
        self.known: dict[str, tuple[int, ...]] = {}

    def features(self, word: str) -> tuple[int, ...]:
        found = self.known[word] = tuple(at for k in keys_of(word) if (at := self.vocabulary.get(k)) is not None)
        return found

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities: a row per text, a column per category."""
        present = np.zeros((len(texts), len(self.vocabulary)))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for r, t in enumerate(texts):
            for w in distinct_words(t):
                at = self.known.get(w)
                for k in self.features(w) if at is None else at:
                    present[r, k] = 1
        earlier = np.zeros((len(texts), 0))
        for link, places in zip(self.chain, self.places, strict=True):
            earlier = np.hstack([earlier, sigmoid(link.odds(present[:, places], earlier))[:, None]])
        return earlier


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: list[str], each: int, text: str, doc_id: str, seed: int) -> pa.Table:
    """Rows (words, categories) of about `each` labelled documents with the first category and as many without."""
    order = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(1 << 40))
    once = labels.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(*[F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(c) for c in categories])
    first = F.col(categories[0])
    n, positive = once.agg(F.count(F.lit(1)), F.coalesce(F.sum(first), F.lit(0))).first()
    share = F.when(first == 1, F.lit(int((1 << 40) * min(1.0, each / max(1, positive))))).otherwise(F.lit(int((1 << 40) * min(1.0, each / max(1, n - positive)))))
    few = once.where(order < share)  # of a bounded size: about twice `each`
    keys = F.arrow_udf(lambda v: pa.array([np.array(word_keys(t), np.uint64).view(np.int64).tolist() for t in v.to_pylist()], pa.list_(pa.int64())), "array<long>")
    # Of an id with several rows one text, whichever hashes lowest: an id that is repeated is no larger a sample.
    labelled = docs.where(F.col(text).isNotNull()).join(F.broadcast(few), doc_id).groupBy(doc_id, *categories).agg(F.min_by(text, F.xxhash64(text)).alias("_text"))
    return labelled.select(F.col(doc_id).alias("doc_id"), keys(F.col("_text")).alias("words"), *categories).toArrow()


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], each: int = SAMPLE_EACH, text: str = "text", doc_id: str = "doc_id", seed: int = 3) -> list[Link]:
    """The chain for labels' 0/1 columns `categories`, in this order. Rows without id, text or label are no use; several labels of an id count as the highest, and of several texts one is used."""
    small_batches(docs.sparkSession)
    rows = labelled_sample(docs.select(doc_id, text), labels, categories, each, text, doc_id, seed)
    rows = rows.append_column("n", pa.compute.list_value_length(rows["words"])).sort_by([("doc_id", "ascending"), ("n", "ascending")]).combine_chunks()
    y = np.stack([rows[c].to_numpy() for c in categories], 1).astype(float)
    lengths = rows["n"].to_numpy()
    flat = rows["words"].combine_chunks().flatten().to_numpy().view(np.uint64)
    return fit_chain(flat, lengths, y)


def probabilities(text: Column, chain: list[Link], categories: list[str]) -> Column:
    """A struct p_<category> for a text column."""
    names = [f"p_{c}" for c in categories]

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predictor = Predictor(chain)
        for batch in batches:
            p = predictor(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(len(names))], names)

    return predict(text)


def classify(docs: DataFrame, chain: list[Link], categories: list[str], threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with p_<category> (0 to 1) of each category and `toxic`: whether the first category's is at least the threshold.

    Null texts and texts without known words get the intercepts' probabilities. Repeated rows get equal results; the new columns replace docs' columns of these
    names; every row stays.
    """
    small_batches(docs.sparkSession)
    out = fresh(docs, "_toxicity")
    found = unfold(docs.withColumn(out, probabilities(F.col(text), chain, categories)), out, [f"p_{c}" for c in categories])
    return found.withColumn("toxic", F.col(f"p_{categories[0]}") >= threshold)
