"""Grouping of spelling variants: words that differ by one edit, found with asymmetric q-chunks.

A word contributes its two halves as disjoint chunks to one side of a join, and positional grams of the chunks' lengths to the other. One inserted, deleted or replaced code point leaves at least one chunk of a
word whole: the first at its place if the edit comes after it, the second shifted by the difference in length, one at most, if the edit comes before it. Only these grams are made. The edit lies in what is
left of both words beside the whole chunk, so that is cut in two in the same way, and one of its parts is whole as well: chunk and part together are the key, about three quarters of a word, under which
few words meet by chance. Levenshtein's distance then decides; a pair that shares several keys is taken by the first.

All on the JVM's side: counts are pre-aggregated, keys are hashed with place and length, and a frequent one is split by adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylark.llm.common import checkpointed

#: Maximal runs of these are words.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Doublings that follow any chain of forms: each form is RATIO times as frequent, and counts have 63 bits.
DOUBLINGS, RATIO = 6, 2


def misspelt(word: Column, doc_id: Column, every: int) -> Column:
    """The word, less one code point if `every` divides the checksum h of `<doc_id>:<word>`: that at h modulo the length."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word), "UTF-8"))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", every: int | None = None, pattern: str = RUN) -> DataFrame:
    """(word, n): the words of all texts with only A-Z lower-cased; every: see `misspelt` (None: words as they are)."""
    word = F.translate("_run", UPPER, LOWER)
    runs = docs.select(F.col(doc_id).alias("_id"), F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(pattern), F.lit(0))).alias("_run"))
    words = runs.select((word if every is None else misspelt(word, F.col("_id"), every)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def whole_parts(size: Column) -> list[tuple[Column, Column]]:
    """For each key of a word of this length, how many code points at its beginning and at its end are whole: a chunk, and a part of the rest."""
    half = F.floor(size / 2).cast("int")
    after, before = F.floor((size - half) / 2).cast("int"), F.floor(half / 2).cast("int")
    return [(half + after, F.lit(0)), (half, size - half - after), (before, size - half), (F.lit(0), size - before)]


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every ordered pair of distinct words one edit apart, once. words: (word, n), distinct words of two code points or more."""
    size = F.char_length("word")

    def keys(longer: int) -> list[Column]:
        """The keys of a word that is so much longer, in this word."""
        whole = size + longer
        found = [F.struct(F.lit(k).alias("k"), whole.alias("size"), F.left("word", a).alias("begin"), F.right("word", b).alias("end")) for k, (a, b) in enumerate(whole_parts(whole))]
        return [F.when(whole > 1, f) for f in found]

    chunks = words.select("word", "n", F.explode(F.array(*keys(0))).alias("key"))
    grams = F.array_compact(F.array(*[k for longer in (-1, 0, 1) for k in keys(longer)]))
    others = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.explode(grams).alias("key"))
    found = chunks.join(others, "key").where(F.col("word") != F.col("other")).where(F.levenshtein("word", "other", 1) == 1)
    shared = [(F.left("word", a) == F.left("other", a)) & (F.right("word", b) == F.right("other", b)) for a, b in whole_parts(size)]
    first = F.when(shared[0], 0).when(shared[1], 1).when(shared[2], 2).otherwise(3)
    return found.where(F.col("key.k") == first).select("word", "n", "other", "other_n")


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: the end of the chain of forms, by doubling. forms: (word, form), no cycles."""
    roots = checkpointed(forms.select("word", F.col("form").alias("root")))
    for _ in range(DOUBLINGS):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        roots = checkpointed(roots.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")))
        if roots.where("_moved").isEmpty():
            break
        roots = roots.drop("_moved")
    return roots.select("word", "root")


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int | None = None, text: str = "text", doc_id: str = "doc_id", pattern: str = RUN) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of at least least_length code points (two or more) and least_count occurrences.

    n_near: the words one edit away; form: the most frequent of them, if it is at least twice as frequent as the word (ties: the first by code point), form_n its count, both null
    if there is none; root: the end of the chain of forms, the word itself without a form. Null and empty texts have no words; repeated rows count each time; a null id reads as an empty one; other columns
    are not looked at. No texts give an empty table.
    """
    counts = word_counts(docs, text, doc_id, every, pattern)
    words = checkpointed(counts.where((F.char_length("word") >= max(2, least_length)) & (F.col("n") >= least_count)))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    strong = F.col("n") * RATIO <= -F.col("best.less")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"))
    found = checkpointed(found)
    roots = rooted(found.where("form is not null"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
