"""Who does what to whom in a sentence, without a parser: each verb of a lexicon takes the last entity before it and the first after it.

An approximation, and flagged as one: clauses and pronouns aren't resolved. Entities, verbs, forms of "be" and the "by" of the passive are patterns of one automaton, so that texts are walked once where they
are read and a verb within a name isn't one; only hits are shuffled, by sentence, and the neighbours come from windows over a sentence's hits.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylark.operators.names import mentions

#: Ends of sentences: marks before white space or the end of the text, and line breaks.
ENDS = r"[.!?]+\s+|[.!?]+$|\n+"
BE = ("is", "are", "was", "were", "be", "been", "being")
BY = ("by",)
ENTITY, VERB, BEING, AGENT = range(4)


def sentences(texts: DataFrame) -> DataFrame:
    """(doc_id: struct of doc and sentence, text) of texts (doc_id, text); null texts have none."""
    cut = texts.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", ENDS)).alias("sentence", "text"))
    return cut.select(F.struct(F.col("doc_id").alias("doc"), "sentence").alias("doc_id"), "text")


def forms(lexicon: DataFrame, irregular: DataFrame | None = None) -> DataFrame:
    """(form, relation, participle): a lexicon (lemma, relation) with its regular English forms, and irregular ones (lemma, form, participle) if given.

    A final consonant after a vowel is written once and twice, as either may be right. A form of several lemmas belongs to the first of them in order.
    """
    v = F.lower("lemma")
    soft, silent = v.rlike("(s|x|z|ch|sh)$"), v.rlike("e$")
    why = v.rlike("[^aeiou]y$")
    stem = F.regexp_replace(v, "y$", "i")
    bare = F.regexp_replace(v, "e$", "")
    twice = F.when(v.rlike("[aeiou][bdgklmnprt]$"), F.concat(v, F.substring(v, -1, 1)))
    one = lambda form, participle: F.struct(form.alias("form"), F.lit(participle).alias("participle"))
    made = [
        one(v, False),
        one(F.when(soft, F.concat(v, F.lit("es"))).when(why, F.concat(stem, F.lit("es"))).otherwise(F.concat(v, F.lit("s"))), False),
        one(F.when(silent, F.concat(v, F.lit("d"))).when(why, F.concat(stem, F.lit("ed"))).otherwise(F.concat(v, F.lit("ed"))), True),
        one(F.concat(twice, F.lit("ed")), True),
        one(F.concat(bare, F.lit("ing")), False),
        one(F.concat(twice, F.lit("ing")), False),
    ]
    rows = lexicon.select("lemma", "relation", F.explode(F.array(*made)).alias("f")).select("lemma", "relation", "f.form", "f.participle")
    if irregular is not None:
        rows = rows.unionByName(lexicon.join(irregular, "lemma").select("lemma", "relation", F.lower("form").alias("form"), "participle"))
    return rows.where(F.col("form").isNotNull()).groupBy("form").agg(F.min_by("relation", F.struct("lemma", "relation")).alias("relation"), F.bool_or("participle").alias("participle"))


def triples(texts: DataFrame, entities: DataFrame, verbs: DataFrame, *, generic: Iterable[str] = (), be: Iterable[str] = BE, by: Iterable[str] = BY) -> DataFrame:
    """(doc_id, subject, relation, object, passive, sentence, approximate): one row per text, subject, relation and object, with the first sentence that has it.

    texts (doc_id, text), entities (name_id, name), verbs (form, relation, participle). Active: the last entity before the verb is the subject, the first after it the object. Passive, a participle with a form
    of "be" one or two words before it: the other way round, if "by" stands between verb and entity; without it there is no triple. Names in `generic` are no subjects; subject and object differ.
    """
    spark = texts.sparkSession
    kind = entities.schema["name_id"].dataType
    token = lambda k, entity, relation, participle: F.struct(F.lit(k).alias("kind"), entity.cast(kind).alias("entity"), relation.cast("string").alias("relation"), participle.cast("boolean").alias("participle"))
    null = F.lit(None)
    no_subject = F.lower(F.trim("name")).isin(*[g.lower() for g in generic]) if generic else F.lit(False)
    # A generic name is marked by the participle's place, which entities don't need.
    tokens = entities.select(token(ENTITY, F.col("name_id"), null, no_subject).alias("name_id"), "name")
    tokens = tokens.union(verbs.select(token(VERB, null, F.col("relation"), F.col("participle")), F.col("form")))
    words = spark.createDataFrame([(BEING, w) for w in be] + [(AGENT, w) for w in by], "kind int, name string")
    tokens = tokens.union(words.select(F.struct("kind", null.cast(kind).alias("entity"), null.cast("string").alias("relation"), F.lit(False).alias("participle")), "name"))
    hits = mentions(sentences(texts), tokens).select("doc_id", "place", F.col("name_id").alias("t"))
    along = Window.partitionBy("doc_id").orderBy("place")
    earlier, later = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    at = F.struct(F.col("t.entity").alias("id"), F.col("t.participle").alias("generic"), "place")
    is_a = lambda k: F.col("t.kind") == k
    near = hits.withColumns({
        "before": F.last(F.when(is_a(ENTITY), at), ignorenulls=True).over(earlier),
        "after": F.first(F.when(is_a(ENTITY), at), ignorenulls=True).over(later),
        "be": F.last(F.when(is_a(BEING), F.col("place")), ignorenulls=True).over(earlier),
        "by": F.first(F.when(is_a(AGENT), F.col("place")), ignorenulls=True).over(later),
    })
    passive = F.col("t.participle") & F.coalesce(F.col("place") - F.col("be") <= 2, F.lit(False))
    found = near.where(is_a(VERB) & F.col("before").isNotNull() & F.col("after").isNotNull()).withColumn("passive", passive)
    found = found.where(~F.col("passive") | (F.col("by") < F.col("after.place")))
    side = lambda x, y: F.when(F.col("passive"), F.col(x)).otherwise(F.col(y))
    pairs = found.select("doc_id", side("after", "before").alias("s"), side("before", "after").alias("o"), F.col("t.relation").alias("relation"), "passive", "place")
    pairs = pairs.where((F.col("s.id") != F.col("o.id")) & ~F.col("s.generic"))
    keys = [F.col("doc_id.doc").alias("doc_id"), F.col("s.id").alias("subject"), "relation", F.col("o.id").alias("object")]
    once = pairs.groupBy(*keys).agg(F.min(F.struct(F.col("doc_id.sentence").alias("sentence"), "place", "passive")).alias("first"))
    return once.select("doc_id", "subject", "relation", "object", "first.passive", "first.sentence", F.lit(True).alias("approximate"))
