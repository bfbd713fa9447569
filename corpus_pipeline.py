"""A training corpus from `documents`: language ID, near-duplicates, decontamination, mixing, packed token ids.

Each stage takes (spark, docs, sf_dir) and returns a table which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylark.llm import decontaminate, langid, mixing, packing, queries, simhash
from skylark.llm.common import checkpointed


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without text or letters go."""
    model = queries.fitted_language_model(docs)
    kept = {c: f"_kept_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    found = langid.identify(docs.withColumnsRenamed(kept), model).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in kept.items()}).select(docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold a test item."""
    added = ("coverage", "item_id", "n_items", "contaminated")
    kept = {c: f"_kept_{c}" for c in added if c in docs.columns}
    found = decontaminate.decontaminate(docs.withColumnsRenamed(kept), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(~F.col("contaminated"))
    return found.drop(*added).withColumnsRenamed({v: k for k, v in kept.items()}).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: rows as often as they are taken."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack(docs)


STAGES = [("language", language_stage), ("dedup", dedup_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL has no tokenizer, no linear machine and no 64-bit hash of this kind: tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; between stages the rows are written to the checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
