"""The operators applied to the whole tables, with production parameters. What SQL can't express, tests/llm holds against plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylark.llm import aligned, attribution, chat, decontaminate, html, langid, mixing, packing, prefix_bpe, quality, simhash, toxicity, variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    trusted = quality.documents_of(docs, quality.trusted_ids(labels))
    return quality.quality(docs, trusted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "whole", "part")


#: Toxicity categories in the chain's order: whether a text is toxic at all; whether it is otherwise good text; whether it is junk as well.
CATEGORIES = ["toxic", "toxic_prose", "toxic_junk"]


def toxicity_labels(labels: DataFrame) -> DataFrame:
    toxic, good = F.coalesce(F.col("toxic"), F.lit(0)) > 0, F.coalesce(F.col("quality"), F.lit(0)) > 0
    return labels.select("doc_id", toxic.cast("int").alias("toxic"), (toxic & good).cast("int").alias("toxic_prose"), (toxic & ~good).cast("int").alias("toxic_junk"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, toxicity_labels(table(spark, sf_dir, "labels")), CATEGORIES)
    return toxicity.classify(docs, chain, CATEGORIES).drop("text")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "coverage", "item_id", "n_items")


def op6_chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_roles(table(spark, sf_dir, "conversations")).drop("text")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.main_text(pages, html.fit(pages)).select("page_id", "url", "text", "n_chars")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def fitted_language_model(docs: DataFrame) -> langid.Hierarchy:
    return langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fitted_language_model(docs)
    return langid.identify(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    decoded = F.sha2(F.encode(prefix_bpe.decoded(F.col("ids")), "UTF-8"), 256)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), decoded.alias("decoded_sha256"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned.align(table(spark, sf_dir, "documents"))


#: One word in so many, by its checksum, is misspelt.
MISSPELT = 97


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"), every=MISSPELT)


#: Checksums are computed byte by byte, forms by deletion: two words are near if one is the other less a code point, or both are the same less the one at the same place.
SPELLING_SQL = """
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
),
step AS (SELECT i, c FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS times
  FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents)
  GROUP BY ALL
),
hashed(doc_id, run, raw, spot, c) AS (
  SELECT doc_id, run, hex(encode(doc_id || ':' || run)), 1, 4294967295::BIGINT FROM runs
  UNION ALL
  SELECT h.doc_id, h.run, h.raw, h.spot + 2, xor(h.c >> 8, s.c)
  FROM hashed h JOIN step s ON s.i = xor(h.c & 255, ('0x' || substr(h.raw, h.spot, 2))::BIGINT)
  WHERE h.spot < length(h.raw)
),
sums AS (SELECT doc_id, run, xor(c, 4294967295) AS h FROM hashed WHERE spot > length(raw)),
words AS (
  SELECT word, sum(times)::BIGINT AS n
  FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times
    FROM runs JOIN sums USING (doc_id, run))
  GROUP BY word HAVING length(word) >= 5 AND sum(times) >= 3
),
less AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
),
ranked AS (
  SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place
  FROM near
),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
    CASE WHEN r.other_n >= 2 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 2 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
),
chain(word, spot) AS (
  SELECT word, word FROM words
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.spot WHERE f.form IS NOT NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.spot AS root
FROM formed f
JOIN chain c ON c.word = f.word
JOIN formed last ON last.word = c.spot AND last.form IS NULL
"""


OPERATORS = (
    op1_quality_rules, op2_token_counts, op3_source_mixing, op4_toxicity, op5_decontamination, op6_chat_roles, op7_packing, op8_html_text, op9_simhash_dedup, op10_language_id,
    op11_bpe_codec, op12_tokenizer_alignment, op13_spelling_variants,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op13_spelling_variants": SPELLING_SQL}
