"""Who does what to whom: triples by nearest entities, links of a signal's actors by verb patterns. The invented prose has none of the verbs: common words of it stand in for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.adapters import ACTOR_EVENTS, actor_events, table
from skylark.operators import relations, triples
from skylark.plans.names import item_names
from skylark.plans.registry import query

VERBS = [("with", "CONTRACTED", False), ("for", "INVESTIGATES", False), ("that", "ACCUSED_OF", True), ("from", "MEMBER_OF", True)]
BE, BY = ["is", "was", "are", "be"], ["by", "in"]
WORD = r"[\p{L}\p{N}_]+"

TRIPLES = rf"""WITH RECURSIVE named AS (
  SELECT item_id AS name_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM benchmark),
known AS (
  SELECT w[1:CASE WHEN name_id % 3 = 0 THEN 2 ELSE 1 END] AS run, 0 AS kind, name_id, NULL AS relation, false AS participle FROM named WHERE len(w) > 1
  UNION ALL SELECT [form], 1, NULL, relation, participle FROM (VALUES {", ".join(f"('{f}', '{r}', {str(p).lower()})" for f, r, p in VERBS)}) AS v(form, relation, participle)
  UNION ALL SELECT [form], 2, NULL, NULL, false FROM (VALUES {", ".join(f"('{w}')" for w in BE)}) AS v(form)
  UNION ALL SELECT [form], 3, NULL, NULL, false FROM (VALUES {", ".join(f"('{w}')" for w in BY)}) AS v(form)),
tokens AS (SELECT *, len(run) AS n FROM known QUALIFY row_number() OVER (PARTITION BY run ORDER BY kind, name_id) = 1),
cut AS (SELECT doc_id, regexp_split_to_array(text, '[.!?]+\s+|[.!?]+$|\n+') AS parts FROM documents WHERE text IS NOT NULL),
texts AS (SELECT doc_id, sentence, regexp_extract_all(lower(part), '{WORD}') AS w FROM (SELECT doc_id, unnest(range(len(parts))) AS sentence, unnest(parts) AS part FROM cut)),
places AS (SELECT doc_id, sentence, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
hits AS (SELECT doc_id, sentence, i AS place, kind, name_id, relation, participle, n FROM places JOIN tokens ON w[i] = run[1] WHERE w[i:i + n - 1] = run),
taken(doc_id, sentence, place, kind, name_id, relation, participle, n) AS (
  SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, sentence ORDER BY place, n DESC) = 1
  UNION ALL
  SELECT doc_id, sentence, place, kind, name_id, relation, participle, n FROM (
    SELECT h.*, row_number() OVER (PARTITION BY h.doc_id, h.sentence ORDER BY h.place, h.n DESC) AS r FROM taken t JOIN hits h ON h.doc_id = t.doc_id AND h.sentence = t.sentence AND h.place >= t.place + t.n)
  WHERE r = 1),
near AS (SELECT v.doc_id, v.sentence, v.place, v.relation, v.participle,
  (SELECT max(e.place) FROM taken e WHERE e.doc_id = v.doc_id AND e.sentence = v.sentence AND e.kind = 0 AND e.place < v.place) AS before,
  (SELECT min(e.place) FROM taken e WHERE e.doc_id = v.doc_id AND e.sentence = v.sentence AND e.kind = 0 AND e.place > v.place) AS after,
  (SELECT max(e.place) FROM taken e WHERE e.doc_id = v.doc_id AND e.sentence = v.sentence AND e.kind = 2 AND e.place < v.place) AS be,
  (SELECT min(e.place) FROM taken e WHERE e.doc_id = v.doc_id AND e.sentence = v.sentence AND e.kind = 3 AND e.place > v.place) AS agent
  FROM taken v WHERE v.kind = 1),
told AS (SELECT *, participle AND coalesce(place - be <= 2, false) AS passive FROM near WHERE before IS NOT NULL AND after IS NOT NULL),
pairs AS (SELECT t.doc_id, t.sentence, t.place, t.relation, t.passive, CASE WHEN passive THEN y.name_id ELSE x.name_id END AS subject, CASE WHEN passive THEN x.name_id ELSE y.name_id END AS object
  FROM told t JOIN taken x ON x.doc_id = t.doc_id AND x.sentence = t.sentence AND x.place = before JOIN taken y ON y.doc_id = t.doc_id AND y.sentence = t.sentence AND y.place = after
  WHERE NOT passive OR coalesce(agent < after, false))
SELECT doc_id, subject, relation, object, passive, CAST(sentence AS INTEGER) AS sentence, true AS approximate FROM pairs WHERE subject <> object
QUALIFY row_number() OVER (PARTITION BY doc_id, subject, relation, object ORDER BY sentence, place) = 1"""


@query(TRIPLES)
def t35_triples(spark, sf):
    """Triples of benchmark names in all documents, by nearest entities about each verb."""
    verbs = spark.createDataFrame(VERBS, "form string, relation string, participle boolean")
    return triples.triples(table(spark, sf, "documents").select("doc_id", "text"), item_names(spark, sf, 1), verbs, be=BE, by=BY)


#: Whole words by their neighbours, as the oracle's word boundary knows ASCII letters only.
WHOLE = r"(?:^|[^\p{L}\p{N}_])(?:%s)(?:$|[^\p{L}\p{N}_])"
PATTERNS = tuple((WHOLE % w, r, weight) for w, r, weight in (("von|zu", "INVESTIGATED_BY", 0.65), ("que|les", "LEADS", 0.60), ("by", "CONTRACTED", 0.55), ("this", "FUNDED_BY", 0.45), ("of", "AFFILIATED_WITH", 0.40)))
ENFORCERS = ("3", "7")
HEAD = "lower(coalesce(split_part(text, chr(10), 1), '') || ' ' || coalesce(substr(text, 1, 300), ''))"


@query(rf"""WITH {ACTOR_EVENTS},
said AS (SELECT doc_id AS signal_id, CASE {" ".join(f"WHEN regexp_matches({HEAD}, '{p}') THEN {k}" for k, (p, _, _) in enumerate(PATTERNS))} END AS k FROM documents WHERE text IS NOT NULL),
kinds AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{r}', CAST({w} AS DOUBLE))" for k, (_, r, w) in enumerate(PATTERNS))}) AS v(k, relation, weight)),
told AS (SELECT signal_id, relation, weight, actor_id, (actor_id % 9 + 1) / CAST(9 AS DOUBLE) AS confidence, regexp_matches(s_name, '[37]') AS force
  FROM said JOIN kinds USING (k) JOIN actor_events e ON e.event_id = signal_id JOIN supplier ON s_suppkey = actor_id WHERE (actor_id % 9 + 1) / CAST(9 AS DOUBLE) >= 0.3),
pairs AS (SELECT signal_id, x.relation, round(least(x.confidence, y.confidence) * x.weight, 4) AS confidence, x.relation = 'INVESTIGATED_BY' AND x.force AND NOT y.force AS turned, x.actor_id AS a, y.actor_id AS b
  FROM told x JOIN told y USING (signal_id) WHERE x.actor_id < y.actor_id)
SELECT CASE WHEN turned THEN b ELSE a END AS subject, CASE WHEN turned THEN a ELSE b END AS object, relation, confidence, signal_id FROM pairs WHERE confidence >= 0.15
QUALIFY row_number() OVER (PARTITION BY CASE WHEN turned THEN b ELSE a END, CASE WHEN turned THEN a ELSE b END, relation ORDER BY signal_id) = 1""")
def t33_verb_links(spark, sf):
    """Links of the suppliers of an order by the text of the same number: verb patterns, orientation and confidence; suppliers' confidence goes by their number."""
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("signal_id"), F.split("text", "\n", 2)[0].alias("title"), F.col("text").alias("content"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("actor_id"), F.col("s_name").alias("name"), ((F.col("s_suppkey") % 9 + 1) / F.lit(9.0)).alias("confidence"))
    actors = actor_events(spark, sf).withColumnRenamed("event_id", "signal_id").join(s, "actor_id")
    return relations.verb_links(docs, actors, PATTERNS, ENFORCERS)
