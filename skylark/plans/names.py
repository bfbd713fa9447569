"""Names: mentions, resolution, gates, entities by rule, and the edges that come of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.adapters import table
from skylark.operators import automaton, joins
from skylark.operators import names as N
from skylark.plans.registry import query


def count():
    return F.count(F.lit(1))


def item_names(spark, sf, words: int = 2):
    """Names to look for: how the benchmark's texts begin, of two words and of one more for every third."""
    w = N.words_of(F.col("text"))
    n = F.when(F.col("item_id") % 3 == 0, words + 1).otherwise(words)
    return table(spark, sf, "benchmark").where(F.size(w) > words).select(F.col("item_id").alias("name_id"), F.array_join(F.slice(w, F.lit(1), n), " ").alias("name"))


def named_documents(spark, sf):
    return N.mentions(table(spark, sf, "documents").select("doc_id", "text"), item_names(spark, sf))


#: Words with their places meet the names that begin with them; from left to right, of equal places the longest name is taken and the next begins after it.
MENTIONS = r"""WITH RECURSIVE named AS (
  SELECT item_id AS name_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
names AS (
  SELECT min(name_id) AS name_id, run, len(run) AS n
  FROM (SELECT name_id, w[1:CASE WHEN name_id % 3 = 0 THEN 3 ELSE 2 END] AS run FROM named WHERE len(w) > 2) GROUP BY run),
texts AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
hits AS (SELECT doc_id, i - 1 AS place, name_id, n FROM places JOIN names ON w[i] = run[1] WHERE w[i:i + n - 1] = run),
taken(doc_id, place, name_id, n) AS (
  SELECT doc_id, place, name_id, n FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place, n DESC) = 1
  UNION ALL
  SELECT doc_id, place, name_id, n
  FROM (SELECT h.*, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.place, h.n DESC) AS r FROM taken t JOIN hits h ON h.doc_id = t.doc_id AND h.place >= t.place + t.n)
  WHERE r = 1)
SELECT doc_id, place, name_id FROM taken"""


@query(MENTIONS)
def j17_name_mentions(spark, sf):
    return named_documents(spark, sf)


@query()
def t38_mention_links(spark, sf):
    """Links between the texts whose names they mention, own names apart."""
    found = N.mentions(table(spark, sf, "documents").select("doc_id", "text"), item_names(spark, sf, 1))
    return found.where("doc_id <> name_id").groupBy(F.col("doc_id").alias("source"), F.col("name_id").alias("target")).agg(count().alias("n"))


CASE_COUNT = 20


@query(f"""WITH a AS (
  SELECT item_id AS actor_id, item_id % {CASE_COUNT} AS case_id, lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) AS name, lower(split_part(text, ' ', 2)) AS surname
  FROM benchmark WHERE item_id % 3 <> 0 AND split_part(text, ' ', 2) <> '')
SELECT doc_id AS signal_id, actor_id FROM documents JOIN a ON doc_id % {CASE_COUNT} = case_id AND (contains(lower(text), name) OR contains(lower(text), surname))""")
def g73_case_text_links(spark, sf):
    """Actors without links get those of their cases' texts that hold the full name or the surname anywhere. Items stand for actors, named by two words; a third of them have links already."""
    w = F.split("text", " ")
    actors = table(spark, sf, "benchmark").where("item_id % 3 <> 0").select(F.col("item_id").alias("actor_id"), (F.col("item_id") % CASE_COUNT).alias("case_id"), F.get(w, F.lit(0)).alias("given"), F.get(w, F.lit(1)).alias("surname")).where("surname <> ''")
    named = actors.select("actor_id", "case_id", F.explode(F.array(F.lower(F.concat_ws(" ", "given", "surname")), F.lower("surname"))).alias("name"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = automaton.held_by(docs, named.select("name")).withColumn("case_id", F.col("doc_id") % CASE_COUNT)
    return found.join(named, ["case_id", "name"]).select(F.col("doc_id").alias("signal_id"), "actor_id").distinct()


@query()
def g64_mention_bridge(spark, sf):
    """Edges of names and the texts that hold them, and of names that share a text."""
    found = named_documents(spark, sf).select("doc_id", "name_id").distinct()
    match = found.select(F.col("name_id").alias("a"), F.col("doc_id").alias("b"), F.lit("osint_match").alias("relation"), F.lit(0.95).alias("confidence"))
    pairs = joins.shared_key_pairs(found, "name_id", "doc_id").select("a", "b", F.lit("co_occurrence").alias("relation"), F.lit(0.85).alias("confidence"))
    return match.unionByName(pairs)


@query()
def j18_resolved_names(spark, sf):
    """The beginnings of all texts, resolved against those of the benchmark's."""
    head = lambda n: F.array_join(F.slice(F.split(F.regexp_replace(F.trim("text"), r"\s+", " "), " "), 1, n), " ")
    q = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("query_id"), head(3).alias("name"))
    return N.resolved(q, table(spark, sf, "benchmark").select(F.col("item_id").alias("actor_id"), head(3).alias("name")), least=0.85)


GENERIC = ["red", "blue", "widget", "small", "gizmo"]
NORMAL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH c AS (SELECT p_partkey AS company_id, {NORMAL.format("CASE WHEN p_size < 5 THEN p_name ELSE p_brand || ' ' || p_name END")} AS c FROM part), a AS (SELECT min(p_partkey) AS actor_id, {NORMAL.format('p_name')} AS a FROM part GROUP BY p_name),
exact AS (SELECT company_id, actor_id FROM c JOIN a ON c = a WHERE length(c) >= 4)
SELECT company_id, actor_id, 'exact' AS how FROM exact UNION ALL SELECT company_id, actor_id, 'substring' FROM c JOIN a ON length(c) >= 4 AND length(a) >= 8 AND (contains(c, a) OR contains(a, c)) WHERE company_id NOT IN (SELECT company_id FROM exact)
AND len(list_filter(string_split(CASE WHEN contains(c, a) THEN a ELSE c END, ' '), lambda w: NOT list_contains({GENERIC}, w))) > 0""")
def j19_company_matches(spark, sf):
    p = table(spark, sf, "part")
    company = p.select(F.col("p_partkey").alias("company_id"), F.when(F.col("p_size") < 5, F.col("p_name")).otherwise(F.concat_ws(" ", "p_brand", "p_name")).alias("name"))
    return N.contained(company, p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("actor_id")), GENERIC)


ARTEFACT = r"<[^>]+>|&#?[a-z0-9]+;|&nbsp|\x{00A0}"
SITE = r"(?i)(\s-\s.*\.(gov|co|org|com|net)\.(za|uk|us)$|\.(gov|co|org|com|net)\.(za|uk)$)"


def gated(names, acronyms, noise, media):
    """names (name) with `reason`: the first of seven gates that refuses it, or null. acronyms, noise and media are tables (name): initials that pass the gates for short names, words that are
    no names, and outlets.
    """
    bare = F.trim("name")
    letters = F.regexp_replace(bare, r"\W", "")
    plain = F.regexp_replace(F.lower(bare), r"^['\".,;: ]+|['\".,;: ]+$", "")
    base = F.trim(F.regexp_replace(plain, r"'s?$", ""))
    x = names.withColumns({"_bare": bare, "_letters": letters, "_plain": plain, "_base": base})

    def flag(df, keys, words, name):
        known = words.select(F.col("name").alias("_w")).distinct().withColumn(name, F.lit(True))
        for k, key in enumerate(keys):
            df = df.join(known.withColumnRenamed(name, f"{name}{k}"), F.col(key) == F.col("_w"), "left").drop("_w")
        return df.withColumn(name, F.coalesce(*[F.col(f"{name}{k}") for k in range(len(keys))], F.lit(False)))

    x = flag(x.withColumn("_upper", F.upper("_letters")), ["_upper"], acronyms, "_acronym")
    x = flag(flag(x, ["_plain", "_base"], noise, "_noise"), ["_plain", "_base"], media, "_media")
    n = F.char_length("_bare")
    capitals = (F.col("_letters") == F.col("_upper")) & (F.col("_letters") != F.lower("_letters"))
    reason = (
        F.when(~F.col("_acronym") & (n < 4), "too_short")
        .when(n > 120, "too_long")
        .when(F.col("_bare").rlike(ARTEFACT), "html_artefact")
        .when(F.col("_noise"), "noise_set")
        .when(~F.col("_acronym") & capitals & (F.char_length("_letters") <= 3), "short_acronym")
        .when(F.regexp_count("_bare", F.lit("[0-9]")) / F.greatest(n, F.lit(1)) > 0.6, "digit_heavy")
        .when(F.col("_bare").rlike(SITE), "webpage_title")
        .when(F.col("_media"), "media_outlet")
    )
    return x.select(*names.columns, reason.alias("reason"))


GATE_NAMES = """SELECT c_name AS name FROM customer UNION ALL SELECT p_name FROM part UNION ALL SELECT p_type || '''s' FROM part UNION ALL SELECT o_orderkey::VARCHAR || 'A' FROM orders UNION ALL SELECT p_brand || ' - home - x.gov.za' FROM part
UNION ALL SELECT 'b' || p_size::VARCHAR || '.co.za' FROM part UNION ALL SELECT substr(p_type, 1, 3) FROM part UNION ALL SELECT substr(c_mktsegment, 1, 3) FROM customer UNION ALL SELECT '"' || r_name || '"' FROM region UNION ALL SELECT '<b>' || n_name || '</b>' FROM nation
UNION ALL SELECT repeat(p_name, 13) FROM part UNION ALL SELECT 'A.B.' || p_size::VARCHAR FROM part"""
RE_ARTEFACT, RE_SITE = ARTEFACT, SITE
GATE_SQL = f"""WITH n AS ({GATE_NAMES}), x AS (SELECT trim(name) AS b, regexp_replace(trim(name), '\\W', '', 'g') AS l, regexp_replace(lower(trim(name)), '^[''".,;: ]+|[''".,;: ]+$', '', 'g') AS p FROM n), y AS (SELECT *, trim(regexp_replace(p, '''s?$', '')) AS base, upper(l) IN (SELECT upper(substr(c_mktsegment, 1, 3)) FROM customer) AS acr FROM x)
SELECT coalesce(CASE WHEN NOT acr AND length(b) < 4 THEN 'too_short' WHEN length(b) > 120 THEN 'too_long' WHEN regexp_matches(b, '{RE_ARTEFACT}') THEN 'html_artefact' WHEN p IN (SELECT lower(p_type) FROM part) OR base IN (SELECT lower(p_type) FROM part) THEN 'noise_set'
WHEN NOT acr AND l = upper(l) AND l <> lower(l) AND length(l) <= 3 THEN 'short_acronym' WHEN len(regexp_extract_all(b, '[0-9]')) / greatest(length(b), 1) > 0.6 THEN 'digit_heavy' WHEN regexp_matches(b, '{RE_SITE}') THEN 'webpage_title'
WHEN p IN (SELECT lower(r_name) FROM region) OR base IN (SELECT lower(r_name) FROM region) THEN 'media_outlet' END, 'kept') AS reason, count(*) AS n FROM y GROUP BY 1"""


@query(GATE_SQL)
def t48_seven_gates(spark, sf):
    """How many names each gate refuses."""
    p, c, r = (table(spark, sf, t) for t in ("part", "customer", "region"))
    one = lambda df, e: df.select(e.cast("string").alias("name"))
    col, size = F.col, F.col("p_size").cast("string")
    parts = [one(c, col("c_name")), one(p, col("p_name")), one(p, F.concat("p_type", F.lit("'s"))), one(table(spark, sf, "orders"), F.concat(col("o_orderkey").cast("string"), F.lit("A"))), one(p, F.concat("p_brand", F.lit(" - home - x.gov.za")))]
    parts += [one(p, F.concat(F.lit("b"), size, F.lit(".co.za"))), one(p, F.substring("p_type", 1, 3)), one(c, F.substring("c_mktsegment", 1, 3)), one(r, F.concat(F.lit('"'), "r_name", F.lit('"')))]
    parts += [one(table(spark, sf, "nation"), F.concat(F.lit("<b>"), "n_name", F.lit("</b>"))), one(p, F.repeat("p_name", F.lit(13))), one(p, F.concat(F.lit("A.B."), size))]
    names = parts[0]
    for part in parts[1:]:
        names = names.unionByName(part)
    found = gated(names, one(c, F.upper(F.substring("c_mktsegment", 1, 3))), one(p, F.lower("p_type")), one(r, F.lower("r_name")))
    return found.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(count().alias("n"))


REGISTRY = [("MAIL", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"), ("ADDRESS", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), ("LICENSE", r"(?i)licen[cs]e"), ("YEAR", r"\b(?:19|20)[0-9]{2}\b")]


@query(" UNION ALL ".join(f"SELECT doc_id, e AS entity, '{kind}' AS kind, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{rx}')) AS e FROM documents) GROUP BY 1, 2" for kind, rx in REGISTRY))
def t36_registry_entities(spark, sf):
    """Entities by the patterns of a register, with their kinds."""
    t = F.col("text")

    def found(kind, rx):
        return F.transform(F.regexp_extract_all(t, F.lit(rx), F.lit(0)), lambda e: F.struct(e.alias("entity"), F.lit(kind).alias("kind")))

    every = F.concat(*[found(kind, rx) for kind, rx in REGISTRY])
    return table(spark, sf, "documents").select("doc_id", F.explode(every).alias("e")).groupBy("doc_id", "e.entity", "e.kind").agg(count().alias("n")).select("doc_id", "entity", "kind", "n")


RUNS = "[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}"
ORGS = "(Ltd|Inc|Department|Group|Tion|Heit|Keit)$"


@query(f"WITH r AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{RUNS}'))) AS entity FROM documents) SELECT doc_id, entity, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE lower(n_name) = lower(entity)) THEN 'GPE' WHEN regexp_matches(entity, '{ORGS}') THEN 'ORG' ELSE 'PERSON' END AS label FROM r")
def t34_rule_entities(spark, sf):
    """Runs of capitalised words, labelled by a gazetteer, then by what they end in; a rule in place of a trained recogniser, whose results would be a table like this one."""
    runs = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(RUNS), F.lit(0)))).alias("entity"))
    places = table(spark, sf, "nation").select(F.lower("n_name").alias("_place")).distinct()
    label = F.when(F.col("_place").isNotNull(), "GPE").when(F.col("entity").rlike(ORGS), "ORG").otherwise("PERSON")
    return runs.join(places, F.lower("entity") == F.col("_place"), "left").select("doc_id", "entity", label.alias("label"))


@query("SELECT c_custkey, 'https://www.google.com/search?q=' || replace(url_encode('\"' || c_name || '\" ' || c_mktsegment || ' site:gov.za'), '%20', '+') AS url FROM customer")
def t42_search_links(spark, sf):
    text = F.concat(F.lit('"'), "c_name", F.lit('" '), "c_mktsegment", F.lit(" site:gov.za"))
    return table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("https://www.google.com/search?q="), F.url_encode(text)).alias("url"))


ENTITIES = "entities AS (SELECT l_orderkey AS signal_id, 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') AS name, CASE WHEN l_linenumber <= 2 THEN 'PERSON' WHEN l_linenumber <= 4 THEN 'ORG' ELSE 'GPE' END AS label, l_discount * 10 AS confidence FROM lineitem)"


def entities(spark, sf):
    """(signal_id, name, label, confidence): lines as recognised entities."""
    label = F.when(F.col("l_linenumber") <= 2, "PERSON").when(F.col("l_linenumber") <= 4, "ORG").otherwise("GPE")
    name = F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("signal_id"), name.alias("name"), label.alias("label"), (F.col("l_discount") * 10).alias("confidence"))


@query(f"""WITH {ENTITIES}, named AS (SELECT DISTINCT signal_id, label, s_suppkey AS actor FROM entities JOIN supplier ON s_name = name)
SELECT p.actor AS person, o.actor AS organisation, count(*) AS signals, 0.5 AS weight FROM named p JOIN named o ON p.signal_id = o.signal_id AND p.label = 'PERSON' AND o.label = 'ORG' AND p.actor <> o.actor GROUP BY 1, 2""")
def g48_memberships(spark, sf):
    """Persons and organisations that a signal names together, where both are known actors."""
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("actor"))
    named = entities(spark, sf).join(s, "name").select("signal_id", "label", "actor").distinct()
    side = lambda label, name: named.where(F.col("label") == label).select("signal_id", F.col("actor").alias(name))
    both = side("PERSON", "person").join(side("ORG", "organisation"), "signal_id").where("person <> organisation")
    return both.groupBy("person", "organisation").agg(count().alias("signals")).withColumn("weight", F.lit(0.5))


@query(f"WITH {ENTITIES}, known AS (SELECT s_name FROM supplier WHERE s_acctbal > 5000), blocked AS (SELECT s_name FROM supplier WHERE s_acctbal < 0) SELECT lower(name) AS name, count(*) AS frequency, min(label) AS label FROM entities WHERE label IN ('PERSON', 'ORG') AND name NOT IN (SELECT s_name FROM known) AND name NOT IN (SELECT s_name FROM blocked) GROUP BY lower(name) HAVING count(*) >= 2")
def g43_named_actors(spark, sf):
    """Names met twice or more that aren't actors yet nor blocked; suppliers of a high balance stand for the known ones."""
    s = table(spark, sf, "supplier")
    gone = s.where("s_acctbal > 5000 or s_acctbal < 0").select(F.col("s_name").alias("name"))
    seen = entities(spark, sf).where(F.col("label").isin("PERSON", "ORG")).join(gone, "name", "left_anti")
    return seen.groupBy(F.lower("name").alias("name")).agg(count().alias("frequency"), F.min("label").alias("label")).where("frequency >= 2")


@query(f"""WITH {ENTITIES}, best AS (SELECT name, max(confidence) AS c, arg_max(label, (confidence, label)) AS label FROM entities GROUP BY 1)
SELECT name, label, round(CASE WHEN s_acctbal > 9000 THEN least(1.0, c + 0.05) ELSE c END, 4) AS confidence FROM best LEFT JOIN supplier ON s_name = name WHERE c >= 0.20 AND name NOT IN (SELECT s_name FROM supplier WHERE s_acctbal < 0)""")
def g49_materialised_entities(spark, sf):
    """Entities of enough confidence that aren't blocked; those on the watch list gain a little, once."""
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("b"))
    best = entities(spark, sf).groupBy("name").agg(F.max("confidence").alias("c"), F.max_by("label", F.struct("confidence", "label")).alias("label")).where("c >= 0.20")
    kept = best.join(s.where("b < 0").select("name"), "name", "left_anti").join(s, "name", "left")
    return kept.select("name", "label", F.round(F.when(F.col("b") > 9000, F.least(F.lit(1.0), F.col("c") + 0.05)).otherwise(F.col("c")), 4).alias("confidence"))
