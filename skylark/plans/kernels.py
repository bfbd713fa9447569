"""Kernels over rows of the given tables: cleaning, field parsing, gates, grades and score variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.adapters import SIGNALS, signals, table
from skylark.functions import parse, scores
from skylark.functions import text as T
from skylark.plans.registry import SQL, query


def text(c: str):
    return F.col(c).cast("string")


@query(r"""SELECT doc_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '<[^>]*>', ' ', 'g'), '(?i)(union\s+select|drop\s+table|insert\s+into|delete\s+from|or\s+1=1)', '[REDACTED]', 'g'), '[ \t\r\n]+', ' ', 'g')), 1, 4000) AS clean FROM documents""")
def t02_sanitise(spark, sf):
    """Texts as fields: a field holds 4,000 characters at most, which is the feature."""
    return table(spark, sf, "documents").select("doc_id", parse.sanitised(F.col("text")).alias("clean"))


WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z]+'))"


@query(f"WITH x AS (SELECT p_partkey, {WORDS.format('p_name')} AS a, {WORDS.format('p_type')} AS b FROM part) SELECT p_partkey, CAST(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END AS DOUBLE) AS jaccard FROM x")
def t05_title_jaccard(spark, sf):
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    return table(spark, sf, "part").select("p_partkey", T.jaccard(words("p_name"), words("p_type")).cast("double").alias("jaccard"))


# Patterns of the classifier in order, with class and boost of relevance.
RULES = [("(?i)\\bthe\\b", "CIVIC", 0.2), ("(?i)[0-9]{4}", "TENDER", 0.3), ("(?i)(stupid|idiot)", "UNREST", 0.4), ("(?i)license", "LEGAL", 0.1)]


def _rule_sql(k: int) -> str:
    if k < 0:
        return "CAST(1 AS DOUBLE)"
    return f"CASE WHEN regexp_matches(text, '{RULES[k][0]}') THEN least(CAST(1.5 AS DOUBLE), {_rule_sql(k - 1)} + {RULES[k][2]}) ELSE {_rule_sql(k - 1)} END"


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{c}'" for p, c, _ in reversed(RULES)) + f" ELSE 'GLOBAL' END AS class, round({_rule_sql(len(RULES) - 1)}, 6) AS relevance FROM documents")
def t07_rule_classifier(spark, sf):
    """Later rules override the class of earlier ones; each that holds adds its boost, up to 1.5."""
    name, relevance = F.lit("GLOBAL"), F.lit(1.0)
    for pattern, value, boost in RULES:
        hit = F.coalesce(F.col("text").rlike(pattern), F.lit(False))
        name, relevance = F.when(hit, value).otherwise(name), F.when(hit, F.least(F.lit(1.5), relevance + boost)).otherwise(relevance)
    return table(spark, sf, "documents").select("doc_id", name.alias("class"), F.round(relevance, 6).alias("relevance"))


CUES = [("license", 0.25), ("email", 0.2), ("token", 0.15), ("copyright", 0.1)]


@query("SELECT doc_id, round(least(0.95, 0.25" + "".join(f" + CASE WHEN instr(lower(text), '{w}') > 0 THEN {v} ELSE 0 END" for w, v in CUES) + "), 4) AS confidence FROM documents")
def t09_keyword_confidence(spark, sf):
    low, total = F.lower("text"), F.lit(0.25)
    for w, v in CUES:
        total = total + F.when(low.contains(w), v).otherwise(0.0)
    return table(spark, sf, "documents").select("doc_id", F.round(F.least(F.lit(0.95), total), 4).alias("confidence"))


@query("SELECT p_partkey, split_part(p_name || ' - ' || p_brand, ' - ', 1) AS subject, upper(substr(split_part(p_name || ' - ' || p_brand, ' - ', 2), 1, 3)) || split_part(p_brand, '#', 2) AS region FROM part")
def t10_title_split(spark, sf):
    """Titles of the form `subject - region`, and a code of the region."""
    title = F.concat_ws(" - ", "p_name", "p_brand")
    subject, region = F.substring_index(title, " - ", 1), F.substring_index(title, " - ", -1)
    return table(spark, sf, "part").select("p_partkey", subject.alias("subject"), F.concat(F.upper(F.substring(region, 1, 3)), F.substring_index(region, "#", -1)).alias("region"))


@query()
def t14_sequence_ratio(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_type", parse.sequence_ratio("p_name", F.lower("p_type")).alias("ratio"))


@query("""WITH c AS (SELECT c_custkey, unnest(regexp_extract_all(lower(c_mktsegment), '[a-z]')) AS w FROM customer), d AS (SELECT c_custkey, unnest(regexp_extract_all(lower(c_name), '[a-z]')) AS w FROM customer),
x AS (SELECT c_custkey, w, count(*) AS n FROM c GROUP BY 1, 2), y AS (SELECT c_custkey, w, count(*) AS n FROM d GROUP BY 1, 2), nx AS (SELECT c_custkey, sum(n * n) AS q FROM x GROUP BY 1), ny AS (SELECT c_custkey, sum(n * n) AS q FROM y GROUP BY 1), xy AS (SELECT c_custkey, sum(x.n * y.n) AS q FROM x JOIN y USING (c_custkey, w) GROUP BY 1)
SELECT c_custkey, round(coalesce(xy.q, 0) / sqrt(CAST(nx.q * ny.q AS DOUBLE)), 6) AS cosine FROM nx JOIN ny USING (c_custkey) LEFT JOIN xy USING (c_custkey)""")
def t19_counter_cosine(spark, sf):
    letters = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]"), F.lit(0))
    return table(spark, sf, "customer").select("c_custkey", F.round(parse.counter_cosine(letters("c_mktsegment"), letters("c_name")), 6).alias("cosine"))


ANCHORS = ["ation", "erst", "gaar", "mente", "whre"]


@query("SELECT doc_id, array_to_string(list_filter(['ation', 'erst', 'gaar', 'mente', 'whre'], lambda a: contains(lower(text), a)), ',') AS anchors FROM documents WHERE text IS NOT NULL")
def t22_anchor_extraction(spark, sf):
    names = F.array(*[F.lit(a) for a in ANCHORS])
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.array_join(F.filter(names, lambda a: F.contains(F.lower("text"), a)), ",").alias("anchors"))


@query("""WITH m AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' | D' || (o_custkey % 5)::VARCHAR || ' | C' || (o_orderkey % 9)::VARCHAR AS body, md5(o_orderkey::VARCHAR) AS h FROM orders)
SELECT o_orderkey, body || ' | ' || substr(sha256(body || chr(10) || h), 1, 16) AS mark, 1 AS genuine, 0 AS tampered, split_part(body, ' | ', 3) AS case_mark FROM m""")
def t26_exhibit_marks(spark, sf):
    """Marks of exhibits, which hold for their own hash and for no other."""
    h = F.md5(text("o_orderkey"))
    mark = parse.exhibit_mark(h, F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("D"), (F.col("o_custkey") % 5).cast("string")), F.concat(F.lit("C"), (F.col("o_orderkey") % 9).cast("string")))
    o = table(spark, sf, "orders").select("o_orderkey", mark.alias("mark"), h.alias("h"))
    return o.select("o_orderkey", "mark", parse.exhibit_holds(F.col("mark"), F.col("h")).cast("int").alias("genuine"), parse.exhibit_holds(F.col("mark"), F.reverse("h")).cast("int").alias("tampered"), F.regexp_extract("mark", r" \| (C[0-9]+) \| ", 1).alias("case_mark"))


# Weight of a source's grade and of the information's.
SOURCE_GRADE = {"A": 1.0, "B": 0.8, "C": 0.6, "D": 0.4, "E": 0.2, "F": 0.5}
INFO_GRADE = {1: 1.0, 2: 0.8, 3: 0.6, 4: 0.4, 5: 0.2, 6: 0.5}
SG = "substr('ABCDEF', CAST(signal_id % 6 AS INTEGER) + 1, 1)"


@query(f"WITH {SIGNALS}, g AS (SELECT signal_id, {SG} AS s, CAST(k % 6 + 1 AS INTEGER) AS i FROM signals) SELECT signal_id, s || i::VARCHAR AS grade, round(sqrt(CAST(" + "CASE s " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SOURCE_GRADE.items()) + " END * CASE i " + " ".join(f"WHEN {k} THEN {v}" for k, v in INFO_GRADE.items()) + " END AS DOUBLE)), 6) AS weight FROM g")
def t27_source_grades(spark, sf):
    """Two-part grade and its weight, the geometric mean of both parts'."""
    source = F.substring(F.lit("ABCDEF"), (F.col("signal_id") % 6).cast("int") + 1, F.lit(1))
    info = (F.col("k") % 6 + 1).cast("int")
    look = lambda table_, key: F.create_map(*[F.lit(x) for kv in table_.items() for x in kv])[key]
    weight = F.sqrt(look(SOURCE_GRADE, source) * look(INFO_GRADE, info))
    return signals(spark, sf).select("signal_id", F.concat(source, info.cast("string")).alias("grade"), F.round(weight, 6).alias("weight"))


@query("SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS sentence, upper(substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) AS initials, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 7) || '…' ELSE p_name END AS short FROM part")
def t28_name_forms(spark, sf):
    p = F.col("p_name")
    sentence = F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.char_length(p)))
    initials = F.upper(F.array_join(F.transform(F.slice(F.split(p, " "), 1, 2), lambda w: F.substring(w, 1, 1)), ""))
    short = F.when(F.char_length(p) > 8, F.concat(F.substring(p, 1, 7), F.lit("…"))).otherwise(p)
    return table(spark, sf, "part").select("p_partkey", sentence.alias("sentence"), initials.alias("initials"), short.alias("short"))


@query(f"WITH {SIGNALS} SELECT signal_id, round((CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END) * (CAST(k AS DOUBLE) + CAST(signal_id % 60 AS DOUBLE) / 60 + CAST(actor_id % 60 AS DOUBLE) / 3600), 8) AS decimal_degrees FROM signals")
def t29_degrees(spark, sf):
    d = lambda c: c.cast("double")
    value = parse.degrees(d(F.col("k")), d(F.col("signal_id") % 60), d(F.col("actor_id") % 60), F.when(F.col("k") % 2 == 0, "s").otherwise("N"))
    return signals(spark, sf).select("signal_id", F.round(value, 8).alias("decimal_degrees"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'high' AS level, 1 AS broken_is_null FROM events")
def t30_json_patch(spark, sf):
    """A field read, a field added over one that was there, and a text that isn't JSON read as null."""
    props = F.from_json("props", "map<string,string>")
    patched = F.to_json(F.map_concat(F.map_filter(props, lambda k, v: k != "level"), F.create_map(F.lit("level"), F.lit("high"))))
    broken = F.get_json_object(F.concat(F.lit("{"), "props"), "$.k").isNull().cast("int")
    return table(spark, sf, "events").select("event_id", F.get_json_object(patched, "$.k").cast("long").alias("k"), F.get_json_object(patched, "$.level").alias("level"), broken.alias("broken_is_null"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM events")
def t31_mixed_timestamps(spark, sf):
    """Three formats and one that is none of them."""
    k = F.col("event_id") % 4
    written = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00Z"))).otherwise("soon")
    from skylark.sources.feeds import moment

    return table(spark, sf, "events").select("event_id", moment(written, "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss").alias("parsed"))


@query(
    r"""WITH d AS (SELECT doc_id, text, length(regexp_extract(text, '(?is)^(.*?)the', 1)) AS before FROM documents WHERE regexp_matches(text, '(?i)the'))
SELECT doc_id, substr(trim(regexp_extract(substr(text, 1, before), '[^.\n]*$') || regexp_extract(substr(text, before + 1), '^[^.\n]*')), 1, 250) AS snippet FROM d""",
    also=["t32_snippets_all"],
)
def t32_snippets(spark, sf):
    """The sentence around the first find in each document."""
    return table(spark, sf, "documents").select("doc_id", parse.snippet(F.col("text"), F.lit("the")).alias("snippet")).where("snippet is not null")


# Patterns of relations in order of trust, with weights.
# Whole words: engines differ in what they take for a word's edge next to letters with accents.
RELATIONS = [(rf"(?:^|[^\p{{L}}\p{{N}}_]){word}(?:$|[^\p{{L}}\p{{N}}_])", name, weight) for word, name, weight in (("of", "member_of", 0.9), ("to", "paid", 0.7), ("in", "located_in", 0.5), ("the", "mentioned_with", 0.3))]


def relations(texts, key):
    """The first relation whose pattern is in the text, with its weight."""
    low = F.lower("text")
    first = F.coalesce(*[F.when(low.rlike(p), F.struct(F.lit(r).alias("relation"), F.lit(w).alias("weight"))) for p, r, w in RELATIONS])
    return texts.select(key, first.alias("f")).where("f is not null").select(key, "f.relation", "f.weight")


@query("SELECT item_id, relation, CASE relation " + " ".join(f"WHEN '{r}' THEN CAST({w} AS DOUBLE)" for _, r, w in RELATIONS) + " END AS weight FROM (SELECT item_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{r}'" for p, r, _ in RELATIONS) + " END AS relation FROM benchmark) WHERE relation IS NOT NULL")
def t33_relation_patterns(spark, sf):
    return relations(table(spark, sf, "benchmark"), "item_id")


@query(SQL["t33_relation_patterns"].replace("item_id", "doc_id").replace("benchmark", "documents"))
def t33_relation_patterns_documents(spark, sf):
    return relations(table(spark, sf, "documents"), "doc_id")


@query("SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}')), lambda x: x NOT IN ('To The', 'The Of'))), ';') AS actors FROM documents WHERE text IS NOT NULL")
def t37_title_runs(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.array_join(F.array_sort(parse.title_runs(F.col("text"), ["To The", "The Of"])), ";").alias("actors"))


@query("SELECT o_orderkey, CASE WHEN cents / 1e8 >= 0.01 THEN round(cents / 1e8, 8) END AS millions FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)")
def t41_money(spark, sf):
    """Amounts written with a decimal comma, with thousands parted and in thousands of the unit: all read alike."""
    v, k = F.round(F.col("o_totalprice"), 2), F.col("o_orderkey") % 3
    written = F.when(k == 0, F.concat(F.lit("paid R "), F.replace(F.format_string("%.2f", v), F.lit("."), F.lit(",")))).when(k == 1, F.concat(F.lit("R"), F.format_number(v, 2), F.lit(" in all"))).otherwise(F.concat(F.lit("R "), F.format_string("%.5f", v / 1000), F.lit(" k")))
    return table(spark, sf, "orders").select("o_orderkey", F.round(parse.money(written), 8).alias("millions"))


def amounts(spark, sf):
    """Prices of orders in hundredths, whole units and thousands by turns."""
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") * F.when(F.col("o_orderkey") % 3 == 0, 0.01).when(F.col("o_orderkey") % 3 == 1, 1.0).otherwise(1000.0)).alias("v"))


@query(
    """SELECT o_orderkey, CASE WHEN v >= 1e9 THEN 'R' || printf('%.1f', v / 1e9) || 'B' WHEN v >= 1e6 THEN 'R' || printf('%.1f', v / 1e6) || 'M' WHEN v >= 1e3 THEN 'R' || CAST(floor(v / 1e3) AS BIGINT)::VARCHAR || 'K'
ELSE 'R' || CAST(floor(v) AS BIGINT)::VARCHAR END AS label FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) * CAST(CASE o_orderkey % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 1 ELSE 1000 END AS DOUBLE) AS v FROM orders)""",
    also=["t45_money_labels_all"],
)
def t45_money_labels(spark, sf):
    """Labels of all amounts, from single units to billions."""
    return amounts(spark, sf).select("o_orderkey", parse.money_label(F.col("v")).alias("label"))


@query("SELECT doc_id, round(CASE WHEN d > 0 THEN 0.35 * least(1, 0.6 + 0.1 * ln(1 + d)) ELSE 0 END + CASE WHEN h > 0 THEN 0.30 * least(1, 0.6 + 0.1 * ln(1 + h)) ELSE 0 END, 3) AS confidence FROM (SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS d, len(regexp_extract_all(text, '#')) AS h FROM documents WHERE text IS NOT NULL)")
def t44_diversity_confidence(spark, sf):
    """Kinds of evidence count by weight, and within a kind by the logarithm of their number."""

    def part(pattern, weight):
        n = F.regexp_count("text", F.lit(pattern))
        return F.when(n > 0, weight * F.least(F.lit(1.0), 0.6 + 0.1 * F.log(1.0 + n))).otherwise(0.0)

    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.round(part("[0-9]+", 0.35) + part("#", 0.30), 3).alias("confidence"))


@query("SELECT o_orderkey, 'Customer#' || o_custkey::VARCHAR AS first_party, CASE WHEN o_orderkey % 3 = 2 THEN 3 ELSE 2 END AS n FROM orders")
def t47_parties(spark, sf):
    joiner = F.when(F.col("o_orderkey") % 3 == 0, " v ").when(F.col("o_orderkey") % 3 == 1, " Versus ").otherwise(" & Others; ")
    got = parse.parties(F.concat(F.lit("Customer#"), text("o_custkey"), joiner, F.lit("The State")))
    return table(spark, sf, "orders").select("o_orderkey", got[0].alias("first_party"), F.size(got).alias("n"))


REFUSED = r"CASE WHEN name IS NULL OR trim(name) = '' THEN 'empty' WHEN name IN ('EFF', 'ANC', 'SAPS', 'NPA') THEN NULL WHEN length(name) < 4 THEN 'short' WHEN length(name) > 80 THEN 'long' WHEN len(regexp_extract_all(name, '[0-9]')) * 10 > length(name) * 6 THEN 'digits' WHEN regexp_matches(name, '(?i)(home page|\| |\.com$|log in)') THEN 'site title' WHEN NOT regexp_matches(name, '[A-Z]') THEN 'lower case' WHEN NOT regexp_matches(name, '[ #]') THEN 'one word' END"


@query(f"WITH n AS (SELECT c_name AS name FROM customer UNION ALL SELECT p_name FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT o_orderkey::VARCHAR || 'A' FROM orders UNION ALL SELECT p_brand || ' home page' FROM part) SELECT coalesce({REFUSED}, 'kept') AS reason, count(*) AS n FROM n GROUP BY 1")
def t48_entity_gate(spark, sf):
    p, name = table(spark, sf, "part"), lambda t, c: t.select(c.alias("name"))
    names = name(table(spark, sf, "customer"), F.col("c_name")).unionByName(name(p, F.col("p_name"))).unionByName(name(p, F.col("p_type")))
    names = names.unionByName(name(table(spark, sf, "orders"), F.concat(text("o_orderkey"), F.lit("A")))).unionByName(name(p, F.concat("p_brand", F.lit(" home page"))))
    return names.groupBy(F.coalesce(parse.entity_refusal(F.col("name")), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SIGNALS} SELECT signal_id, CASE source WHEN 'error' THEN 'usgs:' || signal_id::VARCHAR WHEN 'signup' THEN 'court_roll:' || substr(sha256(signal_id::VARCHAR), 1, 16) WHEN 'purchase' THEN 'treasury:' || substr(sha1(signal_id::VARCHAR), 1, 16) ELSE 'ndbc:' || actor_id::VARCHAR || ':' || strftime(ts, '%Y%m%d%H%M') END AS external_id FROM signals")
def t51_dedupe_keys(spark, sf):
    """Keys by source that come out alike on every run."""
    i = text("signal_id")
    key = F.when(F.col("source") == "error", F.concat(F.lit("usgs:"), i)).when(F.col("source") == "signup", F.concat(F.lit("court_roll:"), F.substring(F.sha2(i, 256), 1, 16))).when(F.col("source") == "purchase", F.concat(F.lit("treasury:"), F.substring(F.sha1(i), 1, 16)))
    return signals(spark, sf).select("signal_id", F.coalesce(key, F.concat_ws(":", F.lit("ndbc"), text("actor_id"), F.date_format("ts", "yyyyMMddHHmm"))).alias("external_id"))


@query(f"""WITH {SIGNALS} SELECT signal_id, round(CASE source WHEN 'error' THEN least(0.55, 0.40 + CASE WHEN k >= 50 THEN 0.15 ELSE 0 END + CASE WHEN is_priority = 1 THEN 0.10 ELSE 0 END) WHEN 'signup' THEN least(0.65, 0.15 + CASE WHEN k >= 25 THEN 0.20 ELSE 0 END + CASE WHEN k >= 50 THEN 0.10 ELSE 0 END + CASE WHEN is_priority = 1 THEN 0.15 ELSE 0 END) ELSE least(0.75, CAST(k AS DOUBLE) / 100 / 2) END, 6) AS gravity FROM signals""")
def t50_source_gravity(spark, sf):
    """Gravity of records whose source has a rule of its own: a start, additions for what is present, a cap."""
    k, p = F.col("k"), F.col("is_priority") == 1
    add = lambda c, v: F.when(c, v).otherwise(0.0)
    court = F.least(F.lit(0.55), 0.40 + add(k >= 50, 0.15) + add(p, 0.10))
    ruling = F.least(F.lit(0.65), 0.15 + add(k >= 25, 0.20) + add(k >= 50, 0.10) + add(p, 0.15))
    value = F.when(F.col("source") == "error", court).when(F.col("source") == "signup", ruling).otherwise(F.least(F.lit(0.75), k.cast("double") / 100 / 2))
    return signals(spark, sf).select("signal_id", F.round(value, 6).alias("gravity"))


@query(f"WITH {SIGNALS} SELECT signal_id, round(greatest(0.0, least(1.0, (0.5 * (0.9 + 0.1 * CAST(k AS DOUBLE) / 100)) * (1 + 0.0) + least(0.05 * floor(k / 10), 0.15))), 6) AS gravity, round(0.5 * 0.4 + 0.5 * least(CAST(k AS DOUBLE) / 50, 1.0), 6) AS rebuilt FROM signals WHERE source = 'error'")
def g02_conflict_gravity(spark, sf):
    """Conflict records: momentum by frequency, an addition for each ten victims up to three tens, and a value rebuilt from the count alone."""
    k = F.col("k").cast("double")
    gravity = scores.clamp(0.5 * (0.9 + 0.1 * k / 100) + F.least(0.05 * F.floor(k / 10), F.lit(0.15)))
    return signals(spark, sf).where("source = 'error'").select("signal_id", F.round(gravity, 6).alias("gravity"), F.round(0.2 + 0.5 * F.least(k / 50, F.lit(1.0)), 6).alias("rebuilt"))


@query(f"WITH {SIGNALS} SELECT signal_id, CASE WHEN source = 'error' THEN 'incident' WHEN source = 'purchase' THEN 'finance' ELSE 'general' END AS event_type, least(0.3 * (actor_id % 5), 1.0)::DOUBLE AS importance, round(CASE WHEN k >= 50 THEN 0.4 ELSE 0.2 END + 0.3 * is_priority, 4)::DOUBLE AS frequency FROM signals")
def g08_interpretation(spark, sf):
    kind = F.when(F.col("source") == "error", "incident").when(F.col("source") == "purchase", "finance").otherwise("general")
    frequency = F.when(F.col("k") >= 50, 0.4).otherwise(0.2) + 0.3 * F.col("is_priority")
    return signals(spark, sf).select("signal_id", kind.alias("event_type"), F.least(0.3 * (F.col("actor_id") % 5), F.lit(1.0)).alias("importance"), F.round(frequency, 4).alias("frequency"))


@query(f"WITH {SIGNALS} SELECT signal_id, round(least(0.55, least(0.24, 0.004 * k) + least(0.12, 0.03 * (actor_id % 7)) + least(0.15, value / 1000) + CASE WHEN is_priority = 1 THEN 0.10 ELSE 0 END), 6) AS gravity FROM signals WHERE source = 'click' AND value IS NOT NULL")
def g58_behaviour_gravity(spark, sf):
    """Four capped parts of behaviour, together at most 0.55."""
    capped = lambda top, c: F.least(F.lit(top), c)
    total = capped(0.24, 0.004 * F.col("k")) + capped(0.12, 0.03 * (F.col("actor_id") % 7)) + capped(0.15, F.col("value") / 1000) + F.when(F.col("is_priority") == 1, 0.10).otherwise(0.0)
    return signals(spark, sf).where("source = 'click' and value is not null").select("signal_id", F.round(capped(0.55, total), 6).alias("gravity"))
