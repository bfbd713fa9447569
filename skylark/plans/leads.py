"""Leads: latent seeds, enriched reports, rules of gravity for texts, actors to search for, the whole ranked feed, names of persons, dossiers, communities by labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.adapters import REPORTS, SIGNALS, part_links, reports, signals, table
from skylark.functions import parse
from skylark.functions import text as T
from skylark.operators import graph, joins, louvain
from skylark.plans.engines import PAIRS_SQL, best_correlated, gravity, relevance
from skylark.plans.engines import GRAVITY as GRAVITY_SQL
from skylark.plans.engines import RELEVANCE as RELEVANCE_SQL
from skylark.plans.registry import query
from skylark.session import checkpointed


def count():
    return F.count(F.lit(1))


TAGGED = """e AS (SELECT event_id, CAST(ts AS DATE) AS day FROM events), m AS (SELECT min(event_id) AS low, max(event_id) AS high FROM events),
dated AS (SELECT day AS pulse, lang AS seed, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents, m JOIN e ON event_id = low + doc_id % (high - low + 1) WHERE lang IS NOT NULL),
c AS (SELECT pulse, seed, tag, count(*) AS n FROM (SELECT pulse, seed, unnest(w) AS tag FROM dated) GROUP BY 1, 2, 3), t AS (SELECT seed, count(*) AS total FROM dated GROUP BY 1)"""


def tagged(spark, sf):
    """(pulse, seed, w): the words of each document under its language, on the day of the event that it is dealt to."""
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("pulse"))
    low, high = e.agg(F.min("event_id"), F.max("event_id")).first()
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    d = table(spark, sf, "documents").where("lang is not null").select(F.col("lang").alias("seed"), words.alias("w"), (F.lit(low) + F.col("doc_id") % (high - low + 1)).alias("event_id"))
    return d.join(e, "event_id").select("pulse", "seed", "w")


def latent_seeds(counts, totals, depths, rate: float = 0.30, least: int = 3, deepest: int = 2):
    """(tag, parent_seed, discovery_depth, jaccard_score, velocity, total_count) of tags that go with a seed at the rate or more.

    counts: (pulse, seed, tag, n). totals: (seed, total), the texts of a seed. depths: (seed, depth) of seeds that were found themselves, others count as 0; a tag lies one
    deeper, at most `deepest`. Velocity is the tag's count in the latest pulse by that in the one before it, 1 for tags under `least` in all. Of several seeds the last by
    name is the parent, and the first gives the depth.
    """
    pulses = [r.pulse for r in counts.select("pulse").distinct().orderBy(F.desc("pulse")).limit(2).collect()]
    of = lambda k: F.sum(F.when(F.col("pulse") == F.lit(pulses[k]), F.col("n")).otherwise(0))
    now, before = (of(0), of(1)) if len(pulses) == 2 else (F.lit(0), F.lit(0))
    tags = counts.groupBy("tag").agg(F.sum("n").alias("all"), now.alias("now"), before.alias("before"))
    pairs = counts.groupBy("seed", "tag").agg(F.sum("n").alias("co")).join(totals, "seed").where(F.col("co") / F.col("total") >= rate)
    x = pairs.join(tags, "tag").join(depths, "seed", "left").withColumn("depth", F.coalesce("depth", F.lit(0)) + 1).where(F.col("depth") <= deepest)
    union = F.col("total") + F.col("all") - F.col("co")
    jaccard = F.when(union > 0, F.round(F.col("co") / union, 4)).otherwise(0.0)
    pace = F.when(F.lit(len(pulses) < 2) | (F.col("all") < least), 1.0).when(F.col("before") > 0, F.round(F.col("now") / F.col("before"), 4)).when(F.col("now") > 0, F.col("now").cast("double")).otherwise(1.0)
    last = F.max_by(F.struct(F.col("seed").alias("parent_seed"), jaccard.alias("jaccard_score"), pace.alias("velocity"), F.col("co").alias("total_count")), "seed")
    return x.groupBy("tag").agg(last.alias("l"), F.min_by("depth", "seed").alias("discovery_depth")).select("tag", "discovery_depth", "l.*")


@query(f"""WITH {TAGGED}, k AS (SELECT pulse, row_number() OVER (ORDER BY pulse DESC) AS r FROM (SELECT DISTINCT pulse FROM c)),
v AS (SELECT tag, sum(n) AS al, coalesce(sum(n) FILTER (WHERE r = 1), 0) AS now_n, coalesce(sum(n) FILTER (WHERE r = 2), 0) AS bef FROM c JOIN k USING (pulse) GROUP BY 1),
p AS (SELECT seed, tag, sum(n) AS co, any_value(total) AS total FROM c JOIN t USING (seed) GROUP BY 1, 2 HAVING sum(n) / any_value(total) >= 0.30),
f AS (SELECT tag, seed, co, round(CAST(co AS DOUBLE) / (total + al - co), 4) AS j, CASE WHEN al < 3 THEN 1.0 WHEN bef > 0 THEN round(CAST(now_n AS DOUBLE) / bef, 4) WHEN now_n > 0 THEN now_n ELSE 1.0 END::DOUBLE AS v,
row_number() OVER (PARTITION BY tag ORDER BY seed DESC) AS r FROM p JOIN v USING (tag) WHERE seed <> (SELECT max(lang) FROM documents))
SELECT tag, seed AS parent_seed, 1 AS discovery_depth, j AS jaccard_score, v AS velocity, CAST(co AS BIGINT) AS total_count FROM f WHERE r = 1""")
def g35_latent_seeds(spark, sf):
    """Words as tags, languages as seeds; the last language by name stands for a seed that lies as deep as seeds may."""
    d = checkpointed(tagged(spark, sf))
    counts = d.select("pulse", "seed", F.explode("w").alias("tag")).groupBy("pulse", "seed", "tag").agg(count().alias("n"))
    depths = table(spark, sf, "documents").agg(F.max("lang").alias("seed")).select("seed", F.lit(2).alias("depth"))
    return latent_seeds(counts, d.groupBy("seed").agg(count().alias("total")), depths)


def enriched(found, severity, credibility, priority, known):
    """Of a report with so many entities: (gravity, recommendation, confidence); urgency counts one half."""
    frequency = F.least(F.when(known, 0.5).otherwise(0.2) + 0.3 * priority, F.lit(1.0))
    base = 0.35 * severity + 0.25 * F.least(found * 0.25, F.lit(1.0)) + 0.15 * frequency + 0.15 * 0.5 + 0.10 * credibility
    value = F.round(F.least(base * (0.8 + 0.2 * frequency), F.lit(1.0)), 4)
    sure = F.least(found * 0.12, F.lit(0.40)) + credibility * 0.35 + severity * 0.15 + 0.10 * priority
    return value, F.when(value >= 0.55, "ESCALATE").when(value >= 0.35, "MONITOR").otherwise("IGNORE"), F.round(F.least(sure, F.lit(1.0)), 3)


@query(f"""WITH {REPORTS}, x AS (SELECT signal_id, is_priority AS p, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+){{1,2}}'))) AS n, CAST(least(coalesce(value, 0) / 200.0, 1.0) AS DOUBLE) AS s, source IN ('src0', 'src1', 'src2') IS TRUE AS known FROM reports),
y AS (SELECT *, CASE WHEN known THEN 0.9 ELSE 0.5 END::DOUBLE AS c, least(CASE WHEN known THEN 0.5 ELSE 0.2 END + 0.3 * p, 1.0)::DOUBLE AS f FROM x WHERE n > 0),
z AS (SELECT *, round(least((0.35 * s + 0.25 * least(n * 0.25, 1.0) + 0.15 * f + 0.075 + 0.10 * c)::DOUBLE * (0.8 + 0.2 * f), 1.0), 4) AS gravity FROM y)
SELECT signal_id, n AS entities, gravity, CASE WHEN gravity >= 0.55 THEN 'ESCALATE' WHEN gravity >= 0.35 THEN 'MONITOR' ELSE 'IGNORE' END AS recommendation, round(least(least(n * 0.12, 0.40)::DOUBLE + c * 0.35 + s * 0.15 + 0.10 * p, 1.0), 3) AS confidence FROM z""")
def g57_signal_enrichment(spark, sf):
    """Reports whose text holds entities (runs of capitalised words), with gravity and confidence; those without any give no row."""
    x = reports(spark, sf).withColumn("entities", F.size(parse.title_runs(F.col("text"), [""]))).where("entities > 0")
    known = F.coalesce(F.col("source").isin("src0", "src1", "src2"), F.lit(False))
    severity = F.least(F.coalesce("value", F.lit(0.0)) / 200.0, F.lit(1.0))
    value, advice, sure = enriched(F.col("entities"), severity, F.when(known, 0.9).otherwise(0.5), F.col("is_priority"), known)
    return x.select("signal_id", "entities", value.alias("gravity"), advice.alias("recommendation"), sure.alias("confidence"))


def holds(text, words):
    """How many of the words lie within the lower-cased text."""
    total = F.lit(0)
    for w in words:
        total = total + F.coalesce(F.contains(text, F.lit(w)), F.lit(False)).cast("int")
    return total


# Stand-ins, in invented prose, for the names and terms that a user gives.
ACTORS, KEYWORDS, CAUSES = ("data", "water", "north"), ("time", "power"), ((("light",), 0.25), (("house", "stone"), 0.20), (("river",), 0.10), (("world", "green"), 0.12), (("people",), 0.08))


def hearing_gravity(text, portfolio, actors):
    return F.least(0.25 + F.when(portfolio, 0.10).otherwise(0.0) + F.when(holds(text, actors) > 0, 0.15).otherwise(0.0), F.lit(0.55))


def statement_gravity(text, actors, keywords):
    return F.least(0.35 + F.when(holds(text, actors) >= 2, 0.10).otherwise(0.0) + F.when(holds(text, keywords) > 0, 0.10).otherwise(0.0), F.lit(0.55))


def bridge_gravity(text, causes, bonus):
    total = F.lit(0.30) + bonus
    for words, weight in causes:
        total = total + F.when(holds(text, words) > 0, weight).otherwise(0.0)
    return F.least(total, F.lit(0.95))


def _has(words, least: int = 1) -> str:
    return "(" + " + ".join(f"contains(low, '{w}')::INTEGER" for w in words) + f") >= {least}"


@query(
    f"""WITH d AS (SELECT doc_id, source, lower(text) AS low FROM documents WHERE text IS NOT NULL)
SELECT doc_id, round(least(0.25 + CASE WHEN source IN ('src1', 'src4') THEN 0.10 ELSE 0 END + CASE WHEN {_has(ACTORS)} THEN 0.15 ELSE 0 END, 0.55)::DOUBLE, 6) AS hearing,
round(least(0.35 + CASE WHEN {_has(ACTORS, 2)} THEN 0.10 ELSE 0 END + CASE WHEN {_has(KEYWORDS)} THEN 0.10 ELSE 0 END, 0.55)::DOUBLE, 6) AS statement,
round(least(0.30 + CASE source WHEN 'src0' THEN 0.10 WHEN 'src2' THEN 0.10 WHEN 'src3' THEN 0.08 ELSE 0 END """
    + " ".join(f"+ CASE WHEN {_has(words)} THEN {weight} ELSE 0 END" for words, weight in CAUSES)
    + ", 0.95)::DOUBLE, 6) AS bridge FROM d"
)
def t50_text_gravity(spark, sf):
    """Gravity of hearings, of public statements and of finds of a hunt: a start, additions for what the text holds, a cap."""
    low = F.lower("text")
    bonus = F.when(F.col("source").isin("src0", "src2"), 0.10).when(F.col("source") == "src3", 0.08).otherwise(0.0)
    six = lambda c, name: F.round(c, 6).alias(name)
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", six(hearing_gravity(low, F.col("source").isin("src1", "src4"), ACTORS), "hearing"), six(statement_gravity(low, ACTORS, KEYWORDS), "statement"), six(bridge_gravity(low, CAUSES, bonus), "bridge"))


def leading_actors(actors, influence, scored, most: int = 20, over: float = 0.6):
    """(actor_id, name, influence): whom to search for: the most influential actors (actor_id, name) by influence (actor_id, influence), and if none has any, those of the
    gravest signals (actor_id, gravity) over a threshold. Names of three characters or fewer are left out; ties go to the least id."""
    named = actors.where(F.char_length(F.trim("name")) > 3)
    top = lambda x: x.orderBy(F.desc("influence"), "actor_id").limit(most).select("actor_id", "name", "influence")
    first = named.join(influence.where("influence > 0"), "actor_id")
    if not first.isEmpty():
        return top(first)
    return top(named.join(scored.where(F.col("gravity") > over).groupBy("actor_id").agg(F.max("gravity").alias("influence")), "actor_id"))


@query("SELECT s_suppkey AS actor_id, s_name AS name, round(s_acctbal / 10000, 6) AS influence FROM supplier WHERE s_acctbal > 0 AND length(trim(s_name)) > 3 ORDER BY s_acctbal / 10000 DESC, s_suppkey LIMIT 20")
def s13_leading_actors(spark, sf):
    s = table(spark, sf, "supplier")
    found = leading_actors(s.select(F.col("s_suppkey").alias("actor_id"), F.col("s_name").alias("name")), s.select(F.col("s_suppkey").alias("actor_id"), (F.col("s_acctbal") / 10000).alias("influence")), no_scores(spark))
    return found.withColumn("influence", F.round("influence", 6))


def no_scores(spark):
    return spark.createDataFrame([], "actor_id long, gravity double")


@query(f"WITH {SIGNALS}, g AS (SELECT actor_id, max(g) AS influence FROM (SELECT actor_id, {GRAVITY_SQL} AS g FROM signals WHERE value IS NOT NULL) WHERE g > 0.6 GROUP BY 1) SELECT actor_id, c_name AS name, round(influence, 6) AS influence FROM g JOIN customer ON c_custkey = actor_id ORDER BY g.influence DESC, actor_id LIMIT 20")
def s13_gravest_actors(spark, sf):
    """Without any influence: the actors of the gravest signals."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("actor_id"), F.col("c_name").alias("name"))
    scored = signals(spark, sf).where("value is not null").select("actor_id", gravity().alias("gravity"))
    found = leading_actors(c, no_scores(spark).withColumnRenamed("gravity", "influence"), scored)
    return found.withColumn("influence", F.round("influence", 6))


ALERTS = """alerts AS (SELECT CAST(floor(lat) AS BIGINT) * 1000 + CAST(floor(lng) AS BIGINT) AS id, floor(lat) + 0.5 AS lat, floor(lng) + 0.5 AS lng, count(*) AS n, least(0.95, 0.5 + 0.05 * count(*))::DOUBLE AS confidence FROM signals WHERE status = 'promoted' AND ts >= TIMESTAMP '2024-01-29 00:00:00' GROUP BY ALL)"""
HOT = "(SELECT coalesce(min(v), 0) FROM (SELECT s_acctbal / 1000 AS v, ntile(10) OVER (ORDER BY s_acctbal) AS d FROM supplier WHERE s_acctbal > 0) WHERE d = 10)"
STREAM = "CASE stream WHEN 'CRIME_INTEL' THEN 1.0 WHEN 'PRIORITY' THEN 0.9 WHEN 'INFRASTRUCTURE' THEN 0.7 ELSE 0.3 END"


@query(f"""WITH {SIGNALS}, {ALERTS}, live AS (SELECT *, CAST({RELEVANCE_SQL} AS DOUBLE) AS rel FROM signals WHERE status IN ('raw', 'promoted') AND source_type = 'live'), recent AS (SELECT * FROM live WHERE source <> 'click' AND ts >= TIMESTAMP '2024-01-29 00:00:00'), {PAIRS_SQL},
sig AS (SELECT * FROM live ORDER BY is_priority DESC, round(rel, 9) DESC, signal_id LIMIT 500),
items AS (SELECT * FROM (SELECT 'alert' AS kind, id, 0.2 + 0.8 * confidence AS score FROM alerts WHERE n >= 3 ORDER BY confidence DESC, n DESC, id LIMIT 5)
UNION ALL SELECT 'signal', signal_id, rel * 0.4 + is_priority * 0.3 + CASE WHEN EXISTS (SELECT 1 FROM alerts a WHERE a.lat BETWEEN s.lat - 0.9 AND s.lat + 0.9 AND a.lng BETWEEN s.lng - 0.9 AND s.lng + 0.9) THEN 0.2 ELSE 0 END + ({STREAM}) * 0.1 FROM sig s
UNION ALL SELECT * FROM (SELECT 'pair', a, 0.4 * (x.rel + y.rel) / 2 + 0.3 * greatest(x.is_priority, y.is_priority) + 0.1 FROM scored JOIN live x ON x.signal_id = a JOIN live y ON y.signal_id = b WHERE score >= 0.85 ORDER BY score DESC, a, b LIMIT 100)
UNION ALL SELECT 'lead', s_suppkey, 0.4 * (s_acctbal / 1000 / (s_acctbal / 1000 + 1)) + 0.09 FROM supplier WHERE s_acctbal / 1000 >= {HOT} AND s_acctbal > 0)
SELECT kind, id, round(score, 4) AS score FROM items ORDER BY round(score, 4) DESC, kind, id LIMIT 200""")
def g39_whole_feed(spark, sf):
    """Alerts (the five surest), signals (500 by priority and relevance), correlated pairs (the best hundred) and the most influential tenth of actors on one scale; two hundred
    in all. Every bound is the feed's own. Cells of promoted signals of the last days stand for alerts."""
    s = signals(spark, sf)
    one = lambda c: F.floor(c) + 0.5
    cells = s.where("status = 'promoted' and ts >= timestamp'2024-01-29 00:00:00'").groupBy(one("lat").alias("lat"), one("lng").alias("lng")).agg(count().alias("n"))
    cells = checkpointed(cells.select((F.floor("lat") * 1000 + F.floor("lng")).alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), "n", F.least(F.lit(0.95), 0.5 + 0.05 * F.col("n")).alias("confidence")))
    alerts = cells.where("n >= 3").orderBy(F.desc("confidence"), F.desc("n"), "id").limit(5).select(F.lit("alert").alias("kind"), "id", (0.2 + 0.8 * F.col("confidence")).alias("score"))
    live = s.where("status in ('raw', 'promoted') and source_type = 'live'").withColumn("rel", relevance())
    best = checkpointed(live.orderBy(F.desc("is_priority"), F.desc(F.round("rel", 9)), "signal_id").limit(500))
    near = joins.box_exists(best, cells, 0.9).select("signal_id", F.lit(0.2).alias("flag"))
    weight = F.when(F.col("stream") == "CRIME_INTEL", 1.0).when(F.col("stream") == "PRIORITY", 0.9).when(F.col("stream") == "INFRASTRUCTURE", 0.7).otherwise(0.3)
    score = F.col("rel") * 0.4 + F.col("is_priority") * 0.3 + F.coalesce("flag", F.lit(0.0)) + weight * 0.1
    found = best.join(near, "signal_id", "left").select(F.lit("signal").alias("kind"), F.col("signal_id").alias("id"), score.alias("score"))
    pairs = best_correlated(live.where("source <> 'click' and ts >= timestamp'2024-01-29 00:00:00'"), 100, 0.85).withColumnRenamed("score", "c")
    end = live.select("signal_id", "rel", "is_priority")
    pairs = pairs.join(end.toDF("a", "rel_a", "p_a"), "a").join(end.toDF("b", "rel_b", "p_b"), "b")
    pairs = pairs.select(F.lit("pair").alias("kind"), F.col("a").alias("id"), (0.4 * (F.col("rel_a") + F.col("rel_b")) / 2 + 0.3 * F.greatest("p_a", "p_b") + 0.1).alias("score"))
    actors = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000).alias("i"))
    # With under ten actors there is no top tenth, and all of them count.
    least = joins.value_at(actors, "i", actors.count() // 10 - 1)
    leads = actors.where(F.col("i") >= F.lit(least or 0.0)).select(F.lit("lead").alias("kind"), "id", (0.4 * (F.col("i") / (F.col("i") + 1)) + 0.09).alias("score"))
    items = alerts.unionByName(found).unionByName(pairs).unionByName(leads)
    return items.withColumn("score", F.round("score", 4)).orderBy(F.desc("score"), "kind", "id").limit(200)


@query()
def t12_person_names(spark, sf):
    """Names as scans give them, from parts' names: with titles, broken lines, blanks, numbers and headings."""
    words = F.split(F.initcap("p_name"), " ")
    k, two = F.col("p_partkey") % 8, F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)))
    raw = F.when(k == 0, F.concat(F.lit("Adv. "), two)).when(k == 1, F.concat_ws("\n", F.get(words, F.lit(0)), F.get(words, F.lit(1)))).when(k == 2, F.upper(two)).when(k == 3, F.concat(two, F.lit("  Bay;")))
    raw = raw.when(k == 4, F.concat(F.lit("Schedule "), F.col("p_partkey").cast("string"))).when(k == 5, F.concat(two, F.lit("\nContributor"))).when(k == 6, F.get(words, F.lit(0))).otherwise(F.concat(F.lit(" justice "), two, F.lit(".")))
    name = parse.person_name(raw)
    return table(spark, sf, "part").select("p_partkey", raw.alias("raw"), name.alias("name"), parse.is_person_name(name).alias("valid"))


@query(
    r"""WITH d AS (SELECT source || '-' || doc_id::VARCHAR AS stem, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)
SELECT stem AS slug, upper(substr(stem, 1, 1)) || replace(substr(stem, 2), '-', ' ') AS title, array_to_string(list_transform(l, lambda x: CASE WHEN starts_with(x, '# ') THEN '<h1>' || substr(x, 3) || '</h1>' WHEN starts_with(x, '## ') THEN '<h2>' || substr(x, 4) || '</h2>' ELSE '<p>' || x || '</p>' END), chr(10)) AS html FROM d"""
)
def s20_dossiers(spark, sf):
    """Texts as dossiers under the name of a file: slug, title and pages of headings and paragraphs."""
    stem = F.concat_ws("-", "source", F.col("doc_id").cast("string"))
    d = table(spark, sf, "documents").where("text is not null and source is not null")
    return d.select(T.slug(stem).alias("slug"), F.initcap(F.translate(stem, "-_", "  ")).alias("title"), parse.dossier_html(F.col("text")).alias("html"))


def sharing_parts(spark, sf):
    """Links of parts that share two orders or more."""
    return joins.shared_key_pairs(part_links(spark, sf), "actor_id", "event_id").where("shared >= 2").withColumnRenamed("shared", "weight")


def within_largest(links):
    """The links of the largest connected group."""
    parts = checkpointed(graph.components(links.select("a", "b")))
    largest = parts.groupBy("component").agg(count().alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return links.join(parts.join(F.broadcast(largest), "component").select(F.col("node").alias("a")), "a", "left_semi")


@query()
def g24_modularity_communities(spark, sf):
    """Communities by modularity within the largest connected group of parts."""
    return louvain.communities(within_largest(checkpointed(sharing_parts(spark, sf))))


@query()
def g26_modularity_communities_of_all(spark, sf):
    """The same over all connected groups."""
    return louvain.communities(sharing_parts(spark, sf))


@query()
def g24_label_communities(spark, sf):
    """Communities of parts that share two orders or more, within the largest connected group; by label propagation."""
    links = checkpointed(joins.shared_key_pairs(part_links(spark, sf), "actor_id", "event_id").where("shared >= 2").withColumnRenamed("shared", "weight"))
    parts = checkpointed(graph.components(links.select("a", "b")))
    largest = parts.groupBy("component").agg(count().alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    inside = parts.join(F.broadcast(largest), "component").select(F.col("node").alias("a"))
    return graph.label_communities(links.join(inside, "a", "left_semi"))


@query()
def g26_label_communities_of_all(spark, sf):
    """The same over all connected groups, each with at least one community of its own."""
    links = joins.shared_key_pairs(part_links(spark, sf), "actor_id", "event_id").where("shared >= 2").withColumnRenamed("shared", "weight")
    return graph.label_communities(links)
