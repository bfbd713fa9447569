"""Engines by the whole of their rules, with their inputs from tables: coalitions, neighbourhoods, merged aliases, archives, scored phrases, style, gazetteer matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.adapters import REPORTS, SIGNALS, reports, signals, table
from skylark.functions import parse
from skylark.functions import text as T
from skylark.operators import graph
from skylark.params import Coalition
from skylark.plans.cases import OWNED, owned
from skylark.plans.engines import best_correlated
from skylark.plans import kernels  # noqa: F401  its SQL is used
from skylark.plans.graphs import LINKS, supplier_links
from skylark.plans.network import DISTANCE
from skylark.plans.registry import SQL, query
from skylark.plans.texts import STOPS
from skylark.session import checkpointed


def count():
    return F.count(F.lit(1))


NEEDED = Coalition().min_shared


@query(f"""WITH RECURSIVE {LINKS}, strong AS (SELECT a, b, weight FROM links WHERE weight >= {NEEDED}), e AS (SELECT a, b FROM strong UNION SELECT b, a FROM strong),
r AS (SELECT DISTINCT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE e.b > r.root), c AS (SELECT node, min(root) AS coalition FROM r GROUP BY node), top AS (SELECT coalition, max(weight) AS strongest FROM strong JOIN c ON node = a GROUP BY 1)
SELECT c.coalition, count(*) AS members, strongest, string_agg(s_name, '; ' ORDER BY node) AS names, 1000 + c.coalition AS community FROM c JOIN top USING (coalition) JOIN supplier ON s_suppkey = node GROUP BY c.coalition, strongest""")
def g27_labelled_coalitions(spark, sf):
    """Suppliers that share five orders or more, as many as the survey asks for, as groups with their members' names, strongest link and a community number, which is filled in where there is none."""
    strong = checkpointed(supplier_links(spark, sf, NEEDED))
    member = graph.components(strong.select("a", "b"))
    top = strong.join(member.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.max("weight").alias("strongest"))
    named = member.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), "s_name"), "node")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "s_name"))), lambda s: s["s_name"]), "; ")
    groups = named.groupBy("component").agg(count().alias("members"), names.alias("names")).join(top, "component")
    return groups.select(F.col("component").alias("coalition"), "members", "strongest", "names", (F.lit(1000) + F.col("component")).alias("community"))


@query(f"""WITH {LINKS}, pins AS (SELECT s_nationkey AS case_id, s_suppkey AS actor FROM supplier), ends AS (SELECT a AS actor, b AS node FROM links UNION ALL SELECT b, a FROM links)
SELECT case_id, node, EXISTS (SELECT 1 FROM pins q WHERE q.case_id = p.case_id AND q.actor = node) AS pinned, count(*) AS pins, count(*) >= 2 AND NOT EXISTS (SELECT 1 FROM pins q WHERE q.case_id = p.case_id AND q.actor = node) AS bridging FROM ends JOIN pins p USING (actor) GROUP BY case_id, node""")
def j21_case_neighbourhoods(spark, sf):
    """Nodes one link from a case's pinned actors, with the number of pins they are linked to; those that aren't pinned and join two pins or more are bridges."""
    pins = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("case_id"), F.col("s_suppkey").alias("actor"))
    links = supplier_links(spark, sf)
    ends = links.select(F.col("a").alias("actor"), F.col("b").alias("node")).unionByName(links.select(F.col("b").alias("actor"), F.col("a").alias("node")))
    near = ends.join(pins, "actor").groupBy("case_id", "node").agg(count().alias("pins"))
    found = near.join(pins.select("case_id", F.col("actor").alias("node"), F.lit(True).alias("_pinned")), ["case_id", "node"], "left").withColumn("pinned", F.coalesce("_pinned", F.lit(False)))
    return found.select("case_id", "node", "pinned", "pins", ((F.col("pins") >= 2) & ~F.col("pinned")).alias("bridging"))


@query(f"""WITH {LINKS}, alias AS (SELECT s_suppkey AS alias, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS canonical FROM supplier), x AS (SELECT coalesce(p.canonical, a) AS a, coalesce(q.canonical, b) AS b, weight FROM links LEFT JOIN alias p ON p.alias = a LEFT JOIN alias q ON q.alias = b)
SELECT least(a, b) AS a, greatest(a, b) AS b, sum(weight) AS weight, count(*) AS merged FROM x WHERE a <> b GROUP BY 1, 2""")
def j23_merged_actors(spark, sf):
    """Links after aliases became their canonical actor, from a table of aliases: loops go, links that fall together are one. Here the suppliers of a nation are aliases of its first."""
    s = table(spark, sf, "supplier")
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("canonical"))
    alias = s.join(first, "s_nationkey").select(F.col("s_suppkey").alias("alias"), "canonical")
    x = supplier_links(spark, sf)
    for end in ("a", "b"):
        x = x.join(alias.toDF(end, f"_{end}"), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return x.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"), count().alias("merged"))


@query(f"""WITH {OWNED}, reach AS (SELECT DISTINCT case_id, l_partkey AS artifact FROM owned JOIN lineitem ON l_orderkey = event), n AS (SELECT artifact, count(*) AS cases FROM reach GROUP BY 1)
SELECT 'artifact' AS kind, artifact AS id, 3 AS archived_case_id, CASE WHEN cases = 1 THEN 'move' ELSE 'copy' END AS action FROM reach JOIN n USING (artifact) WHERE case_id = 3
UNION ALL SELECT 'event', event, 3, 'move' FROM owned WHERE case_id = 3 UNION ALL SELECT 'pin', artifact, 3, 'delete' FROM reach WHERE case_id = 3""")
def g51_archived_rows(spark, sf):
    """What archiving one case does row by row: what only it has moves, what others share is copied, its pins go."""
    case = 3
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_partkey").alias("artifact"))
    mine = owned(spark, sf)
    reach = mine.join(li, "event").select("case_id", "artifact").distinct()
    own = reach.where(F.col("case_id") == case).select("artifact")
    others = reach.where(F.col("case_id") != case).select("artifact").distinct().withColumn("shared", F.lit(True))
    row = lambda df, kind, i, action: df.select(F.lit(kind).alias("kind"), F.col(i).alias("id"), F.lit(case).alias("archived_case_id"), action.alias("action"))
    found = row(own.join(others, "artifact", "left"), "artifact", "artifact", F.when(F.col("shared"), "copy").otherwise("move"))
    found = found.unionByName(row(mine.where(F.col("case_id") == case), "event", "event", F.lit("move")))
    return found.unionByName(row(own, "pin", "artifact", F.lit("delete")))


PAIRS, TOP, LEAST, EVIDENCE = 500, 25, 2, 10
WORDS = f"list_filter(regexp_extract_all(lower(title), '[a-z]{{3,}}'), lambda x: NOT list_contains({STOPS}, x))"
SPANS = "list_concat(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]), list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"


@query(f"""WITH {REPORTS}, s AS (SELECT signal_id, ts, lat AS s_lat, lng AS s_lng FROM reports WHERE source <> 'src0'), near AS (SELECT x.signal_id AS a, y.signal_id AS b, {DISTANCE.format(a='x.s', b='y.s')} AS km, abs(epoch_us(x.ts) - epoch_us(y.ts)) / 3.6e9 AS h FROM s x JOIN s y ON x.signal_id < y.signal_id AND abs(x.s_lat - y.s_lat) < 0.5 AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 86400000000),
pairs AS (SELECT a, b, score FROM (SELECT *, round(2 * (1 - km / 50) * (1 - h / 24) / nullif((1 - km / 50) + (1 - h / 24), 0), 4) AS score FROM near WHERE km <= 50 AND h <= 24) WHERE score >= 0.70 ORDER BY score DESC, a, b LIMIT {PAIRS}),
t AS (SELECT signal_id, {WORDS} AS w FROM reports), g AS (SELECT signal_id, unnest({SPANS}) AS phrase FROM t WHERE len(w) >= 2), said AS (SELECT phrase, score, a FROM pairs JOIN g ON signal_id = a UNION ALL SELECT phrase, score, b FROM pairs JOIN g ON signal_id = b)
SELECT phrase, count(*) AS n, round(sum(score), 4) AS score, least({EVIDENCE}, count(DISTINCT a)) AS evidence FROM said WHERE phrase NOT IN (SELECT lower(p_name) FROM part) GROUP BY phrase HAVING count(*) >= {LEAST} ORDER BY round(sum(score), 4) DESC, count(*) DESC, phrase LIMIT {TOP}""")
def g33_scored_phrases(spark, sf):
    """Phrases of two and three words in the titles of the best correlated pairs, scored by the pairs that say them; known phrases are left out. The numbers of pairs and of phrases are the engine's own."""
    r = checkpointed(reports(spark, sf))
    best = best_correlated(r.where("source <> 'src0'").select("signal_id", "lat", "lng", "ts"), PAIRS)
    words = F.filter(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(T.STOP_WORDS))
    g = r.select("signal_id", words.alias("w")).select("signal_id", F.explode(F.concat(T.word_ngrams(F.col("w"), 2), T.word_ngrams(F.col("w"), 3))).alias("phrase"))
    said = best.select("score", F.explode(F.array("a", "b")).alias("signal_id")).join(g, "signal_id")
    known = table(spark, sf, "part").select(F.lower("p_name").alias("phrase")).distinct()
    found = said.join(known, "phrase", "left_anti").groupBy("phrase").agg(count().alias("n"), F.round(F.sum("score"), 4).alias("score"), F.least(F.lit(EVIDENCE), F.countDistinct("signal_id")).cast("long").alias("evidence"))
    return found.where(F.col("n") >= LEAST).orderBy(F.desc("score"), F.desc("n"), "phrase").limit(TOP)


@query(r"""WITH c AS (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '#[A-Za-z0-9_]+')) AS hashtags, len(regexp_extract_all(text, '\$[A-Z]{2,6}')) AS cashtags, len(regexp_extract_all(text, '[\x{1F300}-\x{1FAFF}]')) AS emoji, len(regexp_extract_all(text, '[A-Za-z]')) AS letters, len(regexp_extract_all(text, '[A-Z]')) AS capitals,
len(regexp_extract_all(text, '[A-Za-z][013457][A-Za-z]')) AS leet, len(regexp_extract_all(text, '[!?]{2,}')) AS shouts, len(regexp_extract_all(text, '[0-9]{1,2}/[0-9]{1,2}')) AS threads, len(regexp_extract_all(text, '[A-Za-z]+')) AS words FROM documents WHERE text IS NOT NULL)
SELECT doc_id, hashtags, cashtags, emoji, round(CASE WHEN letters > 0 THEN CAST(capitals AS DOUBLE) / letters ELSE 0 END, 6) AS caps, round(CAST(leet AS DOUBLE) / greatest(words, 1), 6) AS leet, shouts, threads, round(CAST(letters AS DOUBLE) / greatest(words, 1), 6) AS word_length, n AS chars FROM c""")
def t18_style_profile(spark, sf):
    """Nine traits of style: tags of two kinds, emoji, capitals, digits in words, shouting, thread marks, length of words and of the text."""
    t, n = F.col("text"), lambda rx: F.regexp_count("text", F.lit(rx))
    letters, words = n("[A-Za-z]"), F.greatest(n("[A-Za-z]+"), F.lit(1))
    d = table(spark, sf, "documents").where("text is not null")
    return d.select(
        "doc_id", n("#[A-Za-z0-9_]+").alias("hashtags"), n(r"\$[A-Z]{2,6}").alias("cashtags"), n(r"[\x{1F300}-\x{1FAFF}]").alias("emoji"), F.round(T.caps_ratio(t), 6).alias("caps"), F.round(n("[A-Za-z][013457][A-Za-z]") / words, 6).alias("leet"),
        n("[!?]{2,}").alias("shouts"), n("[0-9]{1,2}/[0-9]{1,2}").alias("threads"), F.round(letters / words, 6).alias("word_length"), F.char_length(t).alias("chars"),
    )


@query("""WITH g AS (SELECT DISTINCT substr(lower(p_name), 1, 3) AS name, min(p_partkey) OVER (PARTITION BY substr(lower(p_name), 1, 3)) AS place FROM part UNION SELECT lower(p_type), min(p_partkey) FROM part GROUP BY 1 UNION SELECT substr(lower(p_name), 1, 4), min(p_partkey) FROM part GROUP BY 1)
SELECT doc_id, name, place FROM (SELECT doc_id, name, place, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) AS r FROM documents, g WHERE contains(lower(text), name)) WHERE r = 1""")
def j16_gazetteer_matches(spark, sf):
    """The longest name of a gazetteer table within each text, as a string and not as a word.

    Names are few to the letters they begin with: texts give their distinct runs of three characters, which are joined with the names' first three; the name itself is then looked for.
    """
    p = table(spark, sf, "part")
    head = lambda k: p.groupBy(F.substring(F.lower("p_name"), 1, k).alias("name")).agg(F.min("p_partkey").alias("place"))
    g = head(3).unionByName(p.groupBy(F.lower("p_type").alias("name")).agg(F.min("p_partkey").alias("place"))).unionByName(head(4)).distinct()
    g = g.withColumn("run", F.substring("name", 1, 3))
    low = table(spark, sf, "documents").where("text is not null").select("doc_id", F.lower("text").alias("low"))
    # Runs that begin at every third character, from the first three characters on, are all runs.
    runs = F.array_distinct(F.concat(*[F.regexp_extract_all(F.substring("low", F.lit(k), F.char_length("low")), F.lit("(?s)..."), F.lit(0)) for k in (1, 2, 3)]))
    # Only names and ids go through the join; texts come back to the names that may be in them.
    maybe = low.select("doc_id", F.explode(runs).alias("run")).join(g, "run").groupBy("doc_id").agg(F.collect_set(F.struct("name", "place")).alias("names"))
    met = low.join(maybe, "doc_id").select("doc_id", F.explode(F.filter("names", lambda n: F.instr(F.col("low"), n["name"]) > 0)).alias("n")).select("doc_id", "n.*")
    best = F.min_by(F.struct("name", "place"), F.struct(-F.char_length("name"), "name"))
    return met.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.name", "b.place")


DIRTY = r"<[^>]+>|&[a-z]+;|[#*$%]{3,}"


CLEAN = SQL["t02_sanitise"].split("SELECT doc_id, ")[1].split(" AS clean")[0]


@query(f"SELECT doc_id, regexp_matches(text, '{DIRTY}') AS dirty, md5(CASE WHEN regexp_matches(text, '{DIRTY}') THEN {CLEAN} ELSE text END) AS digest FROM documents WHERE text IS NOT NULL")
def g70_bleached(spark, sf):
    """Only texts with traces of markup are sanitised again; the others stay as they are."""
    dirty = F.col("text").rlike(DIRTY)
    return table(spark, sf, "documents").where("text is not null").select("doc_id", dirty.alias("dirty"), F.md5(F.when(dirty, parse.sanitised(F.col("text"))).otherwise(F.col("text"))).alias("digest"))


@query(f"""WITH {SIGNALS}, k AS (SELECT CAST(ts AS DATE) AS day, source, 'geo:' || CAST(trunc(lat) AS BIGINT)::VARCHAR || ':' || CAST(trunc(lng) AS BIGINT)::VARCHAR AS region FROM signals UNION ALL SELECT CAST(ts AS DATE), source, 'actor:' || actor_id::VARCHAR FROM signals WHERE actor_id IS NOT NULL)
SELECT day::VARCHAR AS day, source, region, count(*) AS n FROM k GROUP BY 1, 2, 3""")
def g14_incremental_baselines(spark, sf):
    """Daily counts by source and cell or actor. What is stored up to the day before the last is kept, and only the days from then on are counted anew: late signals of the last day are seen."""
    s = signals(spark, sf)
    cell = F.concat_ws(":", F.lit("geo"), F.col("lat").cast("int").cast("string"), F.col("lng").cast("int").cast("string"))
    geo = s.select(F.to_date("ts").alias("day"), "source", cell.alias("region"))
    keys = geo.unionByName(s.where("actor_id is not null").select(F.to_date("ts").alias("day"), "source", F.concat(F.lit("actor:"), F.col("actor_id").cast("string")).alias("region")))
    daily = lambda rows: rows.groupBy("day", "source", "region").agg(count().alias("n"))
    stored = checkpointed(daily(keys.where("day <= date'2024-01-20'")))
    last = stored.agg(F.max("day")).first()[0]
    since = F.date_sub(F.lit(last), 1) if last else F.to_date(F.lit("1970-01-01"))
    return stored.where(F.col("day") < since).unionByName(daily(keys.where(F.col("day") >= since))).withColumn("day", F.col("day").cast("string"))
