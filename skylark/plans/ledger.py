"""Bridges from signals to cases, roll-ups, sinks, gates, timelines, stateful rules in batch form, and the register of scorers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from skylark.adapters import ACTOR_EVENTS, SIGNALS, actor_events, reports, signals, table
from skylark.functions import scores
from skylark.operators import text as engines
from skylark.plans.cases import OWNED, owned
from skylark.plans.engines import GRAVITY, RELEVANCE, gravity, relevance
from skylark.operators.ordered import walked
from skylark.operators.rules import Outbreak, StandingTitles
from skylark.plans.flags import story_words
from skylark.plans.registry import query
from skylark.plugins import Registry
from skylark.session import checkpoint_folder, checkpointed


def count():
    return F.count(F.lit(1))


SUPPLIER = "'Supplier#' || lpad({}::VARCHAR, 9, '0')"


@query(f"""WITH {OWNED}, m AS (SELECT event_id AS signal_id, json_object('target', {SUPPLIER.format('user_id')}) AS meta FROM events WHERE event_type = 'signup'),
named AS (SELECT signal_id, s_suppkey AS actor FROM m JOIN supplier ON lower(s_name) = lower(trim(meta ->> '$.target'))), one AS (SELECT DISTINCT l_suppkey AS actor, l_orderkey AS event FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49), two AS (SELECT DISTINCT l_suppkey AS actor, l_orderkey AS event FROM lineitem),
a AS (SELECT one.actor, max(case_id) AS case_id FROM one JOIN owned USING (event) GROUP BY 1), b AS (SELECT two.actor, max(case_id) AS case_id FROM two JOIN owned USING (event) GROUP BY 1)
SELECT signal_id, coalesce(a.case_id, b.case_id) AS case_id, a.case_id IS NULL AS by_fallback FROM named LEFT JOIN a USING (actor) LEFT JOIN b USING (actor) WHERE coalesce(a.case_id, b.case_id) IS NOT NULL""")
def j14_target_bridge(spark, sf):
    """A signal's named target leads over its events to the case of the highest number; if its own links lead to none, over the wider ones."""
    meta = F.to_json(F.struct(F.concat(F.lit("Supplier#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("target")))
    m = table(spark, sf, "events").where("event_type = 'signup'").select(F.col("event_id").alias("signal_id"), meta.alias("meta"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("actor"), F.lower("s_name").alias("name"))
    named = m.withColumn("name", F.lower(F.trim(F.get_json_object("meta", "$.target")))).join(s, "name").select("signal_id", "actor")
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("actor"), F.col("l_orderkey").alias("event"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)).alias("own"))
    # One pass: the highest case by either kind of link.
    per = li.join(owned(spark, sf).select("event", "case_id"), "event").groupBy("actor").agg(F.max(F.when(F.col("own"), F.col("case_id"))).alias("a"), F.max("case_id").alias("b"))
    return named.join(per, "actor").select("signal_id", F.coalesce("a", "b").alias("case_id"), F.col("a").isNull().alias("by_fallback"))


@query(f"""WITH {SIGNALS}, linked AS (SELECT DISTINCT signal_id, actor_id FROM signals WHERE source = 'error' AND actor_id IS NOT NULL), direct AS (SELECT DISTINCT signal_id, c_nationkey AS case_id FROM linked JOIN customer ON c_custkey = actor_id WHERE c_acctbal > 0),
wide AS (SELECT DISTINCT signal_id, s_nationkey AS case_id FROM linked JOIN orders ON o_custkey = actor_id JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE signal_id NOT IN (SELECT signal_id FROM direct))
SELECT signal_id, case_id, 'actor' AS path FROM direct UNION ALL SELECT signal_id, case_id, 'event' FROM wide""")
def j15_actor_bridge(spark, sf):
    """Cases that share a signal's actors; for signals without one, those reached over the actors' events."""
    linked = signals(spark, sf).where("source = 'error' and actor_id is not null").select("signal_id", "actor_id").distinct()
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("actor_id"), F.col("c_nationkey").alias("case_id"))
    direct = checkpointed(linked.join(c, "actor_id").select("signal_id", "case_id").distinct())
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("actor_id"), F.col("o_orderkey").alias("l_orderkey"))
    reach = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(o, "l_orderkey").select("actor_id", F.col("s_nationkey").alias("case_id")).distinct()
    wide = linked.join(direct.select("signal_id"), "signal_id", "left_anti").join(reach, "actor_id").select("signal_id", "case_id").distinct()
    return direct.withColumn("path", F.lit("actor")).unionByName(wide.withColumn("path", F.lit("event")))


@query(f"WITH {SIGNALS}, {ACTOR_EVENTS} SELECT ae.actor_id, s_name AS name, count(*) AS events, round(avg(lat), 5) AS lat, round(avg(lng), 5) AS lng FROM actor_events ae JOIN signals ON signal_id = event_id JOIN supplier ON s_suppkey = ae.actor_id GROUP BY 1, 2")
def a10_actor_centroids(spark, sf):
    place = signals(spark, sf).select(F.col("signal_id").alias("event_id"), "lat", "lng")
    mean = actor_events(spark, sf).join(place, "event_id").groupBy("actor_id").agg(count().alias("events"), F.round(F.avg("lat"), 5).alias("lat"), F.round(F.avg("lng"), 5).alias("lng"))
    return mean.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("actor_id"), F.col("s_name").alias("name")), "actor_id")


@query(f"""WITH {SIGNALS}, g AS (SELECT actor_id, count(*) AS signals, max({GRAVITY}) AS top, max(is_priority) AS priority FROM signals WHERE value IS NOT NULL AND actor_id IS NOT NULL GROUP BY 1)
SELECT actor_id, signals, round(top, 3) AS top, priority, CASE WHEN priority = 1 AND top >= 0.6 THEN 'CRITICAL' WHEN top >= 0.6 THEN 'HIGH' WHEN top >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM g""")
def a14_actor_targets(spark, sf):
    g = signals(spark, sf).where("value is not null and actor_id is not null").groupBy("actor_id").agg(count().alias("signals"), F.max(gravity()).alias("top"), F.max("is_priority").alias("priority"))
    level = F.when((F.col("priority") == 1) & (F.col("top") >= 0.6), "CRITICAL").when(F.col("top") >= 0.6, "HIGH").when(F.col("top") >= 0.45, "MEDIUM").otherwise("LOW")
    return g.select("actor_id", "signals", F.round("top", 3).alias("top"), "priority", level.alias("level"))


@query(f"WITH {SIGNALS}, r AS (SELECT signal_id, round({RELEVANCE}, 6) AS relevance, round(least(1.0, value / 200), 6) AS stored FROM signals) SELECT signal_id, stored, relevance FROM r WHERE stored IS DISTINCT FROM relevance")
def k02_column_update(spark, sf):
    """The rows that an update of one column changes, with old and new value: the column is derived as a whole, in no batches."""
    r = signals(spark, sf).select("signal_id", F.round(F.least(F.lit(1.0), F.col("value") / 200), 6).alias("stored"), F.round(relevance(), 6).alias("relevance"))
    return r.where(~F.col("stored").eqNullSafe(F.col("relevance"))).select("signal_id", "stored", "relevance")


@query(f"WITH {SIGNALS} SELECT stream, source, count(*) AS n FROM signals WHERE status <> 'dismissed' GROUP BY 1, 2")
def k03_full_replace(spark, sf):
    """A result table replaced as a whole: what an earlier run left is gone."""
    folder = f"{checkpoint_folder(spark)}/replaced-{uuid.uuid4().hex}"
    per = signals(spark, sf).groupBy("stream", "source").agg(count().alias("n"))
    per.write.parquet(folder)
    signals(spark, sf).where("status <> 'dismissed'").groupBy("stream", "source").agg(count().alias("n")).write.mode("overwrite").parquet(folder)
    return spark.read.schema(per.schema).parquet(folder)


@query(f"""WITH {ACTOR_EVENTS} SELECT 'node' AS part, json_object('id', 'actor:' || s_suppkey::VARCHAR, 'label', s_name, 'group', s_nationkey)::VARCHAR AS body FROM supplier UNION ALL
SELECT 'edge', json_object('source', 'actor:' || a.actor_id::VARCHAR, 'target', 'actor:' || b.actor_id::VARCHAR, 'value', count(*))::VARCHAR FROM actor_events a JOIN actor_events b ON a.event_id = b.event_id AND a.actor_id < b.actor_id GROUP BY a.actor_id, b.actor_id""")
def k05_graph_json(spark, sf):
    """Nodes and edges as JSON objects, one a row, so that a graph of any size can be written as lines."""
    from skylark.plans.graphs import supplier_links

    name = lambda c: F.concat(F.lit("actor:"), F.col(c).cast("string"))
    nodes = table(spark, sf, "supplier").select(F.lit("node").alias("part"), F.to_json(F.struct(name("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.col("s_nationkey").alias("group"))).alias("body"))
    return nodes.unionByName(supplier_links(spark, sf).select(F.lit("edge").alias("part"), F.to_json(F.struct(name("a").alias("source"), name("b").alias("target"), F.col("weight").alias("value"))).alias("body")))


SORTS = {"name": ("c_name", False), "balance": ("c_acctbal", True), "segment": ("c_mktsegment", False)}


def sorted_by(df, key: str, unique: str, default: str = "name"):
    """df in the order of a listed key; a key that isn't listed is the default's. Ties by the unique column."""
    column, down = SORTS.get(key, SORTS[default])
    return df.orderBy(F.desc(column) if down else F.asc(column), unique)


@query("SELECT c_custkey, 'balance' AS by_key FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20) UNION ALL SELECT c_custkey, 'drop table' FROM (SELECT * FROM customer ORDER BY c_name, c_custkey LIMIT 20)")
def o05_listed_sort_keys(spark, sf):
    c = table(spark, sf, "customer")
    one = lambda k: sorted_by(c, k, "c_custkey").limit(20).select("c_custkey", F.lit(k).alias("by_key"))
    return one("balance").unionByName(one("drop table"))


@query("""WITH r AS (SELECT l_orderkey AS signal_id, l_suppkey AS subject, 1000000 + o_custkey AS object FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'), a AS (SELECT signal_id, subject AS actor FROM r UNION SELECT signal_id, object FROM r)
SELECT signal_id, (SELECT count(*) FROM r WHERE r.signal_id = a.signal_id) AS relations, count(*) AS actors FROM a GROUP BY 1 HAVING count(*) >= 3""")
def g40_nexus_signals(spark, sf):
    """Signals of the best grade whose relations name three actors or more."""
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") + 1000000).alias("object"))
    r = table(spark, sf, "lineitem").join(o, "l_orderkey").select(F.col("l_orderkey").alias("signal_id"), F.col("l_suppkey").alias("subject"), "object")
    ends = r.select("signal_id", F.explode(F.array("subject", "object")).alias("actor"))
    return ends.groupBy("signal_id").agg((count() / 2).cast("long").alias("relations"), F.countDistinct("actor").alias("actors")).where("actors >= 3")


@query("""WITH t AS (SELECT l_suppkey AS actor, o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY l_suppkey ORDER BY o_orderdate DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey)
SELECT actor, n AS mentions, string_agg(day::VARCHAR || ' #' || o_orderkey::VARCHAR, '; ' ORDER BY r) AS timeline FROM t WHERE r <= 10 AND n >= 3 GROUP BY actor, n""")
def g53_dossiers(spark, sf):
    """Actors of three mentions or more with their ten latest as a timeline, which is the dossier's length."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("day"), "o_orderdate")
    t = actor_events(spark, sf).join(o, "event_id")
    n = t.groupBy("actor_id").agg(count().alias("mentions")).where("mentions >= 3")
    last = t.withColumn("r", F.row_number().over(Window.partitionBy("actor_id").orderBy(F.desc("o_orderdate"), "event_id"))).where("r <= 10")
    line = F.struct("r", F.concat(F.col("day").cast("string"), F.lit(" #"), F.col("event_id").cast("string")).alias("x"))
    lines = last.groupBy("actor_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda v: v["x"]), "; ").alias("timeline"))
    return n.join(lines, "actor_id").withColumnRenamed("actor_id", "actor")


@query(f"""WITH {SIGNALS}, v AS (SELECT count(*) AS signals, count(DISTINCT source) AS sources, count(DISTINCT actor_id) AS actors FROM signals), g AS (SELECT 'signals' AS gate, signals AS value, 10 AS needed FROM v UNION ALL SELECT 'sources', sources, 3 FROM v UNION ALL SELECT 'entities', actors, 50 FROM v)
SELECT gate, value, value >= needed AS passes FROM g UNION ALL SELECT 'pairs', actors * (actors - 1) // 2, actors * (actors - 1) // 2 <= 50000 FROM v""")
def g60_preflight_gates(spark, sf):
    """Whether there is enough for the engines, and not too much for the search of all pairs."""
    v = signals(spark, sf).agg(count().alias("signals"), F.countDistinct("source").alias("sources"), F.countDistinct("actor_id").alias("actors"))
    pairs = F.expr("actors * (actors - 1) div 2")
    gates = [("signals", F.col("signals"), F.col("signals") >= 10), ("sources", F.col("sources"), F.col("sources") >= 3), ("entities", F.col("actors"), F.col("actors") >= 50), ("pairs", pairs, pairs <= 50000)]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), x.cast("long").alias("value"), ok.alias("passes")) for n, x, ok in gates]))
    return v.select(rows.alias("g")).select("g.*")


@query("SELECT doc_id, source, length(coalesce(text, '')) AS chars FROM documents WHERE length(coalesce(text, '')) < 200 AND source IN ('src0', 'src3', 'src7', 'src11', 'src12', 'src15', 'src18')")
def g61_enrichment_queue(spark, sf):
    """Stubs of the sources whose pages can be fetched."""
    chars = F.char_length(F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").where((chars < 200) & F.col("source").isin("src0", "src3", "src7", "src11", "src12", "src15", "src18")).select("doc_id", "source", chars.alias("chars"))


@query(f"""WITH {SIGNALS}, {OWNED}, c AS (SELECT CAST(floor(lat) AS BIGINT)::VARCHAR || '_' || CAST(floor(lng) AS BIGINT)::VARCHAR AS cluster, signal_id, {GRAVITY} AS g FROM signals WHERE value IS NOT NULL), big AS (SELECT cluster FROM c GROUP BY 1 HAVING count(*) >= 5)
SELECT 'signal' AS kind, arg_max(signal_id, (round(g, 9), -signal_id)) AS id, round(max(g), 3) AS weight FROM c JOIN big USING (cluster) GROUP BY cluster HAVING max(g) >= 0.5
UNION ALL SELECT 'actor', l_suppkey, count(DISTINCT case_id) FROM lineitem JOIN owned ON event = l_orderkey WHERE l_quantity = 1 GROUP BY 2 HAVING count(DISTINCT case_id) >= 2""")
def g63_latent_cases(spark, sf):
    """What a case could begin with: the gravest signal of each larger cluster, and actors in two cases or more."""
    name = F.concat_ws("_", F.floor("lat").cast("string"), F.floor("lng").cast("string"))
    c = signals(spark, sf).where("value is not null").select(name.alias("cluster"), "signal_id", gravity().alias("g"))
    per = c.groupBy("cluster").agg(count().alias("n"), F.max_by("signal_id", F.struct(F.round("g", 9), -F.col("signal_id"))).alias("id"), F.max("g").alias("g")).where("n >= 5 and g >= 0.5")
    li = table(spark, sf, "lineitem").where("l_quantity = 1").select(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("id"))
    actors = li.join(owned(spark, sf), "event").groupBy("id").agg(F.countDistinct("case_id").alias("n")).where("n >= 2")
    return per.select(F.lit("signal").alias("kind"), "id", F.round("g", 3).alias("weight")).unionByName(actors.select(F.lit("actor").alias("kind"), "id", F.col("n").cast("double").alias("weight")))


RELATIONS = "relations AS (SELECT l_suppkey AS a, l_partkey AS b, CASE l_returnflag WHEN 'R' THEN 'returned_to' WHEN 'A' THEN 'supplied' ELSE 'co_occurrence' END AS relation, CASE l_linestatus WHEN 'F' THEN 'pattern' ELSE 'model' END AS method, l_discount AS confidence FROM lineitem)"


def relations(spark, sf):
    """(a, b, relation, method, confidence): lines as relations of suppliers and parts."""
    kind = F.when(F.col("l_returnflag") == "R", "returned_to").when(F.col("l_returnflag") == "A", "supplied").otherwise("co_occurrence")
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), kind.alias("relation"), F.when(F.col("l_linestatus") == "F", "pattern").otherwise("model").alias("method"), F.col("l_discount").alias("confidence"))


@query(f"WITH {RELATIONS} SELECT p_partkey AS actor, (SELECT count(*) FROM relations WHERE relation <> 'co_occurrence' AND (a = p_partkey OR b = p_partkey)) AS relations FROM part")
def g68_roster(spark, sf):
    """All actors with their relations at either end, other than mere co-occurrence; numbers are counted once before the join."""
    r = relations(spark, sf).where("relation <> 'co_occurrence'")
    ends = r.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("actor")).groupBy("actor").agg(count().alias("relations"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("actor")).join(ends, "actor", "left").select("actor", F.coalesce("relations", F.lit(0)).alias("relations"))


@query(f"""WITH {SIGNALS}, x AS (SELECT 'signal' AS kind, signal_id AS id, CASE WHEN signal_id % 11 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS moment FROM signals UNION ALL SELECT 'artifact', l_orderkey * 10 + l_linenumber, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') FROM lineitem)
SELECT kind, id, coalesce(moment, '9999-99-99') AS moment FROM x""")
def g69_mixed_timeline(spark, sf):
    """Signals and artifacts in one shape; what has no date sorts last."""
    form = "yyyy-MM-dd HH:mm:ss"
    s = signals(spark, sf).select(F.lit("signal").alias("kind"), F.col("signal_id").alias("id"), F.when(F.col("signal_id") % 11 != 0, F.date_format("ts", form)).alias("moment"))
    a = table(spark, sf, "lineitem").select(F.lit("artifact").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.date_format("l_shipdate", form).alias("moment"))
    return s.unionByName(a).withColumn("moment", F.coalesce("moment", F.lit("9999-99-99")))


@query(f"""WITH {SIGNALS}, x AS (SELECT s.stream AS before, CASE WHEN s.stream IS NULL OR s.stream = 'GLOBAL' THEN CASE WHEN contains(lower(text), 'license') THEN 'INFRASTRUCTURE' WHEN contains(lower(text), 'the') THEN 'CRIME_INTEL' ELSE 'GLOBAL' END ELSE s.stream END AS after FROM documents JOIN signals s ON signal_id = doc_id WHERE text IS NOT NULL)
SELECT before, after, count(*) AS n FROM x GROUP BY 1, 2""")
def g71_stream_backfill(spark, sf):
    """Signals of no stream or the general one are classified anew; the others stay."""
    low = F.lower("text")
    new = F.when(low.contains("license"), "INFRASTRUCTURE").when(low.contains("the"), "CRIME_INTEL").otherwise("GLOBAL")
    after = F.when(F.col("stream").isNull() | (F.col("stream") == "GLOBAL"), new).otherwise(F.col("stream"))
    return reports(spark, sf).groupBy(F.col("stream").alias("before"), after.alias("after")).agg(count().alias("n"))


@query("""SELECT doc_id, source, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'A' WHEN source < 'src5' THEN 'B' ELSE 'C' END AS grade FROM documents LEFT JOIN labels USING (doc_id) WHERE CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'A' WHEN source < 'src5' THEN 'B' ELSE 'C' END IN ('A', 'B') AND coalesce(quality, 0) = 0 AND length(trim(text)) > 0""")
def g72_rescued_artifacts(spark, sf):
    """Artifacts without findings but with text, of sources in the better grades."""
    grade = F.when(F.col("source").isin("src0", "src1", "src2"), "A").when(F.col("source") < "src5", "B").otherwise("C")
    x = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return x.withColumn("grade", grade).where("grade in ('A', 'B') and coalesce(quality, 0) = 0 and length(trim(text)) > 0").select("doc_id", "source", "grade")


@query(f"WITH {RELATIONS} SELECT method, count(*) AS relations, (SELECT count(*) FROM supplier WHERE s_suppkey IN (SELECT a FROM relations UNION SELECT b FROM relations)) AS actors, count(*) FILTER (WHERE confidence = 0) AS unscored FROM relations GROUP BY method")
def g74_relation_record(spark, sf):
    r = relations(spark, sf)
    ends = r.select(F.col("a").alias("s_suppkey")).union(r.select("b")).distinct()
    n = table(spark, sf, "supplier").join(ends, "s_suppkey", "left_semi").agg(count().alias("actors"))
    per = r.groupBy("method").agg(count().alias("relations"), F.count_if(F.col("confidence") == 0).alias("unscored"))
    return per.withColumn("actors", F.lit(n.first()[0]))


@query("""WITH f AS (SELECT user_id AS actor, stddev_samp(CAST(json_extract(props, '$.k') AS DOUBLE)) AS volatility, count(*) AS velocity, avg(CAST(json_extract(props, '$.k') AS DOUBLE)) / 100 AS stability FROM events WHERE user_id IS NOT NULL GROUP BY 1)
SELECT arg_max(actor, (round(volatility, 9), -actor)) AS most_volatile, arg_max(actor, (velocity, -actor)) AS fastest, round(avg(stability), 6) AS stability FROM f WHERE volatility IS NOT NULL""")
def g75_knowledge_diagnostics(spark, sf):
    k = F.from_json("props", "k double")["k"]
    f = table(spark, sf, "events").where("user_id is not null").groupBy(F.col("user_id").alias("actor")).agg(F.stddev_samp(k).alias("volatility"), count().alias("velocity"), (F.avg(k) / 100).alias("stability")).where("volatility is not null")
    order = lambda c: F.struct(c, -F.col("actor"))
    return f.agg(F.max_by("actor", order(F.round("volatility", 9))).alias("most_volatile"), F.max_by("actor", order(F.col("velocity"))).alias("fastest"), F.round(F.avg("stability"), 6).alias("stability"))


@query(f"WITH {RELATIONS}, l AS (SELECT DISTINCT a, b FROM relations) SELECT p_partkey AS page, (SELECT count(*) FROM l WHERE l.b = p_partkey) AS backlinks, (SELECT count(*) FROM l WHERE l.a = p_partkey) AS outbound FROM part")
def g76_backlinks(spark, sf):
    """Links in and out of every page; suppliers and parts share one space of numbers here."""
    links = relations(spark, sf).select("a", "b").distinct()
    per = links.select(F.explode(F.array(F.struct(F.col("b").alias("page"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("a").alias("page"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x")).select("x.*")
    per = per.groupBy("page").agg(F.sum("i").alias("backlinks"), F.sum("o").alias("outbound"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("page")).join(per, "page", "left").fillna(0)


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS events, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS span FROM orders GROUP BY 1, 2""")
def g77_event_timeline(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").groupBy(F.year(d).alias("year"), F.month(d).alias("month")).agg(count().alias("events"), F.date_format(F.min(d), "yyyy-MM-dd").alias("first"), F.date_format(F.max(d), "yyyy-MM-dd").alias("last"), F.datediff(F.max(d), F.min(d)).cast("long").alias("span"))


@query(f"""WITH {SIGNALS}, t AS (SELECT signal_id, actor_id AS outbreak, ts, k, CASE WHEN k >= 60 THEN 3 WHEN k >= 20 THEN 2 ELSE 1 END AS tier FROM signals WHERE actor_id IS NOT NULL AND k IS NOT NULL)
SELECT a.signal_id, (SELECT count(*) FROM t b WHERE b.outbreak = a.outbreak AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 24 HOUR) AS in_a_day FROM t a WHERE tier = 3 AND (SELECT count(*) FROM t b WHERE b.outbreak = a.outbreak AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 24 HOUR) >= 5""")
def g78_tier_spikes(spark, sf):
    """Spikes are looked for when a report of the third tier comes; reports of all tiers count, blocked ones too."""
    s = signals(spark, sf).where("actor_id is not null and k is not null")
    t = F.unix_micros("ts")
    day = Window.partitionBy("actor_id").orderBy(t).rangeBetween(-86400000000 + 1, 0)
    return s.withColumn("in_a_day", count().over(day)).where("k >= 60 and in_a_day >= 5").select("signal_id", "in_a_day")


@query(f"WITH {SIGNALS} SELECT signal_id, is_priority FROM signals WHERE status = 'raw' ORDER BY is_priority DESC, ts, signal_id LIMIT 500")
def r01_next_batch(spark, sf):
    """What an incremental run takes next: not processed yet, priority first, as many as a batch holds."""
    return signals(spark, sf).where("status = 'raw'").orderBy(F.desc("is_priority"), "ts", "signal_id").limit(500).select("signal_id", "is_priority")


def title_duplicates(told, hours: float = 24.0, block: float = 0.90, tag: float = 0.70, shortest: int = 3):
    """told (id, ts, words) with outcome: 'blocked' if an earlier title that wasn't blocked is as alike as `block` within the hours, 'tagged' from `tag` on, else 'new'. Titles of fewer
    words than the shortest are always new and block nothing.
    """
    words = F.array_sort(F.array_distinct("words"))
    whole = F.coalesce((F.size("words") >= shortest) & F.col("ts").isNotNull(), F.lit(False))
    sets = checkpointed(told.where(whole).select("id", "ts", F.unix_micros("ts").alias("t"), F.array_join(words, " ").alias("name"), words.alias("words")))
    alike = engines.alike_sets(sets, tag, hours).where(F.col("jaccard") >= tag)
    rows = engines.with_alike(sets.select("id", "t", "name"), alike, block=F.col("jaccard") >= block, tag=F.lit(True))
    return told.where(~whole).select("id", F.lit("new").alias("outcome")).unionByName(walked(rows, StandingTitles(hours)).select("id", "outcome"))


@query()
def r04_title_duplicates(spark, sf):
    told = reports(spark, sf).select(F.col("signal_id").alias("id"), "ts", F.array_distinct(story_words(F.col("title"))).alias("words"))
    return title_duplicates(checkpointed(told)).withColumnRenamed("id", "signal_id")


def outbreaks_sql(reports: str, before: str = "") -> str:
    """Outcomes of reports (key, t, signal_id, tier): all outbreaks at once, one report of each after the other. What stands is kept so that the least is of the lowest tier, and of these the latest."""
    return f"""WITH RECURSIVE {before}reports AS ({reports}),
c AS MATERIALIZED (SELECT key, t, signal_id, CAST(tier AS BIGINT) AS tier, row_number() OVER (PARTITION BY key ORDER BY t, signal_id) AS r FROM reports),
walk(key, r, signal_id, outcome, parent, surge, stands, recent) AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', CAST(NULL AS BIGINT), false,
    CAST([] AS STRUCT(tier BIGINT, t BIGINT, id BIGINT)[]), CAST([] AS BIGINT[]) FROM c
  UNION ALL
  SELECT key, r, signal_id, outcome, CASE WHEN outcome = 'chained' THEN -best.id END, len(near) + 1 >= 5,
    CASE WHEN outcome = 'blocked' THEN st ELSE list_append(st, {{'tier': tier, 't': -t, 'id': -signal_id}}) END, list_append(near, t)[-4:]
  FROM (
    SELECT *, CASE WHEN len(st) = 0 THEN 'opens' WHEN tier < best.tier THEN 'chained' ELSE 'blocked' END AS outcome
    FROM (
      SELECT *, list_min(st) AS best
      FROM (
        SELECT c.key, c.r, c.signal_id, c.t, c.tier, list_filter(w.stands, lambda x: c.t + x.t <= 259200000000) AS st, list_filter(w.recent, lambda x: c.t - x < 86400000000) AS near
        FROM walk w JOIN c ON c.key = w.key AND c.r = w.r + 1))))
SELECT signal_id, outcome, parent, surge FROM walk WHERE r > 0"""


@query(outbreaks_sql("SELECT actor_id::VARCHAR || ':' || source AS key, epoch_us(ts) AS t, signal_id, signal_id % 3 + 1 AS tier FROM signals WHERE actor_id IS NOT NULL", f"{SIGNALS}, "))
def r05_outbreak_admissions(spark, sf):
    """Of reports on the same outbreak (here of an actor and a source), the first in 72 hours opens it, one of higher authority than the best that stands is chained to that, and the others are blocked; the fifth in a day is a surge."""
    outbreak = F.concat_ws(":", F.col("actor_id").cast("string"), "source")
    s = signals(spark, sf).where("actor_id is not null").select(outbreak.alias("key"), F.unix_micros("ts").alias("t"), F.col("signal_id").alias("id"), (F.col("signal_id") % 3 + 1).cast("int").alias("tier"))
    return walked(s, Outbreak()).select(F.col("id").alias("signal_id"), "outcome", "parent", "surge")


@query(f"""WITH {SIGNALS}, w AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00' - INTERVAL 23 HOUR, TIMESTAMP '2024-01-31 00:00:00', INTERVAL 1 HOUR)) AS start)
SELECT strftime(start, '%Y-%m-%d %H') AS start, source, count(*) AS n FROM w JOIN signals ON ts >= start AND ts < start + INTERVAL 24 HOUR GROUP BY 1, 2 HAVING count(*) >= 5""")
def r09_sliding_windows(spark, sf):
    """Counts of 24 hours, begun anew each hour: hours are counted first, then each is put into its 24 windows."""
    hours = signals(spark, sf).groupBy("source", F.date_trunc("hour", "ts").alias("h")).agg(count().alias("n"))
    w = F.window("h", "24 hours", "1 hour")
    return hours.groupBy(w.alias("w"), "source").agg(F.sum("n").alias("n")).where("n >= 5").select(F.date_format("w.start", "yyyy-MM-dd HH").alias("start"), "source", "n")


@query("""WITH x AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents WHERE text IS NOT NULL)
SELECT source, count(*) AS items, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS corpus FROM x WHERE r <= 100 GROUP BY source""")
def r11_latest_hundred(spark, sf):
    """A source's corpus holds its latest hundred items, which is the corpus' size."""
    latest = Window.partitionBy("source").orderBy(F.desc("doc_id"))
    x = table(spark, sf, "documents").where("text is not null").select("source", "doc_id").withColumn("r", F.row_number().over(latest)).where("r <= 100")
    ids = F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string"))
    return x.groupBy("source").agg(count().alias("items"), F.array_join(ids, " ").alias("corpus"))


@query("SELECT l_orderkey AS exhibit, list_reduce(list_prepend('', list(l_linenumber::VARCHAR || '|' || l_suppkey::VARCHAR ORDER BY l_linenumber, l_suppkey, l_partkey)), lambda h, x: sha256(h || '|' || x)) AS head, count(*) AS entries FROM lineitem GROUP BY 1")
def r13_custody_chain(spark, sf):
    """The hash chain of an exhibit's log: each entry is hashed with the hash before it."""
    entry = F.concat_ws("|", F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"))
    log = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", entry.alias("x"))))
    head = F.aggregate(log, F.lit(""), lambda h, e: F.sha2(F.concat_ws("|", h, e["x"]), 256))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("exhibit")).agg(head.alias("head"), count().alias("entries"))


def scorers() -> Registry:
    """Three scorers of signals, one of which wants a column that signals don't have."""
    r = Registry()
    result = lambda entities, intent, g, c: F.struct(entities.alias("entities"), intent.alias("intent"), g.alias("gravity"), c.alias("confidence"))

    @r.register("gravity", "value", "actor_id", "k", "signal_id")
    def by_gravity():
        return F.when(F.col("value").isNotNull(), result(F.array(F.concat(F.lit("actor:"), F.col("actor_id").cast("string"))), scores.decision(gravity()), gravity(), F.lit(0.8)))

    @r.register("priority", "is_priority", "source")
    def by_priority():
        return F.when(F.col("is_priority") == 1, result(F.array("source"), F.lit("FLAG"), F.lit(0.7), F.lit(0.6)))

    @r.register("face", "picture")
    def by_face():
        return F.lit(None)

    return r


@query(f"""WITH {SIGNALS}, r AS (SELECT signal_id, {GRAVITY} AS g, CASE WHEN {GRAVITY} > 0.8 THEN 'CREATE' WHEN {GRAVITY} > 0.6 THEN 'FLAG' ELSE 'STORE' END AS intent, 0.8 AS c, 'actor:' || actor_id::VARCHAR AS entity FROM signals WHERE value IS NOT NULL UNION ALL SELECT signal_id, 0.7, 'FLAG', 0.6, source FROM signals WHERE is_priority = 1),
v AS (SELECT signal_id, intent, count(*) AS n FROM r GROUP BY 1, 2), best AS (SELECT signal_id, intent FROM v QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY n DESC, intent) = 1)
SELECT signal_id, intent, round(avg(CAST(g AS DOUBLE)), 3) AS gravity, round(avg(CAST(c AS DOUBLE)), 4) AS confidence, string_agg(entity, ' ' ORDER BY entity) AS entities FROM r JOIN best USING (signal_id, signal_id) GROUP BY signal_id, best.intent""".replace("USING (signal_id, signal_id)", "USING (signal_id)").replace("SELECT signal_id, intent, round(avg", "SELECT signal_id, best.intent, round(avg"))
def x01_merged_scorers(spark, sf):
    """Results of all registered scorers that fit the signals, merged."""
    x = scorers().scored(signals(spark, sf)).where("result is not null")
    return x.select("signal_id", "result.intent", F.round("result.gravity", 3).alias("gravity"), F.round("result.confidence", 4).alias("confidence"), F.array_join("result.entities", " ").alias("entities"))


