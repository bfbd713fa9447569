"""Cases, entities and names: nations stand for cases, their customers for actors, orders for events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skylark.adapters import table
from skylark.functions.text import normal_name
from skylark.operators import names as N
from skylark.plans.registry import query

def count():
    return F.count(F.lit(1))

OWNED = "owned AS (SELECT c_nationkey AS case_id, c_custkey AS actor, o_orderkey AS event, CAST(o_orderdate AS DATE) AS day FROM customer JOIN orders ON o_custkey = c_custkey)"


def owned(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey).select(F.col("c_nationkey").alias("case_id"), F.col("c_custkey").alias("actor"), F.col("o_orderkey").alias("event"), F.to_date("o_orderdate").alias("day"))


@query(f"""WITH {OWNED}, base AS (SELECT case_id, count(DISTINCT actor) AS actors, count(DISTINCT event) AS events FROM owned GROUP BY 1),
per AS (SELECT case_id, day, count(*) AS n FROM owned GROUP BY 1, 2), week AS (SELECT a.case_id, a.day, sum(b.n) AS n FROM per a JOIN per b ON a.case_id = b.case_id AND b.day BETWEEN a.day AND a.day + 7 GROUP BY 1, 2)
SELECT case_id, round(100 * (0.35 * least(CAST(events AS DOUBLE) / actors / 5, 1) + 0.35 * (CAST(max(n) AS DOUBLE) / events) + 0.30 * least(CAST(events AS DOUBLE) / 1000, 1)), 1) AS heat FROM base JOIN week USING (case_id) GROUP BY case_id, events, actors""")
def g37_case_heat(spark, sf):
    """Density of events per actor, share of the densest week, and size."""
    x = owned(spark, sf)
    base = x.groupBy("case_id").agg(F.countDistinct("actor").alias("actors"), F.countDistinct("event").alias("events"))
    week = Window.partitionBy("case_id").orderBy("d").rangeBetween(0, 7)
    per = x.groupBy("case_id", F.unix_date("day").alias("d")).agg(count().alias("n"))
    dense = per.withColumn("w", F.sum("n").over(week)).groupBy("case_id").agg(F.max("w").alias("w"))
    one = F.lit(1.0)
    heat = 0.35 * F.least(F.col("events") / F.col("actors") / 5, one) + 0.35 * (F.col("w") / F.col("events")) + 0.30 * F.least(F.col("events") / 1000, one)
    return base.join(dense, "case_id").select("case_id", F.round(100 * heat, 1).alias("heat"))


@query(f"""WITH {OWNED}, hot AS (SELECT DISTINCT case_id, event FROM owned), cand AS (SELECT h.case_id, l_suppkey AS actor, count(DISTINCT h.event) AS shared FROM hot h JOIN lineitem ON l_orderkey = h.event GROUP BY 1, 2),
known AS (SELECT s_nationkey AS case_id, s_suppkey AS actor FROM supplier)
SELECT case_id, actor, confidence, CASE WHEN confidence >= 67 THEN 'HIGH' WHEN confidence >= 34 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT case_id, actor, least(100, shared * 12) AS confidence, row_number() OVER (PARTITION BY case_id ORDER BY shared DESC, actor) AS r FROM cand c WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.case_id = c.case_id AND k.actor = c.actor)) WHERE r <= 12""")
def g38_case_suggestions(spark, sf):
    """Actors met in all of a case's events that aren't pinned to it, the best twelve of each case."""
    hot = owned(spark, sf).select("case_id", "event").distinct()
    met = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("actor")).distinct()
    cand = hot.join(met, "event").groupBy("case_id", "actor").agg(count().alias("shared"))
    known = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("case_id"), F.col("s_suppkey").alias("actor"))
    best = Window.partitionBy("case_id").orderBy(F.desc("shared"), "actor")
    top = cand.join(known, ["case_id", "actor"], "left_anti").withColumn("r", F.row_number().over(best)).where("r <= 12")
    conf = F.least(F.lit(100), F.col("shared") * 12)
    return top.select("case_id", "actor", conf.alias("confidence"), F.when(conf >= 67, "HIGH").when(conf >= 34, "MEDIUM").otherwise("LOW").alias("level"))


@query()
def g38_case_suggestions_all(spark, sf):
    """The best twelve leads of each case from all of its events: events met by pinned actors, actors met in pinned events, loose artifacts of pinned events.

    A nation's suppliers and its customers' orders are pinned to it; lines are artifacts, the returned ones pinned.
    """
    pinned = owned(spark, sf).select("case_id", "event").distinct()
    known = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("case_id"), F.col("s_suppkey").alias("actor"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("actor"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("artifact"), "l_shipdate", "l_returnflag")
    met, one = li.select("event", "actor").distinct(), F.lit(1).cast("long")

    def best(found, *order):
        return found.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy(*order))).where("r <= 12")

    def leads(found, kind, entity, co, confidence):
        return found.select("case_id", F.lit(kind).alias("kind"), F.col(entity).alias("entity_id"), co.alias("shared"), confidence.cast("int").alias("confidence"), "r")

    artifacts = li.groupBy("event").agg(count().alias("artifacts"))
    hidden = met.join(known, "actor").groupBy("case_id", "event").agg(count().alias("shared")).join(pinned, ["case_id", "event"], "left_anti").join(artifacts, "event")
    events = best(hidden, F.desc("shared"), F.desc("artifacts"), "event").withColumn("top", F.max("shared").over(Window.partitionBy("case_id")))
    sizes = pinned.groupBy("case_id").agg(count().alias("events"))
    actors = best(pinned.join(met, "event").groupBy("case_id", "actor").agg(count().alias("shared")).join(known, ["case_id", "actor"], "left_anti"), F.desc("shared"), "actor").join(sizes, "case_id")
    # The survey takes ten artifacts at most of each case.
    loose = best(pinned.join(li.where("l_returnflag <> 'R'"), "event"), F.desc("l_shipdate"), "artifact").where("r <= 10")
    found = leads(events, "event", "event", F.col("shared"), F.bround(F.col("shared") / F.col("top") * 100))
    found = found.unionByName(leads(actors, "actor", "actor", F.col("shared"), F.bround(F.col("shared") / F.col("events") * 100))).unionByName(leads(loose, "artifact", "artifact", one, F.lit(85)))
    step = F.when(F.col("kind") == "event", 1).when(F.col("kind") == "actor", 2).otherwise(3)
    top = best(found.withColumnRenamed("r", "own"), F.desc("confidence"), F.desc("shared"), step, "own")
    level = F.when(F.col("confidence") >= 67, "HIGH").when(F.col("confidence") >= 34, "MEDIUM").otherwise("LOW")
    return top.select("case_id", F.col("r").alias("place"), "kind", "entity_id", "shared", "confidence", level.alias("level"))


@query(f"""WITH {OWNED}, li AS (SELECT l_orderkey AS event, l_partkey AS artifact FROM lineitem), reach AS (SELECT DISTINCT case_id, artifact FROM owned JOIN li USING (event)), n AS (SELECT artifact, count(*) AS cases FROM reach GROUP BY 1)
SELECT case_id, count(*) FILTER (WHERE cases = 1) AS moved, count(*) FILTER (WHERE cases > 1) AS copied FROM reach JOIN n USING (artifact) GROUP BY case_id""")
def g51_archive_split(spark, sf):
    """Archiving a case moves what only it has and copies what others share."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_partkey").alias("artifact"))
    reach = owned(spark, sf).join(li, "event").select("case_id", "artifact").distinct()
    n = reach.groupBy("artifact").agg(count().alias("cases"))
    return reach.join(n, "artifact").groupBy("case_id").agg(F.count_if(F.col("cases") == 1).alias("moved"), F.count_if(F.col("cases") > 1).alias("copied"))


@query("""WITH n AS (SELECT min(c_custkey) AS k, norm FROM (SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS norm FROM customer) WHERE norm <> '' GROUP BY norm)
SELECT a.k AS a, b.k AS b, round(jaro_winkler_similarity(a.norm, b.norm), 6) AS similarity FROM n a JOIN n b ON a.k < b.k WHERE jaro_winkler_similarity(a.norm, b.norm) >= 0.98""")
def j18_fuzzy_names(spark, sf):
    """All names alike by Jaro-Winkler; equal ones are one name, under its least id."""
    names = table(spark, sf, "customer").groupBy(normal_name(F.col("c_name")).alias("norm")).agg(F.min("c_custkey").alias("id"))
    return N.alike(names).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("SELECT l_suppkey AS actor, count(*) AS mentions, count(DISTINCT l_orderkey) AS signals, round(least(0.5 + 0.1 * count(DISTINCT l_orderkey), 0.95), 4) AS confidence FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2")
def g42_promote_entities(spark, sf):
    """Entities seen twice or more that aren't on the block list, with a confidence that grows with their signals."""
    blocked = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    seen = table(spark, sf, "lineitem").where("l_returnflag = 'R'").join(blocked, "l_suppkey", "left_anti")
    n = seen.groupBy(F.col("l_suppkey").alias("actor")).agg(count().alias("mentions"), F.countDistinct("l_orderkey").alias("signals")).where("signals >= 2")
    return n.withColumn("confidence", F.round(F.least(0.5 + 0.1 * F.col("signals"), F.lit(0.95)), 4))


@query("""WITH x AS (SELECT user_id AS actor, count(DISTINCT event_type) AS diversity, max(value) AS top FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT actor, diversity, round(top, 4) AS top FROM x WHERE (diversity >= 4 OR top >= 250) AND actor NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' AND user_id IS NOT NULL) ORDER BY diversity DESC, top DESC, actor LIMIT 50""")
def g41_observer_candidates(spark, sf):
    """Actors worth a look, less those in their cool-down; the best fifty."""
    e = table(spark, sf, "events")
    cooling = e.where("ts >= timestamp'2024-01-30 00:00:00'").select(F.col("user_id").alias("actor"))
    x = e.where("value is not null").groupBy(F.col("user_id").alias("actor")).agg(F.countDistinct("event_type").alias("diversity"), F.max("value").alias("top")).where("diversity >= 4 or top >= 250")
    return x.join(cooling, "actor", "left_anti").orderBy(F.desc("diversity"), F.desc("top"), "actor").limit(50).select("actor", "diversity", F.round("top", 4).alias("top"))


@query(f"""WITH {OWNED}, ctx AS (SELECT DISTINCT case_id, actor FROM owned) SELECT o.case_id, count(*) AS items, round(avg(CASE WHEN e % 3 = 0 THEN 0.5 ELSE 0 END + CASE WHEN e % 4 = 0 THEN 0.3 ELSE 0 END + 0.2 * least(CAST(e % 5 AS DOUBLE) / 4, 1)), 4) AS gravity FROM (SELECT case_id, event AS e FROM owned) o JOIN (SELECT case_id FROM ctx GROUP BY 1) USING (case_id) GROUP BY 1""")
def g09_case_gravity(spark, sf):
    """Mean case gravity: half for a matching actor, three tenths for a near place, up to two for keywords."""
    e = F.col("event")
    score = F.when(e % 3 == 0, 0.5).otherwise(0.0) + F.when(e % 4 == 0, 0.3).otherwise(0.0) + 0.2 * F.least((e % 5).cast("double") / 4, F.lit(1.0))
    return owned(spark, sf).groupBy("case_id").agg(count().alias("items"), F.round(F.avg(score), 4).alias("gravity"))


@query("SELECT event_type AS component, strftime(max(ts), '%Y-%m-%d %H:%M') AS run_at, arg_max(CASE WHEN value > 0 THEN 'ok' ELSE 'failed' END, (ts, event_id)) AS status, count(*) AS runs FROM events GROUP BY 1")
def k07_pipeline_runs(spark, sf):
    state = F.when(F.col("value") > 0, "ok").otherwise("failed")
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("component")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm").alias("run_at"), F.max_by(state, F.struct("ts", "event_id")).alias("status"), count().alias("runs"))


