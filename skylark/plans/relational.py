"""Filters, joins, aggregates, set operations and paging over the given tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from skylark.adapters import ACTOR_EVENTS, PART_ORDERS, SIGNALS, actor_events, actor_links, part_orders, signals, table
from skylark.operators import joins
from skylark.plans.registry import query

def count():
    return F.count(F.lit(1))



@query(f"WITH {SIGNALS} SELECT stream, count(*) AS n FROM signals WHERE source_type = 'live' GROUP BY stream")
def p01_lens_filter(spark, sf):
    return signals(spark, sf).where("source_type = 'live'").groupBy("stream").agg(count().alias("n"))


@query(f"WITH {SIGNALS} SELECT signal_id, source, is_priority FROM signals WHERE source IN ('error','purchase') AND ts >= TIMESTAMP '2024-01-29 00:00:00' AND status IN ('raw','promoted') AND is_priority = 1")
def p02_dynamic_filters(spark, sf):
    wanted = {"source": ["error", "purchase"], "status": ["raw", "promoted"], "is_priority": [1]}
    keep = F.col("ts") >= F.to_timestamp(F.lit("2024-01-29 00:00:00"))
    for name, values in wanted.items():
        keep = keep & F.col(name).isin(values)
    return signals(spark, sf).where(keep).select("signal_id", "source", "is_priority")


@query(f"""WITH {SIGNALS} SELECT signal_id, stream, CASE WHEN is_priority = 1 AND stream = 'CRIME_INTEL' THEN 'crime' WHEN k >= 95 THEN 'magnitude' WHEN value > 150 AND source <> 'click' THEN 'value' ELSE 'seed' END AS gate
FROM signals WHERE status <> 'dismissed' AND ((is_priority = 1 AND stream = 'CRIME_INTEL') OR k >= 95 OR (value > 150 AND source NOT LIKE 'clic%') OR (source_type = 'seed' AND source LIKE '%up%'))""")
def p05_alert_gates(spark, sf):
    crime, size = (F.col("is_priority") == 1) & (F.col("stream") == "CRIME_INTEL"), F.col("k") >= 95
    worth, seed = (F.col("value") > 150) & ~F.col("source").like("clic%"), (F.col("source_type") == "seed") & F.col("source").like("%up%")
    gate = F.when(crime, "crime").when(size, "magnitude").when((F.col("value") > 150) & (F.col("source") != "click"), "value").otherwise("seed")
    return signals(spark, sf).where((F.col("status") != "dismissed") & (crime | size | worth | seed)).select("signal_id", "stream", gate.alias("gate"))


@query(f"WITH {SIGNALS} SELECT signal_id FROM signals WHERE lat BETWEEN -30.0 AND -28.0 AND abs(lng - 20.0) < 1 AND lat IS NOT NULL AND lat <> 0")
def p06_box_predicate(spark, sf):
    return signals(spark, sf).where(F.col("lat").between(-30.0, -28.0) & (F.abs(F.col("lng") - 20.0) < 1) & F.col("lat").isNotNull() & (F.col("lat") != 0)).select("signal_id")


@query("SELECT doc_id, lang FROM documents WHERE lower(text) LIKE '%license%' OR lower(text) LIKE '%token%' OR lower(text) LIKE '%reserved%'")
def p09_keyword_any(spark, sf):
    low = F.lower("text")
    return table(spark, sf, "documents").where(low.contains("license") | low.contains("token") | low.contains("reserved")).select("doc_id", "lang")


REPORT = "ships left nation_3 for nation_17 by way of nation_20"


@query(f"SELECT n_nationkey, n_name FROM nation WHERE '{REPORT}' LIKE '%' || lower(n_name) || '%'")
def p10_reverse_like(spark, sf):
    return table(spark, sf, "nation").where(F.instr(F.lit(REPORT), F.lower("n_name")) > 0).select("n_nationkey", "n_name")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 7500 THEN 'CRITICAL' WHEN c_acctbal >= 5000 THEN 'HIGH' WHEN c_acctbal >= 2500 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM customer")
def p11_threat_levels(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", F.when(b >= 7500, "CRITICAL").when(b >= 5000, "HIGH").when(b >= 2500, "MEDIUM").otherwise("LOW").alias("level"))


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS snippet, concat_ws(' | ', lang, source) AS summary FROM documents")
def p13_snippets(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.when(F.char_length(t) > 120, F.concat(F.substring(t, 1, 120), F.lit("..."))).otherwise(t).alias("snippet"), F.concat_ws(" | ", "lang", "source").alias("summary"))


@query(f"WITH {SIGNALS} SELECT signal_id, status, k FROM signals ORDER BY CASE status WHEN 'promoted' THEN 0 WHEN 'raw' THEN 1 ELSE 2 END, k DESC NULLS LAST, signal_id LIMIT 50")
def p14_status_rank(spark, sf):
    rank = F.when(F.col("status") == "promoted", 0).when(F.col("status") == "raw", 1).otherwise(2)
    return signals(spark, sf).orderBy(rank, F.col("k").desc_nulls_last(), "signal_id").limit(50).select("signal_id", "status", "k")


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
def j01_inner_chain(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    totals = c.groupBy("c_nationkey").agg(count().alias("customers"), F.sum("c_acctbal").alias("b"))
    return totals.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.sum("customers").alias("customers"), F.round(F.sum("b"), 2).alias("balance"))


@query("SELECT c_custkey, count(o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def j02_left_aggregate(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(count().alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return table(spark, sf, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("spent", F.lit(0.0)).alias("spent"))


@query(f"WITH {ACTOR_EVENTS} SELECT a.actor_id AS a, b.actor_id AS b, count(*) AS shared, least(1.0, CAST(count(*) AS DOUBLE) / 10) AS confidence FROM actor_events a JOIN actor_events b ON a.event_id = b.event_id AND a.actor_id < b.actor_id GROUP BY 1, 2 HAVING count(*) >= 2")
def g44_cooccurrence(spark, sf):
    pairs = joins.shared_key_pairs(actor_links(spark, sf), "actor_id", "event_id").where("shared >= 2")
    return pairs.withColumn("confidence", F.least(F.lit(1.0), F.col("shared") / F.lit(10.0)))


@query(f"WITH {ACTOR_EVENTS} SELECT a.actor_id AS actor, b.actor_id AS other, count(*) AS shared FROM actor_events a JOIN actor_events b ON a.event_id = b.event_id AND a.actor_id <> b.actor_id GROUP BY 1, 2 HAVING count(*) >= 3")
def j04_both_directions(spark, sf):
    pairs = joins.shared_key_pairs(actor_links(spark, sf), "actor_id", "event_id").where("shared >= 3")
    return pairs.select(F.col("a").alias("actor"), F.col("b").alias("other"), "shared").unionByName(pairs.select(F.col("b").alias("actor"), F.col("a").alias("other"), "shared"))


@query(f"""WITH {ACTOR_EVENTS}, pairs AS (SELECT a.actor_id AS a, b.actor_id AS b, count(*) AS shared FROM actor_events a JOIN actor_events b ON a.event_id = b.event_id AND a.actor_id < b.actor_id GROUP BY 1, 2)
SELECT x.s_name AS name_a, y.s_name AS name_b, shared FROM pairs JOIN supplier x ON a = x.s_suppkey JOIN supplier y ON b = y.s_suppkey""")
def j05_both_endpoints(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    pairs = joins.shared_key_pairs(actor_links(spark, sf), "actor_id", "event_id")
    return pairs.join(s.toDF("a", "name_a"), "a").join(s.toDF("b", "name_b"), "b").select("name_a", "name_b", "shared")


@query(f"""WITH {ACTOR_EVENTS}, pairs AS (SELECT a.actor_id AS a, b.actor_id AS b, count(*) AS shared FROM actor_events a JOIN actor_events b ON a.event_id = b.event_id AND a.actor_id < b.actor_id GROUP BY 1, 2)
SELECT s_name AS peer, shared FROM pairs JOIN supplier ON s_suppkey = CASE WHEN a = 7 THEN b ELSE a END WHERE a = 7 OR b = 7""")
def j06_peers(spark, sf):
    pairs = joins.shared_key_pairs(actor_links(spark, sf), "actor_id", "event_id").where("a = 7 or b = 7")
    peer = pairs.select(F.when(F.col("a") == 7, F.col("b")).otherwise(F.col("a")).alias("s_suppkey"), "shared")
    return peer.join(table(spark, sf, "supplier"), "s_suppkey").select(F.col("s_name").alias("peer"), "shared")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000 UNION SELECT user_id FROM events WHERE event_type = 'purchase')")
def j07_semi_over_union(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    bought = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    return table(spark, sf, "customer").join(big.unionByName(bought), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def j08_anti(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey")


@query(f"""WITH {SIGNALS} SELECT s.signal_id FROM signals s WHERE s.source = 'signup' AND EXISTS (SELECT 1 FROM signals p WHERE p.is_priority = 1 AND p.source = 'error' AND s.lat BETWEEN p.lat - 0.45 AND p.lat + 0.45 AND s.lng BETWEEN p.lng - 0.45 AND p.lng + 0.45)""")
def j09_box_semi(spark, sf):
    s = signals(spark, sf)
    return joins.box_exists(s.where("source = 'signup'").select("signal_id", "lat", "lng"), s.where("is_priority = 1 and source = 'error'"), 0.45).select("signal_id")


@query(f"""WITH {SIGNALS} SELECT s.signal_id FROM signals s WHERE s.source = 'signup' AND NOT EXISTS (SELECT 1 FROM signals p WHERE p.is_priority = 1 AND p.source = 'error' AND s.lat BETWEEN p.lat - 0.9 AND p.lat + 0.9 AND s.lng BETWEEN p.lng - 0.9 AND p.lng + 0.9)""")
def j09_box_anti(spark, sf):
    s = signals(spark, sf)
    return joins.box_exists(s.where("source = 'signup'").select("signal_id", "lat", "lng"), s.where("is_priority = 1 and source = 'error'"), 0.9, "left_anti").select("signal_id")


@query("SELECT a.c_nationkey AS case_a, b.c_nationkey AS case_b, count(DISTINCT a.p) AS shared FROM (SELECT DISTINCT c_nationkey, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) a JOIN (SELECT DISTINCT c_nationkey, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) b ON a.p = b.p AND a.c_nationkey <> b.c_nationkey GROUP BY 1, 2")
def j12_case_overlap(spark, sf):
    li, o, c = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    owned = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).select("c_nationkey", "l_partkey")
    pairs = joins.shared_key_pairs(owned, "c_nationkey", "l_partkey")
    return pairs.select(F.col("a").alias("case_a"), F.col("b").alias("case_b"), "shared").unionByName(pairs.select(F.col("b").alias("case_a"), F.col("a").alias("case_b"), "shared"))


@query("SELECT c_nationkey AS case_id, count(DISTINCT o_custkey) AS actors, count(DISTINCT o_orderkey) AS events, count(DISTINCT l_partkey) AS artifacts FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size > 20 GROUP BY 1")
def j13_cross_links(spark, sf):
    c, o, li, p = (table(spark, sf, t) for t in ("customer", "orders", "lineitem", "part"))
    x = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(p.where("p_size > 20"), F.col("p_partkey") == F.col("l_partkey"))
    return x.groupBy(F.col("c_nationkey").alias("case_id")).agg(F.countDistinct("o_custkey").alias("actors"), F.countDistinct("o_orderkey").alias("events"), F.countDistinct("l_partkey").alias("artifacts"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def j20_latest_per_key(spark, sf):
    row = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id"))
    return table(spark, sf, "events").groupBy("user_id").agg(row.alias("r")).select("user_id", "r.event_id", "r.event_type", "r.value")


@query("WITH x AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) SELECT s, count(*) FILTER (WHERE n > 1) AS shared, count(*) FILTER (WHERE n = 1) AS exclusive FROM x JOIN (SELECT p, count(*) AS n FROM x GROUP BY p) USING (p) GROUP BY s")
def j22_shared_exclusive(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct()
    n = x.groupBy("p").agg(count().alias("n"))
    return x.join(n, "p").groupBy("s").agg(F.count_if(F.col("n") > 1).alias("shared"), F.count_if(F.col("n") == 1).alias("exclusive"))


@query(f"""WITH {ACTOR_EVENTS}, pairs AS (SELECT a.actor_id AS a, b.actor_id AS b, count(*) AS w FROM actor_events a JOIN actor_events b ON a.event_id = b.event_id AND a.actor_id < b.actor_id GROUP BY 1, 2),
merged AS (SELECT a - a % 5 AS x, b - b % 5 AS y, w FROM pairs)
SELECT least(x, y) AS a, greatest(x, y) AS b, max(w) AS w FROM merged WHERE x <> y GROUP BY 1, 2""")
def j23_merge_aliases(spark, sf):
    pairs = joins.shared_key_pairs(actor_links(spark, sf), "actor_id", "event_id")
    canonical = lambda c: F.col(c) - F.col(c) % 5
    merged = pairs.select(canonical("a").alias("x"), canonical("b").alias("y"), "shared").where("x <> y")
    return merged.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("shared").alias("w"))


@query(f"WITH {SIGNALS} SELECT stream, count(*) AS n, sum(is_priority) AS priority, count(*) FILTER (WHERE status = 'promoted') AS promoted, count(DISTINCT actor_id) AS actors, count(DISTINCT CASE WHEN is_priority = 1 THEN actor_id END) AS priority_actors, round(avg(value), 4) AS mean_value, min(k) AS low, max(k) AS high FROM signals GROUP BY stream")
def a02_conditional_counts(spark, sf):
    return signals(spark, sf).groupBy("stream").agg(
        count().alias("n"), F.sum("is_priority").alias("priority"), F.count_if(F.col("status") == "promoted").alias("promoted"), F.countDistinct("actor_id").alias("actors"),
        F.countDistinct(F.when(F.col("is_priority") == 1, F.col("actor_id"))).alias("priority_actors"), F.round(F.avg("value"), 4).alias("mean_value"), F.min("k").alias("low"), F.max("k").alias("high"),
    )


@query(f"WITH {SIGNALS} SELECT actor_id, string_agg(DISTINCT stream, ',' ORDER BY stream) AS streams, count(*) AS n FROM signals GROUP BY actor_id HAVING count(*) > 5")
def a06_group_concat(spark, sf):
    return signals(spark, sf).groupBy("actor_id").agg(F.array_join(F.sort_array(F.collect_set("stream")), ",").alias("streams"), count().alias("n")).where("n > 5")


@query(f"WITH {SIGNALS} SELECT actor_id, max(value) AS top, arg_max(signal_id, (value, signal_id)) AS at FROM signals WHERE value IS NOT NULL GROUP BY actor_id")
def a07_row_of_max(spark, sf):
    return signals(spark, sf).where("value is not null").groupBy("actor_id").agg(F.max("value").alias("top"), F.max_by("signal_id", F.struct("value", "signal_id")).alias("at"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang ORDER BY n DESC, source, lang LIMIT 15")
def a08_top_facets(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(count().alias("n")).orderBy(F.desc("n"), "source", "lang").limit(15)


@query(f"WITH {SIGNALS} SELECT CAST(floor(lat) AS BIGINT) AS y, CAST(floor(lng) AS BIGINT) AS x, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, count(*) AS n, max(is_priority) AS any_priority FROM signals GROUP BY 1, 2")
def a09_centroids(spark, sf):
    s = signals(spark, sf)
    return s.groupBy(F.floor("lat").alias("y"), F.floor("lng").alias("x")).agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng"), count().alias("n"), F.max("is_priority").alias("any_priority"))


@query("SELECT c_nationkey AS case_id, count(DISTINCT c_custkey) AS actors, count(DISTINCT o_orderkey) AS events, round(avg(o_totalprice), 2) AS coe FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def a11_case_rollup(spark, sf):
    """The mean is over joined rows, so that events with more rows weigh more: kept on purpose."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(count().alias("rows"))
    x = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy(F.col("c_nationkey").alias("case_id")).agg(F.countDistinct("c_custkey").alias("actors"), F.countDistinct("o_orderkey").alias("events"), F.round(F.sum(F.col("o_totalprice") * F.col("rows")) / F.sum("rows"), 2).alias("coe"))


@query(f"WITH {SIGNALS} SELECT actor_id, stream, n FROM (SELECT actor_id, stream, count(*) AS n, row_number() OVER (PARTITION BY actor_id ORDER BY count(*) DESC, stream) AS r FROM signals GROUP BY actor_id, stream) WHERE r = 1")
def a12_dominant_stream(spark, sf):
    n = signals(spark, sf).groupBy("actor_id", "stream").agg(count().alias("n"))
    return joins.latest(n, "actor_id", F.desc("n"), F.asc("stream"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS std, round(min(value), 4) AS low, round(max(value), 4) AS high FROM events GROUP BY event_type")
def a16_mean_std(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(count().alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 4).alias("std"), F.round(F.min(v), 4).alias("low"), F.round(F.max(v), 4).alias("high"))


@query("SELECT s_suppkey, CASE WHEN hi = lo THEN 0.0 ELSE round((s_acctbal - lo) / (hi - lo), 6) END AS scaled FROM supplier, (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)")
def a17_min_max(spark, sf):
    s = table(spark, sf, "supplier")
    low, high = s.agg(F.min("s_acctbal"), F.max("s_acctbal")).first()
    return s.select("s_suppkey", (F.round((F.col("s_acctbal") - F.lit(low)) / F.lit(high - low), 6) if high and high != low else F.lit(0.0)).alias("scaled"))


@query(f"WITH {SIGNALS} SELECT actor_id, round(avg(value), 4) AS gravity, arg_min(status, (-n, status)) AS vote, sum(n) AS n FROM (SELECT actor_id, status, count(*) AS n, avg(value) AS value FROM signals GROUP BY 1, 2) GROUP BY actor_id")
def a18_merge_results(spark, sf):
    each = signals(spark, sf).groupBy("actor_id", "status").agg(count().alias("n"), F.avg("value").alias("value"))
    return each.groupBy("actor_id").agg(F.round(F.avg("value"), 4).alias("gravity"), F.min_by("status", F.struct(-F.col("n"), "status")).alias("vote"), F.sum("n").alias("n"))


@query("SELECT n_regionkey, string_agg(n_nationkey || ':' || n_name, ';' ORDER BY n_nationkey) AS members, count(*) AS size FROM nation GROUP BY n_regionkey")
def a21_nested_groups(spark, sf):
    members = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(members, lambda m: F.concat_ws(":", m["n_nationkey"].cast("string"), m["n_name"])), ";").alias("members"), count().alias("size"))


@query("SELECT DISTINCT actor, event FROM (SELECT l_suppkey AS actor, l_orderkey AS event FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_suppkey, l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00')")
def u01_union_distinct(spark, sf):
    li = table(spark, sf, "lineitem")
    pick = lambda cond: li.where(cond).select(F.col("l_suppkey").alias("actor"), F.col("l_orderkey").alias("event"))
    return pick("l_returnflag = 'R'").union(pick("l_shipdate >= timestamp'1998-01-01 00:00:00'")).distinct()


@query("SELECT 'customer' AS kind, c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'part', p_brand, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'order', o_orderpriority, count(*) FROM orders GROUP BY 2")
def u03_union_of_groups(spark, sf):
    parts = [("customer", "customer", "c_mktsegment"), ("part", "part", "p_brand"), ("order", "orders", "o_orderpriority")]
    grouped = [table(spark, sf, t).groupBy(F.col(c).alias("label")).agg(count().alias("n")).select(F.lit(k).alias("kind"), "label", "n") for k, t, c in parts]
    return grouped[0].unionByName(grouped[1]).unionByName(grouped[2])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def o02_page(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT id, kind, score FROM (SELECT c_custkey AS id, 'customer' AS kind, c_acctbal AS score, 0 AS r FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT s_suppkey, 'supplier', s_acctbal, 1 FROM supplier) ORDER BY r, score DESC, id LIMIT 40")
def o04_padded_top(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("score"), F.lit(0).alias("r"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("score"), F.lit(1).alias("r"))
    return c.unionByName(s).orderBy("r", F.desc("score"), "id").limit(40).drop("r")


@query("SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL) GROUP BY 1 UNION ALL SELECT -1, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL)")
def g54_orphans(spark, sf):
    c, o, li = (table(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    lost = o.join(c, o.o_custkey == c.c_custkey, "left_anti").groupBy(F.col("o_custkey").alias("k")).agg(count().alias("n"))
    return lost.unionByName(li.join(o, li.l_orderkey == o.o_orderkey, "left_anti").agg(count().alias("n")).select(F.lit(-1).cast("long").alias("k"), "n"))


@query(f"""WITH {SIGNALS}, old AS (SELECT signal_id AS id, k AS a FROM signals WHERE signal_id % 3 <> 0), new AS (SELECT signal_id AS id, k + 1 AS a FROM signals WHERE signal_id % 2 = 0)
SELECT coalesce(o.id, n.id) AS id, o.a AS ignored, coalesce(n.a, o.a) AS replaced, coalesce(o.a, 0) + coalesce(n.a, 0) AS added FROM old o FULL JOIN new n ON o.id = n.id""")
def k01_upserts(spark, sf):
    """Insert-or-ignore (null where the old table lacks the row), replace and additive merge of two versions of a table."""
    s = signals(spark, sf)
    old, new = s.where("signal_id % 3 <> 0").select(F.col("signal_id").alias("id"), F.col("k").alias("o")), s.where("signal_id % 2 = 0").select(F.col("signal_id").alias("id"), (F.col("k") + 1).alias("n"))
    zero = F.lit(0)
    return old.join(new, "id", "full").select("id", F.col("o").alias("ignored"), F.coalesce("n", "o").alias("replaced"), (F.coalesce("o", zero) + F.coalesce("n", zero)).alias("added"))


@query(f"""WITH {SIGNALS} SELECT signal_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || printf('%.4f', lng) || ',' || printf('%.4f', lat) || ']}},"properties":{{"stream":"' || stream || '"}}}}' AS feature FROM signals WHERE is_priority = 1 ORDER BY ts DESC, signal_id LIMIT 2000""")
def k04_geojson(spark, sf):
    point = F.format_string('{"type":"Feature","geometry":{"type":"Point","coordinates":[%.4f,%.4f]},"properties":{"stream":"%s"}}', "lng", "lat", "stream")
    return signals(spark, sf).where("is_priority = 1").orderBy(F.desc("ts"), "signal_id").limit(2000).select("signal_id", point.alias("feature"))


@query(f"WITH {PART_ORDERS} SELECT actor_id, count(DISTINCT event_id) AS events, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day FROM part_orders GROUP BY actor_id")
def g55_actor_dossier(spark, sf):
    return part_orders(spark, sf).groupBy("actor_id").agg(F.countDistinct("event_id").alias("events"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


