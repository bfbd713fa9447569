"""Rankings, cut-offs, rolling baselines and time buckets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skylark.adapters import PART_ORDERS, SIGNALS, part_orders, signals, table
from skylark.functions.scores import z_confidence
from skylark.operators import joins
from skylark.params import Anomaly, Emergence
from skylark.operators.ordered import numbered
from skylark.plans.registry import query

def count():
    return F.count(F.lit(1))



@query("SELECT min(v) AS p90, count(*) AS n FROM (SELECT o_totalprice AS v, ntile(10) OVER (ORDER BY o_totalprice DESC, o_orderkey) AS d FROM orders WHERE o_totalprice > 0) WHERE d = 1")
def w01_top_decile(spark, sf):
    """The least value of the top tenth of positive scores: the value at the tenth's last place, found by counts of range partitions; nothing is sorted as a whole."""
    o = table(spark, sf, "orders").where("o_totalprice > 0")
    n = o.count()
    size = n // 10 + (1 if n % 10 else 0)
    return spark.range(1).select(F.lit(joins.value_at(o, "o_totalprice", size - 1)).cast("double").alias("p90"), F.lit(size).cast("long").alias("n"))


@query("WITH x AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS r, count(*) OVER () AS n FROM supplier) SELECT s_suppkey, s_acctbal FROM x WHERE s_acctbal >= (SELECT s_acctbal FROM x WHERE r = greatest(0, CAST(floor(n * 0.75) AS BIGINT) - 1) + 1)")
def w02_percentile_cut(spark, sf):
    """Keeps the top 75 %: the cut is the value at index int(n * 0.75) - 1 of the descending list."""
    s = table(spark, sf, "supplier")
    cut = joins.top_share_cut(s, "s_acctbal", 0.75)
    return s.where(F.col("s_acctbal") >= F.lit(cut)).select("s_suppkey", "s_acctbal")


P = Anomaly()
DAILY = """days AS (SELECT source, CAST(floor(lat / 4) AS BIGINT) AS y, CAST(ts AS DATE) AS day, count(*) AS n FROM signals GROUP BY 1, 2, 3)"""
Z_SQL = f"""WITH {SIGNALS}, {DAILY},
stats AS (SELECT a.source, a.y, a.day, a.n, count(b.day) AS days, avg(b.n) AS mean, stddev_samp(b.n) AS std FROM days a JOIN days b ON a.source = b.source AND a.y = b.y AND b.day BETWEEN a.day - 30 AND a.day - 1 GROUP BY 1, 2, 3, 4)
SELECT source, y, CAST(day AS VARCHAR) AS day, n, round((n - mean) / std, 4) AS z,
round(least(0.95, 1 / (1 + exp(1.4)) + (0.95 - 1 / (1 + exp(1.4))) / (1 + exp(-0.7 * ((n - mean) / std - 2)))), 3) AS confidence
FROM stats WHERE days >= 7 AND std >= 0.5 AND (n - mean) / std > 2"""


@query(Z_SQL)
def g15_rolling_z_alerts(spark, sf):
    """Daily counts by source and latitude band against the 30 days before: at least 7 days, deviation 0.5, z over 2."""
    days = signals(spark, sf).groupBy("source", F.floor(F.col("lat") / 4).alias("y"), F.to_date("ts").alias("day")).agg(count().alias("n"))
    before = Window.partitionBy("source", "y").orderBy(F.unix_date("day")).rangeBetween(-P.baseline_days, -1)
    known = days.withColumns({"days": F.count("n").over(before), "mean": F.avg("n").over(before), "std": F.stddev_samp("n").over(before)})
    z = (F.col("n") - F.col("mean")) / F.col("std")
    alerts = known.where((F.col("days") >= P.min_days) & (F.col("std") >= P.min_std)).withColumn("z", z).where(F.col("z") > P.z)
    return alerts.select("source", "y", F.col("day").cast("string").alias("day"), "n", F.round("z", 4).alias("z"), z_confidence(F.col("z")).alias("confidence"))


@query(f"WITH {SIGNALS} SELECT CAST(ts AS DATE)::VARCHAR AS bucket_date, source, CAST(floor(lat) AS BIGINT)::VARCHAR || ':' || CAST(floor(lng) AS BIGINT)::VARCHAR AS region_key, count(*) AS daily_count FROM signals GROUP BY 1, 2, 3")
def g14_daily_baselines(spark, sf):
    key = F.concat_ws(":", F.floor("lat").cast("string"), F.floor("lng").cast("string"))
    return signals(spark, sf).groupBy(F.to_date("ts").cast("string").alias("bucket_date"), "source", key.alias("region_key")).agg(count().alias("daily_count"))


@query(f"""WITH {PART_ORDERS}, w AS (SELECT actor_id, count(DISTINCT event_id) FILTER (WHERE day > DATE '1997-06-30' AND day <= DATE '1997-12-31') AS now_n, count(DISTINCT event_id) FILTER (WHERE day > DATE '1996-12-31' AND day <= DATE '1997-06-30') AS base_n FROM part_orders GROUP BY 1)
SELECT actor_id, now_n, base_n, round(CAST(now_n AS DOUBLE) / greatest(base_n, 1), 4) AS growth, round(ln(1 + CAST(now_n AS DOUBLE) / greatest(base_n, 1)) * now_n, 4) AS score FROM w WHERE now_n >= 3 AND CAST(now_n AS DOUBLE) / greatest(base_n, 1) >= 2""")
def g28_emergence(spark, sf):
    """Growth of actors between two adjacent windows; one pass with conditional counts."""
    e = Emergence()
    d = lambda x: F.to_date(F.lit(x))
    within = lambda a, b: F.countDistinct(F.when((F.col("day") > d(a)) & (F.col("day") <= d(b)), F.col("event_id")))
    w = part_orders(spark, sf).groupBy("actor_id").agg(within("1997-06-30", "1997-12-31").alias("now_n"), within("1996-12-31", "1997-06-30").alias("base_n"))
    growth = F.col("now_n") / F.greatest(F.col("base_n"), F.lit(1))
    return w.where((F.col("now_n") >= e.min_count) & (growth >= e.min_growth)).select("actor_id", "now_n", "base_n", F.round(growth, 4).alias("growth"), F.round(F.log1p(growth) * F.col("now_n"), 4).alias("score"))


@query("""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day FROM events), m AS (SELECT min(event_id) AS low, max(event_id) AS high FROM events),
p AS (SELECT day AS pulse, lang AS seed, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS tag FROM documents, m JOIN e ON event_id = low + doc_id % (high - low + 1)),
c AS (SELECT pulse, seed, tag, count(*) AS n FROM p GROUP BY 1, 2, 3), k AS (SELECT pulse, lag(pulse) OVER (ORDER BY pulse) AS before FROM (SELECT DISTINCT day AS pulse FROM e)),
a AS (SELECT k.pulse, seed, tag, n AS latest, 0 AS previous FROM c JOIN k USING (pulse) UNION ALL SELECT k.pulse, seed, tag, 0, n FROM c JOIN k ON k.before = c.pulse)
SELECT strftime(pulse, '%Y-%m-%d') AS pulse, seed, tag, CAST(sum(latest) AS BIGINT) AS latest, CAST(sum(previous) AS BIGINT) AS previous, round(CAST(sum(latest) AS DOUBLE) / greatest(sum(previous), 1), 4) AS velocity FROM a GROUP BY 1, 2, 3 HAVING sum(latest) + sum(previous) >= 2""", also=["g35_tag_velocity_all"])
def g35_tag_velocity(spark, sf):
    """Counts of all words of all documents by pulse against the pulse before it, for every pulse.

    Documents carry no time: the days of `events`, dealt by id, are their pulses. Each count is told to its own pulse and to the next one.
    """
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"))
    low, high = e.agg(F.min("event_id"), F.max("event_id")).first()
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    d = table(spark, sf, "documents").select(F.col("lang").alias("seed"), words.alias("w"), (F.lit(low) + F.col("doc_id") % (high - low + 1)).alias("event_id"))
    c = d.join(e, "event_id").select("day", "seed", F.explode("w").alias("tag")).groupBy("day", "seed", "tag").agg(count().alias("n"))
    # One row for each day, so the order of days is a small window.
    days = e.select("day").distinct().withColumn("after", F.lead("day").over(Window.orderBy("day")))
    told = F.explode(F.array(F.struct(F.col("day").alias("pulse"), F.col("n").alias("latest"), F.lit(0).cast("long").alias("previous")), F.struct(F.col("after").alias("pulse"), F.lit(0).cast("long").alias("latest"), F.col("n").alias("previous"))))
    x = c.join(F.broadcast(days), "day").select("seed", "tag", told.alias("t")).select("seed", "tag", "t.*").where("pulse is not null")
    x = x.groupBy("pulse", "seed", "tag").agg(F.sum("latest").alias("latest"), F.sum("previous").alias("previous")).where("latest + previous >= 2")
    return x.select(F.date_format("pulse", "yyyy-MM-dd").alias("pulse"), "seed", "tag", "latest", "previous", F.round(F.col("latest") / F.greatest(F.col("previous"), F.lit(1)), 4).alias("velocity"))


@query(f"""WITH {SIGNALS}, c AS (SELECT a.signal_id, a.actor_id, (SELECT count(*) FROM signals b WHERE b.actor_id = a.actor_id AND b.ts > a.ts - INTERVAL 24 HOUR AND b.ts <= a.ts) AS n FROM signals a) SELECT signal_id, actor_id, n FROM c WHERE n >= 3""")
def w06_surge(spark, sf):
    """Signals whose actor has three or more in the 24 hours up to them."""
    day = Window.partitionBy("actor_id").orderBy(F.unix_micros("ts")).rangeBetween(-86_400_000_000 + 1, 0)
    return signals(spark, sf).withColumn("n", F.count(F.lit(1)).over(day)).where("n >= 3").select("signal_id", "actor_id", "n")


@query("""WITH d AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders), c AS (SELECT a.k, a.day, count(*) AS n FROM (SELECT DISTINCT k, day FROM d) a JOIN d b ON a.k = b.k AND b.day BETWEEN a.day AND a.day + 7 GROUP BY 1, 2)
SELECT k, max(n) AS densest FROM c GROUP BY k""")
def w07_densest_week(spark, sf):
    week = Window.partitionBy("k").orderBy("day").rangeBetween(0, 7)
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.unix_date(F.to_date("o_orderdate")).alias("day"))
    return d.withColumn("n", F.count(F.lit(1)).over(week)).groupBy("k").agg(F.max("n").alias("densest"))


@query(f"""WITH {SIGNALS}, spine AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-28 00:00:00', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS h)
SELECT strftime(h, '%Y-%m-%d %H') AS hour, count(signal_id) AS n, coalesce(sum(is_priority), 0) AS priority FROM spine LEFT JOIN signals ON date_trunc('hour', ts) = h GROUP BY 1""")
def w08_hourly_spine(spark, sf):
    """Hourly counts without gaps: the few hours of the spine take the grouped counts."""
    per = signals(spark, sf).where("ts >= timestamp'2024-01-28 00:00:00' and ts < timestamp'2024-01-31 00:00:00'").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(count().alias("n"), F.sum("is_priority").alias("p"))
    spine = spark.sql("select explode(sequence(timestamp'2024-01-28 00:00:00', timestamp'2024-01-30 23:00:00', interval 1 hour)) as h")
    return spine.join(per, "h", "left").select(F.date_format("h", "yyyy-MM-dd HH").alias("hour"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("p", F.lit(0)).alias("priority"))


@query(f"""WITH {SIGNALS} SELECT CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 2) AS BIGINT) AS bucket48, strftime(ts, '%Y%m') AS month, CAST(strftime(ts, '%W') AS INTEGER) AS week, count(*) AS n FROM signals GROUP BY 1, 2, 3""")
def w09_time_buckets(spark, sf):
    """48-hour buckets since the epoch, months, and weeks of the year that begin on Monday (week 0 before the first)."""
    day = F.to_date("ts")
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7).cast("int")
    return signals(spark, sf).groupBy(F.floor(F.unix_date(day) / 2).alias("bucket48"), F.date_format("ts", "yyyyMM").alias("month"), week.alias("week")).agg(count().alias("n"))


@query("""WITH x AS (
  SELECT 'order' AS kind, o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders
  UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber, CAST(l_shipdate AS DATE) FROM lineitem
  UNION ALL SELECT 'event', event_id, CAST(ts AS DATE) FROM events)
SELECT kind, id, row_number() OVER (ORDER BY day, kind, id) AS seq FROM x""")
def w10_sequence_numbers(spark, sf):
    """One sequence over three kinds of entities by effective date, kind and id: ranges are counted, then numbered by themselves."""
    o, li, e = (table(spark, sf, t) for t in ("orders", "lineitem", "events"))
    kinds = [
        o.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day")),
        li.select(F.lit("line").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.to_date("l_shipdate").alias("day")),
        e.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.to_date("ts").alias("day")),
    ]
    return numbered(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]), ["day", "kind", "id"]).drop("day")


@query("SELECT o_custkey AS k, year(o_orderdate) AS year, string_agg(month(o_orderdate)::VARCHAR || ':' || o_orderkey::VARCHAR, ',' ORDER BY month(o_orderdate), o_orderkey) AS months FROM orders GROUP BY 1, 2")
def w11_timeline(spark, sf):
    o = table(spark, sf, "orders")
    entry = F.array_sort(F.collect_list(F.struct(F.month("o_orderdate").alias("m"), F.col("o_orderkey").alias("id"))))
    return o.groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("long").alias("year")).agg(F.array_join(F.transform(entry, lambda e: F.concat_ws(":", e["m"].cast("string"), e["id"].cast("string"))), ",").alias("months"))
