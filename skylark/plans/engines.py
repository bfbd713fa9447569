"""Scores, decay, clusters, correlation, alerts and the ranked feed over signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.adapters import SIGNALS, signals
from skylark.functions import geo, scores
from skylark.operators import joins
from skylark.params import AS_OF, Correlation, Entropy
from skylark.plans.registry import query
from skylark.session import checkpointed

def count():
    return F.count(F.lit(1))

def as_of():
    return F.to_timestamp(F.lit(AS_OF))


HOURS = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 3.6e9"
RATE = "CASE stream WHEN 'CRIME_INTEL' THEN 0.02 WHEN 'INFRASTRUCTURE' THEN 0.006 WHEN 'PRIORITY' THEN 0.003 ELSE 0.012 END"
RELEVANCE = f"greatest(CAST(0.05 AS DOUBLE), CASE WHEN is_priority = 1 THEN 1.5 ELSE 1.0 END * exp(-CAST({RATE} AS DOUBLE) * greatest({HOURS}, 0)))"


def relevance():
    return scores.decayed(F.col("stream"), F.col("is_priority"), scores.hours_between(as_of(), F.col("ts")))


@query(f"""WITH {SIGNALS} SELECT signal_id, stream, round({RELEVANCE}, 6) AS relevance, CASE WHEN {RELEVANCE} >= 0.6 THEN 'high' WHEN {RELEVANCE} >= 0.2 THEN 'medium' ELSE 'low' END AS bucket FROM signals WHERE status <> 'dismissed'""")
def g10_decay_report(spark, sf):
    s = signals(spark, sf).where("status <> 'dismissed'").withColumn("r", relevance())
    return s.select("signal_id", "stream", F.round("r", 6).alias("relevance"), F.when(F.col("r") >= 0.6, "high").when(F.col("r") >= 0.2, "medium").otherwise("low").alias("bucket"))


# Every number is a DOUBLE: as decimals they would make another last digit than Spark's, which decides at a threshold.
N = lambda x: f"CAST({x} AS DOUBLE)"
G_SEV, G_ACT, G_FREQ, G_SENT = f"least(value / {N(200)}, {N(1)})", f"least({N(0.3)} * (actor_id % 5), {N(1)})", f"(CAST(k AS DOUBLE) / {N(100)})", f"(CAST(signal_id % 21 AS DOUBLE) - {N(10)}) / {N(10)}"
GRAVITY = f"""greatest({N(0)}, least({N(1)}, ({N(0.35)} * {G_SEV} + {N(0.25)} * {G_ACT} + {N(0.15)} * {G_FREQ} + {N(0.15)} * ({N(1)} - ({G_SENT} + {N(1)}) / {N(2)})
 + {N('0.10')} * (CASE WHEN signal_id % 3 = 0 THEN {N(0.5)} ELSE {N(0.8)} END)) * ({N(0.8)} + {N(0.2)} * {G_FREQ})))"""


def over(g: str, least: float) -> str:
    """Whether a DOUBLE is above a threshold, which is one too."""
    return f"{g} > {N(least)}"


def rounded(x: str, places: int) -> str:
    """A DOUBLE rounded half up in the digits that it is written with, as Spark's round does; DuckDB's round of a DOUBLE multiplies first, which moves ties."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), {places}) AS DOUBLE)"


DECISION = f"CASE WHEN {over(GRAVITY, 0.8)} THEN 'CREATE' WHEN {over(GRAVITY, 0.6)} THEN 'FLAG' ELSE 'STORE' END"


def gravity():
    d = lambda c: F.col(c).cast("double")
    sentiment = ((F.col("signal_id") % 21).cast("double") - 10) / 10.0
    credibility = F.when(F.col("signal_id") % 3 != 0, F.lit(0.8))  # null falls back to one half
    return scores.gravity(F.least(d("value") / 200.0, F.lit(1.0)), F.least((F.col("actor_id") % 5) * 0.3, F.lit(1.0)), d("k") / 100.0, sentiment, credibility)


@query(f"WITH {SIGNALS} SELECT signal_id, {rounded(GRAVITY, 3)} AS gravity, {DECISION} AS decision FROM signals WHERE value IS NOT NULL")
def g01_gravity_decisions(spark, sf):
    g = gravity()
    return signals(spark, sf).where("value is not null").select("signal_id", F.round(g, 3).alias("gravity"), scores.decision(g).alias("decision"))


@query(f"""WITH {SIGNALS}, g AS (SELECT *, {GRAVITY} AS g FROM signals WHERE value IS NOT NULL) SELECT signal_id, round(CASE WHEN source IN ('error', 'purchase') AND stream IN ('CRIME_INTEL', 'PRIORITY') AND value > 0 AND g < 0.35 THEN 0.35 ELSE g END * greatest(0.5, least(2.0, 0.8 + CAST(actor_id % 7 AS DOUBLE) / 10)), 3) AS score FROM g""")
def g03_score_signals(spark, sf):
    """Gravity with a floor for investigative sources, times the actor's influence, kept within 0.5 and 2."""
    g = gravity()
    floor = F.col("source").isin("error", "purchase") & F.col("stream").isin("CRIME_INTEL", "PRIORITY") & (F.col("value") > 0) & (g < 0.35)
    influence = scores.clamp(0.8 + (F.col("actor_id") % 7).cast("double") / 10, 0.5, 2.0)
    return signals(spark, sf).where("value is not null").select("signal_id", F.round(F.when(floor, 0.35).otherwise(g) * influence, 3).alias("score"))


@query(f"""WITH {SIGNALS}, cells AS (SELECT signal_id, CAST(floor(lat / CAST(0.5 AS DOUBLE)) AS BIGINT) AS y, CAST(floor(lng / CAST(0.5 AS DOUBLE)) AS BIGINT) AS x, ts, status, {GRAVITY} AS g, date_diff('day', CAST(ts AS DATE), DATE '2024-02-29') AS age FROM signals WHERE value IS NOT NULL),
active AS (SELECT y, x FROM cells GROUP BY y, x HAVING max(ts) >= TIMESTAMP '2024-01-30 00:00:00')
SELECT signal_id, round(greatest(0.10, g - 0.05 * floor(age / 30)), 3) AS gravity FROM cells c WHERE status <> 'dismissed' AND g > 0.10 AND age >= 30 AND NOT EXISTS (SELECT 1 FROM active a WHERE a.y = c.y AND a.x = c.x)""")
def g11_entropy_decay(spark, sf):
    """Gravity falls by a step for each full 30 days, unless the signal's cell has been active within 30 days."""
    p = Entropy()
    s = signals(spark, sf).where("value is not null").select("signal_id", geo.cell(F.col("lat"), 0.5).alias("y"), geo.cell(F.col("lng"), 0.5).alias("x"), "ts", "status", gravity().alias("g"), F.datediff(F.to_date(F.lit("2024-02-29")), F.to_date("ts")).alias("age"))
    active = s.groupBy("y", "x").agg(F.max("ts").alias("last")).where("last >= timestamp'2024-01-30 00:00:00'").select("y", "x")
    stale = s.where((F.col("status") != "dismissed") & (F.col("g") > p.floor) & (F.col("age") >= p.epoch_days)).join(active, ["y", "x"], "left_anti")
    return stale.select("signal_id", F.round(F.greatest(F.lit(p.floor), F.col("g") - p.step * F.floor(F.col("age") / p.epoch_days)), 3).alias("gravity"))


STEP = "CASE WHEN source IN ('error', 'signup') THEN 1.0 ELSE 0.5 END"


@query(f"""WITH {SIGNALS} SELECT signal_id, 'geo_' || CAST(floor(lat / CAST({STEP} AS DOUBLE)) AS BIGINT)::VARCHAR || '_' || CAST(floor(lng / CAST({STEP} AS DOUBLE)) AS BIGINT)::VARCHAR || '_' || CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 2 AS BIGINT)::VARCHAR AS cluster FROM signals""")
def g12_grid_clusters(spark, sf):
    """Grid cell (coarse for some sources) and 48-hour bucket; a fallback on actors or source and month would follow for null coordinates."""
    step = F.when(F.col("source").isin("error", "signup"), 1.0).otherwise(0.5)
    number = lambda c: F.floor(F.col(c) / step).cast("string")
    bucket = F.floor(F.unix_date(F.to_date("ts")) / 2).cast("string")
    actors = F.concat(F.lit("act_"), F.substring(F.sha1(F.col("actor_id").cast("string")), 1, 12))
    by_source = F.concat_ws("_", F.lit("src"), "source", F.date_format("ts", "yyyyMM"))
    place = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.concat_ws("_", F.lit("geo"), number("lat"), number("lng"), bucket))
    return signals(spark, sf).select("signal_id", F.coalesce(place, actors, by_source).alias("cluster"))


C = Correlation()
KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"
PAIRS_SQL = f"""near AS (SELECT a.signal_id AS a, b.signal_id AS b, {KM} AS km, abs(epoch_us(a.ts) - epoch_us(b.ts)) / 3.6e9 AS h, a.lat AS lat_a, b.lat AS lat_b, a.lng AS lng_a, b.lng AS lng_b FROM recent a JOIN recent b ON a.signal_id < b.signal_id AND abs(a.lat - b.lat) < 0.5),
scored AS (SELECT *, round(2 * (1 - km / 50) * (1 - h / 24) / nullif((1 - km / 50) + (1 - h / 24), 0), 4) AS score FROM near WHERE km <= 50 AND h <= 24)"""
RECENT = "recent AS (SELECT * FROM signals WHERE status IN ('raw', 'promoted') AND source <> 'click' AND ts >= TIMESTAMP '2024-01-29 00:00:00')"


def reach(least: float = C.min_score) -> float:
    """The share of the space and of the time that pairs of a score use at most.

    Neither part of the harmonic mean is above one, so that each must be h / (2 - h) at least for a mean of h.
    """
    h = least - 1e-4  # what rounds up to the least
    return 1 - max(0.0, h / (2 - h))


def correlated(s, least: float = C.min_score, places: bool = False):
    """Scored pairs: harmonic mean of nearness in space and in time, kept from the least score on after rounding.

    Only pairs within so much less space and time as the least score allows are looked for; with `places` they have those of both ends.
    """
    part = reach(least)
    pairs = joins.spacetime_pairs(s.select(F.col("signal_id").alias("id"), "lat", "lng", "ts"), part * C.max_km, part * C.max_hours, places)
    space, time = 1 - F.col("distance_km") / C.max_km, 1 - F.col("hours") / C.max_hours
    score = F.when(space + time > 0, 2 * space * time / (space + time))
    return pairs.withColumns({"score": F.round(score, 4), "space": F.round(space, 4), "time": F.round(time, 4)}).where(F.col("score") >= least)


def best_correlated(s, most: int, least: float = C.min_score):
    """(a, b, score): the best pairs by score, then a and b, so many at most. Those of a high score are looked for first, and others only if these are too few, so that work follows the number asked for and not all pairs."""
    for h in sorted({h for h in (0.995, 0.97, 0.85) if h > least} | {least}, reverse=True):
        best = checkpointed(correlated(s, h).select("a", "b", "score").orderBy(F.desc("score"), "a", "b").limit(most))
        if h == least or best.count() >= most:
            return best


def recent(spark, sf):
    return signals(spark, sf).where("status in ('raw', 'promoted') and source <> 'click' and ts >= timestamp'2024-01-29 00:00:00'")


@query(f"WITH {SIGNALS}, {RECENT}, {PAIRS_SQL} SELECT a, b, score, round(km, 3) AS distance_km, round(h, 3) AS hours FROM scored WHERE score >= 0.70")
def g13_correlated_pairs(spark, sf):
    return correlated(recent(spark, sf)).select("a", "b", "score", F.round("distance_km", 3).alias("distance_km"), F.round("hours", 3).alias("hours"))


@query(f"WITH {SIGNALS}, {RECENT}, {PAIRS_SQL} SELECT a, b, round(least(score + 0.15 * (CASE WHEN x.source <> y.source THEN 1 ELSE 0 END), 1.0), 4) AS confidence FROM scored JOIN signals x ON x.signal_id = a JOIN signals y ON y.signal_id = b WHERE score > 0.85")
def g16_pair_alerts(spark, sf):
    s = recent(spark, sf)
    source = s.select("signal_id", "source")
    pairs = correlated(s, 0.85).where("score > 0.85").join(source.toDF("a", "sa"), "a").join(source.toDF("b", "sb"), "b")
    return pairs.select("a", "b", F.round(F.least(F.col("score") + 0.15 * (F.col("sa") != F.col("sb")).cast("int"), F.lit(1.0)), 4).alias("confidence"))


@query(f"""WITH {SIGNALS} SELECT CAST(floor(lat) AS BIGINT) AS y, CAST(floor(lng / 2) AS BIGINT) AS x, count(*) AS n, round(least(1.0, least(0.5 + 0.05 * count(*), 0.85) + 0.15 * (count(DISTINCT source) - 1)), 4) AS confidence, round(avg(lat), 5) AS lat, round(avg(lng), 5) AS lng
FROM signals WHERE source <> 'click' AND ts >= TIMESTAMP '2024-01-29 00:00:00' GROUP BY 1, 2 HAVING count(*) >= 5""")
def g17_cell_alerts(spark, sf):
    s = signals(spark, sf).where("source <> 'click' and ts >= timestamp'2024-01-29 00:00:00'")
    cells = s.groupBy(F.floor("lat").alias("y"), F.floor(F.col("lng") / 2).alias("x")).agg(count().alias("n"), F.countDistinct("source").alias("k"), F.round(F.avg("lat"), 5).alias("lat"), F.round(F.avg("lng"), 5).alias("lng")).where("n >= 5")
    conf = F.least(F.lit(1.0), F.least(0.5 + 0.05 * F.col("n"), F.lit(0.85)) + 0.15 * (F.col("k") - 1))
    return cells.select("y", "x", "n", F.round(conf, 4).alias("confidence"), "lat", "lng")


@query(f"""WITH {SIGNALS} SELECT source, actor_id, round((epoch_us(TIMESTAMP '{AS_OF}') - max(epoch_us(ts))) / 3.6e9, 3) AS gap_hours FROM signals WHERE actor_id IS NOT NULL
GROUP BY source, actor_id HAVING (epoch_us(TIMESTAMP '{AS_OF}') - max(epoch_us(ts))) / 3.6e9 >= 24""")
def g19_stalls(spark, sf):
    """Feeds, here of a source and an actor each, that have been silent for a day or more."""
    gap = scores.hours_between(as_of(), F.col("last"))
    return signals(spark, sf).where("actor_id is not null").groupBy("source", "actor_id").agg(F.max("ts").alias("last")).where(gap >= 24).select("source", "actor_id", F.round(gap, 3).alias("gap_hours"))


@query(f"WITH {SIGNALS} SELECT stream, count(*) AS n, round(avg(CASE WHEN source = 'error' THEN least(k / 9.0, 1.0) WHEN source = 'purchase' THEN least(value / 500.0, 1.0) WHEN is_priority = 1 THEN 0.7 ELSE 0.5 END), 4) AS intensity FROM signals GROUP BY stream")
def g56_stream_pulse(spark, sf):
    heat = F.when(F.col("source") == "error", F.least(F.col("k") / 9.0, F.lit(1.0))).when(F.col("source") == "purchase", F.least(F.col("value") / 500.0, F.lit(1.0))).when(F.col("is_priority") == 1, 0.7).otherwise(0.5)
    return signals(spark, sf).groupBy("stream").agg(count().alias("n"), F.round(F.avg(heat), 4).alias("intensity"))


@query(f"""WITH {SIGNALS}, {RECENT}, {PAIRS_SQL},
flagged AS (SELECT DISTINCT id FROM (SELECT a AS id FROM scored WHERE score >= 0.70 UNION ALL SELECT b FROM scored WHERE score >= 0.70)),
items AS (SELECT 'signal' AS kind, s.signal_id AS id, {RELEVANCE} * 0.4 + is_priority * 0.3 + (CASE WHEN f.id IS NULL THEN 0 ELSE 1 END) * 0.2 + (CASE stream WHEN 'CRIME_INTEL' THEN 1.0 WHEN 'PRIORITY' THEN 0.9 WHEN 'INFRASTRUCTURE' THEN 0.7 ELSE 0.3 END) * 0.1 AS score FROM signals s LEFT JOIN flagged f ON f.id = s.signal_id WHERE status <> 'dismissed'
UNION ALL SELECT 'pair', a, 0.2 + 0.8 * score FROM scored WHERE score >= 0.70)
SELECT kind, id, round(score, 4) AS score FROM items ORDER BY round(score, 4) DESC, kind, id LIMIT 100""")
def g39_ranked_feed(spark, sf):
    """Signals and correlated pairs scored on one scale; the top hundred."""
    pairs = correlated(recent(spark, sf))
    flagged = pairs.select(F.explode(F.array("a", "b")).alias("signal_id")).distinct().withColumn("hit", F.lit(1))
    weight = F.when(F.col("stream") == "CRIME_INTEL", 1.0).when(F.col("stream") == "PRIORITY", 0.9).when(F.col("stream") == "INFRASTRUCTURE", 0.7).otherwise(0.3)
    s = signals(spark, sf).where("status <> 'dismissed'").join(flagged, "signal_id", "left")
    score = relevance() * 0.4 + F.col("is_priority") * 0.3 + F.coalesce("hit", F.lit(0)) * 0.2 + weight * 0.1
    items = s.select(F.lit("signal").alias("kind"), F.col("signal_id").alias("id"), F.round(score, 4).alias("score"))
    items = items.unionByName(pairs.select(F.lit("pair").alias("kind"), F.col("a").alias("id"), F.round(0.2 + 0.8 * F.col("score"), 4).alias("score")))
    return items.orderBy(F.desc("score"), "kind", "id").limit(100)


SITES = [("north", -24.5, 29.5), ("coast", -33.9, 18.4), ("port", -29.9, 31.0), ("centre", -29.1, 26.2)]
SITE_SQL = "(VALUES ('north', -24.5, 29.5), ('coast', -33.9, 18.4), ('port', -29.9, 31.0), ('centre', -29.1, 26.2)) AS t(name, y, x)"


@query(f"WITH {SIGNALS} SELECT signal_id, site FROM (SELECT signal_id, name AS site, row_number() OVER (PARTITION BY signal_id ORDER BY sqrt(pow(lat - y, 2) + pow(lng - x, 2)), name) AS r FROM signals, {SITE_SQL}) WHERE r = 1")
def t23_nearest_site(spark, sf):
    """Nearest of a fixed list of sites: a minimum over literal columns, not a join."""
    away = [F.struct(F.sqrt(F.pow(F.col("lat") - y, 2) + F.pow(F.col("lng") - x, 2)).alias("d"), F.lit(n).alias("n")) for n, y, x in SITES]
    return signals(spark, sf).select("signal_id", F.least(*away)["n"].alias("site"))


@query(f"WITH {SIGNALS} SELECT signal_id, CASE WHEN EXISTS (SELECT 1 FROM (SELECT CAST(y AS DOUBLE) AS lat, CAST(x AS DOUBLE) AS lng FROM {SITE_SQL}) b WHERE {KM} <= 250) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS near FROM signals a")
def t21_within_radius(spark, sf):
    return signals(spark, sf).select("signal_id", geo.within_radius(F.col("lat"), F.col("lng"), [(y, x) for _, y, x in SITES]).alias("near"))
