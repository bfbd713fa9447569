"""Feed parsers over records that Spark writes from the given tables: what was written must be read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.adapters import SIGNALS, signals, table
from skylark.plans.registry import query
from skylark.sources import feeds

STREAM = "CASE WHEN source = 'error' THEN 'CRIME_INTEL' WHEN source = 'purchase' THEN 'PRIORITY' WHEN source = 'signup' THEN 'INFRASTRUCTURE' ELSE 'GLOBAL' END"


def text(c: str):
    return F.col(c).cast("string")


@query(f"WITH {SIGNALS} SELECT 'rss:' || signal_id::VARCHAR AS external_id, 'rss' AS source, source || ' & ' || signal_id::VARCHAR AS title, date_trunc('second', ts) AS ts, lat, lng, is_priority, {STREAM} AS stream FROM signals")
def s01_rss_items(spark, sf):
    """Items of a feed, every one given twice; the first by time stays."""
    s = signals(spark, sf)
    title = F.concat(F.lit("<![CDATA[<b>"), "source", F.lit("</b> &amp; "), text("signal_id"), F.lit("]]>"))
    urgent = F.when(F.col("is_priority") == 1, "Severe weather").otherwise("calm")
    item = F.concat(F.lit("<item><guid>"), text("signal_id"), F.lit("</guid><title>"), title, F.lit("</title><description>"), urgent, F.lit("</description><pubDate>"), F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><georss:point>"), text("lat"), F.lit(" "), text("lng"), F.lit("</georss:point></item>"))
    raw = s.select(F.explode(F.array(item, item)).alias("raw"))
    return feeds.keep_first(feeds.rss(raw), "external_id", "ts").select(*feeds.SIGNAL)


@query(f"WITH {SIGNALS} SELECT 'usgs:' || signal_id::VARCHAR AS external_id, 'quakes' AS source, CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS ts, lat, lng, CASE WHEN k / 10.0 >= 6 OR signal_id % 50 = 0 THEN 1 ELSE 0 END AS is_priority FROM signals WHERE CAST(k AS DOUBLE) / 10 >= 2.5")
def s02_quake_features(spark, sf):
    s = signals(spark, sf)
    props = F.struct((F.col("k").cast("double") / 10).alias("mag"), F.col("source").alias("place"), F.unix_millis("ts").alias("time"), (F.col("signal_id") % 50 == 0).cast("int").alias("tsunami"))
    feature = F.to_json(F.struct(text("signal_id").alias("id"), props.alias("properties"), F.struct(F.array("lng", "lat").alias("coordinates")).alias("geometry")))
    return feeds.quakes(s.select(feature.alias("raw"))).select("external_id", "source", "ts", "lat", "lng", "is_priority")


@query(f"WITH {SIGNALS} SELECT signal_id % 1000 AS k, count(*) AS n, max(date_trunc('minute', ts)) AS ts, sum(CASE WHEN value >= 100 OR signal_id % 3 = 0 THEN 1 ELSE 0 END) AS urgent FROM signals WHERE value >= 10 GROUP BY 1")
def s04_hotspots(spark, sf):
    """Lines of a hot spot table; latitude carries the row's group, so that counts can be compared."""
    s = signals(spark, sf)
    hhmm = F.date_format("ts", "HHmm").cast("int").cast("string")
    line = F.concat_ws(",", ((F.col("signal_id") % 1000) / 1000.0).cast("string"), text("lng"), F.date_format("ts", "yyyy-MM-dd"), hhmm, text("value"), F.when(F.col("signal_id") % 3 == 0, "high").otherwise("nominal"))
    got = feeds.hotspots(s.select(line.alias("raw")))
    return got.groupBy(F.round(F.col("lat") * 1000).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts"), F.sum("is_priority").alias("urgent"))


@query(f"WITH {SIGNALS} SELECT 'S' || signal_id::VARCHAR AS station, date_trunc('minute', ts) AS ts, CASE WHEN k NOT IN (99) THEN CAST(k AS DOUBLE) END AS wave_m, CASE WHEN signal_id % 4 <> 0 THEN CAST(actor_id % 90 AS DOUBLE) END AS wind_ms FROM signals")
def s05_buoy_reports(spark, sf):
    s = signals(spark, sf)
    line = F.concat_ws("  ", F.concat(F.lit("S"), text("signal_id")), F.date_format("ts", "yyyy MM dd HH mm"), text("k"), F.when(F.col("signal_id") % 4 == 0, "MM").otherwise((F.col("actor_id") % 90).cast("string")))
    raw = s.select(F.explode(F.array(line, F.lit("#STN YY MM DD hh mm WVHT WSPD"))).alias("raw"))
    return feeds.buoys(raw, "STN YY MM DD hh mm WVHT WSPD".split())


@query("SELECT 'ofac:' || c_custkey::VARCHAR AS external_id, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'individual' END AS kind, 2 AS n_programmes FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')")
def s06_sanctions_lines(spark, sf):
    c = table(spark, sf, "customer")
    line = F.concat_ws(",", text("c_custkey"), F.concat(F.lit('"'), "c_name", F.lit('"')), F.when(F.col("c_nationkey") % 2 == 0, "individual").otherwise("-0- "), F.concat("c_mktsegment", F.lit("; SDGT")), F.lit("-0-"))
    return feeds.sanctions(c.select(line.alias("raw")), ["MACHINERY", "BUILDING"])


@query("SELECT 'interpol:' || c_custkey::VARCHAR AS external_id, c_name AS name, 'N' || c_nationkey::VARCHAR AS nationalities FROM customer")
def s08_notice_pages(spark, sf):
    """Pages of at most 160 notices as a service gives them, by number of customer."""
    notice = F.struct(text("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.array(F.concat(F.lit("N"), text("c_nationkey"))).alias("nationalities"))
    pages = table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 160).cast("int").alias("page")).agg(F.collect_list(notice).alias("notices"))
    return feeds.notices(pages.select(F.to_json(F.struct("page", F.struct("notices").alias("_embedded"))).alias("raw")))
