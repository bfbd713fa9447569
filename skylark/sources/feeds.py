"""Feed records to signals: each parser takes a table with one record per row in `raw` and gives rows of the signal schema.

Records come from `spark.read.text` (lines), `records` (elements of a large XML or JSON file) or any column of text, so that
parsing splits as the input does. A record that can't be read gives no row; a field that can't be read is null. Only `raw` is
read, whatever else the table holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylark.functions.text import first_match, refine

SIGNAL = ("external_id", "source", "title", "ts", "lat", "lng", "is_priority", "stream")

# Words that make a notice urgent, and the streams by keyword.
URGENT = ["red alert", "severe", "tsunami", "critical"]
STREAMS = [("CRIME_INTEL", ["error", "fraud"]), ("PRIORITY", ["purchase"]), ("INFRASTRUCTURE", ["signup", "dam", "power"])]


def records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Pieces of text files between separators, as `raw`; the files are split, not read whole."""
    return spark.read.option("lineSep", separator).text(path).withColumnRenamed("value", "raw")


def signal(external_id: Column, source: str, title: Column, ts: Column, lat: Column, lng: Column, urgent: Column) -> list[Column]:
    priority = F.coalesce(urgent.cast("int"), F.lit(0))
    stream = first_match(title, STREAMS, "GLOBAL")
    values = (external_id, F.lit(source), title, ts, lat.cast("double"), lng.cast("double"), priority, stream)
    return [v.alias(n) for v, n in zip(values, SIGNAL, strict=True)]


def any_of(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower(text).contains(w)
    return hit


def moment(text: Column, *formats: str) -> Column:
    """The first format that reads the text, in UTC; a weekday in front and a zone of Z, GMT or +0000 behind are left out."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"\s*(?:Z|GMT|UT|UTC|\+00:?00(?:Z)?)$", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in formats])


def rss(raw: DataFrame, source: str = "rss") -> DataFrame:
    """Items with title, guid or link, date, and a point as `lat lng` or as two elements."""
    schema = "guid STRING, link STRING, title STRING, description STRING, pubDate STRING, point STRING, lat DOUBLE, long DOUBLE"
    item = raw.select(F.from_xml("raw", schema, {"mode": "PERMISSIVE", "ignoreNamespace": "true"}).alias("i")).select("i.*")
    title, pair = refine(F.col("title")), F.split(F.trim("point"), r"\s+")
    lat, lng = F.coalesce(F.try_element_at(pair, F.lit(1)).try_cast("double"), "lat"), F.coalesce(F.try_element_at(pair, F.lit(2)).try_cast("double"), "long")
    key = F.coalesce("guid", "link")
    urgent = any_of(F.concat_ws(" ", title, F.col("description")), URGENT)
    return item.where(key.isNotNull()).select(signal(F.concat(F.lit(f"{source}:"), key), source, title, moment(F.col("pubDate"), "dd MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"), lat, lng, urgent))


def quakes(raw: DataFrame, min_mag: float = 2.5) -> DataFrame:
    """GeoJSON features from min_mag on: epoch milliseconds, coordinates in the order lng, lat."""
    schema = "id STRING, properties STRUCT<mag: DOUBLE, place: STRING, time: BIGINT, tsunami: INT>, geometry STRUCT<coordinates: ARRAY<DOUBLE>>"
    f = raw.select(F.from_json("raw", schema).alias("f")).select("f.id", "f.properties.*", F.col("f.geometry.coordinates").alias("at")).where("id is not null")
    title = F.concat_ws(" ", F.lit("M"), F.round("mag", 1).cast("string"), F.col("place"))
    urgent = (F.col("mag") >= 6) | (F.col("tsunami") == 1)
    return f.where(F.col("mag") >= min_mag).select(signal(F.concat(F.lit("usgs:"), "id"), "quakes", title, F.timestamp_millis("time"), F.try_element_at("at", F.lit(2)), F.try_element_at("at", F.lit(1)), urgent))


def hotspots(raw: DataFrame, min_frp: float = 10.0) -> DataFrame:
    """CSV lines latitude, longitude, date, HHMM without its leading zeros, radiative power, confidence."""
    r = raw.select(F.from_csv("raw", "lat DOUBLE, lng DOUBLE, day STRING, hhmm STRING, frp DOUBLE, confidence STRING").alias("r")).select("r.*").where(F.col("frp") >= min_frp)
    clock = F.lpad(F.trim("hhmm"), 4, "0")
    key = F.concat_ws(":", F.lit("firms"), F.format_string("%.4f", "lat"), F.format_string("%.4f", "lng"), "day", clock)
    urgent = (F.col("frp") >= 100) | F.lower("confidence").isin("h", "high")
    title = F.concat(F.lit("fire of "), F.format_string("%.1f", "frp"), F.lit(" MW"))
    return r.select(signal(key, "hotspots", title, moment(F.concat_ws(" ", "day", clock), "yyyy-MM-dd HHmm"), F.col("lat"), F.col("lng"), urgent))


#: Values that stand for a missing measurement.
MISSING = ["MM", "99", "99.0", "999", "999.0", "9999", "9999.0"]


def measured(text: Column) -> Column:
    return F.when(~text.isin(MISSING), text.try_cast("double"))


def buoys(raw: DataFrame, header: list[str]) -> DataFrame:
    """Lines of a station's report, columns apart by blanks, named by the header; comment lines (#) are left out."""
    line = raw.where(F.col("raw").isNotNull() & ~F.startswith("raw", F.lit("#")))
    parts = F.split(F.trim("raw"), r"\s+")
    field = lambda n: F.try_element_at(parts, F.lit(header.index(n) + 1))
    ts = moment(F.concat_ws(" ", F.concat_ws("-", *[field(n) for n in ("YY", "MM", "DD")]), F.concat_ws(":", field("hh"), field("mm"))), "yyyy-MM-dd HH:mm")
    return line.select(field("STN").alias("station"), ts.alias("ts"), measured(field("WVHT")).alias("wave_m"), measured(field("WSPD")).alias("wind_ms"))


def sanctions(raw: DataFrame, programmes: list[str] | None = None) -> DataFrame:
    """CSV lines number, name, kind, programmes: `-0-` is empty; kept if any programme is asked for."""
    row = raw.select(F.from_csv("raw", "number BIGINT, name STRING, kind STRING, programmes STRING, remarks STRING").alias("r")).select("r.*")
    for c in ("name", "kind", "programmes", "remarks"):
        row = row.withColumn(c, F.nullif(F.nullif(F.trim(c), F.lit("-0-")), F.lit("")))
    tokens = F.filter(F.split(F.upper(F.coalesce("programmes", F.lit(""))), r"[;\s]+"), lambda x: x != "")
    row = row.withColumn("tokens", tokens).where("number is not null")
    if programmes:
        row = row.where(F.arrays_overlap("tokens", F.array(*[F.lit(p) for p in programmes])))
    return row.select(F.concat(F.lit("ofac:"), F.col("number").cast("string")).alias("external_id"), "name", "kind", F.size("tokens").alias("n_programmes"))


def notices(raw: DataFrame) -> DataFrame:
    """JSON pages of notices: one row per notice of each page."""
    page = F.from_json("raw", "page INT, _embedded STRUCT<notices: ARRAY<STRUCT<entity_id: STRING, name: STRING, nationalities: ARRAY<STRING>>>>")
    n = raw.select(F.explode(page["_embedded"]["notices"]).alias("n")).select("n.*").where("entity_id is not null")
    return n.select(F.concat(F.lit("interpol:"), "entity_id").alias("external_id"), "name", F.array_join("nationalities", ",").alias("nationalities"))


def keep_first(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key, the first by the order; rows that tie wholly are alike. Partial minima come before the shuffle."""
    others = [c for c in rows.columns if c not in (*order, key)]
    whole = F.struct(*order, *others)
    return rows.groupBy(key).agg(F.min(whole).alias("_first")).select(key, *[F.col("_first")[c].alias(c) for c in (*order, *others)])
