"""Queries over paged feeds, whose pages Spark writes from the given tables; odd pages are in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.adapters import table
from skylark.plans.registry import query
from skylark.sources import paged
from skylark.streaming import events as streams

#: Items of a page. Every seventh comes again on the next page, under another title.
PAGE_ITEMS = 40
SINCE = "2024-01-10 00:00:00"


def listed(spark, sf):
    """(page, place, doc_id, again): documents as items of numbered pages; times are minutes after the year's beginning."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.substring(F.regexp_replace(F.split("text", "\n", 2)[0], "[^A-Za-z ]", ""), 1, 60).alias("title"), F.coalesce("source", F.lit("none")).alias("source"))
    page = F.floor(F.col("doc_id") / PAGE_ITEMS)
    again = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.withColumn("again", F.explode(again)).withColumn("page", page + F.col("again")).withColumn("minute", F.col("doc_id") * 97 % 43200)


def write_pages(items, page_text, folder: str) -> str:
    """One folder a page, as a feed's server would give them."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("again", "doc_id", "item"))), lambda x: x["item"]), "\n")
    pages = items.groupBy("page").agg(body.alias("body"))
    pages.select("page", page_text(F.col("body")).alias("value")).write.partitionBy("page").text(folder, lineSep="\n")
    return folder if "://" in folder else f"file://{folder}"


FEED_SQL = f"""SELECT 'doc-' || doc_id AS external_id, substr(regexp_replace(split_part(text, chr(10), 1), '[^A-Za-z ]', '', 'g'), 1, 60) AS t,
strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 97 % 43200), '%Y-%m-%d %H:%M') AS published, coalesce(source, 'none') AS source
FROM documents WHERE text IS NOT NULL"""


def shown(items):
    return items.select("external_id", F.coalesce("title", F.lit("")).alias("title"), F.date_format("published", "yyyy-MM-dd HH:mm").alias("published"), "source")


@query(f"SELECT external_id, trim(t) AS title, published, source FROM ({FEED_SQL}) WHERE published >= '{SINCE[:16]}'")
def s12_paged_news(spark, sf):
    """News by query: RSS pages, items since a time, the first of each id. The source itself leaves out older ones."""
    at = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("minute") * 60), "EEE, dd MMM yyyy HH:mm:ss")
    tag = lambda n, v: F.concat(F.lit(f"<{n}>"), v, F.lit(f"</{n}>"))
    title = F.when(F.col("again") == 0, F.col("title")).otherwise(F.concat(F.lit("again "), "title"))
    item = tag("item", F.concat(tag("guid", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))), tag("title", title), tag("pubDate", F.concat(at, F.lit(" +0000"))), tag("source", F.col("source"))))
    whole = lambda body: F.concat(F.lit("<rss><channel>"), F.translate(body, "\n", " "), F.lit("</channel></rss>"))
    place = write_pages(listed(spark, sf).withColumn("item", item), whole, streams.shared_folder(spark, "feed"))
    found = paged.keep_first(paged.read_feed(spark, place, kind="rss", since=SINCE))
    return shown(found)


@query(f"SELECT external_id, t AS title, published, source FROM ({FEED_SQL})")
def s18_paged_search(spark, sf):
    """Search results: JSON pages as a stream, whose offsets are page numbers; the first of each id."""
    title = F.when(F.col("again") == 0, F.col("title")).otherwise(F.concat(F.lit("again "), "title"))
    item = F.to_json(F.struct(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), title.alias("title"), (F.lit(1_704_067_200) + F.col("minute") * 60).alias("published"), "source"))
    place = write_pages(listed(spark, sf).withColumn("item", item), lambda body: body, streams.shared_folder(spark, "feed"))
    stream = paged.read_feed(spark, place, stream=True, kind="json", fields='{"external_id": "id"}')
    return shown(paged.keep_first(streams.drained(stream, streams.shared_folder(spark, "search"))))
