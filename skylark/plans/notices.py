"""Lists, feeds and notices that Spark writes from the given tables and parses again. Tests hold the parsers against broken and unusual records."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.adapters import table
from skylark.plans.registry import query
from skylark.sources import files, notices


def text(c):
    return F.col(c).cast("string")


@query("SELECT 'un-tfs:' || c_custkey::VARCHAR AS external_id, 'individual' AS kind, replace(c_name, '#', ' ') AS name, c_mktsegment AS list, 'N' || c_nationkey::VARCHAR AS nationalities, CASE WHEN c_acctbal > 0 THEN 'K' || c_custkey::VARCHAR || ' (Good)' END AS aliases FROM customer")
def s07_sanctions_xml(spark, sf):
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))
    alias = F.when(F.col("c_acctbal") > 0, tag("INDIVIDUAL_ALIAS", tag("QUALITY", F.lit("Good")), tag("ALIAS_NAME", F.lit("K"), text("c_custkey")))).otherwise(F.lit("<INDIVIDUAL_ALIAS><ALIAS_NAME/></INDIVIDUAL_ALIAS>"))
    name = F.split("c_name", "#")
    xml = tag("INDIVIDUAL", tag("DATAID", text("c_custkey")), tag("FIRST_NAME", name[0]), tag("SECOND_NAME", name[1]), tag("UN_LIST_TYPE", F.col("c_mktsegment")), tag("NATIONALITY", tag("VALUE", F.lit("N"), text("c_nationkey"))), alias)
    found = notices.sanctioned(table(spark, sf, "customer").select(xml.alias("raw")))
    return found.select("external_id", "kind", "name", "list", "nationalities", "aliases")


@query("SELECT 'gdelt-doc:' || substr(sha1('https://x.example/' || event_id::VARCHAR), 1, 16) AS external_id, 'Report ' || event_id::VARCHAR AS title, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN value IS NULL THEN -0.1 ELSE CAST(value AS DOUBLE) END AS sentiment, 0.5 AS severity FROM events")
def s09_news_articles(spark, sf):
    """Pages of a hundred articles."""
    article = F.struct(F.concat(F.lit(" https://x.example/"), text("event_id")).alias("url"), F.concat(F.lit("Report  "), text("event_id")).alias("title"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), text("value").alias("sentiment"))
    pages = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 100).alias("page")).agg(F.collect_list(article).alias("articles"))
    return notices.articles(pages.select(F.to_json(F.struct("articles")).alias("raw"))).select("external_id", "title", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "sentiment", "severity")


@query("SELECT 'acled:' || o_orderkey::VARCHAR AS external_id, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_custkey % 15 AS INTEGER) AS fatalities, round(least(1.0, CASE o_orderstatus WHEN 'F' THEN 0.8 WHEN 'O' THEN 0.3 ELSE 0.4 END + least(0.02 * (o_custkey % 15), 0.2)), 4) AS severity FROM orders")
def s10_conflict_events(spark, sf):
    kind = F.when(F.col("o_orderstatus") == "F", "Battles").when(F.col("o_orderstatus") == "O", "Protests").otherwise("Other")
    event = F.struct(text("o_orderkey").alias("event_id_cnty"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_date"), kind.alias("event_type"), (F.col("o_custkey") % 15).cast("string").alias("fatalities"))
    pages = table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 50).alias("page")).agg(F.collect_list(event).alias("data"))
    found = notices.conflicts(pages.select(F.to_json(F.struct("data")).alias("raw")))
    return found.select("external_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "fatalities", "severity")


@query("SELECT o_orderkey::VARCHAR || '/2021' AS case_number, 'A' || o_custkey::VARCHAR AS plaintiff, 'B & Sons' AS defendant, CAST(o_orderdate AS DATE)::VARCHAR AS day FROM orders")
def s14_court_rolls(spark, sf):
    """HTML tables of court rolls, one for each customer."""
    row = F.concat(F.lit("<tr><td> "), text("o_orderkey"), F.lit("/2021</td><td><b>A"), text("o_custkey"), F.lit("</b> v B &amp; Sons</td><td>"), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit("</td></tr>"))
    pages = table(spark, sf, "orders").groupBy("o_custkey").agg(F.concat(F.lit("<table><tr><th>No</th></tr>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table>")).alias("raw"))
    found = notices.court_roll(pages.select("raw"))
    # "B & Sons" is one party's name here, and two by the rule that parts at "&".
    return found.select("case_number", F.get("parties", F.lit(0)).alias("plaintiff"), F.array_join(F.slice("parties", 2, 2), " & ").alias("defendant"), text("day").alias("day"))


@query("SELECT c_custkey, CAST(c_custkey % 100000 AS INTEGER) AS notice, 'Old' AS before, 'New' AS after FROM customer UNION ALL SELECT c_custkey, 7, 'First', 'Second' FROM customer")
def t46_surname_changes(spark, sf):
    forms = F.when(F.col("c_nationkey") % 3 == 0, "assume the surname NEW in lieu of the surname OLD.").when(F.col("c_nationkey") % 3 == 1, "change my surname from OLD to NEW, born").otherwise("naam verander van NEW na OLD;")
    notice = F.concat(F.lit("Notice No. "), (F.col("c_custkey") % 100000).cast("string"), F.lit(" of 2021: to "), forms, F.lit("\nNotice No 7: assume the surname SECOND instead of FIRST and"))
    return notices.surname_changes(table(spark, sf, "customer").select("c_custkey", notice.alias("text"))).select("c_custkey", "notice", "before", "after")


@query("SELECT o_orderkey, 'SCM/' || (1000 + o_orderkey)::VARCHAR || '/2022' AS reference, round(CAST(o_custkey + 1 AS DOUBLE) * CASE WHEN o_orderstatus = 'F' THEN 1000 ELSE 1 END, 2) AS amount, 'Acme ' || o_custkey::VARCHAR AS awardee, 'Department of Public Works' AS department FROM orders WHERE (o_custkey + 1) * CASE WHEN o_orderstatus = 'F' THEN 1000 ELSE 1 END <= 999000")
def t43_procurement(spark, sf):
    unit = F.when(F.col("o_orderstatus") == "F", "bn").otherwise("million")
    t = F.concat(F.lit("Department of Public Works awarded to Acme "), text("o_custkey"), F.lit(", ref SCM/"), (F.col("o_orderkey") + 1000).cast("string"), F.lit("/2022, for R"), F.format_number((F.col("o_custkey") + 1), 0), F.lit(" "), unit, F.lit("."))
    found = notices.procurement(table(spark, sf, "orders").select("o_orderkey", t.alias("text"))).where(F.size("amounts") > 0)
    return found.select("o_orderkey", F.get("references", F.lit(0)).alias("reference"), F.get("amounts", F.lit(0)).alias("amount"), F.get("awardees", F.lit(0)).alias("awardee"), F.get("departments", F.lit(0)).alias("department"))


@query()
def t01_refined_texts(spark, sf):
    """All pages by the whole rule, with all character references and the tags that they hid."""
    return table(spark, sf, "pages").select("page_id", notices.refined(F.col("html")).alias("plain"))


@query("""SELECT doc_id, 'jpeg' AS kind, round((doc_id * 7919 % 180000) / 1000.0 - 90, 4) AS lat, round((doc_id * 104729 % 360000) / 1000.0 - 180, 4) AS lng,
strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id), '%Y-%m-%d %H:%M:%S') AS taken, sha256(text) AS text_sha256, md5(text) AS text_md5
FROM documents WHERE text IS NOT NULL""")
def s19_artifacts(spark, sf):
    """Each text as a file, and a photograph that Spark makes of its number, whose directories are read again; files in folders are in the tests."""
    word = lambda v, n: F.lpad(F.hex(v.cast("long")), n, "0")
    lat, lng = F.col("doc_id") * 7919 % 180000 - 90000, F.col("doc_id") * 104729 % 360000 - 180000
    taken = F.date_format(F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(secs=F.col("doc_id")), "yyyy:MM:dd HH:mm:ss")
    rational = lambda v: F.concat(word(F.abs(v), 8), F.lit("000003E8" + "0000000000000001" * 2))  # noqa: E731  thousandths of a degree, no minutes, no seconds
    ref = lambda v, n, p: F.when(v < 0, F.hex(F.lit(n))).otherwise(F.hex(F.lit(p)))
    header = "4D4D002A00000008" + "0002" + "0132000200000014" + "00000026" + "8825000400000001" + "0000003A" + "00000000"
    gps = [F.lit("0004" + "0001000200000002"), ref(lat, "S", "N"), F.lit("000000" + "0002000500000003" + "00000070" + "0003000200000002"), ref(lng, "W", "E"), F.lit("000000" + "0004000500000003" + "00000088" + "00000000")]
    tiff = F.concat(F.lit(header), F.hex(taken), F.lit("00"), *gps, rational(lat), rational(lng))
    app1 = F.concat(F.lit("457869660000"), tiff)
    photo = F.unhex(F.concat(F.lit("FFD8FFE1"), word(F.length(app1) / 2 + 2, 4), app1, F.lit("FFDA0002")))
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("raw"), photo.alias("content"))
    d = d.select("doc_id", "content", F.sha2("raw", 256).alias("text_sha256"), F.md5("raw").alias("text_md5"))
    found = files.artifacts(d)
    return found.select("doc_id", "kind", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"), F.date_format("taken", "yyyy-MM-dd HH:mm:ss").alias("taken"), "text_sha256", "text_md5")
