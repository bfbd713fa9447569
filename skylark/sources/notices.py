"""Sanction lists, news and conflict feeds, court rolls, gazette notices and procurement texts to rows.

As in `feeds`, each parser takes one record a row in `raw`; a record that can't be read gives no row, a field that can't be read is null.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skylark.functions.parse import parties
from skylark.sources.feeds import moment


def filled(text: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def lines_of(array: Column, sep: str) -> Column:
    """The items that aren't null, joined; null if there are none."""
    return F.nullif(F.array_join(array, sep), F.lit(""))


def sanctioned(raw: DataFrame) -> DataFrame:
    """INDIVIDUAL and ENTITY elements of a sanctions list: external_id, kind, name, list, listed_on, nationalities, aliases, born, documents; without a name the number stands for it."""
    alias = "STRUCT<ALIAS_NAME: STRING, QUALITY: STRING>"
    schema = f"""DATAID STRING, FIRST_NAME STRING, SECOND_NAME STRING, THIRD_NAME STRING, FOURTH_NAME STRING, UN_LIST_TYPE STRING, LISTED_ON STRING, NATIONALITY STRUCT<VALUE: ARRAY<STRING>>,
        INDIVIDUAL_ALIAS ARRAY<{alias}>, ENTITY_ALIAS ARRAY<{alias}>, INDIVIDUAL_DATE_OF_BIRTH ARRAY<STRUCT<DATE: STRING, YEAR: STRING>>, INDIVIDUAL_DOCUMENT ARRAY<STRUCT<TYPE_OF_DOCUMENT: STRING, NUMBER: STRING, ISSUING_COUNTRY: STRING>>"""
    x = raw.select(F.when(F.col("raw").contains("<ENTITY>"), "entity").otherwise("individual").alias("kind"), F.from_xml("raw", schema, {"mode": "PERMISSIVE"}).alias("x")).select("kind", "x.*")
    x = x.where(filled(F.col("DATAID")).isNotNull())
    name = F.concat_ws(" ", *[filled(F.col(f"{n}_NAME")) for n in ("FIRST", "SECOND", "THIRD", "FOURTH")])
    aliases = F.concat(F.coalesce("INDIVIDUAL_ALIAS", F.array().cast(f"array<{alias}>")), F.coalesce("ENTITY_ALIAS", F.array().cast(f"array<{alias}>")))
    with_quality = lambda a: F.concat(filled(a["ALIAS_NAME"]), F.coalesce(F.concat(F.lit(" ("), filled(a["QUALITY"]), F.lit(")")), F.lit("")))
    born = lambda d: F.coalesce(filled(d["DATE"]), F.concat(F.lit("Year: "), filled(d["YEAR"])))
    paper = lambda d: F.concat(F.coalesce(F.concat(filled(d["TYPE_OF_DOCUMENT"]), F.lit(": ")), F.lit("")), filled(d["NUMBER"]), F.coalesce(F.concat(F.lit(" ("), filled(d["ISSUING_COUNTRY"]), F.lit(")")), F.lit("")))
    number = F.trim("DATAID")
    return x.select(
        F.concat(F.lit("un-tfs:"), number).alias("external_id"),
        "kind",
        F.coalesce(F.nullif(name, F.lit("")), F.concat(F.initcap("kind"), F.lit(" DATAID "), number)).alias("name"),
        filled(F.col("UN_LIST_TYPE")).alias("list"),
        F.to_date(moment(F.col("LISTED_ON"), "yyyy-MM-dd")).alias("listed_on"),
        lines_of(F.transform("NATIONALITY.VALUE", filled), ", ").alias("nationalities"),
        lines_of(F.transform(aliases, with_quality), "; ").alias("aliases"),
        lines_of(F.transform("INDIVIDUAL_DATE_OF_BIRTH", born), ", ").alias("born"),
        lines_of(F.transform("INDIVIDUAL_DOCUMENT", paper), "; ").alias("documents"),
    )


def articles(raw: DataFrame, relevance: float = 1.0, credibility: float = 0.6) -> DataFrame:
    """JSON pages of news articles: one row for each with address and title. Severity stands in for relevance; an unknown sentiment is slightly negative."""
    schema = "articles ARRAY<STRUCT<url: STRING, title: STRING, seendate: STRING, domain: STRING, language: STRING, sourcecountry: STRING, sentiment: STRING>>"
    a = raw.select(F.explode(F.from_json("raw", schema)["articles"]).alias("a")).select("a.*").where(filled(F.col("url")).isNotNull() & filled(F.col("title")).isNotNull())
    key = F.concat(F.lit("gdelt-doc:"), F.substring(F.sha1(F.trim("url")), 1, 16))
    title = F.substring(F.regexp_replace(F.trim("title"), r"\s+", " "), 1, 200)
    return a.select(key.alias("external_id"), title.alias("title"), moment(F.col("seendate"), "yyyyMMdd'T'HHmmss").alias("ts"), F.coalesce("language", F.lit("English")).alias("language"), F.coalesce(F.col("sentiment").try_cast("double"), F.lit(-0.1)).alias("sentiment"), F.lit(min(relevance / 2, 0.75)).alias("severity"), F.lit(credibility).alias("credibility"))


#: Severity of conflict events by kind, and their sentiment; config for the scorer.
CONFLICT_SEVERITY = {"battles": 0.8, "explosions/remote violence": 0.85, "violence against civilians": 0.9, "riots": 0.5, "protests": 0.3, "strategic developments": 0.25}


def conflicts(raw: DataFrame, severity: dict[str, float] = CONFLICT_SEVERITY) -> DataFrame:
    """JSON pages of conflict events: external_id, ts, kind, actors, place, fatalities (unreadable: 0), severity by kind and fatalities."""
    schema = "data ARRAY<STRUCT<event_id_cnty: STRING, event_date: STRING, event_type: STRING, actor1: STRING, actor2: STRING, fatalities: STRING, latitude: STRING, longitude: STRING>>"
    d = raw.select(F.explode(F.from_json("raw", schema)["data"]).alias("d")).select("d.*").where(filled(F.col("event_id_cnty")).isNotNull())
    dead = F.greatest(F.lit(0), F.coalesce(F.col("fatalities").try_cast("int"), F.lit(0)))
    base = F.lit(0.4)
    for kind, value in severity.items():
        base = F.when(F.lower(F.trim("event_type")) == kind, value).otherwise(base)
    lat, lng = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    there = lat.between(-90, 90) & lng.between(-180, 180)
    return d.select(F.concat(F.lit("acled:"), F.trim("event_id_cnty")).alias("external_id"), moment(F.col("event_date"), "yyyy-MM-dd").alias("ts"), F.col("event_type").alias("kind"), lines_of(F.array(filled(F.col("actor1")), filled(F.col("actor2"))), " / ").alias("actors"), F.when(there, lat).alias("lat"), F.when(there, lng).alias("lng"), dead.alias("fatalities"), F.round(F.least(F.lit(1.0), base + F.least(0.02 * dead, F.lit(0.2))), 4).alias("severity"))


@F.arrow_udf(StringType())
def unescaped(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Character references decoded; Spark has no function for all of them."""
    for batch in texts:
        yield pa.array([None if t is None else html.unescape(t).encode("utf-8", "replace").decode("utf-8") for t in batch.to_pylist()], pa.string())


def refined(text: Column) -> Column:
    """Tags out (up to 500 characters each), character references decoded, the tags that this shows out as well, URL escapes decoded, runs of blanks as one."""
    tag = r"<[^>]{0,500}>"
    plain = F.regexp_replace(unescaped(F.regexp_replace(text, tag, " ")), tag, " ")
    plain = F.url_decode(F.regexp_replace(plain, r"%(?![0-9A-Fa-f]{2})", "%25"))
    return F.trim(F.regexp_replace(plain, r"[ \t]{2,}", " "))


def cells(raw: DataFrame) -> DataFrame:
    """(row, cells): the rows of HTML tables with the plain texts of their cells; rows without cells are left out."""
    rows = F.regexp_extract_all("raw", F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|</table>|\z)"), F.lit(1))
    x = raw.select(F.posexplode(rows).alias("row", "html"))
    found = F.regexp_extract_all("html", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]>|<t[dh]\b|\z)"), F.lit(1))
    plain = F.transform(found, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " ")))
    return x.select("row", F.transform(plain, lambda c: F.replace(F.replace(F.replace(c, F.lit("&nbsp;"), F.lit(" ")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))).alias("cells")).where(F.size("cells") > 0)


def court_roll(raw: DataFrame) -> DataFrame:
    """Rows of a court roll that hold a case number: case_number, title, parties, day. The parts are known by their form, not by their column."""
    line = F.array_join("cells", " | ")
    title = F.get(F.filter("cells", lambda c: c.rlike(r"(?i)\s(?:v|vs|versus)\.?\s")), F.lit(0))
    number = F.regexp_extract(line, r"\b((?:[A-Z]{1,5}\s?)?\d+/(?:19|20)\d{2})\b", 1)
    day = F.regexp_extract(line, r"\b(\d{4}-\d{2}-\d{2}|\d{1,2} [A-Z][a-z]+ \d{4}|\d{1,2}/\d{1,2}/\d{4})\b", 1)
    date = F.coalesce(*[F.to_date(F.try_to_timestamp(day, F.lit(f))) for f in ("yyyy-MM-dd", "d MMMM yyyy", "d MMM yyyy", "d/M/yyyy")])
    return cells(raw).where(number != "").select(number.alias("case_number"), title.alias("title"), parties(title).alias("parties"), date.alias("day"))


# The wordings of a change of surname; the first two and the last give the new name first.
NAME = r"([A-Z][A-Z '-]{1,40}?)"
END = r"(?=[.,;\d]|\s+(?:and|born|id)\b|$)"
SURNAMES = [
    (rf"(?i)assume\s+the\s+surname\s+{NAME}\s+in\s+lieu\s+of\s+(?:the\s+surname\s+)?{NAME}{END}", True),
    (rf"(?i)assume\s+the\s+surname\s+{NAME}\s+instead\s+of\s+(?:the\s+surname\s+)?{NAME}{END}", True),
    (rf"(?i)change\s+(?:my\s+|the\s+)?surname\s+from\s+{NAME}\s+to\s+{NAME}{END}", False),
    (rf"(?i)naam\s+verander\s+(?:van\s+)?{NAME}\s+na\s+(?:naam\s+)?{NAME}{END}", True),
]


def surname_changes(texts: DataFrame, text: str = "text") -> DataFrame:
    """The notices of gazette texts, each a block from one number to the next, that change a surname: the other columns, notice, before, after, id_number. The first wording that fits counts."""
    blocks = F.split(text, r"(?i)(?=\bnotice\s+no\b)")
    x = texts.withColumn("_block", F.explode(blocks))
    before, after = [], []
    for pattern, new_first in SURNAMES:
        one, two = (F.nullif(F.initcap(F.lower(F.trim(F.regexp_extract("_block", pattern, k)))), F.lit("")) for k in (1, 2))
        before.append(two if new_first else one)
        after.append(one if new_first else two)
    found = x.withColumns({"notice": F.regexp_extract("_block", r"(?i)notice\s+no\.?\s*(\d{1,6})", 1).try_cast("int"), "before": F.coalesce(*before), "after": F.coalesce(*after), "id_number": F.nullif(F.regexp_extract("_block", r"\b(\d{13})\b", 1), F.lit(""))})
    return found.where("before is not null").drop("_block", text)


# Forms of procurement references.
REFERENCES = r"(?i)(?:\b(?:tender|bid|quotation)\s*(?:no\.?|number|ref\.?|#)\s*:?\s*([A-Z0-9]{2,10}[/-][0-9A-Z]{2,}(?:[/-][A-Z0-9]{1,10})?)|\b(RFP[- ]?\d{3,}|SCM[/-]\d{3,}[/-]\d{4})\b)"


def procurement(texts: DataFrame, text: str = "text", most: int = 10) -> DataFrame:
    """The other columns with references, amounts (millions), awardees and departments of a text: distinct, in order, `most` of each at most, which is the record's size.

    A comma with one or two digits behind it at the end is a decimal sign, other commas and blanks part thousands; amounts outside 0.01 to 999,000 millions are no amounts.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    few = lambda a: F.slice(F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x.cast("string") != ""))), 1, most)
    refs = F.transform(F.arrays_zip(F.regexp_extract_all(t, F.lit(REFERENCES), F.lit(1)).alias("a"), F.regexp_extract_all(t, F.lit(REFERENCES), F.lit(2)).alias("b")), lambda z: F.coalesce(F.nullif(z["a"], F.lit("")), z["b"]))
    money = r"(?i)\bR\s*(\d[\d ,.]*?)\s*(billion|million|bn|m)\b"
    numbers = F.arrays_zip(F.regexp_extract_all(t, F.lit(money), F.lit(1)).alias("n"), F.regexp_extract_all(t, F.lit(money), F.lit(2)).alias("u"))
    value = lambda z: F.regexp_replace(F.regexp_replace(z["n"], r"^(\d+),(\d{1,2})$", "$1.$2"), "[ ,]", "").try_cast("double") * F.when(F.lower(z["u"]).isin("billion", "bn"), 1000.0).otherwise(1.0)
    amounts = F.filter(F.transform(numbers, value), lambda v: (v >= 0.01) & (v <= 999000))
    awards = F.transform(F.regexp_extract_all(t, F.lit(r"(?i:awarded?\s+to|preferred\s+bidder|winning\s+bidder)\s*:?\s+([A-Z][\w&.' -]{3,99}?)(?=[,;.\n]|\s+for\b|\z)"), F.lit(1)), lambda x: F.trim(x))
    offices = F.transform(F.regexp_extract_all(t, F.lit(r"((?:Provincial )?Department of [A-Z][A-Za-z &]{3,60}?|Ministry of [A-Z][A-Za-z ]{3,50}?)(?=[,;.\n]|\s+(?:has|will|awarded)\b|\z)"), F.lit(1)), lambda x: F.trim(x))
    return texts.withColumns({"references": few(refs), "amounts": few(F.transform(amounts, lambda v: F.round(v, 2))), "awardees": few(awards), "departments": few(offices)}).drop(text)
