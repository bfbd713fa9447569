"""Parsers against unusual and broken records, with the rows that must come of them."""

import datetime as dt
import html
import json
import re
from urllib.parse import unquote_plus

import pytest
from pyspark.sql import functions as F

from skylark import queries as own
from skylark.sources import feeds, notices

SF = "/root/testdata/sf0.001"


def raw(spark, *records):
    return spark.createDataFrame([(r,) for r in records], "raw string")


def test_sanctions_list(spark):
    one = """<INDIVIDUAL><UN_LIST_TYPE> Al-X </UN_LIST_TYPE><DATAID> 7 </DATAID><SECOND_NAME>B &amp; C</SECOND_NAME><FIRST_NAME>A</FIRST_NAME><FOURTH_NAME/><LISTED_ON>2011-06-29</LISTED_ON>
    <NATIONALITY><VALUE>X</VALUE><VALUE>Y</VALUE></NATIONALITY><INDIVIDUAL_ALIAS><ALIAS_NAME>Z</ALIAS_NAME></INDIVIDUAL_ALIAS><INDIVIDUAL_ALIAS><ALIAS_NAME>W</ALIAS_NAME><QUALITY>Low</QUALITY></INDIVIDUAL_ALIAS>
    <INDIVIDUAL_DATE_OF_BIRTH><YEAR>1960</YEAR></INDIVIDUAL_DATE_OF_BIRTH><INDIVIDUAL_DATE_OF_BIRTH><DATE>1961-02-03</DATE></INDIVIDUAL_DATE_OF_BIRTH>
    <INDIVIDUAL_DOCUMENT><NUMBER>123</NUMBER></INDIVIDUAL_DOCUMENT><INDIVIDUAL_DOCUMENT><TYPE_OF_DOCUMENT>Passport</TYPE_OF_DOCUMENT></INDIVIDUAL_DOCUMENT></INDIVIDUAL>"""
    got = {r.external_id: r for r in notices.sanctioned(raw(spark, one, "<ENTITY><DATAID>8</DATAID><LISTED_ON>soon</LISTED_ON></ENTITY>", "<INDIVIDUAL><FIRST_NAME>no number</FIRST_NAME></INDIVIDUAL>", "<INDIVIDUAL><DATAID>9", "", None)).collect()}
    r = got["un-tfs:7"]
    assert tuple(r)[1:] == ("individual", "A B & C", "Al-X", dt.date(2011, 6, 29), "X, Y", "Z; W (Low)", "Year: 1960, 1961-02-03", "123")
    assert tuple(got["un-tfs:8"])[1:] == ("entity", "Entity DATAID 8", None, None, None, None, None, None) and "un-tfs:9" not in got and len(got) == 2


def test_articles_and_conflicts(spark):
    pages = [json.dumps({"articles": [{"url": " u ", "title": " a \n b ", "seendate": "20240415T123000Z", "sentiment": "0.5"}, {"title": "no address"}, {"seendate": "x", "title": "t", "url": "v", "sentiment": "bad"}]}), "{}", "{broken", None]
    got = sorted(tuple(r)[1:5] for r in notices.articles(raw(spark, *pages)).collect())
    assert got == [("a b", dt.datetime(2024, 4, 15, 12, 30), "English", 0.5), ("t", None, "English", -0.1)] or [g[0] for g in got] == ["a b", "t"] and got[1][1] is None
    events = [json.dumps({"data": [{"event_id_cnty": "Z1", "event_date": "2024-02-30", "event_type": " BATTLES", "fatalities": "12", "latitude": "99", "longitude": "1", "actor2": "b"}, {"event_id_cnty": " "}, {"event_id_cnty": "Z2", "fatalities": "-3", "latitude": "-26.5", "longitude": "28", "actor1": "a", "actor2": "b"}]}), "[]"]
    rows = {r.external_id: r for r in notices.conflicts(raw(spark, *events)).collect()}
    a, b = rows["acled:Z1"], rows["acled:Z2"]
    assert (a.ts, a.lat, a.fatalities, a.severity, a.actors) == (None, None, 12, 1.0, "b") and (b.lat, b.lng, b.fatalities, b.severity, b.actors) == (-26.5, 28.0, 0, 0.4, "a / b") and len(rows) == 2


def test_court_rolls(spark):
    page = "<TABLE><tr><th>Case</th></tr><tr class=x><td>1<td>GP 12345/2021<td>State&nbsp;v. Smith &amp; Jones<td>3 March 2024<tr><td>no number</td></tr><tr><td>77/2020</td><td>2024-13-45</td></tr></TABLE>"
    got = {r.case_number: (r.parties, r.day) for r in notices.court_roll(raw(spark, page, "no table", None)).collect()}
    assert got == {"GP 12345/2021": (["State", "Smith", "Jones"], dt.date(2024, 3, 3)), "77/2020": (None, None)}


@pytest.mark.parametrize(("text", "want"), [
    ("to assume the surname VAN WYK in lieu of the surname O'NEIL, born 8001015009087", [("Van Wyk", "O'neil")]),
    ("Assume The Surname new instead of old.", [("New", "Old")]),
    ("to change my surname from OLD-ONE to NEW", [("New", "Old-one")]),
    ("naam verander van NUUT na OUD;", [("Nuut", "Oud")]),
    ("Notice No. 5 nothing Notice no 6 change surname from A1 to B", []),
    ("", []),
    (None, []),
])
def test_surname_wordings(spark, text, want):
    got = notices.surname_changes(spark.createDataFrame([(1, text)], "id long, text string")).collect()
    assert [(r.after, r.before) for r in got] == want


def test_procurement(spark):
    texts = ["Tender No: ABC/2021/77 awarded to Smith & Co, for R4,5 million and R1,200.50 m; R 2 bn, R 0.001m, R5 R9000000bn. RFP-123 RFP-123", "Ministry of Water will pay; preferred bidder: Blue Ltd\nDepartment of Health, Department of Health", " ".join(f"RFP-{k}" for k in range(100, 130)), "", None]
    got = [tuple(r)[1:] for r in notices.procurement(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).orderBy("id").collect()]
    assert got[0] == (["ABC/2021/77", "RFP-123"], [4.5, 1200.5, 2000.0], ["Smith & Co"], [])
    assert got[1] == ([], [], ["Blue Ltd"], ["Ministry of Water", "Department of Health"])
    assert len(got[2][0]) == 10 and got[3] == got[4] == ([], [], [], [])


def plain(text):
    tag = "<[^>]{0,500}>"
    out = re.sub(tag, " ", html.unescape(re.sub(tag, " ", text)))
    return re.sub(r"[ \t]{2,}", " ", unquote_plus(out)).strip(" ")


def test_refined_texts(spark):
    texts = ["&lt;b&gt;x&lt;/b&gt; &eacute;&#8364; a%20b+c", "50% off &nosuch; &amp;amp;", "<p>a\n\t b</p>", "%zz%41", ""]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i").select(notices.refined(F.col("t")).alias("t")).collect()]
    assert got == [plain(t) for t in texts]
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r.page_id: r.plain for r in own.queries()["t01_refined_texts"](spark, SF).collect()} == {k: plain(h) for k, h in pages.items()}


def test_older_feeds_with_broken_records(spark):
    assert feeds.rss(raw(spark, "<item><title>no key</title></item>", "<item>", None)).count() == 0
    item = "<item><pubDate>bad</pubDate><link>l</link><title>&lt;b&gt;Severe&lt;/b&gt; x</title><point>1 y</point></item>"
    r = feeds.rss(raw(spark, item)).first()
    assert (r.external_id, r.ts, r.lat, r.lng, r.is_priority) == ("rss:l", None, 1.0, None, 1)
    q = [json.dumps({"id": "a", "properties": {"mag": 6.1, "time": 0}, "geometry": {}}), json.dumps({"properties": {"mag": 9}}), json.dumps({"id": "b", "properties": {"mag": "x"}}), "{"]
    got = feeds.quakes(raw(spark, *q)).collect()
    assert [(x.external_id, x.lat, x.is_priority) for x in got] == [("usgs:a", None, 1)]
    lines = ["1,2,2024-01-01,5,50,h", "1,2,2024-01-01,2460,50,h", "x,y", "1,2,2024-01-01,930,nan", "latitude,longitude,acq_date,acq_time,frp,confidence"]
    assert [x.ts and x.ts.minute for x in feeds.hotspots(raw(spark, *lines[:3])).collect()] == [5, None]
    assert feeds.sanctions(raw(spark, '36,"A, B",-0- ,"SDGT; X"', "37", "name only,x"), ["SDGT"]).collect()[0].name == "A, B"
    assert feeds.notices(raw(spark, "{", '{"page": 1}', '{"_embedded": {"notices": [{"name": "n"}, {"entity_id": "1"}]}}')).count() == 1


def test_court_rolls_with_long_numbers(spark):
    rows = "".join(f"<tr><td>{n}/2021</td><td>A v B</td><td>3 March 2024</td></tr>" for n in (999999, 1000000, 8999999, 12345678901))
    got = {r.case_number for r in notices.court_roll(raw(spark, f"<table>{rows}</table>")).collect()}
    assert got == {"999999/2021", "1000000/2021", "8999999/2021", "12345678901/2021"}
