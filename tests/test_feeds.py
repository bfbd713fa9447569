"""Feed records that are broken, null, repeated or carry extra columns; kernels that SQL does not have."""

from difflib import SequenceMatcher

from skylark import queries as own
from skylark.sources import feeds

SF = "/root/testdata/sf0.001"


def raw(spark, *lines):
    return spark.createDataFrame([(x, "extra") for x in lines], "raw string, title string")


def test_broken_records_give_no_row(spark):
    assert feeds.rss(raw(spark, None, "", "<item><title>no key</title></item>", "not xml")).count() == 0
    assert feeds.quakes(raw(spark, None, "", "{", "{}", '{"id": "a", "properties": {"mag": 1.0}}')).count() == 0
    assert feeds.hotspots(raw(spark, None, "", "a,b,c")).count() == 0
    assert feeds.sanctions(raw(spark, None, "", "x,y")).count() == 0
    assert feeds.notices(raw(spark, None, "", "[]", '{"page": 1}')).count() == 0


def test_fields_that_cannot_be_read_are_null(spark):
    row = feeds.rss(raw(spark, "<item><link>u</link><title>Tsunami</title><pubDate>soon</pubDate></item>")).first()
    assert (row.external_id, row.ts, row.lat, row.is_priority) == ("rss:u", None, None, 1)
    row = feeds.buoys(raw(spark, "# note", "S1 2024 01 02 03 04 MM 5.5"), "STN YY MM DD hh mm WVHT WSPD".split()).first()
    assert (row.station, row.wave_m, row.wind_ms) == ("S1", None, 5.5)


def test_keep_first_takes_the_earliest(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z"), ("b", 1, "z")], "k string, t int, v string")
    assert sorted(map(tuple, feeds.keep_first(rows, "k", "t").collect())) == [("a", 1, "y"), ("b", 1, "z")]


def test_sequence_ratio(spark):
    for r in own.queries()["t14_sequence_ratio"](spark, SF).collect():
        assert r.ratio == SequenceMatcher(None, r.p_name, r.p_type.lower(), autojunk=False).ratio()
