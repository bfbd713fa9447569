"""The paged source: batch and stream over the same pages, odd items, the pushed filter, pages that come later."""

import hashlib
import json

from pyspark.sql import functions as F

from skylark.sources import paged
from skylark.streaming import events as streams


def rss(*items):
    return "<rss><channel>" + "".join("<item>" + "".join(f"<{k}>{v}</{k}>" for k, v in i.items()) + "</item>" for i in items) + "</channel></rss>"


def test_times():
    assert paged.moment("Wed, 10 Jan 2024 12:00:00 +0200").isoformat() == "2024-01-10T10:00:00+00:00"
    assert paged.moment("2024-01-10 12:00").isoformat() == "2024-01-10T12:00:00+00:00" == paged.moment(1704888000).isoformat()
    assert [paged.moment(x) for x in ("soon", None, "", 1e30, [])] == [None] * 5


def test_batch_and_stream_read_the_same_pages(spark, tmp_path):
    feed, place = tmp_path / "feed", f"file://{tmp_path}/feed"
    feed.mkdir()
    (feed / "page-0.rss").write_text(rss({"guid": "a", "title": "first &amp; last", "link": "l", "pubDate": "Wed, 10 Jan 2024 12:00:00 GMT"}, {"title": "no id", "link": "http://x"}, {"title": "nothing"}))
    (feed / "page-1.rss").write_text(rss({"guid": "a", "title": "later", "pubDate": "Thu, 11 Jan 2024 12:00:00 GMT"}, {"guid": "b", "title": "", "pubDate": "never"}))
    (feed / "page-2.rss").write_text("<rss><item>torn")
    (feed / "notes.txt").write_text("no page")
    rows = paged.read_feed(spark, place)
    assert rows.rdd.getNumPartitions() == 3
    first = {r.external_id: (r.title, r.page, r.place) for r in paged.keep_first(rows).collect()}
    own = hashlib.sha1(b"http://x").hexdigest()
    assert first == {"a": ("first & last", 0, 0), own: ("no id", 0, 1), "b": (None, 1, 1)}
    read = lambda: sorted(tuple(r) for r in streams.drained(paged.read_feed(spark, place, stream=True), str(tmp_path / "run")).select("external_id", "page", "place").collect())
    batch = lambda: sorted(tuple(r) for r in paged.read_feed(spark, place).select("external_id", "page", "place").collect())
    assert read() == batch() and len(batch()) == 4
    (feed / "page-3.rss").write_text(rss({"guid": "c"}))
    assert read() == batch() and len(batch()) == 5
    assert paged.read_feed(spark, f"file://{tmp_path}/nowhere").count() == 0


def test_the_time_filter_reaches_the_source(spark, tmp_path):
    (tmp_path / "page=0").mkdir()
    lines = [{"id": k, "published": f"2024-01-{k:02} 00:00:00", "title": k} for k in range(1, 29)] + ["text", [1], None]
    (tmp_path / "page=0" / "part-0.json").write_text("\n".join(map(json.dumps, lines)) + "\n{torn")
    (tmp_path / "page=0" / "_SUCCESS").write_text("")
    spark.conf.set(paged.PUSHDOWN, "true")
    try:
        rows = paged.read_feed(spark, f"file://{tmp_path}", kind="json", fields='{"external_id": "id"}')
        late = rows.where(F.col("published") > F.to_timestamp(F.lit("2024-01-20 00:00:00")))
        assert sorted(int(r.external_id) for r in late.collect()) == list(range(21, 29))
        reader = paged.FilteringReader({"location": f"file://{tmp_path}", "kind": "json", "fields": '{"external_id": "id"}'})
        list(reader.pushFilters([paged.GreaterThanOrEqual(("published",), paged.moment("2024-01-20"))]))
        assert len(list(reader.read(paged.Page(0)))) == 9
    finally:
        spark.conf.set(paged.PUSHDOWN, "false")
    assert paged.read_feed(spark, f"file://{tmp_path}", kind="json", since="2024-01-25", fields='{"external_id": "id"}').count() == 4


def test_many_pages_take_few_tasks_and_one_listing(spark, tmp_path, monkeypatch):
    for k in range(paged.MOST_TASKS * 2 + 1):
        (tmp_path / f"page-{k}.json").write_text(json.dumps({"external_id": k}))
    rows = paged.read_feed(spark, f"file://{tmp_path}", kind="json")
    assert rows.rdd.getNumPartitions() <= paged.MOST_TASKS
    assert sorted((int(r.external_id), r.page) for r in rows.collect()) == [(k, k) for k in range(paged.MOST_TASKS * 2 + 1)]
    # A task lists nothing but what is in its pages' folders.
    reader = paged.BatchReader({"location": f"file://{tmp_path}", "kind": "json"})
    parts = reader.partitions()
    monkeypatch.setattr(paged.fs, "FileSelector", lambda *a, **k: 1 / 0)
    assert sum(len(list(reader.read(p))) for p in parts) == paged.MOST_TASKS * 2 + 1
