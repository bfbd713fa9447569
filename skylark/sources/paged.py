"""Paged feeds as a Spark data source, for batch and streaming reads through one class: `spark.read.format("paged_feed")`.

A feed is a location with numbered pages (`page=0`, `page=1`, ...), each a folder of files or one file `page-0.rss`; pages are dealt to a bounded number of partitions, up to which each page is one, and read by the task that gets them; the location is listed once for all. Options: `location` (any store that pyarrow's file systems
know), `pushdown`, `kind` (`rss`: items of an XML feed; `json`: a list or lines of objects), `since` (earliest time), `fields` (JSON object that renames a feed's own fields). A filter on `published` can be taken by the source, so that older items
leave a task no further. A page that can't be read as its kind gives no items; items without an id get one from their link.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

FORMAT = "paged_feed"
SCHEMA = "external_id string, title string, link string, published timestamp, source string, page bigint, place int"
PAGE = re.compile(r"page[=-](\d+)")
#: Setting by which Spark hands filters to sources in Python.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


#: Tasks that a feed's pages are dealt to at most, neighbouring ones together.
MOST_TASKS = 200


class Page(InputPartition):
    """A page, or several that follow each other, with the names of each one's files and folders where they were listed."""

    def __init__(self, number: int, listed: dict[int, list[str]] | None = None):
        super().__init__(number)
        self.number, self.listed = number, listed or {number: None}


def dealt(pages: dict[int, list[str]], most: int = MOST_TASKS) -> list[Page]:
    """Pages in order, in so many partitions at most."""
    numbers = sorted(pages)
    each = -(-len(numbers) // most) or 1
    return [Page(numbers[k], {n: pages[n] for n in numbers[k : k + each]}) for k in range(0, len(numbers), each)]


def moment(value) -> datetime | None:
    """A time in RFC 2822, ISO 8601 or seconds, in UTC without a zone of its own; null if it is none."""
    try:
        if isinstance(value, (int, float)):
            found = datetime.fromtimestamp(value, timezone.utc)
        else:
            raw = str(value).strip()
            found = parsedate_to_datetime(raw) if "," in raw[:5] else datetime.fromisoformat(raw)
    except (ValueError, TypeError, OverflowError, OSError):
        return None
    return found.astimezone(timezone.utc) if found.tzinfo else found.replace(tzinfo=timezone.utc)


def rss_items(raw: bytes) -> Iterator[dict]:
    try:
        root = ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        return
    for item in root.iter("item"):
        of = lambda name: (item.findtext(name) or "").strip() or None  # noqa: B023, E731
        yield {"external_id": of("guid"), "title": of("title"), "link": of("link"), "published": of("pubDate"), "source": of("source")}


def json_items(raw: bytes) -> Iterator[dict]:
    text = raw.decode("utf-8", "replace")
    for piece in [text] if text.lstrip().startswith("[") else text.splitlines():
        try:
            found = json.loads(piece)
        except ValueError:
            continue
        yield from (x for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict))


KINDS = {"rss": rss_items, "json": json_items}


class Feed:
    """The pages of a location, and their items as rows."""

    def __init__(self, options: dict):
        self.location, self.kind = options["location"], options.get("kind", "rss")
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {sorted(KINDS)}")
        self.since = moment(options["since"]) if options.get("since") else None
        self.fields = json.loads(options.get("fields") or "{}")

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.location)

    def listed(self) -> dict[int, list[str]]:
        """Names of the files and folders of each page that is there; the location is listed once."""
        store, path = self.store()
        found: dict[int, list[str]] = {}
        for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if m := PAGE.match(f.base_name):
                found.setdefault(int(m[1]), []).append(f.base_name)
        return found

    def pages(self) -> list[int]:
        """Numbers of the pages that are there, in order."""
        return sorted(self.listed())

    def files(self, page: int, names: list[str] | None = None) -> Iterator[bytes]:
        store, path = self.store()
        names = self.listed().get(page, []) if names is None else names
        for f in store.get_file_info([f"{path.rstrip('/')}/{name}" for name in sorted(names)]):
            parts = [f] if f.is_file else sorted(store.get_file_info(fs.FileSelector(f.path, allow_not_found=True)), key=lambda f: f.path)
            for part in parts:
                if part.is_file and not part.base_name.startswith(("_", ".")):
                    with store.open_input_stream(part.path) as held:
                        yield held.read()

    def rows(self, page: int, names: list[str] | None = None) -> Iterator[tuple]:
        place = 0
        for raw in self.files(page, names):
            for item in KINDS[self.kind](raw):
                x = {k: item.get(self.fields.get(k, k)) for k in ("external_id", "title", "link", "published", "source")}
                at = moment(x["published"])
                text = lambda k: None if x[k] is None else str(x[k])  # noqa: B023, E731
                own = text("external_id") or (hashlib.sha1(text("link").encode()).hexdigest() if x["link"] else None)
                place += 1
                if own is None or self.since and (at is None or at < self.since):
                    continue
                yield own, text("title"), text("link"), at, text("source"), page, place - 1


class BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.feed = Feed(options)

    def partitions(self) -> list[InputPartition]:
        return dealt(self.feed.listed())

    def read(self, partition: Page | None) -> Iterator[tuple]:
        for page, names in partition.listed.items() if partition else ():  # None: a feed without pages
            yield from self.feed.rows(page, names)


class FilteringReader(BatchReader):
    """A reader that takes filters, which Spark allows only where the session has switched that on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  name of the interface
        """Takes lower bounds on the time; all filters go back to Spark too, which a bound without its equality needs."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("published",):
                bound = f.value if f.value.tzinfo else f.value.replace(tzinfo=timezone.utc)
                self.feed.since = max(self.feed.since or bound, bound)
            yield f


class StreamReader(DataSourceStreamReader):
    """Offsets are page numbers: pages are complete once they are there."""

    def __init__(self, options: dict):
        self.feed = Feed(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"next": max(self.feed.pages(), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return dealt({n: names for n, names in self.feed.listed().items() if start["next"] <= n < end["next"]})

    def read(self, partition: Page) -> Iterator[tuple]:
        for page, names in partition.listed.items():
            yield from self.feed.rows(page, names)


class PagedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else BatchReader)(self.options)

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self.options)


def read_feed(spark: SparkSession, location: str, stream: bool = False, **options: str) -> DataFrame:
    """The items of a feed, as a table or a stream. Filters on the time are pushed down if the session has PUSHDOWN on; the option `since` needs no setting."""
    spark.dataSource.register(PagedFeed)
    reader = (spark.readStream if stream else spark.read).format(FORMAT).option("location", location).option("pushdown", spark.conf.get(PUSHDOWN, "false").lower())
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def keep_first(items: DataFrame) -> DataFrame:
    """One item of each id: that of the earliest page and place."""
    rest = [c for c in items.columns if c != "external_id"]
    best = items.groupBy("external_id").agg(F.min_by(F.struct(*rest), F.struct("page", "place")).alias("_x"))
    return best.select("external_id", *[F.col(f"_x.{c}").alias(c) for c in rest])
