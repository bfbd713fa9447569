"""Files as artifacts: hashes, kind by leading bytes, and what a photograph's EXIF directories tell, all as Column expressions over the bytes.

Nothing that a file holds makes a query fail: what can't be read is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file in which its metadata are looked for; the first segments of a photograph.
HEAD = 65_536
#: Segments before the metadata, and entries of a directory, that are looked at at most; both are one-digit or two-digit numbers in real files.
SEGMENTS, ENTRIES = 32, 64
#: How files of a kind begin, in hexadecimal digits.
KINDS = {"jpeg": "FFD8FF", "png": "89504E470D0A1A0A", "gif": "474946383", "pdf": "255044462D", "zip": "504B0304", "gzip": "1F8B", "tiff": "49492A00", "mp3": "494433", "xml": "3C3F786D6C", "html": "3C21444F4354595045"}
# Tags of EXIF directories.
MAKE, MODEL, TAKEN, GPS = 0x010F, 0x0110, 0x0132, 0x8825
LAT_REF, LAT, LNG_REF, LNG = 1, 2, 3, 4


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, length, content) of the files below a path. Files are rows, so each must be smaller than 2 GB."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("modificationTime").alias("modified"), "length", "content")


def kind(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 16))
    return F.coalesce(*[F.when(head.startswith(v), k) for k, v in KINDS.items()], F.when(content.isNotNull(), "other"))


def number(digits: Column, at: Column, size: int, little: Column) -> Column:
    """The unsigned number of so many bytes at a byte place (from 0) of hexadecimal digits; null beyond the end."""
    part = lambda k: F.substring(digits, 2 * (at + k) + 1, F.lit(2))
    whole = F.substring(digits, 2 * at + 1, F.lit(2 * size))
    turned = F.concat(*[part(k) for k in reversed(range(size))])
    return F.when((at >= 0) & (F.length(whole) == 2 * size), F.conv(F.when(little, turned).otherwise(whole), 16, 10).cast("long"))


def exif_start(digits: Column) -> Column:
    """Where the directories' header begins: segments are followed from the start until one holds EXIF; null without one."""
    big = F.lit(False)
    start = F.struct(F.lit(2).cast("long").alias("at"), F.lit(None).cast("long").alias("found"))

    def step(s: Column, _: Column) -> Column:
        here = F.substring(digits, 2 * s["at"] + 1, F.lit(4))
        size = number(digits, s["at"] + 2, 2, big)
        held = (here == "FFE1") & (F.substring(digits, 2 * (s["at"] + 4) + 1, F.lit(12)) == "457869660000")
        ahead = F.when(here.startswith("FF") & (size >= 2) & (here != "FFDA"), s["at"] + 2 + size)
        return F.when(s["found"].isNotNull() | s["at"].isNull(), s).otherwise(F.struct(F.when(~held, ahead).alias("at"), F.when(held, s["at"] + 10).alias("found")))

    return F.when(digits.startswith("FFD8"), F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), start, step, lambda s: s["found"]))


def entry(digits: Column, start: Column, directory: Column, tag: int, little: Column) -> Column:
    """(count, at) of a directory's entry: how many values, and where they are; null without it. start: of the header, to which places refer."""
    many = F.least(number(digits, directory, 2, little), F.lit(ENTRIES))
    # Sizes of a value by type: bytes and text 1, short 2, long 4, rational 8.
    places = F.when(many > 0, F.transform(F.sequence(F.lit(0).cast("long"), many - 1), lambda k: directory + 2 + 12 * k))
    at = F.get(F.filter(places, lambda p: number(digits, p, 2, little) == tag), F.lit(0))
    width = F.element_at(F.create_map(*[F.lit(x).cast("long") for x in (1, 1, 2, 1, 3, 2, 4, 4, 5, 8, 7, 1, 9, 4, 10, 8)]), F.coalesce(number(digits, at + 2, 2, little), F.lit(1)).cast("long"))
    count = number(digits, at + 4, 4, little)
    return F.when(at.isNotNull(), F.struct(count.alias("count"), F.when(count * width <= 4, at + 8).otherwise(start + number(digits, at + 8, 4, little)).alias("at")))


def text(digits: Column, found: Column) -> Column:
    """An entry's text, up to its closing zero."""
    raw = F.unhex(F.substring(digits, (2 * found["at"] + 1).cast("int"), (2 * F.least(found["count"], F.lit(256))).cast("int")))
    return F.nullif(F.trim(F.regexp_replace(F.try_validate_utf8(F.decode(raw, "ISO-8859-1")), "\\x00.*", "")), F.lit(""))


def degrees(digits: Column, values: Column, ref: Column, little: Column, negative: str) -> Column:
    """Degrees, minutes and seconds, three rationals, as a signed number."""
    part = lambda k: F.try_divide(number(digits, values["at"] + 8 * k, 4, little), number(digits, values["at"] + 8 * k + 4, 4, little))
    size = F.when(values["count"] >= 3, part(0) + part(1) / 60 + part(2) / 3600)
    return F.when(F.upper(ref) == negative, -size).otherwise(size)


def with_exif(files: DataFrame, content: str = "content") -> DataFrame:
    """files with make, model, taken, lat and lng of their EXIF directories, in either byte order; null where there is none. Steps are columns of their own, so that each is computed once."""
    d, s = F.col("_digits"), F.col("_start")
    x = files.withColumn("_digits", F.hex(F.substring(F.col(content), 1, HEAD))).withColumn("_start", exif_start(d))
    x = x.withColumn("_order", F.substring(d, (2 * s + 1).cast("int"), F.lit(4))).withColumn("_little", F.col("_order") == "4949")
    little = F.col("_little")
    x = x.withColumn("_dir", F.when(F.col("_order").isin("4949", "4D4D"), s + number(d, s + 4, 4, little)))
    named = {k: entry(d, s, F.col("_dir"), t, little) for k, t in (("_make", MAKE), ("_model", MODEL), ("_taken", TAKEN), ("_gps", GPS))}
    x = x.withColumns(named)
    x = x.withColumn("_gps", F.when(F.col("_gps").isNotNull(), s + number(d, F.col("_gps.at"), 4, little)))
    x = x.withColumns({k: entry(d, s, F.col("_gps"), t, little) for k, t in (("_lat_ref", LAT_REF), ("_lat", LAT), ("_lng_ref", LNG_REF), ("_lng", LNG))})
    place = lambda v, r, n: degrees(d, F.col(v), text(d, F.col(r)), little, n)
    lat, lng = place("_lat", "_lat_ref", "S"), place("_lng", "_lng_ref", "W")
    made = {
        "make": text(d, F.col("_make")), "model": text(d, F.col("_model")), "taken": F.try_to_timestamp(text(d, F.col("_taken")), F.lit("yyyy:MM:dd HH:mm:ss")),
        "lat": F.when(F.abs(lat) <= 90, lat), "lng": F.when(F.abs(lng) <= 180, lng),
    }
    return x.withColumns(made).drop(*[c for c in x.columns if c.startswith("_") and c not in files.columns])


def artifacts(files: DataFrame) -> DataFrame:
    """files (content, ...) with kind, size, sha256, md5 and what EXIF tells; without the bytes."""
    c = F.col("content")
    return with_exif(files.withColumns({"kind": kind(c), "size": F.octet_length(c).cast("long"), "sha256": F.sha2(c, 256), "md5": F.md5(c)})).drop("content")
