"""Files that the test writes: photographs of either byte order, other kinds, broken ones."""

import hashlib
import random
import struct

import pytest

from skylark.sources import files


def photograph(order, lat, lng, make=b"Maker\0", before=b"", gps=True, taken=b"2024:03:05 10:20:30\0"):
    """A JPEG of metadata only, in byte order < or >."""
    pack = lambda f, *v: struct.pack(order + f, *v)
    rational = lambda v: pack("IIIIII", int(abs(v)), 1, int(abs(v) * 60 % 60), 1, round(abs(v) * 3600 % 60 * 1000), 1000)
    entries = 2 + gps
    at = 8 + 2 + 12 * entries + 4
    data, place = b"", lambda raw: at + len(data)

    def text(tag, raw):
        nonlocal data
        if len(raw) <= 4:
            return pack("HHI", tag, 2, len(raw)) + raw.ljust(4, b"\0")
        out = pack("HHII", tag, 2, len(raw), place(raw))
        data += raw
        return out

    first = [text(0x010F, make), text(0x0132, taken)]
    if gps:
        first.append(pack("HHII", 0x8825, 4, 1, at + len(data)))
        start = at + len(data) + 2 + 12 * 4 + 4
        data += pack("H", 4) + pack("HHI", 1, 2, 2) + (b"S" if lat < 0 else b"N").ljust(4, b"\0") + pack("HHII", 2, 5, 3, start)
        data += pack("HHI", 3, 2, 2) + (b"W" if lng < 0 else b"E").ljust(4, b"\0") + pack("HHII", 4, 5, 3, start + 24) + pack("I", 0) + rational(lat) + rational(lng)
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + pack("I", 8) + pack("H", entries) + b"".join(first) + pack("I", 0) + data
    app1 = b"Exif\0\0" + tiff
    return b"\xff\xd8" + before + b"\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xda\x00\x02" + b"\0" * 50


COMMENT = b"\xff\xe0\x00\x10JFIF" + b"\0" * 10


@pytest.mark.parametrize("order", ["<", ">"])
def test_photographs_in_a_folder(spark, tmp_path, order):
    made = {"a.jpg": (-33.918861, 18.4233, COMMENT), "b.jpg": (51.5, -0.1275, b""), "c.jpg": (0.0, 179.5, COMMENT * 3)}
    for name, (lat, lng, before) in made.items():
        (tmp_path / name).write_bytes(photograph(order, lat, lng, before=before))
    (tmp_path / "no.jpg").write_bytes(photograph(order, 1, 1, gps=False, make=b"A\0", taken=b"whenever\0"))
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.artifacts(files.read_files(spark, str(tmp_path), "*.jpg")).collect()}
    for name, (lat, lng, _) in made.items():
        r, raw = rows[name], (tmp_path / name).read_bytes()
        assert (r.lat, r.lng) == (pytest.approx(lat, abs=1e-6), pytest.approx(lng, abs=1e-6))
        assert (r.kind, r.size, r.make, str(r.taken)) == ("jpeg", len(raw), "Maker", "2024-03-05 10:20:30")
        assert (r.sha256, r.md5) == (hashlib.sha256(raw).hexdigest(), hashlib.md5(raw).hexdigest())
    assert rows["no.jpg"].make == "A" and rows["no.jpg"].lat is None and rows["no.jpg"].taken is None


def test_broken_files_give_null(spark):
    draw, whole = random.Random(6), photograph("<", 10.5, 20.25, before=COMMENT)
    raws = [None, b"", b"\xff\xd8", b"plain text", b"%PDF-1.4", b"\x89PNG\r\n\x1a\n", whole[:60], b"\xff\xd8" + b"\xff" * 5_000, b"\xff\xd8\xff\xe1\x00\x00", b"\xff\xd8\xff\xe1\x00\x08Exif\0\0II"]
    raws += [whole[:k] for k in range(0, len(whole), 7)]
    for _ in range(60):
        torn = bytearray(whole)
        for _ in range(draw.randrange(1, 12)):
            torn[draw.randrange(len(torn))] = draw.randrange(256)
        raws.append(bytes(torn))
    frame = spark.createDataFrame([(k, None if b is None else bytearray(b), "x") for k, b in enumerate(raws)], "id int, content binary, lat string")
    rows = files.artifacts(frame).collect()
    assert len(rows) == len(raws)
    got = {r.id: r for r in rows}
    assert [got[k].kind for k in range(6)] == [None, "other", "other", "other", "pdf", "png"]
    assert all(r.lat is None or -90 <= r.lat <= 90 for r in rows) and all(got[k].lat is None for k in range(10))
    assert files.artifacts(frame.where("false")).count() == 0
