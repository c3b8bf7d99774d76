"""Archives: round trip, revisits, seek table, lookups, damage, edges."""

import glob
import hashlib
import os
import struct

import pyarrow as pa
import pytest
import zstandard

from gleaner.llm import warc
from gleaner.llm.queries import op13_warc

PAGES = "page_id bigint, url string, html string, digest string, refers_to int, salt int"


def _df(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], PAGES)


def _rows():
    same, short = "<p>copy é</p>" * 20, "x" * 99
    rows = [(i, f"http://host/{i}", f"<html>{i}" + "y" * (i * 37 % 500)) for i in range(300)]
    rows += [(1000 + i, "http://hot/", same) for i in range(150)]
    rows += [(2000, "u", short), (2001, "u", short), (2002, "u", "x" * 100), (2003, "u", "x" * 100)]
    rows += [(2010, None, None), (2011, "a b\r\nX: y é", ""), (2012, "http://long", "long " * 400_000)]
    rows += [(2020, "u", "é" * 50), (2021, "v", "é" * 50), (2030, "u", "\r\n\r\nWARC/1.1\r\n" * 20)]
    rows += [(None, "n", same), (None, "n", "z" * 200), (None, "n", "z" * 200), (-5, "minus", "z" * 300), (4, "w", "z" * 300)]
    return rows + [(1000, "http://again/", same), (0, "http://host/0", "<html>0")]


def _wanted(rows):
    least = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            least[data] = min(i, least.get(data, i))
    for i, _, html in rows:
        data = (html or "").encode()
        first = least.get(data)
        revisit = first is not None and i != first
        yield (
            i, len(data), hashlib.sha256(data).hexdigest(),
            "revisit" if revisit else "response", first if revisit else None,
        )


def test_round_trip(spark, scratch):
    rows, folder = _rows(), scratch("archives")
    warc.write_archives(_df(spark, rows), folder, frame_bytes=4000, bundle_bytes=2000)
    read = warc.read_archives(spark, folder).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(got, key=key) == sorted(_wanted(rows), key=key)
    html = {(i, (h or "").encode()) for i, _, h in rows}
    for r in read:
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or (r.page_id, bytes(r.payload)) in html
    urls = {r.page_id: r.url for r in read}
    assert urls[2010] is None and urls[2011] == "a%20b%0D%0AX:%20y%20é" and urls[7] == "http://host/7"
    # The index names the same places as reading in order does.
    places = {(r.record_id, r.bundle, r.frame, r.offset, r.length) for r in read}
    index = warc.read_index(spark, folder).collect()
    assert places == {(r.record_id, r.bundle, r.frame, r.offset, r.length) for r in index}
    assert len({r.bundle for r in index}) > 3 and max(r.frame for r in index) > 1


def test_single_records_are_read_by_their_frames(spark, scratch):
    rows, folder = _rows(), scratch("archives")
    warc.write_archives(_df(spark, rows), folder, frame_bytes=3000)
    wanted = spark.createDataFrame([(5,), (2012,), (1007,), (5,), (123456,), (None,)], "page_id bigint")
    got = {r.page_id: r for r in warc.read_records(wanted, folder).collect()}
    assert set(got) == {5, 2012, 1007}
    assert bytes(got[2012].payload) == b"long " * 400_000
    assert got[1007].record_type == "revisit" and got[1007].refers_to == 1000


def test_bundles_are_plain_zstandard(spark, scratch):
    folder = scratch("archives")
    warc.write_archives(_df(spark, _rows()[:50]), folder, frame_bytes=2000)
    path = glob.glob(f"{folder}/bundles/*.warc.zst")[0]
    data = open(path, "rb").read()
    reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
    text = reader.read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response") and text.endswith(b"\r\n\r\n")
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    assert magic == 0x8F92EAB1 and flags == 0x80 and n > 1
    sizes = [struct.unpack("<II", data[-9 - 12 * (n - k) :][:8]) for k in range(n)]
    assert sum(raw for _, raw in sizes) == len(text)
    assert sum(packed for packed, _ in sizes) + 8 + 12 * n + 9 == len(data)


def test_bundles_outside_the_index_are_not_read(spark, scratch):
    """What a lost attempt has left behind."""
    rows, folder = _rows()[:40], scratch("archives")
    warc.write_archives(_df(spark, rows), folder)
    with open(f"{folder}/bundles/lost.warc.zst", "wb") as lost:
        lost.write(b"half a bundle")
    assert warc.read_archives(spark, folder).count() == 40


def test_damage_is_seen(tmp_path):
    path = str(tmp_path / "x.warc.zst")
    with open(path, "wb") as out:
        writer = warc.BundleWriter(out)
        record = warc.make_record(1, "u", b"payload" * 30, hashlib.sha256(b"payload" * 30).hexdigest(), None, "d")
        writer.add(record)
        writer.add(record.replace(b"payload", b"pAyload"))
        writer.finish()
    with pa.OSFile(path) as source:
        reader = warc.BundleReader(source)
        assert warc.parse_record(reader.read(0), 0)[0][5] == 210
        with pytest.raises(ValueError, match="damaged"):
            warc.parse_record(reader.read(1), 0)
        reader.frames[0] = reader.frames[0]._replace(checksum=1)
        with pytest.raises(ValueError, match="frame 0"):
            reader.read(0)
    os.truncate(path, os.path.getsize(path) - 1)
    with pa.OSFile(path) as source, pytest.raises(ValueError):
        warc.BundleReader(source)


def test_empty_table_and_query(spark, scratch):
    folder = scratch("archives")
    warc.write_archives(_df(spark, []), folder)
    assert warc.read_archives(spark, folder).count() == 0
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = op13_warc(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, _wanted(rows)))
