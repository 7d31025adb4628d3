"""Archives: round trips, dictionaries, damage, and equal payloads against a plain restatement."""

import base64
import hashlib
import struct
from collections import defaultdict

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from barloom.llm import oracles, warc
from barloom.llm.common import shared_folder

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"
LONG = "<p>long, équal</p>" * 80
ODD = [
    (1, "http://a/1", None), (2, None, ""), (3, "http://a/3\r\nX-Bad: yes", LONG), (9, "http://a/é b", LONG), (4, "http://a/4", LONG), (9, "http://a/é b", LONG), (None, None, LONG), (5, "u", "short"), (6, "u", "short"),
    (-7, "v", "x" * 999 + "é"), (-8, "v", "x" * 999 + "é"), (None, "w", "y" * 2000), (None, "w", "y" * 2000), (10, "z", "WARC/1.1\r\n\r\n" * 100_000), (11, "z", "z" * 999), (12, "z", "z" * 999),
]


def plain(rows, least=1000):
    groups, out = defaultdict(list), []
    for page_id, _, html in rows:
        groups[html or ""].append(page_id)
    for page_id, _, html in rows:
        body = (html or "").encode()
        best = max((x for x in groups[html or ""] if x is not None), default=None)
        revisit = len(body) >= least and best is not None and page_id != best
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def columns(records):
    return records.where("record_type != 'warcinfo'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).withColumns({c: F.lit(f"extra {c}") for c in ("name", "winner", "rows", "row", "salt", "archive", "payload")})


def test_sample_pages_give_what_sql_gives(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    rows = con.execute(oracles.ARCHIVED)
    names = [x[0] for x in rows.description]
    df = warc.op11_zstd_warc(spark, SF)
    assert df.columns == names == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(df) == sorted(rows.fetchall(), key=str) == plain(pages)


def test_odd_tables(spark, odd):
    assert got(columns(warc.read(warc.write(odd, shared_folder(spark, "w"))))) == plain(ODD)
    none = warc.write(odd.limit(0), shared_folder(spark, "w"))
    assert none.count() == 0 and warc.read(none).count() == 0


def test_large_groups_meet_under_salts(spark, odd, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    rows = [(i, f"u{i}", LONG if i % 3 else f"{i} " * 400) for i in range(300)]
    pages = spark.createDataFrame(rows, SCHEMA)
    assert got(columns(warc.read(warc.write(pages, shared_folder(spark, "w"))))) == plain(rows)
    assert got(columns(warc.read(warc.write(odd, shared_folder(spark, "w"))))) == plain(ODD)


def test_payloads_come_back_whole(spark, odd):
    records = warc.read(warc.write(odd, shared_folder(spark, "w"), warc.Params(archive_bytes=20_000, sample_rows=2)), payloads=True)
    assert records.select("archive").distinct().count() > 1
    back = [(r.page_id, bytes(r.payload).decode()) for r in warc.resolved(records).collect()]
    assert sorted(back, key=str) == sorted(((i, h or "") for i, _, h in ODD), key=str)
    ids = {r.record_id: r for r in records.collect()}
    for r in ids.values():
        if r.record_type == "revisit":
            assert ids[r.refers_to_id].record_type == "response" and ids[r.refers_to_id].page_id == r.refers_to
        if r.page_id == 3:
            assert r.target_uri == "http://a/3%0D%0AX-Bad:%20yes"


def test_archives_lead_with_a_dictionary_and_have_a_frame_a_record(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").coalesce(1)
    archive = warc.write(pages, shared_folder(spark, "w")).collect()
    assert [r.records for r in archive] == [250]
    data = open(archive[0].archive.removeprefix("file://"), "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and len(data) == archive[0].bytes
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    assert dictionary.dict_id() != 0
    bodies, at = [], 8 + size
    while at < len(data):
        out = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        bodies.append(out.decompress(data[at:]))
        assert zstandard.get_frame_parameters(data[at : at + 32]).dict_id == dictionary.dict_id()
        at = len(data) - len(out.unused_data)
    assert len(bodies) == 251 and all(b.startswith(b"WARC/1.1\r\n") and b.endswith(b"\r\n\r\n") for b in bodies)
    plain_size = sum(len(zstandard.compress(b, 3)) for b in bodies)
    assert len(data) < plain_size


RECORD = warc.page_record(5, "http://a", b"<p>payload</p>", "2020-01-01T00:00:00Z", None, None)


def archive_of(tmp_path, *frames):
    path = tmp_path / "x.warc.zst"
    path.write_bytes(b"".join(frames))
    return str(path)


@pytest.mark.parametrize(
    "record, says",
    [
        (RECORD.replace(b"WARC/1.1", b"WARC/9.9"), "not a record"), (RECORD.replace(b"WARC-Date", b"WARC-Dote"), "without warc-date"), (RECORD.replace(b"<p>payload", b"<p>pailoda"), "digest"),
        (RECORD[:-4], "does not end"), (RECORD + RECORD, "does not end"), (RECORD[:-12], "of a block"), (RECORD.replace(b"WARC-Target-URI:", b"WARC Target URI "), "header's line"),
        (RECORD.replace(b"Content-Length: ", b"Content-Length: x", 1), "not a length"), (b"no record at all", "without an end"), (RECORD.replace(b"sha1:", b"md9:"), "another kind"), (b"", "without an end"),
    ],
)
def test_damaged_records_are_told(spark, tmp_path, record, says):
    good = zstandard.compress(RECORD)
    path = archive_of(tmp_path, good, zstandard.compress(record), good)
    table = spark.createDataFrame([(path,)], "archive string")
    rows = warc.read(table, strict=False).orderBy("offset").collect()
    assert [r.error is None for r in rows] == [True, False, True] and says in rows[1].error
    assert [r.payload_bytes for r in rows] == [14, None, 14]
    with pytest.raises(Exception, match="Damaged"):
        warc.read(table).collect()


def test_foreign_archives(tmp_path):
    held = zstandard.ZstdCompressionDict(b"WARC/1.1\r\nWARC-Type: response\r\n" * 20, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    coder = zstandard.ZstdCompressor(dict_data=held, write_content_size=False)
    streamed = coder.compressobj()
    frame = streamed.compress(RECORD * 1) + streamed.flush()
    raw = struct.pack("<II", 0x184D2A5D, len(held.as_bytes())) + held.as_bytes()
    other = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    path = archive_of(tmp_path, raw, frame, other, zstandard.compress(bytes(500_000)), zstandard.compress(RECORD), b"junk and more")
    found = list(warc.frames(path))
    assert [x if isinstance(x, bytes) else type(x) for _, x in found] == [RECORD, bytes(500_000), RECORD, warc.Damaged]
    cut = archive_of(tmp_path, zstandard.compress(RECORD)[:-3])
    assert [type(x) for _, x in warc.frames(cut)] == [warc.Damaged]
    flipped = bytearray(zstandard.ZstdCompressor(write_checksum=True).compress(RECORD))
    flipped[-2] ^= 1
    path = archive_of(tmp_path, bytes(flipped), zstandard.compress(RECORD))
    assert [x if isinstance(x, bytes) else type(x) for _, x in warc.frames(path)] == [warc.Damaged, RECORD]
    assert list(warc.frames(archive_of(tmp_path))) == []


def test_digests_in_base_32_and_old_versions():
    digest = hashlib.sha1(b"<p>payload</p>")
    other = RECORD.replace(digest.hexdigest().encode(), base64.b32encode(digest.digest())).replace(b"WARC/1.1", b"WARC/1.0")
    assert warc.parse(other)["payload_digest"] == digest.hexdigest() == warc.parse(RECORD)["payload_digest"]
