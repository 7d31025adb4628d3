"""Stores, calendars, decoders, texts, streams and listings on small inputs."""

import datetime
import struct
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barloom.deploy import work_folder
from barloom.functions import codes, tables, values
from barloom.operators import blocks, indicators, intraday, screen, textsections
from barloom.plans import fixtures, registry
from barloom.schemas import BARS
from barloom.sources import bars, barstore, store, wire
from barloom.streaming import bars as streaming

DAY = datetime.datetime(2024, 1, 1)


def bar_rows(spark, rows):
    return spark.createDataFrame([(c, 9, DAY + datetime.timedelta(days=d), float(x), float(x), float(x), float(x), 1.0, float(x)) for c, d, x in rows], BARS)


def rows_of(df):
    return sorted((r.code, r.ts.day, r.close) for r in df.collect())


def test_bar_store(spark):
    s = barstore.BarStore(spark, work_folder(spark, "bars"))
    assert s.read().count() == 0 and s.scan("a", 9).count() == 0 and s.versions() == [] and s.latest((9,)).count() == 0 and s.span() == (None, None)
    assert s.save(bar_rows(spark, [("a", 0, 1), ("a", 1, 2), ("b", 0, 3)])) == 1
    assert s.save(bar_rows(spark, [("a", 1, 5), ("a", 2, 6), ("c", 0, 7), ("c", 0, 8)]), order=F.col("close")) == 2
    assert s.save(bar_rows(spark, [("a", 1, 5)]).limit(0)) == 2
    assert rows_of(s.read()) == [("a", 1, 1), ("a", 2, 5), ("a", 3, 6), ("b", 1, 3), ("c", 1, 8)]
    assert [r.close for r in s.scan("a", 9).orderBy("ts").collect()] == [1, 5, 6]
    plan = barstore.refresh_plan(s, spark.createDataFrame([("a",), ("z",)], "code string"), F.lit("2024-01-03 10:00:00").cast("timestamp"))
    assert {r.code: r.action for r in plan.collect()} == {"a": "today", "z": "all"}


def test_readers_see_whole_versions(spark, monkeypatch):
    s = barstore.BarStore(spark, work_folder(spark, "bars"), buckets=2)
    s.save(bar_rows(spark, [(c, d, 1) for c in "abcdef" for d in range(3)]))
    before, rows = s.read(), rows_of(s.read())
    seen = []
    publish = s._publish
    monkeypatch.setattr(s, "_publish", lambda *x: (seen.append(rows_of(barstore.BarStore(spark, s.path).read())), publish(*x)))
    s.save(bar_rows(spark, [(c, d, 2) for c in "abcdef" for d in range(3)]))
    assert seen == [rows] and rows_of(before) == rows and rows_of(barstore.BarStore(spark, s.path, version=1).read()) == rows
    assert {x for _, _, x in rows_of(s.read())} == {2} and s.versions() == [1, 2]
    # A save that ends before its rename changes nothing.
    monkeypatch.setattr(s, "_publish", lambda *x: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        s.save(bar_rows(spark, [("a", 0, 3)]))
    assert {x for _, _, x in rows_of(s.read())} == {2} and s.versions() == [1, 2]
    monkeypatch.setattr(s, "_publish", publish)
    other = barstore.BarStore(spark, s.path)
    monkeypatch.setattr(other, "current", lambda: 1)
    with pytest.raises(barstore.Conflict):
        other.save(bar_rows(spark, [("a", 0, 4)]))
    gone = s.vacuum()
    assert "versions/000000000001" in gone and len([x for x in gone if x.startswith("data/")]) == 3
    assert {x for _, _, x in rows_of(s.read())} == {2} and s.versions() == [2]
    with pytest.raises(ValueError):
        barstore.BarStore(spark, s.path, version=2).save(bar_rows(spark, [("a", 0, 3)]))


def test_scans_read_matching_files_alone(spark):
    s = barstore.BarStore(spark, work_folder(spark, "bars"), buckets=2, file_rows=10)
    s.save(bar_rows(spark, [(c, d, d) for c in "abcdefgh" for d in range(60)]))
    files = s.manifest().collect()
    assert sum(r.rows for r in files) == 480 and len(files) >= 48 and max(r.rows for r in files) <= 10
    found = s.scan("c", 9, "2024-01-20", "2024-01-24")
    assert [r.close for r in found.orderBy("ts").collect()] == [19, 20, 21, 22, 23]
    read = found.select(F.input_file_name()).distinct().count()
    held = {r.file for r in files if r.min_code <= "c" <= r.max_code and r.min_ts <= DAY + datetime.timedelta(days=23) and r.max_ts >= DAY + datetime.timedelta(days=19)}
    assert len(found.inputFiles()) == len(held) <= 3 and read <= len(held)
    assert all(any(f.endswith(h) for h in held) for f in found.inputFiles())
    assert len(s.between(DAY + datetime.timedelta(days=55), None).inputFiles()) < len(files) / 3


def test_newest_first_stops_early(spark):
    s = barstore.BarStore(spark, work_folder(spark, "bars"), buckets=2, file_rows=10)
    s.save(bar_rows(spark, [(c, d, d) for c in "abc" for d in range(300)]))
    spans = barstore.slices(*s.span(), days=10)
    assert spans[-1][0] == DAY and all(a[0] == b[1] for a, b in zip(spans, spans[1:])) and len(spans) < 7
    asked = []

    def read(first, end):
        asked.append(s.between(first, end))
        return asked[-1]

    wanted = spark.createDataFrame([("a", 295.0), ("b", 285.0), ("zz", 1.0)], "code string, bound double")
    got = barstore.until_newest_first(read, spans, wanted.where("code <> 'zz'"), F.col("close") < F.col("bound"))
    assert sorted((r.code, r.close) for r in got.collect()) == [("a", float(x)) for x in range(294, 300)] + [("b", float(x)) for x in range(284, 300)]
    assert len(asked) == 2 and sum(x.count() for x in asked) == 90
    asked.clear()
    assert barstore.until_newest_first(read, spans, wanted.where("code = 'zz'"), F.lit(True)).count() == 0 and len(asked) == len(spans)


def test_each_class_of_a_refresh_reads_its_slice(spark, monkeypatch):
    kept, source = (barstore.BarStore(spark, work_folder(spark, "bars"), buckets=2, file_rows=10) for _ in range(2))
    source.save(bar_rows(spark, [(c, d, d + 1000) for c in "abcd" for d in range(300)]))
    days = {"b": 300, "c": 290, "d": 300}
    kept.save(bar_rows(spark, [(c, d, d) for c, n in days.items() for d in range(n)]))
    last = DAY + datetime.timedelta(days=299)  # a Saturday
    assert last.weekday() == 5
    reads = []
    between = source.between
    monkeypatch.setattr(source, "between", lambda *x: reads.append((x[0], between(*x).count())) or between(*x))
    now = F.lit(str(last + datetime.timedelta(hours=16))).cast("timestamp")

    def plan_of(codes, at=now):
        reads.clear()
        found = {r.code: r.action for r in barstore.refresh(kept, source, spark.createDataFrame([(x,) for x in codes], "code string"), at).collect()}
        return found, [n for _, n in reads]

    assert plan_of("bd") == ({"b": "stored", "d": "stored"}, [])
    friday = F.lit(str(last + datetime.timedelta(days=-1, hours=10))).cast("timestamp")
    assert plan_of("c", friday) == ({"c": "since"}, [4 * 32])
    assert plan_of("a") == ({"a": "all"}, [1200])
    got = {c: [r.close for r in kept.scan(c, 9).orderBy("ts").collect()] for c in "abcd"}
    assert got == {"a": [d + 1000 for d in range(300)], "b": list(range(300)), "c": [*range(288), *range(1288, 1300)], "d": list(range(300))}
    kept.save(bar_rows(spark, [("e", 299, 1)]))
    source.save(bar_rows(spark, [("e", d, 7) for d in range(290, 300)]))
    monkeypatch.setattr(barstore, "refresh_action", lambda latest, at: F.lit("today"))
    assert plan_of("e") == ({"e": "today"}, [4 * 32 + 10])
    assert [r.close for r in kept.scan("e", 9).collect()] == [7]


def test_pages_and_stops(spark):
    rows = bar_rows(spark, [("a", d, d) for d in range(10)] + [("b", d, 1) for d in range(3)])
    assert sorted((r.code, r.close) for r in bars.page(rows, 2, 3).collect()) == [("a", 5), ("a", 6), ("a", 7), ("b", 1)]
    assert sorted((r.code, r.close) for r in bars.until(rows, F.col("close") == 7).collect()) == [("a", 7), ("a", 8), ("a", 9), ("b", 1), ("b", 1), ("b", 1)]


def test_calendar(spark):
    days = spark.createDataFrame([(datetime.date(2023, 12, 29),), (datetime.date(2024, 1, 2),), (datetime.date(2024, 1, 3),)], "date date")
    dates = spark.createDataFrame([(datetime.date(2023, 12, 29),), (datetime.date(2024, 1, 1),), (datetime.date(2024, 1, 3),)], "date date")
    got = {r.date.isoformat(): r.next and r.next.isoformat() for r in store.next_days(days, dates).collect()}
    assert got == {"2023-12-29": "2024-01-02", "2024-01-01": "2024-01-02", "2024-01-03": None}


@pytest.mark.parametrize(("now", "day"), [("2024-01-05 15:00", "2024-01-05"), ("2024-01-05 14:59", "2024-01-04"), ("2024-01-06 16:00", "2024-01-05"), ("2024-01-07 09:00", "2024-01-05"), ("2024-01-08 09:00", "2024-01-05")])
def test_last_day(spark, now, day):
    assert spark.range(1).select(values.last_complete_day(F.lit(now).cast("timestamp")).cast("string")).first()[0] == day


def test_cache(spark):
    empty = spark.createDataFrame([], "bucket string, key string, value string, created_at long, expires_at long")
    entries = spark.createDataFrame([("codes", "k", "v"), ("other", "k", "w")], "bucket string, key string, value string")
    cache = store.put_entries(empty, entries, F.lit(1000)).cache()
    assert {(r.bucket, r.expires_at) for r in cache.collect()} == {("codes", 87400), ("other", 0)}
    assert [r.bucket for r in store.valid_entries(cache, F.lit(87400)).collect()] == ["other"]
    assert store.without_expired(cache, F.lit(0), "codes").count() == 1 and store.without_expired(cache, F.lit(0), "codes", "x").count() == 2
    assert spark.range(1).select(store.cache_file(F.lit("abc"))).first()[0] == "ba7816bf8f01cfea414140de5dae2223"


def test_varints():
    assert [wire.signed_varint(bytes.fromhex(x), 0) for x in ("05", "45", "8101", "c101", "80")] == [(5, 1), (-5, 1), (65, 2), (-65, 2), (0, 1)]
    for n in (0, 1, -1, 63, 64, -64, 8191, 8192, 123456789, -987654321):
        data = b"x" + wire.encode_varint(n)
        assert wire.signed_varint(data, 1) == (n, len(data))


def test_volumes(spark):
    rows = spark.createDataFrame([(0x4A000000,), (0x4A800000,), (0x4AC01234,), (0x3F7F00FF,)], "v long")
    got = [tuple(r) for r in rows.select(wire.volume(F.col("v")), wire.volume(F.col("v"), 128)).collect()]

    def plain(v, unit):
        a, b, c, d = v.to_bytes(4, "big")
        base, fine = 2.0 ** (a * 2 - 0x7F), 2.0 if b & 0x80 else 1.0
        mid = base * (64 + (b & 0x7F) * 64 / unit) / 64 if b > 0x80 else base * b / 128
        return base + mid + base * c / 32768 * fine + base * d / 8388608 * fine

    assert got == [(plain(v, 64), plain(v, 128)) for v in (0x4A000000, 0x4A800000, 0x4AC01234, 0x3F7F00FF)]


def frame_of(body, packed=True, msg=1):
    data = zlib.compress(body) if packed else body
    return wire.RESPONSE_PREFIX + struct.pack("<BIBHHH", 12, msg, 0, 0x52D, len(data), len(body)) + data


def test_frames_and_bars(spark):
    body = struct.pack("<H", 2)
    for when, deltas in ((20240102, (10000, 500, 700, -200)), (20240103, (-100, 50, 60, -10))):
        body += struct.pack("<I", when) + b"".join(map(wire.encode_varint, deltas)) + struct.pack("<II", 0x4A000000, 0x4B000000)
    body += bytes(100)
    capture = b"noise" + frame_of(body) + b"\x00" + frame_of(b"plain", False, 7) + frame_of(body)[:-3]
    rows = spark.createDataFrame([("600000", 9, capture), ("x", 9, None), ("y", 9, b"")], "code string, ktype int, data binary")
    found = wire.frames(rows).cache()
    assert [(r.code, r.seq, r.msg_id, bytes(r.body)) for r in found.orderBy("seq").collect()] == [("600000", 0, 1, body), ("600000", 1, 7, b"plain")]
    got = wire.bars(wire.raw_bars(found.where("seq = 0").select("code", "ktype", "body"))).orderBy("ts").collect()
    assert [(str(r.ts), round(r.open, 3), round(r.high, 3), round(r.low, 3), round(r.close, 3)) for r in got] == [("2024-01-02 15:00:00", 10.0, 10.7, 9.8, 10.5), ("2024-01-03 15:00:00", 10.4, 10.46, 10.39, 10.45)]


def test_ticks(spark):
    body = struct.pack("<H", 2) + b"\0" * 4 + b"".join(bytes(m) + b"".join(map(wire.encode_varint, v)) + b"\0" * 8 * (m[1] == 0x31) for m, v in (((0x09, 0x30), (1000, 5000000, 1)), ((0x09, 0x31), (-3, 7, 0))))
    rows = wire.raw_ticks(spark.createDataFrame([("1", body)], "code string, body binary"))
    assert [(r.minute, r.value, r.volume) for r in intraday.undelta(rows, "price_delta", 100.0).orderBy("seq").collect()] == [(570, 10.0, 5000000), (571, 9.97, 7)]


def test_other_responses(spark):
    v = lambda *x: b"".join(map(wire.encode_varint, x))
    quote = b"\0\0" + struct.pack("<H", 1) + b"\x01600000\0\0" + v(1050, -50, -10, 20, -30, 0, 0, 1234, 0) + struct.pack("<I", 0x4A000000) + v(11, 22, 0, 0) + v(-1, 1, 5, 6) * 5 + b"\0\0" + v(0, 0, 0, 0) + b"\0" * 4
    got = wire.quotes(wire.raw_quotes(spark.createDataFrame([(quote,), (b"",), (None,)], "body binary"))).collect()
    assert len(got) == 1 and (got[0].code, got[0].price, got[0].last_close, got[0].open, got[0].high, got[0].low, got[0].volume, got[0].s_vol, got[0].b_vol) == ("600000", 10.5, 10.0, 10.4, 10.7, 10.2, 1234, 11, 22)
    assert [tuple(x) for x in got[0].bid_ask] == [(10.49, 10.51, 5, 6)] * 5
    line = struct.pack("<H", 2) + b"\0\0\0\x50" + v(1000, 0, 7, -5, 0, -8)
    rows = wire.minutes(wire.raw_minutes(spark.createDataFrame([("1", line)], "code string, body binary"))).orderBy("seq").collect()
    assert [(r.time, r.price, r.number) for r in rows] == [("09:31", 10.0, 7), ("09:32", 9.95, -8)]
    index = struct.pack("<H", 1) + struct.pack("<I", 20240102) + v(3000000, 1000, 2000, -500) + struct.pack("<IIHH", 0x4A000000, 0x4B000000, 700, 300)
    bar = wire.bars(wire.raw_bars(spark.createDataFrame([("999999", 9, index)], "code string, ktype int, body binary"), breadth=True)).first()
    assert (bar.open, bar.close, bar.up_count, bar.down_count) == (3000.0, 3001.0, 700, 300)
    assert intraday.breadth(spark.createDataFrame([("x", DAY, 3, 1), ("x", DAY, 0, 0)], "code string, ts timestamp, up_count int, down_count int")).select("breadth").collect() == [(0.75,), (None,)]
    codes_ = struct.pack("<H", 2) + b"600000\0\0" + "浦发银行".encode("gbk") + b"\0" * 13 + b"short"
    assert [(bytes(r.code), bytes(r.name).decode("gbk")) for r in wire.records(spark.createDataFrame([(codes_,)], "body binary"), "securities").collect()] == [(b"600000", "浦发银行")]
    call = struct.pack("<H", 1) + struct.pack("<HfIh3xB", 565, 10.5, 1000, -300, 7)
    assert tuple(wire.records(spark.createDataFrame([(call,)], "body binary"), "auctions").first()) == (565, 10.5, 1000, -300, 7)
    money = bytes(9) + struct.pack(wire.FINANCE_FORM, 1.5, 1, 2, 20240101, 19991110, *range(30))
    found = wire.finance(spark.createDataFrame([(money,), (b"x",)], "body binary")).collect()
    assert len(found) == 1 and (found[0].float_shares, found[0].ipo, found[0].total_shares, found[0].reserved) == (1.5, 19991110, 0.0, 29.0)
    acts = bytes(9) + struct.pack("<H", 2) + struct.pack("<8xIB4f", 20240301, 1, 2.5, 0.0, -3.0, 0.125) + struct.pack("<8xIB4I", 20240302, 5, 0x4A000000, 0, 0x4A800000, 0)
    got = wire.corp_actions(wire.records(spark.createDataFrame([("1", acts)], "code string, body binary"), "corp_actions")).orderBy("date").collect()
    assert (str(got[0].date), got[0].a, got[0].b, got[0].c, got[0].d) == ("2024-03-01", 2.5, 0.0, -3.0, 0.125) and (got[1].category, got[1].a) == (5, 2.0**21)
    toc = struct.pack("<H", 1) + struct.pack("<64s80sII", "公司概况".encode("gbk"), b"1.txt", 3, 4)
    entries = wire.records(spark.createDataFrame([("1", toc)], "code string, body binary"), "company_toc").withColumns({"name": wire.text_of(F.col("name")), "filename": wire.text_of(F.col("filename"))})
    files = spark.createDataFrame([("1", "1.txt", b"0123456789")], "code string, filename string, content binary")
    assert bytes(textsections.from_toc(entries, files, "公司概况").first().part) == b"3456"


def test_block_files(spark, tmp_path):
    def record(name, kind, members):
        body = b"".join(c.encode().ljust(7, b"\0") for c in members)
        return (b"\0\0" + name.encode("gbk").ljust(9, b"\0") + struct.pack("<HH", len(members), kind) + body).ljust(2813, b"\0")

    (tmp_path / "block.dat").write_bytes(b"\0" * 384 + record("银行", 2, ["600000", "000001"]) + record("", 1, ["1"]) + record("123", 3, ["300003"]))
    got = wire.read_block_files(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.block_name, r.block_type, r.stock_code, r.seq) for r in got] == [("银行", 2, "600000", 0), ("银行", 2, "000001", 1), ("123", 3, "300003", 2)]
    members = wire.read_block_files(spark, str(tmp_path))
    names = spark.createDataFrame([("600000", "浦发银行")], "code string, name string")
    shown = {(r.code, r.name, r.exchange) for r in blocks.show(members, "银行", names).collect()}
    assert shown == {("600000", "浦发银行", "上交所"), ("000001", "未知", "深交所")}
    assert blocks.block_list(members).count() == 1


def test_whole_blocks_are_filed(spark, tmp_path):
    rows = [(k, f"Brand#{11 + k % 2}", "PROMO TIN" if k % 3 else "STANDARD POLISHED TIN", 1 + k % 3) for k in range(2000)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in registry.queries()["block_file_decode"](spark, str(tmp_path)).collect())
    kinds, want = {}, []
    for k, *names, size in rows:
        for name in (*names, str(size)):
            if len(name) <= 9:
                want.append((name, kinds.setdefault(name, size % 4), f"{k * 48271 % 1000000:06d}"))
    assert got == sorted(want) and max(Counter(n for n, *_ in got).values()) > 2 * 399


def test_all_years_are_streamed(spark, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(60)
    moved = orders.withColumn("o_orderdate", F.when(F.col("o_orderkey") % 2 == 0, F.add_months("o_orderdate", 240)).otherwise(F.col("o_orderdate")).cast(orders.schema["o_orderdate"].dataType))
    moved.write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.queries()["stream_indicators"](spark, str(tmp_path)).select("code", "ts").collect()
    want = fixtures.bars_d(spark, str(tmp_path)).select("code", "ts").collect()
    assert sorted(got) == sorted(want) and max(r.ts.year for r in want) > 2005


def test_packed_times(spark):
    rows = spark.createDataFrame([((20 << 11) + 3 * 100 + 14, 571)], "d int, m int")
    assert str(rows.select(values.packed_minute(F.col("d"), F.col("m"))).first()[0]) == "2024-03-14 09:31:00"
    assert [r[0] for r in spark.createDataFrame([(0,), (119,), (120,), (239,)], "s int").select(values.slot_clock(F.col("s"))).collect()] == ["09:31", "11:30", "13:01", "15:00"]


def test_gbk(spark):
    rows = spark.createDataFrame([("浦发\0银行".encode("gbk"),), (None,)], "b binary")
    assert [r.t for r in rows.select(wire.text_of(F.col("b")).alias("t")).collect()] == ["浦发银行", None]


def test_jsonp_and_ranges(spark):
    rows = spark.createDataFrame([('cb([{"a": 1}, {"a": 2}]);', b"0123456789")], "t string, c binary")
    got = wire.jsonp(rows, "t", "array<struct<a:int>>").select("parsed.a", wire.byte_range(F.col("c"), F.lit(2), F.lit(3)).alias("x")).first()
    assert got.a == [1, 2] and bytes(got.x) == b"234"


def test_sections(spark):
    text = "【概况】\r\n first line\nsecond line\n┌──┬──┐\n│ a │ b │\n├──┼──┤\n│ c │ d │\n└──┴──┘\nafter\n\nhttps://example.org/x\n────\n★ star\n│ x │\n\n│ y │"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "only")], "doc_id long, text string")
    got = {}
    for r in textsections.sections(rows).orderBy("seq").collect():
        got.setdefault(r.doc_id, []).append((r.type, r.content, r.text))
    assert got == {
        1: [
            ("header", [], "【概况】"), ("paragraph", [], "first line\nsecond line"), ("table", [["a", "b"], ["c", "d"]], ""), ("paragraph", [], "after"), ("link", [], "https://example.org/x"),
            ("paragraph", [], "★ star"), ("table", [["x"]], ""), ("table", [["y"]], ""),
        ],
        None: [("paragraph", [], "only")],
    }
    pages = {r.html for r in textsections.html(textsections.sections(spark.createDataFrame([(1, "a < b\nc")], "doc_id long, text string"))).collect()}
    assert pages == {"<p>a &lt; b<br>c</p>"}


def test_code_files(spark, tmp_path):
    (tmp_path / "codes.txt").write_text("# list\n\n 600000 \n000001\n")
    assert [r.code for r in bars.read_codes(spark, str(tmp_path / "codes.txt")).collect()] == ["600000", "000001"]


def test_codes(spark):
    rows = spark.createDataFrame([(x,) for x in ("600000", "300001", "510050", "159915", "830799", "920001", "430001", "399001", "900901", "sh600000", "12", "700000", "SZ000001")], "c string")
    got = [tuple(r) for r in rows.select(codes.add_prefix(F.col("c")), codes.decoded(F.col("c"))[0], codes.security_class(F.col("c")), codes.is_stock(F.col("c"))).collect()]
    assert got[:3] == [("sh600000", "sh", "沪市A股", True), ("sz300001", "sz", "创业板", True), ("sh510050", "sh", "ETF", False)]
    assert [x[0] for x in got[3:9]] == ["sz159915", "bj830799", "bj920001", "bj430001", "sz399001", "sh900901"] and got[9][1] == "sh" and got[10][1] is None and got[11] == ("700000", None, "其他", False) and got[12][1] == "sz"


def test_streamed_upserts(spark):
    source, s = work_folder(spark, "in"), barstore.BarStore(spark, work_folder(spark, "bars"))
    bar_rows(spark, [("a", 0, 1), ("a", 1, 2)]).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(BARS).parquet(source)
    check = work_folder(spark, "check")
    streaming.upsert_into(stream, s, check).awaitTermination()
    bar_rows(spark, [("a", 1, 9), ("b", 0, 4)]).coalesce(1).write.mode("append").parquet(source)
    streaming.upsert_into(stream, s, check).awaitTermination()
    assert sorted((r.code, r.close) for r in s.read().collect()) == [("a", 1), ("a", 9), ("b", 4)]


def run_to_the_end(made, out, check):
    made.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()


def test_streamed_indicators_go_on_after_a_restart(spark):
    rows = bar_rows(spark, [(c, d, 5 + (d * k) % 13) for k, c in enumerate("abc", 2) for d in range(80)])
    source, out, check = (work_folder(spark, n) for n in ("in", "out", "check"))
    for first, end in ((0, 30), (30, 31), (31, 80)):
        rows.where((F.col("ts") >= DAY + datetime.timedelta(days=first)) & (F.col("ts") < DAY + datetime.timedelta(days=end))).repartition(3).write.mode("append").parquet(source)
        run_to_the_end(streaming.indicators(spark.readStream.schema(BARS).parquet(source)), out, check)  # a new query each time
    rows.where("ts < '2024-01-05'").write.mode("append").parquet(source)  # late, so left out
    run_to_the_end(streaming.indicators(spark.readStream.schema(BARS).parquet(source)), out, check)
    names = ["dif", "dea", "k", "d", "j", "rsi_6", "rsi_24"]
    got = {(r.code, r.ts): [r[n] for n in names] for r in spark.read.parquet(out).collect()}
    want = {(r.code, r.ts): [r[n] for n in names] for r in indicators.indicators(rows).collect()}
    assert got == want and len(got) == 240
    at = {r.key.code: (r.value.bars, r.value.ts) for r in streaming.held_state(spark, check, "at").collect()}
    assert at == {c: (80, DAY + datetime.timedelta(days=79)) for c in "abc"}
    assert streaming.held_state(spark, check, "recent").count() == 3 * 8


def test_runs_of_states_and_what_comes_late(spark):
    """A run ends at a gap; a signal later than the watermark allows is left out, one within it joins its run."""
    source, out, check = (work_folder(spark, n) for n in ("in", "out", "check"))
    schema = "code string, ktype int, ts timestamp, type string, indicator string"
    days = [[0, 1, 2, 5], [3, 20, 21], [9, 12, 60]]  # 3 is late but within seven days; 9 is not, 12 is not either
    for batch in days:
        spark.createDataFrame([("a", 9, DAY + datetime.timedelta(days=d), "x", "y") for d in batch], schema).coalesce(1).write.mode("append").parquet(source)
        run_to_the_end(streaming.state_runs(spark.readStream.schema(schema).parquet(source), "1 day 1 second"), out, check)
    got = sorted(((r.first - DAY).days, (r.last - DAY).days, r.bars) for r in spark.read.parquet(out).collect())
    assert got == [(0, 3, 4), (5, 5, 1), (20, 21, 2)]


def test_sliding_windows(spark):
    source, out, check = (work_folder(spark, n) for n in ("in", "out", "check"))
    schema = "code string, ts timestamp, price double, volume long"
    at = lambda m: DAY + datetime.timedelta(minutes=m)
    for batch in ([(0, 1.0), (7, 3.0), (12, 5.0)], [(9, 7.0), (100, 1.0)], [(10, 9.0), (300, 1.0)]):  # 9 comes in time, 10 doesn't
        spark.createDataFrame([("a", at(m), p, 2) for m, p in batch], schema).coalesce(1).write.mode("append").parquet(source)
        run_to_the_end(streaming.sliding(spark.readStream.schema(schema).parquet(source), "10 minutes", "5 minutes"), out, check)
    got = {int((r.start - DAY).total_seconds() // 60): (r.volume, r.price) for r in spark.read.parquet(out).collect()}
    assert got == {-5: (2, 1), 0: (6, 11 / 3), 5: (6, 5), 10: (2, 5), 95: (2, 1), 100: (2, 1)}


def test_sections_of_one_text_are_those_of_many(spark):
    texts = [None, "", "a\nb\n\nc", "【H】\nx\nhttps://a.b/c\ny", "┌─┐\n│ a │ b │\n├─┤\n│c│d│\n└─┘\n│e│f│\n\n│g│h│", "text\n│a│b│\nmore\n──────\nend", "│\n  │ x │ \n\r\n ─ \nz", "A 【no】\n【yes】 \n　 indented　\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((r.doc_id, r.seq, r.type, str(r.content), r.text) for r in textsections.sections(docs).collect())
    got = sorted((i, seq, kind, str(content), text) for i, t in enumerate(texts) for seq, kind, content, text in textsections.of_text(t))
    assert got == want


def test_table_functions(spark, monkeypatch):
    tables.register(spark)
    rows = bar_rows(spark, [(c, d, 5 + (d * k) % 13) for k, c in enumerate("abc", 2) for d in range(30 * k)] + [("z", 0, 1)])
    rows.createOrReplaceTempView("some_bars")
    names = ["dif", "dea", "hist", "k", "d", "j", "rsi_6", "rsi_24"]
    found = spark.sql("SELECT * FROM indicator_lines(TABLE(some_bars) PARTITION BY code ORDER BY ts)")
    want = {(r.code, r.ts): [r[n] for n in names] for r in indicators.indicators(rows).collect()}
    assert {(r.code, r.ts): [r[n] for n in names] for r in found.collect()} == want and len(want) == 271
    for bad in ("SELECT * FROM indicator_lines(TABLE(SELECT code FROM some_bars))", "SELECT * FROM text_sections(5)"):
        with pytest.raises(Exception, match="needs"):
            spark.sql(bad).collect()
    # In parts, a series is the same.
    monkeypatch.setattr(tables, "PART_ROWS", 7)
    parts, own = tables.IndicatorLines(), rows.where("code = 'b'").orderBy("ts").collect()
    made = [x for r in own for x in parts.eval(r) or ()] + list(parts.terminate())
    at = rows.columns + parts.shown()
    assert [[x[at.index(n)] for n in names] for x in made[40:]] == [want["b", r.ts] for r in own][40:]


def test_days_numbers_and_lines(spark):
    days = spark.createDataFrame([("20240229",), ("2024-03-01",), ("20240230",), ("2024/03/01",), ("",), (None,)], "t string")
    assert [str(r.d) for r in days.select(values.parse_day(F.col("t")).alias("d")).collect()] == ["2024-02-29", "2024-03-01", "None", "None", "None", "None"]
    data = spark.createDataFrame([(b"\x01\x02\xff\x80",), (b"\x01",), (None,)], "b binary")
    got = [tuple(r) for r in data.select(values.uint_le(F.col("b"), 0, 4), values.uint_le(F.col("b"), 2, 2), values.uint_le(F.col("b"), 0, 1)).collect()]
    assert got == [(0x80FF0201, 0x80FF, 1), (None, None, 1), (None, None, None)]
    rows = spark.createDataFrame([("a", 1.005, None), ("long name", -2.5, "x")], "n string, v double, s string")
    lines = [r.line for r in screen.text_lines(rows, {"n": "%-4s", "v": "%8.2f", "s": "%3s"}).collect()]
    assert lines == ["a        1.00   -", "long name    -2.50   x"]


def test_kinds_expire_by_themselves(spark):
    now = F.lit(1_700_000_000)
    cache = spark.createDataFrame([], "bucket string, key string, value string, created_at long, expires_at long")
    for kind in store.TTL_DAYS:
        cache = store.put_entries(cache, spark.createDataFrame([(kind, "k", '{"a": 1}')], "bucket string, key string, value string"), now)
    for days, left in ((0, 5), (1, 3), (6, 3), (7, 1), (29, 1), (30, 0)):
        assert sum(store.typed_entries(cache, kind, "a int", now + days * 86400).count() for kind in store.TTL_DAYS) == left
    dates = spark.createDataFrame([(datetime.date(y, m, 1),) for y in (2022, 2023, 2024) for m in (1, 5)], "date date")
    assert [(r.date.isoformat(), r.nth) for r in store.newest_first(dates).orderBy("nth").collect()] == [(f"{y}-{m:02}-01", i) for i, (y, m) in enumerate(((2024, 5), (2024, 1), (2023, 5), (2023, 1), (2022, 5), (2022, 1)), 1)]
