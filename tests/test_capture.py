"""Files of responses as a data source: ranges, resynchronising, filters, streams, writing."""

import random
import struct
import zlib

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from barloom.deploy import work_folder
from barloom.sources import capture, wire

PREFIX = wire.RESPONSE_PREFIX


def response(body, kind=7, msg=1, packed=True):
    data = zlib.compress(body) if packed else body
    return PREFIX + struct.pack("<BIBHHH", 12, msg, 0, kind, len(data), len(body)) + data


def hostile(seed, n=400):
    """Responses with noise between them, cut ones, and bodies that hold prefixes, headers and whole responses."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        body = rng.randbytes(rng.choice([0, 3, 50, 900, 20_000]))
        pick = rng.random()
        if pick < 0.25:
            body = b"".join(response(rng.randbytes(20), 9, i, False) + PREFIX + rng.randbytes(14) for _ in range(rng.randint(1, 30)))[:60_000]
        one = response(body, rng.choice([7, 8]), i, packed=len(body) > 30_000 or rng.random() < 0.4)
        out.append(one[: rng.randint(0, len(one))] if pick > 0.97 else one)
        out.append(rng.choice([b"", b"", rng.randbytes(rng.randint(0, 40)), PREFIX[:3]]))
    return b"".join(out)


def in_order(data):
    """By one reading from the start."""
    out, at = [], 0
    while (at := data.find(PREFIX, at)) >= 0 and at + 16 <= len(data):
        control, msg, _, kind, packed, size = struct.unpack_from("<BIBHHH", data, at + 4)
        body, begun = data[at + 16 : at + 16 + packed], at
        at += 16 + packed
        if len(body) < packed:
            break
        try:
            body = body if packed == size else zlib.decompress(body)
        except zlib.error:
            continue
        if len(body) == size:
            out.append((begun, control, msg, kind, body))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_any_range_finds_its_responses(tmp_path, seed):
    data = hostile(seed)
    path = tmp_path / "x"
    path.write_bytes(data)
    whole = in_order(data)
    assert len(whole) > 250
    rng = random.Random(seed)
    cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(40)), *(w[0] + d for w in rng.sample(whole, 20) for d in (0, 1, 16))})
    source = capture._Bytes(fs.LocalFileSystem(), str(path), len(data))
    for low, high in zip(cuts, cuts[1:], strict=False):
        got = list(capture.responses(source, low, high))
        ends = [w for w in whole if low < w[0] + 16 + struct.unpack_from("<H", data, w[0] + 12)[0] <= high]
        assert got == ends
    for at in cuts:
        chain, place = data.find(PREFIX), -1
        while chain >= 0 and chain < at:
            step = chain + 16 + (struct.unpack_from("<H", data, chain + 12)[0] if chain + 16 <= len(data) else len(data))
            chain = data.find(PREFIX, step)
        place = chain
        assert capture.first_response(source, at) == place


def test_source(spark, tmp_path):
    capture.register(spark)
    data = [hostile(9), hostile(10, 50), b""]
    for k, d in enumerate(data):
        (tmp_path / f"{k}.bin").write_bytes(d)
    want = sorted((f"{k}.bin", *x) for k, d in enumerate(data) for x in in_order(d))
    rows = spark.read.format("responses").option("rangebytes", 50_000).load(str(tmp_path))

    def got(df):
        return sorted((r.file.rsplit("/", 1)[1], r.offset, r.control, r.msg_id, r.type, bytes(r.body)) for r in df.collect())

    assert rows.rdd.getNumPartitions() > 20 and got(rows) == want
    for test, types in (("type = 8", {8}), ("type IN (7, 9)", {7}), ("type = 8 AND type = 7", set()), ("type = 7 AND length(body) > 100", {7})):
        assert got(rows.where(test)) == [w for w in want if w[4] in types and (len(w[5]) > 100 or "body" not in test)]
    plan = rows.where("type = 8")._jdf.queryExecution().executedPlan().toString()
    assert " Filter " not in plan
    assert spark.read.format("responses").load(str(tmp_path / "none")).count() == 0


def test_written_files_come_back(spark):
    capture.register(spark)
    path = work_folder(spark, "captures")
    rows = spark.range(100).select(F.lit(None).cast("binary").alias("data"))
    bodies = [(response(bytes([i]) * 50, 5, i),) for i in range(100)] + [(None,)]
    spark.createDataFrame(bodies, "data binary").repartition(4).write.format("responses").mode("append").save(path)
    found = spark.read.format("responses").load(path)
    assert sorted((r.msg_id, bytes(r.body)) for r in found.collect()) == [(i, bytes([i]) * 50) for i in range(100)]
    spark.createDataFrame(bodies[:3], "data binary").coalesce(1).write.format("responses").mode("overwrite").save(path)
    assert spark.read.format("responses").load(path).count() == 3 and rows.count() == 100


def test_stream_reads_what_has_become_whole(spark, tmp_path):
    capture.register(spark)
    data, folder = hostile(12, 60), tmp_path / "in"
    folder.mkdir()
    out, check = work_folder(spark, "out"), work_folder(spark, "check")
    cuts = [0, 1000, len(data) // 2, len(data) // 2 + 7, len(data)]
    for cut in cuts[1:]:
        (folder / "a.bin").write_bytes(data[:cut])
        if cut == cuts[3]:
            (folder / "b.bin").write_bytes(response(b"late", 3, 77))
        stream = spark.readStream.format("responses").option("rangebytes", 70_000).load(str(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.file.rsplit("/", 1)[1], r.offset, r.msg_id, bytes(r.body)) for r in spark.read.parquet(out).collect())
    assert got == sorted([("a.bin", x[0], x[2], x[4]) for x in in_order(data)] + [("b.bin", 0, 77, b"late")])
