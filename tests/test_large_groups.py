"""Groups that outgrow one response, and numbers at the edges of their text."""

import datetime as dt

from pyspark.sql import functions as F

from barloom.functions import values as v
from barloom.plans import captures, fixtures
from barloom.plans.registry import QUERIES
from barloom.sources import wire

DAY = dt.datetime(2024, 1, 2, 9, 30)


def _events(spark, folder, n):
    rows = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.unix_timestamp(F.lit(DAY)) + F.col("id") % 3600).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("buy").alias("event_type"),
        (F.col("id") * 7919 % 100000 / 100).alias("value"), F.concat(F.lit('{"k": '), F.col("id") % 100, F.lit("}")).alias("props"),
    )
    rows.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_a_day_with_more_trades_than_a_response_holds(spark, tmp_path):
    n = 70_000  # beyond 16 bits, in records and in bytes
    d = _events(spark, tmp_path, n)
    for name in ("frame_decode", "capture_files_decode"):
        found = QUERIES[name](spark, d)
        assert found.count() == n
        wrong = found.join(fixtures.ticks(spark, d).select(F.col("seq"), F.col("price").alias("p"), F.col("volume").alias("w")), "seq").where("abs(price - p) > 1e-6 OR volume <> w")
        assert wrong.count() == 0
    assert fixtures.tick_requests(spark, d).count() == -(-n // 1800)
    line = QUERIES["minute_line_decode"](spark, d)
    assert line.count() == n and line.agg(F.max("seq")).first()[0] == n - 1
    assert QUERIES["auction_decode"](spark, d).count() == n
    numbers = QUERIES["varint_decode"](spark, d)
    assert numbers.where(F.col("value") == F.col("seq") * 7919 % 2147483648 - 1073741824).count() == n
    assert captures.numbers(spark, d).agg(F.max(F.octet_length("body"))).first()[0] < 0x10000


def test_a_large_response_is_decoded_in_parts(spark):
    made = []

    def endless(raw):
        for i in range(50_000):
            made.append(i)
            yield (i,)

    frame = spark.createDataFrame([("1", b"x")], "code string, body binary")
    parts = []
    fake = type("Rows", (), {"sparkSession": spark, "columns": ["code", "body"], "dtypes": frame.dtypes, "mapInPandas": lambda self, run, schema: parts.append(run)})()
    wire._each(fake, "body", "n int", endless)
    first = next(parts[0](iter([frame.toPandas()])))
    assert len(first) == len(made) == wire._ROWS


def test_text_of_numbers_below_zero_keeps_the_sign(spark):
    rows = spark.createDataFrame([(-0.0,), (-1e-9,), (-0.001,), (0.0,), (1e-9,), (-1.255,), (None,)], "x double")
    assert [r.t for r in rows.select(v.fixed(F.col("x")).alias("t")).collect()] == ["-0.00", "-0.00", "-0.00", "0.00", "0.00", "-1.25", None]


def test_times_to_live_round_fractions_of_seconds(spark, tmp_path):
    noon = dt.datetime(2024, 1, 1, 12, 0, 0)
    at = {1: -0.4, 2: 0.6, 4: 0.4, 5: -0.6, 8: 0.5, 7: 0.5}
    spark.createDataFrame([(k, noon + dt.timedelta(seconds=x), "buy") for k, x in at.items()], "event_id long, ts timestamp, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    # a half goes to the even second, as in the SQL: 8 stays at noon, 7 is odd and so a second later
    assert {r.key for r in QUERIES["cache_ttl"](spark, str(tmp_path)).collect()} == {"1", "2", "7"}


def test_companies_whose_codes_are_cut_to_the_same_digits(spark, tmp_path):
    rows = [(k, f"n{k}", f"kind {k}") for k in (100000, 1000000, 1000001, 7)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = sorted(tuple(r) for r in QUERIES["company_contents"](spark, str(tmp_path)).collect())
    assert found == [("000007", "kind 7"), ("100000", "kind 100000"), ("100000", "kind 1000000"), ("100000", "kind 1000001")]
