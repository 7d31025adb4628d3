"""Moving windows of the kernel against Spark's own, over parts of series and with nulls."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators, screen, signals


def _bars(spark, n=700):
    rows = spark.range(3 * n).select(
        (F.col("id") % 3).cast("string").alias("code"), F.lit(9).alias("ktype"), F.timestamp_seconds(F.floor(F.col("id") / 3) * 86400).alias("ts"), (F.sin(F.col("id") / 7) * 40 + 100 + F.col("id") * 7919 % 13).alias("close"),
    )
    rows = rows.where("code = '0' OR code = '1' AND ts < '1970-01-23' OR code = '2' AND ts < '1970-01-05'")
    return rows.withColumns({"close": F.when(F.col("ts") != F.lit("1970-02-10").cast("timestamp"), F.col("close")), "volume": F.col("close") % 17, "open": F.col("close")}).withColumns({"high": F.col("close") + 1, "low": F.col("close") - 1, "amount": F.col("close")})


def test_windows_are_those_of_spark(spark):
    bars = _bars(spark)
    up, mid, low = indicators.boll(20, 2.0)
    mean, ratio, label = indicators.volume_ratio()
    plain = {f"ma_{p}": indicators.sma(p) for p in (5, 10, 20, 60, 120)} | {"boll_up": up, "boll_mid": mid, "boll_low": low, "avg5": mean, "ratio": ratio, "activity": label}
    want = indicators.price_change(indicators.ordered(bars)).withColumns(plain)
    for a, b in ((5, 10), (10, 20), (20, 60)):
        want = want.withColumn(f"ma_gap_{a}_{b}_before", F.lag(F.col(f"ma_{a}") - F.col(f"ma_{b}")).over(indicators.Window.partitionBy("code", "ktype").orderBy("i")))
    names = [*plain, "change", "change_pct", *[c for c in want.columns if c.startswith("ma_gap")]]
    got = indicators.indicators(bars).select("code", "ts", *names).toPandas().sort_values(["code", "ts"])
    want = want.select("code", "ts", *names).toPandas().sort_values(["code", "ts"])
    for name in names:  # to the last bit
        assert got[name].fillna(-1).tolist() == want[name].fillna(-1).tolist(), name


@pytest.mark.parametrize("size", [50, 333])
def test_parts_of_a_series_look_back_into_the_part_before(spark, size):
    import pyarrow as pa

    table = indicators.ordered(_bars(spark).where("code = '0'")).toPandas().sort_values("i")
    one = indicators._Windows((indicators.Config(),), frozenset(["ma_120", "boll_up", "boll_low", "ma_gap_5_10_before", "avg5", "change", "trend"]))
    rows = pa.Table.from_pandas(table.assign(ends=[[1.0] * 25] + [None] * (len(table) - 1)), preserve_index=False)

    def run(step):
        from copy import deepcopy

        over, out = deepcopy(one), {}
        for at in range(0, len(table), step):
            part = rows.slice(at, step)
            i, n = (part.column(x).to_numpy() for x in ("i", "n"))
            lines, rsv = over.lines(part, i, n, i * 0)
            for k, v in (lines | {"rsv": rsv}).items():
                out.setdefault(k, []).extend(v.to_pylist() if isinstance(v, pa.Array) else [repr(x) for x in v])
        return out

    assert run(size) == run(len(table))


def test_only_the_named_lines_are_made(spark):
    bars = _bars(spark).select("code", "ktype", "ts", "high", "low", "close")
    last = screen.last_rows(indicators.indicators(bars, only=("change_pct",)))
    assert last.columns == ["code", "ktype", "ts", "high", "low", "close", "i", "n", "change_pct"] and last.count() == 3
    # screens need no texts of signals, and no more lines than LINES
    few = signals.on_bars(indicators.indicators(bars, only=signals.LINES), told=False)
    assert "details" not in few.schema["signals"].dataType.simpleString()
    whole = signals.signals(indicators.indicators(_bars(spark)))
    assert few.selectExpr("explode(signals) s").groupBy("s.type").count().orderBy("type").collect() == whole.groupBy("type").count().orderBy("type").collect()
    newest = {tuple(r) for r in screen.latest(signals.signals(screen.newest(few))).select("code", "ts", "type", "details").collect()}
    assert newest == {tuple(r) for r in screen.latest(whole).select("code", "ts", "type", "details").collect()}
