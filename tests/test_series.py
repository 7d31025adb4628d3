"""Indicators, signals and cycles on small series, with values worked out by hand or by plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.values import round_half_away
from barloom.operators import backtest, cycles, indicators, params, screen, signals
from barloom.operators.params import Config
from barloom.schemas import BARS

from . import literal


def series(spark, closes, code="1", spread=1.0, step=1):
    rows = [(code, 9, literal.DAY0 + datetime.timedelta(days=i * step), float(c), float(c + spread), float(c - spread), float(c), 1.0, float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BARS)


def column(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy("code", "i").collect()]


X3 = [100 + i + (i % 5 - 2) for i in range(50)]
X4 = [50 + i % 10 for i in range(30)]
X5 = [100 + i % 5 for i in range(30)]
X6 = [100 + (i % 3) * 2 - 1 for i in range(30)]
X8 = [100 + (i % 10) * 5 for i in range(50)]


def test_mean(spark):
    rows = indicators.ordered(series(spark, range(10, 16))).withColumn("m", indicators.sma(3))
    assert column(rows, "m") == [0, 0, 11, 12, 13, 14]


def test_exponential_mean(spark):
    assert column(indicators.ema(series(spark, range(10, 15)), (3,)), "ema_3") == [0, 0, 11, 12, 13]


def test_macd(spark):
    got = column(indicators.indicators(series(spark, X3, spread=0)), "dif", "dea", "hist")
    for i, want in {24: (0, 0, 0), 25: (7.041614, 0, 7.041614), 33: (7.057204, 7.029640, 0.027564), 49: (7.187665, 7.040951, 0.146714)}.items():
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_kdj(spark):
    got = column(indicators.indicators(series(spark, X4, spread=0)), "k", "d", "j")
    for i, want in {7: (0, 0, 0), 8: (100, 100, 100), 10: (66.666667, 88.888889, 22.222222), 29: (82.256666, 66.036640, 114.696717)}.items():
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_bands(spark):
    got = column(indicators.indicators(series(spark, X5)), "boll_up", "boll_mid", "boll_low")
    assert got[18] == (0, 0, 0) and got[19] == pytest.approx((104.828427, 102, 99.171573), abs=1e-6)
    assert all(a > b > c for a, b, c in got[19:])


def test_rsi(spark):
    got = column(indicators.indicators(series(spark, X6), Config(rsi=(14,))), "rsi_14")
    assert got[13] == 0 and got[14] == pytest.approx(55.555556, abs=1e-6) and got[29] == pytest.approx(53.691258, abs=1e-6)
    assert all(0 <= x <= 100 for x in got[14:])


@pytest.mark.parametrize("n", [1, 4, 5, 8, 9, 12, 13, 29, 30, 34, 35, 59, 60, 130])
def test_any_length(spark, n):
    rng = random.Random(n)
    closes = [round(rng.uniform(5, 15), 2) for _ in range(n)]
    got = indicators.indicators(series(spark, closes))
    high, low = [c + 1 for c in closes], [c - 1 for c in closes]
    for p in (5, 10, 20, 60, 120):
        assert column(got, f"ma_{p}") == pytest.approx(literal.sma(closes, p))
    for p in (6, 12, 24):
        assert column(got, f"rsi_{p}") == pytest.approx(literal.rsi(closes, p))
    for names, want in ((("dif", "dea", "hist"), literal.macd(closes)), (("k", "d", "j"), literal.kdj(high, low, closes))):
        for name, line in zip(names, want or [[None] * n] * 3, strict=True):
            assert column(got, name) == (pytest.approx(line) if want else line)
    found = signals.signals(got, by_trend=False)
    assert found.count() >= 0




def test_cross_table(spark):
    rows = spark.createDataFrame([(1.0, -1.0), (-1.0, 1.0), (1.0, 1.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (1.0, None)], "now double, before double")
    assert [r.c for r in rows.select(signals.cross(F.col("now"), F.col("before")).alias("c")).collect()] == [1, -1, 0, 1, -1, 0, 0]


def counted(spark, closes, spread=1.0):
    frame = indicators.indicators(series(spark, closes, spread=spread))
    rows = signals.signals(frame).groupBy("indicator", "type").count().collect()
    trend = screen.last_rows(frame).first().trend
    return trend, {(r.indicator, r.type): r["count"] for r in rows}, frame


def test_sideways(spark):
    trend, found, frame = counted(spark, X8)
    assert trend == "sideways" and found == {("KDJ", "超卖"): 2, ("KDJ", "超买"): 7, ("RSI6", "超买"): 4}
    got = {k: [(r.buy_i, r.sell_i, round(r.return_pct, 4)) for r in cycles.cycles(frame, (k,)).orderBy("buy_i").collect()] for k in cycles.KINDS}
    assert got == {
        "MA(5,10)": [(4, 12, -8.3333), (17, 22, -18.5185), (27, 32, -18.5185), (37, 42, -18.5185)], "MACD": [(26, 31, -19.2308), (37, 40, -25.9259)], "KDJ": [(16, 20, -23.0769), (25, 30, -20.0), (35, 40, -20.0)],
    }


def test_falling(spark):
    trend, found, frame = counted(spark, [200 - i for i in range(70)])
    assert trend == "down" and found["MACD", "死叉"] == 1 and found["MA", "空头排列"] == 51 and not any(k[0].startswith("RSI") for k in found)
    assert all(found[f"MA{a}/MA{b}", x] == 1 for a, b in ((5, 10), (10, 20), (20, 60)) for x in ("金叉", "死叉"))
    assert [(r.buy_i, r.sell_i, round(r.return_pct, 3)) for r in cycles.cycles(frame, ("MA(5,10)",)).collect()] == [(4, 9, -2.551)]


def test_rising(spark):
    trend, found, frame = counted(spark, [100 + i for i in range(40)])
    assert trend == "up" and found["MACD", "金叉"] == 1 and found["MA", "多头排列"] == 21 and [found[f"RSI{p}", "超买"] for p in (6, 12, 24)] == [34, 28, 16]
    assert cycles.cycles(frame).count() == 0


def test_flat(spark):
    trend, found, frame = counted(spark, [100] * 70, spread=0.0)
    assert trend == "sideways" and found == {(f"RSI{p}", "超买"): n for p, n in ((6, 64), (12, 58), (24, 46))} and cycles.cycles(frame).count() == 0


def test_cycles_are_those_of_a_state_machine(spark):
    rng = random.Random(4)
    runs = {f"{k:03}": [rng.choice([-1, 0, 0, 1]) for _ in range(120)] for k in range(30)}
    closes = {k: [round(rng.uniform(1, 9), 2) for _ in v] for k, v in runs.items()}
    rows = [(k, 9, literal.DAY0 + datetime.timedelta(days=i), i, closes[k][i], float(x), 0.0, -float(x)) for k, v in runs.items() for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "code string, ktype int, ts timestamp, i int, close double, dif double, dea double, macd_gap_before double")
    got = {(r.code, r.buy_i, r.sell_i) for r in cycles.cycles(frame, ("MACD",)).collect()}
    assert got == {(k, a, b) for k, v in runs.items() for a, b, _ in literal.cycles(v, closes[k])}


def test_runs_of_states_end_at_a_gap(spark):
    days = [0, 1, 2, 4, 5, 9]
    rows = [("1", 9, literal.DAY0 + datetime.timedelta(days=d), d, "超买", "KDJ") for d in days] + [("1", 9, literal.DAY0 + datetime.timedelta(days=d), d, "金叉", "KDJ") for d in (0, 1)]
    kept = backtest.dedup_states(spark.createDataFrame(rows, "code string, ktype int, ts timestamp, i int, type string, indicator string"))
    assert sorted((r.type, r.i) for r in kept.collect()) == [("超买", 0), ("超买", 4), ("超买", 9), ("金叉", 0), ("金叉", 1)]


def test_forward_returns(spark):
    frame = indicators.ordered(series(spark, [10, 20, 0, 5]))
    got = column(backtest.with_forward_returns(frame, (1,)), "chg_1")
    assert got == [100, -100, None, None]


def test_rounding(spark):
    rows = spark.createDataFrame([(1.005,), (-2.675,), (0.125,), (-0.125,)], "x double")
    assert [r.y for r in rows.select(round_half_away(F.col("x")).alias("y")).collect()] == [1.0, -2.68, 0.13, -0.13]


def test_series_are_told_apart_across_batches(spark):
    """Codes follow each other in a task, in several Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    rng = random.Random(1)
    all_ = {f"c{k}": [round(rng.uniform(5, 15), 2) for _ in range(rng.randint(1, 60))] for k in range(12)}
    df = None
    for k, v in all_.items():
        one = series(spark, v, code=k)
        df = one if df is None else df.union(one)
    got = indicators.indicators(df.repartition(3))
    for k, v in all_.items():
        want = literal.macd(v)
        own = column(got.where(F.col("code") == k), "dif")
        assert own == (pytest.approx(want[0]) if want else [None] * len(v))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_parameters():
    p = params.Params()
    assert p.resolve("600000", "large_cap").macd == (12, 26, 9) and p.resolve("002001", "small_cap") == Config(ma=(5, 10, 20), macd=(8, 17, 9), kdj=(7, 3, 3))
    assert p.resolve("000001", "large_cap").kdj == (5, 3, 3) and p.resolve("1", "mid_cap") == Config()
    loaded = params.from_mapping({"defaults": {"ma": [3]}, "categories": {"mid_cap": {"rsi": [2]}}, "overrides": {7: {"macd": {"fast": 1, "slow": 2, "signal": 3}}}})
    assert loaded.resolve("7", "mid_cap") == Config(ma=(3,), rsi=(2,), macd=(1, 2, 3))
    with pytest.raises(ValueError):
        params.from_mapping({"defaults": {"macd": {"fast": 12}}})
    with pytest.raises(ValueError):
        Config(kdj=(9, 0, 3))


def test_screens(spark):
    frame = indicators.indicators(series(spark, [100 + i for i in range(40)], "up").union(series(spark, [200 - i for i in range(70)], "down")))
    found = signals.signals(frame)
    assert {r.code for r in screen.with_any(signals.on_bars(frame), "overbought").collect()} == {"up"}
    assert screen.with_any(signals.on_bars(frame), "nonsense").count() == 0
    assert {(r.code, r.type) for r in screen.latest_buys(found).collect()} <= {("up", "多头排列"), ("down", "超卖")}
    assert {r.code for r in screen.table(signals.on_bars(frame)).collect()} == {"up", "down"}


def mixed_series(spark, n_codes=40, seed=3, least=1, most=90):
    rng = random.Random(seed)
    df = None
    data = {f"c{k:03}": [round(rng.uniform(5, 15), 2) for _ in range(rng.randint(least, most))] for k in range(n_codes)}
    rows = [(code, 9, literal.DAY0 + datetime.timedelta(days=i), x, x + 1, x - 1, x, 1.0, x) for code, v in data.items() for i, x in enumerate(v)]
    return data, spark.createDataFrame(rows, BARS)


def bits(df, *names):
    return sorted((r.code, r.i, *[r[n] for n in names]) for r in df.collect())


LINES = ("dif", "dea", "hist", "k", "d", "j", "rsi_6", "rsi_12", "rsi_24", "macd_gap_before", "kdj_gap_before")


@pytest.mark.parametrize("few, buffer", [(1, 100_000), (6, 100_000), (6, 50), (1, 200), (1000, 64)])
def test_lines_are_the_same_to_the_last_bit_however_they_are_batched(spark, monkeypatch, few, buffer):
    """By themselves, many at once, and in parts of a longer series."""
    data, df = mixed_series(spark)
    config = Config(macd=(3, 7, 4), rsi=(6, 12, 24), kdj=(5, 3, 2))
    monkeypatch.setattr(indicators, "FEW", few)
    monkeypatch.setattr(indicators, "BUFFER_ROWS", buffer)
    monkeypatch.setattr(indicators, "ship", lambda spark: None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    rows = indicators.ordered(df.repartition(3)).withColumn("rsv", indicators.rsv(5))
    table = rows.sort("code", "i").select("code", "ktype", "i", "n", "close", "rsv").toArrow()
    got = {}

    class One:
        columns, schema, sparkSession = table.column_names, rows.select("code", "ktype", "i", "n", "close", "rsv").schema, spark

        def sortWithinPartitions(self, *keys):
            return self

        def mapInArrow(self, run, schema):
            return [r for b in run(iter(table.to_batches(max_chunksize=17))) for r in b.to_pylist()]

    for r in indicators.with_recurrences(One(), config, (4,)):
        got[r["code"], r["i"]] = r
    assert len(got) == sum(map(len, data.values()))
    for code, closes in data.items():
        want = literal.macd(closes, 3, 7, 4), literal.kdj([x + 1 for x in closes], [x - 1 for x in closes], closes, 5, 3, 2)
        for name, line in zip(("dif", "dea", "hist", "k", "d", "j"), [*(want[0] or [[None] * len(closes)] * 3), *(want[1] or [[None] * len(closes)] * 3)], strict=True):
            assert [got[code, i][name] for i in range(len(closes))] == line
        for p in config.rsi:
            assert [got[code, i][f"rsi_{p}"] for i in range(len(closes))] == literal.rsi(closes, p)
        assert [got[code, i]["ema_4"] for i in range(len(closes))] == literal.ema(closes, 4)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fifty_configurations_make_one_plan(spark):
    """Each code by its own parameters, with one scan and one shuffle, as by a plan for each."""
    rng = random.Random(8)
    data, df = mixed_series(spark, 60, 5, 60, 90)
    own = {f"c{k:03}": params.Partial(macd=(rng.randint(3, 9), rng.randint(10, 20), rng.randint(2, 9)), kdj=(rng.randint(3, 9), 3, rng.randint(2, 4)), rsi=(6, 12, rng.choice([14, 24])), boll=(rng.choice([10, 20]), 2.0), ma=(5, 10, 20, *rng.choice([(), (30,)]))) for k in range(50)}
    p = params.Params(overrides=tuple(own.items()))
    stored = df.repartition(2)
    found = indicators.indicators_by_code(stored, p)
    configs, _ = p.numbered(spark)
    assert len(configs) >= 48
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(code") == 1 and plan.count("MapInArrow") == 1
    names = ("dif", "dea", "k", "d", "rsi_6", "boll_up", "ma_5", "ma_30", "rsi_14", "trend")
    got = {(r.code, r.i): r for r in found.collect()}
    assert len(got) == df.count()
    for code in [*list(own)[:5], "c055"]:
        c = p.resolve(code, "mid_cap")
        for r in indicators.indicators(df.where(F.col("code") == code), c).collect():
            for name in names:
                assert got[code, r.i][name] == (r[name] if name in r else None)


def test_cycles_go_by_days(spark):
    """Four bars a day: the span is from the buying day's first bar to the selling day's last."""
    rng = random.Random(11)
    n = 200
    closes = [round(rng.uniform(5, 15), 2) for _ in range(n)]
    marks = [rng.choice([-1, 0, 0, 0, 1]) for _ in range(n)]
    times = [literal.DAY0 + datetime.timedelta(days=i // 4, hours=9 + i % 4) for i in range(n)]
    rows = [("1", 3, t, i, c, float(m), 0.0, -float(m)) for i, (t, c, m) in enumerate(zip(times, closes, marks, strict=True))]
    frame = spark.createDataFrame(rows, "code string, ktype int, ts timestamp, i int, close double, dif double, dea double, macd_gap_before double")
    found = cycles.cycles(frame, ("MACD",))
    got = {(r.buy_i, r.sell_i): (r.hold_days, r.max_profit, r.max_loss) for r in found.collect()}
    want, spans = {}, []
    for a, b, _ in literal.cycles(marks, closes):
        first, last = a - a % 4, min(n - 1, b - b % 4 + 3)
        moves = [(closes[i] - closes[a]) / closes[a] * 100 for i in range(first, last + 1)]
        want[a, b] = (b - first, round(max(0.0, *moves), 2), round(min(0.0, *moves), 2))
        spans += [(a, times[i]) for i in range(first, last + 1)]
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k] == pytest.approx(want[k], abs=0.011) for k in want)
    assert sorted((r.buy_i, r.ts) for r in cycles.span_bars(found, frame).collect()) == sorted(spans)
    assert len(spans) > len(set(t for _, t in spans))  # spans share days
