"""Signals from indicator frames: one pass over the rows, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.values import fixed
from barloom.operators.indicators import CROSSING
from barloom.operators.params import Config

#: Names of signal types.
GOLDEN, DEATH = "金叉", "死叉"
OVERBOUGHT, OVERSOLD = "超买", "超卖"
BREAK_UPPER, BREAK_LOWER = "突破上轨", "跌破下轨"
BULL, BEAR = "多头排列", "空头排列"
BUYS = (GOLDEN, OVERSOLD, BREAK_LOWER, BULL)
#: Types that last for runs of bars.
STATES = (BULL, BEAR, OVERBOUGHT, OVERSOLD)
SCREENED = {"golden_cross": GOLDEN, "death_cross": DEATH, "overbought": OVERBOUGHT, "oversold": OVERSOLD}

#: When a bar has a signal, and the signal's fields.
Found = tuple[Column, dict[str, Column]]
#: The lines that signals of the default parameters are made of, for indicators(only=...).
LINES = (
    "ma_5", "ma_10", "ma_20", "ma_60", "ma_gap_5_10_before", "ma_gap_10_20_before", "ma_gap_20_60_before", "boll_up", "boll_low", "dif", "dea", "hist", "macd_gap_before", "k", "d", "j", "kdj_gap_before",
    "rsi_6", "rsi_12", "rsi_24", "trend",
)
COLUMNS = ("code", "ktype", "ts", "i", "type", "indicator", "details", "strength", "detector", "sub", "trend")


@dataclass(frozen=True)
class Detect:
    """Which detectors run."""

    macd: bool = True
    kdj: bool = True
    boll: bool = True
    ma: bool = True
    rsi: bool = True


def cross(now: Column, before: Column) -> Column:
    """1 where a difference comes to be above 0 from 0 or below, -1 the other way, else 0. A difference that
    touches 0 and leaves again on its old side crosses as well."""
    return F.when((before <= 0) & (now > 0), 1).when((before >= 0) & (now < 0), -1).otherwise(0)


def macd_cross() -> Column:
    return cross(F.col("dif") - F.col("dea"), F.col("macd_gap_before"))


def kdj_cross() -> Column:
    return cross(F.col("k") - F.col("d"), F.col("kdj_gap_before"))


def ma_cross(a: int, b: int) -> Column:
    return cross(F.col(f"ma_{a}") - F.col(f"ma_{b}"), F.col(f"ma_gap_{a}_{b}_before"))


def _signal(when: Column, kind: Column | str, indicator: str, details: Column, strength: Column, detector: int, sub: int) -> Found:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return when, {"type": kind, "indicator": F.lit(indicator), "details": details, "strength": strength, "detector": F.lit(detector), "sub": F.lit(sub)}


def _crossed(c: Column, *rest) -> Found:
    return _signal(c != 0, F.when(c == 1, GOLDEN).otherwise(DEATH), *rest)


def _details(form: str, *columns: str) -> Column:
    """The form with each {} filled by a column's value, two decimals."""
    parts = form.split("{}")
    return F.concat(*[x for text, c in zip(parts, columns, strict=False) for x in (F.lit(text), fixed(F.col(c)))], F.lit(parts[-1]))


def _macd() -> list[Found]:
    return [_crossed(macd_cross(), "MACD", _details("DIF({}) DEA({})", "dif", "dea"), F.abs("hist"), 0, 0)]


def _kdj() -> list[Found]:
    j = F.col("j")
    return [
        _crossed(kdj_cross(), "KDJ", _details("K({}) D({}) J({})", "k", "d", "j"), F.abs(j - 50) / 50, 1, 0),
        _signal(j > 100, OVERBOUGHT, "KDJ", _details("J={}", "j"), (j - 100) / 100, 1, 1),
        _signal(j < 0, OVERSOLD, "KDJ", _details("J={}", "j"), -j / 100, 1, 2),
    ]


def _boll() -> list[Found]:
    close, up, low = F.col("close"), F.col("boll_up"), F.col("boll_low")
    return [
        _signal((close > up) & (up > 0), BREAK_UPPER, "BOLL", _details("Close({}) > Upper({})", "close", "boll_up"), (close - up) / up, 2, 0),
        _signal((close < low) & (low > 0), BREAK_LOWER, "BOLL", _details("Close({}) < Lower({})", "close", "boll_low"), (low - close) / low, 2, 1),
    ]


def _ma(c: Config) -> list[Found]:
    out = []
    for sub, (a, b) in enumerate(zip(CROSSING, CROSSING[1:], strict=False)):
        if a in c.ma and b in c.ma:
            out.append(_crossed(ma_cross(a, b), f"MA{a}/MA{b}", _details(f"MA{a}({{}}) MA{b}({{}})", f"ma_{a}", f"ma_{b}"), F.lit(0.5), 3, sub))
    if {5, 10, 20} <= set(c.ma):
        x, y, z = F.col("ma_5"), F.col("ma_10"), F.col("ma_20")
        full = (x != 0) & (y != 0) & (z != 0)
        for sub, sign, kind, test in ((3, ">", BULL, (x > y) & (y > z)), (4, "<", BEAR, (x < y) & (y < z))):
            out.append(_signal(full & test, kind, "MA", _details(f"MA5({{}}) {sign} MA10({{}}) {sign} MA20({{}})", "ma_5", "ma_10", "ma_20"), F.abs(x - z) / z, 3, sub))
    return out


def _rsi(c: Config) -> list[Found]:
    out = []
    for sub, p in enumerate(sorted(c.rsi)):
        v = F.col(f"rsi_{p}")
        out.append(_signal(v > 80, OVERBOUGHT, f"RSI{p}", _details(f"RSI{p}={{}}", f"rsi_{p}"), (v - 80) / 20, 4, 2 * sub))
        out.append(_signal((v < 20) & (v != 0), OVERSOLD, f"RSI{p}", _details(f"RSI{p}={{}}", f"rsi_{p}"), (20 - v) / 20, 4, 2 * sub + 1))
    return out


def on_bars(frame: DataFrame, c: Config = Config(), detect: Detect = Detect(), by_trend: bool = True, told: bool = True) -> DataFrame:
    """An indicator frame with each bar's signals as an array `signals`, empty if there are none. With by_trend,
    crosses of MACD, KDJ and the means go where the series' trend is sideways or unknown; in either trend all stay.
    Without `told` they lack details and strength, whose texts cost more than to find the signals.

    Of signals on one bar, `detector` and `sub` give the order: MACD, KDJ, BOLL, MA, RSI, then as listed
    within each, RSI by period."""
    found = [s for on, part in ((detect.macd, _macd()), (detect.kdj, _kdj()), (detect.boll, _boll()), (detect.ma, _ma(c)), (detect.rsi, _rsi(c))) if on for s in part]
    if not found:
        raise ValueError("at least one detector must be on")

    def stays(s: Column) -> Column:
        cross = s["type"].isin(GOLDEN, DEATH) & s["detector"].isin(0, 1, 3)
        return s.isNotNull() & ~(cross & F.col("trend").isin("unknown", "sideways")) if by_trend else s.isNotNull()

    made = [F.when(when, F.struct(*[x.alias(k) for k, x in fields.items() if told or k not in ("details", "strength")])) for when, fields in found]
    return frame.withColumn("signals", F.filter(F.array(*made), stays))


def signals(frame: DataFrame, c: Config = Config(), detect: Detect = Detect(), by_trend: bool = True) -> DataFrame:
    """The signals of on_bars(), a row each."""
    each = on_bars(frame, c, detect, by_trend).select("code", "ktype", "ts", "i", "trend", F.explode("signals").alias("s"))
    return each.select("code", "ktype", "ts", "i", "s.*", "trend").select(*COLUMNS)


def state_labels(frame: DataFrame) -> DataFrame:
    """Each bar's labels. Warm-up zeros are judged like any value, and null indicators are neutral."""
    trend = F.when(F.col("ma_5") > F.col("ma_20"), "bullish").when(F.col("ma_5") < F.col("ma_20"), "bearish").otherwise("neutral")
    macd = F.when(F.col("dif") > F.col("dea"), "golden_cross").when(F.col("dif") < F.col("dea"), "death_cross").otherwise("neutral")
    kdj = F.when(F.col("j") > 100, "overbought").when(F.col("j") < 0, "oversold").otherwise("neutral")
    rsi = F.when(F.col("rsi_6") > 80, "overbought").when(F.col("rsi_6") < 20, "oversold").otherwise("neutral")
    up, low, close = F.col("boll_up"), F.col("boll_low"), F.col("close")
    boll = F.when(close > up, "break_upper").when(close < low, "break_lower").otherwise("normal")
    position = F.when(up > low, (close - low) / (up - low)).otherwise(0.0)
    return frame.withColumns({"trend_label": trend, "macd_label": macd, "kdj_label": kdj, "rsi_label": rsi, "boll_label": boll, "boll_position": position})


def display_flags(frame: DataFrame) -> DataFrame:
    """What a chart and a screen colour by: whether a bar rose, whether its histogram is not below 0, and whether
    the means are in rising, falling or mixed order; means that are missing count as 0."""
    a, b, d = (F.coalesce(f"ma_{p}", F.lit(0.0)) for p in (5, 10, 20))
    label = F.when((a > b) & (b > d), "bull").when((a < b) & (b < d), "bear").otherwise("mixed")
    return frame.withColumns({"rising": F.col("close") >= F.col("open"), "hist_rising": F.col("hist") >= 0, "ma_label": label})


def summary(labelled: DataFrame) -> DataFrame:
    """What the labels come to: a word, a strength from 0 to 100, and the list of states."""
    t = F.col("trend_label")
    listed = F.array(
        F.when(F.col("macd_label") == "golden_cross", "golden_cross"), F.when(F.col("macd_label") == "death_cross", "death_cross"), F.when(F.col("kdj_label") == "overbought", "overbought"),
        F.when(F.col("kdj_label") == "oversold", "oversold"), F.when(t == "bullish", BULL), F.when(t == "bearish", BEAR),
    )
    return labelled.withColumns({
        "summary": F.when(t == "bullish", "买入").when(t == "bearish", "卖出").otherwise("持有"),
        "summary_strength": F.when(t == "bullish", 70).when(t == "bearish", 30).otherwise(50),
        "states": F.array_compact(listed),
    })


def as_json(labelled: DataFrame, c: Config = Config()) -> DataFrame:
    """code, ts, and a bar's indicators and labels as one JSON document; short series leave their part out."""
    def part(test: Column, **columns: Column) -> Column:
        return F.when(test, F.struct(*[v.alias(k) for k, v in columns.items()]))

    doc = F.struct(
        F.col("close"), part(F.lit(True), trend=F.col("trend_label"), **{f"ma{p}": F.col(f"ma_{p}") for p in c.ma}).alias("ma"),
        part(F.col("dif").isNotNull(), dif=F.col("dif"), dea=F.col("dea"), hist=F.col("hist"), signal=F.col("macd_label")).alias("macd"),
        part(F.col("k").isNotNull(), k=F.col("k"), d=F.col("d"), j=F.col("j"), signal=F.col("kdj_label")).alias("kdj"),
        part(F.lit(True), signal=F.col("rsi_label"), **{f"rsi{p}": F.col(f"rsi_{p}") for p in c.rsi}).alias("rsi"),
        part(F.col("boll_up").isNotNull(), upper=F.col("boll_up"), middle=F.col("boll_mid"), lower=F.col("boll_low"), position=F.col("boll_position"), signal=F.col("boll_label")).alias("boll"),
        part(F.lit(True), current=F.col("volume"), avg5=F.col("avg5"), ratio=F.col("ratio"), signal=F.col("activity")).alias("volume"),
        part(F.lit(True), trend=F.col("trend_label"), signal=F.col("summary"), strength=F.col("summary_strength")).alias("summary"),
        F.col("states").alias("signals"),
    )
    return summary(labelled).select("code", "ts", F.to_json(doc).alias("json"))
