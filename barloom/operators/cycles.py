"""Trade cycles: a golden cross buys, the next death cross sells.

A cycle's span goes by days: from the first bar of the day that buys to the last bar of the day that sells, so that on
bars of hours or minutes the spans of one indicator may share a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.values import fixed, round_half_away
from barloom.operators.signals import kdj_cross, ma_cross, macd_cross

#: Crosses that make cycles, by the order that cycles of one day go in. They are not filtered by trend.
KINDS = {"MACD": macd_cross, "KDJ": kdj_cross, "MA(5,10)": lambda: ma_cross(5, 10)}


def _held(frame: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The bars of each cycle, with their days' first place and extremes, from the golden cross that buys to the death cross that sells, for each indicator: c
    is 1 or -1 at a cross, g numbers the cycle. Cycles of one indicator don't overlap, so a running count and the
    last crosses tell each bar its cycle; the windows keep the frame's own partitioning."""
    day = Window.partitionBy("code", "ktype", F.to_date("ts"))
    frame = frame.withColumns({"day_first": F.min("i").over(day), "day_most": F.max("close").over(day), "day_least": F.min("close").over(day)})
    own = ("code", "ktype", "ts", "i", "close", "day_first", "day_most", "day_least")
    each = F.array(*[F.struct(F.lit(name).alias("indicator"), F.lit(rank).alias("rank"), KINDS[name]().alias("c")) for rank, name in enumerate(KINDS) if name in kinds])
    marked = frame.select(*own, F.explode(each).alias("x")).select(*own, "x.*")
    upto = Window.partitionBy("code", "ktype", "indicator").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("code", "ktype", "indicator").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    death = F.coalesce(F.max(F.when(F.col("c") == -1, F.col("i"))).over(before), F.lit(-1))
    marked = marked.withColumns({"g": F.coalesce(F.count_if(F.col("c") == -1).over(before), F.lit(0)), "golden": F.max(F.when(F.col("c") == 1, F.col("i"))).over(upto), "death": death})
    return marked.where(F.col("golden") > F.col("death"))


def cycles(frame: DataFrame, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """All cycles of an indicator frame: return, bars held from the first one of the buying day, and the largest profit
    and loss from there to the end of the selling day, in percent of the buying price. The first golden cross buys;
    what is open at the end is dropped. A span is the bars between the crosses and those of the two days, so its
    extremes are theirs, and days are windows of the frame's own partitions."""
    at, buys, sells = F.struct("i", "ts", "close", "day_first", "day_most", "day_least"), F.col("c") == 1, F.col("c") == -1
    found = _held(frame, kinds).groupBy("code", "ktype", "indicator", "rank", "g").agg(
        F.min(F.when(buys, at)).alias("buy"), F.max(F.when(sells, at)).alias("sell"), F.max("close").alias("most"), F.min("close").alias("least")
    )

    def percent(price: Column) -> Column:
        return F.when(F.col("buy.close") != 0, (price - F.col("buy.close")) / F.col("buy.close") * 100)

    most = percent(F.greatest("most", "buy.day_most", "sell.day_most"))
    least = percent(F.least("least", "buy.day_least", "sell.day_least"))
    return found.where(F.col("sell").isNotNull()).select(
        "code", "ktype", "indicator", "rank", F.col("buy.ts").alias("buy_ts"), F.col("sell.ts").alias("sell_ts"), F.col("buy.i").alias("buy_i"), F.col("sell.i").alias("sell_i"),
        F.col("buy.close").alias("buy_price"), F.col("sell.close").alias("sell_price"), F.when(F.col("buy.close") > 0, percent(F.col("sell.close"))).otherwise(0.0).alias("return_pct"),
        (F.col("sell.i") - F.col("buy.day_first")).alias("hold_days"), round_half_away(F.greatest(most, least, F.lit(0.0))).alias("max_profit"), round_half_away(F.least(most, least, F.lit(0.0))).alias("max_loss"),
    )


def in_order(found: DataFrame) -> DataFrame:
    """Cycles with nth, their place in the list of their series: by the day that buys, then by indicator and time."""
    by = Window.partitionBy("code", "ktype").orderBy(F.to_date("buy_ts"), "rank", "buy_i")
    return found.withColumn("nth", F.row_number().over(by).cast("long"))


#: Days of a bin of span_bars().
BIN_DAYS = 64


def span_bars(found: DataFrame, bars: DataFrame) -> DataFrame:
    """Each cycle's bars: code, ktype, indicator, buy_i, ts, close, for all bars from the buying day to the selling
    day, both whole. Spans of several cycles may overlap, and their bars come once for each.

    Both sides meet by code and bin of days, a span in every bin that it touches, so a long history is many keys and
    no bar is compared with spans of other times."""
    def bin_of(ts: Column) -> Column:
        return F.floor(F.unix_date(F.to_date(ts)) / BIN_DAYS)

    spans = found.select("code", "ktype", "indicator", "buy_i", F.to_date("buy_ts").alias("_first"), F.to_date("sell_ts").alias("_last"), F.explode(F.sequence(bin_of(F.col("buy_ts")), bin_of(F.col("sell_ts")))).alias("_bin"))
    rows = bars.select("code", "ktype", "ts", "close", bin_of(F.col("ts")).alias("_bin"))
    met = rows.join(spans, ["code", "ktype", "_bin"])
    return met.where(F.to_date("ts").between(F.col("_first"), F.col("_last"))).select("code", "ktype", "indicator", "buy_i", "ts", "close")


def cycle_summary(found: DataFrame, *keys: str) -> DataFrame:
    """Number of cycles, share with a profit, mean return, and a sentence."""
    out = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("cycles"), F.avg(F.when(F.col("return_pct") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("return_pct").alias("avg_return"))
    return out.withColumn("summary", sentence(F.col("cycles"), F.col("win_rate"), F.col("avg_return")))


def sentence(n: Column, win_rate: Column, mean: Column) -> Column:
    return F.when(n == 0, "无完整交易周期").otherwise(F.concat(F.lit("周期数: "), n, F.lit(" | 胜率: "), fixed(win_rate * 100, 1), F.lit("% | 平均收益: "), fixed(mean), F.lit("%")))
