"""Within a day: minute lines, ticks, auctions, turnover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.values import clock, fixed, slot_clock

#: Minutes of a trading day, its ends included: 09:30-11:30 and 13:00-15:00.
GRID = (*range(570, 691), *range(780, 901))


def minute_grid(spark: SparkSession) -> DataFrame:
    """slot and HH:MM of each minute of trading."""
    return spark.createDataFrame(list(enumerate(GRID)), "slot int, minute int").withColumn("time", clock(F.col("minute")))


def day_grid(days: DataFrame, *keys: str) -> DataFrame:
    """slot, minute and HH:MM of each minute of trading on each of the days."""
    slots = days.select(*keys, F.posexplode(F.array(*[F.lit(m) for m in GRID])).alias("slot", "minute"))
    return slots.withColumn("time", clock(F.col("minute")))


def on_grid(minutes: DataFrame, last_close: DataFrame, keys: tuple[str, ...] = ("code", "day")) -> DataFrame:
    """Every minute of each key's day: price, volume, and the running volume-weighted price. Minutes without
    a trade carry the last price and mean on; before the first trade both are the last close.

    minutes: keys, minute (of the day), price, volume. last_close: keys, last_close."""
    full = last_close.select(*keys, "last_close", F.explode(F.array(*[F.lit(m) for m in GRID])).alias("minute"))
    rows = full.join(minutes.select(*keys, "minute", "price", "volume"), [*keys, "minute"], "left")
    upto = Window.partitionBy(*keys).orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    size = F.abs("volume")
    money, total = F.sum(F.col("price") * size).over(upto), F.sum(size).over(upto)
    return rows.select(
        *keys, clock(F.col("minute")).alias("time"), F.coalesce(F.last("price", ignorenulls=True).over(upto), "last_close").alias("price"), F.coalesce(size, F.lit(0)).alias("volume"),
        F.coalesce(F.when(total > 0, money / total), "last_close").alias("vwap"),
    )


def vwap(ticks: DataFrame, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """Mean price by the size of trades; the last close where no size is known, given as column last_close."""
    size = F.abs("volume")
    out = ticks.groupBy(*keys).agg(F.sum(F.col("price") * size).alias("money"), F.sum(size).alias("total"), F.max("last_close").alias("last_close"))
    return out.select(*keys, F.when(F.col("total") > 0, F.col("money") / F.col("total")).otherwise(F.col("last_close")).alias("vwap"))


def inner_outer(ticks: DataFrame, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """Volume sold into bids and bought at offers, as percentages of both; 50 each without any."""
    out = ticks.groupBy(*keys).agg(F.sum(F.when(F.col("status") == 1, F.col("volume")).otherwise(0)).alias("inner"), F.sum(F.when(F.col("status") == 0, F.col("volume")).otherwise(0)).alias("outer"))
    total = F.col("inner") + F.col("outer")
    return out.select(*keys, "inner", "outer", *[F.when(total > 0, F.col(c) / total * 100).otherwise(50.0).alias(f"{c}_pct") for c in ("inner", "outer")])


def turnover(volumes: DataFrame, finance: DataFrame) -> DataFrame:
    """Volume as a percentage of the shares that trade; 0 where these aren't known."""
    shares = F.col("float_shares")
    return volumes.join(finance, "code", "left").select("code", "volume", F.when(shares > 0, F.col("volume") / shares * 100).otherwise(0.0).alias("turnover_pct"))


def undelta(rows: DataFrame, column: str, scale: float, keys: tuple[str, ...] = ("code",), order: str = "seq") -> DataFrame:
    """Values from their differences, in order."""
    return rows.withColumn("value", F.sum(column).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) / scale)


def undelta_bars(rows: DataFrame, scale: float = 1000.0, keys: tuple[str, ...] = ("code",), order: str = "seq") -> DataFrame:
    """Bars from differences: the open to the close before, the others to the open."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    close = F.sum(F.col("open_delta") + F.col("close_delta")).over(upto)
    opening = close - F.col("close_delta")
    return rows.select(*keys, order, (opening / scale).alias("open"), ((opening + F.col("high_delta")) / scale).alias("high"), ((opening + F.col("low_delta")) / scale).alias("low"), (close / scale).alias("close"))


def minute_labels(rows: DataFrame, keys: tuple[str, ...] = ("code",), order: str = "seq") -> DataFrame:
    """Adds the 0-based slot of each row in its day and that minute's HH:MM."""
    slot = (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long")
    return rows.withColumn("slot", slot).withColumn("time", slot_clock(F.col("slot")))


def auction(rows: DataFrame) -> DataFrame:
    """Splits the signed unmatched volume into its side and size."""
    return rows.withColumns({"flag": F.when(F.col("unmatched") < 0, -1).otherwise(1), "unmatched": F.abs("unmatched"), "side": F.when(F.col("unmatched") < 0, "卖").otherwise("买")})


def breadth(index_bars: DataFrame) -> DataFrame:
    """Share of rising members per bar of an index."""
    both = F.col("up_count") + F.col("down_count")
    return index_bars.select("code", "ts", "up_count", "down_count", F.when(both > 0, F.col("up_count") / both).alias("breadth"))


def routed_actions(raw: DataFrame) -> DataFrame:
    """Corporate actions from four numbers a to d, whose meaning the category decides; what a category has
    not is 0."""
    c = F.col("category")
    dividend, shrink, warrant = c == 1, c.isin(11, 12), c.isin(13, 14)
    shares = ~dividend & ~shrink & ~warrant

    def put(test, value: str, name: str):
        return F.when(test, F.col(value)).otherwise(0.0).alias(name)

    return raw.select(
        "code", "date", "category", put(dividend, "a", "fen_hong"), put(dividend, "b", "pei_gu_jia"), put(dividend, "c", "song_zhuan_gu"), put(dividend, "d", "pei_gu"), put(shrink, "c", "suo_gu"),
        put(warrant, "a", "xing_quan_jia"), put(warrant, "c", "fen_shu"), put(shares, "a", "pan_qian_liu_tong"), put(shares, "b", "qian_zong_gu_ben"), put(shares, "c", "pan_hou_liu_tong"), put(shares, "d", "hou_zong_gu_ben"),
    )


def finance_display(rows: DataFrame) -> DataFrame:
    """The lines in which a financial snapshot is shown: shares in ten thousands, sums in units of 10^9."""
    def line(*parts: tuple) -> Column:
        return F.concat(*[x for text, column, scale, places in parts for x in (F.lit(text), fixed(F.col(column) / scale, places))])

    return rows.withColumns({
        "shares_line": F.concat(line(("总股本: ", "total_shares", 1e4, 2), ("万股  流通股本: ", "float_shares", 1e4, 2)), F.lit("万股")),
        "assets_line": F.concat(line(("总资产: ", "total_assets", 1e9, 2), ("亿元  净资产: ", "net_assets", 1e9, 2)), F.lit("亿元")),
        "income_line": F.concat(line(("主营收入: ", "main_income", 1e9, 2), ("亿元  净利润: ", "net_profit", 1e9, 2)), F.lit("亿元")),
        "holders_line": F.concat(line(("每股净资产: ", "net_assets_per_share", 1.0, 4)), F.lit("元  股东人数: "), F.round("holders", 0).cast("long").cast("string")),
    })
