"""Bars: scans, paging, and making coarser ones from finer ones or from trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ("code", "ktype")
#: Rows of a page.
BARS_PAGE, TICKS_PAGE, CODES_PAGE = 800, 1800, 1000
#: Bar period and where it begins; minutes count from midnight.
PERIODS = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "60m": 60, "day": "day", "week": "week", "month": "month", "quarter": "quarter", "year": "year"}


def _start(ts: Column, period: str) -> Column:
    step = PERIODS[period]
    if isinstance(step, str):
        return F.date_trunc(step, ts)
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / (60 * step)) * (60 * step))


def from_trades(trades: DataFrame, code: Column, ts: Column, price: Column, volume: Column, order: Column, period: str, ktype: int, amount: Column | None = None) -> DataFrame:
    """Bars of a period. `order` says which trade of a bar came first and must have no ties within one.
    Sums and extremes combine before the shuffle, so a busy code costs a row per task and bar."""
    rows = trades.select(code.alias("code"), _start(ts, period).alias("ts"), price.alias("p"), volume.cast("double").alias("v"), (price if amount is None else amount).alias("a"), order.alias("o"))
    return rows.groupBy("code", "ts").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").alias("volume"), F.sum("a").alias("amount")
    ).select("code", F.lit(ktype).alias("ktype"), "ts", "open", "high", "low", "close", "volume", "amount")


def resample(bars: DataFrame, period: str, ktype: int) -> DataFrame:
    """Coarser bars from finer ones of the same code."""
    return bars.groupBy("code", _start(F.col("ts"), period).alias("start")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount")
    ).select("code", F.lit(ktype).alias("ktype"), F.col("start").alias("ts"), "open", "high", "low", "close", "volume", "amount")


def klines(bars: DataFrame, code: str, ktype: int, first: str | None = None, last: str | None = None) -> DataFrame:
    """One code's bars from a date to a date, both included; filters reach the scan."""
    out = bars.where((F.col("code") == code) & (F.col("ktype") == ktype))
    if first:
        out = out.where(F.col("ts") >= F.lit(first).cast("timestamp"))
    if last:
        out = out.where(F.col("ts") < F.lit(last).cast("timestamp") + F.expr("interval 1 day"))
    return out


def newest_first(*keys: str, order: str = "ts"):
    return Window.partitionBy(*keys).orderBy(F.col(order).desc())


def page(rows: DataFrame, start: int, count: int, keys: tuple[str, ...] = KEYS, order: str = "ts") -> DataFrame:
    """Each key's rows from the start-th newest on, `count` of them. The bound on the row number lets Spark
    drop rows before the shuffle."""
    return rows.withColumn("_nth", F.row_number().over(newest_first(*keys, order=order))).where((F.col("_nth") > start) & (F.col("_nth") <= start + count)).drop("_nth")


def tail(rows: DataFrame, n: int, keys: tuple[str, ...] = KEYS, order: str = "ts") -> DataFrame:
    return page(rows, 0, n, keys, order)


def until(bars: DataFrame, stop: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Walks each key's bars from the newest back and ends with the first for which `stop` holds, which is
    included; all of them if it never holds."""
    return up_to(bars, stops(bars, stop, keys), keys)


def stops(bars: DataFrame, stop: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """_end: each key's newest time at which `stop` holds, for keys that have one."""
    return bars.where(stop).groupBy(*keys).agg(F.max("ts").alias("_end"))


def up_to(bars: DataFrame, ends: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Each key's bars from the newest back to its _end, which is included; all of those without one."""
    return bars.join(ends, list(keys), "left").where(F.col("_end").isNull() | (F.col("ts") >= F.col("_end"))).drop("_end")


def latest_date(bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return bars.groupBy(*keys).agg(F.to_date(F.max("ts")).alias("latest"))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database server, which the driver of its JDBC URL must be on the class path for."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Codes from a text file, one a line; blank lines and those that begin with # are left out."""
    line = F.trim(F.col("value"))
    return spark.read.text(path).select(line.alias("code")).where((F.col("code") != "") & ~F.col("code").startswith("#"))


def split_codes(rows: DataFrame, column: str) -> DataFrame:
    """A row per code of a comma-separated list, trimmed, without blanks."""
    return rows.select(F.explode(F.split(column, ",")).alias("code")).select(F.trim("code").alias("code")).where(F.col("code") != "")
