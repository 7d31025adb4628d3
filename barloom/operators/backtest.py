"""Back-tests of signals by what prices did after them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.signals import BUYS, STATES

DAYS = (1, 5, 10, 20)
#: Series shorter than this are not tested.
LEAST_BARS = 30


def testable(bars: DataFrame) -> DataFrame:
    """bars, numbered, of series that are long enough to be tested."""
    return bars.where(F.col("n") >= LEAST_BARS)


def dedup_states(found: DataFrame) -> DataFrame:
    """Of each run of a lasting state on consecutive calendar days, its first signal. A weekend ends a run;
    other types stay as they are."""
    runs = Window.partitionBy("code", "ktype", "indicator", "type").orderBy("ts", "i")
    gap = F.datediff(F.to_date("ts"), F.to_date(F.lag("ts").over(runs)))
    return found.withColumn("_gap", gap).where(~F.col("type").isin(*STATES) | F.col("_gap").isNull() | (F.col("_gap") > 1)).drop("_gap")


def with_forward_returns(bars: DataFrame, days: tuple[int, ...] = DAYS) -> DataFrame:
    """chg_d: percent from a bar's close to that d bars later; null past the end or from a close that isn't
    positive. bars are numbered by i."""
    w, close = Window.partitionBy("code", "ktype").orderBy("i"), F.col("close")
    return bars.withColumns({f"chg_{d}": F.when(close > 0, (F.lead("close", d).over(w) - close) / close * 100) for d in days})


def outcomes(found: DataFrame, bars: DataFrame, days: tuple[int, ...] = DAYS) -> DataFrame:
    """Each signal with the price of its day's first bar and the returns from there on."""
    ahead = with_forward_returns(testable(bars), days)
    first = ahead.groupBy("code", "ktype", F.to_date("ts").alias("day")).agg(F.min_by(F.struct("close", *[f"chg_{d}" for d in days]), "i").alias("b"))
    rows = found.withColumn("day", F.to_date("ts")).join(first, ["code", "ktype", "day"])
    action = F.when(F.col("type").isin(*BUYS), "买入参考").otherwise("卖出参考")
    return rows.select("code", "ktype", "day", "ts", "type", "indicator", "details", F.col("b.close").alias("price"), action.alias("action"), *[F.col(f"b.chg_{d}").alias(f"chg_{d}") for d in days])


def outcome_summary(rows: DataFrame, days: tuple[int, ...] = DAYS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per type: how many, how many have a return after d bars, the share of gains and the mean of those; 0
    where there are none."""
    aggs = [F.count(F.lit(1)).alias("count")]
    for d in days:
        chg = F.col(f"chg_{d}")
        aggs += [
            F.count(chg).alias(f"valid_{d}"), F.coalesce(F.avg(F.when(chg.isNotNull(), F.when(chg > 0, 100.0).otherwise(0.0))), F.lit(0.0)).alias(f"win_{d}"), F.coalesce(F.avg(chg), F.lit(0.0)).alias(f"avg_{d}"),
        ]
    return rows.groupBy(*keys, "type", "action").agg(*aggs)
