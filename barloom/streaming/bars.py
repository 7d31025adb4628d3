"""Bars and indicators as streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from barloom.deploy import ship
from barloom.operators.indicators import held_at_start, line_names, rsv_line, run_lines
from barloom.operators.params import Config
from barloom.sources.barstore import BarStore


def bars(trades: DataFrame, ktype: int, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of trades (code, ts, price, volume, seq), a window of time each. Trades later than the
    watermark allows are left out; state is a row for each code and open window."""
    order = F.struct("ts", "seq")
    grouped = trades.withWatermark("ts", late).groupBy("code", F.window("ts", width))
    out = grouped.agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum(F.col("volume").cast("double")).alias("volume"),
        F.sum("price").alias("amount"),
    )
    return out.select("code", F.lit(ktype).alias("ktype"), F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "amount")


def upsert_into(stream: DataFrame, store: BarStore, checkpoint: str, order: Column | None = None) -> StreamingQuery:
    """Keeps a store of bars up to date with a stream of them: each batch replaces the bars with its keys. A
    batch that runs again after a failure writes the same rows in a new version."""

    def save(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.save(batch, order)

    return stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Lines(StatefulProcessor):
    """A code's lines so far as typed state: how many bars it has had and the time of the last one, what the
    recurrences hold, and the highs and lows that RSV looks back on."""

    def __init__(self, c: Config, idle: str | None):
        self._c, self._idle = c, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._at = handle.getValueState("at", "bars bigint, ts timestamp")
        self._held = handle.getListState("held", "value double")
        self._recent = handle.getListState("recent", "high double, low double")

    def handleInputRows(self, key, rows, timerValues):
        c, (i, last) = self._c, self._at.get() if self._at.exists() else (0, None)
        bars = pd.concat(list(rows)).sort_values("ts")
        bars = bars if last is None else bars[bars["ts"] > pd.Timestamp(last)]
        if bars.empty:
            return
        held = np.array(list(self._held.get()), dtype=float).reshape(-1, 1) if i else held_at_start(c)
        tail = np.array([x for x in self._recent.get()] if i else [], dtype=float).reshape(-1, 2).T
        high, low, close = (bars[x].to_numpy(dtype=float) for x in ("high", "low", "close"))
        rsv, tail = rsv_line(high, low, close, c.kdj[0], tail)
        lines, after = run_lines(c, (), i, close[:, None], rsv[:, None], held)
        self._at.update((i + len(bars), bars["ts"].iloc[-1].to_pydatetime()))
        self._held.put([(float(x),) for x in after[:, 0]])
        self._recent.put(list(zip(*tail.tolist(), strict=True)))
        if self._idle:
            for timer in self._handle.listTimers():
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(pd.Timedelta(self._idle).total_seconds() * 1000))
        made = {name: line[:, 0] for name, line in zip(line_names(c), lines, strict=True) if not name.endswith("_before")}
        yield pd.DataFrame({"code": key[0], "ts": bars["ts"].to_numpy()} | made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._at.clear()
        self._held.clear()
        self._recent.clear()
        yield from ()

    def close(self) -> None:
        pass


def typed_state(spark: SparkSession) -> None:
    """Keeps the session's streaming state in RocksDB, which typed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def indicators(stream: DataFrame, c: Config = Config(), idle: str | None = None) -> DataFrame:
    """dif, dea, hist, k, d, j and rsi_* of a stream of bars, as they come, as of series without an end. A code's state
    is typed: its place, a few numbers, and the last bars of RSV's window, however long its history. Bars not later
    than the last one seen are left out, so within a batch any order will do and over batches time must go on. With
    `idle` (such as "30 days"), the state of a code without bars for so long goes, and it begins anew."""
    ship(stream.sparkSession)
    typed_state(stream.sparkSession)
    shown = [x for x in line_names(c) if not x.endswith("_before")]
    schema = ", ".join(["code string", "ts timestamp", *[f"{x} double" for x in shown]])
    return stream.groupBy("code").transformWithStateInPandas(_Lines(c, idle), schema, "append", "processingTime" if idle else "none")


def held_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """A state variable (at, held or recent) of a stream of indicators(), as a table, from its checkpoint."""
    typed_state(spark)
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


def state_runs(found: DataFrame, gap: str = "1 day", late: str = "7 days") -> DataFrame:
    """Runs of a lasting state in a stream of signals (code, ktype, ts, type, indicator): signals of one kind that
    are no further apart than `gap` make one run, which ends for good once the watermark has passed it. Signals later
    than `late` are left out."""
    session = F.session_window("ts", gap)
    runs = found.withWatermark("ts", late).groupBy("code", "ktype", "indicator", "type", session)
    return runs.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("bars")).drop("session_window")


def sliding(trades: DataFrame, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    """code, start, end, volume, price (the mean) of windows that overlap, over a stream of trades (code, ts, price,
    volume). Trades later than the watermark allows are left out."""
    grouped = trades.withWatermark("ts", late).groupBy("code", F.window("ts", width, step))
    return grouped.agg(F.sum(F.col("volume").cast("double")).alias("volume"), F.avg("price").alias("price")).select("code", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "volume", "price")
