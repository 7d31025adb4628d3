"""Screening a universe of codes by their signals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.codes import decoded
from barloom.functions.values import fixed
from barloom.operators.signals import BUYS, SCREENED

#: A list of names is broadcast up to so many rows and bytes.
BROADCAST_NAMES, BROADCAST_BYTES = 200_000, 32 << 20


def named(rows: DataFrame, names: DataFrame, how: str = "inner") -> DataFrame:
    """Adds name by code. names has one row a code; it is broadcast if that is small enough. An inner join keeps no
    row of an empty code or name."""
    if how == "inner":
        names = names.where("code <> '' AND name <> ''")
    names = names.select("code", "name")
    size = F.octet_length(F.concat_ws("", "code", "name")).cast("long")
    held = names.limit(BROADCAST_NAMES + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).first()
    small = held.rows <= BROADCAST_NAMES and (held.bytes or 0) <= BROADCAST_BYTES
    return rows.join(F.broadcast(names) if small else names, "code", how)


def named_by_exchange(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows whose code, with its exchange by prefix, has a name there, with that name; names: exchange, code, name,
    one row for each exchange and code."""
    placed = rows.withColumn("exchange", decoded(F.col("code"))[0])
    return placed.join(names.select("exchange", "code", "name"), ["exchange", "code"])


def text_lines(rows: DataFrame, columns: dict[str, str], *keys: str) -> DataFrame:
    """keys and `line`: the columns as text in fixed widths, each by its printf format; null is a dash. Widths count
    characters, and longer text is not cut."""
    def cell(name: str, form: str) -> Column:
        width, places, kind = re.fullmatch(r"%(-?\d+)(?:\.(\d+))?([sfd])", form).groups()
        value = fixed(F.col(name), int(places)) if kind == "f" else F.col(name).cast("string")
        value, size = F.coalesce(value, F.lit("-")), abs(int(width))
        pad = F.repeat(F.lit(" "), F.greatest(size - F.char_length(value), F.lit(0)))
        return F.concat(value, pad) if width.startswith("-") else F.concat(pad, value)

    return rows.select(*keys, F.concat_ws(" ", *[cell(n, f) for n, f in columns.items()]).alias("line"))


def by_priority(listed: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """One row a code: of several exchanges that list it, the first in order; of several there, the last name."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("exchange"))
    best = Window.partitionBy("code").orderBy(F.when(rank == 0, len(order) + 1).otherwise(rank), F.col("name").desc())
    return listed.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def last_rows(frame: DataFrame) -> DataFrame:
    """The newest bar of each series; the frame's own numbering tells it."""
    return frame.where(F.col("i") == F.col("n") - 1)


def latest(found: DataFrame) -> DataFrame:
    """The newest signal of each series; of one bar's, that of the last detector and place."""
    best = Window.partitionBy("code", "ktype").orderBy(F.col("ts").desc(), F.col("detector").desc(), F.col("sub").desc())
    return found.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def newest(bars: DataFrame) -> DataFrame:
    """Each series' newest bar with a signal, without its signals; bars hold them. A task sends a row of each series that
    it met."""
    whole = [x for x in bars.columns if x not in ("code", "ktype", "signals")]
    return bars.where(F.size("signals") > 0).groupBy("code", "ktype").agg(F.max_by(F.struct(*whole), "i").alias("bar")).select("code", "ktype", "bar.*")


def latest_buys(found: DataFrame) -> DataFrame:
    """Series whose newest signal says buy, with that signal."""
    return latest(found).where(F.col("type").isin(*BUYS))


def with_any(bars: DataFrame, signal: str, keep: tuple[str, ...] = ("close",)) -> DataFrame:
    """code, ktype and the columns in keep of the newest bar of each series that ever had a signal of the named
    type; none for an unknown name. bars hold their signals, so one pass over them tells both, and what a task
    found of a series is a row of the shuffle."""
    last = F.max_by(F.struct(*keep), "i").alias("last")
    had = F.max(F.exists("signals", lambda s: s["type"] == SCREENED.get(signal))).alias("had")
    return bars.groupBy("code", "ktype").agg(last, had).where("had").select("code", "ktype", "last.*")


def table(bars: DataFrame, order: Column | None = None) -> DataFrame:
    """The newest bar of each series with its indicators and its signals, "-" if there are none. bars hold their
    signals in order."""
    told = F.array_join(F.transform("signals", lambda s: F.concat(s["indicator"], s["type"])), ", ")
    out = last_rows(bars).select(
        "code", "ktype", "ts", "close", "change", "change_pct", "ma_5", "ma_10", "ma_20", "dif", "dea", "k", "d", "j", "rsi_6", F.when(F.size("signals") > 0, told).otherwise("-").alias("signals")
    )
    return out if order is None else out.orderBy(order)


def counts_by_type(found: DataFrame) -> DataFrame:
    """found: a row for each signal, with its type."""
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
