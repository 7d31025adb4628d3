"""Technical indicators, over all codes in one plan.

A single shuffle by code and one sort serve all of them. Moving windows, which Spark would add up row by row, and
the recurrences (exponential means, K and D, Wilder's means) run over the sorted rows as a stream of
buffers, a step of time over all series of a buffer at once; a series longer than a buffer goes on from a few numbers,
whatever the length of its history. Each step is done in its exact order, as crosses depend on the last bit of a
difference. Warm-up rows hold 0.0; an indicator whose series is too short is null."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import deepcopy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.deploy import ship
from barloom.functions.values import change
from barloom.operators.params import Config, Params, with_own

KEYS = ("code", "ktype")


def ordered(bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds i, the 0-based place in the series, and n, its length."""
    return bars.withColumns({"i": (F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1).cast("long"), "n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})


def _rows(before: int, keys: tuple[str, ...] = KEYS):
    return Window.partitionBy(*keys).orderBy("i").rowsBetween(-before, 0)


def sma(p: int, column: str = "close") -> Column:
    return F.when((F.col("i") >= p - 1) & (F.col("n") >= p), F.avg(column).over(_rows(p - 1))).otherwise(0.0)


def boll(n: int, k: float) -> tuple[Column, Column, Column]:
    """Upper, middle, lower: the mean and k population deviations, null throughout if the series is shorter
    than n."""
    mean, square = F.avg("close").over(_rows(n - 1)), F.avg(F.col("close") * F.col("close")).over(_rows(n - 1))
    width = F.lit(float(k)) * F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))

    def line(x: Column) -> Column:
        return F.when(F.col("n") >= n, F.when(F.col("i") >= n - 1, x).otherwise(0.0))

    return line(mean + width), line(mean), line(mean - width)


def rsv(n: int) -> Column:
    """Where the close lies between the lowest low and the highest high of n bars, in percent; 50 if they are
    one."""
    high, low = F.max("high").over(_rows(n - 1)), F.min("low").over(_rows(n - 1))
    return F.when(high == low, 50.0).otherwise((F.col("close") - low) / (high - low) * 100)


def volume_ratio() -> tuple[Column, Column, Column]:
    """Mean volume of the last five bars, the bar's ratio to it, and a label."""
    few = F.col("n") < 5
    mean = F.when(few, F.col("volume")).otherwise(F.avg("volume").over(_rows(4)))
    ratio = F.when(few, 1.0).otherwise(F.when(mean == 0, 0.0).otherwise(F.col("volume") / mean))
    label = F.when(ratio > 2, "very_active").when(ratio > 1.5, "active").when(ratio < 0.5, "inactive").otherwise("normal")
    return mean, ratio, label


def price_change(bars: DataFrame) -> DataFrame:
    diff, pct = change(F.col("close"), F.lag("close").over(Window.partitionBy(*KEYS).orderBy("i")))
    return bars.withColumns({"change": diff, "change_pct": pct})


# Recurrences run over all series of a batch at once: arrays have a row for each step of time and a column for each
# series, and each step is taken in the order of its definition. A single series takes the same steps over plain numbers.


def _steps(x: np.ndarray) -> list:
    return x[:, 0].tolist() if x.shape[1] == 1 else list(x)


def _ema_line(x: np.ndarray, p: int, i: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponential means of x, whose first row is the i-th of its series, after held (sum so far, value)."""
    if not len(x):
        return x, held
    warm = max(0, min(len(x), p - i))
    sums = np.add.accumulate(np.vstack([held[:1], x[:warm]]))
    out = np.zeros(x.shape)
    value = held[1]
    if i < p <= i + len(x):
        value = sums[p - i] / p
        out[p - i - 1] = value
    steps, k = [], 2.0 / (p + 1)
    value = float(value[0]) if x.shape[1] == 1 else value
    for now in _steps(x[warm:]):
        value = (now - value) * k + value
        steps.append(value)
    if steps:
        out[warm:] = np.array(steps).reshape(-1, x.shape[1])
    return out, np.vstack([sums[-1], np.broadcast_to(value, x.shape[1:])])


def _wilder_line(up: np.ndarray, down: np.ndarray, p: int, i: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Relative strength of rises and falls, whose first row is the i-th of its series (the 0th has none)."""
    both = np.hstack([up, down])
    first = 1 if i == 0 else 0
    seen = i + first - 1  # differences before
    warm = max(0, min(len(both) - first, p - seen))
    sums = np.add.accumulate(np.vstack([held.reshape(1, -1), both[first : first + warm]]))
    out = np.zeros(both.shape)
    value = sums[-1]
    if warm and seen + warm == p:
        value = value / p
        out[first + warm - 1] = value
    steps = []
    if both.shape[1] == 2:
        gain, loss = map(float, value)
        for rise, fall in both[first + warm :].tolist():
            gain = (gain * (p - 1) + rise) / p
            loss = (loss * (p - 1) + fall) / p
            steps.append((gain, loss))
        value = np.array([gain, loss])
    else:
        for now in both[first + warm :]:
            value = (value * (p - 1) + now) / p
            steps.append(value)
    if steps:
        out[first + warm :] = np.array(steps)
    half = up.shape[1]
    gain, loss = out[:, :half], out[:, half:]
    with np.errstate(divide="ignore", invalid="ignore"):
        line = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))
    line[: max(0, p - i)] = 0.0
    return line, value.reshape(2, -1)


def _kd_lines(rsv_: np.ndarray, n: int, m1: int, m2: int, i: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K and D."""
    ks, ds = np.zeros(rsv_.shape), np.zeros(rsv_.shape)
    begin = max(0, n - 1 - i)
    k, d = (float(x[0]) if rsv_.shape[1] == 1 else x for x in held)
    if begin < len(rsv_):
        out_k, out_d, steps = [], [], _steps(rsv_[begin:])
        if i <= n - 1:
            k = d = steps[0]
            out_k, out_d, steps = [k], [d], steps[1:]
        for now in steps:
            k = (1 - 1 / m1) * k + (1 / m1) * now
            d = (1 - 1 / m2) * d + (1 / m2) * k
            out_k.append(k)
            out_d.append(d)
        ks[begin:], ds[begin:] = (np.array(x).reshape(-1, rsv_.shape[1]) for x in (out_k, out_d))
    return ks, ds, np.vstack([np.broadcast_to(x, rsv_.shape[1:]) for x in (k, d)])


def held_at_start(c: Config, emas: tuple[int, ...] = (), series: int = 1) -> np.ndarray:
    """What series hold before their first bar: sums and values of the exponential means, K and D, the last close, the
    gaps DIF-DEA and K-D, gains and losses; a column for each series."""
    out = np.zeros((11 + 2 * (len(c.rsi) + len(emas)), series))
    out[8:11] = np.nan
    return out


def line_names(c: Config, emas: tuple[int, ...] = ()) -> list[str]:
    return ["dif", "dea", "hist", "macd_gap_before", "k", "d", "j", "kdj_gap_before", *[f"rsi_{p}" for p in c.rsi], *[f"ema_{p}" for p in emas]]


def run_lines(c: Config, emas: tuple[int, ...], i: int, close: np.ndarray, rsv_: np.ndarray, held: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The lines of line_names(), each with a row for each bar from the i-th on and a column for each series, and what
    the series hold then."""
    (fast, slow, signal), new = c.macd, held.copy()
    ef, new[0:2] = _ema_line(close, fast, i, held[0:2])
    es, new[2:4] = _ema_line(close, slow, i, held[2:4])
    cut = min(len(close), max(0, slow - 1 - i))
    dif, dea = np.zeros(close.shape), np.zeros(close.shape)
    dif[cut:] = ef[cut:] - es[cut:]
    dea[cut:], new[4:6] = _ema_line(dif[cut:], signal, max(0, i - slow + 1), held[4:6])
    hist = dif - dea
    k, d, new[6:8] = _kd_lines(rsv_, *c.kdj, i, held[6:8])
    before = np.vstack([held[8:9], close[:-1]])
    diff = close - before
    if i == 0:
        diff[0] = 0.0
    up, down = np.where(diff > 0, diff, 0.0), np.where(diff > 0, 0.0, -diff)
    lines = [dif, dea, hist, np.vstack([held[9:10], hist[:-1]]), k, d, 3 * k - 2 * d, np.vstack([held[10:11], (k - d)[:-1]])]
    new[8:11] = close[-1], hist[-1], (k - d)[-1]
    at = 11
    for p in c.rsi:
        line, new[at : at + 2] = _wilder_line(up, down, p, i, held[at : at + 2])
        lines.append(line)
        at += 2
    for p in emas:
        line, new[at : at + 2] = _ema_line(close, p, i, held[at : at + 2])
        lines.append(line)
        at += 2
    return lines, new


def rsv_line(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """RSV over n bars of a part of one series, after the highs and lows in tail; and the tail of the next part."""
    tops, bottoms, back = np.r_[tail[0], high], np.r_[tail[1], low], tail.shape[1]
    top, bottom = tops[back:].copy(), bottoms[back:].copy()
    for k in range(1, min(n, len(tops))):
        ahead = max(0, k - back)
        top[ahead:] = np.maximum(top[ahead:], tops[back + ahead - k : len(tops) - k])
        bottom[ahead:] = np.minimum(bottom[ahead:], bottoms[back + ahead - k : len(tops) - k])
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(top == bottom, 50.0, (close - bottom) / (top - bottom) * 100)
    return out, np.vstack([tops[-(n - 1) :], bottoms[-(n - 1) :]]) if n > 1 else np.zeros((2, 0))


def shown_lines(lines: list[np.ndarray], c: Config, emas: tuple[int, ...], n: np.ndarray) -> list[np.ndarray]:
    """Lines as they are shown of series of n bars in all: NaN, or 0 for relative strength and means, where the series
    is too short for them."""
    least = [sum(c.macd[1:])] * 4 + [c.kdj[0]] * 4 + [p + 1 for p in c.rsi] + list(emas)
    return [np.where(n >= m, x, np.nan if at < 8 else 0.0) for at, (x, m) in enumerate(zip(lines, least, strict=True))]


#: Rows that a task computes at once. A longer series goes on from what it holds.
BUFFER_ROWS = 100_000
#: Series of a batch below which each is computed by itself.
FEW = 6


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole series, or of parts of one that is longer than a buffer."""
    held: list[pa.RecordBatch | pa.Table] = []
    rows = 0

    def joined() -> pa.Table:
        return pa.concat_tables([x if isinstance(x, pa.Table) else pa.Table.from_batches([x]) for x in held])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= BUFFER_ROWS:
            table = joined()
            i, n = table.column("i")[-1].as_py(), table.column("n")[-1].as_py()
            open_ = i + 1 if i + 1 < n <= BUFFER_ROWS else 0
            if open_ < table.num_rows:
                yield table.slice(0, table.num_rows - open_)
                held, rows = ([table.slice(table.num_rows - open_)] if open_ else []), open_
    if rows:
        yield joined()


def _alike(begin: np.ndarray, length: np.ndarray, config: np.ndarray, whole: np.ndarray) -> Iterator[np.ndarray]:
    """Places of segments to compute together: whole series of one configuration with lengths within a factor of two,
    or one segment; the first, which may go on from the buffer before, comes first."""
    kind = np.where(whole, config * 64 + np.ceil(np.log2(length)).astype(np.int64), np.arange(len(begin)) - len(begin))
    order = np.argsort(kind, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
        yield from [part] if len(part) >= FEW else part[:, None]


#: What the trend of a series is told by: its last closes, five bars with the means of 20 and the mean five bars before.
TREND_ROWS = 25
_TRENDS = ("unknown", "up", "down", "sideways")
_ACTIVITIES = ("very_active", "active", "inactive", "normal")


def _trends(ends: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Places in _TRENDS for series of n bars by their last closes: up or down if four of the last five bars have their
    means in that order; else by close and slope against MA20; sideways otherwise; unknown below 20 bars."""
    x = np.full((TREND_ROWS, len(n)), np.nan)
    for at, end in enumerate(ends):
        x[TREND_ROWS - len(end) :, at] = end
    there, filled = ~np.isnan(x), np.nan_to_num(x)

    def mean(p: int, back: int) -> np.ndarray:
        end = TREND_ROWS - back
        total, count = filled[end - p].copy(), there[end - p : end].sum(axis=0)
        for row in filled[end - p + 1 : end]:
            total += row
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n - 1 - back >= p - 1, total / count, 0.0)

    bull, bear = np.zeros(len(n), int), np.zeros(len(n), int)
    for back in range(5):
        a, b, d = (mean(p, back) for p in (5, 10, 20))
        bull += (a > b) & (b > d) & (d > 0)
        bear += (a < b) & (b < d) & (d > 0)
    close, d, old = x[-1], mean(20, 0), mean(20, 5)
    return np.select([n < 20, bull >= 4, bear >= 4, (d > 0) & (close > d) & (d > old), (d > 0) & (close < d) & (d < old)], [0, 1, 2, 1, 2], 3)


class _Windows:
    """Lines of moving windows over the buffers of a task, whose rows stand in the order of their series. A window adds up
    its rows from the oldest on, each row of the buffer at once, and looks back into the buffer before."""

    def __init__(self, configs: tuple[Config, ...], only: frozenset[str] | None):
        self.configs, self.only = configs, only
        self.ma = tuple(dict.fromkeys(p for x in configs for p in x.ma))
        self.pairs = [(a, b) for a, b in zip(CROSSING, CROSSING[1:], strict=False) if a in self.ma and b in self.ma]
        self.back = max([5, *self.ma, *(x.boll[0] for x in configs), *(x.kdj[0] for x in configs)])
        self.held = {x: np.full(self.back, np.nan) for x in ("close", "high", "low", *(["volume"] if self.sizes() else []))}
        self.gaps, self.trend = {pair: np.nan for pair in self.pairs}, 0

    def sizes(self) -> bool:
        return any(self.wants(x) for x in ("avg5", "ratio", "activity"))

    def names(self) -> dict[str, str]:
        """The lines and their types."""
        numbers = [*[f"ma_{p}" for p in self.ma], "boll_up", "boll_mid", "boll_low", "avg5", "ratio"]
        out = dict.fromkeys(numbers, "double") | {"activity": "string", "change": "double", "change_pct": "double"}
        out |= {f"ma_gap_{a}_{b}_before": "double" for a, b in self.pairs} | {"trend": "string"}
        return {k: t for k, t in out.items() if self.wants(k)}

    def wants(self, name: str) -> bool:
        return self.only is None or name in self.only

    def _mean(self, x: np.ndarray, p: int, rows: int) -> np.ndarray:
        """Means of p rows that end with each, nulls left out."""
        def total(y: np.ndarray) -> np.ndarray:
            begin = self.back - p + 1
            out = y[begin : begin + rows].copy()
            for k in range(begin + 1, begin + p):
                out += y[k : k + rows]
            return out

        there = ~np.isnan(x)
        if there[self.back :].all() and there[: self.back].all():
            return total(x) / p
        with np.errstate(invalid="ignore", divide="ignore"):
            return total(np.where(there, x, 0.0)) / total(there.astype(float))

    def _each(self, number: np.ndarray, part: Callable[[Config], object], make: Callable[[object], np.ndarray]) -> np.ndarray:
        """make(part of each row's configuration)."""
        parts = [part(c) for c in self.configs]
        distinct = list(dict.fromkeys(parts))
        if len(distinct) == 1:
            return make(distinct[0])
        made = [make(x) for x in distinct]
        return np.choose(np.array([distinct.index(x) for x in parts])[number], made) if len(made) <= 32 else np.stack(made)[np.array([distinct.index(x) for x in parts])[number], np.arange(len(number))]

    def lines(self, table: pa.Table, i: np.ndarray, n: np.ndarray, number: np.ndarray) -> tuple[dict[str, object], np.ndarray]:
        """The lines of names() for a buffer, and RSV."""
        rows, x, out = len(i), {}, {}
        for name, before in self.held.items():
            x[name] = np.r_[before, table.column(name).to_numpy().astype(float)]
            self.held[name] = x[name][-self.back :]
        close, at = x["close"][self.back :], self.back
        means: dict[int, np.ndarray] = {}

        def mean(p: int) -> np.ndarray:
            if p not in means:
                means[p] = self._mean(x["close"], p, rows)
            return means[p]

        def ma(p: int) -> np.ndarray:
            return self._each(number, lambda c: p in c.ma, lambda has: np.where(i >= p - 1, mean(p), 0.0) if has else np.full(rows, np.nan))

        def top(name: str, p: int, better: Callable) -> np.ndarray:
            found = x[name][at:].copy()
            for k in range(1, p):
                found = np.where(i >= k, better(found, x[name][at - k : at - k + rows]), found)
            return found

        def rsv_(p: int) -> np.ndarray:
            high, low = top("high", p, np.fmax), top("low", p, np.fmin)
            with np.errstate(invalid="ignore", divide="ignore"):
                return np.where(high == low, 50.0, (close - low) / (high - low) * 100)

        mas = {p: ma(p) for p in self.ma if self.wants(f"ma_{p}") or any(p in pair and self.wants(f"ma_gap_{pair[0]}_{pair[1]}_before") for pair in self.pairs)}
        out |= {f"ma_{p}": v for p, v in mas.items()}
        if any(self.wants(b) for b in ("boll_up", "boll_mid", "boll_low")):
            def band(nk: tuple, sign: int) -> np.ndarray:
                square = self._mean(x["close"] * x["close"], nk[0], rows)
                line = mean(nk[0])
                if sign:
                    with np.errstate(invalid="ignore"):
                        line = line + sign * (float(nk[1]) * np.sqrt(np.maximum(square - line * line, 0.0)))
                return np.where(n >= nk[0], np.where(i >= nk[0] - 1, line, 0.0), np.nan)

            out |= {name: self._each(number, lambda c: c.boll, lambda nk, sign=sign: band(nk, sign)) for name, sign in (("boll_up", 1), ("boll_mid", 0), ("boll_low", -1))}
        if self.sizes():
            size = x["volume"]
            total, count = np.zeros(rows), np.zeros(rows)
            for k in range(4, -1, -1):
                then = size[at - k : at - k + rows]
                there = (i >= k) & ~np.isnan(then)
                total, count = total + np.where(there, then, 0.0), count + there
            with np.errstate(invalid="ignore", divide="ignore"):
                out["avg5"] = np.where(n < 5, size[at:], total / count)
                out["ratio"] = ratio = np.where(n < 5, 1.0, np.where(out["avg5"] == 0, 0.0, size[at:] / out["avg5"]))
            out["activity"] = _words(np.select([ratio > 2, ratio > 1.5, ratio < 0.5], [0, 1, 2], 3), _ACTIVITIES)
        previous = np.where(i == 0, np.nan, x["close"][at - 1 : at - 1 + rows])
        out["change"] = diff = np.where(np.isnan(previous), 0.0, close - previous)
        with np.errstate(invalid="ignore", divide="ignore"):
            out["change_pct"] = np.where(previous > 0, diff / previous * 100, 0.0)
        for a, b in self.pairs:
            if a in mas and b in mas:
                gap = mas[a] - mas[b]
                out[f"ma_gap_{a}_{b}_before"] = np.where(i == 0, np.nan, np.r_[self.gaps[a, b], gap[:-1]])
                self.gaps[a, b] = gap[-1]
        if self.wants("trend"):
            first = np.flatnonzero(i == 0)
            ends = table.column("ends").take(pa.array(first))
            told = _trends([np.array(e, float) for e in ends.to_pylist()], n[first])
            told = self._each(number[first], lambda c: {5, 10, 20} <= set(c.ma), lambda has: told if has else np.zeros(len(first), int))
            trend = np.r_[self.trend, told][np.cumsum(i == 0)]
            self.trend = trend[-1]
            out["trend"] = _words(trend, _TRENDS)
        return {k: out[k] for k in self.names()}, self._each(number, lambda c: c.kdj[0], rsv_)


def _words(places: np.ndarray, words: tuple[str, ...]) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(places, pa.int32()), pa.array(words)).cast(pa.string())


def with_recurrences(rows: DataFrame, c: Config | tuple[Config, ...], emas: tuple[int, ...] = (), keys: tuple[str, ...] = KEYS, windows: _Windows | None = None) -> DataFrame:
    """rows (with i, n, close, rsv), which must be dealt by keys, with dif, dea, hist, k, d, j, rsi_*, ema_* and
    the gaps DIF-DEA and K-D of the bar before. Of several configurations, the column `config` says by number which is a
    row's; rsi_* of periods that it lacks are null. With windows, rsv and their lines are made here too."""
    ship(rows.sparkSession)
    configs = c if isinstance(c, tuple) else (c,)
    periods = tuple(dict.fromkeys(p for x in configs for p in x.rsi))
    names = line_names(Config(rsi=periods), emas)
    columns = [x for x in rows.columns if x != "config" and (windows is None or x != "ends")]
    moving = windows.names() if windows else {}
    shown = [x for x in names if windows is None or windows.wants(x)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = None, deepcopy(windows)
        for table in _buffers(batches):
            i, n = (table.column(x).to_numpy() for x in ("i", "n"))
            number = table.column("config").to_numpy() if len(configs) > 1 else np.zeros(len(i), np.int64)
            close = table.column("close").to_numpy().astype(float)
            lines_, rsv_ = over.lines(table, i, n, number) if over else ({}, table.column("rsv").to_numpy().astype(float))
            begin = np.flatnonzero(np.r_[True, i[1:] == 0]) if shown else np.zeros(0, int)
            length = np.diff(np.r_[begin, len(i)]) if shown else begin
            whole = (i[begin] == 0) & (length == n[begin])
            out = {x: np.full(len(i), np.nan) for x in names if shown}
            for part in _alike(begin, length, number[begin], whole) if shown else ():
                own, start = configs[number[begin[part[0]]]], int(i[begin[part[0]]])
                most = length[part].max()
                step = np.arange(most)[:, None]
                place = begin[part] + np.minimum(step, length[part] - 1)
                there = step < length[part]
                lines, after = run_lines(own, emas, start, close[place], rsv_[place], held if start else held_at_start(own, emas, len(part)))
                for name, line in zip(line_names(own, emas), shown_lines(lines, own, emas, n[begin[part]]), strict=True):
                    out[name][place[there]] = line[there]
                if len(part) == 1 and not whole[part[0]]:
                    held = after
            made = table.select(columns)
            for name, line in lines_.items():
                made = made.append_column(name, line if isinstance(line, pa.Array) else pa.array(line, mask=np.isnan(line)))
            for name in shown:
                made = made.append_column(name, pa.array(out[name], mask=np.isnan(out[name])))
            yield from made.to_batches(max_chunksize=10_000)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in columns], *[f"{x} {t}" for x, t in moving.items()], *[f"{x} double" for x in shown]])
    return rows.sortWithinPartitions(*keys, "i").mapInArrow(run, schema)


def ema(bars: DataFrame, periods: tuple[int, ...]) -> DataFrame:
    """ema_p of each period, over ordered bars."""
    c = Config(rsi=(1,))
    out = with_recurrences(ordered(bars).withColumn("rsv", F.lit(50.0)), c, periods)
    return out.select(*bars.columns, "i", "n", *[f"ema_{p}" for p in periods])


#: Periods whose adjacent lines may cross.
CROSSING = (5, 10, 20, 60)


def indicators(bars: DataFrame, c: Config | tuple[Config, ...] = Config(), emas: tuple[int, ...] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    """bars with i, n, ma_*, boll_up, boll_mid, boll_low, dif, dea, hist, k, d, j, rsi_*, change, change_pct,
    avg5, ratio, activity, the trend of the series' end, and the gaps before that crosses need; with `only`, of these
    lines those named there.

    Rows of several codes and periods may be mixed; the series of a code and ktype must have one bar a time. Of several
    configurations, the column `config` says by number which is a series'; it is one plan with one shuffle for all, and
    lines that a series' configuration lacks are null."""
    configs = c if isinstance(c, tuple) else (c,)
    whole = Window.partitionBy(*KEYS).orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = F.collect_list(F.when(F.col("i") >= F.col("n") - TREND_ROWS, F.coalesce("close", F.lit(float("nan"))))).over(whole)
    rows = ordered(bars).withColumn("ends", F.when(F.col("i") == 0, end))
    return with_recurrences(rows, configs, emas, windows=_Windows(configs, None if only is None else frozenset(only)))


def indicators_by_code(bars: DataFrame, params: Params) -> DataFrame:
    """indicators() with each code's own parameters, in one plan."""
    configs, numbered = params.numbered(bars.sparkSession)
    return indicators(with_own(bars, params).join(F.broadcast(numbered), ["category", "own"]).select(*bars.columns, "config"), configs)
