"""DuckDB SQL for the registered queries, put together from common table expressions.

It follows the operators' definitions on its own path: recurrences are recursive queries, one step a row."""

from __future__ import annotations

CODE_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN '600001' WHEN '2-HIGH' THEN '002001' WHEN '3-MEDIUM' THEN '300003' WHEN '4-NOT SPECIFIED' THEN '000001' WHEN '5-LOW' THEN '688005' END"

#: The bar columns of each source: code, ktype, ts, price, volume, order, amount.
BARS = {
    "d": f"SELECT {CODE_SQL} AS code, 9 AS ktype, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, o_totalprice AS p, 1 AS v, o_orderkey AS o, o_totalprice AS a FROM orders",
    "h": "SELECT event_type AS code, 3 AS ktype, date_trunc('hour', ts)::TIMESTAMP AS ts, value AS p, 1 AS v, event_id AS o, value AS a FROM events",
    "m": (
        "SELECT lpad(l_suppkey::VARCHAR, 6, '0') AS code, 9 AS ktype, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100.0::DOUBLE AS p, l_quantity AS v, "
        "{'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': floor(l_extendedprice / l_quantity * 100 + 0.5) / 100.0::DOUBLE} AS o, l_extendedprice AS a FROM lineitem"
    ),
}


def bars(source: str = "d", step: str | None = None, ktype: int | None = None) -> str:
    """CTE bars; step makes them coarser."""
    ts = f"date_trunc('{step}', ts)::TIMESTAMP" if step else "ts"
    kind = "ktype" if ktype is None else str(ktype)
    return f"""trades AS ({BARS[source]}),
bars AS (SELECT code, {kind} AS ktype, {ts} AS ts, arg_min(p, {{'t': ts, 'o': o}}) AS open, max(p) AS high, min(p) AS low, arg_max(p, {{'t': ts, 'o': o}}) AS close, sum(v)::DOUBLE AS volume, sum(a) AS amount
  FROM trades GROUP BY code, ktype, {ts})"""


def numbered(source: str = "d") -> str:
    return f"""{bars(source)},
b AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY code) AS n FROM bars)"""


def _frame(p: int) -> str:
    return f"OVER (PARTITION BY code ORDER BY i ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"


def sma_sql(p: int) -> str:
    return f"CASE WHEN i >= {p - 1} AND n >= {p} THEN avg(close) {_frame(p)} ELSE 0 END"


def rsv_sql(n: int) -> str:
    high, low = f"max(high) {_frame(n)}", f"min(low) {_frame(n)}"
    return f"CASE WHEN {high} = {low} THEN 50 ELSE (close - {low}) / ({high} - {low}) * 100 END"


MA, RSI = (5, 10, 20, 60, 120), (6, 12, 24)
DEFAULT = {"f": "12", "s": "26", "g": "9", "kn": "9", "m1": "3", "m2": "3"}
MIXED = {
    "f": "CASE code WHEN '002001' THEN 8 ELSE 12 END", "s": "CASE code WHEN '002001' THEN 17 ELSE 26 END", "g": "9",
    "kn": "CASE code WHEN '002001' THEN 7 WHEN '000001' THEN 5 ELSE 9 END", "m1": "3", "m2": "3",
}


def windows(source: str = "d", params: dict[str, str] = DEFAULT) -> str:
    """CTE w: everything that windows give, with each code's parameters."""
    sets = ", ".join(f"({v}) AS {k}" for k, v in params.items())
    mas = ", ".join(f"{sma_sql(p)} AS ma_{p}" for p in MA)
    rsvs = rsv_sql(9) if params is DEFAULT else f"CASE kn WHEN 5 THEN {rsv_sql(5)} WHEN 7 THEN {rsv_sql(7)} ELSE {rsv_sql(9)} END"
    mean, square = f"avg(close) {_frame(20)}", f"avg(close * close) {_frame(20)}"
    width = f"2 * sqrt(greatest({square} - {mean} * {mean}, 0))"

    def band(x: str) -> str:
        return f"CASE WHEN n >= 20 THEN CASE WHEN i >= 19 THEN {x} ELSE 0 END END"

    return f"""{numbered(source)},
p AS (SELECT *, {sets}, close - lag(close) OVER (PARTITION BY code ORDER BY i) AS diff, lag(close) OVER (PARTITION BY code ORDER BY i) AS prev FROM b),
w AS (SELECT *, {mas}, {rsvs} AS rsv, greatest(coalesce(diff, 0), 0) AS up, greatest(-coalesce(diff, 0), 0) AS dn,
  {band(f"{mean} + {width}")} AS boll_up, {band(mean)} AS boll_mid, {band(f"{mean} - {width}")} AS boll_low,
  CASE WHEN n < 5 THEN volume ELSE avg(volume) {_frame(5)} END AS avg5 FROM p)"""


def _rsi_step(p: int) -> str:
    out = []
    for kind, gain in (("u", "up"), ("d", "dn")):
        old = f"r.{kind}{p}"
        out.append(f"CASE WHEN x.i < {p} THEN {old} + x.{gain} WHEN x.i = {p} THEN ({old} + x.{gain}) / {p} ELSE ({old} * {p - 1} + x.{gain}) / {p} END AS {kind}{p}")
    return ", ".join(out)


def indicators(source: str = "d", params: dict[str, str] = DEFAULT) -> str:
    """CTEs up to ind: bars with all indicators, and the gaps of the bar before."""
    one, two = "1.0::DOUBLE", "2.0::DOUBLE"
    rsi_names = ", ".join(f"u{p}, d{p}" for p in RSI)
    rsi_first = ", ".join(f"0.0::DOUBLE AS u{p}, 0.0::DOUBLE AS d{p}" for p in RSI)
    rsis = ", ".join(f"CASE WHEN w.n <= {p} OR w.i < {p} THEN 0 WHEN rec.d{p} = 0 THEN 100 ELSE 100 - 100 / (1 + rec.u{p} / rec.d{p}) END AS rsi_{p}" for p in RSI)
    return f"""{windows(source, params)},
rec AS (
  SELECT code, i, close AS sf, CASE WHEN f = 1 THEN close ELSE 0.0::DOUBLE END AS ef, close AS ss, 0.0::DOUBLE AS es, 0.0::DOUBLE AS dif, 0.0::DOUBLE AS sg, 0.0::DOUBLE AS dea,
    CASE WHEN kn = 1 THEN rsv ELSE 0.0::DOUBLE END AS k, CASE WHEN kn = 1 THEN rsv ELSE 0.0::DOUBLE END AS d, {rsi_first}
  FROM w WHERE i = 0
  UNION ALL
  SELECT code, i, sf, ef, ss, es, dif, sg2, CASE WHEN i < s + g - 2 THEN 0 WHEN i = s + g - 2 THEN sg2 / g ELSE (dif - dea0) * ({two} / (g + 1)) + dea0 END, k2,
    CASE WHEN i < kn - 1 THEN 0 WHEN i = kn - 1 THEN rsv ELSE (1 - {one} / m2) * d0 + ({one} / m2) * k2 END, {rsi_names}
  FROM (SELECT *, CASE WHEN i >= s - 1 AND i <= s + g - 2 THEN sg0 + dif ELSE sg0 END AS sg2
    FROM (SELECT *, CASE WHEN i >= s - 1 THEN ef - es ELSE 0 END AS dif
      FROM (SELECT x.code, x.i, x.s, x.g, x.kn, x.m2, x.rsv, r.sg AS sg0, r.dea AS dea0, r.d AS d0,
          r.sf + x.close AS sf, CASE WHEN x.i < x.f - 1 THEN 0 WHEN x.i = x.f - 1 THEN (r.sf + x.close) / x.f ELSE (x.close - r.ef) * ({two} / (x.f + 1)) + r.ef END AS ef,
          r.ss + x.close AS ss, CASE WHEN x.i < x.s - 1 THEN 0 WHEN x.i = x.s - 1 THEN (r.ss + x.close) / x.s ELSE (x.close - r.es) * ({two} / (x.s + 1)) + r.es END AS es,
          CASE WHEN x.i < x.kn - 1 THEN 0 WHEN x.i = x.kn - 1 THEN x.rsv ELSE (1 - {one} / x.m1) * r.k + ({one} / x.m1) * x.rsv END AS k2, {", ".join(_rsi_step(p) for p in RSI)}
        FROM rec r JOIN w x ON x.code = r.code AND x.i = r.i + 1)))
),
ind0 AS (SELECT w.*, rec.ef AS ema_f, CASE WHEN w.n >= w.s + w.g THEN rec.dif END AS dif, CASE WHEN w.n >= w.s + w.g THEN rec.dea END AS dea, CASE WHEN w.n >= w.s + w.g THEN rec.dif - rec.dea END AS hist,
    CASE WHEN w.n >= w.kn THEN rec.k END AS k, CASE WHEN w.n >= w.kn THEN rec.d END AS d, CASE WHEN w.n >= w.kn THEN 3 * rec.k - 2 * rec.d END AS j, {rsis},
    coalesce(w.diff, 0) AS change, CASE WHEN w.prev > 0 THEN w.diff / w.prev * 100 ELSE 0 END AS change_pct,
    CASE WHEN w.n < 5 THEN 1 WHEN w.avg5 = 0 THEN 0 ELSE w.volume / w.avg5 END AS ratio
  FROM w JOIN rec ON rec.code = w.code AND rec.i = w.i),
ind1 AS (SELECT *, lag(dif - dea) OVER o AS mg, lag(k - d) OVER o AS kg, lag(ma_5 - ma_10) OVER o AS g5, lag(ma_10 - ma_20) OVER o AS g10, lag(ma_20 - ma_60) OVER o AS g20, lag(ma_20, 5) OVER o AS old20,
    sum(CASE WHEN ma_5 > ma_10 AND ma_10 > ma_20 AND ma_20 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY code ORDER BY i ROWS 4 PRECEDING) AS bull,
    sum(CASE WHEN ma_5 < ma_10 AND ma_10 < ma_20 AND ma_20 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY code ORDER BY i ROWS 4 PRECEDING) AS bear
  FROM ind0 WINDOW o AS (PARTITION BY code ORDER BY i)),
tr AS (SELECT code, CASE WHEN n < 20 THEN 'unknown' WHEN bull >= 4 THEN 'up' WHEN bear >= 4 THEN 'down' WHEN ma_20 > 0 AND close > ma_20 AND ma_20 > old20 THEN 'up'
    WHEN ma_20 > 0 AND close < ma_20 AND ma_20 < old20 THEN 'down' ELSE 'sideways' END AS trend FROM ind1 WHERE i = n - 1),
ind AS (SELECT ind1.*, tr.trend, CASE WHEN ratio > 2 THEN 'very_active' WHEN ratio > 1.5 THEN 'active' WHEN ratio < 0.5 THEN 'inactive' ELSE 'normal' END AS activity FROM ind1 JOIN tr USING (code))"""


def cross(gap: str, before: str) -> str:
    return f"CASE WHEN {before} <= 0 AND {gap} > 0 THEN 1 WHEN {before} >= 0 AND {gap} < 0 THEN -1 ELSE 0 END"


MACD_CROSS, KDJ_CROSS = cross("dif - dea", "mg"), cross("k - d", "kg")
MA_CROSS = {(5, 10): cross("ma_5 - ma_10", "g5"), (10, 20): cross("ma_10 - ma_20", "g10"), (20, 60): cross("ma_20 - ma_60", "g20")}


def signals(source: str = "d") -> str:
    """CTEs up to sig (all) and kept (those that the trend lets stay)."""

    def crossed(c: str, indicator: str, details: str, strength: str, detector: int, sub: int) -> str:
        return one(f"{c} <> 0", f"CASE WHEN {c} = 1 THEN '金叉' ELSE '死叉' END", indicator, details, strength, detector, sub)

    def one(when: str, kind: str, indicator: str, details: str, strength: str, detector: int, sub: int) -> str:
        return f"SELECT code, ktype, ts, i, n, trend, {kind} AS type, '{indicator}' AS indicator, {details} AS details, {strength} AS strength, {detector} AS detector, {sub} AS sub FROM ind WHERE {when}"

    parts = [
        crossed(MACD_CROSS, "MACD", "printf('DIF(%.2f) DEA(%.2f)', round(dif, 6), round(dea, 6))", "abs(hist)", 0, 0),
        crossed(KDJ_CROSS, "KDJ", "printf('K(%.2f) D(%.2f) J(%.2f)', round(k, 6), round(d, 6), round(j, 6))", "abs(j - 50) / 50", 1, 0),
        one("j > 100", "'超买'", "KDJ", "printf('J=%.2f', round(j, 6))", "(j - 100) / 100", 1, 1),
        one("j < 0", "'超卖'", "KDJ", "printf('J=%.2f', round(j, 6))", "-j / 100", 1, 2),
        one("close > boll_up AND boll_up > 0", "'突破上轨'", "BOLL", "printf('Close(%.2f) > Upper(%.2f)', round(close, 6), round(boll_up, 6))", "(close - boll_up) / boll_up", 2, 0),
        one("close < boll_low AND boll_low > 0", "'跌破下轨'", "BOLL", "printf('Close(%.2f) < Lower(%.2f)', round(close, 6), round(boll_low, 6))", "(boll_low - close) / boll_low", 2, 1),
    ]
    for sub, ((a, b), c) in enumerate(MA_CROSS.items()):
        parts.append(crossed(c, f"MA{a}/MA{b}", f"printf('MA{a}(%.2f) MA{b}(%.2f)', round(ma_{a}, 6), round(ma_{b}, 6))", "0.5", 3, sub))
    full = "ma_5 <> 0 AND ma_10 <> 0 AND ma_20 <> 0"
    for sub, sign, kind in ((3, ">", "多头排列"), (4, "<", "空头排列")):
        parts.append(one(f"{full} AND ma_5 {sign} ma_10 AND ma_10 {sign} ma_20", f"'{kind}'", "MA", f"printf('MA5(%.2f) {sign} MA10(%.2f) {sign} MA20(%.2f)', round(ma_5, 6), round(ma_10, 6), round(ma_20, 6))", "abs(ma_5 - ma_20) / ma_20", 3, sub))
    for sub, p in enumerate(RSI):
        parts.append(one(f"rsi_{p} > 80", "'超买'", f"RSI{p}", f"printf('RSI{p}=%.2f', round(rsi_{p}, 6))", f"(rsi_{p} - 80) / 20", 4, 2 * sub))
        parts.append(one(f"rsi_{p} < 20 AND rsi_{p} <> 0", "'超卖'", f"RSI{p}", f"printf('RSI{p}=%.2f', round(rsi_{p}, 6))", f"(20 - rsi_{p}) / 20", 4, 2 * sub + 1))
    return f"""{indicators(source)},
sig AS ({" UNION ALL ".join(parts)}),
kept AS (SELECT * FROM sig WHERE NOT (type IN ('金叉', '死叉') AND detector IN (0, 1, 3) AND trend IN ('unknown', 'sideways')))"""


def cycles(source: str = "d") -> str:
    """CTEs up to cyc."""
    kinds = (("MACD", 0, MACD_CROSS), ("KDJ", 1, KDJ_CROSS), ("MA(5,10)", 2, MA_CROSS[5, 10]))
    crosses = " UNION ALL ".join(f"SELECT code, ktype, ts, i, close, '{name}' AS indicator, {rank} AS rank, {c} AS c FROM ind" for name, rank, c in kinds)
    return f"""{indicators(source)},
crosses AS (SELECT * FROM ({crosses}) WHERE c <> 0),
grouped AS (SELECT *, count(*) FILTER (c = -1) OVER (PARTITION BY code, indicator ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM crosses),
pairs AS (SELECT code, ktype, indicator, rank, coalesce(g, 0) AS g, min(i) FILTER (c = 1) AS buy_i, max(i) FILTER (c = -1) AS sell_i FROM grouped GROUP BY code, ktype, indicator, rank, coalesce(g, 0)),
span AS (SELECT *, min(i) OVER (PARTITION BY code, ts::DATE) AS first_i, max(i) OVER (PARTITION BY code, ts::DATE) AS last_i FROM b),
cyc AS (SELECT p.code, p.ktype, p.indicator, p.rank, x.ts AS buy_ts, y.ts AS sell_ts, p.buy_i, p.sell_i, x.close AS buy_price, y.close AS sell_price, (y.close - x.close) / x.close * 100 AS return_pct,
    p.sell_i - x.first_i AS hold_days, x.first_i, y.last_i,
    (SELECT greatest(max((z.close - x.close) / x.close * 100), 0) FROM b z WHERE z.code = p.code AND z.i BETWEEN x.first_i AND y.last_i) AS up,
    (SELECT least(min((z.close - x.close) / x.close * 100), 0) FROM b z WHERE z.code = p.code AND z.i BETWEEN x.first_i AND y.last_i) AS down
  FROM pairs p JOIN span x ON x.code = p.code AND x.i = p.buy_i JOIN span y ON y.code = p.code AND y.i = p.sell_i)"""


def half_away(x: str) -> str:
    return f"(sign({x}) * floor(abs({x} * 100) + 0.5) / 100)"


def with_(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


_EDGES = r"^[\s\v 　﻿]+|[\s\v 　﻿]+$"
SECTIONS = rf"""
WITH raw AS (SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10))) AS raw, unnest(range(len(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10))))) AS pos FROM documents),
l AS (SELECT doc_id, pos, regexp_replace(raw, '{_EDGES}', '', 'g') AS line FROM raw),
k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^\s*[┌├└─┬┼┴┘┐].*─|^\s*─') THEN 'border' WHEN starts_with(line, '│') THEN 'row' WHEN regexp_full_match(line, '【.*】') THEN 'header'
  WHEN regexp_full_match(line, 'https?://\S+') THEN 'link' ELSE 'text' END AS kind FROM l),
c AS (SELECT *, CASE WHEN kind = 'row' THEN list_transform(string_split(line, '│')[2 : len(string_split(line, '│')) - 1], lambda x: trim(x, ' ')) END AS cells FROM k),
g AS (SELECT *, count(*) FILTER (kind IN ('blank', 'header', 'link', 'text')) OVER w AS tb, count(*) FILTER (kind <> 'text') OVER w AS xb FROM c WHERE kind <> 'row' OR len(cells) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
p AS (SELECT doc_id, kind, CASE kind WHEN 'row' THEN tb WHEN 'text' THEN xb ELSE pos END AS g, min(pos) AS first, list(cells ORDER BY pos) AS rows, string_agg(line, chr(10) ORDER BY pos) AS body FROM g WHERE kind IN ('row', 'text', 'header', 'link') GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS seq, CASE kind WHEN 'row' THEN 'table' WHEN 'text' THEN 'paragraph' ELSE kind END AS type, CASE WHEN kind = 'row' THEN to_json(rows)::VARCHAR ELSE '[]' END AS content, CASE WHEN kind = 'row' THEN '' ELSE body END AS text FROM p
"""
