"""Decoders for captured responses and block files: binary columns in, rows out.

A capture is a row with its bytes; Spark deals them out and each is decoded on its own, so only the bytes of
one response are held at a time. What follows the raw integers (running sums, times, exchanges) is left to
column expressions."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.deploy import ship
from barloom.functions.values import packed_day, packed_minute

#: Fixed values of the formats.
RESPONSE_PREFIX = bytes.fromhex("b1cb7400")
MINUTE_KTYPES = (0, 1, 2, 3, 7, 8)
BLOCK_HEADER, BLOCK_RECORD, BLOCK_CODES, BLOCK_CODE = 384, 2813, 15, 7


def signed_varint(data: bytes, at: int) -> tuple[int, int]:
    """A number and where the next begins: six bits and a sign in the first byte, seven in each further one, the
    top bit set on all but the last. Data that ends within a number gives 0 and its end."""
    value, shift = 0, 0
    for k in range(at, len(data)):
        byte = data[k]
        value |= (byte & (0x3F if k == at else 0x7F)) << shift
        shift += 6 if k == at else 7
        if byte < 0x80:
            return (-value if data[at] & 0x40 else value), k + 1
    return 0, len(data)


def encode_varint(value: int) -> bytes:
    """The shortest form of a number that signed_varint() reads."""
    rest, first = abs(value) >> 6, (abs(value) & 0x3F) | (0x40 if value < 0 else 0)
    out = [first | (0x80 if rest else 0)]
    while rest:
        out.append((rest & 0x7F) | (0x80 if rest >> 7 else 0))
        rest >>= 7
    return bytes(out)


def volume(code: Column, unit: int = 64) -> Column:
    """A volume from its 32 bits: the top byte is a doubled exponent, the others parts of its power. unit says
    what the second byte's lower bits count when it is above 128: 64ths in bars, 128ths in corporate actions."""
    c = F.when(code >= 1 << 31, code - (1 << 32)).otherwise(code).cast("long")
    power = F.pow(F.lit(2.0), F.shiftright(c, 24) * 2 - 0x7F)
    second, third, last = (F.shiftright(c, n).bitwiseAND(F.lit(0xFF)) for n in (16, 8, 0))
    fine = F.when(second.bitwiseAND(F.lit(0x80)) != 0, 2.0).otherwise(1.0)
    most = F.when(second > 0x80, power * (64.0 + second.bitwiseAND(F.lit(0x7F)) * (64.0 / unit)) / 64.0).otherwise(power * second / 128.0)
    return power + most + power * third / 32768.0 * fine + power * last / 8388608.0 * fine


#: Decoded rows that are handed on together, at most.
_ROWS = 20_000


def _each(rows: DataFrame, data: str, schema: str, decode: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """rows without `data`, each as often as decode() has rows for it, with those rows' columns. Bytes that
    don't follow the format give the rows before they stop to."""
    ship(rows.sparkSession)
    names = [c.strip().split()[0] for c in schema.split(",")]
    kept = [c for c in rows.columns if c != data]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            of, found = [], []

            def made(of=of, found=found, batch=batch) -> pd.DataFrame:
                return pd.concat([batch[kept].iloc[of].reset_index(drop=True), pd.DataFrame(found, columns=names)], axis=1)

            for i, raw in enumerate(batch[data]):
                for own in decode(bytes(raw)) if raw is not None else ():
                    of.append(i)
                    found.append(own)
                    if len(found) >= _ROWS:  # rows of large responses don't pile up
                        yield made()
                        of.clear()
                        found.clear()
            if found:
                yield made()

    head = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != data)
    return rows.mapInPandas(run, f"{head}, {schema}" if head else schema)


def frames(rows: DataFrame, data: str = "data") -> DataFrame:
    """The responses in each capture: seq, control, msg_id, type, body. Bytes between responses are skipped;
    bodies are inflated where the header says so, and responses whose lengths don't agree are left out."""

    def decode(raw: bytes) -> Iterator[tuple]:
        at, seq = 0, 0
        while (at := raw.find(RESPONSE_PREFIX, at)) >= 0 and at + 16 <= len(raw):
            control, msg_id, _, kind, packed, size = struct.unpack_from("<BIBHHH", raw, at + 4)
            body = raw[at + 16 : at + 16 + packed]
            at += 16 + packed
            if len(body) < packed:
                return
            if packed != size:
                try:
                    body = zlib.decompress(body)
                except zlib.error:
                    continue
            if len(body) == size:
                yield seq, control, msg_id, kind, body
                seq += 1

    return _each(rows, data, "seq int, control int, msg_id long, type int, body binary", decode)


class _Reader:
    """Takes values off the front of bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def left(self) -> int:
        return len(self.data) - self.at

    def varints(self, n: int) -> list[int]:
        out = []
        for _ in range(n):
            value, self.at = signed_varint(self.data, self.at)
            out.append(value)
        return out

    def fixed(self, form: str) -> tuple:
        out = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return out


_COUNT = struct.Struct("<H")


def _count(raw: bytes, at: int = 0) -> range:
    return range(_COUNT.unpack_from(raw, at)[0]) if len(raw) >= at + 2 else range(0)


def raw_bars(rows: DataFrame, data: str = "body", breadth: bool = False) -> DataFrame:
    """Bars as they stand in responses: seq, when, four differences in thousandths, two encoded volumes; with
    breadth, as an index has it, the numbers of members that rose and fell."""
    form, names = ("<IIHH", ", up_count int, down_count int") if breadth else ("<II", "")

    def decode(raw: bytes) -> Iterator[tuple]:
        r = _Reader(raw, 2)
        for seq in _count(raw):
            if r.left() < 12:
                return
            when, deltas = r.fixed("<I")[0], r.varints(4)
            if r.left() < struct.calcsize(form):
                return
            yield seq, when, *deltas, *r.fixed(form)

    return _each(rows, data, "seq int, when long, open_delta long, close_delta long, high_delta long, low_delta long, volume_code long, amount_code long" + names, decode)


def bars(raw: DataFrame, keys: tuple[str, ...] = ("code", "ktype")) -> DataFrame:
    """Bars from raw ones: running sums of the differences, times by ktype, volumes. An index's keep their
    breadth, and their volumes are not in hundreds."""
    from barloom.operators.intraday import undelta_bars

    prices = undelta_bars(raw, keys=keys)
    breadth = [c for c in ("up_count", "down_count") if c in raw.columns]
    when, ktype = F.col("when"), F.col("ktype")
    ts = F.when(ktype.isin(*MINUTE_KTYPES), packed_minute(when % 65536, F.floor(when / 65536))).otherwise(packed_day(when))
    size = volume(F.col("volume_code")) / (F.lit(1.0) if breadth else F.when((ktype <= 6) | (ktype == 8), 100.0).otherwise(1.0))
    rest = raw.select(*keys, "seq", F.when(when > 0, ts).alias("ts"), size.alias("volume"), (volume(F.col("amount_code")) / 100).alias("amount"), *breadth)
    return prices.join(rest, [*keys, "seq"]).select(*keys, "ts", "open", "high", "low", "close", "volume", "amount", *breadth)


def raw_ticks(rows: DataFrame, data: str = "body") -> DataFrame:
    """Trades as they stand in responses: seq, minute of the day (from decimal digits of hour and minute, four
    bits each), price difference in hundredths, volume, status."""

    def digits(b: int) -> int:
        return (b >> 4) * 10 + (b & 15)

    def decode(raw: bytes) -> Iterator[tuple]:
        r = _Reader(raw, 6)
        for seq in _count(raw):
            if r.left() < 8:
                return
            hour, minute = r.fixed("<BB")
            yield seq, digits(hour) * 60 + digits(minute), *r.varints(3)

    return _each(rows, data, "seq int, minute int, price_delta long, volume long, status int", decode)


def raw_minutes(rows: DataFrame, data: str = "body") -> DataFrame:
    """A day's minute line as it stands in responses: seq, price difference, the divisor of prices, volume."""

    def decode(raw: bytes) -> Iterator[tuple]:
        if len(raw) < 6:
            return
        r, divisor = _Reader(raw, 6), 100.0 if raw[5] > 0x40 else 1000.0
        for seq in _count(raw):
            if not r.left():
                return
            delta, _, size = r.varints(3)
            yield seq, delta, divisor, size

    return _each(rows, data, "seq int, price_delta long, divisor double, number long", decode)


def minutes(raw: DataFrame, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """time and price of raw minutes."""
    from barloom.operators.intraday import minute_labels, undelta

    return minute_labels(undelta(raw, "price_delta", 1.0, keys), keys).select(*keys, "seq", "time", (F.col("value") / F.col("divisor")).alias("price"), "number")


def raw_quotes(rows: DataFrame, data: str = "body") -> DataFrame:
    """Quotes as they stand in responses: prices in hundredths (all but the last one relative to it), volumes,
    an encoded amount, and five levels of (bid, ask, bid volume, ask volume), prices relative likewise."""

    def decode(raw: bytes) -> Iterator[tuple]:
        r = _Reader(raw, 4)
        for _ in _count(raw, 2):
            if r.left() < 9:
                return
            code = raw[r.at + 1 : r.at + 7].decode("ascii", "replace")
            r.at += 9
            prices, (_, _, hand, _) = r.varints(5), r.varints(4)
            amount = r.fixed("<I")[0] if r.left() >= 4 else 0
            sold, bought, _, _ = r.varints(4)
            levels = [r.varints(4) for _ in range(5) if r.left()]
            r.at = min(r.at + 2, len(raw))
            r.varints(4)
            r.at = min(r.at + 4, len(raw))
            yield code, *prices, hand, amount, sold, bought, levels

    schema = "quoted string, price_cents long, last_delta long, open_delta long, high_delta long, low_delta long, hand long, amount_code long, s_vol long, b_vol long, levels array<array<bigint>>"
    return _each(rows, data, schema, decode)


def quotes(raw: DataFrame) -> DataFrame:
    p = F.col("price_cents")
    level = F.transform("levels", lambda x: F.struct(((p + x[0]) / 100).alias("bid_price"), ((p + x[1]) / 100).alias("ask_price"), x[2].alias("bid_volume"), x[3].alias("ask_volume")))
    deltas = {"last_close": "last_delta", "open": "open_delta", "high": "high_delta", "low": "low_delta"}
    return raw.select(
        F.col("quoted").alias("code"), (p / 100).alias("price"), *[((p + F.col(d)) / 100).alias(k) for k, d in deltas.items()], F.col("hand").cast("double").alias("volume"),
        F.when(F.col("amount_code") > 0, volume(F.col("amount_code")) / 10000).otherwise(0.0).alias("amount"), "s_vol", "b_vol", level.alias("bid_ask"),
    )


#: Layouts of responses that are a count and records of one size. Where the count stands, the
#: record's form, and its columns.
RECORDS = {
    "securities": (0, "<6s2x8s13x", "code binary, name binary"),
    "auctions": (0, "<HfIh3xB", "minute int, price double, match long, unmatched long, second int"),
    "company_toc": (0, "<64s80sII", "name binary, filename binary, start long, length long"),
    "corp_actions": (9, "<8xIB16s", "day long, category int, numbers binary"),
}
#: A financial snapshot, which begins at byte 9.
FINANCE_FORM, FINANCE_AT = "<fHHII30f", 9
FINANCE = (
    "float_shares province industry updated ipo total_shares state_shares founder_shares legal_shares b_shares h_shares staff_shares total_assets current_assets fixed_assets intangible_assets holders "
    "current_debt long_debt capital_reserve net_assets main_income main_profit receivables operating_profit investment_income operating_cash total_cash inventory profit_total profit_after_tax net_profit "
    "retained_profit net_assets_per_share reserved"
).split()


def records(rows: DataFrame, kind: str, data: str = "body") -> DataFrame:
    """Records of one of RECORDS. Texts stay bytes; text_of() reads them."""
    at, form, schema = RECORDS[kind]
    size = struct.calcsize(form)

    def decode(raw: bytes) -> Iterator[tuple]:
        r = _Reader(raw, at + 2)
        for _ in _count(raw, at):
            if r.left() < size:
                return
            yield tuple(x.partition(b"\0")[0] if isinstance(x, bytes) and kind != "corp_actions" else x for x in r.fixed(form))

    return _each(rows, data, schema, decode)


def finance(rows: DataFrame, data: str = "body") -> DataFrame:
    whole = {"province", "industry", "updated", "ipo"}

    def decode(raw: bytes) -> Iterator[tuple]:
        if len(raw) >= FINANCE_AT + struct.calcsize(FINANCE_FORM):
            yield struct.unpack_from(FINANCE_FORM, raw, FINANCE_AT)

    return _each(rows, data, ", ".join(f"{c} {'long' if c in whole else 'double'}" for c in FINANCE), decode)


def _little(number: Column, at: int) -> Column:
    """The unsigned 32 bits at a place of binary data, least byte first."""
    return F.conv(F.hex(F.concat(*[F.substring(number, at + k, 1) for k in (4, 3, 2, 1)])), 16, 10).cast("long")


def corp_actions(raw: DataFrame) -> DataFrame:
    """Numbers a to d of raw corporate actions: singles for the categories whose numbers are ratios or prices,
    else encoded share counts. routed_actions() names them."""
    bits = [_little(F.col("numbers"), at) for at in (0, 4, 8, 12)]
    ratios = F.col("category").isin(1, 11, 12, 13, 14)
    day = F.make_date(F.floor(F.col("day") / 10000).cast("int"), F.floor(F.col("day") % 10000 / 100).cast("int"), (F.col("day") % 100).cast("int"))
    named = [F.when(ratios, _single(b)).otherwise(volume(b, 128)).alias(c) for b, c in zip(bits, "abcd", strict=True)]
    return raw.select(*[c for c in raw.columns if c not in ("day", "category", "numbers")], day.alias("date"), "category", *named)


def _single(bits: Column) -> Column:
    """An IEEE single from its 32 bits, finite ones."""
    sign = F.when(bits >= 1 << 31, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(bits, 23).bitwiseAND(F.lit(0xFF)), bits.bitwiseAND(F.lit(0x7FFFFF)) / float(1 << 23)
    return sign * F.when(exponent == 0, fraction * 2.0**-126).otherwise((1.0 + fraction) * F.pow(F.lit(2.0), exponent - 127))


def block_members(rows: DataFrame, data: str = "content") -> DataFrame:
    """Members in block files: block_name (GBK bytes as they stand), block_type, stock_code, seq."""

    def cut(raw: bytes) -> bytes:
        return raw.partition(b"\0")[0]

    def decode(raw: bytes) -> Iterator[tuple]:
        seq = 0
        for base in range(BLOCK_HEADER, len(raw) - BLOCK_RECORD + 1, BLOCK_RECORD):
            count, kind = struct.unpack_from("<HH", raw, base + 11)
            name = cut(raw[base + 2 : base + 11])
            for j in range(min(count, (BLOCK_RECORD - BLOCK_CODES) // BLOCK_CODE) if name else 0):
                code = cut(raw[base + BLOCK_CODES + j * BLOCK_CODE :][:BLOCK_CODE])
                if not code:
                    break
                yield name, kind, code.decode("ascii", "replace"), seq
                seq += 1

    return _each(rows, data, "block_name binary, block_type int, stock_code string, seq long", decode)


def read_block_files(spark: SparkSession, path: str) -> DataFrame:
    """Members in all block files of a folder, with each file's path; names are decoded from GBK."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return block_members(files).withColumn("block_name", text_of(F.col("block_name")))


def text_of(data: Column) -> Column:
    """Text from GBK bytes, in Arrow batches: Spark 4 decodes GBK natively only under a legacy setting."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode("gbk", "replace").replace("\0", ""))

    return decode(data)


def jsonp(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """The JSON within a callback's parentheses, parsed by a schema."""
    return rows.withColumn("parsed", F.from_json(F.regexp_extract(column, r"(?s)^[^(]*\((.*)\)\s*;?\s*$", 1), schema))


def varints(rows: DataFrame, data: str = "body") -> DataFrame:
    """The numbers that binary data is made of, in order: seq, value."""

    def decode(raw: bytes) -> Iterator[tuple]:
        r, seq = _Reader(raw), 0
        while r.left():
            yield seq, *r.varints(1)
            seq += 1

    return _each(rows, data, "seq long, value long", decode)


def byte_range(content: Column, start: Column, length: Column) -> Column:
    """Bytes of a file's content from 0-based start."""
    return F.substring(content, start + 1, length)
