"""The engine's input tables, made from the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.deploy import ship
from barloom.functions.codes import add_prefix, lookup
from barloom.sources.bars import TICKS_PAGE, from_trades

CODES = {"1-URGENT": "600001", "2-HIGH": "002001", "3-MEDIUM": "300003", "4-NOT SPECIFIED": "000001", "5-LOW": "688005"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of five codes, from orders."""
    code = lookup(F.col("o_orderpriority"), CODES, F.lit(None))
    return from_trades(table(spark, sf_dir, "orders"), code, F.col("o_orderdate"), F.col("o_totalprice"), F.lit(1), F.col("o_orderkey"), "day", 9)


def bars_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of five codes, from events."""
    return from_trades(table(spark, sf_dir, "events"), F.col("event_type"), F.col("ts"), F.col("value"), F.lit(1), F.col("event_id"), "60m", 3)


def bars_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of many codes, from lineitem; the order of a day's trades ends with the price, as their keys
    repeat."""
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100.0
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", price)
    return from_trades(table(spark, sf_dir, "lineitem"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"), F.col("l_shipdate"), price, F.col("l_quantity"), order, "day", 9, F.col("l_extendedprice"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("code"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), k.alias("volume"), (F.col("event_id") % 2).cast("int").alias("status"), "user_id"
    )


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("p_partkey") * 48271) % 1000000
    code = F.lpad(number.cast("string"), 6, "0")
    full = add_prefix(code)
    return table(spark, sf_dir, "part").select(F.when(F.length(full) == 8, full.substr(1, 2)).otherwise("").alias("exchange"), code.alias("code"), F.col("p_name").alias("name"), "p_partkey")


def block_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of blocks by brand, by type, and by size, whose names are of digits alone."""
    part = table(spark, sf_dir, "part").withColumn("code", F.lpad(((F.col("p_partkey") * 48271) % 1000000).cast("string"), 6, "0"))
    names = F.explode(F.array("p_brand", "p_type", F.col("p_size").cast("string")))
    return part.select(F.lit("block").alias("file"), names.alias("block_name"), (F.col("p_size") % 4).alias("block_type"), F.col("code").alias("stock_code"), F.col("p_partkey").alias("seq"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and volume of each minute of trading that has events, by type and day."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    rows = ticks(spark, sf_dir).withColumns({"day": F.to_date("ts"), "minute": minute}).where(minute.between(570, 690) | minute.between(780, 900))
    return rows.groupBy("code", "day", "minute").agg(F.max_by("price", "seq").alias("price"), F.sum("volume").alias("volume"))


def last_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last price before each day on which a code has events."""
    days = ticks(spark, sf_dir).withColumn("day", F.to_date("ts")).groupBy("code", "day").agg(F.max_by("price", "seq").alias("close"))
    return days.select("code", "day", F.coalesce(F.lag("close").over(Window.partitionBy("code").orderBy("day")), F.lit(0.0)).alias("last_close"))


def raw_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("code"), F.to_date("ts").alias("date"), (F.col("event_id") % 14 + 1).cast("int").alias("category"), v.alias("a"), (v * 2).alias("b"), (v * 3).alias("c"), (v * 4).alias("d"), "event_id"
    )


def finance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), (F.abs("s_acctbal") * 1e4).alias("float_shares"))


def _two_bytes(n):
    """16 bits, least byte first."""
    whole = F.unhex(F.lpad(F.hex(n), 4, "0"))
    return F.concat(F.substring(whole, 2, 1), F.substring(whole, 1, 1))


def _zeros(n: int):
    return F.unhex(F.lit("00" * n))


def block_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each block whose name fits a record's nine bytes: its members in order, up to 399 a record, in
    as many records as they take."""
    order = Window.partitionBy("block_name").orderBy("seq")
    fits = block_members(spark, sf_dir).where(F.octet_length("block_name").between(1, 9))
    rows = fits.withColumns({"nth": F.floor((F.row_number().over(order) - 1) / 399), "kind": F.first("block_type").over(order)})
    codes = F.transform(F.array_sort(F.collect_list(F.struct("seq", "stock_code"))), lambda m: F.concat(F.encode(m["stock_code"], "US-ASCII"), _zeros(1)))
    of = rows.groupBy("block_name", "nth").agg(F.first("kind").alias("kind"), F.count(F.lit(1)).alias("n"), codes.alias("codes"))
    body = F.aggregate("codes", _zeros(0), lambda a, x: F.concat(a, x))
    record = F.concat(_zeros(2), F.rpad(F.encode("block_name", "US-ASCII"), F.lit(9), _zeros(1)), _two_bytes(F.col("n")), _two_bytes(F.col("kind")), body)
    records = of.select("block_name", "nth", F.hex(F.rpad(record, F.lit(2813), _zeros(1))).alias("record"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "record"))), lambda r: r["record"]), "")
    return records.groupBy("block_name").agg(whole.alias("records")).select(F.concat(_zeros(384), F.unhex("records")).alias("content"))


def with_pages(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Adds page: which of the responses, of so many records each, a row of its group stands in. A response counts its
    records and its bytes in 16 bits each."""
    return rows.withColumn("page", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / TICKS_PAGE).cast("int"))


def over_pages(raw: DataFrame) -> DataFrame:
    """Decoded records, numbered by seq through all pages of their group."""
    kind = dict(raw.dtypes)["seq"]
    return raw.withColumn("seq", F.col("seq") + F.col("page").cast(kind) * TICKS_PAGE).drop("page")


def tick_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, day, page and msg_id of each response of tick_captures(). Messages are numbered without a gap over a table
    that has a row for each code and day."""
    counts = ticks(spark, sf_dir).groupBy("code", F.to_date("ts").alias("day")).agg(F.ceil(F.count(F.lit(1)) / TICKS_PAGE).alias("pages"))
    upto = F.sum("pages").over(Window.orderBy("code", "day"))
    each = counts.select("code", "day", (upto - F.col("pages")).alias("first"), F.explode(F.sequence(F.lit(0), F.col("pages").cast("int") - 1)).alias("page"))
    return each.select("code", "day", "page", (F.col("first") + F.col("page")).alias("msg_id"))


def tick_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of each code's and day's trades, a page of them in each, as a compressed response whose msg_id tells code,
    day and page, as tick_requests() does. Prices go on from the page before."""
    import struct
    import zlib

    import pandas as pd

    from barloom.sources.wire import RESPONSE_PREFIX, encode_varint

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, body = rows.sort_values("seq"), [struct.pack("<HI", len(rows), 0)]
        for minute, delta, size, status in zip(rows["minute"], rows["delta"], rows["volume"], rows["status"], strict=True):
            hour, rest = divmod(int(minute), 60)
            body += [bytes([hour // 10 << 4 | hour % 10, rest // 10 << 4 | rest % 10]), *map(encode_varint, (int(delta), int(size), int(status)))]
        body = b"".join([*body, bytes(8)])
        data = zlib.compress(body)
        data = body if len(data) == len(body) else data
        return pd.DataFrame({"code": [key[0]], "day": [key[1]], "page": [key[2]], "data": [RESPONSE_PREFIX + struct.pack("<BIBHHH", 12, rows["msg_id"].iloc[0], 0, 1, len(data), len(body)) + data]})

    ship(spark)
    rows = ticks(spark, sf_dir).withColumn("day", F.to_date("ts")).select("code", "day", "seq", (F.hour("ts") * 60 + F.minute("ts")).alias("minute"), F.round(F.col("price") * 100).cast("long").alias("cents"), "volume", "status")
    rows = with_pages(rows, ("code", "day"), "seq").withColumn("delta", F.col("cents") - F.lag("cents", 1, 0).over(Window.partitionBy("code", "day").orderBy("seq"))).drop("cents")
    rows = rows.join(tick_requests(spark, sf_dir), ["code", "day", "page"])
    return rows.groupBy("code", "day", "page").applyInPandas(pack, "code string, day date, page int, data binary")
