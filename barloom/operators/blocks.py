"""Sector blocks and their members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.codes import exchange_label, is_stock
from barloom.operators.screen import named
from barloom.operators.securities import UNKNOWN_NAME


def valid_name(name: Column) -> Column:
    """Not empty, and not of digits alone."""
    return F.coalesce(name.rlike("[^0-9]"), F.lit(False))


def grouped(members: DataFrame) -> DataFrame:
    """One row a block name: the type of its first member, members in order, their number with repeats. A
    block file's list of a block is short (a few thousand at most by its format)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "stock_code"))), lambda m: m["stock_code"])
    return members.groupBy("block_name").agg(F.min_by("block_type", "seq").alias("block_type"), F.count(F.lit(1)).alias("n"), listed.alias("codes"))


def block_list(members: DataFrame, block_type: str | None = None) -> DataFrame:
    """Blocks with a valid name, of a type if one is named, by size; equal sizes go by name. The sample has
    the first three members."""
    sizes = members.where(valid_name(F.col("block_name"))).groupBy("block_name").agg(
        F.min_by("block_type", "seq").alias("block_type"), F.count(F.lit(1)).alias("n")
    )
    return (sizes.where(F.col("block_type").cast("string") == block_type) if block_type else sizes).orderBy(F.col("n").desc(), "block_name")


def samples(members: DataFrame, n: int = 3) -> DataFrame:
    """The first members of each block as text, with "..." if it has more. Only those are gathered."""
    from pyspark.sql.window import Window

    numbered = members.withColumns({"r": F.row_number().over(Window.partitionBy("block_name").orderBy("seq"))}).where(F.col("r") <= n + 1)
    first = F.transform(F.array_sort(F.collect_list(F.struct("r", "stock_code"))), lambda m: m["stock_code"])
    return numbered.groupBy("block_name").agg(first.alias("f")).select(
        "block_name", F.concat(F.array_join(F.slice("f", 1, n), ", "), F.when(F.size("f") > n, "...").otherwise("")).alias("sample")
    )


def containing(members: DataFrame, code: str) -> DataFrame:
    """Names of the valid blocks that hold a code."""
    return members.where((F.col("stock_code") == code) & valid_name(F.col("block_name"))).select("block_name").distinct()


def of_codes(members: DataFrame, codes: DataFrame) -> DataFrame:
    """Members of all blocks that hold any of the codes."""
    held = members.join(codes.select(F.col("code").alias("stock_code")), "stock_code", "left_semi").select("block_name").distinct()
    return members.join(held, "block_name", "left_semi")


def matching(members: DataFrame, text: str) -> DataFrame:
    """Names that contain the text."""
    return members.where(valid_name(F.col("block_name")) & F.col("block_name").contains(text)).select("block_name").distinct()


def show(members: DataFrame, text: str, names: DataFrame, stocks_only: bool = False) -> DataFrame:
    """block_name, seq, code, name, exchange: if the text names one block, its members; if several, a row for each of
    those blocks with nulls but for its name; if none, nothing. An exact name counts as the one. At most two names come
    to the driver."""
    found = matching(members, text)
    exact = found.where(F.col("block_name") == text)
    few = exact.take(1) or found.take(2)
    if len(few) != 1:
        nothing = {"seq": members.schema["seq"].dataType.simpleString(), "code": "string", "name": "string", "exchange": "string"}
        return found.select("block_name", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    own = members.where(F.col("block_name") == few[0].block_name)
    own = own.where(is_stock(F.col("stock_code"))) if stocks_only else own
    return with_names(own, names)


def with_names(members: DataFrame, names: DataFrame) -> DataFrame:
    rows = named(members.withColumnRenamed("stock_code", "code"), names, "left")
    return rows.select("block_name", "seq", "code", F.coalesce("name", F.lit(UNKNOWN_NAME)).alias("name"), exchange_label(F.col("code")).alias("exchange"))
