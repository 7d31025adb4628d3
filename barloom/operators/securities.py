"""Listings: classes, categories, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.codes import add_prefix, in_category, is_etf, is_stock, security_class

UNKNOWN_NAME = "未知"


def codes_list(listed: DataFrame, category: str = "", stocks_only: bool = False) -> DataFrame:
    out = listed.where(in_category(F.col("code"), category))
    return out.where(is_stock(F.col("code"))) if stocks_only else out


def codes_stats(listed: DataFrame) -> DataFrame:
    """How many codes of each class each exchange lists, and in all (class "total")."""
    rolled = listed.select("exchange", security_class(F.col("code")).alias("class")).rollup("exchange", "class").count()
    return rolled.where(F.col("exchange").isNotNull()).select("exchange", F.coalesce("class", F.lit("total")).alias("class"), F.col("count").alias("n"))


def flags(listed: DataFrame) -> DataFrame:
    return listed.select("code", is_stock(F.col("code")).alias("is_stock"), is_etf(F.lower(add_prefix(F.col("code")))).alias("is_etf"))


def search(listed: DataFrame, text: str, n: int = 20) -> DataFrame:
    """The first n codes, in order, that hold the text in code or name, whatever its case."""
    hit = F.col("code").contains(text) | F.lower("name").contains(text.lower())
    return listed.where(hit).orderBy("code", "name").limit(n)


def well_formed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("code").rlike("^[0-9]{6}$"))


def without(rows: DataFrame, held: DataFrame) -> DataFrame:
    """rows whose code is not held yet."""
    return rows.join(held.select("code").distinct(), "code", "left_anti")
