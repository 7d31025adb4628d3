"""Removal of lines that many sites share.

A sketch of the sites of each line says on about how many sites it stands; only where that is near the
threshold are sites counted exactly. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import broadcast_below, reject_clash, stored, text_key, text_or_empty

MIN_SITES = 10
#: A line of these alone is blank, which is no line to judge.
BLANKS = " \t\r\x0b\x0c\u00a0\u3000"
LG_K = 12
#: Relative distance from the threshold below which a sketch's estimate does not decide: over five
#: standard errors of a sketch with 2^12 registers.
MARGIN = 0.1
BROADCAST_ROWS = 200_000


def _lines(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """id and h (which tells apart rows that repeat an id with another text), site, pos and two hashes of
    each line but blank ones, trimmed of spaces; the two together are its 128-bit name."""
    line = F.trim(F.col("line"))
    return (
        reject_clash(docs, key, text, site)
        .select(F.col(key).alias("id"), text_key(text).alias("h"), F.col(site).cast("string").alias("site"), F.posexplode(F.split(text_or_empty(F.col(text)), "\n")).alias("pos", "line"))
        .select("id", "h", "site", "pos", line.alias("line"))
        .where(F.trim("line", F.lit(BLANKS)) != "")
        .select("id", "h", "site", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    )


def spread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """a, b, sites of each line on at least min_sites distinct sites. Lines with fewer rows than that can't
    be among them and go before any sketch is made. Far from the threshold `sites` is an estimate; which
    lines are returned is exact but for estimates off by more than MARGIN."""
    often = stored(lines.groupBy("a", "b").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites).select("a", "b"), "frequent-lines")
    kept = lines.join(broadcast_below(often, BROADCAST_ROWS), ["a", "b"], "left_semi")
    sketched = stored(kept.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites")), "line-sites")
    near = sketched.where(F.abs(F.col("sites") - min_sites) <= F.lit(1 + MARGIN * min_sites)).select("a", "b")
    exact = kept.join(broadcast_below(near, BROADCAST_ROWS), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.countDistinct("site").alias("exact"))
    return (
        sketched.join(exact, ["a", "b"], "left")
        .select("a", "b", F.coalesce("exact", "sites").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )


def boilerplate_places(docs: DataFrame, min_sites: int = MIN_SITES, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """id, h and the positions of the lines to remove from that text. The first row in order of (id, h, pos)
    that holds a line keeps it, so no line is lost from the corpus."""
    lines = stored(_lines(docs, key, text, site), "lines")
    wide = stored(spread(lines, min_sites), "boilerplate")
    where = lines.join(broadcast_below(wide, BROADCAST_ROWS), ["a", "b"])
    first = where.groupBy("a", "b").agg(F.min(F.struct("id", "h", "pos")).alias("first"))
    return (
        where.join(broadcast_below(stored(first, "first-places"), BROADCAST_ROWS), ["a", "b"])
        .where(~F.struct("id", "h", "pos").eqNullSafe(F.col("first")))
        .groupBy("id", "h")
        .agg(F.collect_set("pos").alias("gone"))
    )


def _without(text: Column, gone: Column) -> Column:
    """The text's lines but for the positions in gone. The split lines become a lambda's variable, so that
    a text is split once and not for each line."""

    def kept(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    return F.transform(F.array(F.split(text, "\n")), kept)[0]


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """docs with all its columns and rows; text has lost every line that stands on min_sites or more sites,
    but for that line's first place. n_lines_removed says how many went.

    Lines of any length are compared, without surrounding spaces; blank ones stay. Null texts stay null. A null site counts as none. Rows repeated with the same id and text lose the same lines.
    An input column of the name n_lines_removed is replaced."""
    # What goes grows with the documents, so both sides shuffle at any size.
    gone = boilerplate_places(docs, min_sites, key, text, site)
    met = docs.join(gone, docs[key].eqNullSafe(gone["id"]) & (text_key(docs[text]) == gone["h"]), "left")
    cleaned = F.when(gone["gone"].isNull(), docs[text]).otherwise(_without(docs[text], gone["gone"]))
    columns = [cleaned.alias(text) if c == text else docs[c] for c in docs.columns if c != "n_lines_removed"]
    return met.select(*columns, F.when(gone["gone"].isNull(), 0).otherwise(F.size(gone["gone"])).cast("long").alias("n_lines_removed"))


def op10_distinct_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_boilerplate(docs).select("doc_id", "n_lines_removed", F.char_length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))
