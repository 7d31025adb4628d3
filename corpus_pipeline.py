"""The corpus pipeline: stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, langid, line_dedup, minhash, packing
from barloom.llm.common import broadcast_below, remove, scratch, stored, stored_at, text_key

#: Rejected ids are broadcast up to so many; beyond it both sides of the join shuffle.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs but for the rows whose id, which may be null, and text are among the rejected (doc_id, h); a row
    that repeats a rejected one's id with another text stays."""
    gone = stored(rejected.select(F.col("doc_id").alias("_gone"), F.col("h").alias("_h")).distinct(), "rejected")
    gone = broadcast_below(gone, BROADCAST_IDS)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]) & (text_key(docs["text"]) == gone["_h"]), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language of the corpus, by a model of the pages' texts."""
    model = langid.fit_on_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = langid.identify(docs, model, "doc_id", "text", F.col("lang"), F.col("source"))
    return _without(docs, found.where(~F.col("accepted")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that many sites share from all but their first document, and documents left without
    any text by that."""
    out = line_dedup.remove_boilerplate(docs)
    left = out.where((F.col("n_lines_removed") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies."""
    found = stored(minhash.near_duplicates(docs), "near-copies")
    kept = _without(docs, found.where(~F.col("kept")))
    repeated = not found.where("kept").groupBy("doc_id").count().where("count > 1").isEmpty()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark items make up a twentieth or more of."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(docs, keep=300_000)  # the executors have four stages behind them


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("decontamination", decontamination), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stored on its way goes once its result is written, and that result once
    the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch():
            docs, path = stored_at(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            remove(before)
        before = path
    return docs
