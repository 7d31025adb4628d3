"""Secret scans with an incremental ledger of blobs.

Every version of a text is a blob, named by its SHA-256. A ledger keeps which blobs each version of the
rules has been over and what it found; a scan reads only pairs of blob and rule version that the ledger
lacks, and findings join back to every document that holds the blob."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import reject_clash, shared_folder, small_enough, stored, text_or_empty


@dataclass(frozen=True)
class Rule:
    """pattern: a Java regular expression. Matches are the leftmost ones that don't overlap; one counts if
    its `group` (0: all of it) has `least` characters. probe: found in any text with a match that counts,
    and cheaper to look for."""

    kind: str
    pattern: str
    group: int
    least: int
    probe: str = ""


#: The kinds of the base rules, in their order, with patterns and lengths.
BASE_RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, probe=r"[0-9a-f]{24}"),
)
BASE_VERSION = "base-1"

#: Unseen digests are broadcast up to so many.
BROADCAST_BLOBS = 200_000

FINDINGS = "blob binary, rule_version string, kind_rank int, kind string, start long, end long"
SCANNED = "blob binary, rule_version string"
PATHS = "key long, blob binary, version string"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _may_match(rule: Rule) -> Column:
    return F.col("text").rlike(rule.probe or rule.pattern)


def _matches(rule: Rule) -> Column:
    """Array of (gap before the match, match, counted part) by one anchored pattern: \\G makes each match
    begin where the last ended, the lazy gap finds the leftmost next one."""
    whole = F.lit(rf"(?s)\G(.*?)({rule.pattern})")
    part = F.regexp_extract_all("text", whole, F.lit(rule.group + 2 if rule.group else 2))
    return F.arrays_zip(
        F.transform(F.regexp_extract_all("text", whole, F.lit(1)), F.char_length).alias("gap"),
        F.transform(F.regexp_extract_all("text", whole, F.lit(2)), F.char_length).alias("length"),
        F.transform(part, F.char_length).alias("part"),
    )


def find(blobs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """blob, kind_rank, kind, start, end of each match that counts, over (blob, text) with a row for each copy.
    Offsets are in code points, the end exclusive. Texts without a possible match stop at the filter, so only the
    others are shuffled, for copies to merge."""
    may = reduce(or_, map(_may_match, rules))
    # With a mark of unseen blobs the filter waits for the join that gives it.
    possible = blobs.where(F.when(F.col("unseen"), may) if "unseen" in blobs.columns else may).groupBy("blob").agg(F.first("text").alias("text"))
    kinds = F.array(*[F.struct(F.lit(i).alias("kind_rank"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), F.when(_may_match(r), _matches(r)).alias("found")) for i, r in enumerate(rules)])
    each = possible.select("blob", F.explode(kinds).alias("k")).select("blob", "k.kind_rank", "k.kind", "k.least", F.posexplode("k.found").alias("nth", "m"))
    upto = Window.partitionBy("blob", "kind_rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum((F.col("m.gap") + F.col("m.length")).cast("long")).over(upto))
    return placed.where(F.col("m.part") >= F.col("least")).select("blob", "kind_rank", "kind", (F.col("end") - F.col("m.length")).alias("start"), "end")


class Ledger:
    """Three Parquet tables below path: which text each version of a corpus has where, pairs of blob and rule version
    that have been scanned, and findings. Findings are written first; if a run ends between the two, the next scans
    those blobs again and distinct() makes the findings one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._table("scanned", SCANNED)

    def findings(self, rule_version: str) -> DataFrame:
        return self._table("findings", FINDINGS).where(F.col("rule_version") == rule_version).distinct()

    def paths(self, version: str | None = None) -> DataFrame:
        """version, key, blob: a row for each row that a version of the corpus had."""
        held = self._table("paths", PATHS)
        return held if version is None else held.where(F.col("version") == version)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, rule_version: str = BASE_VERSION, key: str = "doc_id", text: str = "text", version: str | None = None) -> str:
        """Brings the ledger up to date with docs, a version of the corpus, whose name is returned. Digests alone tell
        what is unseen. Of what is unseen and what has been seen, the smaller one meets the texts where they stand, so
        that no text is shuffled and only unseen ones are looked at; if both are many, texts that may match at all are
        shuffled to meet the unseen ones."""
        version = version or uuid.uuid4().hex
        texts = reject_clash(docs, key, text).select(F.col(key).cast("long").alias("key"), text_or_empty(F.col(text)).alias("text")).withColumn("blob", blob_of(F.col("text")))
        texts.select("key", "blob").write.mode("overwrite").parquet(f"{self.path}/paths/version={version}")
        names = self.paths(version).select("blob").distinct()
        done, versions, unseen = self.scanned().where(F.col("rule_version") == rule_version).select("blob"), texts.select("text", "blob"), names
        if not done.isEmpty():
            marked = stored(names.join(done.distinct().withColumn("seen", F.lit(True)), "blob", "left"), "blobs")
            unseen, seen = marked.where("seen IS NULL").select("blob"), marked.where("seen")
            if small_enough(unseen, BROADCAST_BLOBS):
                versions = versions.join(F.broadcast(unseen.withColumn("unseen", F.lit(True))), "blob")
            elif small_enough(seen, BROADCAST_BLOBS):
                versions = versions.join(F.broadcast(seen), "blob", "left").select("text", "blob", F.col("seen").isNull().alias("unseen"))
            else:
                versions = versions.where(reduce(or_, map(_may_match, rules))).join(unseen, "blob", "left_semi")
        found = find(versions, rules).withColumn("rule_version", F.lit(rule_version))
        found.select("blob", "rule_version", "kind_rank", "kind", "start", "end").write.mode("append").parquet(f"{self.path}/findings")
        unseen.withColumn("rule_version", F.lit(rule_version)).select("blob", "rule_version").write.mode("append").parquet(f"{self.path}/scanned")
        return version

    def report(self, holders: DataFrame | str, rules: tuple[Rule, ...] = BASE_RULES, rule_version: str = BASE_VERSION, key: str = "doc_id", text: str = "text") -> DataFrame:
        """One row per row of holders, which are documents or the name of a version of them that was scanned: key,
        counts by kind, spans, and a digest of them.

        A null text is an empty one, without findings; empty tables give empty ones; repeated rows each
        get their row. Spans go by start, then by the order of the rules."""
        line = F.concat_ws(":", "kind", "start", "end")
        spans = F.transform(F.array_sort(F.collect_list(F.struct("start", "kind_rank", line.alias("line")))), lambda x: x["line"])
        by_blob = self.findings(rule_version).groupBy("blob").agg(
            *[F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in rules], F.array_join(spans, ",").alias("spans")
        )
        if isinstance(holders, str):
            places = self.paths(holders).select(F.col("key").alias(key), "blob")
        else:
            places = reject_clash(holders, key, text).select(F.col(key), blob_of(text_or_empty(F.col(text))).alias("blob"))
        out = places.join(by_blob, "blob", "left")
        joined = F.coalesce(F.col("spans"), F.lit(""))
        return out.select(
            key, *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules],
            F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"), F.lower(F.hex("blob")).alias("blob_sha256"),
        )


def op9_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' secrets by the base rules, through a ledger that has been over the pages before."""
    ledger = Ledger(spark, shared_folder(spark, "secret-ledger"))
    ledger.scan(spark.read.parquet(f"{sf_dir}/pages.parquet"), key="page_id", text="html", version="pages")
    return ledger.report(ledger.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), version="documents"))
