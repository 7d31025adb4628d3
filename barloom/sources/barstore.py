"""A store of bars in versions, and its incremental refresh from a source.

A save writes new files and a manifest that lists every file of the new version with what it holds, from the least to
the largest code and time; one rename makes that version the current one. Files never change, so a reader sees the
version it began with, whole, and what a save that fails has written is named by none."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.deploy import work_folder
from barloom.schemas import BARS
from barloom.sources import bars
from barloom.sources.store import DAILY, refresh_action

MANIFEST = "ktype int, bucket int, buckets int, save string, file string, rows long, min_code string, max_code string, min_ts timestamp, max_ts timestamp"
LATEST = "code string, latest timestamp"
_COLUMNS = [c.strip().split()[0] for c in BARS.split(",")]
_PLACED = f"{BARS}, save string, bucket int"
#: Rows of a file: a version's files are what scans are pruned by.
FILE_ROWS = 2_000_000
#: A row for each code is broadcast up to so many rows, and bytes of them as JSON.
BROADCAST_CODES, BROADCAST_BYTES = 500_000, 32 << 20
#: Rows lie in files by ranges of these.
_PLACE = ("ktype", "bucket", "code", "ts")
#: Days of the first slice when a source is read newest first; each next one is twice as long.
FIRST_DAYS = 32


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df written into the shared folder and read back, so that it is computed once."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_code(codes: DataFrame) -> DataFrame:
    """codes, a stored frame of a row for each, marked for broadcast if they are few enough, so that bars which meet
    them stay in place; else as they are, for a shuffled join."""
    size = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    held = codes.limit(BROADCAST_CODES + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).first()
    return F.broadcast(codes) if held.rows <= BROADCAST_CODES and (held.bytes or 0) <= BROADCAST_BYTES else codes


def _upserted(placed: DataFrame) -> DataFrame:
    """Of rows that lie by ranges of their keys, those that an upsert leaves: of fresh ones (column _fresh) with one key
    the last by _order, if there is one, of others those without a fresh one. Keys with a null meet nothing."""
    ordered = "_order" in placed.columns
    w = Window.partitionBy(*_PLACE).orderBy(F.desc("_fresh"), *([F.desc("_order")] if ordered else []))
    numbered = placed.withColumns({"_rank": F.rank().over(w), **({"_nth": F.row_number().over(w)} if ordered else {})})
    fresh = F.col("_nth") == 1 if ordered else F.lit(True)
    null = F.col("code").isNull() | F.col("ktype").isNull() | F.col("ts").isNull()
    return numbered.where(F.when(F.col("_fresh"), fresh).otherwise((F.col("_rank") == 1) | null)).select(*_COLUMNS, "bucket")


class BarStore:
    """Bars by ktype and bucket of codes. A save rewrites the buckets it touches; all others keep their files. A store
    keeps the number of buckets it began with. `version` pins a reader to one of the versions there are."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, file_rows: int = FILE_ROWS, version: int | None = None):
        self.spark, self.path, self._buckets, self.file_rows, self.version = spark, path.rstrip("/"), buckets, file_rows, version

    # --- files, by the file systems that Spark itself knows

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """The versions there are, oldest first."""
        files, path = self._at("versions")
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(x) for x in names if x.isdigit())

    def current(self) -> int:
        """The version that is read: the pinned or the newest one; 0 before the first save."""
        return self.version if self.version is not None else (self.versions() or [0])[-1]

    def manifest(self, version: int | None = None) -> DataFrame:
        """A row for each file of a version."""
        version = self.current() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/versions/{version:012d}")

    def _files(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], BARS)
        return self.spark.read.schema(_PLACED).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{x}" for x in files]).select(*_COLUMNS)

    @staticmethod
    def _folders(manifest: DataFrame) -> list[str]:
        """Folders of the manifest's buckets: as many as there are kinds of bars times buckets."""
        return [f"save={r.save}/ktype={r.ktype}/bucket={r.bucket}" for r in manifest.select("save", "ktype", "bucket").distinct().collect()]

    # --- reading

    def read(self) -> DataFrame:
        return self._files(self._folders(self.manifest()))

    def scan(self, code: str, ktype: int, first: str | None = None, last: str | None = None) -> DataFrame:
        """One code's bars from a date to a date, both included: only files that may hold some are read."""
        bucket = F.pmod(F.xxhash64(F.lit(code)), F.col("buckets")).cast("int")
        found = self.manifest().where((F.col("ktype") == ktype) & (F.col("bucket") == bucket) & (F.col("min_code") <= code) & (F.col("max_code") >= code))
        if first:
            found = found.where(F.col("max_ts") >= F.lit(first).cast("timestamp"))
        if last:
            found = found.where(F.col("min_ts") < F.lit(last).cast("timestamp") + F.expr("interval 1 day"))
        return bars.klines(self._files([r.file for r in found.select("file").collect()]), code, ktype, first, last)

    def between(self, first: datetime.datetime | None, end: datetime.datetime | None, ktypes: tuple[int, ...] | None = None) -> DataFrame:
        """All bars from a time to before a time, from the files that may hold some."""
        found, rows = self.manifest(), F.lit(True)
        if ktypes is not None:
            found, rows = found.where(F.col("ktype").isin(*ktypes)), rows & F.col("ktype").isin(*ktypes)
        if first is not None:
            found, rows = found.where(F.col("max_ts") >= F.lit(first)), rows & (F.col("ts") >= F.lit(first))
        if end is not None:
            found, rows = found.where(F.col("min_ts") < F.lit(end)), rows & (F.col("ts") < F.lit(end))
        return self._files([r.file for r in found.select("file").collect()]).where(rows)

    def span(self, ktypes: tuple[int, ...] | None = None) -> tuple[datetime.datetime | None, datetime.datetime | None]:
        """The first and the last time of a bar, by the manifest."""
        found = self.manifest() if ktypes is None else self.manifest().where(F.col("ktype").isin(*ktypes))
        return tuple(found.agg(F.min("min_ts"), F.max("max_ts")).first())

    def latest(self, ktypes: tuple[int, ...]) -> DataFrame:
        """code and the newest day of its bars, from what each save has noted of its codes; no bar is read."""
        folders = self._folders(self.manifest().where(F.col("ktype").isin(*ktypes)))
        if not folders:
            return self.spark.createDataFrame([], "code string, latest date")
        noted = self.spark.read.schema(f"{LATEST}, save string, ktype int, bucket int").option("basePath", f"{self.path}/latest").parquet(*[f"{self.path}/latest/{x}" for x in folders])
        return noted.groupBy("code").agg(F.to_date(F.max("latest")).alias("latest"))

    # --- writing

    def save(self, incoming: DataFrame, order: Column | None = None, again: bool = False) -> int:
        """Upserts, as a new version, whose number is returned; no rows make none. Of rows with one key the last by
        order counts; without an order the keys must be distinct. incoming is computed once, for which it is written
        an additional time; with `again` its last stage is computed two or three times instead, which suits stored rows
        and what one shuffle gives, and must give the same rows each time.

        What is held and what comes in meet in the ranges that the files are made of, so bars are shuffled once."""
        if self.version is not None:
            raise ValueError("a pinned version can't be written to")
        before, id_ = self.current(), uuid.uuid4().hex
        manifest = self.manifest(before)
        held = manifest.select("buckets").first()
        buckets = held.buckets if held else self._buckets
        bucket = F.pmod(F.xxhash64("code"), F.lit(buckets)).cast("int").alias("bucket")
        rows = incoming.select(*_COLUMNS, bucket, *([] if order is None else [order.alias("_order")]))
        if not again:
            rows = _kept(rows, "incoming-bars")
        marks, folders = None, []
        if held or not again:
            touched = rows.select("ktype", "bucket").distinct().collect()
            if not touched:
                return before
            marks = self.spark.createDataFrame([(r.ktype, r.bucket) for r in touched], "ktype int, bucket int")
            folders = self._folders(manifest.join(F.broadcast(marks), ["ktype", "bucket"], "left_semi"))
        if folders or order is not None:
            rows = rows.withColumn("_fresh", F.lit(True))
        if folders:
            rows = rows.unionByName(self._files(folders).select(*_COLUMNS, bucket, F.lit(False).alias("_fresh")), allowMissingColumns=True)
        # Ranges split a large bucket, or one code's long history, between tasks and files; rows of one key stay together.
        rows = rows.repartitionByRange(*_PLACE)
        if folders or order is not None:
            rows = _upserted(rows)
        data = f"{self.path}/data/save={id_}"
        rows.sortWithinPartitions(*_PLACE).write.option("maxRecordsPerFile", self.file_rows).option("compression", "zstd").partitionBy("ktype", "bucket").parquet(data)
        made = self.spark.read.schema(f"{BARS}, bucket int").parquet(data)
        if marks is None and made.isEmpty():
            return before
        made.groupBy("ktype", "bucket", "code").agg(F.max("ts").alias("latest")).repartition("ktype", "bucket").write.partitionBy("ktype", "bucket").parquet(f"{self.path}/latest/save={id_}")
        name = F.regexp_extract(F.col("_metadata.file_path"), f"save={id_}/.*$", 0)
        files = made.select("ktype", "bucket", "code", "ts", name.alias("file")).groupBy("ktype", "bucket", "file").agg(
            F.count(F.lit(1)).alias("rows"), F.min("code").alias("min_code"), F.max("code").alias("max_code"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")
        )
        whole = files.withColumns({"buckets": F.lit(buckets), "save": F.lit(id_)})
        if held:
            whole = manifest.join(F.broadcast(marks), ["ktype", "bucket"], "left_anti").unionByName(whole)
        self._publish(whole.select(*[c.strip().split()[0] for c in MANIFEST.split(",")]), before + 1, id_)
        return before + 1

    def _publish(self, manifest: DataFrame, version: int, id_: str) -> None:
        manifest.write.parquet(f"{self.path}/versions/_{id_}")
        files, made = self._at(f"versions/_{id_}")
        _, place = self._at(f"versions/{version:012d}")
        if files.exists(place) or not files.rename(made, place):
            files.delete(made, True)
            raise Conflict(f"version {version} is there already")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes all but the newest `keep` versions and the files that none of these names; what it removed. No
        save may be running, and readers of what goes must be done."""
        there = self.versions()
        live = {r.save for v in there[-keep:] for r in self.manifest(v).select("save").distinct().collect()}
        gone = [f"versions/{v:012d}" for v in there[:-keep]]
        for top in ("data", "latest"):
            files, path = self._at(top)
            if files.exists(path):
                gone += [f"{top}/{n}" for n in (s.getPath().getName() for s in files.listStatus(path)) if n.removeprefix("save=") not in live]
        for name in gone:
            files, path = self._at(name)
            files.delete(path, True)
        return gone


# --- newest first, and refresh


def slices(first: datetime.datetime, last: datetime.datetime, days: int = FIRST_DAYS) -> list[tuple[datetime.datetime, datetime.datetime]]:
    """Spans of time from the newest back, each twice as long as the one before: few, however long the history."""
    out, end = [], last + datetime.timedelta(seconds=1)
    while end > first:
        begin = max(first, end - datetime.timedelta(days=days))
        out.append((begin, end))
        end, days = begin, days * 2
    return out


def until_newest_first(read: Callable[[datetime.datetime, datetime.datetime], DataFrame], spans: list[tuple[datetime.datetime, datetime.datetime]], wanted: DataFrame, stop: Column) -> DataFrame:
    """The bars of wanted's codes from the newest back to the first for which `stop` holds, which is included. Spans
    are read one by one; a code whose stop is found is wanted no more, and once none is, older spans aren't read.
    `stop` may use wanted's other columns, whose names must differ from those of bars."""
    spark, out = wanted.sparkSession, None
    for first, end in spans:
        rows = _kept(read(first, end).join(by_code(wanted), "code"), "slice")
        ends = by_code(_kept(bars.stops(rows, stop), "stops"))
        taken = bars.up_to(rows, ends).select(*_COLUMNS)
        out = taken if out is None else out.unionByName(taken)
        wanted = _kept(wanted.join(ends, "code", "left_anti"), "still-wanted")
        if wanted.isEmpty():
            break
    return spark.createDataFrame([], BARS) if out is None else out


def refresh_plan(store: BarStore, codes: DataFrame, now: Column) -> DataFrame:
    """code, latest (the newest day stored) and what to fetch of its daily bars at the time `now`, which may use
    columns of codes."""
    return codes.join(store.latest(DAILY).withColumnRenamed("latest", "_latest"), "code", "left").select("code", F.col("_latest").alias("latest"), refresh_action(F.col("_latest"), now).alias("action"))


def refresh(store: BarStore, source: BarStore, codes: DataFrame, now: Column, ktypes: tuple[int, ...] = DAILY) -> DataFrame:
    """Brings the daily bars of codes in store up to date and returns what was planned for each.

    Of codes without bars all are fetched; of those whose running day is stored the newest bar; of those that are
    behind what came since, back to the bar before the latest day; of the others nothing. Each class reads its own
    slices of the source, and one save takes what they gave."""
    plan = _kept(refresh_plan(store, codes, now), "refresh-plan")
    classes = {r.action for r in plan.select("action").distinct().collect()}
    first, last = source.span(ktypes)
    spans = slices(first, last) if first else []

    def of(action: str) -> DataFrame:
        return plan.where(F.col("action") == action).select("code", "latest")

    def read(begin: datetime.datetime, end: datetime.datetime) -> DataFrame:
        return source.between(begin, end, ktypes)

    parts = []
    if "all" in classes:
        parts.append(source.between(None, None, ktypes).join(by_code(of("all")), "code", "left_semi"))
    if "today" in classes:
        parts.append(until_newest_first(read, spans, of("today"), F.lit(True)))
    if "since" in classes:
        parts.append(until_newest_first(read, spans, of("since"), F.to_date("ts") < F.col("latest")))
    fetched = None
    for part in parts:
        fetched = part.select(*_COLUMNS) if fetched is None else fetched.unionByName(part.select(*_COLUMNS))
    if fetched is not None:
        store.save(fetched)
    return plan

