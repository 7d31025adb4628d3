"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.deploy import work_folder as shared_folder
from barloom.llm.files import at

__all__ = ["broadcast_below", "lower_ascii", "reject_clash", "remove", "scratch", "shared_folder", "small_enough", "stored", "stored_at", "text_batches", "text_key", "text_or_empty"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_scratch: list[list[str]] = []


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet into the shared folder; df read back, and its path, which no scratch() removes."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: a cut of lineage that outlives
    executors, and the way not to compute a frame twice. Frames are lazy, so what an operator stored stays until
    its caller has read the result; see scratch()."""
    out, path = stored_at(df, name)
    for made in _scratch:
        made.append(path)
    return out


def remove(path: str) -> None:
    """Removes a folder of the shared one, if it is there."""
    system, at_ = at(path)
    if system.get_file_info(at_).type != fs.FileType.NotFound:
        system.delete_dir(at_)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes what stored() wrote in its block when the block ends; results must have been written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(path)


#: What an Arrow batch of texts may hold.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20
#: What a frame of any shape may hold, in bytes of its rows as JSON, to be broadcast.
BROADCAST_BYTES = 32 << 20


def text_batches(spark: SparkSession) -> None:
    """Python tasks get whole texts, so the session's Arrow batches are held to so many rows and bytes; Spark's own
    default of 10,000 rows may be gigabytes of text. The setting stays, as frames are planned when they are read."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"-?\d+", spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if now is None or not 0 < int(now[0]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def small_enough(df: DataFrame, rows: int, most: int = BROADCAST_BYTES) -> bool:
    """Whether a stored frame has at most so many rows and bytes; asked before each explicit broadcast."""
    held = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length(F.to_json(F.struct("*"))).cast("long")).alias("bytes")).first()
    return held.rows <= rows and (held.bytes or 0) <= most


def broadcast_below(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, in as many bytes as a broadcast may have; else as
    it is, for a shuffled join."""
    return F.broadcast(df) if small_enough(df, rows) else df


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, _UPPER, _UPPER.lower())


def text_key(text: Column | str) -> Column:
    """Tells apart rows that repeat a document's id with another text."""
    return F.xxhash64(text_or_empty(text))


def reject_clash(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that columns of any other name can't clash with an operator's own."""
    return df.select(*[df[c] for c in columns])
