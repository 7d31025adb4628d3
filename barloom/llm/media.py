"""Media columns: payloads in tar shards, named by their content.

Rows carry a payload's digest and where its stored form stands: shard, offset, length. Reading that form's
first bytes alone fills the metadata columns. The form here is a grey PNG, eight bits a sample and 576
samples a row, so a payload is stored losslessly and its size is known from the header."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.deploy import ship
from barloom.llm.common import reject_clash, shared_folder, stored, text_batches, text_or_empty
from barloom.llm.files import Replacing, at

WIDTH = 576
PAD = b"\xff"  # no byte of UTF-8
TAIL = 32
#: A shard is closed once it is as large.
SHARD_BYTES = 256 << 20
#: A PNG's signature and first chunk.
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_STORED = "id long, digest string, n_bytes long, shard string, offset long, length long"
_METADATA = "width int, height long, bit_depth int"


def payload_of(text: str) -> bytes:
    body = text.encode("utf-8", "replace")
    return body + PAD * (-len(body) % WIDTH if body else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """A PNG whose samples are the payload's bytes; its length is a positive multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.pad(rows, ((0, 0), (1, 0))).tobytes()
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered, 6)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """width, height, bit depth from a PNG's first bytes."""
    if len(first) < HEADER_BYTES or not first.startswith(_SIGNATURE) or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth = struct.unpack(">IIB", first[16:25])
    return width, height, depth


def decode(form: bytes) -> bytes:
    """The samples of a PNG that encode() made."""
    width, height, _ = header(form)
    size = struct.unpack(">I", form[33:37])[0]
    rows = np.frombuffer(zlib.decompress(form[41 : 41 + size]), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def store(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes payloads into tar shards below folder; returns, stored, id, digest (SHA-256 of the payload),
    n_bytes, shard, offset, length per row of docs.

    A task writes shards of its own and a payload once in each, so no text is shuffled, and copies within a
    shard cost a row; a group of copies leaves at most one payload a shard. A null text is an empty one;
    rows without an id are stored too; an empty table writes nothing. Shards of a task that was lost are
    named by no row."""
    ship(docs.sparkSession)
    text_batches(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, name, size, held = None, "", 0, {}
        for batch in batches:
            out = []
            for id_, body in zip(batch["id"], batch["text"], strict=True):
                payload = payload_of(body)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in held:
                    if file is None or size >= SHARD_BYTES:
                        if file:
                            file.write(bytes(1024))
                            file.close()
                        name, size, held = f"{folder}/media-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tar", 0, {}
                        file = Replacing(name)
                    form = encode(payload)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(form)
                    head = info.tobuf(tarfile.GNU_FORMAT)
                    file.write(head + form + bytes(-len(form) % 512))
                    held[digest] = (size + len(head), len(form))
                    size += len(head) + len(form) + -len(form) % 512
                out.append((id_, digest, len(payload.rstrip(PAD)), name, *held[digest]))
            yield pd.DataFrame(out, columns=["id", "digest", "n_bytes", "shard", "offset", "length"]).astype({"id": "Int64"})
        if file:
            file.write(bytes(1024))
            file.close()

    plain = reject_clash(docs, key, text).select(F.col(key).cast("long").alias("id"), text_or_empty(F.col(text)).alias("text"))
    return stored(plain.mapInPandas(rows, _STORED), "media-rows")


def catalog(rows: DataFrame) -> DataFrame:
    """One place for each digest, the least of those that hold it."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def _by_place(rows: DataFrame) -> DataFrame:
    """A shard's rows in one task, by offset, so that each shard is opened once and read forwards. A shard's
    size is bounded, and so are its rows by those of the task that wrote it."""
    return rows.repartition("shard").sortWithinPartitions("shard", "offset")


class _Shards:
    """The shard that was last read from, open."""

    def __init__(self):
        self._name, self._file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self._name:
            if self._file:
                self._file.close()
            system, path = at(name)
            self._name, self._file = name, system.open_input_file(path)
        return self._file.read_at(length, offset)


def fill_metadata(rows: DataFrame) -> DataFrame:
    """rows with width, height and bit_depth, from range reads of HEADER_BYTES each."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards, last, known = _Shards(), None, None
        for batch in batches:
            out = []
            for name, offset in zip(batch["shard"], batch["offset"], strict=True):
                if (name, offset) != last:
                    last, known = (name, offset), header(shards.read(name, offset, HEADER_BYTES))
                out.append(known)
            yield batch.assign(**dict(zip(("width", "height", "bit_depth"), zip(*out, strict=True), strict=True))).astype({"id": "Int64"}) if out else batch.assign(width=[], height=[], bit_depth=[])

    return _by_place(rows).mapInPandas(read, f"{_STORED}, {_METADATA}")


def feature(payload: bytes) -> str:
    """Rows, mean and entropy of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    mean = int(counts @ np.arange(256)) / len(payload)
    return f"rows={len(payload) // WIDTH};mean={mean:.4f};entropy={abs(float(-(share * np.log2(share)).sum())):.4f}"


def read_back(rows: DataFrame, tail: int = TAIL) -> DataFrame:
    """rows, placed as by fill_metadata(), with what their stored bytes give. Equal payloads give equal
    values, as the form of a payload is decided by it alone."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards, last, known = _Shards(), None, None
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            out = []
            for name, offset, length in zip(batch["shard"], batch["offset"], batch["length"], strict=True):
                if (name, offset) != last:
                    form = shards.read(name, offset, length)
                    payload = decode(form)
                    last, known = (name, offset), (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-tail:]), len(form), hashlib.sha256(form).hexdigest(), feature(payload))
                out.append(known)
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1).astype({"id": "Int64"})

    return rows.mapInPandas(read, f"{_STORED}, {_METADATA}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_tar_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts as payloads."""
    rows = store(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark, "media"))
    return read_back(fill_metadata(rows)).select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"
    )
