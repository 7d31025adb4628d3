"""Training-order materialisation of token sequences.

Documents' ids, END after each, make one stream that is cut into sequences of equal length. Documents stand in it
by a hash of their id and text, so the stream, and all that is made of it, is decided by the documents and the key
alone, and not by how their rows come dealt out over files and tasks. A keyed Feistel
permutation of the sequences' numbers gives each its global slot, so the order of training is known
without a sort or a shuffle table. Slots go by ranges to shard files of a fixed stride: the sequence in
slot s starts at byte (s % per_shard) * stride of shard s // per_shard, and reading on from a slot needs
its number alone."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.deploy import ship
from barloom.llm.common import reject_clash, shared_folder, stored, text_batches, text_key
from barloom.llm.files import Replacing, read_range, read_whole
from barloom.llm.tokens import END, default_tokenizer, document_ids, forget, tokenizer as tokenizer_of

LENGTH = 2048
PER_SHARD = 4096
ID = np.dtype("<u2")
#: Chunks whose ids a process keeps; its tasks here do little else.
KEEP = 1_200_000
#: Ids that are stored together, at least.
RUN = 1 << 18
#: Parts of the stream; each is ordered by itself.
BUCKETS = 4096


_FILL = np.array([END], ID).tobytes()
_SEQUENCES = pa.schema([(c, pa.int64()) for c in ("sequence", "slot", "shard", "byte_offset", "n_tokens")] + [("doc_ids", pa.list_(pa.int64())), ("ids_crc32", pa.int64())])


class Feistel:
    """A keyed permutation of 0 .. n-1: a balanced Feistel network over the next even number of bits, walked
    on from results that are n or more until one is below."""

    ROUNDS = 6

    def __init__(self, n: int, key: int):
        self.n = n
        half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self._half, self._mask = np.uint64(half), np.uint64((1 << half) - 1)
        self._keys = np.random.default_rng(key).integers(0, 1 << 63, self.ROUNDS, dtype=np.uint64)

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self._mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self._half, x & self._mask
        for key in self._keys[::-1] if back else self._keys:
            if back:
                left, right = right ^ self._mix(left, key), left
            else:
                left, right = right, left ^ self._mix(right, key)
        return (left << self._half) | right

    def _walk(self, numbers, back: bool) -> np.ndarray:
        x = self._once(np.asarray(numbers, np.uint64), back)
        while (over := x >= np.uint64(self.n)).any():
            x[over] = self._once(x[over], back)
        return x.astype(np.int64)

    def slots(self, sequences) -> np.ndarray:
        return self._walk(np.atleast_1d(sequences), False)

    def sequences(self, slots) -> np.ndarray:
        return self._walk(np.atleast_1d(slots), True)


def _tokenised(docs: DataFrame, tokenizer: str, key: str, text: str) -> DataFrame:
    """Runs of documents in the order that tasks read them: part (the task's partition), first (the first one's
    place there), ids and hs (which tells apart rows that repeat an id with another text) of the documents, sizes
    (ids of each), data (all their ids)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            made, at = list(document_ids(batch.column(2).to_pylist(), tokenizer, KEEP)), 0
            while at < len(made):
                upto, size = at, 0
                while upto < len(made) and (size < RUN or upto == at):
                    size += len(made[upto])
                    upto += 1
                data = _pressed(np.concatenate(made[at:upto]).astype(ID))
                lists = [pa.array([batch.column(c).slice(at, upto - at).to_pylist()], pa.list_(pa.int64())) for c in (0, 1)]
                columns = [pa.array([part], pa.int32()), pa.array([place], pa.int64()), *lists, pa.array([[len(x) for x in made[at:upto]]], pa.list_(pa.int64())), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "first", "ids", "hs", "sizes", "data"])
                place += upto - at
                at = upto

    plain = reject_clash(docs, key, text).select(F.col(key).cast("long").alias("id"), text_key(text).alias("h"), F.encode(text, "UTF-8").alias("text"))
    return plain.mapInArrow(rows, "part int, first long, ids array<long>, hs array<long>, sizes array<long>, data binary")


def _store_starts(tokens: DataFrame, folder: str) -> int:
    """Writes where each document's ids start in the stream, as a file of 64-bit numbers for each part, in the
    part's order; returns the length of the stream. Ids, hashes and sizes are shuffled, tokens are not: the tasks
    that cut them up look up the file of their part."""
    each = tokens.select("part", "first", F.posexplode(F.arrays_zip("ids", "hs", "sizes")).alias("at", "d"))
    each = each.select("part", (F.col("first") + F.col("at")).alias("place"), F.col("d.ids").alias("id"), F.col("d.hs").alias("h"), F.col("d.sizes").alias("n"))
    bucket = F.pmod(F.xxhash64("id", "h"), F.lit(BUCKETS)).cast("int")
    each = stored(each.withColumn("bucket", bucket), "documents")
    # A row per bucket at most.
    totals = {r.bucket: r.n for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    bases, base = [], 0
    for x in range(BUCKETS):
        bases.append((x, base))
        base += totals.get(x, 0)
    order = Window.partitionBy("bucket").orderBy("id", "h", "part", "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).join(F.broadcast(tokens.sparkSession.createDataFrame(bases, "bucket int, base long")), "bucket")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file = None, None
        for batch in batches:
            parts, starts = (batch.column(c).to_numpy() for c in (0, 2))
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    if parts[a] != part:
                        if file:
                            file.close()
                        part, file = parts[a], Replacing(_starts_file(folder, parts[a]))
                    file.write(starts[a:b].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([len(parts)], pa.int64())], ["n"])
        if file:
            file.close()

    dealt = placed.select("part", "place", (F.col("base") + F.col("before")).alias("start")).repartition("part").sortWithinPartitions("part", "place")
    dealt.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return base


def _starts_file(folder: str, part: int) -> str:
    return f"{folder}/starts-{part:08d}.bin"


_ZSTD = pa.Codec("zstd", compression_level=3)


def _pressed(ids) -> bytes:
    """Ids as they travel between tasks; about two thirds of their size in a shard."""
    return _ZSTD.compress(memoryview(ids).cast("B"), asbytes=True)


def _restored(data: bytes, n: int) -> bytes:
    return _ZSTD.decompress(data, n * ID.itemsize, asbytes=True)


def shard_file(folder: str, shard: int) -> str:
    return f"{folder}/tokens-{shard:08d}.bin"


def materialise(docs: DataFrame, folder: str, order_key: int, tokenizer: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards below folder and returns one row per sequence: sequence, slot, shard, byte_offset,
    n_tokens (of documents; the last sequence is filled up with END), doc_ids (in order), ids_crc32.

    A null or empty text is an END alone; an empty table writes no shard and has no rows; repeated rows
    stand in the stream each; a null id is a null in doc_ids. Other columns of docs are not read. A task
    that is lost is run again and writes the same file. The same documents, tokenizer and key give the same files,
    however docs is partitioned."""
    spark = docs.sparkSession
    ship(spark)
    text_batches(spark)
    path = tokenizer or default_tokenizer()
    if tokenizer_of(path).largest_id() > np.iinfo(ID).max:
        raise ValueError("ids do not fit the shards' format")
    forget()
    tokens = stored(_tokenised(docs, path, key, text), "tokenised")
    places = shared_folder(spark, "token-starts")
    total = _store_starts(tokens, places)
    count = -(-total // length)
    order = Feistel(max(count, 1), order_key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own, starts = None, None
        for batch in batches:
            for part, first, doc_ids, sizes, pressed in zip(*[batch.column(c).to_pylist() for c in range(5)], strict=True):
                if part != own:
                    own, starts = part, np.frombuffer(read_whole(_starts_file(places, part)), "<i8")
                ids = memoryview(_restored(pressed, sum(sizes)))
                of, sequences, at, counts, data, done = [], [], [], [], [], 0
                for id_, start, n in zip(doc_ids, starts[first : first + len(sizes)].tolist(), sizes, strict=True):
                    while n:
                        sequence, pos = divmod(start, length)
                        some = min(length - pos, n)
                        of.append(id_)
                        sequences.append(sequence)
                        at.append(pos)
                        counts.append(some)
                        data.append(_pressed(ids[done * ID.itemsize : (done + some) * ID.itemsize]))
                        start, n, done = start + some, n - some, done + some
                numbers = np.array(sequences, np.int64)
                slots = order.slots(numbers)
                columns = [pa.array(slots // per_shard), pa.array(slots), pa.array(at, pa.int32()), pa.array(numbers), pa.array(of, pa.int64()), pa.array(counts, pa.int32()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "slot", "pos", "sequence", "id", "n", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, slot and pos; a sequence's rows may go on in the next batch."""
        forget()
        out, shard, file, own, ids, head = [], None, None, [], [], None

        def end_sequence() -> None:
            if head is None:
                return
            body = b"".join(own)
            whole = body + bytes(_FILL * (length - len(body) // ID.itemsize))
            file.write(whole)
            slot, sequence, s = head
            out.append((sequence, slot, s, slot % per_shard * length * ID.itemsize, len(body) // ID.itemsize, list(ids), zlib.crc32(whole)))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SEQUENCES, strict=True)], schema=_SEQUENCES)

        for batch in batches:
            for s, slot, _, sequence, id_, n, pressed in zip(*[batch.column(c).to_pylist() for c in range(7)], strict=True):
                if head is None or head[0] != slot:
                    end_sequence()
                    own, ids, head = [], [], (slot, sequence, s)
                    if s != shard:
                        if file:
                            file.close()
                        shard, file = s, Replacing(shard_file(folder, s))
                own.append(_restored(pressed, n))
                ids.append(id_)
            yield flush()
        end_sequence()
        if file:
            file.close()
        yield flush()

    shards = max(1, -(-count // per_shard))
    placed = tokens.select("part", "first", "ids", "sizes", "data").mapInArrow(cut, "shard long, slot long, pos int, sequence long, id long, n int, ids binary")
    dealt = placed.repartitionById(min(shards, 100_000), F.pmod(F.col("shard"), F.lit(100_000)).cast("int")).sortWithinPartitions("shard", "slot", "pos")
    return stored(dealt.mapInArrow(write, "sequence long, slot long, shard long, byte_offset long, n_tokens long, doc_ids array<long>, ids_crc32 long"), "sequences")


def read_on(folder: str, slot: int, how_many: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> np.ndarray:
    """The ids of so many sequences of one shard from a slot on, by one range read."""
    shard, place = divmod(slot, per_shard)
    stride = length * ID.itemsize
    data = read_range(shard_file(folder, shard), place * stride, min(how_many, per_shard - place) * stride)
    return np.frombuffer(data, ID).reshape(-1, length)


def op5_feistel_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' sequences of 2048 ids in training order."""
    return materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark, "token-shards"), order_key=20240229)
