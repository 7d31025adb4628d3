"""Best-fit packing of documents into token sequences, after Martello and Toth's reduction.

How many pieces there are of each length is all that packing needs, and lengths go up to the capacity
alone. So the plan is made from that histogram, as patterns (how many pieces of which lengths share a
sequence, and how many sequences are like it): as large as the capacity, however many documents there
are. Pieces then find their sequence by their length and their rank among pieces of that length."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.deploy import ship
from barloom.llm.common import reject_clash, stored, text_batches
from barloom.llm.tokens import KEEP, default_tokenizer, document_ids

CAPACITY = 2048
#: Ranks among pieces of one length are taken in so many parts, as a third of all pieces may be of it.
PARTS = 64
#: More than there are pieces of one length.
_RANKS = 1 << 50
#: (length, how many) of each length in a sequence, and how many sequences are like it.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def reduce(counts: Counter, capacity: int) -> list[Pattern]:
    """Takes out of counts, as fixed sequences, small sets that dominate: some best packing has them. For a
    piece j with room r beside it, and i the longest other piece that fits there:
    - nothing fits: j alone;
    - i fills r, or no two others fit: j with i, as whatever stood beside j can stand where i was;
    - no three others fit, and no two that fit are together longer than i: j with i, for the same reason;
    - no three others fit, the two longest together that fit are i and some b, and no two longer than b fit:
      j with i and b, as of any two beside j one can stand where i was and the other where b was."""
    fixed: list[Pattern] = []
    lengths = sorted(k for k, n in counts.items() if n)

    def take(times: int, *pieces: int) -> None:
        fixed.append((tuple(sorted(Counter(pieces).items(), reverse=True)), times))
        for k in pieces:
            counts[k] -= times
        for k in set(pieces):
            if not counts[k]:
                lengths.remove(k)

    def shortest(j: int, how_many: int) -> list[int]:
        out: list[int] = []
        for k in lengths:
            out += [k] * min(counts[k] - (k == j), how_many - len(out))
            if len(out) >= how_many:
                break
        return out

    def longest_pair(j: int, room: int) -> tuple[int, int]:
        """The two pieces other than one j with the greatest sum up to room, the shorter first; of equal sums
        those furthest apart."""
        best, low, high = (0, 0), 0, bisect.bisect_right(lengths, room) - 1
        while low <= high:
            a, b = lengths[low], lengths[high]
            if a + b > room or (low == high and counts[a] - (a == j) < 2) or not counts[b] - (b == j):
                high -= 1
            elif not counts[a] - (a == j):
                low += 1
            else:
                if a + b > sum(best):
                    best = (a, b)
                low += 1
        return best

    def two_longer(j: int, i: int, b: int) -> list[int]:
        """The two shortest pieces longer than b, other than one j and one i."""
        out: list[int] = []
        for k in lengths[bisect.bisect_right(lengths, b) :]:
            out += [k] * min(counts[k] - (k == j) - (k == i), 2 - len(out))
            if len(out) == 2:
                break
        return out

    changed = True
    while changed:
        changed = False
        for j in sorted(lengths, reverse=True):
            while counts[j]:
                room = capacity - j
                small = shortest(j, 3)
                if not small or small[0] > room:
                    take(counts[j], j)
                    changed = True
                    break
                at = bisect.bisect_right(lengths, room) - 1
                i = lengths[at]
                if i == j and counts[j] == 1:
                    i = lengths[at - 1]
                chosen = [j, i]
                if not (i == room or len(small) == 1 or small[0] + small[1] > room):
                    if len(small) == 3 and sum(small) <= room:
                        break
                    b, a = longest_pair(j, room)
                    if a + b > i:
                        longer = two_longer(j, i, b)
                        if a != i or (len(longer) == 2 and sum(longer) <= room):
                            break
                        chosen.append(b)
                # What is left of a set's lengths meets the same condition as long as the set is there.
                take(min(counts[k] // n for k, n in Counter(chosen).items()), *chosen)
                changed = True
    return fixed


def best_fit(counts: Counter, capacity: int) -> list[Pattern]:
    """Best-fit decreasing: each piece, the longest first, goes where least room is left. Sequences alike in
    content are one group, which gives what one piece after the other would."""
    groups: dict[int, list[list]] = defaultdict(list)  # by room left: [content, how many]
    rooms: list[int] = []

    def add(room: int, content: tuple, how_many: int) -> None:
        if room not in groups or not groups[room]:
            bisect.insort(rooms, room)
        groups[room].append([content, how_many])

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    add(capacity - each * length, ((length, each),), full)
                if rest:
                    add(capacity - rest * length, ((length, rest),), 1)
                break
            room = rooms[at]
            content, how_many = groups[room].pop()
            if not groups[room]:
                rooms.pop(at)
            each = room // length
            full = min(how_many, left // each)
            if full:
                add(room - each * length, (*content, (length, each)), full)
            left -= full * each
            if how_many > full:
                if rest := min(left, each - 1 if full < how_many and left < each else left):
                    add(room - rest * length, (*content, (length, rest)), 1)
                    left -= rest
                    full += 1
                if how_many > full:
                    add(room, content, how_many - full)
    return [(content, how_many) for same in groups.values() for content, how_many in same]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold each piece of the histogram once."""
    left = Counter({k: n for k, n in counts.items() if n})
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths must be from 1 to the capacity")
    fixed = reduce(left, capacity)
    return fixed + best_fit(left, capacity)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", keep: int = KEEP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids, cut where they exceed the capacity."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, ids in enumerate(document_ids(batch.column(1).to_pylist(), tokenizer, keep)):
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    at.append(k)
                    out.append((piece, start, len(part), zlib.crc32(part)))
            numbers = np.array(out, np.int64).reshape(-1, 4)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers[:, 0], pa.int32()), *[pa.array(numbers[:, c]) for c in (1, 2, 3)]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32"])

    plain = reject_clash(docs, key, text).select(F.col(key).cast("long").alias("id"), F.encode(text, "UTF-8").alias("text"))
    return plain.mapInArrow(rows, "id long, piece int, start long, length long, ids_crc32 long")


def _places(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length * _RANKS + first rank, first rank, pieces in a sequence, first sequence, offset of the first
    piece), in order. Their number is that of the patterns' parts, bounded by the capacity."""
    rows, rank, sequence = [(-1, 0, 1, 0, 0)], Counter(), 0
    for content, times in patterns:
        offset = 0
        for length, each in content:
            rows.append((length * _RANKS + rank[length], rank[length], each, sequence, offset))
            rank[length] += each * times
            offset += each * length
        sequence += times
    return np.array(sorted(rows), np.int64)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", keep: int = KEEP) -> DataFrame:
    """One row per piece: its place in its document, its sequence, and its offset there. keep: chunks whose ids a
    process keeps, which trades its memory for its time.

    A document is its ids and an END; null and empty texts are an END alone. An empty table has no
    pieces. Repeated rows are packed each, ids may be null, and other columns of docs are not read."""
    ship(docs.sparkSession)
    text_batches(docs.sparkSession)
    cut = stored(pieces(docs, tokenizer or default_tokenizer(), capacity, key, text, keep), "pieces")
    parted = cut.withColumn("part", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(PARTS)).cast("int"))
    # At most capacity x PARTS rows.
    counted = parted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["length", "part"])
    before = np.zeros((capacity + 1, PARTS), np.int64)
    before[counted["length"], counted["part"]] = counted["n"].groupby(counted["length"]).cumsum() - counted["n"]
    places = _places(plan({int(k): int(n) for k, n in counted.groupby("length")["n"].sum().items()}, capacity))
    ranked = parted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")) - 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length = batch["length"].to_numpy(np.int64)
            rank = batch["nth"].to_numpy(np.int64) + before[length, batch["part"].to_numpy(np.int64)]
            at = places[np.searchsorted(places[:, 0], length * _RANKS + rank, "right") - 1]
            sequence, copy = np.divmod(rank - at[:, 1], np.maximum(at[:, 2], 1))
            yield batch.assign(sequence_id=at[:, 3] + sequence, offset=at[:, 4] + copy * length)[["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"id": "Int64"})

    out = ranked.mapInPandas(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", key)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
