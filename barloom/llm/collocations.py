"""Phrase collocations: sketches, exact counts of what the sketches let through, score, subsume.

First pass: each task counts words and pairs of its texts in a count-min sketch, and the tasks' sketches are merged
block by block. Cells never say less than the truth, so a phrase that one of its cells puts below the threshold
is not frequent. Second pass: a sketch of the longer phrases, of those alone all of whose words and pairs reach the
threshold. Third pass: phrases all of whose parts and cells reach it are counted exactly; no frequent one is lost,
and what the sketches let through by chance falls to its exact count. A sketch has far more cells than there are
phrases, so that it doesn't fill up as the input grows; tasks hold and send the cells that they touch, and of the
merged sketch only the cells that reach the threshold are kept."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.deploy import ship
from barloom.llm.common import reject_clash, stored, stored_at, text_batches
from barloom.llm.files import at

NO_LANG = "und"


@dataclass(frozen=True)
class Params:
    """Phrases of 2 to max_words words with at least min_count occurrences; a phrase goes if a longer one that
    holds it has `subsumed` percent of its count; `top` a language are returned. A sketch has `depth` rows of
    `width` cells (a power of two, 2^32 at most)."""

    max_words: int = 5
    min_count: int = 100
    subsumed: int = 100
    top: int = 2000
    depth: int = 1
    width: int = 1 << 32


#: Blocks of a line of the sketch, and cells of one at least.
BLOCKS, LEAST_BLOCK = 1 << 10, 1 << 12
#: Cells that a task holds, repeated ones included, before it sends them; cells that the merge of a block holds.
HELD_CELLS, MERGED_CELLS = 1 << 24, 1 << 22
#: Words that a task handles at once.
CHUNK_WORDS = 1 << 20
#: Phrases whose counts a task holds, and rows that it sends at once.
HELD_PHRASES, OUT_ROWS = 400_000, 20_000
#: Input partitions that one task reads, as long as every core has two tasks: counts added up in a task aren't shuffled.
MERGED = 8
_CELLS = "line int, block int, cells binary"
_COUNTS = "lang string, words int, phrase binary, n long"

#: Stands where a piece ends; no word is upper case.
_END = b"A"
#: A-Z become lower case, what ends a piece becomes _END.
_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else _END[0] if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _Numbers(dict):
    """A language's words by number; a new one gets the next number, and its hash and language their places."""

    def __init__(self, lang: str, hashes: list[int], lang_of: list[str]):
        super().__init__({_END: -1})
        self._lang, self._seed, self._hashes, self._lang_of = lang, xxhash.xxh32_intdigest(lang.encode()), hashes, lang_of

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self._hashes)
        self._hashes.append(xxhash.xxh3_64_intdigest(word, self._seed))
        self._lang_of.append(self._lang)
        return n


class Chunk:
    """Words of several texts in one row, with _END after each piece: `names` gives each a number by language and
    word, and -1 to _END."""

    def __init__(self):
        self.words: list[bytes] = []
        self.names: list[int] = []
        self._number: dict[str, _Numbers] = {}
        self.hashes: list[int] = []
        self.lang_of: list[str] = []

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self._number:
            self._number[lang] = _Numbers(lang, self.hashes, self.lang_of)
        words = text.translate(_PLAIN).replace(_END, b" " + _END + b" ").split()
        words.append(_END)
        self.words += words
        self.names += map(self._number[lang].__getitem__, words)

    def left(self) -> np.ndarray:
        """How many words each one's piece has from there on; 0 at _END."""
        ends = np.flatnonzero(np.array(self.names, np.int64) < 0)
        return np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(self.names))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[Chunk]:
    chunk = Chunk()
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            chunk.add(lang, bytes(text))
            if len(chunk.words) >= CHUNK_WORDS:
                if chunk.hashes:
                    yield chunk
                chunk = Chunk()
    if chunk.hashes:
        yield chunk


Passes = Callable[[int, np.ndarray], np.ndarray]


def _phrase_hashes(chunk: Chunk, max_words: int, passes: Passes | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of words: the places where such a phrase begins, and its hash there; of those alone that
    `passes`, asked by number of words and hashes, lets through with all their parts, if it is given."""
    name, hashes = np.array(chunk.names, np.int64), np.array(chunk.hashes, np.uint64)
    word, left = hashes[name], chunk.left()
    starts, h, alive = np.arange(len(word)), word, None
    for words in range(1, max_words + 1):
        go_on = left[starts] >= words
        if alive is not None:
            go_on &= alive[starts + 1]
        starts, h = starts[go_on], h[go_on]
        if words > 1:
            h = h * _ODD + word[starts + words - 1]
            h ^= h >> np.uint64(32)
        if passes is not None:
            often = passes(1, hashes)[name[starts]] if words == 1 else passes(words, h)
            starts, h = starts[often], h[often]
            alive = np.zeros(len(word), bool)
            alive[starts] = True
        yield words, starts, h


def _cells(h: np.ndarray, line: int, width: int) -> np.ndarray:
    x = (h ^ np.uint64(line * 0x517CC1B727220A95 + 1 & (1 << 64) - 1)) * _MIX
    return ((x ^ x >> np.uint64(29)) * _ODD >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)


def _cell_type(min_count: int) -> type:
    """Cells stop at what their type holds, which is no less than the threshold."""
    return np.uint8 if min_count <= 255 else np.uint32


def _plain_texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """lang, and text as bytes, in fewer partitions; a null text is left out, as it has no words."""
    plain = reject_clash(docs, lang, text).select(F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"), F.col(text).cast("binary").alias("text")).where(F.col("text").isNotNull())
    return plain.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, plain.rdd.getNumPartitions() // MERGED))


def _block(width: int) -> int:
    """Cells of a block."""
    return min(width, max(width // BLOCKS, LEAST_BLOCK))


def _packed(places: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Rising places in a block as gaps, byte by byte of all of them, then their counts."""
    gaps = np.diff(places.astype(np.uint32), prepend=np.uint32(0))
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + (b"" if counts is None else counts.tobytes()), 1)


def _unpacked(packed: bytes, kind: type | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    n = len(raw) // (4 + (np.dtype(kind).itemsize if kind else 0))
    gaps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(gaps, dtype=np.uint32), raw[4 * n :].view(kind) if kind else None


def _runs(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted ones."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


def _touched(batches: Iterator[pd.DataFrame], p: Params, sizes: Iterable[int], passes: Passes | None = None) -> Iterator[pd.DataFrame]:
    """A task's sketch of phrases of so many words, a row for each line and block that it touches; it goes out each
    time that HELD_CELLS are held."""
    kind, most, block = _cell_type(p.min_count), np.iinfo(_cell_type(p.min_count)).max, np.uint32(_block(p.width))
    held: list[list[np.ndarray]] = [[] for _ in range(p.depth)]

    def let_go() -> Iterator[pd.DataFrame]:
        for line, each in enumerate(held):
            x = np.sort(np.concatenate(each))
            each.clear()
            first = _runs(x)
            times, x = np.minimum(np.diff(first, append=len(x)), most).astype(kind), x[first]
            at_block = x // block
            begin = _runs(at_block)
            out = [(line, int(at_block[i]), _packed(x[i:j] % block, times[i:j])) for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(x)], strict=True)]
            yield pd.DataFrame(out, columns=["line", "block", "cells"])

    holds = 0
    for chunk in _chunks(batches):
        for words, _, h in _phrase_hashes(chunk, max(sizes), passes):
            if words in sizes and len(h):
                for line in range(p.depth):
                    held[line].append(_cells(h, line, p.width).astype(np.uint32))
                holds += len(h) * p.depth
        if holds >= HELD_CELLS:
            yield from let_go()
            holds = 0
    if holds:
        yield from let_go()


def _merged(batches: Iterator[pd.DataFrame], p: Params) -> Iterator[pd.DataFrame]:
    """The cells that reach the threshold, of tasks' blocks in order of line and block."""
    kind, most = _cell_type(p.min_count), np.iinfo(_cell_type(p.min_count)).max
    now, parts, holds = None, [], 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        places, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(places, kind="stable")
        places = places[order]
        first = _runs(places)
        return places[first], np.minimum(np.add.reduceat(times[order].astype(np.int64), first), most).astype(kind)

    def row() -> Iterator[pd.DataFrame]:
        places, times = added()
        places = places[times >= p.min_count]
        if len(places):
            yield pd.DataFrame([(*now, _packed(places))], columns=["line", "block", "cells"])

    for batch in batches:
        for line, b, packed in zip(batch["line"], batch["block"], batch["cells"], strict=True):
            if (line, b) != now:
                if parts:
                    yield from row()
                now, parts, holds = (line, b), [], 0
            parts.append(_unpacked(packed, kind))
            holds += len(parts[-1][0])
            if holds >= max(MERGED_CELLS, 2 * len(parts[0][0])):
                parts = [added()]
                holds = len(parts[0][0])
    if parts:
        yield from row()


def sketch(texts: DataFrame, p: Params, sizes: Iterable[int] | None = None, within: dict[int, str] | None = None) -> str:
    """Path of the merged sketch of phrases of so many words: for each line and block, the cells that reach the
    threshold. within: merged sketches by number of words, all of which a phrase's parts have to pass to be counted.
    Tasks' blocks are compressed, and those of one place are added as they stream by."""
    sizes = frozenset(range(1, p.max_words + 1) if sizes is None else sizes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _touched(batches, p, sizes, _let_through(within, p) if within else None)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _merged(batches, p)

    parts = texts.mapInPandas(count, _CELLS).repartition("line", "block").sortWithinPartitions("line", "block")
    return stored_at(parts.mapInPandas(merge, _CELLS), "phrase-sketch")[1]


_held: dict[str, list[np.ndarray]] = {}


def _passing(path: str, p: Params) -> list[np.ndarray]:
    """For each line of a merged sketch the cells that reach the threshold, in order; a worker keeps those of the last
    two sketches for its next tasks."""
    if path not in _held:
        while len(_held) > 1:
            del _held[next(iter(_held))]
        lines: list[list[np.ndarray]] = [[np.zeros(0, np.uint32)] for _ in range(p.depth)]
        system, folder = at(path)
        for part in pq.ParquetDataset(folder, filesystem=system).fragments:
            for batch in part.to_batches(batch_size=64):
                for line, b, packed in zip(*(batch.column(n).to_pylist() for n in ("line", "block", "cells")), strict=True):
                    lines[line].append(_unpacked(packed)[0] + np.uint32(b * _block(p.width)))
        _held[path] = [np.sort(np.concatenate(x)) for x in lines]
    return _held[path]


def _load(path: str, p: Params) -> np.ndarray:
    """A narrow merged sketch as a whole: what each cell has counted at most, up to the threshold."""
    cells = np.full((p.depth, p.width), p.min_count - 1, _cell_type(p.min_count))
    for line, passing in enumerate(_passing(path, p)):
        cells[line, passing] = p.min_count
    return cells


def _let_through(sketches: dict[int, str], p: Params) -> Passes:
    """Whether all cells of phrases reach the threshold; phrases of as many words as no sketch has counted all pass."""

    def passes(words: int, h: np.ndarray) -> np.ndarray:
        often = np.ones(len(h), bool)
        for line, cells in enumerate(_passing(sketches[words], p) if words in sketches else []):
            x = _cells(h, line, p.width).astype(np.uint32)
            often &= cells[np.minimum(np.searchsorted(cells, x), len(cells) - 1)] == x if len(cells) else False
        return often

    return passes


def phrase_counts(texts: DataFrame, sketches: dict[int, str], p: Params) -> DataFrame:
    """lang, words, phrase, n of all phrases of one to max_words words with min_count occurrences or more, and one
    row with words 0 and an empty phrase for each language's number of words. sketches: merged ones by number of words.

    In a chunk, phrases are told apart by exact numbers (that of the phrase without its last word, and the word's); a
    task adds up its chunks' counts and lets them go once it holds HELD_PHRASES; Spark adds these up before and after
    its shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], dict[bytes, int]] = {}

        def let_go() -> Iterator[pd.DataFrame]:
            for (lang, words), each in held.items():
                phrases = list(each)
                for i in range(0, len(phrases), OUT_ROWS):
                    part = phrases[i : i + OUT_ROWS]
                    yield pd.DataFrame({"lang": lang, "words": np.int32(words), "phrase": part, "n": [each[x] for x in part]})
            held.clear()

        for chunk in _chunks(batches):
            name = np.array(chunk.names, np.int64)
            word = name.copy()
            for lang, n in zip(chunk.lang_of, np.bincount(word[word >= 0]).tolist(), strict=True):
                total = held.setdefault((lang, 0), {})
                total[b""] = total.get(b"", 0) + n
            for words, starts, _ in _phrase_hashes(chunk, p.max_words, _let_through(sketches, p)):
                exact = name[starts] if words == 1 else name[starts] << 32 | word[starts + words - 1]
                _, first, same, n = np.unique(exact, return_index=True, return_inverse=True, return_counts=True)
                name[starts] = same
                for i, times in zip(starts[first].tolist(), n.tolist(), strict=True):
                    each = held.setdefault((chunk.lang_of[chunk.names[i]], words), {})
                    phrase = b" ".join(chunk.words[i : i + words])
                    each[phrase] = each.get(phrase, 0) + times
            if sum(map(len, held.values())) >= HELD_PHRASES:
                yield from let_go()
        yield from let_go()

    each = texts.mapInPandas(count, _COUNTS)
    total = each.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return total.where((F.col("n") >= p.min_count) | (F.col("words") == 0)).withColumn("phrase", F.col("phrase").cast("string"))


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of each phrase of two or more words, by the lowest-scoring of its
    cuts, the first of them on ties. Products have up to 38 digits, and no fraction is rounded."""
    phrases = counts.where("words >= 2").withColumn("w", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", "words", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "words", "a", "cut", _part(F.col("w"), F.lit(1), F.col("cut")).alias("left"), _part(F.col("w"), F.col("cut") + 1, F.col("words") - F.col("cut")).alias("rest"))
    parts = counts.where("words >= 1").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("n").alias("_n"))
    totals = F.broadcast(counts.where("words = 0").select("lang", F.col("n").alias("total")))
    met = cuts.join(parts, (cuts["lang"] == parts["_lang"]) & (cuts["left"] == parts["_part"])).select(*cuts.columns, F.col("_n").alias("l"))
    met = met.join(parts, (met["lang"] == parts["_lang"]) & (met["rest"] == parts["_part"])).select(*met.columns, F.col("_n").alias("r")).join(totals, "lang")
    score = F.expr("1000BD * cast(a AS decimal(17, 0)) * cast(total AS decimal(17, 0)) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)))")
    least = met.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), F.first("total").alias("n"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))
    return least.select("lang", "phrase", "words", "a", "x.l", "x.r", "n", "x.score")


def within_longer(counts: DataFrame, subsumed: int = 100) -> DataFrame:
    """lang, phrase of the phrases that some longer one holds and nearly equals in count."""
    longer = counts.where("words >= 3").withColumn("w", F.split("phrase", " "))
    inside = longer.select("lang", "w", "words", "n", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("length"))
    inside = inside.select("lang", "w", "n", "length", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("length") + 1)).alias("start"))
    most = inside.groupBy("lang", _part(F.col("w"), F.col("start"), F.col("length")).alias("phrase")).agg(F.max("n").alias("most"))
    own = counts.where("words >= 2").select("lang", "phrase", "n")
    return own.join(most, ["lang", "phrase"]).where(F.col("most") * 100 >= F.col("n") * subsumed).select("lang", "phrase")


def collocations(docs: DataFrame, p: Params = Params(), lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, count, phrase.

    Texts are lower-cased A-Z, split at . , ; : ! ? and line ends into pieces and those at spaces and tabs into
    words; phrases lie within a piece. A null language is `und`, a null or empty text has no words, repeated
    rows count each time, other columns are not looked at, an empty table gives an empty one. Ties in score and
    count go by the phrase's bytes."""
    ship(docs.sparkSession)
    text_batches(docs.sparkSession)
    texts = _plain_texts(docs, lang, text)
    sketches = dict.fromkeys((1, 2), sketch(texts, p, (1, 2)))
    if p.max_words > 2:
        longer = range(3, p.max_words + 1)
        sketches |= dict.fromkeys(longer, sketch(texts, p, longer, sketches))
    counts = stored(phrase_counts(texts, sketches, p), "phrase-counts")
    left = scored(counts).join(within_longer(counts, p.subsumed), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.top)
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_merged_sketch_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
