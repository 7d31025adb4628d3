"""Near-duplicate documents by b-bit MinHash.

Each document's shingle set gets minima under many hash functions. Bands of minima name the buckets in
which candidates meet; of the minima themselves only the low bits stay, packed into a few integers, and
the share of agreeing ones, corrected for chance collisions, says which candidates are worth an exact
comparison of full sets. Documents with equal sets form a class before any of this, so copies cost
nothing further. Within a bucket, members are compared with one hub and not with each other. Only buckets
that this leaves in more than one component are looked at whole: long signatures of one bit a minimum meet
in wide tiles, and texts follow only where a pair of two components may be similar enough, into tiles whose
results are at most a link for two components.

Classes are the nodes of all joins. They are told apart by all 128 bits of a set's hash and numbered when they
are stored."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.deploy import ship
from barloom.llm.common import broadcast_below, reject_clash, remove, stored, stored_at, text_batches, text_key, text_or_empty

BROADCAST_ROWS = 1_000_000  # of ids alone
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Params:
    """A link needs a Jaccard similarity of percent/100 or more. With 32 bands of 5 minima, two sets at 0.8
    share no bucket with a probability of 3e-6, and less above. A pair is compared exactly if its estimate
    is within `slack` of the threshold, over five standard errors of 160 two-bit minima."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    bits: int = 2
    slack: float = 0.2
    seed: int = 20240229
    #: Documents on a side of a tile; a task holds two sides' sets, or the long signatures of `wide` times as many.
    block: int = 256
    wide: int = 8
    #: Minima of a long signature. Pairs whose estimate is within long_slack of the threshold, over five standard
    #: errors again, are compared exactly; documents that are half alike lie over seven below it.
    long: int = 1024
    long_slack: float = 0.1


# --- one document's set -------------------------------------------------------------------------------

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(rb"[\x09-\x0D\x20]")
_STRETCH = 1 << 20
#: Longer words are hashed one by one.
_LONG_WORD = 4096


@lru_cache(maxsize=4)
def _byte_tables(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    values = rng.integers(0, _MASK, 256, dtype=np.uint64, endpoint=True)
    base = np.full(_LONG_WORD, rng.integers(0, _MASK, dtype=np.uint64) | np.uint64(1))
    base[0] = 1
    return values, np.multiply.accumulate(base)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str, seed: int) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, A-Z lower-cased."""
    data, parts, at = text.encode("utf-8", "surrogatepass").translate(_LOWER), [], 0
    while at < len(data):  # in stretches that end between words, so that long texts take little memory at once
        gap = _GAP.search(data, at + _STRETCH)
        end = gap.start() if gap else len(data)
        parts.append(_hashes(data[at:end], seed))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _hashes(data: bytes, seed: int) -> np.ndarray:
    octets = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[octets]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    values, powers = _byte_tables(seed)
    kept = octets[inside]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(kept)) - np.repeat(first, lengths)
    long = lengths > _LONG_WORD
    if long.any():
        place[place >= _LONG_WORD] = 0
    out = _mixed(np.add.reduceat(values[kept] * powers[place], first) + lengths.astype(np.uint64))
    for k in np.flatnonzero(long):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def shingle_set(text: str, words: int, seed: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of so many words; of all words if there are fewer."""
    w = word_hashes(text, seed)
    if not len(w):
        return w
    run = min(words, len(w))
    out = np.full(len(w) - run + 1, np.uint64(run))
    for i in range(run):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + w[i : i + len(out)])
    return np.unique(out)


@lru_cache(maxsize=4)
def _functions(seed: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, (k, 1), dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, (k, 1), dtype=np.uint32)


def minima(hashes: np.ndarray, p: Params, long: bool = False) -> np.ndarray:
    """One minimum for each function (those of bands, or the many of long signatures), in blocks so that long sets
    take little memory."""
    a, b = _functions(p.seed + 2, p.long) if long else _functions(p.seed + 1, p.bands * p.rows)
    low = hashes.astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    step = 512 if long else 2048
    for i in range(0, len(low), step):
        block = a * low[None, i : i + step]
        block += b
        np.minimum(out, block.min(axis=1), out=out)
    return out


def packed(mins: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of the mixed minima, 64 // bits of them in an integer, padded with zero bits."""
    low = _mixed(mins.astype(np.uint64)) & np.uint64((1 << bits) - 1)
    each = 64 // bits
    low = np.pad(low, (0, -len(low) % each)).reshape(-1, each)
    return np.bitwise_or.reduce(low << (np.arange(each, dtype=np.uint64) * np.uint64(bits)), axis=1)


def band_keys(mins: np.ndarray, p: Params) -> np.ndarray:
    out = np.arange(p.bands, dtype=np.uint64) + np.uint64(1)
    for column in mins.reshape(p.bands, p.rows).T:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


_SIGNED = "id long, tk long, n_shingles long, s1 long, s2 long, sig array<long>, bands array<long>"


def signatures(docs: DataFrame, p: Params, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: size of its set, the set's 128-bit name, packed signature, bands."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, tk, body in zip(batch["id"], batch["tk"], batch["text"], strict=True):
                hashes = shingle_set(body, p.words, p.seed)
                if not len(hashes):
                    out.append((id_, tk, 0, 0, 0, None, None))
                    continue
                name = hashlib.blake2b(hashes.tobytes(), digest_size=16, salt=p.seed.to_bytes(8, "little")).digest()
                mins = minima(hashes, p)
                out.append((id_, tk, len(hashes), *np.frombuffer(name, np.int64).tolist(), packed(mins, p.bits).view(np.int64), band_keys(mins, p).view(np.int64)))
            frame = pd.DataFrame(out, columns=["id", "tk", "n_shingles", "s1", "s2", "sig", "bands"])
            yield frame.astype({"id": "Int64"})

    return _plain(docs, key, text).mapInPandas(rows, _SIGNED)


def _plain(docs: DataFrame, key: str, text: str) -> DataFrame:
    return reject_clash(docs, key, text).select(F.col(key).cast("long").alias("id"), text_key(text).alias("tk"), text_or_empty(F.col(text)).alias("text"))


# --- pairs --------------------------------------------------------------------------------------------


def estimate(a: str, b: str, p: Params):
    """Similarity from two packed signatures: agreeing places by bit counts, less those that agree by
    chance. Padding agrees always and is taken off."""
    k, each = p.bands * p.rows, 64 // p.bits
    words = -(-k // each)
    marks = sum(1 << (p.bits * i) for i in range(each))
    marks = marks - (1 << 64) if marks >= 1 << 63 else marks
    differ = F.lit(0)
    for i in range(words):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        folded = x
        for s in range(1, p.bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(folded.bitwiseAND(F.lit(marks)))
    chance = 0.5**p.bits
    return ((1 - differ / F.lit(float(k))) - F.lit(chance)) / F.lit(1 - chance)


def _texts(nodes: DataFrame, texts_of: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """node, text. The nodes' ids are broadcast if they are few enough; else the documents shuffle."""
    wanted = stored(texts_of.join(nodes, "node", "left_semi"), "candidates")
    return stored(_plain(docs, key, text).join(broadcast_below(wanted, BROADCAST_ROWS), ["id", "tk"]).select("node", "text").dropDuplicates(["node"]), "candidate-texts")


def _in_parts(pairs: DataFrame, each: int = 200, salts: int = 32) -> DataFrame:
    """hub, node, role, and the parts from `first` to `last` that the node's text is wanted in: a partner (role 1)
    in one, the hub itself (role 0) in all of its own. A hub has a part for `each` partners, or for the root of
    their number if that is more, so parts and partners in one grow alike. Only hubs of more than one part are
    looked up, under several salts, so that no task gets all partners of one."""
    large = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > each)
    large = stored(large.select("hub", F.ceil(F.col("n") / F.greatest(F.lit(float(each)), F.sqrt("n"))).cast("int").alias("parts")), "large-hubs")
    salted = large.select(F.col("hub").alias("hub2"), "parts", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64(F.lit(2), "node"), F.lit(salts)).cast("int")
    met = pairs.join(broadcast_below(salted, BROADCAST_ROWS), (F.col("hub") == F.col("hub2")) & (salt == F.col("salt")), "left")
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")
    partners = met.select("hub", "node", F.lit(1).alias("role"), part.alias("first"), part.alias("last"))
    hubs = pairs.select("hub").distinct().join(broadcast_below(large, BROADCAST_ROWS), "hub", "left")
    return partners.union(hubs.select("hub", F.col("hub").alias("node"), F.lit(0).alias("role"), F.lit(0).alias("first"), (F.coalesce("parts", F.lit(1)) - 1).alias("last")))


def confirmed(pairs: DataFrame, texts_of: DataFrame, docs: DataFrame, p: Params, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pairs (hub, node) whose full sets are similar enough. texts_of: node, and the id and tk of a row
    of docs with its text. Texts of candidates alone are shuffled, dealt by hub; a hub with many partners
    is dealt out over several parts, each with its own copy of the hub's text, and a task holds one hub's
    set at a time."""
    texts = _texts(pairs.select(F.col("hub").alias("node")).union(pairs.select("node")).distinct(), texts_of, docs, key, text)
    met = _in_parts(pairs).join(texts, "node").select("hub", F.explode(F.sequence("first", "last")).alias("part"), "role", "node", "text")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, own = None, None
        for batch in batches:
            out = []
            for h, part, role, node, body in zip(batch["hub"], batch["part"], batch["role"], batch["node"], batch["text"], strict=True):
                hashes = shingle_set(body, p.words, p.seed)
                if role == 0:
                    hub, own = (h, part), hashes
                    continue
                if hub != (h, part):
                    raise RuntimeError("a partner came before its hub")
                both = len(np.intersect1d(own, hashes, assume_unique=True))
                if 100 * both >= p.percent * (len(own) + len(hashes) - both):
                    out.append((h, node))
            yield pd.DataFrame(out, columns=["hub", "node"]).astype("int64")

    dealt = met.repartition("hub", "part").sortWithinPartitions("hub", "part", "role")
    return dealt.mapInPandas(compare, "hub long, node long")


def components(links: DataFrame) -> DataFrame:
    """node, component (one node of it, the smallest) for all nodes of links (hub, node), by large-star and
    small-star steps: each hangs a node's neighbours below the smallest of them, until nothing changes."""
    edges, path = stored_at(links.where("hub <> node").select(F.greatest("hub", "node").alias("a"), F.least("hub", "node").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least).distinct()
        old = path
        edges, path = stored_at(small, "edges")
        remove(old)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(own)


def _open_links(buckets: DataFrame, labels: DataFrame, texts_of: DataFrame, docs: DataFrame, p: Params, key: str, text: str) -> DataFrame | None:
    """Links (hub, node) across components within buckets that still hold more than one; None if there are no
    such buckets. Any such pair has a member outside its bucket's largest component, so those members meet all
    of the bucket, by their long signatures, in tiles of p.wide * p.block documents a side. Of each tile of p.block
    by p.block in it that has a likely pair, the documents of such pairs alone are compared exactly; of the links
    between two components a tile returns one. Buckets with equal members count once."""
    labelled = stored(buckets.join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")), "labelled")
    sizes = labelled.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"))
    open_ = sizes.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("rows"), F.max(F.struct("n", "component")).alias("most"), F.bit_xor("x").alias("x")).where("parts > 1")
    open_ = open_.groupBy("x", "rows", "parts").agg(F.min(F.struct("band", "most")).alias("b")).select("b.band", "rows", F.col("b.most.n").alias("largest_n"), F.col("b.most.component").alias("largest"))
    open_ = stored(open_, "open-buckets")
    if open_.isEmpty():
        return None

    def tiles(n, size):
        return F.ceil(n / size).cast("int")

    members = labelled.join(open_.withColumns({"across": tiles(F.col("rows") - F.col("largest_n"), p.block), "down": tiles(F.col("rows"), p.block)}), "band")
    place = F.xxhash64("node")
    members = members.withColumns({"a": F.pmod(place, F.col("across")).cast("int"), "d": F.pmod(place, F.col("down")).cast("int")})
    members = stored(members.select("band", "node", "component", (F.col("component") != F.col("largest")).alias("outside"), "a", "d", "across", "down"), "open-members")
    texts = _texts(members.select("node").distinct(), texts_of, docs, key, text)

    def over(n: str):
        return F.explode(F.sequence(F.lit(0), tiles(F.col(n), p.wide) - 1))

    def wide(n: str):
        return F.floor(F.col(n) / p.wide).cast("int")

    mine = members.where("outside").select("band", wide("a").alias("wa"), over("down").alias("wd"), F.lit(0).alias("side"), "node", "component", F.col("a").alias("at"))
    every = members.select("band", over("across").alias("wa"), wide("d").alias("wd"), F.lit(1).alias("side"), "node", "component", F.col("d").alias("at"))
    met = mine.union(every).join(stored(_long_signatures(texts, p), "long-signatures"), "node").repartition("band", "wa", "wd").sortWithinPartitions("band", "wa", "wd", "side")
    dealt = stored(_likely_members(met, p), "tiles").join(texts, "node").repartition("band", "a", "d").sortWithinPartitions("band", "a", "d", "side")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _by_tile(batches, ("band", "a", "d"), ("node", "component", "text"), lambda node, component, body: (node, component, shingle_set(body, p.words, p.seed)), lambda _, x, y: _links_in_tile(x, y, p)):
            yield pd.DataFrame(out, columns=["hub", "node"]).astype("int64")

    return stored(dealt.mapInPandas(compare, "hub long, node long"), "open-links")


def _by_tile(batches: Iterator[pd.DataFrame], keys: tuple[str, ...], columns: tuple[str, ...], read: Callable, finish: Callable) -> Iterator[list]:
    """What finish(tile, side 0, side 1) lists for each tile, over rows that come by tile; a side is a list of
    what read() makes of a row's columns."""
    tile, sides = None, ([], [])
    for batch in batches:
        out = []
        for row in zip(*[batch[c] for c in (*keys, "side", *columns)], strict=True):
            own = row[: len(keys)]
            if own != tile:
                out += finish(tile, *sides)
                tile, sides = own, ([], [])
            sides[row[len(keys)]].append(read(*row[len(keys) + 1 :]))
        yield out
    yield finish(tile, *sides)


def _long_signatures(texts: DataFrame, p: Params) -> DataFrame:
    """node, n (size of its set), sig: its many minima's lowest bits."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node, body in zip(batch["node"], batch["text"], strict=True):
                hashes = shingle_set(body, p.words, p.seed)
                out.append((node, len(hashes), packed(minima(hashes, p, long=True), 1).view(np.int64)))
            yield pd.DataFrame(out, columns=["node", "n", "sig"])

    return texts.mapInPandas(rows, "node long, n long, sig array<long>")


def _likely_members(met: DataFrame, p: Params) -> DataFrame:
    """band, a, d, side, node, component of the members of each narrow tile that have a partner of another
    component there, near enough by long signatures and by the sizes of their sets."""
    least = p.percent / 100 - p.long_slack

    def finish(tile: tuple | None, rows: list, columns: list) -> list:
        out = []
        if not rows or not columns:
            return out
        sig_b, n_b, comp_b, at_b = (np.array([x[i] for x in columns]) for i in (1, 2, 3, 4))
        sig_a, n_a, comp_a, at_a = (np.array([x[i] for x in rows]) for i in (1, 2, 3, 4))
        likely = np.zeros((len(rows), len(columns)), bool)
        for i in range(0, len(rows), 64):
            s = slice(i, i + 64)
            differ = np.bitwise_count((sig_a[s, None, :] ^ sig_b[None, :, :]).view(np.uint64)).sum(axis=2, dtype=np.int32)
            likely[s] = 1 - 2 * differ / p.long >= least
            likely[s] &= comp_a[s, None] != comp_b[None, :]
            likely[s] &= 100 * np.minimum(n_a[s, None], n_b[None, :]) >= p.percent * np.maximum(n_a[s, None], n_b[None, :])
        for a in np.unique(at_a[likely.any(axis=1)]):
            of_a = np.flatnonzero(at_a == a)
            for d in np.unique(at_b[likely[of_a].any(axis=0)]):
                of_d = np.flatnonzero(at_b == d)
                some = likely[np.ix_(of_a, of_d)]
                out += [(tile[0], int(a), int(d), 0, rows[k][0], rows[k][3]) for k in of_a[some.any(axis=1)]]
                out += [(tile[0], int(a), int(d), 1, columns[k][0], columns[k][3]) for k in of_d[some.any(axis=0)]]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _by_tile(batches, ("band", "wa", "wd"), ("node", "sig", "n", "component", "at"), lambda *x: x, finish):
            yield pd.DataFrame(out, columns=["band", "a", "d", "side", "node", "component"]).astype("int64")

    return met.mapInPandas(run, "band long, a int, d int, side int, node long, component long")


def _links_in_tile(rows: list[tuple], columns: list[tuple], p: Params) -> list[tuple[int, int]]:
    """One link, as (smaller node, larger node), for each two components that have any between rows and
    columns, both of (node, component, set). Intersections are counted for all pairs at once, as products of
    incidence matrices over the hashes that both sides hold, some thousands of them at a time."""
    if not rows or not columns:
        return []
    both = np.zeros((len(rows), len(columns)), np.float32)
    shared = np.intersect1d(np.unique(np.concatenate([s for *_, s in rows])), np.unique(np.concatenate([s for *_, s in columns])), assume_unique=True)
    for i in range(0, len(shared), 4096):
        some = shared[i : i + 4096]

        def incidence(side: list[tuple], some=some) -> np.ndarray:
            out = np.zeros((len(side), len(some)), np.float32)
            for k, (*_, s) in enumerate(side):
                s = s[np.searchsorted(s, some[0]) : np.searchsorted(s, some[-1], "right")]
                at = np.searchsorted(some, s)
                out[k, at[some[at] == s]] = 1
            return out

        both += incidence(rows) @ incidence(columns).T
    n, m = (np.array([len(s) for *_, s in side], np.float64) for side in (rows, columns))
    a, b = (np.array([c for _, c, _ in side], np.int64) for side in (rows, columns))
    linked = (100 * both >= p.percent * (n[:, None] + m[None, :] - both)) & (a[:, None] != b[None, :])
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for i, j in np.argwhere(linked):
        x, y = rows[i][0], columns[j][0]
        found.setdefault(tuple(sorted((int(a[i]), int(b[j])))), (min(x, y), max(x, y)))
    return list(found.values())


def near_duplicates(docs: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, h (tells apart rows that repeat a key with another text), n_shingles,
    component_id (the smallest id that links reach) and kept.

    A text without words, or null, has an empty set and is linked with nothing; so is a row without an id.
    Repeated rows share their component, and rows that repeat an id with another text are linked by their
    own text. Empty tables give empty ones. Only the id and text columns of docs are read, whatever
    others it has."""
    ship(docs.sparkSession)
    text_batches(docs.sparkSession)
    signed = stored(signatures(docs, p, key, text), "signatures")
    linked = signed.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    # Documents of one set have one signature; the class is numbered by what is stored, so that two sets share a
    # number only if all of their names agree.
    of_set = linked.groupBy("s1", "s2").agg(F.min(F.struct("id", "tk")).alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = stored(of_set.select("s1", "s2", "rep.id", "rep.tk", "sig", "bands", F.monotonically_increasing_id().alias("node")), "classes")
    reps = classes.select("node", "sig", "bands")
    banded = reps.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub < other")
    buckets = stored(banded.join(shared.drop("other"), "band"), "buckets")
    texts_of = classes.select("node", "id", "tk")

    def links(pairs: DataFrame) -> DataFrame:
        one, two = reps.select("node", F.col("sig").alias("sig1")), reps.select(F.col("node").alias("hub"), F.col("sig").alias("sig2"))
        likely = pairs.join(one, "node").join(two, "hub").where(estimate("sig1", "sig2", p) >= p.percent / 100 - p.slack).select("hub", "node")
        return stored(confirmed(stored(likely, "likely-pairs"), texts_of, docs, p, key, text), "links")

    edges = links(stored(buckets.where("hub <> node").select("hub", "node").distinct(), "star-pairs"))
    labels = stored(components(edges), "labels")
    across = _open_links(buckets.select("band", "node"), labels, texts_of, docs, p, key, text)
    if across is not None and not across.isEmpty():
        # Old components are one edge a node; only what the new links touch changes.
        labels = stored(components(labels.select(F.col("component").alias("hub"), "node").union(across)), "labels")
    grouped = classes.select("node", "id").join(labels, "node")
    least = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    named = stored(grouped.join(least, "component").select("node", "component_id"), "component-ids")
    named = classes.select("node", "id", "s1", "s2").join(named, "node", "left").select(F.col("s1").alias("n1"), F.col("s2").alias("n2"), F.coalesce("component_id", "id").alias("component_id"))
    rows = signed.select("id", "tk", "n_shingles", *[F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col(s)).alias(s) for s in ("s1", "s2")])
    component = F.coalesce("component_id", "id")
    met = rows.join(named, (F.col("s1") == F.col("n1")) & (F.col("s2") == F.col("n2")), "left")
    return met.select(F.col("id").alias(key), F.col("tk").alias("h"), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op3_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents, on shingles of two words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Params(words=2)).drop("h")
