"""Whitening of embeddings by a compensated covariance.

The mean is an exact sum over a count. Centred vectors are cut into slices of few bits, whose outer products add up in
doubles without any rounding error; these sums are accumulated as pairs of a high and a low double by error-free
additions, in each task and then across tasks. The driver gets a matrix of the dimension alone, and solves it by
reduction to a tridiagonal matrix and divide and conquer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.deploy import ship
from barloom.llm.common import reject_clash, stored

#: Units of a vector's entry.
UNITS = 256
COMPONENTS = 4
#: Vectors whose outer products are summed at once, bits of a slice, and slices. Products have twice the bits of a
#: slice, and with as many summed they must fit a double's 53; three slices hold an entry to 2^-60 of its column's
#: largest in the block.
ROWS, BITS, SLICES = 1024, 20, 3
#: An eigenvalue below this share of the trace is none.
NOUGHT = 1e-13
#: Vectors that Python handles at once.
BATCH = 4096


@dataclass(frozen=True)
class Whitening:
    """Of the fit list: its size, sums, mean as high and low doubles, eigenvalues, eigenvectors as columns, trace."""

    n: int
    sums: tuple[int, ...]
    mean: tuple[np.ndarray, np.ndarray]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


# --- pairs of doubles


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its error: together exactly a + b."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded product and its error, by products of the factors' halves."""

    def halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = v * 134217729.0
        high = c - (c - v)
        return high, v - high

    p, (ah, al), (bh, bl) = a * b, halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two pairs as a pair."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x - mean as pairs; x are integers, which may exceed a double's 53 bits."""
    high = x.astype(np.float64)
    low = (x - np.clip(high, -(2.0**63), 2.0**63 - 1024).astype(np.int64)).astype(np.float64)
    return add((high, low), (-mean[0], -mean[1]))


def slices(d: tuple[np.ndarray, np.ndarray], top: np.ndarray) -> list[np.ndarray]:
    """Cuts pairs, a column's below 2^top of it, into parts of BITS bits each, in units that fall by 2^-BITS; each is
    exact."""
    high, low = d
    out = []
    for i in range(1, SLICES + 1):
        unit = np.ldexp(1.0, top - i * BITS)
        part = np.rint(high / unit)
        out.append(part)
        high, low = two_sum(high - part * unit, low)
    return out


def outer(d: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the rows' outer products as a pair. Products of slices are whole numbers whose sums a double
    holds, so that matrix products of them have no rounding error."""
    top = np.frexp(np.abs(d[0]).max(axis=0))[1] + 1
    scale = top[:, None] + top[None, :]
    total = (np.zeros(scale.shape), np.zeros(scale.shape))
    parts = slices(d, top)
    for i, a in enumerate(parts, 1):
        for j, b in enumerate(parts, 1):
            if i + j <= SLICES + 1:
                total = add(total, (np.ldexp(a.T @ b, scale - (i + j) * BITS), np.zeros(scale.shape)))
    return total


# --- frames


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id as text, which keeps nulls and all digits in Python, and x, the vector in units of 1 / UNITS rounded down, of rows whose vector has entries and all of them are
    finite. If vectors differ in length, only those of the most frequent length are kept, the longer one on ties."""
    v = F.transform(F.col("v"), lambda c: c.cast("double"))
    finite = (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    plain = reject_clash(rows, key, vector).select(F.col(key).cast("string").alias("id"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & finite)
    lengths = plain.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(2).collect()
    if len(lengths) > 1:
        plain = plain.where(F.size("v") == lengths[0]["size"])
    return plain.select("id", F.transform(v, lambda c: F.floor(c * UNITS).cast("long")).alias("x"))


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    for batch in batches:
        for i in range(0, len(batch), BATCH):
            yield np.stack(batch["x"].iloc[i : i + BATCH].to_numpy()).astype(np.int64)


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, None
        for x in _vectors(batches):
            halves = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            total = halves if total is None else (total[0] + halves[0], total[1] + halves[1])
            n += len(x)
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total[0])), "n": n, "high": total[0], "low": total[1]})

    parts = fit.mapInPandas(add_up, "i long, n long, high long, low long")
    whole = [F.sum(F.col(c).cast("decimal(28, 0)")).alias(c) for c in ("high", "low")]
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), *whole).orderBy("i").collect()
    return (rows[0].n if rows else 0), [int(r.high) * 2**32 + int(r.low) for r in rows]


def mean_of(n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    high = np.array([float(Fraction(s, n)) for s in total])
    low = np.array([float(Fraction(s, n) - Fraction(h)) for s, h in zip(total, high, strict=True)])
    return high, low


def covariance(fit: DataFrame, n: int, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Centred covariance of the fit list as a pair of matrices. A task sends a row for each line of its matrix; lines
    are added up one by one where they meet."""
    size = len(mean[0])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for x in _vectors(batches):
            for i in range(0, len(x), ROWS):
                part = outer(centred(x[i : i + ROWS], mean))
                total = part if total is None else add(total, part)
        if total is not None:
            yield pd.DataFrame({"i": np.arange(size), "high": list(total[0]), "low": list(total[1])})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        done: list[tuple[int, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for i, high, low in zip(batch["i"], batch["high"], batch["low"], strict=True):
                if i != now:
                    if total is not None:
                        done.append((now, *total))
                    now, total = i, (high, low)
                else:
                    total = add(total, (high, low))
        if total is not None:
            done.append((now, *total))
        yield pd.DataFrame(done, columns=["i", "high", "low"])

    schema = "i long, high array<double>, low array<double>"
    lines = fit.mapInPandas(task, schema).repartition("i").sortWithinPartitions("i").mapInPandas(merge, schema)
    high, low = np.zeros((size, size)), np.zeros((size, size))
    for r in lines.toLocalIterator():
        high[r.i], low[r.i] = r.high, r.low
    quotient = high / n
    p, e = two_product(quotient, np.float64(n))
    return two_sum(quotient, ((high - p) - e + low) / n)


def eigen(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and their unit vectors as columns, by reduction to a tridiagonal matrix and divide
    and conquer (LAPACK's syevd). The largest entry of a vector is positive. What the low parts add to an eigenvalue
    is brought in to first order."""
    values, vectors = np.linalg.eigh((high + high.T) / 2)
    values = values + np.einsum("ij,ij->j", vectors, (low + low.T) / 2 @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    lead = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[lead, np.arange(len(values))] < 0, -1.0, 1.0)


def fit_list(vectors: DataFrame) -> DataFrame:
    """Each distinct vector once, stored. Copies of one meet in their task before the shuffle."""
    return stored(vectors.select("x").distinct(), "fit-list")


def fit(distinct: DataFrame) -> Whitening | None:
    """The whitening of a fit list; None if it is empty."""
    ship(distinct.sparkSession)
    n, total = sums(distinct)
    if not n:
        return None
    mean = mean_of(n, total)
    high, low = covariance(distinct, n, mean)
    values, vectors = eigen(high, low)
    diagonal = np.diagonal(high), np.diagonal(low)
    trace = reduce(add, zip(diagonal[0], diagonal[1], strict=True), (np.float64(0), np.float64(0)))
    return Whitening(n, tuple(total), mean, values, vectors, float(trace[0] + trace[1]))


def components(w: Whitening, most: int = COMPONENTS) -> int:
    """How many of the first `most` components have an eigenvalue at all."""
    return int(np.sum(w.values[:most] > w.trace * NOUGHT))


def _deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Sum of squares of n * x - sums for each row; None beyond a long. Whole numbers throughout."""
    bound = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + int(np.abs(total).max(initial=0))
    if bound**2 * x.shape[1] < 2**63:
        return ((x * n - total.astype(np.int64)) ** 2).sum(1).tolist()
    exact = ((x.astype(object) * n - total) ** 2).sum(1)
    return [int(v) if v < 2**63 else None for v in exact]


def project(vectors: DataFrame, w: Whitening, most: int = COMPONENTS) -> DataFrame:
    """id, deviation and the array `whitened` of the first components of each vector."""
    k = components(w, most)
    basis = w.vectors[:, :k] / np.sqrt(w.values[:k])
    total = np.array(w.sums, object)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), BATCH):
                part = batch.iloc[i : i + BATCH]
                x = np.stack(part["x"].to_numpy()).astype(np.int64)
                high, low = centred(x, w.mean)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "deviation": pd.array(_deviations(x, w.n, total), "Int64"), "whitened": list(high @ basis + low @ basis)})

    return vectors.mapInPandas(task, "id string, deviation long, whitened array<double>")


def identity_error(distinct: DataFrame, w: Whitening, most: int = COMPONENTS) -> float:
    """The largest entry of the difference between the identity and the covariance that the whitened fit list has,
    by centred co-moments that Spark merges."""
    k = components(w, most)
    out = project(distinct.select(F.lit("").alias("id"), "x"), w, most).select(*[F.col("whitened")[i].alias(f"w{i}") for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = out.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(row, pairs, strict=True))


def whiten(rows: DataFrame, most: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error for each row with a whole vector and each of
    the first `most` components that have an eigenvalue above nought.

    Rows whose vector is null, empty or holds null, NaN or infinite entries have no row, nor has any where all
    vectors are equal. Ids may be null or repeat. Copies of a vector count once in the fit list and each have their
    rows. Ties of eigenvalues are in the solver's order. An empty table gives an empty one. deviation is null beyond
    a long's range."""
    spark = rows.sparkSession
    ship(spark)
    vectors = whole_vectors(rows, key, vector)
    distinct = fit_list(vectors)
    w = fit(distinct)
    kind = rows.schema[key].dataType.simpleString()
    if w is None or not components(w, most):
        return spark.createDataFrame([], f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(distinct, w, most)
    explained = F.array(*[F.lit(float(v / w.trace)) for v in w.values[: components(w, most)]])
    each = project(vectors, w, most).select("id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select(
        F.col("id").cast(kind).alias(key), (F.col("i") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("i")].alias("explained"), F.lit(float(error)).alias("identity_error")
    )


def op13_double_double_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings' first four whitened components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
