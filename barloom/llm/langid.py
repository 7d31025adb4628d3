"""Language identification by Bayesian fusion of evidence.

For each language, the posterior takes in the text's likelihood under byte trigrams (tempered, as trigrams of
one text repeat each other's news), what the markup declares, and the prior of the host. Host priors are grouped counts
of the languages that texts alone point to, smoothed from the address's suffix down: a host draws on its registered
domain, that on its suffix, that on the whole table. What a suffix speaks for is so learnt from the table, and a row's
own text is left out of all its counts, as it is evidence already."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.deploy import ship
from barloom.llm import html_extract
from barloom.llm.common import broadcast_below, reject_clash, stored, text_batches, text_key, text_or_empty

BUCKETS = 1 << 16
#: Labelled rows a language that the model is fitted on, at most.
FIT_ROWS = 300
_PARTS = 64
_BLOCK = 1 << 20
#: How far, in nats a trigram, a text may lie below the mean of the languages' own texts. Those vary by a few
#: tenths, and other prose of the same language lies one or two lower; random letters lie five or more lower.
FLOOR = 3.0
#: A text's own mean is off by the spread of single trigrams over the root of their number; so many times that is
#: allowed for.
ERRORS = 3.0
#: Labels with fewer distinct texts are none: tags in markup are noisy. Of more than so many labels, those with the
#: most texts count; both bound the model and what the driver gets of it.
LEAST_TEXTS, LABELS = 5, 256

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Digits and ASCII punctuation say nothing of a language and read as one space.
_LETTERS = bytes(c if c in b"abcdefghijklmnopqrstuvwxyz" or c > 127 else 32 for c in _LOWER)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Bucket of each byte trigram of the text's letters, runs of other characters being one space; a block at a
    time, so that long texts take little memory at once."""
    data = b" ".join([b"", *text.encode("utf-8", "replace").translate(_LETTERS).split(), b""])
    for at in range(0, len(data) - 2, _BLOCK):
        b = np.frombuffer(data, np.uint8, min(_BLOCK + 2, len(data) - at), at).astype(np.uint32)
        x = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
        yield (x >> np.uint32(16)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """languages, and a row of log probabilities of each trigram bucket for each; mean and spread: of a trigram's
    log probability in the texts that it was fitted on, under their own language."""

    languages: tuple[str, ...]
    logp: np.ndarray
    mean: float
    spread: float

    def floor(self, n: Column) -> Column:
        """The mean log probability below which a text of n trigrams is in none of the languages."""
        return F.lit(self.mean - FLOOR) - F.lit(ERRORS * self.spread) / F.sqrt(n)


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", rows: int = FIT_ROWS, smoothing: float = 0.5, least: int = LEAST_TEXTS, labels: int = LABELS, read: Callable[[DataFrame], DataFrame] | None = None) -> Model:
    """Fits on at most `rows` rows of each label, those whose text hashes lowest; a bounded sample, as the
    counts of some hundred texts change little with more. read: makes the sample's texts of what stands in its
    column `text`. Rows without text or label are left out, and so are labels with fewer than `least` distinct texts and,
    if there are more than `labels`, those with the fewest; of ties, those that sort last."""
    ship(labelled.sparkSession)
    chosen = reject_clash(labelled, text, label).where(F.col(text).isNotNull() & F.col(label).isNotNull())
    ids = chosen.select(F.col(label).alias("label"), F.xxhash64(F.lit(5), F.col(text)).alias("h")).distinct()
    counts = ids.groupBy("label").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= least).orderBy(F.desc("texts"), "label").limit(labels)
    ids = ids.join(F.broadcast(counts.select("label")), "label", "left_semi")
    # The lowest of each of many parts of a label first, so that no task sorts a label whole: the second window
    # has _PARTS times `rows` rows of a label at most.
    parted = Window.partitionBy("label", F.pmod("h", F.lit(_PARTS))).orderBy("h")
    lowest = ids.withColumn("r", F.row_number().over(parted)).where(F.col("r") <= rows)
    first = lowest.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("r") <= rows).select("label", "h")
    sample = chosen.select(F.col(label).alias("label"), F.xxhash64(F.lit(5), F.col(text)).alias("h"), F.col(text).alias("text")).join(broadcast_below(stored(first, "sample"), 100_000), ["label", "h"])
    sample = sample.dropDuplicates(["label", "h"])
    counted = _counts(read(sample) if read else sample)
    own = counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows a label at most
    languages = tuple(sorted(own["label"].unique()))
    counts = np.zeros((max(1, len(languages)), BUCKETS))
    counts[own["label"].map({x: k for k, x in enumerate(languages)}).to_numpy(int), own["bucket"].to_numpy(int)] = own["n"].to_numpy(float)
    smoothed = counts + smoothing
    logp = np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).astype(np.float32)
    total = counts.sum()
    if not total:
        return Model(languages, logp, -np.inf, 0.0)
    mean = float((counts * logp).sum() / total)
    return Model(languages, logp, mean, float(np.sqrt(max(0.0, (counts * logp.astype(float) ** 2).sum() / total - mean * mean))))


#: Parts of a label's sample, at most, that are counted by themselves.
_COUNTED = 4


def _counts(sample: DataFrame) -> DataFrame:
    """label, bucket, n: a row for each trigram bucket of each of a few parts of a label's texts, however many partitions
    they stand in."""

    def rows(key: tuple, texts: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(BUCKETS, np.int64)
        for body in texts["text"]:
            for x in trigrams(body or ""):
                n += np.bincount(x, minlength=BUCKETS)
        at = np.flatnonzero(n)
        return pd.DataFrame({"label": key[0], "bucket": at, "n": n[at]})

    part = F.pmod(F.xxhash64("text"), F.lit(_COUNTED)).alias("part")
    return sample.select("label", "text", part).groupBy("label", "part").applyInPandas(rows, "label string, bucket int, n long")


def language_tag(declared: Column) -> Column:
    """The language of a tag such as de-AT, lower-cased; empty if it is none."""
    return F.lower(F.regexp_extract(F.coalesce(declared.cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))


def host_of(url: Column) -> Column:
    """The host of an address, lower-cased, without port; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _evidence(rows: DataFrame, model: Model, temper: float) -> DataFrame:
    """Adds n_grams, ll (the text's log likelihood for each language, less the likeliest's), and own: what the text
    alone points to, one divided among the languages as its tempered likelihoods are, in millionths, so that sums don't
    depend on their order; nothing for a text without letters. own_total is its sum."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for body in batch["text"]:
                n, ll = 0, np.zeros(len(model.languages))
                for x in trigrams(body):
                    n += len(x)
                    ll += [p[x].sum(dtype=np.float64) for p in model.logp]
                best = float(ll.max())
                p = np.exp((ll - best) * temper)
                own = np.floor(p / p.sum() * 1e6 + 0.5).astype(np.int64) if n else np.zeros(len(p), np.int64)
                found.append((n, (ll - best).tolist(), best / n if n else 0.0, own.tolist(), int(own.sum())))
            columns = dict(zip(("n_grams", "ll", "mean_ll", "own", "own_total"), zip(*found, strict=True) if found else [[]] * 5, strict=True))
            yield batch.drop(columns=["text"]).assign(**columns).astype({"id": "Int64"})

    return rows.mapInPandas(score, "id long, h long, declared string, host string, n_grams long, ll array<double>, mean_ll double, own array<long>, own_total long")


def _argmax(values: Column, languages: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position(values, F.array_max(values)).cast("int"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _levels(counts: DataFrame, name: str, k: int) -> DataFrame:
    """name, and its counts as an array with a place for each language; counts has a row for each that isn't 0."""
    held = F.map_from_entries(F.collect_list(F.struct("k", "n")))
    dense = counts.groupBy(name, "k").agg(F.sum("n").alias("n")).groupBy(name).agg(held.alias("held"))
    return dense.select(name, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long"))).alias(f"{name}_counts"))


def _with_priors(scored: DataFrame, k: int, strength: float) -> DataFrame:
    """scored with log_prior, an array. Counts come from the whole table but for the row itself; a level's distribution
    is its own counts and `strength` draws from the level above. Rows without a host share one and draw on the table."""
    each = scored.select("host", F.posexplode("own").alias("k", "n")).where("n > 0")
    by_host = stored(each.groupBy("host", "k").agg(F.sum("n").alias("n")), "host-counts")
    labels = F.split("host", r"\.")
    last = F.least(F.size(labels), F.lit(2))
    named = {"suffix": F.element_at(labels, -1), "domain": F.array_join(F.slice(labels, -last, last), ".")}
    known = by_host.where("host IS NOT NULL").withColumns(named)
    hosts = scored.select("host").distinct().withColumns(named).join(_levels(known, "domain", k), "domain", "left").join(_levels(known, "suffix", k), "suffix", "left")
    dense = _levels(by_host, "host", k).withColumnRenamed("host", "host3")
    hosts = hosts.join(dense, hosts["host"].eqNullSafe(dense["host3"]), "left").select(F.col("host").alias("host2"), *[F.coalesce(f"{x}_counts", F.array_repeat(F.lit(0).cast("long"), k)).alias(f"{x}_counts") for x in ("host", "domain", "suffix")])
    hosts = hosts.withColumns({f"{x}_total": _total(F.col(f"{x}_counts")) for x in ("host", "domain", "suffix")})
    sums = {r.k: r.n for r in by_host.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # a number for each language
    whole = F.array(*[F.lit(int(sums.get(i, 0))).cast("long") for i in range(k)])
    met = scored.join(broadcast_below(stored(hosts, "host-priors"), 100_000), F.col("host").eqNullSafe(F.col("host2")), "left")

    def prior(i: Column) -> Column:
        def drawn(level: str, above: Column) -> Column:
            return ((F.col(f"{level}_counts")[i] - F.col("own")[i]) / 1e6 + strength * above) / ((F.col(f"{level}_total") - F.col("own_total")) / 1e6 + strength)

        table = ((whole[i] - F.col("own")[i]) / 1e6 + 1) / ((F.lit(sum(sums.values())) - F.col("own_total")) / 1e6 + k)
        return F.log(drawn("host", F.when(F.col("host").isNull(), table).otherwise(drawn("domain", drawn("suffix", table)))))

    return met.withColumn("log_prior", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), prior))


def identify(
    rows: DataFrame, model: Model, key: str, text: str | None, declared: Column | None = None, host: Column | None = None, temper: float = 0.1,
    trust_declared: float = 0.9, strength: float = 10.0, accept: float = 0.6,
) -> DataFrame:
    """One row per row of rows: key, h (tells apart rows that repeat a key with another text), language (null
    if there is no evidence of any), posterior, text_language, declared, host, accepted.

    Accepted are rows whose text has letters, whose trigrams are as likely as texts of some language (the fewer
    they are, the wider the margin, by one rule for all lengths), and whose posterior is `accept` or more. A null text is an empty one and is not accepted; a null or unknown
    declaration, suffix or host adds no evidence. A model of no language accepts nothing. Repeated rows have a row each, an empty table gives an
    empty one, and no other column of rows is read."""
    ship(rows.sparkSession)
    text_batches(rows.sparkSession)
    languages = model.languages
    if not languages:  # fitted on no row
        nothing = {c: F.lit(None).cast(t) for c, t in (("language", "string"), ("posterior", "double"), ("text_language", "string"), ("declared", "string"), ("host", "string"))}
        return rows.select(F.col(key).cast("long").alias(key), text_key(text).alias("h"), *[x.alias(c) for c, x in nothing.items()], F.lit(False).alias("accepted"))
    plain = rows.select(F.col(key).cast("long").alias("id"), text_key(text).alias("h"), (declared if declared is not None else F.lit(None)).cast("string").alias("declared"), (host if host is not None else F.lit(None)).cast("string").alias("host"), text_or_empty(F.col(text)).alias("text"))
    plain = plain.withColumn("declared", language_tag(F.col("declared")))
    met = _with_priors(stored(_evidence(plain, model, temper), "language-evidence"), len(languages), strength)
    # A declaration is right with its trust, else any other language alike.
    met = met.withColumn("said", F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("declared")) - 1)
    right, wrong = np.log(trust_declared), np.log((1 - trust_declared) / max(1, len(languages) - 1))

    def fused(i: Column) -> Column:
        told = F.when(F.col("said") < 0, 0.0).when(F.col("said") == i, F.lit(float(right))).otherwise(F.lit(float(wrong)))
        return F.col("ll")[i] * temper + told + F.col("log_prior")[i]

    out = met.withColumn("logs", F.transform(F.sequence(F.lit(0), F.lit(len(languages) - 1)), fused)).withColumn("top", F.array_max("logs"))
    out = out.withColumn("posterior", 1 / F.aggregate(F.transform("logs", lambda v: F.exp(v - F.col("top"))), F.lit(0.0), lambda a, v: a + v))
    evident = (F.col("n_grams") > 0) | (F.col("said") >= 0) | F.col("host").isNotNull()
    ok = (F.col("n_grams") > 0) & (F.col("mean_ll") >= model.floor(F.col("n_grams"))) & (F.col("posterior") >= accept)
    return out.select(
        F.col("id").alias(key), "h", F.when(evident, _argmax(F.col("logs"), languages)).alias("language"), F.round("posterior", 6).alias("posterior"),
        F.when(F.col("n_grams") > 0, _argmax(F.col("ll"), languages)).alias("text_language"), F.nullif(F.col("declared"), F.lit("")).alias("declared"), "host", ok.alias("accepted"),
    )


def page_declares(page: Column) -> Column:
    """The language that a page's markup declares, empty if none."""
    return language_tag(F.regexp_extract(F.coalesce(page, F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z_-]+)", 1))


def page_rows(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, text (the main text), declared (by the markup of the whole page, a tag), host of each page. A page that
    is null has an empty text and declares nothing; a null address has no host."""
    declared = page_declares(F.col(page))
    named = reject_clash(pages, key, url, page).select(F.col(key), F.col(page), declared.alias("declared"), host_of(F.col(url)).alias("host"))
    return html_extract.extract(named, key, page, ("declared", "host")).drop("n_chars")


def fit_on_pages(pages: DataFrame, page: str = "html") -> Model:
    """Fits on the main texts of a bounded sample of pages by what their markup declares."""
    declared = page_declares(F.col(page))
    labelled = reject_clash(pages, page).select(F.col(page).alias("text"), F.nullif(declared, F.lit("")).alias("label"))
    return fit(labelled, "text", "label", read=lambda sample: html_extract.extract(sample, "h", "text", ("label",)))


def op7_evidence_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, with their declared one and their source as host. The model is fitted on
    pages, so that what documents declare is evidence of its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_on_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return identify(docs, model, "doc_id", "text", F.col("lang"), F.col("source")).drop("h")


def op7_pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all pages by their main text, what the markup declares, host and suffix. The model is fitted
    on documents, so that what pages declare is evidence of its own."""
    model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return identify(rows, model, "page_id", "text", F.col("declared"), F.col("host")).drop("h")
