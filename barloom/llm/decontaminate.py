"""Benchmark decontamination over a positional inverted index.

The index holds (term, document, position) of all terms of the test set in the whole corpus. It is stored once:
it tells how often each term stands in the corpus, and where. One reading of it keeps the lists that are looked
up, those of each window's two rarest terms, as a small table. A window's places are where the lists of its two
rarest terms agree once each is shifted by the term's offset; the documents' own words then confirm every such
place. The same lists give proximity matches. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import broadcast_below, lower_ascii, reject_clash, stored, text_key, text_or_empty

#: Fixed value: what separates words, before A-Z are lower-cased.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: A frame of this module is broadcast only up to so many rows, and as many bytes as any broadcast may have.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN_WORDS), "")


def term(word: Column) -> Column:
    """What terms are looked up by. It is coarser than lower-casing A-Z (other letters change too) and far
    cheaper on a whole corpus; exact words are compared afterwards, so it adds places to look at and
    loses none."""
    return F.lower(word)


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id and h (which tells apart rows that repeat an id with another text), and the text."""
    return reject_clash(docs, key, text).select(F.col(key).alias("id"), text_key(text).alias("h"), text_or_empty(F.col(text)).alias("text"))


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings (term, id, h, pos) of the vocabulary's terms, stored. docs: what _documents() gives. They stay in the
    documents' order, in which ids and places compress best."""
    return stored(
        docs.select("id", "h", F.posexplode(words(F.col("text"))).alias("pos", "w"))
        .select("id", "h", "pos", term(F.col("w")).alias("term"))
        .join(broadcast_below(vocabulary, BROADCAST_ROWS), "term", "left_semi"),
        "postings",
    )


def looked_up(index: DataFrame, probes: DataFrame) -> DataFrame:
    """The postings of the terms that probes look up, which are the rarer ones, stored: the index is read once
    for them, and phrases and proximity matches then read these alone."""
    wanted = stored(probes.select(F.explode(F.array("term1", "term2")).alias("term")).where(F.col("term").isNotNull()).distinct(), "looked-up-terms")
    return stored(index.join(broadcast_below(wanted, BROADCAST_ROWS), "term", "left_semi"), "looked-up-postings")


def item_words(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item (its id as a string) and its exact words w, of each item that has any."""
    return reject_clash(items, key, text).select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("item"), words(lower_ascii(text_or_empty(F.col(text)))).alias("w")).where(F.size("w") > 0)


def test_windows(each: DataFrame, window: int = WINDOW) -> DataFrame:
    """nth, win (which window of that item), len, words: every run of `window` words of an item, or all of
    a shorter one."""
    n = F.least(F.size("w"), F.lit(window))
    return each.select("nth", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("win"), n.alias("len"), "w").select(
        "nth", "win", "len", F.slice("w", F.col("win") + 1, F.col("len")).alias("words")
    )


def probes_of(windows: DataFrame, index: DataFrame) -> DataFrame:
    """nth, at (the place of the first term in the item), term1, term2, apart (how much further the second one
    stands; null with term2 for windows of one word): the two terms of each window that are rarest in the corpus,
    stored. Windows that are looked up alike are one probe; a window with a term that the corpus lacks is none."""
    counts = stored(index.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    terms = windows.select("nth", "win", "len", F.posexplode("words").alias("off", "w")).select("nth", "win", "len", "off", term(F.col("w")).alias("term"))
    rarest = Window.partitionBy("nth", "win").orderBy("n", "term", "off")
    of = terms.join(counts, "term").withColumn("r", F.row_number().over(rarest)).groupBy("nth", "win", "len").agg(
        F.count(F.lit(1)).alias("present"), *[F.max(F.when(F.col("r") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("term", "off")]
    )
    probes = of.where(F.col("present") == F.col("len")).select("nth", (F.col("win") + F.col("off1")).alias("at"), "term1", "term2", (F.col("off2") - F.col("off1")).alias("apart"))
    return stored(probes.distinct(), "probes")


def _first_and_second(index: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of the probes' first terms with their probe, and of their second terms under other names."""
    first = index.join(broadcast_below(probes, BROADCAST_ROWS).withColumnRenamed("term1", "term"), "term")
    seconds = stored(probes.select(F.col("term2").alias("term")).where(F.col("term").isNotNull()).distinct(), "second-terms")
    second = index.join(broadcast_below(seconds, BROADCAST_ROWS), "term", "left_semi")
    return first, second.select(F.col("term").alias("t2"), F.col("id").alias("id2"), F.col("h").alias("h2"), F.col("pos").alias("pos2"))


def _of_one_document(first: DataFrame, second: DataFrame):
    return (first["term2"] == second["t2"]) & first["id"].eqNullSafe(second["id2"]) & (first["h"] == second["h2"])


def phrase_places(index: DataFrame, probes: DataFrame) -> DataFrame:
    """id, h, nth, begin: where an item would begin (before the document, if negative) so that a window's two
    rarest terms stand there as in the item. Every true place of a window is among them."""
    first, second = _first_and_second(index, probes)
    begin = (F.col("pos") - F.col("at")).alias("begin")
    paired = first.join(second, _of_one_document(first, second) & (first["pos"] + first["apart"] == second["pos2"])).select("id", "h", "nth", begin)
    return paired.union(first.where(F.col("term2").isNull()).select("id", "h", "nth", begin)).distinct()


def near_items(index: DataFrame, probes: DataFrame, within: int) -> DataFrame:
    """id, h, nth: documents and items of which a window's two rarest terms stand at most `within` words apart, in
    any order: copies with words added, left out or changed are among them. Both lists meet in cells of `within`
    words, so a posting is compared only with what stands in its own and the next cells."""
    first, second = _first_and_second(index, stored(probes.where(F.col("term2").isNotNull()).select("nth", "term1", "term2").distinct(), "pairs-of-terms"))
    first = first.withColumn("cell", F.explode(F.array(*[F.floor(F.col("pos") / within) + d for d in (-1, 0, 1)])))
    second = second.withColumn("cell2", F.floor(F.col("pos2") / within))
    met = first.join(second, _of_one_document(first, second) & (first["cell"] == second["cell2"]))
    return met.where((F.abs(F.col("pos") - F.col("pos2")) <= within) & (F.col("pos") != F.col("pos2"))).select("id", "h", "nth").distinct()


def near_places(docs: DataFrame, first: str, second: str, within: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Proximity matches: id, pos of `first`, pos of `second`, at most `within` words apart in either
    order. Both terms' postings meet in cells of `within` words, so a pair is compared only with what
    stands in its own and the next cells."""
    spark, rows = docs.sparkSession, _documents(docs, key, text)
    index = build_index(rows, spark.createDataFrame([(t,) for t in {first.lower(), second.lower()}], "term string"))
    a = index.where(F.col("term") == first.lower()).select("id", "h", F.col("pos").alias("pos1"), F.explode(F.array(*[F.floor(F.col("pos") / within) + d for d in (-1, 0, 1)])).alias("cell"))
    b = index.where(F.col("term") == second.lower()).select(F.col("id").alias("id2"), F.col("h").alias("h2"), F.col("pos").alias("pos2"), F.floor(F.col("pos") / within).alias("cell2"))
    met = a.join(b, (F.col("cell") == F.col("cell2")) & F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")))
    return met.where((F.abs(F.col("pos1") - F.col("pos2")) <= within) & (F.col("pos1") != F.col("pos2"))).select(F.col("id").alias(key), "pos1", "pos2").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", share: int = 20) -> DataFrame:
    """One row per row of docs, with h (tells apart rows that repeat a key with another text): how many of its words lie in an occurrence of any item's window, which items
    those are, and whether they are at least one in `share` of its words. n_near: items of which the two rarest
    terms of a window stand within `window` words of each other, whether or not the window occurs.

    A null text has no words; an empty items table hits nothing. A null item id reads as "null". Items
    that repeat an id count once, but each by itself in n_near. Columns of any other name are not read."""
    rows = _documents(docs, key, text)
    each = stored(item_words(items).withColumn("nth", F.monotonically_increasing_id()), "test-items")
    windows = stored(test_windows(each, window), "test-windows")
    vocabulary = stored(windows.select(F.explode("words").alias("w")).select(term(F.col("w")).alias("term")).distinct(), "test-terms")
    index = build_index(rows, vocabulary)
    probes = probes_of(windows, index)
    index = looked_up(index, probes)
    found = phrase_places(index, probes).select("id", "h", "nth", "begin", F.lit(0).alias("near"))
    found = found.union(near_items(index, probes, window).select("id", "h", "nth", F.lit(None).cast("int"), F.lit(1)))
    # An item's words once for each document, however many places it may have there.
    places = found.groupBy("id", "h", "nth").agg(F.collect_list("begin").alias("begins"), F.max("near").alias("near"))
    named = each.select("nth", "item", F.array_join("w", " ").alias("words"))
    met = places.join(broadcast_below(named, BROADCAST_ROWS), "nth")
    c = F.collect_list(F.when(F.size("begins") > 0, F.struct("begins", "item", "words")))
    return _judged(rows, stored(met.groupBy("id", "h").agg(c.alias("c"), F.sum("near").alias("n_near")), "places"), window, key, share)


def _runs(w: Column, begin: Column, words_: Column, item: Column, window: int) -> Column:
    """The stretches of a document's words w that agree with an item's, laid at its place, over a window or
    more (all of an item shorter than a window)."""
    ahead = F.greatest(-begin, F.lit(0))
    own = F.slice(words_, ahead + 1, F.greatest(F.size(words_) - ahead, F.lit(0)))
    there = F.slice(w, begin + ahead + 1, F.size(own))
    same = F.array_join(F.zip_with(there, own, lambda a, b: F.when(lower_ascii(a) == b, "1").otherwise("0")), "")
    least = F.least(F.size(words_), F.lit(window))
    empty = F.array().cast("array<struct<start:int,end:int,item:string>>")
    walked = F.aggregate(
        F.split(same, "0"), F.struct((begin + ahead).alias("at"), empty.alias("runs")),
        lambda a, run: F.struct(
            (a["at"] + F.length(run) + 1).alias("at"),
            F.when(F.length(run) >= least, F.concat(a["runs"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(run)).alias("end"), item.alias("item"))))).otherwise(a["runs"]).alias("runs"),
        ),
    )
    return walked["runs"]


def _runs_of_item(w: Column, x: Column, window: int) -> Column:
    """The runs of all of an item's places; its words are split once."""
    return F.transform(F.array(F.split(x["words"], " ")), lambda own: F.flatten(F.transform(x["begins"], lambda begin: _runs(w, begin, own, x["item"], window))))[0]


def _judged(rows: DataFrame, candidates: DataFrame, window: int, key: str, share: int) -> DataFrame:
    """Compares candidates with the documents' own words. They go to the documents by broadcast if they are few and
    small enough; else both sides shuffle."""
    right = broadcast_below(candidates, BROADCAST_ROWS // 4).withColumnsRenamed({"id": "id2", "h": "h2"})
    met = rows.join(right, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left").select("id", "h", words(F.col("text")).alias("w"), "c", "n_near")
    # The words become a lambda's variable, so that they are split once for a document and not for each place.
    found = F.transform(F.array("w"), lambda w: F.array_sort(F.flatten(F.transform("c", lambda x: _runs_of_item(w, x, window)))))[0]
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], x["end"]).alias("upto")),
    )["n"]
    items = F.coalesce(F.array_sort(F.array_distinct(F.col("hits")["item"])), F.array().cast("array<string>"))
    out = met.select("id", "h", F.size("w").cast("long").alias("n_words"), F.when(F.size("c") > 0, found).alias("hits"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")).select(
        F.col("id").alias(key), "h", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"), items.alias("items"), "n_near"
    )
    return out.select(
        key, "h", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "n_near", "items",
    )


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("h", "items")
