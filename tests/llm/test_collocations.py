"""Collocations against SQL, a plain restatement and awkward tables."""

import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.llm import collocations as co
from barloom.llm import oracles

SMALL = co.Params(min_count=3, top=40, depth=2, width=1 << 12)
SCHEMA = "doc_id long, text string, lang string"


def plain(rows, p):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything."""
    f, n, out = Counter(), Counter(), []
    for text, lang in ((t, "und" if x is None else x) for t, x in rows):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, p.max_words + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= p.min_count}
    gone = {(lang, w[i : i + k]) for (lang, w), v in often.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * v >= p.subsumed * f[lang, w[i : i + k]]}
    for lang in n:
        found = []
        for (own, w), a in often.items():
            if own == lang and (own, w) not in gone:
                cuts = [(Fraction(1000 * a * n[lang], f[lang, w[:k]] * f[lang, w[k:]]) // 1, k) for k in range(1, len(w))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(w).encode(), a, f[lang, w[:k]], f[lang, w[k:]], n[lang]))
        out += [(lang, i, x[2].decode(), *x[3:], -x[0]) for i, x in enumerate(sorted(found)[: p.top], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_sample_documents_give_what_sql_gives(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    rows = con.execute(oracles.COLLOCATIONS)
    names = [x[0] for x in rows.description]
    df = co.op12_merged_sketch_collocations(spark, "/root/testdata/sf0.01")
    assert df.columns == names == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert dict(df.dtypes) == dict.fromkeys(names, "bigint") | {"lang": "string", "phrase": "string"}
    assert got(df) == sorted(rows.fetchall()) != []


def test_restated(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.collect()]
    for p in (SMALL, co.Params(min_count=20, max_words=3, subsumed=60, depth=1, width=1 << 10), co.Params(min_count=2, max_words=2, top=5, width=1 << 16)):
        assert got(co.collocations(docs, p)) == plain(rows, p) != []


ODD = [
    (1, None, "en"), (2, "", None), (3, " \t\n ", "en"), (4, "New York, new york; NEW YORK! x", None), (4, "New York, new york; NEW YORK! x", None), (None, "É É É É É É a\x0bb a\x0cb a b", "fr"),
    (5, "a b " * 4000 + "c", "en"), (6, "the end.the end:the end?the\tend\rthe end", ""), (7, "x y z " * 9 + "  \x1c \x00 \U0001f600 \U0001f600", "de"), (8, "one", "und"),
]


def test_odd_tables(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(f"extra {c}") for c in ("phrase", "n", "words", "w", "rank", "a", "l", "r", "score", "line", "block", "cells")})
    assert got(co.collocations(docs, SMALL)) == plain([(t, lang) for _, t, lang in ODD], SMALL)
    assert co.collocations(docs.limit(0), SMALL).count() == 0


def test_a_full_sketch_loses_nothing(spark):
    """With a single cell everything passes, and exact counts decide."""
    docs = spark.createDataFrame(ODD, SCHEMA)
    assert got(co.collocations(docs, co.Params(min_count=3, depth=1, width=2))) == plain([(t, lang) for _, t, lang in ODD], co.Params(min_count=3))


@pytest.mark.parametrize("min_count", [100, 1000])
def test_cells_bound_counts_from_above_and_prune(spark, min_count):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    p = co.Params(min_count=min_count, width=1 << 16)
    texts = co._plain_texts(docs, "lang", "text")
    cells = co._load(co.sketch(texts, p), p)
    chunk = co.Chunk()
    for r in texts.collect():
        chunk.add(r.lang, bytes(r.text))
    passed = total = 0
    for words, starts, h in co._phrase_hashes(chunk, p.max_words):
        low = cells[:, :].astype(int)
        least = [int(min(low[line][c] for line, c in enumerate(x))) for x in zip(*(co._cells(h, line, p.width) for line in range(p.depth)), strict=True)]
        true = Counter(tuple([chunk.lang_of[chunk.names[i]], *chunk.words[i : i + words]]) for i in starts.tolist())
        for i, seen in zip(starts.tolist(), least, strict=True):
            n = true[tuple([chunk.lang_of[chunk.names[i]], *chunk.words[i : i + words]])]
            assert seen >= min(n, min_count)
        total, passed = total + len(least), passed + sum(x >= min_count for x in least)
    assert passed < total / 2


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", 0, "", 4 * 10**15), ("en", 1, "a", 3 * 10**15), ("en", 1, "b", 2 * 10**15 + 1), ("en", 2, "a b", 10**15 + 7)], "lang string, words int, phrase string, n long")
    row = co.scored(counts).first()
    assert row.score == 1000 * (10**15 + 7) * 4 * 10**15 // (3 * 10**15 * (2 * 10**15 + 1))


def shuffled_mb(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite() / 1e6


def test_rare_phrases_are_not_shuffled_by_name(spark):
    """Two million words whose phrases are nearly all rarer than the threshold; the text has 10 MB."""
    spark.range(0, 20_000, 1, 8).selectExpr("array_join(transform(sequence(1, 100), i -> hex(pmod(xxhash64(id, i), 50000))), ' ') AS text", "'en' AS lang").createOrReplaceTempView("rare")
    before = shuffled_mb(spark)
    assert co.collocations(spark.table("rare"), co.Params(min_count=2, top=5)).count() == 5
    assert shuffled_mb(spark) - before < 20


@pytest.mark.parametrize("p", [co.Params(max_words=3, min_count=9), co.Params(max_words=3, min_count=300, depth=2, width=1 << 14)])
def test_tasks_cells_add_up(monkeypatch, p):
    """However often a task lets its cells go and a merge adds up what it holds."""
    monkeypatch.setattr(co, "CHUNK_WORDS", 100)
    monkeypatch.setattr(co, "HELD_CELLS", 700)
    monkeypatch.setattr(co, "MERGED_CELLS", 30)
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in (40 * rng.random(60) ** 3).astype(int)) for _ in range(300)]
    tasks = [pd.DataFrame({"lang": "en", "text": [t.encode() for t in texts[i::3]]}) for i in range(3)]
    true, chunk = Counter(), co.Chunk()
    for t in texts:
        chunk.add("en", t.encode())
    for words, _, h in co._phrase_hashes(chunk, 3):
        if words > 1:
            true.update((line, c) for line in range(p.depth) for c in co._cells(h, line, p.width).tolist())
    sent = pd.concat([x for t in tasks for x in co._touched(iter([t]), p, (2, 3))]).sort_values(["line", "block"])
    assert len(sent) > 3 * len(sent.drop_duplicates(["line", "block"]))
    got = {(r.line, r.block * co._block(p.width) + int(c)) for m in co._merged(iter([sent]), p) for r in m.itertuples() for c in co._unpacked(r.cells)[0]}
    assert got == {k for k, n in true.items() if n >= p.min_count} != set()
