"""Trigram counts of a sample, whatever its partitions."""

from pyspark.sql import functions as F

from barloom.llm import langid


def test_counts_do_not_grow_with_partitions(spark):
    rows = spark.range(120).select(F.lit("en").alias("label"), F.concat(F.lit("the same words and "), F.col("id").cast("string")).alias("text"))
    few, many = (langid._counts(rows.repartition(k)) for k in (2, 60))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert many.count() <= langid._COUNTED * many.select("bucket").distinct().count()
    whole = {r.bucket: r.n for r in many.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    want = {}
    for r in rows.collect():
        for x in langid.trigrams(r.text):
            for b in x.tolist():
                want[b] = want.get(b, 0) + 1
    assert whole == want
