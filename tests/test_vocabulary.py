"""The vocabulary cut in two levels against counting all runs."""

import random

import pytest
from pyspark.sql import functions as F

from docketry.functions.text import tokens
from docketry.operators import index as ix
from docketry.operators import vocabulary as vb
from docketry.sources.tables import stored


def texts(seed, n, words=400):
    r = random.Random(seed)
    zipf = [f"w{int(words * r.random() ** 3)}" for _ in range(4000)]
    rows = [(i, " ".join(r.choice(zipf) for _ in range(r.randint(0, 60)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "only here " * 300), (3, rows[3][1])]


@pytest.mark.parametrize(("features", "least", "share", "capacity"), [(20, 2, None, 50), (50, 2, 0.01, 10_000), (50, 1, 0.02, 10_000), (5, 3, 0.5, 4), (30, 200, 0.001, 100), (5000, 2, 0.01, 100), (1, 2, 0.0, 1)])
def test_the_cut_keeps_what_counting_all_keeps(spark, features, least, share, capacity):
    df = spark.createDataFrame(texts(features, 150), "doc_id long, text string").repartition(5)
    said = stored(df.select(F.col("doc_id").alias("doc"), tokens(F.coalesce("text", F.lit(""))).alias("said")), "test")
    got = vb.cut(said, 2, least, features, share, capacity, store=lambda x: stored(x, "test"))
    top = lambda p: [tuple(r) for r in p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= least).orderBy(F.desc("cf"), "term").limit(features).collect()]
    assert top(vb.counted(said, got.terms, 2)) == top(ix.postings(df.withColumn("doc_id", F.monotonically_increasing_id()), most=2))


def test_few_runs_are_handed_on_and_bounds_hold(spark):
    df = spark.createDataFrame(texts(9, 400, 3000), "doc_id long, text string").repartition(4)
    said = stored(df.select(F.col("doc_id").alias("doc"), tokens(F.coalesce("text", F.lit(""))).alias("said")), "test")
    whole = {r.term: r.n for r in said.select(F.explode(ix.runs(F.col("said"), 2)).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    parts = vb.summaries(said, 2, 0.002, 300).collect()
    errors = sum(r.error for r in parts if r.term is None)
    low, missing = {}, {}
    for r in parts:
        if r.term is not None:
            low[r.term] = low.get(r.term, 0) + r.n
            missing[r.term] = missing.get(r.term, errors) - r.error
    assert 0 < len(low) < len(whole) / 20 and errors > 0
    assert all(low[t] <= whole[t] <= low[t] + missing[t] for t in low) and all(n <= errors for t, n in whole.items() if t not in low)


def test_index_weighs_as_the_index_of_all(spark):
    df = spark.createDataFrame(texts(4, 80)[:-1], "doc_id long, text string")
    for features in (10, 60_000):
        mine, full = vb.index(df, features=features), ix.build(df, most=2)
        assert (mine.docs, mine.mean) == (full.docs, full.mean)
        for a, b in zip(ix.tfidf(mine, 2, features), ix.tfidf(full, 2, features), strict=True):
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    none = vb.index(spark.createDataFrame([], "doc_id long, text string"))
    assert none.docs == 0 and none.postings.count() == 0
