"""The chain's lists: texts weighed and embedded in their tasks, queries meeting only the texts of their pool, blocks' results put together in groups."""

import glob

import pytest
from pyspark.sql import functions as F

from docketry.operators import blocks as bl
from docketry.operators import hybrid
from docketry.operators import index as ix
from docketry.operators import rank as rk
from docketry.plans import chain as ch
from docketry.sources import tables


@pytest.fixture(scope="module")
def corpus(spark):
    words = F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(k)).cast("string")) for k in (3, 7, 11, 40)))
    return spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") != 9, words).alias("text"), F.when(F.col("id") % 3 == 0, "da").when(F.col("id") % 3 == 1, "en").alias("lang")).localCheckpoint()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_lists_and_vectors_in_pools(spark, corpus, monkeypatch):
    for name, value in (("FEWEST", 30), ("ASKED", 9), ("GATHERED", 50), ("HELD", 100)):
        monkeypatch.setattr(bl, name, value, raising=False)
    weights, rare = ix.tfidf(ix.build(corpus), 2, 40)
    terms = ix.query_terms(corpus.where("doc_id < 40"), "doc_id").withColumn("query", F.concat(F.lit("q"), F.col("query").cast("string")))
    asked = terms.select("query").distinct().withColumn("lang", F.when(F.crc32("query") % 3 == 0, "da").when(F.crc32("query") % 3 == 1, "xx"))
    lists = bl.said(corpus, more=("lang",))
    has = corpus.select(F.col("doc_id").alias("doc"), F.col("lang").alias("has"))
    kept = lambda df: rk.top(df.join(asked, "query").join(has, "doc").where("lang is null or lang = has").select("query", "doc", "score"), 6)
    assert rows(rk.top(bl.tfidf(lists, terms, 6, rare, 200, within=("lang",), asked=asked, many=40), 6)) == rows(kept(ix.tfidf_scores(weights, rare, terms)))
    vectors = hybrid.embedded(lists, rare)
    assert rows(vectors) == rows(hybrid.hashed(weights, "doc"))
    q = hybrid.hashed(terms.join(rare, "term").select("query", "term", F.col("idf").alias("w")), "query").withColumnRenamed("v", "qv")
    got = bl.near(vectors.join(corpus.select(F.col("doc_id").alias("doc"), "lang"), "doc"), q.join(asked, "query"), 6, 200, 0.15e12, ("lang",), 40)
    want = kept(rk.vector_scores(vectors, q, 0.15e12).select("query", "doc", F.bround("score", 0).cast("long").alias("score")))
    assert rows(rk.top(got, 6)) == rows(want) and want.count() > 50


def test_a_stored_corpus_has_no_postings(spark, tmp_path, corpus):
    corpus.write.parquet(str(tmp_path / "documents.parquet"))
    before = set(glob.glob(f"{tables.folder(spark)}/cache/*"))
    at = ch.stored(spark, str(tmp_path), "small", corpus.select(F.col("doc_id").alias("doc"), "text", "lang"), vectors=True)
    made = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{tables.folder(spark)}/cache/*")) - before}
    assert at.vectors.count() == 199 and made == {f"small-{x}" for x in ("docs", "said", "rarities", "features", "units", "vectors")}
