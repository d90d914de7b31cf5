"""Queries that read the whole of their tables and texts."""

import pytest
from pyspark.sql import functions as F

from docketry.functions.snowball_da import stemmed, stems
from docketry.operators import blocks as bl
from docketry.operators import rank as rk
from docketry.plans.queries import ORACLES, QUERIES


def test_similar_cases_are_sought_for_all_documents(spark):
    found = {r.query for r in QUERIES["assess_similar"](spark, "/root/testdata/sf0.001").select("query").collect()}
    assert len(found) > 150 and {q % 20 for q in found} == set(range(20))
    assert "% 20" not in ORACLES["assess_similar"] and "% 20" in ORACLES["similar_docs"]


def test_stems_are_those_of_whole_texts(spark, tmp_path):
    texts = ["titel\nkloakrør " + "fyld " * 3_000, "titel\n" + "fyld " * 2_000 + "kloakrør " + "fyld " * 2_000, "titel\n## Konklusion\nkort\n## Andet\nkloakrør", "titel\n" + "fyld " * 3_000, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "kloakrør")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r.doc for r in QUERIES["tfidf_stems_topk"](spark, str(tmp_path)).collect()} == {0, 1, 2}


@pytest.mark.parametrize("asked", [None, 60])
def test_queries_are_dealt_in_parts(spark, monkeypatch, asked):
    monkeypatch.setattr(bl, "ASKED", 7, raising=False)
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), (F.col("id") % k).cast("string")) for k in (3, 7, 11))).alias("text"))
    lists, terms = bl.said(df), df.where("doc_id < 60").select(F.col("doc_id").alias("query"), F.explode(F.split("text", " ")).alias("term"))
    known = bl.tallies(lists)
    get = lambda **more: sorted(map(tuple, rk.top(bl.bm25(lists, terms, 5, known, 300, 3.0, **more), 5).collect()))
    assert get(asked=asked) == get() and len(get()) == 300


def test_stems_of_batches(spark):
    texts = ["rodindvækst og rødderne i kloakken", None, "", "1 2", "afgørelser rodindtrængninger a bb", "rodvækst"]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).orderBy("i").select(stemmed(F.col("t")).alias("s")).collect()]
    assert got == [stems([w for w in (t or "").split() if len(w) > 1 and w.isalpha()]) for t in texts]
