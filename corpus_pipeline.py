"""A training-data pipeline over ``documents``.

Stages, in order, each over all that the one before it kept, each written as Parquet and read again:

- toxicity: a classifier chain learned from ``labels``; documents that it rejects go.
- near duplicates: of each group of linked SimHash fingerprints the document with the smallest doc_id stays.
- substring dedup: words in windows of 50 that a document with a smaller doc_id holds too are cut out.
- decontamination: documents with a twentieth or more of their words in ``benchmark`` windows go.
- encoding: SentencePiece ids and the decoded text.

Documents stay rows, even where nothing is left of their text. Null and empty texts are kept by every stage but one: of those
linked as near duplicates of no words, the smallest doc_id stays. Rows with a null doc_id are kept as rows of their own. Until the last
stage columns of the input keep their names, types and values (text and n_chars are those of what is left), whatever the operators call theirs; the
last gives doc_id, n_tokens, ids and decoded alone. An empty table gives empty tables. SQL can't
express the learned and the iterative stages, so there is no ORACLE_SQL; the tests hold each stage against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import pieces, queries, repeats, simhash, toxicity, winnow
from docketry.llm.frames import written


def judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], flag: str, results: list[str]) -> DataFrame:
    """docs without the rows that judge() flags; columns named as its results are put aside meanwhile."""
    own = {c: f"__own_{c}" for c in docs.columns if c in results}
    kept = judge(docs.withColumnsRenamed(own)).where(~F.col(flag)).drop(*results)
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.learn(docs, queries.table(spark, sf_dir, "labels"), queries.categories())
    return judged(docs, lambda d: toxicity.score(d, chain, d.columns), "rejected", [*(f"p_{c}" for c in chain.categories), "rejected"])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(docs)
    return docs.join(near.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = repeats.cut_texts(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = queries.table(spark, sf_dir, "benchmark")
    return judged(docs, lambda d: winnow.decontaminate(d, items, d.columns), "contaminated", [x.split()[0] for x in winnow.RESULT.split(", ")])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, queries.tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("near_duplicates", one_of_each),
    ("substring_dedup", unrepeated),
    ("decontamination", uncontaminated),
    ("encoding", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
