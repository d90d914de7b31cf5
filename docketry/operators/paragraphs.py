"""Paragraph BM25: paragraphs as the index's units, their decisions, and the refinement of a ranking by them.

A paragraph is known by (doc, section, paragraph) and indexed with its section's title. Scores are whole numbers as in
``index``; ties go by the paragraph's place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators import index as ix
from docketry.operators import passages
from docketry.operators.rank import fuse, top


def units(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, said): a row for each paragraph, doc being its (doc, section, paragraph)."""
    found = passages.paragraphs(df.select(F.col(doc).alias("doc"), F.col(text).alias("text")), "doc")
    return found.select(F.struct("doc", "section", "paragraph").alias("doc"), F.concat_ws(" ", "section_title", "text").alias("said"))


def hits(df: DataFrame, terms: DataFrame, limit: int = 30, doc: str = "doc_id", text: str = "text", index: ix.Index | None = None) -> DataFrame:
    """(query, doc, section, paragraph, matched, score, rank): the best paragraphs of all texts for each query, ranks from 1. index: that of
    the units, where it is stored."""
    scored = ix.bm25(ix.build(units(df, doc, text), "doc", "said", terms=terms) if index is None else index.of(terms), terms)
    return ranked(scored, limit)


def ranked(scored: DataFrame, limit: int = 30) -> DataFrame:
    """The best of (query, doc, matched, score), doc being a paragraph's place, as ``hits`` has them."""
    best = top(scored.where(F.col("score") > 0), limit)
    return best.select("query", "doc.*", "matched", "score", (F.col("rank") + 1).alias("rank"))


def decisions(found: DataFrame, k: int = 20, each: int = 3) -> DataFrame:
    """(query, doc, score) from paragraphs: 1 / (k + rank) of a decision's ``each`` best, and a thousandth of their scores."""
    order = Window.partitionBy("query", "doc").orderBy(F.desc("score"), "rank")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
    points = F.sum(ix.fixed(1.0 / (k + F.col("rank")))) + F.bround(F.sum("score") * F.lit(0.001), 0).cast("long")
    return best.groupBy("query", "doc").agg(points.alias("score"))


def local_hits(base: DataFrame, df: DataFrame, terms: DataFrame, k1: float = 1.5, b: float = 0.75, coverage: float = 0.08, most: float = 0.5, doc: str = "doc_id", text: str = "text", parts: DataFrame | None = None) -> DataFrame:
    """The paragraphs of each query's candidates as ``hits`` has them, by an index of these candidates alone: at least 40,
    at most three for each candidate. parts: the units of all texts, where they are stored."""
    cand = base.select("query", "doc", F.col("rank").alias("first"))
    few = cand.select("doc").distinct()
    if parts is None:
        part = units(df.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).join(few.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi"))
    else:
        part = parts.join(few.select(F.col("doc").alias("__doc")), F.col("doc.doc") == F.col("__doc"), "left_semi")
    sizes = part.select("doc.doc", F.size(ix.tokens(F.col("said"))).alias("size")).join(cand, "doc").groupBy("query").agg(F.count(F.lit(1)).cast("double").alias("of"), F.avg("size").alias("mean"))
    limits = cand.groupBy("query").agg(F.greatest(F.lit(40), 3 * F.count(F.lit(1))).alias("limit"))
    # Candidates meet their query's terms first: with all terms of their document there would be many more rows.
    posted = cand.join(terms, "query").join(ix.postings(part, "doc", "said").select("doc.*", "n", "term", "tf"), ["doc", "term"])
    freq = posted.groupBy("query", "term").agg(F.count(F.lit(1)).alias("df"))
    n, tf, of, held = F.col("n"), F.col("tf"), F.col("of"), F.col("df")
    w = F.ln(1.0 + (of - held + 0.5) / (held + 0.5)) * (tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * n / F.col("mean"))))
    sums = posted.join(freq, ["query", "term"]).join(sizes, "query").groupBy("query", "doc", "section", "paragraph", "first").agg(F.count(F.lit(1)).alias("matched"), F.sum(ix.fixed(w)).alias("total"))
    factor = 1.0 + F.least(F.lit(most), F.lit(coverage) * (F.col("matched") - 1))
    scored = sums.withColumn("score", F.bround(F.col("total") * factor, 0).cast("long")).where(F.col("score") > 0)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "first", "section", "paragraph")
    ranked = scored.withColumn("rank", F.row_number().over(order)).join(limits, "query").where(F.col("rank") <= F.col("limit"))
    return ranked.select("query", "doc", "section", "paragraph", "matched", "score", "rank")


def refined(base: DataFrame, df: DataFrame, terms: DataFrame, exact: DataFrame | None = None, final: int = 20, k: int = 20, doc: str = "doc_id", text: str = "text", parts: DataFrame | None = None) -> DataFrame:
    """The base ranking (query, doc, rank) fused with the order of its decisions by paragraph, which counts twice. With
    ``exact`` only these queries are refined; the others, and those without a paragraph hit, keep their base."""
    mine = base if exact is None else base.join(exact.select("query").distinct(), "query", "left_semi")
    by_paragraph = decisions(local_hits(mine, df, terms, doc=doc, text=text, parts=parts), k)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    ordered = by_paragraph.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    return top(fuse([ordered, ordered, base], k), final)
