"""Inverted indexes as tables: postings, document frequencies, TF-IDF and BM25 weights.

Scores are added up as whole numbers (weights times SCALE, rounded half to even), so sums don't
depend on the order in which partitions arrive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import tokens

SCALE = 10_000_000


def fixed(x: Column, scale: int = SCALE) -> Column:
    return F.bround(x * F.lit(float(scale)), 0).cast("long")


@dataclass
class Index:
    """postings: doc, term, tf, n (the document's tokens); frequencies: term, df; and two numbers."""

    postings: DataFrame
    frequencies: DataFrame
    docs: int
    mean: float

    def of(self, terms: DataFrame, most: int = 2_000) -> Index:
        """The index with the postings of these terms alone. Up to ``most`` of them are named to the scan, which skips what
        lies elsewhere in a stored index; more are joined."""
        distinct = terms.select("term").distinct()
        named = [r.term for r in distinct.limit(most + 1).collect()]
        if len(named) <= most:
            return Index(self.postings.where(F.col("term").isin(named)), self.frequencies.where(F.col("term").isin(named)), self.docs, self.mean)
        return Index(self.postings.join(distinct, "term", "left_semi"), self.frequencies, self.docs, self.mean)


def runs(said: Column, most: int) -> Column:
    """The runs of 1 to ``most`` neighbouring tokens, joined by spaces."""
    if most == 1:
        return said

    def of(n: int) -> Column:
        starts = F.when(F.size(said) >= n, F.sequence(F.lit(1), F.size(said) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(said, i, n)))

    return F.concat(said, *(of(n) for n in range(2, most + 1)))


def postings(df: DataFrame, doc: str = "doc_id", text: str = "text", most: int = 1, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """Postings of the runs of 1 to ``most`` words of the texts; n counts words."""
    said = df.select(F.col(doc).alias("doc"), words(F.coalesce(F.col(text), F.lit(""))).alias("said"))
    each = said.select("doc", F.size("said").alias("n"), F.explode(runs(F.col("said"), most)).alias("term"))
    return each.groupBy("doc", "n", "term").agg(F.count(F.lit(1)).alias("tf"))


def build(df: DataFrame, doc: str = "doc_id", text: str = "text", terms: DataFrame | None = None, most: int = 1, words: Callable[[Column], Column] = tokens) -> Index:
    """An index of the texts; with terms only these terms have postings (the numbers are those of all)."""
    said = df.select(words(F.coalesce(F.col(text), F.lit(""))).alias("said")).select(F.size("said").alias("n"))
    docs, mean = said.agg(F.count(F.lit(1)), F.coalesce(F.avg("n"), F.lit(0.0))).first()
    found = postings(df, doc, text, most, words)
    if terms is not None:
        found = found.join(terms.select("term").distinct(), "term", "left_semi")
    return Index(found, found.groupBy("term").agg(F.count(F.lit(1)).alias("df")), docs, mean)


def laid_out(rows: DataFrame) -> DataFrame:
    """Rows with a column term in its order, so that files and row groups of a stored table hold ranges of terms."""
    return rows.repartitionByRange("term").sortWithinPartitions("term")


def query_terms(queries: DataFrame, query: str = "query_id", text: str = "text", most: int = 1, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """(query, term), each once."""
    said = queries.select(F.col(query).alias("query"), words(F.coalesce(F.col(text), F.lit(""))).alias("said"))
    return said.select("query", F.explode(F.array_distinct(runs(F.col("said"), most))).alias("term"))


def bm25(index: Index, terms: DataFrame, k1: float = 1.5, b: float = 0.75, coverage: float = 0.08, most: float = 0.5) -> DataFrame:
    """(query, doc, matched, score): BM25 times a factor for the number of query terms matched."""
    df, tf, n = F.col("df"), F.col("tf"), F.col("n")
    idf = F.ln(1.0 + (index.docs - df + 0.5) / (df + 0.5))
    part = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * n / F.lit(float(index.mean) or 1.0)))
    weighed = index.postings.join(index.frequencies, "term").select("doc", "term", fixed(idf * part).alias("w"))
    sums = weighed.join(terms, "term").groupBy("query", "doc").agg(F.count(F.lit(1)).alias("matched"), F.sum("w").alias("total"))
    factor = 1.0 + F.least(F.lit(most), F.lit(coverage) * (F.col("matched") - 1))
    return sums.select("query", "doc", "matched", F.bround(F.col("total") * factor, 0).cast("long").alias("score"))


def tfidf(index: Index, least: int = 2, features: int = 60_000) -> tuple[DataFrame, DataFrame]:
    """(doc, term, w) at unit length, and (term, idf): 1 + ln(tf), smooth idf. Terms in ``least`` texts or more; of these
    the ``features`` most frequent in the corpus, ties by term."""
    counted = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= least)
    # The cut is a limit of the vocabulary: a top-k, no window over one partition.
    kept = counted.orderBy(F.desc("cf"), "term").limit(features).select("term", (1.0 + F.ln((1.0 + index.docs) / (1.0 + F.col("df")))).alias("idf"))
    raw = index.postings.join(kept, "term").select("doc", "term", ((1.0 + F.ln("tf")) * F.col("idf")).alias("w"))
    length = raw.groupBy("doc").agg(F.sqrt(F.sum(fixed(F.col("w") * F.col("w"), 1_000_000)) / F.lit(1e6)).alias("length"))
    return raw.join(length, "doc").select("doc", "term", (F.col("w") / F.col("length")).alias("w")), kept


def tfidf_scores(weights: DataFrame, idf: DataFrame, terms: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(query, doc, score): fixed-point cosine, above the threshold. Query terms count once."""
    q = terms.join(idf, "term")
    length = q.groupBy("query").agg(F.sqrt(F.sum(fixed(F.col("idf") * F.col("idf"), 1_000_000)) / F.lit(1e6)).alias("length"))
    q = q.join(length, "query").select("query", "term", fixed(F.col("idf") / F.col("length")).alias("qw"))
    hit = weights.select("doc", "term", fixed(F.col("w")).alias("dw")).join(q, "term")
    return hit.groupBy("query", "doc").agg(F.sum(F.col("dw") * F.col("qw")).alias("score")).where(F.col("score") > round(threshold * SCALE * SCALE))
