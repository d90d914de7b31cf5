"""From rankings to evidence: adaptive sizes, fused filtered lists, pluggable rerankers, citation contexts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators import rank as rk
from docketry.operators.ordered import within_budget


def sizes(pool: int, retrieve: int, final: int) -> tuple[int, int]:
    """How many to retrieve and to keep, more for larger pools."""
    if pool > 500:
        return max(retrieve, 100), max(final, 15)
    if pool > 200:
        return max(retrieve, 70), max(final, 12)
    return retrieve, final


def fused_with_filter(scores: DataFrame, keep: DataFrame, retrieve: int, final: int) -> DataFrame:
    """The list of all and the list of those kept (doc), fused: a filter that helps without shutting others out."""
    inside = scores.join(keep.select("doc"), "doc", "left_semi")
    return rk.top(rk.fuse([rk.top(scores, retrieve), rk.top(inside, retrieve)]), final)


def reranked(ranking: DataFrame, scorer: Callable[[DataFrame], Column] | None, candidates: int = 40) -> DataFrame:
    """The first candidates by what the scorer says of them, ties and what it doesn't score by their rank; without a
    scorer the ranking as it is."""
    if scorer is None:
        return ranking
    scored = ranking.where(F.col("rank") < candidates).withColumn("said", scorer(ranking))
    order = Window.partitionBy("query").orderBy(F.desc_nulls_last("said"), "rank")
    return scored.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))


def citation_context(hits: DataFrame, group: str, text: str, per_group: int = 2, most: int = 12, budget: int = 12_000) -> DataFrame:
    """Hits of a query that make its context: a few of each group, ``most`` in all, up to the first that breaks the budget;
    source numbers from 1."""
    each = hits.withColumn("__g", F.row_number().over(Window.partitionBy("query", group).orderBy("rank"))).where(F.col("__g") <= per_group)
    kept = each.withColumn("source_number", F.row_number().over(Window.partitionBy("query").orderBy("rank")).cast("long")).where(F.col("source_number") <= most)
    return within_budget(kept, ["query"], ["source_number"], F.length(F.coalesce(F.col(text), F.lit(""))).cast("long"), budget).drop("__g")
