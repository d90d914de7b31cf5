"""Counts, crosstabs and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def success_rate(won: Column, of: Column, places: int = 1, half_even: bool = True) -> Column:
    """Per cent; null where there is nothing to divide by. Half to even, or (half_even false) half up."""
    share = won * 100.0 / F.when(of != 0, of)
    return F.bround(share, places) if half_even else F.round(share, places)


def crosstab(df: DataFrame, label: Column, outcome: str, outcomes: list[str], limit: int | None = None) -> DataFrame:
    """label, a count for each outcome, total: largest totals first, ties by label; blank labels left out."""
    counted = df.select(label.alias("label"), F.col(outcome).alias("__o")).where(F.coalesce(F.trim("label"), F.lit("")) != "")
    out = counted.groupBy("label").agg(*(F.sum((F.col("__o") == o).cast("int")).alias(o) for o in outcomes), F.count(F.lit(1)).alias("total"))
    return out.orderBy(F.desc("total"), "label").limit(limit) if limit else out
