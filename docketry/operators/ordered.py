"""Ordered analytics: nearest neighbours in order, budgets, strata, batches, tails, carried sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(df: DataFrame, groups: list[str], place: str, value: Column, names: tuple[str, str] = ("nearest_place", "nearest_value")) -> DataFrame:
    """For each row the closest place of its group with a value (not null), the lower one of two as close."""
    before = Window.partitionBy(*groups).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*groups).orderBy(place).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    held = F.when(value.isNotNull(), F.struct(F.col(place).alias("p"), value.alias("v")))
    out = df.withColumn("__a", F.last(held, ignorenulls=True).over(before)).withColumn("__b", F.first(held, ignorenulls=True).over(after))
    lower = F.col("__b").isNull() | (F.col("__a").isNotNull() & (F.col(place) - F.col("__a.p") <= F.col("__b.p") - F.col(place)))
    best = F.when(lower, F.col("__a")).otherwise(F.col("__b"))
    return out.withColumn(names[0], best.p).withColumn(names[1], best.v).drop("__a", "__b")


def within_budget(df: DataFrame, groups: list[str], order: list, size: Column, budget: int, separator: int = 2) -> DataFrame:
    """Rows in order until the first that doesn't fit; a separator stands before each but the first."""
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum(size + separator).over(w) - separator
    return df.withColumn("used", used).where(F.col("used") <= budget)


def filled(sizes: Column, budget: int, separator: int = 0) -> Column:
    """Places (from 1) of the sizes that are taken in turn, those that don't fit left out."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("taken"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        cost = x.cast("bigint") + F.when(F.size(s.taken) > 0, F.lit(separator)).otherwise(F.lit(0))
        fits = s.used + cost <= budget
        return F.struct(
            F.when(fits, s.used + cost).otherwise(s.used).cast("bigint").alias("used"), F.when(fits, F.concat(s.taken, F.array(s["at"] + 1))).otherwise(s.taken).alias("taken"), (s["at"] + 1).alias("at")
        )

    return F.aggregate(sizes, start, step, lambda s: s.taken)


def first_per_group(df: DataFrame, groups: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def strata(df: DataFrame, stratum: str, key: str, k: int, seed: str = "") -> DataFrame:
    """k rows, one of each stratum in turn; within a stratum by the SHA-256 of seed and key."""
    blind = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"), 256)
    turn = first_per_group(df.withColumn("blind", blind), [stratum], ["blind", key], k)
    return turn.withColumnRenamed("place", "round").orderBy("round", stratum).limit(k)


def carried_sources(turns: DataFrame, sources: str, most: int) -> DataFrame:
    """(conv_id, link, place): sources of a talk, the latest turn's first, each once, ``most`` at most."""
    each = turns.select("conv_id", "turn", F.posexplode(sources).alias("pos", "link")).where(F.trim("link") != "")
    best = each.groupBy("conv_id", "link").agg(F.min(F.struct((-F.col("turn")).alias("t"), "pos")).alias("at"))
    return first_per_group(best, ["conv_id"], ["at"], most).select("conv_id", "link", "place")
