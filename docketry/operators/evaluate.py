"""Retrieval evaluation: binary and graded metrics, gates, pools, comparisons of runs. Undefined metrics are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query, doc, rank) with rel, null where unjudged."""
    return run.select("query", "doc", "rank").join(qrels, ["query", "doc"], "left")


def gain(rel: Column, place: Column) -> Column:
    """The graded gain at a rank from 0."""
    return (F.pow(F.lit(2.0), rel) - 1.0) / F.log2(place + 2.0)


def graded(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """query, ndcg, judged (share of the first k with a judgement), first (rank from 1 of the first relevant), precision
    among the judged; null where there is nothing relevant or nothing judged."""
    from docketry.operators.ordered import first_per_group

    found = judged(run.where(F.col("rank") < k), qrels)
    got = found.groupBy("query").agg(
        F.sum(gain(F.coalesce("rel", F.lit(0)), F.col("rank"))).alias("dcg"), F.count("rel").alias("known"), F.count(F.lit(1)).alias("shown"),
        F.sum((F.col("rel") > 0).cast("int")).alias("good"), F.min(F.when(F.col("rel") > 0, F.col("rank") + 1)).alias("first"),
    )
    best = first_per_group(qrels.where("rel > 0"), ["query"], [F.desc("rel"), "doc"], k)
    ideal = best.groupBy("query").agg(F.sum(gain(F.col("rel"), F.col("place") - 1)).alias("ideal"))
    both = got.join(ideal, "query", "left")
    return both.select(
        "query", F.bround(F.col("dcg") / F.col("ideal"), 6).alias("ndcg"), F.bround(F.col("known") / F.col("shown"), 6).alias("judged"),
        "first", F.bround(F.when(F.col("known") > 0, F.coalesce("good", F.lit(0)) / F.col("known")), 6).alias("precision"),
    )


def binary(run: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """query, recall at the cuts, reciprocal rank; of queries with something relevant."""
    wanted = qrels.where("rel > 0").groupBy("query").agg(F.count(F.lit(1)).alias("wanted"))
    hits = judged(run, qrels.where("rel > 0")).where("rel is not null").groupBy("query")
    got = hits.agg(*(F.sum((F.col("rank") < c).cast("int")).alias(f"h{c}") for c in cuts), F.min("rank").alias("lead"))
    return wanted.join(got, "query", "left").select("query", *(F.bround(F.coalesce(f"h{c}", F.lit(0)) / F.col("wanted"), 6).alias(f"recall_{c}") for c in cuts), F.bround(F.coalesce(1.0 / (F.col("lead") + 1), F.lit(0.0)), 6).alias("rr"))


def gate(base: DataFrame, candidate: DataFrame, tolerance: float = 0.03, special: dict[str, float] | None = None) -> DataFrame:
    """(metric, base, candidate, passed) of two (metric, value): passed if the candidate loses no more than is
    tolerated; null on either side never passes."""
    both = base.select("metric", F.col("value").alias("base")).join(candidate.select("metric", F.col("value").alias("candidate")), "metric", "full_outer")
    allowed = F.lit(tolerance)
    for metric, t in (special or {"recall_20": 0.02}).items():
        allowed = F.when(F.col("metric") == metric, F.lit(t)).otherwise(allowed)
    return both.withColumn("passed", F.coalesce(F.col("candidate") - F.col("base") >= -(allowed + 1e-12), F.lit(False)))


def run_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query, missing, extra, first_different): documents of one run alone, and the first rank (from 1) that differs."""
    both = a.select("query", "rank", F.col("doc").alias("x")).join(b.select("query", "rank", F.col("doc").alias("y")), ["query", "rank"], "full_outer")
    first = both.groupBy("query").agg(F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col("rank") + 1)).alias("first_different"))
    sides = a.select("query", "doc").withColumn("s", F.lit(1)).unionByName(b.select("query", "doc").withColumn("s", F.lit(2))).groupBy("query", "doc").agg(F.sum("s").alias("s"))
    counts = sides.groupBy("query").agg(F.sum((F.col("s") == 1).cast("int")).alias("missing"), F.sum((F.col("s") == 2).cast("int")).alias("extra"))
    return counts.join(first, "query")


def pool(runs: dict[str, DataFrame], depth: int, seed: str) -> DataFrame:
    """(query, doc, systems, best, blind): what any run has to the depth, in a blind order."""
    every = None
    for name, run in runs.items():
        part = run.where(F.col("rank") < depth).select("query", "doc", "rank", F.lit(name).alias("system"))
        every = part if every is None else every.unionByName(part)
    found = every.groupBy("query", "doc").agg(F.array_join(F.array_sort(F.collect_set("system")), ",").alias("systems"), (F.min("rank") + 1).alias("best"))
    return found.withColumn("blind", F.sha2(F.concat_ws("|", F.lit(seed), "query", "doc").cast("binary"), 256))


def confusion(df: DataFrame, truth: Column, said: Column, *groups: str) -> DataFrame:
    """tp, fp, fn, precision, recall."""
    def n(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("int")), F.lit(0))

    tp, fp, fn = n(truth & said), n(~truth & said), n(truth & ~said)
    share = lambda a, b: F.bround(F.when(b > 0, a / b), 6)
    return df.groupBy(*groups).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).select(*groups, "tp", "fp", "fn", share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
