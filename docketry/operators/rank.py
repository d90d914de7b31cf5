"""Rankings: top lists, vector search, rank fusion, boosts. A ranking is (query, doc, rank) with ranks from 0."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators.index import fixed


def top(scores: DataFrame, k: int, score: str = "score", by: tuple[str, ...] = ("query",)) -> DataFrame:
    """The k best of each query, ties by doc, with their rank; by: other columns that tell lists apart."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), "doc")
    # The number is compared as it is, so that Spark cuts each task's rows before it shuffles them.
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", (F.col("rank") - 1).cast("long"))


def _blocks(df: DataFrame, key: str, vector: str, rows: int, name: str, more: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(name, keys, values, lists of more): some ``rows`` vectors in one row each, and how many blocks there are."""
    count = max(1, -(-df.count() // rows))
    kind = df.schema[key].dataType.simpleString()

    def pack(group: pa.Table) -> pa.Table:
        flat = group[vector].combine_chunks()
        flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
        keys = group[key].combine_chunks()
        keys = pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys
        values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.table({name: group[name].slice(0, 1), "keys": pa.array([keys.to_pylist()], pa.list_(keys.type)), "values": pa.array([values.tobytes()], pa.binary()), **{c: pa.array([group[c].to_pylist()], pa.list_(pa.string())) for c in more}})

    lists = "".join(f", {c} array<string>" for c in more)
    dealt = df.where(F.col(vector).isNotNull()).select(key, vector, *more, F.pmod(F.xxhash64(key), F.lit(count)).cast("int").alias(name))
    return dealt.groupBy(name).applyInArrow(pack, f"{name} int, keys array<{kind}>, values binary{lists}"), count


def vector_scores(vectors: DataFrame, queries: DataFrame, threshold: float = 0.15, k: int | None = None, rows: int = 4_096, within: tuple[str, ...] = ()) -> DataFrame:
    """(query, doc, score) of (query, qv) against all (doc, v): products above the threshold, to ten places; with k the k best of
    each query, ties by doc, in each pair of blocks, which holds the k best of all. within: text columns of both sides that must be
    equal unless the query's is null.

    A stated set of queries meets every vector in blocks of ``rows``: a pair of blocks is one matrix product, so memory is that of
    two blocks and their products, and a vector moves once for each block of queries.
    """
    held, m = _blocks(vectors, "doc", "v", rows, "block", within)
    asked, n = _blocks(queries.withColumnsRenamed({c: f"q_{c}" for c in within}), "query", "qv", rows // 4, "of", tuple(f"q_{c}" for c in within))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # Joined by pair, so that a block of queries isn't one task's.
    pairs = held.withColumn("of", each(n)).join(asked.withColumnsRenamed({"keys": "qkeys", "values": "qvalues"}).withColumn("block", each(m)), ["block", "of"])
    kinds = (vectors.schema["doc"].dataType.simpleString(), queries.schema["query"].dataType.simpleString())

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, named = np.array(row["keys"]), np.array(row["qkeys"])
                v, q = (np.frombuffer(row[c], np.float64).reshape(len(x), -1) for c, x in (("values", docs), ("qvalues", named)))
                order = np.argsort(docs, kind="stable")
                docs, scores = docs[order], np.round(q @ v[order].T, 10)
                kept = {c: np.array(row[c], object)[order] for c in within}
                for i in range(len(named)):
                    hit = scores[i] > threshold
                    for c in within:
                        if row[f"q_{c}"][i] is not None:
                            hit &= kept[c] == row[f"q_{c}"][i]
                    at = np.flatnonzero(hit)
                    if k is not None and len(at) > k:
                        at = at[np.argsort(-scores[i][at], kind="stable")[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array([named[i]] * len(at), batch.schema.field("qkeys").type.value_type), pa.array(docs[at], batch.schema.field("keys").type.value_type), pa.array(scores[i][at])], names=["query", "doc", "score"])

    return pairs.select("keys", "values", "qkeys", "qvalues", *within, *(f"q_{c}" for c in within)).mapInArrow(products, f"query {kinds[1]}, doc {kinds[0]}, score double")


def max_pool(scores: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query, doc, score) of the best chunk of each document; only the k * 8 best chunks of a query count."""
    best = top(scores, k * 8).select("query", F.col("doc").alias("chunk"), "score")
    return best.join(chunks, "chunk").groupBy("query", "doc").agg(F.max("score").alias("score"))


def fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings; a list given twice counts twice. (query, doc, score), score times 1e7 as a whole number."""
    every = reduce(DataFrame.unionByName, [x.select("query", "doc", "rank") for x in lists])
    return every.groupBy("query", "doc").agg(F.sum(fixed(1.0 / (k + F.col("rank") + 1))).alias("score"))


def boosted(ranking: DataFrame, overlap: Column, k: int = 20, step: float = 0.004, most: int = 10) -> DataFrame:
    """Rank order moved by an overlap: 1 / (k + rank) + min(overlap, most) * step."""
    return ranking.withColumn("score", fixed(1.0 / (k + F.col("rank")) + F.least(overlap, F.lit(most)) * F.lit(step)))


def exact_scores(docs: DataFrame, queries: DataFrame, per_phrase: int = 120) -> DataFrame:
    """(query, doc, score): points for phrases that stand in the text. queries: (query, phrase); docs: (doc, said).

    Texts that hold a phrase's longest word are found without the text, which is joined back to compare the phrase whole.
    """
    longest = F.array_sort(F.split("phrase", " "), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    wanted = queries.where(F.col("phrase") != "").withColumn("word", F.get(longest, 0))
    words = docs.select("doc", F.explode(F.array_distinct(F.split("said", " "))).alias("word"))
    # A phrase that many queries have is looked for once.
    likely = words.join(wanted.select("phrase", "word").distinct(), "word").select("phrase", "doc").distinct()
    hit = likely.join(docs, "doc").where(F.contains(F.concat(F.lit(" "), "said", F.lit(" ")), F.concat(F.lit(" "), "phrase", F.lit(" "))))
    hit = hit.select("phrase", "doc").distinct().join(wanted.select("query", "phrase").distinct(), "phrase")
    return hit.groupBy("query", "doc").agg((F.count(F.lit(1)) * per_phrase).alias("score"))
