"""Importance resampling towards a target corpus, by hashed word runs.

A text is lower-cased (A-Z only) and read once: a ring keeps the running CRC-32 states of the last n starts, each word extends
every state by a space and itself and opens a state of its own, and all states are emitted, modulo the number of buckets. So runs of 1
to n words cost one call of zlib a run and no run's text is ever built. Counts of all documents (S, s a bucket) and of all targets (T, t)
are added up a task at a time; a bucket's gain is floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))), a document's weight the
floored mean gain of its runs (none: 0), its score the weight plus Gumbel noise of its key, floor(-1000 ln(-ln((h+0.5) / 2^32))). The highest
scores are a draw without replacement in proportion to e^(weight/1000).

Scores are whole numbers within +-70,000, so a table of how many documents have which score is small whatever the input; the rank of a
drawn document is the number of those above its score plus its place among equals, by key. No task sees more than one score's documents.

Null texts have no words. Null keys are hashed as the empty text and come last among equals; equal keys with equal scores are
ranked in any order, but each rank is given once. Documents of fewer than ``least`` words are never drawn. Without targets T and t are
0; an empty table gives no rows. Columns of the input other than those asked for are left alone; their names can't clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.frames import lists, rows, utf8, written

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Rows that become Python objects at once, and bytes of a long text whose words do.
TURN_ROWS, TURN_BYTES = 256, 1 << 20


def ring(said: list[bytes], n: int, states: list[int]) -> list[int]:
    """The CRC-32 of every run of 1 to n words joined by a space: for each word those that end with it, the longest first. states:
    those of the last n - 1 starts, carried from one call for a text to the next."""
    if n == 1:
        return [*map(crc32, said)]
    out = []
    for word in said:
        spaced = b" " + word
        states[:] = [crc32(spaced, s) for s in states]
        states.append(crc32(word))
        out += states
        if len(states) == n:
            del states[0]
    return out


def runs(text: bytes, n: int) -> Iterator[tuple[int, list[int]]]:
    """(words, CRC-32 of the runs that end with them), a stretch of the text at a time."""
    text, states, at = text.lower(), [], 0  # of bytes, lower() is for A-Z alone
    while at < len(text):
        gap = _GAP.search(text, at + TURN_BYTES) if len(text) - at > TURN_BYTES else None
        end = gap.start() if gap else len(text)
        said = _WORD.findall(text, at, end)
        yield len(said), ring(said, n, states)
        at = end


def _turns(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of a batch in turns."""
    for lo in range(0, batch.num_rows, TURN_ROWS):
        yield lo, rows(batch, name).slice(lo, TURN_ROWS).to_pylist()


def features(df: DataFrame, text: str = "text", n: int = 1, buckets: int = 10_000, keep: list[str] | None = None) -> DataFrame:
    """The kept columns, n_words (long) and buckets (array of int): the bucket of every run of 1 to n words, repeats included."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("n_words", "buckets")]
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _turns(batch, "__text"):
                n_words, flat, sizes = [], [], []
                for t in texts:
                    found = [(k, np.asarray(f, np.int64) % buckets) for k, f in runs(t, n)]
                    n_words.append(sum(k for k, _ in found))
                    sizes.append(sum(len(f) for _, f in found))
                    flat += [f for _, f in found]
                values = np.concatenate([*flat, np.zeros(0, np.int64)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(rows(batch, c).slice(lo, len(texts)) for c in keep), pa.array(n_words, pa.int64()), lists(values, sizes)], names=[*keep, "n_words", "buckets"])

    return df.select(*(F.col(f"`{c}`") for c in keep), utf8(F.col(f"`{text}`")).alias("__text")).mapInArrow(run, f"{kinds}n_words long, buckets array<int>")


def counts(df: DataFrame, text: str = "text", n: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n) over all runs of all texts; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(buckets, np.int64), []

        def add() -> None:
            total[:] += np.bincount(np.asarray(held, np.int64) % buckets, minlength=buckets)
            held.clear()

        for batch in batches:
            for _, texts in _turns(batch, "__text"):
                for t in texts:
                    for _, found in runs(t, n):
                        held += found
                        if len(held) > 200_000:
                            add()
        add()
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    each = df.select(utf8(F.col(f"`{text}`")).alias("__text")).mapInArrow(run, "bucket int, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, targets: DataFrame, text: str = "text", n: int = 1, buckets: int = 10_000) -> list[int]:
    """The gain of each bucket. What comes to the driver is a row a bucket, a parameter's size."""
    s, t = ({r.bucket: r.n for r in counts(df, text, n, buckets).collect()} for df in (documents, targets))
    of_s, of_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    return [math.floor(1000 * math.log((t.get(b, 0) + 1) * of_s / ((s.get(b, 0) + 1) * of_t))) for b in range(buckets)]


def weigh(documents: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text", n: int = 1, seed: int = 2024) -> DataFrame:
    """key, n_words, n_features, weight and score of each document."""
    of, buckets = np.asarray(gain, np.int64), len(gain)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _turns(batch, "__text"):
                made = []
                for t in texts:
                    n_words = n_features = total = 0
                    for said, found in runs(t, n):
                        n_words, n_features = n_words + said, n_features + len(found)
                        total += int(of[np.asarray(found, np.int64) % buckets].sum())
                    made.append((n_words, n_features, total // n_features if n_features else 0))
                columns = [pa.array(c, pa.int64()) for c in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([rows(batch, "__key").slice(lo, len(texts)), *columns], names=["__key", "n_words", "n_features", "weight"])

    each = documents.select(F.col(f"`{key}`").alias("__key"), utf8(F.col(f"`{text}`")).alias("__text")).mapInArrow(run, f"__key {kind}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__key").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return each.select(F.col("__key").alias(key), "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def drawn(scored: DataFrame, percent: int = 10, least: int = 20, key: str = "doc_id") -> DataFrame:
    """scored with rank: 1, 2, 3... from the highest score on for floor(percent * N / 100) of the N documents of ``least`` words or
    more, null for the others. scored is read several times, so it is best a written table."""
    can = F.col("n_words") >= least
    tally = scored.where(can).groupBy("score").agg(F.count("*").alias("n"))
    # One row for each score: fewer than 140,000, whatever the input.
    above = written(tally.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")), "scores")
    wanted = (above.agg(F.sum("n")).first()[0] or 0) * percent // 100
    some = above.where(F.col("above") < wanted)
    lowest = some.agg(F.min("score")).first()[0]
    names = [f"`{c}`" for c in scored.columns if c != "rank"]
    near = can & (F.col("score") >= lowest) if lowest is not None else F.lit(False)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last(f"`{key}`"))) + F.col("above")
    first = scored.where(near).select(*names).join(some.select("score", "above"), "score").withColumn("place", place)
    rank = F.when(F.col("place") <= wanted, F.col("place")).cast("long").alias("rank")
    rest = scored.where(~F.coalesce(near, F.lit(False))).select(*names, F.lit(None).cast("long").alias("rank"))
    return first.select(*names, rank).unionByName(rest)


def resample(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", n: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024) -> DataFrame:
    """key, n_words, n_features, weight, score and rank of every document."""
    scored = weigh(documents, gains(documents, targets, text, n, buckets), key, text, n, seed)
    return drawn(written(scored, "weights"), percent, least, key)


def sql() -> str:
    """DuckDB SQL for op12. The CRC-32 of each distinct word is worked out byte by byte."""
    said = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
    return f"""
    WITH remainders AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS r),
         docs AS (SELECT row_number() OVER () AS d, doc_id, {said} AS words FROM documents),
         of_docs AS (SELECT d, unnest(words) AS w FROM docs),
         of_items AS (SELECT unnest({said}) AS w FROM benchmark),
         vocabulary AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM (SELECT w FROM of_docs UNION ALL SELECT w FROM of_items)),
         hashed AS (SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(r[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM vocabulary, remainders),
         s AS (SELECT bucket, count(*) AS n FROM of_docs JOIN hashed USING (w) GROUP BY bucket),
         t AS (SELECT bucket, count(*) AS n FROM of_items JOIN hashed USING (w) GROUP BY bucket),
         gains AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((s.n + 1) * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
         weighed AS (SELECT d, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM of_docs JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY d),
         scored AS (SELECT d, doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                           coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM docs LEFT JOIN weighed USING (d)),
         ranked AS (SELECT d, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20 QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= count(*) OVER () * 10 // 100)
    SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN ranked USING (d)"""
