"""Append-only feeds: streams of files run to their end, tallies, a sliding rate limiter."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.sources.tables import folder

def drained(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What a query over the files at path, read as a stream, has given when all are read.

    In complete mode each batch replaces the table, in append mode it adds a part of its own, so a batch that
    is run again after a failure gives the same rows.
    """
    if mode not in ("append", "complete"):
        raise ValueError(f"no mode {mode}")
    schema = spark.read.parquet(path).schema
    place = f"{folder(spark)}/streams/{uuid.uuid4().hex}"
    # A directory's files, or one file by its name in its directory.
    parent, _, name = path.rpartition("/")
    is_file = spark.read.format("binaryFile").load(path).select("path").limit(2).collect()[0][0].endswith(name)
    source = spark.readStream.schema(schema).format("parquet")
    stream = source.option("pathGlobFilter", name).load(parent) if is_file else source.load(path)
    out = build(stream)

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{place}/out" if mode == "complete" else f"{place}/out/batch={batch}")

    q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out").select(*out.columns)


def tally(events: DataFrame, rating: str = "event_type", value: str = "value") -> DataFrame:
    """Counts, users and the mean value of each rating; as a stream or at rest."""
    return events.groupBy(F.col(rating).alias("rating")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.bround(F.avg(value), 2).alias("mean"))


def limited(events: DataFrame, most: int, seconds: float, user: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """(event, user, allowed, wait): at most ``most`` allowed events of a user in any span of seconds. Events are taken
    by time, then id; a denied one isn't counted, and waits until the oldest counted one falls out.

    Goes along events sorted by user and time, a user's in one partition, with ``most`` times of one user in memory.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in (event, user)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who: Any = None
        held: list[int] = []
        for batch in batches:
            allowed, wait = [], []
            for u, at in zip(batch[user], batch["__at"], strict=True):
                if u != who:
                    who, held = u, []
                while held and held[0] <= at - seconds * 1e6:
                    held.pop(0)
                ok = len(held) < most
                allowed.append(ok)
                wait.append(0.0 if ok else round((held[0] + seconds * 1e6 - at) / 1e6, 6))
                if ok:
                    held.append(at)
            yield pd.DataFrame({event: batch[event], user: batch[user], "allowed": allowed, "wait": wait})

    sorted_ = events.select(event, user, F.unix_micros(F.col(ts).cast("timestamp")).alias("__at")).repartition(user).sortWithinPartitions(user, "__at", event)
    return sorted_.mapInPandas(run, f"{event} {kinds[event]}, {user} {kinds[user]}, allowed boolean, wait double")
