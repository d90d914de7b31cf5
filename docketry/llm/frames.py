"""Small things that the operators share: map stages over Arrow batches, the shared folder, written tables."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used where spark.checkpoint.dir is unset and all runs on one machine, as in tests.
LOCAL_FOLDER = "/tmp/docketry-checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; LOCAL_FOLDER where there is none and no cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    return LOCAL_FOLDER


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and outlives lost executors. The table goes when
    the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: Column | str) -> Column:
    """The UTF-8 bytes of a text column, null as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("binary"), F.lit(b""))


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """f over each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def lists(values: pa.Array | object, counts: object) -> pa.ListArray:
    """Rows of lists: counts[i] of the values to row i."""
    import numpy as np

    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))


def trim() -> None:
    """Gives freed memory back to the system, where the C library can: a worker outlives its task, what it holds on to doesn't
    serve the next one."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def rows(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    """df with the named columns as Spark types."""
    return df.withColumns({name: F.col(name).cast(T._parse_datatype_string(kind)) for name, kind in kinds.items()})


#: A key with more than this share of all rows is hot; there are at most so many.
HOT_KEYS = 10_000


def hot_join(many: DataFrame, one: DataFrame, key: str, n: str) -> DataFrame:
    """many joined with one, which has a row for each key of many at most and in column n how many rows of many have it.
    Keys with more than 1 / HOT_KEYS of all rows, which are fewer than HOT_KEYS, are broadcast, the others shuffled."""
    total = one.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT_KEYS > total
    some = F.broadcast(one.where(hot).drop(n))
    return many.join(some, key).unionByName(many.join(some.select(key), key, "left_anti").join(one.where(~hot).drop(n), key))
