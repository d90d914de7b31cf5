"""Tables written once to the folder that driver and executors share: cut lineages, caches by content, appended rows."""

from __future__ import annotations

import hashlib
import inspect
import time
import uuid
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

#: Used where spark.checkpoint.dir is unset and all runs on one machine, as in tests.
LOCAL_FOLDER = "/tmp/docketry-checkpoints"


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder of spark.checkpoint.dir; LOCAL_FOLDER where none is named and there is no cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    return (named or LOCAL_FOLDER).rstrip("/")


def _place(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which goes when the driver ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, place = _place(spark, path)
    fs.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def state(spark: SparkSession, paths: list[str]) -> str:
    """A digest of what lies at some paths: names, sizes and times of files."""
    found = []
    for path in paths:
        fs, place = _place(spark, path)
        every = fs.listStatus(place)
        found += sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in (every[i] for i in range(len(every))))
    return hashlib.sha256(repr(found).encode()).hexdigest()


def cached(spark: SparkSession, name: str, paths: list[str], code: list[ModuleType], make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, read from an earlier run's table if the files at paths and the code are those it was made from.

    A new table is written beside and renamed into place, so a reader never sees half of one; of two builders the first one's stays.
    The table before it stays too, for those who still read it; older ones of the same name and paths go after a day.
    """
    said = "".join(inspect.getsource(m) for m in code)
    home = f"{folder(spark)}/cache/{name}-{hashlib.sha256(repr(paths).encode()).hexdigest()[:12]}"
    path = f"{home}/{hashlib.sha256((state(spark, paths) + said).encode()).hexdigest()[:16]}"
    fs, place = _place(spark, path)
    if not fs.exists(place):
        half = f"{home}/.{uuid.uuid4().hex}"
        make().write.parquet(half)
        if not renamed(spark, half, path):
            fs.delete(_place(spark, half)[1], True)
        older = fs.listStatus(_place(spark, home)[1])
        older = sorted((older[i] for i in range(len(older))), key=lambda s: s.getModificationTime())
        for one in [s for s in older if s.getPath().getName() != path.rsplit("/", 1)[1]][:-1]:
            if time.time() * 1000 - one.getModificationTime() > 86_400_000:
                fs.delete(one.getPath(), True)
    return spark.read.parquet(path)


def renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a file or folder; False, and nothing done, where something has the name already."""
    fs, place = _place(spark, target)
    files = spark._jvm.org.apache.hadoop.fs
    plainly = spark.sparkContext._gateway.new_array(getattr(files, "Options$Rename"), 0)
    try:
        files.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(_place(spark, source)[1]), fs.makeQualified(place), plainly)
        return True
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "ParentNotDirectory" not in str(e) and fs.exists(place):
            return False
        raise


def append_json(df: DataFrame, path: str) -> None:
    """Appends rows as lines of JSON; what lies there stays as it is."""
    df.write.mode("append").json(path)
