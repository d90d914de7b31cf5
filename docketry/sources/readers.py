"""Sources and sinks: decision CSV (plain and zipped), JSON lines, judgement files; identities, first-wins dedup, increments."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.text import excerpt, strip_html

#: Columns of a decision file, all text (fixed values).
DECISION = ("Dato", "Titel", "Link", "Tekst", "Sagsnummer", "Selskab", "Udfald", "Mangeltype", "Forsikringstype", "RulingType")


def all_text(columns=DECISION) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, paths: list[str] | str, columns=DECISION) -> DataFrame:
    """CSV with a header, quotes doubled, fields over several lines; a missing column is null."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).schema(all_text(columns)).csv(paths)


def read_zipped_csv(spark: SparkSession, path: str, columns=DECISION) -> DataFrame:
    """The first .csv member of each zip file under path, one file a task; a file that isn't one gives no rows."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        name = next((n for n in sorted(z.namelist()) if n.lower().endswith(".csv")), None)
                        found = pd.read_csv(z.open(name), dtype=str, keep_default_na=False, encoding="utf-8-sig") if name else pd.DataFrame()
                except zipfile.BadZipFile:
                    continue
                yield found.reindex(columns=list(columns)).astype(object).where(lambda x: x.notna(), None)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, all_text(columns))


def cleaned(df: DataFrame) -> DataFrame:
    """Decision rows with HTML turned to text, an excerpt, and the defect types as a list."""
    text = strip_html(F.col("Tekst"), headings=True)
    types = F.filter(F.transform(F.split(F.coalesce("Mangeltype", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumns({"Tekst": text, "Excerpt": excerpt(text), "Mangeltype": types})


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """One object a line; blank lines are left out, a broken one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_judgements(df: DataFrame, least: float = 0.0, uncertain: bool = False) -> DataFrame:
    """Judgement rows of text columns, typed: rows without ids or with numbers that don't parse are dropped, so are
    negative relevance (unless uncertain) and confidence below least."""
    rel, conf = F.col("relevance").try_cast("int"), F.coalesce(F.col("confidence"), F.lit("1")).try_cast("double")
    typed = df.select(F.trim("question_id").alias("question_id"), F.trim("case_number").alias("case_number"), rel.alias("relevance"), conf.alias("confidence"))
    kept = (F.col("question_id") != "") & (F.col("case_number") != "") & F.col("relevance").isNotNull() & (F.col("confidence") >= least)
    return typed.where(kept & (F.lit(uncertain) | (F.col("relevance") >= 0)))


def identity(link: Column, number: Column, title: Column) -> Column:
    """The first of link, case number and title that isn't blank, with its kind before it."""
    full = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c)
    return F.coalesce(F.concat(F.lit("link:"), full(link)), F.concat(F.lit("case:"), full(number)), F.concat(F.lit("title:"), title))


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """Of rows of one key the first in order. Where the order is of columns upwards, rows are weeded out before they are shuffled."""
    if all(isinstance(c, str) for c in order):
        first = df.groupBy(*(F.col(k) for k in key)).agg(F.min_by(F.struct(*(F.col(c) for c in df.columns)), F.struct(*order)).alias("__row"))
        return first.select(*(F.col("__row")[c].alias(c) for c in df.columns))
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def unseen(df: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't known yet."""
    return df.join(known.select(*key), key, "left_anti")


def refreshed(old: DataFrame, new: DataFrame, key: str, text: str, enough: int = 8_000) -> DataFrame:
    """Rows of old with the new text where it is longer (the old one kept as a summary); texts of ``enough`` characters stay."""
    held = old.join(new.select(F.col(key), F.col(text).alias("__new")), key, "left")
    better = (F.length(F.col(text)) < enough) & (F.length("__new") > F.length(F.col(text)))
    return held.select(*(F.when(better, F.col("__new")).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in old.columns), F.when(better, F.col(text)).alias(f"{text}_summary"))


def append_csv(df: DataFrame, path: str) -> None:
    """Appends rows, text without lone surrogates."""
    clean = [F.regexp_replace(f.name, r"[\uD800-\uDFFF]", "").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields]
    df.select(*clean).write.mode("append").option("header", True).option("escape", '"').csv(path)
