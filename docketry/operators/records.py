"""Records: registers, reconciled values, joins by one of several keys, overrides, folders, exports, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pipe_list(text: Column) -> Column:
    """Parts of a text between pipes, trimmed, each once, in order; no empty ones."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != ""))


def named(df: DataFrame, stem: str, registry: DataFrame) -> DataFrame:
    """df with the name and group of (stem, name, group); an unknown stem is its own name in title case, group "other"."""
    said = F.initcap(F.regexp_replace(F.col(stem), "[_-]+", " "))
    return df.join(registry.withColumnRenamed("stem", stem), stem, "left").withColumns({"name": F.coalesce("name", said), "group": F.coalesce("group", F.lit("other"))})


def reconciled(values: DataFrame, options: DataFrame, stem: Column | None = None) -> DataFrame:
    """(value, option, kind): for each value the option it means: the same text, else the same stem, else one that it
    begins or that begins it, with three letters' difference at most; case aside; the first option of several.

    Values and options are brought together by their first three letters.
    """
    head = lambda c: F.substring(F.lower(c), 1, 3)
    stem = stem or (lambda c: F.regexp_replace(F.lower(c), "(ernes|erne|ene|er|en|et|e|s)$", ""))
    v, o = F.lower("value"), F.lower("option")
    pairs = values.select("value", head(F.col("value")).alias("h")).join(options.select("option", head(F.col("option")).alias("h")), "h")
    kind = F.when(v == o, 0).when(stem(F.col("value")) == stem(F.col("option")), 1).when((F.startswith(o, v) | F.startswith(v, o)) & (F.abs(F.length("value") - F.length("option")) <= 3), 2)
    ranked = pairs.withColumn("kind", kind).where("kind is not null")
    best = ranked.withColumn("n", F.row_number().over(Window.partitionBy("value").orderBy("kind", "option"))).where("n = 1").select("value", "option", "kind")
    return values.select("value").distinct().join(best, "value", "left")


def keep_if_any(df: DataFrame, group: str, condition: Column) -> DataFrame:
    """Rows of a group where the condition holds, or all of the group if it holds for none."""
    marked = df.withColumn("__held", F.coalesce(condition, F.lit(False)))
    # A row a group, whatever a group holds.
    groups = marked.groupBy(F.col(group).alias("__group")).agg(F.max("__held").alias("__any"))
    return marked.join(groups, F.col(group).eqNullSafe(F.col("__group"))).where("__held or not __any").drop("__held", "__any", "__group")


def by_either_key(hits: DataFrame, rows: DataFrame, first: str, second: str, order: str) -> DataFrame:
    """hits with the row of the first key, else of the second; of several rows of a key the first in order."""
    from docketry.sources.readers import first_wins

    data = [c for c in rows.columns if c not in (first, second)]
    one = first_wins(rows.where(F.trim(first) != ""), [first], [order]).select(F.col(first), F.struct(*data).alias("__a"))
    two = first_wins(rows.where(F.trim(second) != ""), [second], [order]).select(F.col(second), F.struct(*data).alias("__b"))
    return hits.join(one, first, "left").join(two, second, "left").withColumn("__x", F.coalesce("__a", "__b")).select(*hits.columns, "__x.*")


def overridden(df: DataFrame, members: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """df with another value in the column for rows whose key is a member."""
    flag = members.select(key).distinct().withColumn("__in", F.lit(True))
    return df.join(flag, key, "left").withColumn(column, F.when(F.col("__in"), value).otherwise(F.col(column))).drop("__in")


def register(df: DataFrame, group: str, outcome: str, place: str) -> DataFrame:
    """(group, outcome, n, places): outcomes of a list of sources with the places they stand at."""
    return df.groupBy(group, outcome).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x.cast("string")), ",").alias("places"))


def added(folder: DataFrame, items: DataFrame) -> DataFrame:
    """A folder's items (folder, link, title) with new ones, of a link already there none."""
    new = items.join(folder.select("folder", "link"), ["folder", "link"], "left_anti").dropDuplicates(["folder", "link"])
    return folder.unionByName(new)


def moved(folder: DataFrame, link: str, old: str, new: str) -> DataFrame:
    """The folder table with a link's item in another folder; one that is there already stays as it is."""
    mine = (F.col("folder") == old) & (F.col("link") == link)
    return added(folder.where(~mine), folder.where(mine).withColumn("folder", F.lit(new)))


def board_points(title: Column, position: Column, total: Column, party: tuple[str, ...], decision: tuple[str, ...]) -> Column:
    """Points of a section title: -100 for a party's; else 100 less 7 a rank for the first decision phrase it holds, 25 for the
    board, 15 for a remark or an assessment, and up to 4 by position if there are any."""
    said = F.lower(title)
    holds = lambda p: F.contains(said, F.lit(p))
    base = F.coalesce(*(F.when(holds(p), F.lit(100.0 - 7 * i)) for i, p in enumerate(decision)), F.lit(0.0))
    score = base + F.when(holds("nævn"), 25.0).otherwise(0.0) + F.when(holds("bemærk") | holds("vurder"), 15.0).otherwise(0.0)
    score = score + F.when((score > 0) & (total > 1), 4.0 * position / F.greatest(F.lit(1), total - 1)).otherwise(0.0)
    unless = F.lit(False)
    for p in party:
        unless = unless | holds(p)
    return F.when(unless, -100.0).otherwise(score)


def key_value(cells: Column, key: str) -> Column:
    """The value of a key in an array of (Key, Value): the last one given; null without it."""
    return F.try_element_at(F.filter(cells, lambda c: c.Key == key), F.lit(-1)).Value
