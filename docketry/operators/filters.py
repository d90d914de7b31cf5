"""Facet filters, searches by text, direct hits, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facets(year: Column | None = None, low: int | None = None, high: int | None = None, lists: dict[str, list[str]] | None = None, values: dict[str, list[str]] | None = None) -> Column | None:
    """All conditions at once; None without any. A null year meets no bound. lists: any of the values in an
    array column; values: a column's value among those."""
    found = []
    if low is not None:
        found.append(F.coalesce(year, F.lit(0)) >= low)
    if high is not None:
        found.append(F.coalesce(year, F.lit(9999)) <= high)
    found += [F.arrays_overlap(c, F.array(*map(F.lit, some))) for c, some in (lists or {}).items() if some]
    found += [F.col(c).isin(some) for c, some in (values or {}).items() if some]
    return reduce(Column.__and__, found) if found else None


def isolated(labels: Column, chosen: list[str]) -> Column:
    """Whether all of the labels are among those chosen."""
    return F.size(F.array_except(labels, F.array(*map(F.lit, chosen)))) == 0


def narrowed(df: DataFrame, condition: Column, least: int = 3, most: float = 0.9) -> DataFrame:
    """df where the condition holds, if that leaves ``least`` rows and less than the share ``most``; else df."""
    hits, every = df.agg(F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("int")), F.lit(0)), F.count(F.lit(1))).first()
    return df.where(condition) if hits >= least and hits < most * every else df


def holds(query: Column, *columns: Column) -> Column:
    """Whether any of the columns holds the query, case aside; an empty query is held by all."""
    said = F.lower(F.trim(query))
    return (said == "") | reduce(Column.__or__, [F.contains(F.lower(F.coalesce(c, F.lit(""))), said) for c in columns])


def case_number(number: Column, query: Column) -> Column:
    """Whether a query is this case number, alone or with more behind it, or in brackets."""
    n, q = F.lower(F.trim(number)), F.lower(F.trim(query))
    return (n == q) | F.startswith(n, F.concat(q, F.lit(" "))) | F.contains(n, F.concat(F.lit("("), q, F.lit(")")))


def first_of(parts: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """The parts one after the other, of rows of one key only the first; ``part`` tells where it came from."""
    from docketry.sources.readers import first_wins

    return first_wins(reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]), key, ["part", *order])


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit in order."""
    return df.orderBy(*order).offset(offset).limit(limit)
