"""Matches of a pattern with their places, as Columns: what regexp_extract_all doesn't tell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """The matches in order: at (characters before the match), said (the match), value (one of its groups).

    A place is the length of what lies between the matches before it, and of these. The pattern must not match nothing.
    """
    said, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    between = F.split(text, pattern, -1)

    def length(parts: Column, n: Column) -> Column:
        return F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, x: a + F.length(x))

    return F.transform(said, lambda m, i: F.struct((length(between, i + 1) + length(said, i)).alias("at"), m.alias("said"), F.get(values, i).alias("value")))


def by_place(*found: Column) -> Column:
    """The values of several lists of (at, value), by place, ties by value, each once."""
    every = reduce(lambda a, b: F.concat(a, b), found)
    return F.array_distinct(F.transform(F.array_sort(every), lambda x: x["value"]))


def last_place(text: Column, pattern: str) -> Column:
    """Characters before the last match; null without one."""
    return F.try_element_at(places(text, pattern), F.lit(-1))["at"]


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether one of the phrases stands in the text."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases), F.lit(False))


def met(text: Column, phrases: tuple[str, ...]) -> Column:
    """The phrases that stand in the text."""
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def sentences(text: Column) -> Column:
    """Parts that white space after a full stop, question or exclamation mark divides."""
    return F.split(text, r"(?<=[.!?])\s+")
