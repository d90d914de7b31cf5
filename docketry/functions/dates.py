"""Dates as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Danish month names (fixed values).
MONTHS = ("januar", "februar", "marts", "april", "maj", "juni", "juli", "august", "september", "oktober", "november", "december")


def parsed(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """A date, or null where the text is none."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


def in_text(text: Column) -> Column:
    """All dates that a Danish text names, in order: 16.5.2019, 16-05-2019, 16. maj 2019."""
    said = F.lower(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(said, F.lit(rf"[0-9]{{1,2}}[./-] ?(?:[0-9]{{1,2}}[./-] ?|(?:{'|'.join(MONTHS)}) )[0-9]{{4}}"), F.lit(0))
    month = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)))

    def date(x: Column) -> Column:
        name = F.regexp_extract(x, "[a-z]+", 0)
        number = F.when(name != "", F.try_element_at(month, name)).otherwise(F.regexp_extract(x, "^[0-9]+[./-] ?([0-9]+)", 1).try_cast("int"))
        return F.try_to_timestamp(F.concat_ws("-", F.regexp_extract(x, "[0-9]{4}$", 0), F.lpad(number.cast("string"), 2, "0"), F.lpad(F.regexp_extract(x, "^[0-9]+", 0), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")

    return F.array_compact(F.transform(found, date))


def recency(year: Column, base: int = 2017, step: float = 0.02, most: float = 0.15) -> Column:
    """A factor from 1 on that grows with the year; 1 where it is unknown."""
    return F.coalesce(1 + F.greatest(F.lit(0.0), F.least(F.lit(most), (year - base) * F.lit(step))), F.lit(1.0))


def shown(date: Column, estimated: Column) -> Column:
    """dd.mm.yyyy, with "ca." if estimated; a dash for null."""
    said = F.date_format(date, "dd.MM.yyyy")
    return F.coalesce(F.when(estimated, F.concat(F.lit("ca. "), said)).otherwise(said), F.lit("–"))
