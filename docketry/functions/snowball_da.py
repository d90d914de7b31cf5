"""The Snowball stemmer for Danish, after the published algorithm; an Arrow UDF over token lists."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouyæåø"
# Fixed values of the published algorithm.
MAIN = sorted("hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret".split(), key=len, reverse=True)
S_ENDINGS = "abcdfghjklmnoprtvyzå"
OTHER = sorted("ig lig elig els løst".split(), key=len, reverse=True)
#: Words that the stemmer would join with others, and trade words the board doesn't use (fixed values).
PROTECTED = {"rødder": "rødder", "rødderne": "rødder"}
LEXICON = {"rodindvækst": ("rødder", "indvækst"), "rodindtrængning": ("rødder", "indtrængning"), "rodindtrængninger": ("rødder", "indtrængning"), "rodvækst": ("rødder",)}


def _region(word: str) -> int:
    """Where R1 begins: after the first non-vowel behind a vowel, at the third letter or later."""
    for i in range(1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return max(3, i + 1)
    return len(word)


@lru_cache(1 << 16)
def stem(word: str) -> str:
    r = _region(word)

    def ends(suffix: str) -> bool:
        return word.endswith(suffix) and len(word) - len(suffix) >= r

    def undouble(w: str) -> str:
        return w[:-1] if w[-2:] in ("gd", "dt", "gt", "kt") and len(w) - 2 >= r else w

    found = next((s for s in MAIN if ends(s)), None)
    if found:
        word = word[: -len(found)]
    elif ends("s") and word[-2:-1] in tuple(S_ENDINGS):
        word = word[:-1]
    word = undouble(word)
    if word.endswith("igst"):
        word = word[:-2]
    found = next((s for s in OTHER if ends(s)), None)
    if found == "løst":
        word = word[:-1]
    elif found:
        word = undouble(word[: -len(found)])
    if len(word) > r and len(word) >= 2 and word[-1] == word[-2] and word[-1] not in VOWELS and len(word) - 1 >= r:
        word = word[:-1]
    return word


def stems(tokens: list[str]) -> list[str]:
    """Trade words replaced, then each word protected or stemmed."""
    return [PROTECTED.get(t) or stem(t) for x in tokens for t in LEXICON.get(x, (x,))]


def stemmed(text: Column) -> Column:
    """Stems of the words of two letters or more. Each distinct word of a batch is stemmed once."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        told = [stems([w]) for w in coded.dictionary.to_pylist()]
        codes = np.asarray(coded.indices).astype(np.int64)
        sizes = np.array([len(t) for t in told], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        at = np.repeat(starts[codes] - ends[:-1], sizes[codes]) + np.arange(ends[-1])
        words = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64))])
        every = pa.array([t for x in told for t in x], pa.string())
        return pa.ListArray.from_arrays(pa.array(ends[words].astype(np.int32)), every.take(pa.array(at)))

    return run(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zæøå][a-zæøå-]+"), F.lit(0)))


def sql(words: str) -> str:
    """CTEs of DuckDB SQL: of a CTE ``words`` (w), each word once, stemmed (w, stems) with the list of its stems."""
    v, either = f"[{VOWELS}]", "|".join
    pairs = ", ".join(f"('{w}', {list(t)!r})" for w, t in LEXICON.items())
    kept = ", ".join(f"'{w}'" for w in PROTECTED)
    undoubled = "CASE WHEN right({0}, 2) IN ('gd', 'dt', 'gt', 'kt') AND length({0}) - 2 >= r THEN {0}[:-2] ELSE {0} END"
    return f"""
    trade(w, told) AS (VALUES {pairs}),
    told AS (SELECT w, coalesce(told, [w]) AS told FROM {words} LEFT JOIN trade USING (w)),
    plainly AS (SELECT DISTINCT unnest(told) AS t FROM told),
    region AS (SELECT t, CASE WHEN regexp_matches(t, '{v}[^{VOWELS}]') THEN greatest(3, length(regexp_extract(t, '^.*?{v}[^{VOWELS}]'))) ELSE length(t) END AS r FROM plainly),
    main AS (SELECT t, r, regexp_extract(substr(t, r + 1), '({either(MAIN)})$') AS ending FROM region),
    less AS (SELECT t, r, CASE WHEN ending <> '' THEN t[:-length(ending) - 1] WHEN right(substr(t, r + 1), 1) = 's' AND contains('{S_ENDINGS}', t[-2:-2]) AND length(t) > 1 THEN t[:-2] ELSE t END AS x FROM main),
    bare AS (SELECT t, r, {undoubled.format("x")} AS x FROM less),
    igst AS (SELECT t, r, CASE WHEN right(x, 4) = 'igst' THEN x[:-3] ELSE x END AS x FROM bare),
    others AS (SELECT t, r, x, regexp_extract(substr(x, r + 1), '({either(OTHER)})$') AS ending FROM igst),
    cut AS (SELECT t, r, CASE ending WHEN '' THEN x WHEN 'løst' THEN x[:-2] ELSE x[:-length(ending) - 1] END AS x, ending NOT IN ('', 'løst') AS again FROM others),
    twice AS (SELECT t, r, CASE WHEN again THEN {undoubled.format("x")} ELSE x END AS x FROM cut),
    stem AS (SELECT t, CASE WHEN t IN ({kept}) THEN 'rødder' WHEN length(x) - 1 >= r AND length(x) >= 2 AND x[-1:] = x[-2:-2] AND NOT contains('{VOWELS}', x[-1:]) THEN x[:-2] ELSE x END AS stem FROM twice),
    stemmed AS (SELECT w, list(stem ORDER BY i) AS stems FROM (SELECT w, unnest(told) AS t, generate_subscripts(told, 1) AS i FROM told) JOIN stem USING (t) GROUP BY w)"""
