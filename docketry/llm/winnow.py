"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters (A-Z as a-z), digits and characters beyond ASCII. A window is
``window`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window
of its own length. Of each window the least hash of its ``gram``-word grams is kept. A document's
windows that equal an item's have the same least hash, so documents and items are joined on these
fingerprints and no shared span of a window or more is missed. Hits are then extended: the windows
at the fingerprint are compared with the items', first by hash, then byte by byte.

Items of at most ``broadcast_bytes`` of text in all go to the workers as one index of sorted arrays (some 2.6 times the
text), which is looked up while documents are winnowed; beyond that the fingerprints of both sides are shuffled and
joined. The rows are the same.

Null or empty texts have no words and are never contaminated. A null item id counts as empty text.
Repeated rows, of either side, count as rows. With no items nothing is hit; an empty table of
documents gives an empty result. Columns of the input that clash with result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.frames import lists, rows, utf8
from docketry.llm.words import ALNUM, Words, covered, grams, member, texts_of, window_minima, words

RESULT = "n_words long, n_hit long, items array<string>, hit_starts array<int>, hit_ends array<int>, contaminated boolean"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


@dataclass
class Index:
    """Windows of items, by length: the upper halves of their hashes, sorted, and where they begin in ``said``; and the
    fingerprints of each length, sorted. Item k has ``said`` from begins[k] on, words apart by one space."""

    said: bytes
    begins: np.ndarray
    items: list[str]
    windows: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    marks: dict[int, np.ndarray] = field(default_factory=dict)

    def holding(self, n: int, h: int, said: bytes) -> list[str]:
        """The items with this window, whose hash has the upper half h."""
        halves, places = self.windows[n]
        lo, hi = np.searchsorted(halves, np.uint32(h), "left"), np.searchsorted(halves, np.uint32(h), "right")
        at = [p for p in places[lo:hi].tolist() if self.said.startswith(said, p) and self.said[p + len(said) : p + len(said) + 1] == b" "]
        return [self.items[k] for k in (np.searchsorted(self.begins, at, "right") - 1).tolist()] if at else []


def _index(said: list[bytes], items: list[str], windows: dict[int, list[tuple[int, int]]], marks: dict[int, set[int]]) -> Index:
    """said: of each item its words, each with a space behind it; windows: (hash, place in all of them)."""
    out = Index(b"".join(said), np.cumsum([0, *(len(x) for x in said[:-1])]), items)
    for n, found in windows.items():
        halves, places = (np.array([f[k] for f in found], np.uint64) for k in (0, 1))
        halves = (halves >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(halves, kind="stable")
        out.windows[n] = halves[order], places[order].astype(np.uint32)
    out.marks = {n: np.array(sorted(m), np.uint64) for n, m in marks.items()}
    return out


def _said(w: Words, low: bytes, i: int, length: int) -> bytes:
    return b" ".join([low[w.starts[j] : w.ends[j]] for j in range(i, i + length)])


def item_windows(text: bytes, window: int, gram: int, said: bool = True) -> Iterator[tuple[int, int, int, bytes]]:
    """(length, hash, fingerprint, words if said) of each window of an item, in order."""
    buf = np.frombuffer(text, np.uint8)
    w = words(buf, np.array([0, len(buf)]), ALNUM)
    if not len(w):
        return
    n, low, h = min(window, len(w)), text.lower(), w.hashes(lower=True)
    least, there = window_minima(w, h, n, min(gram, n))
    whole = grams(h, n)
    for i in np.flatnonzero(there).tolist():
        yield n, int(whole[i]), int(least[i]), _said(w, low, i, n) if said else b""


def build(items: list[tuple[str, bytes]], window: int, gram: int) -> Index:
    said, names, windows, marks, size = [], [], {}, {}, 0
    for item, text in items:
        tokens = [x for _, _, _, x in item_windows(text, 1, 1)]
        begins = np.cumsum([0, *(len(t) + 1 for t in tokens)]) + size
        for i, (n, h, least, _) in enumerate(item_windows(text, window, gram, False)):
            windows.setdefault(n, []).append((h, int(begins[i])))
            marks.setdefault(n, set()).add(least)
        said.append(b"".join([t + b" " for t in tokens]))
        names.append(item)
        size = int(begins[-1])
    # Items without words have no place of their own.
    some = [k for k, x in enumerate(said) if x]
    return _index([said[k] for k in some], [names[k] for k in some], windows, marks)


def hits(w: Words, hashes: np.ndarray, low: bytes, index: Index, gram: int) -> list[tuple[int, int, list[str]]]:
    """(first word, length, item ids) of the items' windows in some texts."""
    out = []
    for n in index.windows:
        if len(w) < n:
            continue
        least, there = window_minima(w, hashes, n, min(gram, n))
        change = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        likely = np.repeat(member(least[change], index.marks[n]), np.diff(np.append(change, len(least)))) & there
        places = np.flatnonzero(likely)
        if not len(places):
            continue
        halves = (grams(hashes, n)[places] >> np.uint64(32)).astype(np.uint32)
        known = member(halves, index.windows[n][0])
        for i, h in zip(places[known].tolist(), halves[known].tolist(), strict=True):
            if (ids := index.holding(n, h, _said(w, low, i, n))):
                out.append((i, n, ids))
    return out


def _judge(found: list[tuple[int, int, list[str]]], w: Words) -> list[pa.Array]:
    """Result columns for the texts of w."""
    docs = len(w.first) - 1
    counts = w.counts()
    n_hit = np.zeros(docs, np.int64)
    items: list[list[str]] = [[] for _ in range(docs)]
    begins, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if found:
        inside = covered(np.array([x[0] for x in found]), np.array([x[1] for x in found]), len(w))
        total = np.append(0, np.cumsum(inside))
        n_hit = total[w.first[1:]] - total[w.first[:-1]]
        doc = np.searchsorted(w.first, [x[0] for x in found], "right") - 1
        for d in set(doc.tolist()):
            items[d] = sorted({i for k in np.flatnonzero(doc == d) for i in found[k][2]})
        edge = np.zeros(len(w) + 1, bool)
        edge[w.first] = True
        begins = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | edge[:-1]))
        ends = np.flatnonzero(inside & (np.append(~inside[1:], True) | edge[1:])) + 1
    per = np.searchsorted(begins, w.first)
    base = np.repeat(w.first[:-1], np.diff(per))
    return [
        pa.array(counts.astype(np.int64)), pa.array(n_hit), lists(pa.array([i for x in items for i in x], pa.string()), [len(x) for x in items]),
        lists((begins - base).astype(np.int32), np.diff(per)), lists((ends - base).astype(np.int32), np.diff(per)), pa.array((n_hit > 0) & (20 * n_hit >= counts)),
    ]


def decontaminate(
    df: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, gram: int = 5, broadcast_bytes: int = 16 << 20
) -> DataFrame:
    """The kept columns of df, then RESULT: words, words hit, ids of the items with windows here (sorted), the
    runs of words hit (first, and one past the last), and whether a twentieth of the words or more is hit."""
    spark = df.sparkSession
    keep = [c for c in keep if c not in _NAMES]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    source = df.select(*(F.col(f"`{c}`") for c in keep), utf8(F.col(f"`{text}`")).alias("__text"))
    things = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), utf8(item_text).alias("said"))

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words, np.ndarray, bytes]]:
        for lo, hi, buf, offsets in texts_of(rows(batch, "__text")):
            w = words(buf, offsets, ALNUM)
            yield lo, hi, w, w.hashes(lower=True), b""

    def out(batch: pa.RecordBatch, lo: int, hi: int, columns: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(rows(batch, c).slice(lo, hi - lo) for c in keep), *columns], names=[*keep, *_NAMES])

    size = things.agg(F.sum(F.octet_length("said"))).first()[0] or 0
    if size <= broadcast_bytes:
        index = spark.sparkContext.broadcast(build([(r.item, bytes(r.said)) for r in things.collect()], window, gram))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, w, h, _ in parts(batch):
                    yield out(batch, lo, hi, _judge(hits(w, h, w.buf.tobytes().lower(), index.value, gram), w))

        return source.mapInArrow(near, f"{kinds}, {RESULT}")

    def from_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(n, h - (1 << 63), m - (1 << 63), said, item) for item, t in zip(rows(batch, "item").to_pylist(), rows(batch, "said").to_pylist(), strict=True) for n, h, m, said in item_windows(t, window, gram)]
            columns = list(zip(*made, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["n", "whole", "mark", "said", "item"])

    index_rows = things.mapInArrow(from_items, "n int, whole long, mark long, said binary, item string").distinct()
    sizes = [r.n for r in index_rows.select("n").distinct().collect()]  # at most `window` of them

    def from_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = rows(batch, "__key").to_numpy()
            for lo, _, w, h, _ in parts(batch):
                for n in sizes:
                    least, there = window_minima(w, h, n, min(gram, n))
                    fresh = np.append(True, (least[1:] != least[:-1]) | ~there[:-1])[: len(w)]
                    fresh[w.first[:-1][w.counts() > 0]] = True  # windows of one word leave no gap between texts
                    at = np.flatnonzero(there & fresh)
                    doc = np.searchsorted(w.first, at, "right") - 1
                    mark = (least[at] ^ np.uint64(1 << 63)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo + doc]), pa.array(np.full(len(at), n, np.int32)), pa.array(mark)], names=["__key", "n", "mark"])

    keyed = source.withColumn("__key", F.xxhash64("__text"))
    found = (
        keyed.select("__key", "__text").mapInArrow(from_docs, "__key long, n int, mark long").distinct().join(index_rows, ["n", "mark"])
        .groupBy("__key").agg(F.collect_set(F.struct("n", "whole", "said", "item")).alias("__near"))
    )

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near_by = rows(batch, "__near")
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                found, windows, size = near_by[i].as_py() or [], {}, 0
                for x in found:
                    windows.setdefault(x["n"], []).append((x["whole"] + (1 << 63), size))
                    size += len(x["said"]) + 1
                index = _index([x["said"] + b" " for x in found], [x["item"] for x in found], windows, {})
                for lo, hi, w, h, _ in parts(one):
                    index.marks = {n: np.unique(window_minima(w, h, n, min(gram, n))[0]) for n in windows}
                    yield out(one, lo, hi, _judge(hits(w, h, w.buf.tobytes().lower(), index, gram), w))

    return keyed.join(found, "__key", "left").select(*(f"`{c}`" for c in keep), "__text", "__near").mapInArrow(far, f"{kinds}, {RESULT}")
