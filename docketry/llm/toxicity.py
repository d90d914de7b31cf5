"""Toxicity by a classifier chain.

Categories are predicted in turn by logistic regression on which words, and which beginnings of words
(four and five bytes), a text holds. A category's model also gets the log odds that the models of earlier
categories gave. While it is trained these are out-of-fold: each training row's earlier odds come from
models that haven't seen the row.

Models are fitted on the driver on a bounded, documented sample: the ``sample_rows`` labelled documents
with the smallest XXH64 of the id (ties by id). Features are the ``features`` with the largest
chi-squared for the category among those in ``least`` rows or more. All documents are scored whole.

Null or empty text has no features and gets the probability of the bias alone. Labels that are null aren't
learned from; of repeated labels of a document the largest counts. A category without both answers in the
sample, or no labels at all, gets one constant probability. Repeated documents are scored one by one;
an empty table gives an empty result. Columns that clash with result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.frames import rows, utf8
from docketry.llm.words import ALNUM, Octets, Words, member, texts_of, words


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each word and its beginnings."""
    doc = np.repeat(np.arange(len(w.first) - 1), w.counts())
    if not len(w):
        return doc, np.zeros(0, np.uint64)
    octets = Octets(w.buf, lower=True)
    found, docs = [], []
    for size in (0, 4, 5):
        long = np.ones(len(w), bool) if not size else w.ends - w.starts > size
        a = w.starts[long]
        found.append(octets.hashes(a, a + size if size else w.ends, size) >> np.uint64(32))
        docs.append(doc[long])
    return np.concatenate(docs), np.concatenate(found)


class Logistic:
    """Logistic regression on sets of features and a few dense columns."""

    def __init__(self, names: np.ndarray, dense: int, ridge: float = 0.05, steps: int = 120):
        self.names, self.dense, self.ridge, self.steps = names, dense, ridge, steps
        self.w, self.v, self.bias = np.zeros(len(names)), np.zeros(dense), 0.0

    def fit(self, row: np.ndarray, col: np.ndarray, extra: np.ndarray, y: np.ndarray) -> Logistic:
        n, k = len(y), len(self.names)
        theta = np.zeros(k + self.dense + 1)
        share = min(max(y.mean(), 1e-4), 1 - 1e-4) if n else 0.5
        theta[-1] = np.log(share / (1 - share))
        if n and 0 < y.sum() < n:
            first, second = np.zeros_like(theta), np.zeros_like(theta)
            for t in range(1, self.steps + 1):
                z = np.bincount(row, theta[col], n) + extra @ theta[k:-1] + theta[-1]
                off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
                grad = np.concatenate([np.bincount(col, off[row], k), extra.T @ off, [off.sum()]])
                grad[:-1] += self.ridge * theta[:-1]
                first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
                theta -= 0.15 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        self.w, self.v, self.bias = theta[:k], theta[k:-1], float(theta[-1])
        return self

    def odds(self, row: np.ndarray, col: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return np.bincount(row, self.w[col], len(extra)) + extra @ self.v + self.bias


#: Entries of a sample looked at together, which bounds what lies beside the sample itself.
_BLOCK = 1 << 18


def _coded(row: np.ndarray, name: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features in ``least`` rows or more, sorted, and (row, place of the feature) of their entries; a part of the rows
    can't hold another feature often enough."""
    every, often = np.unique(name, return_counts=True)
    every = every[often >= least]
    rows_, codes = [], []
    for lo in range(0, len(name), _BLOCK):
        part = name[lo : lo + _BLOCK]
        hit = member(part, every)
        rows_.append(row[lo : lo + _BLOCK][hit].astype(np.int32))
        codes.append(np.searchsorted(every, part[hit]).astype(np.int32))
    return every.astype(np.uint64), np.concatenate([*rows_, np.zeros(0, np.int32)]), np.concatenate([*codes, np.zeros(0, np.int32)])


def _select(row: np.ndarray, code: np.ndarray, size: int, y: np.ndarray, use: np.ndarray, most: int, least: int) -> np.ndarray:
    """The places of the features with the largest chi-squared in the rows to use, sorted; ties by place."""
    df, hit = np.zeros(size, np.int64), np.zeros(size)
    for lo in range(0, len(row), _BLOCK):
        r, c = row[lo : lo + _BLOCK], code[lo : lo + _BLOCK]
        own = use[r]
        df += np.bincount(c[own], minlength=size)
        hit += np.bincount(c[own], y[r[own]], size)
    n, pos = int(use.sum()), y[use].sum()
    keep = np.flatnonzero((df >= least) & (df < n))
    if not 0 < pos < n or not len(keep):
        return keep[:0]
    df, hit = df[keep], hit[keep]
    chi = n * (hit * n - df * pos) ** 2 / (df * (n - df) * pos * (n - pos))
    return np.sort(keep[np.lexsort((keep, -chi))[:most]])


def _chosen(row: np.ndarray, code: np.ndarray, size: int, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place among the kept) of the entries that are kept."""
    place = np.full(size, -1, np.int64)
    place[kept] = np.arange(len(kept))
    at = np.concatenate([*(lo + np.flatnonzero(place[code[lo : lo + _BLOCK]] >= 0) for lo in range(0, len(code), _BLOCK)), np.zeros(0, np.int64)])
    return row[at].astype(np.int64), place[code[at]]


def _columns(row: np.ndarray, name: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hit = member(name, names)
    return row[hit], np.searchsorted(names, name[hit])


class Chain:
    """Models of the categories, in turn."""

    def __init__(self, categories: list[str]):
        self.categories, self.models = categories, [Logistic(np.zeros(0, np.uint64), i) for i in range(len(categories))]

    def fit(self, row: np.ndarray, name: np.ndarray, labels: np.ndarray, fold: np.ndarray, most: int, least: int) -> Chain:
        n = len(labels)
        every, row, code = _coded(row, name, least)
        del name
        size, extra, whole = len(every), np.zeros((n, 0)), np.ones(n, bool)
        for i in range(len(self.categories)):
            y = labels[:, i].astype(float)
            kept = _select(row, code, size, y, whole, most, least)
            r, c = _chosen(row, code, size, kept)
            self.models[i] = Logistic(every[kept], i).fit(r, c, extra, y)
            if i + 1 < len(self.categories):
                held = np.zeros(n)
                for f in np.unique(fold):
                    # What is selected, too, comes from the other folds.
                    inside = fold != f
                    at = np.cumsum(inside) - 1
                    mine = _select(row, code, size, y, inside, most, least)
                    r, c = _chosen(row, code, size, mine)
                    own = inside[r]
                    model = Logistic(every[mine], i).fit(at[r[own]], c[own], extra[inside], y[inside])
                    held[~inside] = model.odds(r, c, extra)[~inside]
                extra = np.column_stack([extra, held])
        return self

    def odds(self, row: np.ndarray, name: np.ndarray, n: int) -> np.ndarray:
        """Log odds of each category for n texts; (row, name) without repeats."""
        out = np.zeros((n, 0))
        for model in self.models:
            out = np.column_stack([out, model.odds(*_columns(row, name, model.names), out)])
        return out


def _unique(doc: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((doc.astype(np.uint64) << np.uint64(32)) | name)
    return (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF)


def learn(df: DataFrame, labels: DataFrame, categories: dict[str, Column], key: str = "doc_id", text: str = "text", sample_rows: int = 12_000, most: int = 2_048, least: int = 4, folds: int = 4) -> Chain:
    """A chain of the categories, each given by a condition over columns of labels, in that order."""
    named = list(categories)
    truth = labels.select(F.col(key).alias("__key"), *(c.cast("int").alias(f"__y{i}") for i, c in enumerate(categories.values()))).dropna()
    truth = truth.groupBy("__key").agg(*(F.max(f"__y{i}").alias(f"__y{i}") for i in range(len(named))))
    ids = df.select(F.col(key).alias("__key")).distinct()
    sample = truth.join(ids, "__key", "left_semi").orderBy(F.xxhash64("__key"), "__key").limit(sample_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for lo, hi, buf, offsets in texts_of(rows(batch, "__text")):
                doc, name = _unique(*features(words(buf, offsets, ALNUM)))
                cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
                made += [name[cuts[i] : cuts[i + 1]].astype(np.uint32).tobytes() for i in range(hi - lo)]
            keep = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(rows(batch, c) for c in keep), pa.array(made, pa.binary())], names=[*keep, "__features"])

    answers = ", ".join(f"__y{i} int" for i in range(len(named)))
    # sample_rows at most, here and on the driver.
    texts = df.select(F.col(key).alias("__key"), utf8(text).alias("__text")).join(F.broadcast(sample), "__key")
    got = texts.select("__key", *(f"__y{i}" for i in range(len(named))), "__text").mapInArrow(extract, f"__key {df.schema[key].dataType.simpleString()}, {answers}, __features binary").toArrow().to_pydict()
    order = sorted(range(len(got["__key"])), key=lambda i: (got["__key"][i], got["__features"][i]))
    y = np.array([[got[f"__y{k}"][i] for k in range(len(named))] for i in order]).reshape(-1, len(named))
    sets = [np.frombuffer(got["__features"][i], np.uint32) for i in order]
    row, name = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets]), np.concatenate([*sets, np.zeros(0, np.uint32)])
    del got, sets
    return Chain(named).fit(row, name, y, np.arange(len(y)) % folds, most, least)


def score(df: DataFrame, chain: Chain, keep: list[str], text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The kept columns, p_<category> for each category, and rejected: the last category's reaches the threshold."""
    shared = df.sparkSession.sparkContext.broadcast((chain, np.unique(np.concatenate([m.names for m in chain.models]))))
    results = [*(f"p_{c}" for c in chain.categories), "rejected"]
    keep = [c for c in keep if c not in results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, known = shared.value
        for batch in batches:
            for lo, hi, buf, offsets in texts_of(rows(batch, "__text")):
                doc, name = features(words(buf, offsets, ALNUM))
                hit = member(name, known)
                p = 1 / (1 + np.exp(-chain.odds(*_unique(doc[hit], name[hit]), hi - lo)))
                yield pa.RecordBatch.from_arrays([*(rows(batch, c).slice(lo, hi - lo) for c in keep), *(pa.array(p[:, i].copy()) for i in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], names=[*keep, *results])

    kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"`{c}` double" for c in results[:-1]), "rejected boolean"])
    return df.select(*(F.col(f"`{c}`") for c in keep), utf8(F.col(f"`{text}`")).alias("__text")).mapInArrow(run, kinds)
