"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts up to ``order`` long is counted once and then frozen. A byte
that its context has seen costs -log2(c / (n + d)); else an escape, -log2(d / (n + d)), and then what the next
shorter context makes of it; a context that was never seen costs nothing to leave, and below the empty
context every byte has 1 / 256 (n: occurrences, d: distinct followers, c: the byte's; escape method
C without exclusions). A text's code length in a language is the exact sum over its bytes, with
``order`` line ends before it; the language of the shortest code wins, ties by name.

Trees are learned from a bounded, documented sample: of each language the ``per_language`` training
documents with the smallest XXH64 of the id (ties by id). Everything is scored whole. Costs of all byte
strings of order + 1 that any language has seen are laid out in one hash table; the rest is put together
from shorter tables.

A text that is null or has no letter gets ``und`` and score 0. The score is the winner's share of
the probability over the learned languages. With nothing to learn from every text is ``und``. Rows with
null or repeated ids are rows as any other; null languages aren't learned from.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.frames import mapped, rows
from docketry.llm.words import texts_of

UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def _strings(buf: np.ndarray, n: int) -> np.ndarray:
    """The n-byte string that ends at each byte from the n-th on, as a number."""
    out = np.zeros(len(buf) - n + 1, np.uint32)
    for k in range(n):
        out = (out << np.uint32(8)) | buf[k : len(buf) - n + 1 + k]
    return out


class Model:
    """Code lengths in bits, by language (columns), of a byte after up to three others."""

    order = 3

    def __init__(self, samples: dict[str, list[bytes]]):
        self.langs = sorted(samples)
        width = len(self.langs)
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for lang in self.langs:
            keys: list[list[np.ndarray]] = [[] for _ in range(self.order + 1)]
            for text in samples[lang]:
                buf = np.frombuffer(b"\n" * self.order + text, np.uint8)
                for n in range(1, self.order + 2):
                    keys[n - 1].append(_strings(buf[self.order + 1 - n :], n))
            counts.append([np.unique(np.concatenate(k), return_counts=True) if k else (np.zeros(0, np.uint32), np.zeros(0, np.int64)) for k in keys])
        # Level n: the strings of n bytes that some language has seen, sorted, with their full cost; and
        # the contexts of n - 1 bytes with the cost of leaving them.
        self.seen: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.leave: list[np.ndarray] = []
        for n in range(1, self.order + 2):
            seen = np.unique(np.concatenate([c[n - 1][0] for c in counts])) if width else np.zeros(0, np.uint32)
            contexts = np.unique(seen >> np.uint32(8))
            cost, leave = np.zeros((len(seen), width)), np.zeros((len(contexts), width))
            lower = self._levels(seen, n - 1)
            for k in range(width):
                keys, c = counts[k][n - 1]
                ctx, first, d = np.unique(keys >> np.uint32(8), return_index=True, return_counts=True)
                total = np.add.reduceat(c, first) + d if len(keys) else d
                leave[np.searchsorted(contexts, ctx), k] = -np.log2(d / total)
                cost[:, k] = lower[:, k] + leave[np.searchsorted(contexts, seen >> np.uint32(8)), k]
                cost[np.searchsorted(seen, keys), k] = -np.log2(c / np.repeat(total, d))
            self.seen.append(seen)
            self.cost.append(cost)
            self.contexts.append(contexts)
            self.leave.append(leave)
        top = self.seen[-1]
        self.bits = max(10, int(8 * max(1, len(top)) - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(top))
        at = self._slot(top)
        while len(left):  # open addressing: the first that comes to a free slot has it
            free = self.slots[at] < 0
            take, one = np.unique(at[free], return_index=True)
            self.slots[take] = left[free][one]
            stay = self.slots[at] != left
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def _levels(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Costs of strings by their last n bytes, through the tables of n bytes and less."""
        if n == 0:
            return np.full((len(keys), len(self.langs)), 8.0)
        keys = keys & np.uint32((1 << (8 * n)) - 1) if n < 4 else keys
        seen, contexts = self.seen[n - 1], self.contexts[n - 1]
        out = np.zeros((len(keys), len(self.langs)))
        if not len(keys):
            return out
        at = np.minimum(np.searchsorted(seen, keys), len(seen) - 1)
        hit = seen[at] == keys
        out[hit] = self.cost[n - 1][at[hit]]
        rest = keys[~hit]
        if len(rest):
            ctx = rest >> np.uint32(8)
            where = np.minimum(np.searchsorted(contexts, ctx), len(contexts) - 1)
            out[~hit] = self._levels(rest, n - 1) + np.where((contexts[where] == ctx)[:, None], self.leave[n - 1][where], 0.0)
        return out

    def bytes_cost(self, keys: np.ndarray) -> np.ndarray:
        """Costs of strings of order + 1 bytes."""
        at = self._slot(keys)
        found = self.slots[at]
        top = self.seen[-1]
        wrong = np.flatnonzero((found >= 0) & (top[found] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (top[found[wrong]] != keys[wrong])]
        out = self.cost[-1][found]
        missed = np.flatnonzero(found < 0)
        if len(missed):
            out[missed] = self._levels(keys[missed], self.order + 1)
        return out

    def lengths(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text in each language."""
        docs, pad = len(offsets) - 1, self.order
        size = np.diff(offsets)
        # `order` line ends before each text.
        spread = np.full(len(buf) + pad * docs, 10, np.uint8)
        spread[np.arange(len(buf)) + np.repeat(pad * np.arange(1, docs + 1), size)] = buf
        out = np.zeros((docs, len(self.langs)))
        full = np.flatnonzero(size)
        if not len(full):
            return out
        keys = _strings(spread, pad + 1)
        begin = offsets[:-1] + pad * np.arange(docs)
        real = np.ones(len(keys) + pad, bool)
        for k in range(pad):
            real[begin + size + k] = False
        cost = self.bytes_cost(keys[real[: len(keys)]])
        for k in range(len(self.langs)):
            out[full, k] = np.add.reduceat(cost[:, k], offsets[:-1][full])
        return out


def learn(df: DataFrame, key: str, text: str, lang: str, training, per_language: int, language_bytes: int = 16 << 20, parts: int = 64) -> Model:
    """A model from per_language documents of each language at most, among those where training holds; whole ones, until a
    language has ``language_bytes``. Languages are the distinct values of a column of labels, a few dozen."""
    ids = df.where(F.col(lang).isNotNull() & training).select(F.col(key).alias("__key"), F.col(lang).alias("__lang"))
    order = Window.partitionBy("__lang").orderBy(F.xxhash64("__key"), "__key")
    # First within the rows of each some input partitions, so that a language's rows aren't one task's: a task then reads
    # per_language rows of its input partitions, and in the end of ``parts`` parts. Which row is where changes nothing.
    part = F.pmod(F.spark_partition_id(), F.lit(parts))
    some = Window.partitionBy("__lang", "__part").orderBy(F.xxhash64("__key"), "__key")
    few = ids.withColumn("__part", part).withColumn("__rank", F.row_number().over(some)).where(F.col("__rank") <= per_language)
    chosen = few.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= per_language).select("__key", "__lang").distinct()
    # per_language rows a language.
    texts = df.select(F.col(key).alias("__key"), F.col(lang).alias("__lang"), F.col(text).cast("binary").alias("__text")).join(F.broadcast(chosen), ["__key", "__lang"], "left_semi")
    so_far = F.sum(F.coalesce(F.octet_length("__text"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    texts = texts.withColumn("__before", F.coalesce(so_far, F.lit(0))).where(F.col("__before") < language_bytes).drop("__before")
    samples: dict[str, list[bytes]] = {}
    for r in texts.collect():
        samples.setdefault(r["__lang"], []).append(bytes(r["__text"] or b""))
    return Model(samples)


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, lang_pred, score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        said, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
        if model.langs:
            for lo, hi, buf, offsets in texts_of(rows(batch, "__text")):
                bits = model.lengths(buf, offsets)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(bits.min(axis=1)[:, None] - bits).sum(axis=1)
                raw = buf.tobytes()
                for d in range(hi - lo):
                    if has_letter(raw[offsets[d] : offsets[d + 1]]):
                        said[lo + d], score[lo + d] = model.langs[best[d]], share[d]
        return pa.RecordBatch.from_arrays([rows(batch, "__key"), pa.array(said, pa.string()), pa.array(score)], names=[key, "lang_pred", "score"])

    return mapped(df.select(F.col(key).alias("__key"), F.col(text).cast("binary").alias("__text")), run, f"`{key}` {df.schema[key].dataType.simpleString()}, lang_pred string, score double")
