"""Substring dedup by automata of repeated phrases.

A window is ``window`` consecutive words of one text. Each word is removed that a window covers whose
words also start in a text of a smaller key; windows are those of the input.

1. Winnowing: a window is filed under the least hash of its ``gram``-word grams, its phrase. Equal windows
   have equal phrases, so a window can only recur if its phrase does. Neighbouring windows of one phrase are a
   passage. Of each passage the phrase, a hash of its words and the key are gathered over all texts.
2. Confirmation: a phrase that all its texts hold within one and the same passage recurs with the whole passage, first
   in the least key. Where passages of a phrase differ, the windows of each distinct passage are counted one by one.
   Both give the recurring windows and the first key of each.
3. Passages: the runs of words that recurring windows cover are cut out of the text with the first key, and dealt to
   shards by the least key that holds their phrase.
4. Automata: a shard's phrases are compiled to an Aho-Corasick automaton. All texts that hold a recurring phrase as later
   ones stream through the shards of their phrases (texts that hold none can't have a recurring window). Only
   windows whose phrase the automaton has located within them go on: a window's hash names the place in the shard's
   passages that it may equal, and from there the words are compared one by one along the text. Runs that are equal
   and whose passage has a smaller key are removed.

A shard's texts are dealt over several tasks by their bytes (``task_bytes``), each with the shard's automaton. No step
gathers a phrase's texts in one task: counts are partial aggregates of fixed size, and phrases that many texts hold are
joined by broadcast. Hashes only suggest; the words decide over what is removed.

Null and empty texts, and texts below a window, lose nothing. Rows with a null key lose nothing and remove nothing
elsewhere. Rows of equal keys don't remove from one another. Columns that clash with result columns are replaced;
an empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.frames import hot_join, lists, rows, utf8, written
from docketry.llm.words import NOTHING, PLAIN, Words, covered, grams, member, sliding_min, texts_of, window_minima, words

_FLIP = np.uint64(1 << 63)
#: Letters of a shard's automaton.
LETTERS = 127


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ _FLIP).view(np.int64)


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64) ^ _FLIP


class Windows:
    """The windows of some texts: by first word, phrase, whether there is one, and the runs of one phrase."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        self.w: Words = words(buf, offsets, PLAIN)
        self.h = self.w.hashes(lower=False)
        self.phrase, self.there = window_minima(self.w, self.h, window, gram)
        self.window, self.gram = window, gram

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(first window, number of windows) of each passage."""
        n = len(self.w)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = self.there.copy()
        # Texts are apart: a text's last windows aren't there, if window > 1.
        begin[1:] &= ~self.there[:-1] | (self.phrase[1:] != self.phrase[:-1])
        begin[self.w.first[:-1][self.w.first[:-1] < n]] |= self.there[self.w.first[:-1][self.w.first[:-1] < n]]
        first = np.flatnonzero(begin)
        end = np.flatnonzero(self.there & np.append(~self.there[1:] | begin[1:], True)) + 1
        return first, end - first

    def passages(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """A hash of each passage's words."""
        import xxhash

        raw, size = self.h.tobytes(), 8 * (count + self.window - 1)
        lo = 8 * first
        digest = xxhash.xxh3_64_intdigest
        return np.array([digest(raw[a:b]) for a, b in zip(lo.tolist(), (lo + size).tolist(), strict=True)], np.uint64)

    @cached_property
    def whole(self) -> np.ndarray:
        """A hash of each window."""
        return _signed(grams(self.h, self.window))

    @cached_property
    def small(self) -> np.ndarray:
        """A hash of each gram, as phrases are named."""
        return _signed(grams(self.h, self.gram))

    @cached_property
    def named(self) -> np.ndarray:
        """The name of each window's phrase."""
        return _signed(self.phrase)

    @cached_property
    def raw(self) -> bytes:
        return self.w.buf.tobytes()

    def raw_words(self) -> list[bytes]:
        """All words, text after text."""
        offsets = self.w.offsets.tolist()
        return [w for a, b in zip(offsets[:-1], offsets[1:], strict=True) for w in self.raw[a:b].split()]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.w.first, at, "right") - 1


def _anchors(docs: DataFrame, kind: str, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = rows(batch, "id")
            for lo, _, buf, offsets in texts_of(rows(batch, "said")):
                x = Windows(buf, offsets, window, gram)
                first, count = x.runs()
                passage = x.passages(first, count)
                doc = x.doc_of(first)
                one = _distinct(doc, passage)
                size = pa.array(np.diff(offsets)[doc[one]].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(x.phrase[first[one]])), pa.array(_signed(passage[one])), ids.take(pa.array(lo + doc[one])), size], names=["phrase", "passage", "id", "size"])

    return docs.mapInArrow(run, f"phrase long, passage long, id {kind}, size long")


def _distinct(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One place of each (doc, value)."""
    order = np.lexsort((value, doc))
    if not len(order):
        return order
    keep = np.append(True, (doc[order][1:] != doc[order][:-1]) | (value[order][1:] != value[order][:-1]))
    return order[keep]


def _single_windows(docs: DataFrame, kind: str, window: int, gram: int) -> DataFrame:
    """The windows of the listed passages of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = rows(batch, "id"), rows(batch, "wanted").to_pylist()
            for lo, hi, buf, offsets in texts_of(rows(batch, "said")):
                x = Windows(buf, offsets, window, gram)
                first, count = x.runs()
                passage, doc = _signed(x.passages(first, count)), x.doc_of(first)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                at, owner, last, least = [], [], [], []
                for d in range(hi - lo):
                    of = {p["passage"]: p for p in wanted[lo + d]}
                    for k in range(cut[d], cut[d + 1]):
                        if (p := of.pop(int(passage[k]), None)) is not None:
                            span = range(int(first[k]), int(first[k] + count[k]))
                            at += span
                            owner += [lo + d] * len(span)
                            last += [p["last"]] * len(span)
                            least += [p["least"]] * len(span)
                places = np.array(at, np.int64)
                held = ids.take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.named[places]), pa.array(x.whole[places]), held, pa.array(last, held.type), pa.array(least, held.type)], names=["phrase", "whole", "id", "last", "least"]
                )

    return docs.mapInArrow(run, f"phrase long, whole long, id {kind}, last {kind}, least {kind}")


def _passages(docs: DataFrame, kind: str, window: int, gram: int) -> DataFrame:
    """For each text and each entry of wanted (shard, phrases, wholes) the runs of words that its windows of those
    phrases, and its windows of those hashes, cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = rows(batch, "id"), rows(batch, "wanted").to_pylist()
            for lo, hi, buf, offsets in texts_of(rows(batch, "said")):
                x = Windows(buf, offsets, window, gram)
                shards, owner, said = [], [], []
                for d in range(hi - lo):
                    a, b = int(x.w.first[d]), int(x.w.first[d + 1])
                    for part in wanted[lo + d]:
                        phrases, wholes = (np.array(sorted(part[c] or ()), np.int64) for c in ("phrases", "wholes"))
                        mine = np.flatnonzero(x.there[a:b] & (member(x.named[a:b], phrases) | member(x.whole[a:b], wholes)))
                        inside = covered(mine, window, b - a)
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
                        for i, j in zip((a + edges[::2]).tolist(), (a + edges[1::2]).tolist(), strict=True):
                            shards.append(part["shard"])
                            owner.append(lo + d)
                            said.append(b" ".join(x.raw[x.w.starts[i] : x.w.ends[j - 1]].split()))
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), ids.take(pa.array(owner, pa.int64())), pa.array(said, pa.binary())], names=["shard", "id", "said"])

    return docs.mapInArrow(run, f"shard int, id {kind}, said binary")


class Shard:
    """Passages with their keys, and an automaton of the phrases that their windows are filed under."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.codes: dict[bytes, int] = {}
        #: Words of the passages, one passage after the other; the windows' hashes, places and keys.
        self.words: list[np.ndarray] = []
        self.size = 0
        self.windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.phrases: dict[int, str] = {}
        self.automaton = None

    def _letters(self, codes: np.ndarray) -> str:
        """Words are dealt to LETTERS letters: the automaton looks a node's letters through one by one, so there must be
        few. Words that share one are told apart when words are compared. Unknown words have a letter of no phrase."""
        return np.where(codes > 0, 1 + (codes - 1) % LETTERS, 0).astype(np.uint8).tobytes().decode("latin-1")

    def read(self, x: Windows, keys: list[int]) -> None:
        """Takes passages, given as texts, with their keys."""
        codes = np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in x.raw_words()], np.int32)
        at = np.flatnonzero(x.there)
        self.windows.append((x.whole[at], at + self.size, np.array(keys, np.int64)[x.doc_of(at)]))
        self.words.append(codes)
        self.size += len(codes)
        name, one = np.unique(x.named[at], return_index=True)
        for phrase, k in zip(name.tolist(), at[one].tolist(), strict=True):
            if phrase not in self.phrases:
                i = k + int(np.flatnonzero(x.small[k : k + self.window] == phrase)[0])
                self.phrases[phrase] = self._letters(codes[i : i + self.gram])

    def compile(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for said in set(self.phrases.values()):
            self.automaton.add_word(said, True)
        if self.phrases:
            self.automaton.make_automaton()
        self.names = np.array(sorted(self.phrases), np.int64)
        whole, place, key = (np.concatenate([*(w[k] for w in self.windows), np.zeros(0, np.int64)]) for k in range(3))
        order = np.lexsort((key, whole))
        self.whole, self.place, self.key = whole[order], place[order], key[order]
        self.said = np.concatenate([*self.words, np.zeros(0, np.int32)])
        self.words, self.windows = [], []

    def located(self, x: Windows, codes: np.ndarray) -> np.ndarray:
        """Where the automaton finds phrases: their hashes as they are in x, NOTHING elsewhere."""
        out = np.full(len(x.w), NOTHING)
        ends: list[int] = []
        for a, b in zip(x.w.first[:-1].tolist(), x.w.first[1:].tolist(), strict=True):
            if b - a >= self.window:
                ends += [a + e for e, _ in self.automaton.iter(self._letters(codes[a:b]))]
        at = np.array(ends, np.int64) - (self.gram - 1)
        at = at[member(x.small[at], self.names)]
        out[at] = _unsigned(x.small[at])
        return out

    def spans(self, x: Windows, keys: list[int]) -> np.ndarray:
        """Which words of the texts of x are in removed windows."""
        none = np.zeros(len(x.w), bool)
        if not len(self.whole) or not self.phrases or not len(x.w):
            return none
        get = self.codes.get
        codes = np.array([get(w, 0) for w in x.raw_words()], np.int32)
        at = np.flatnonzero(x.there & (sliding_min(self.located(x, codes), self.window - self.gram + 1) == x.phrase))
        like = np.minimum(np.searchsorted(self.whole, x.whole[at]), len(self.whole) - 1)
        hit = (self.whole[like] == x.whole[at]) & (self.key[like] < np.array(keys, np.int64)[x.doc_of(at)])
        at, place = at[hit], self.place[like[hit]]
        if not len(at):
            return none
        # Windows that go on side by side are compared together, a word once.
        fresh = np.append(True, (np.diff(at) != 1) | (np.diff(place) != 1))
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(at))) + self.window - 1
        begin = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(begin, size)
        differs = np.append(0, np.cumsum(codes[np.repeat(at[first], size) + step] != self.said[np.repeat(place[first], size) + step]))
        run = np.cumsum(fresh) - 1
        here = begin[run] + at - at[first][run]
        return covered(at[differs[here + self.window] == differs[here]], self.window, len(x.w))


def _ranges(inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked words, cut where texts begin: first word, one past the last, runs of each text."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[first] = True
    begins = np.flatnonzero(inside & (np.append(True, ~inside[:-1])[: len(inside)] | edge[:-1]))
    ends = np.flatnonzero(inside & (np.append(~inside[1:], True)[: len(inside)] | edge[1:])) + 1
    return begins, ends, np.diff(np.searchsorted(begins, first))


def _scan(stream: DataFrame, window: int, gram: int) -> DataFrame:
    """Goes along rows sorted by shard, part and step: a shard's passages, then the texts to look through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            place = list(zip(rows(batch, "shard").to_pylist(), rows(batch, "part").to_pylist(), rows(batch, "step").to_pylist(), strict=True))
            lo = 0
            while lo < len(place):
                hi = lo + 1
                while hi < len(place) and place[hi] == place[lo]:
                    hi += 1
                some, step = batch.slice(lo, hi - lo), place[lo][2]
                if place[lo][:2] != at:
                    at, shard = place[lo][:2], Shard(window, gram)
                ids = rows(some, "id")
                for a, b, buf, offsets in texts_of(rows(some, "said")):
                    x = Windows(buf, offsets, window, gram)
                    keys = ids.slice(a, b - a).to_pylist()
                    if step == 0:
                        shard.read(x, keys)
                        continue
                    if shard.automaton is None:
                        shard.compile()
                    begins, ends, per = _ranges(shard.spans(x, keys), x.w.first)
                    base = np.repeat(x.w.first[:-1], per)
                    leads, alone = (rows(some, c).slice(a, b - a) for c in ("leads", "alone"))
                    said = rows(some, "said").take(pa.array(np.arange(a, b), mask=~leads.to_numpy(zero_copy_only=False)))
                    made = [ids.slice(a, b - a), rows(some, "same").slice(a, b - a), lists((begins - base).astype(np.int32), per), lists((ends - base).astype(np.int32), per), said]
                    out = pa.RecordBatch.from_arrays(made, names=["id", "same", "begins", "ends", "said"])
                    # Of a text in several shards one gives the text, whether or not it finds anything.
                    yield out.filter(pc.or_(pa.array(per > 0), pc.and_not(leads, alone)))
                lo = hi

    return stream.mapInArrow(run, f"id {stream.schema['id'].dataType.simpleString()}, same long, begins array<int>, ends array<int>, said binary")


def repeated(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, gram: int = 12, shards: int | None = None, task_bytes: int = 32 << 20) -> DataFrame:
    """(id, same, begins, ends, said): runs of removed words (first, one past the last) of each text that loses any,
    possibly in several rows, one of which has the text; same is the XXH64 of the text. Keys are integers."""
    kind = df.schema[key].dataType.simpleString()
    docs = df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("id"), utf8(F.col(f"`{text}`")).alias("said"))
    anchors = written(_anchors(docs, kind, window, gram), "anchors")
    counted = anchors.groupBy("phrase").agg(F.min("id").alias("least"), F.max("id").alias("last"), (F.min("passage") == F.max("passage")).alias("alone"), F.count(F.lit(1)).alias("n"))
    counted = written(counted.where("least < last").select("phrase", "least", "alone", "n"), "counted")
    again = written(hot_join(anchors, counted, "phrase", "n"), "recurring")
    if shards is None:
        # An automaton of some 40,000 phrases, and their passages: a hundred MB or so.
        shards = max(1, -(-counted.count() // 40_000))
    shard = F.pmod(F.xxhash64("least"), F.lit(shards)).cast("int")

    # Passages of phrases that have several: their windows, one by one.
    apart = again.where(~F.col("alone")).groupBy("phrase", "passage").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.min("least").alias("least"))
    listed = apart.groupBy("id").agg(F.collect_list(F.struct("passage", "last", "least")).alias("wanted"))
    single = _single_windows(docs.join(listed, "id"), kind, window, gram)
    single = single.groupBy("phrase", "whole").agg(F.min("id").alias("id"), F.max("last").alias("last"), F.min("least").alias("least")).where("id < last")

    # What each shard is to have of a text.
    none = F.lit(None).cast("long")
    owned = again.where(F.col("alone") & (F.col("id") == F.col("least"))).select("id", shard.alias("shard"), "phrase", none.alias("whole"))
    owned = owned.unionByName(single.select("id", shard.alias("shard"), none.alias("phrase"), "whole"))
    owned = owned.groupBy("id", "shard").agg(F.collect_set("phrase").alias("phrases"), F.collect_set("whole").alias("wholes"))
    owned = owned.groupBy("id").agg(F.collect_list(F.struct("shard", "phrases", "wholes")).alias("wanted"))
    passages = _passages(docs.join(owned, "id"), kind, window, gram)

    routes = again.where("id > least").groupBy("id").agg(F.collect_set(shard).alias("shards"), F.max("size").alias("size"))
    seekers = written(routes.select("id", "size", F.explode("shards").alias("shard"), F.array_min("shards").alias("lead"), (F.size("shards") == 1).alias("alone")), "seekers")
    # A shard's texts in parts of task_bytes or so.
    parts = written(seekers.groupBy("shard").agg(F.ceil(F.sum(F.col("size") + 64) / task_bytes).cast("int").alias("parts")), "parts")
    spread = parts.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    zero = passages.join(spread, "shard").select("shard", "part", F.lit(0).alias("step"), "id", F.lit(None).cast("long").alias("same"), "said", *(F.lit(None).cast("boolean").alias(c) for c in ("leads", "alone")))
    seek = seekers.join(parts, "shard").select("id", "shard", (F.col("shard") == F.col("lead")).alias("leads"), "alone", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    one = docs.join(seek, "id").select("shard", "part", F.lit(1).alias("step"), "id", F.xxhash64("said").alias("same"), "said", "leads", "alone")
    # Twice the parts, so that few tasks get two; a given number isn't coalesced.
    tasks = 2 * (parts.agg(F.sum("parts")).first()[0] or 1)
    return _scan(zero.unionByName(one).repartition(min(tasks, 16_384), "shard", "part").sortWithinPartitions("shard", "part", "step"), window, gram)


RESULT = "n_words long, n_removed long, kept_sha256 string"


def digest(df: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and RESULT of rows with said (bytes) and begins, ends (runs of words removed, or null)."""
    names = [*keep, *(x.split()[0] for x in RESULT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha = [], [], []
            for said, begins, ends in zip(*(rows(batch, c).to_pylist() for c in ("said", "begins", "ends")), strict=True):
                tokens = said.split()
                n.append(len(tokens))
                for a, b in sorted(zip(begins or (), ends or (), strict=True), reverse=True):
                    tokens[a:b] = [None] * (b - a)
                if begins:
                    tokens = [t for t in tokens if t is not None]
                gone.append(n[-1] - len(tokens))
                sha.append(hashlib.sha256(b" ".join(tokens)).hexdigest())
            yield pa.RecordBatch.from_arrays([*(rows(batch, c) for c in keep), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=names)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, "said", "begins", "ends").mapInArrow(run, f"{kinds}, {RESULT}")


def _gathered(spans: DataFrame) -> DataFrame:
    """One row for each text that loses words: a text is in a few shards at most."""
    every = spans.groupBy("id", "same").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"), F.max("said").alias("said"))
    return every.where(F.size("begins") > 0)


def kept_digests(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Columns key, n_words, n_removed, kept_sha256. Texts that lose words come along with their spans; the others'
    words are digested where they are read. Only digests are joined."""
    spans = written(repeated(df, key, text, **options), "spans")
    docs = df.select(F.col(f"`{key}`").alias("id"), utf8(F.col(f"`{text}`")).alias("said")).withColumn("same", F.xxhash64("said"))
    empty = F.lit(None).cast("array<int>")
    plain = digest(docs.select("id", "same", "said", empty.alias("begins"), empty.alias("ends")), ["id", "same"])
    cut = digest(_gathered(spans), ["id", "same"])
    cut = cut.select(F.col("id").alias("id2"), F.col("same").alias("same2"), F.col("n_removed").alias("n2"), F.col("kept_sha256").alias("sha2"))
    both = plain.join(cut, F.col("id").eqNullSafe(F.col("id2")) & (F.col("same") == F.col("same2")), "left")
    return both.select(F.col("id").alias(key), "n_words", F.coalesce("n2", "n_removed").alias("n_removed"), F.coalesce("sha2", "kept_sha256").alias("kept_sha256"))


def cut_texts(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """df with the removed words cut out of the text, each with the white space behind it; other texts stay as they are."""
    spans = written(repeated(df, key, text, **options), "spans")
    gathered = _gathered(spans).drop("said").withColumnsRenamed({"id": "__id", "same": "__same", "begins": "__begins", "ends": "__ends"})
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for said, begins, ends in zip(*(rows(batch, c).to_pylist() for c in (text, "__begins", "__ends")), strict=True):
                if begins:
                    raw = said.encode()
                    buf = np.frombuffer(raw, np.uint8)
                    w = words(buf, np.array([0, len(buf)]), PLAIN)
                    inside = np.zeros(len(w) + 1, bool)
                    for a, b in zip(begins, ends, strict=True):
                        inside[a:b] = True
                    starts = np.append(w.starts, len(raw)).tolist()
                    keep = [raw[: starts[0]]]
                    for k in np.flatnonzero(~inside[:-1]).tolist():
                        keep.append(raw[starts[k] : starts[k + 1]])
                    said = b"".join(keep).decode()
                out.append(said)
            columns = [pa.array(out, pa.string()) if f.name == text else rows(batch, f.name) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    same = F.xxhash64(utf8(F.col(f"`{text}`")))
    joined = df.withColumn("__hash", same).join(gathered, (F.col(f"`{key}`") == F.col("__id")) & (F.col("__hash") == F.col("__same")), "left")
    return joined.select(*(f"`{c}`" for c in df.columns), "__begins", "__ends").mapInArrow(run, schema)
