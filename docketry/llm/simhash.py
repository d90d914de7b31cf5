"""Near duplicates by SimHash and a hierarchical index in Gray order.

A document's words are lower-cased (A-Z) and joined to shingles of ``shingle`` words, repeats
included; of fewer words the whole sequence is the one shingle. A bit of the fingerprint is set if
more than half of the shingles' XXH64 have it. Fingerprints that differ in at most ``most`` bits link.

The 64 bits are cut into some blocks; fingerprints that differ in ``most`` bits at most agree in all but ``most``
blocks. So for each choice of blocks to agree in, fingerprints are dealt by their bits there, and no other ones are
ever brought together: what is searched grows with the input, not with its square. There are more and shorter choices
the more fingerprints there are (``choices``).

What is dealt together is sorted by Gray rank, so that neighbours share many bits. The index is a tree: a node holds the
bits that all fingerprints below it share and that no node above it holds yet, as (mask, value). Two nodes are searched
together: their differences in bits that both know are added up on the way down, and the pair of groups is
dropped once the sum is beyond ``most``; it is linked as a whole once the bits that are still open can't bring the sum
beyond ``most``; and it is passed over if what was linked before joins it already. The search gives a spanning forest
of its links, not the links; components come from the forests.

A choice's fingerprints with equal bits may be many (copies with small changes). Beyond ``2 * shard`` they are split
into pieces and the pieces are searched two by two, each pair a task of its own.

Null and empty texts have no words: fingerprint zero, linked like any other. Copies share a
fingerprint and are one node. Rows that share a doc_id are one document for component_id. Columns of
the input other than the key and the text aren't looked at; an empty input gives an empty result.
"""

from __future__ import annotations

from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.components import components
from docketry.llm.frames import hot_join, mapped, rows, utf8, written

_LANES = np.array([sum(((v >> j) & 1) << (8 * j) for j in range(8)) for v in range(256)], np.uint64)


def bit_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of h[first[d] : first[d + 1]] have each bit, (d, 64); every run has an element."""
    runs = [np.arange(a, b, 255) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    cuts = np.concatenate(runs)
    octets = h.view(np.uint8).reshape(-1, 8)
    lanes = np.stack([np.add.reduceat(_LANES[octets[:, k]], cuts) for k in range(8)], axis=1)
    counts = np.ascontiguousarray(lanes).view(np.uint8).reshape(len(cuts), 64).astype(np.int64)
    return np.add.reduceat(counts, np.append(0, np.cumsum([len(r) for r in runs])[:-1]), axis=0)


def fingerprint_batch(texts: list[bytes], shingle: int, seed: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    first, full = [0], []
    for i, text in enumerate(texts):
        tokens = text.lower().split()
        if not tokens:
            continue
        full.append(i)
        line = b" ".join(tokens)
        if len(tokens) <= shingle:
            hashes.append(digest(line, seed))
        else:
            gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
            begins, ends = np.append(0, gaps + 1), np.append(gaps, len(line))
            hashes += [digest(line[a:b], seed) for a, b in zip(begins[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
        first.append(len(hashes))
    out = np.zeros(len(texts), np.uint64)
    if full:
        bounds = np.array(first)
        set_bits = 2 * bit_counts(np.array(hashes, np.uint64), bounds) > np.diff(bounds)[:, None]
        out[full] = np.packbits(set_bits.astype(np.uint8), axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """Columns key and fp, the fingerprint's 64 bits as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows(batch, "__text")
        parts = [fingerprint_batch(texts.slice(lo, 256).to_pylist(), shingle, seed) for lo in range(0, len(texts), 256)]
        return pa.RecordBatch.from_arrays([rows(batch, "__key"), pa.array(np.concatenate(parts).view(np.int64))], names=[key, "fp"])

    return mapped(df.select(F.col(f"`{key}`").alias("__key"), utf8(F.col(f"`{text}`")).alias("__text")), run, f"`{key}` {df.schema[key].dataType.simpleString()}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def blocks(count: int) -> list[int]:
    """Masks of 64 bits cut into ``count`` blocks of nearly equal length."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [sum(1 << b for b in range(x, y)) for x, y in pairwise(cuts)]


def choices(n: int, most: int, shard: int) -> list[int]:
    """Masks of the blocks to agree in, so that fingerprints at most ``most`` bits apart agree in one mask at least.
    Of n fingerprints some ``shard`` are meant to agree in a mask, but blocks are at most three more than ``most``."""
    count = most + 1
    while count < min(64, most + 3) and n >> (64 // count * (count - most)) > shard:
        count += 1
    parts = blocks(count)
    return [sum(some) for some in combinations(parts, count - most)]


FANOUT = 4


class GrayTree:
    """levels[0] are the fingerprints in Gray order, levels[i] every FANOUT nodes of levels[i - 1] as one.

    A level is (mask, value): the bits that a node's fingerprints share, without those its parent has.
    """

    def __init__(self, fps: np.ndarray, agree: int = 0):
        self.fps = fps[np.lexsort((gray_rank(fps), fps & np.uint64(agree)))]
        both, either, shared = self.fps, self.fps, []
        while True:
            shared.append((~(both ^ either), both))
            if len(both) <= FANOUT:
                break
            cuts = np.arange(0, len(both), FANOUT)
            both, either = np.bitwise_and.reduceat(both, cuts), np.bitwise_or.reduceat(either, cuts)
        self.levels = []
        for i, (mask, value) in enumerate(shared):
            own = mask if i + 1 == len(shared) else mask & ~shared[i + 1][0][np.arange(len(mask)) // FANOUT]
            self.levels.append((own, value & mask, mask))
        self._fours = np.append(self.fps, np.repeat(self.fps[-1:], -len(self.fps) % FANOUT)).reshape(-1, FANOUT)

    def below(self, at: int) -> np.ndarray:
        """The fingerprints below each node of level 0 or 1; the last node's are repeated to fill it."""
        return self._fours if at and len(self.levels) > 1 else self.fps[:, None]


class Forest:
    """Components of growing links; keeps the links that joined two."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.grown = 0
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = np.flatnonzero(a != b)
            if not len(apart):
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            # Of the links of a root to smaller ones, one takes effect in this round.
            up, by = np.arange(len(self.root)), np.full(len(self.root), -1)
            by[np.maximum(a, b)] = np.arange(len(i))
            taken = np.flatnonzero(by >= 0)
            up[taken] = np.minimum(a, b)[by[taken]]
            self.links.append((i[by[taken]], j[by[taken]]))
            while not np.array_equal(above := up[up], up):
                up = above
            self.root = up[self.root]
            self.grown += 1


class Search:
    """Links fingerprints of tree a with those of tree b, or those of a with one another."""

    def __init__(self, a: GrayTree, b: GrayTree | None, most: int, agree: int = 0, piece: int = 1 << 13):
        self.a, self.b, self.same = a, a if b is None else b, b is None
        self.most, self.agree, self.piece = most, np.uint64(agree), piece
        self.every = a.fps if b is None else np.concatenate([a.fps, b.fps])
        self.shift = 0 if b is None else len(a.fps)
        self.forest = Forest(len(self.every))
        #: Pairs of nodes looked at.
        self.visited = 0
        self._seen = -1

    def _labels(self) -> None:
        """For each node the component of all below it, or one that no other node has."""
        if self._seen == self.forest.grown:
            return
        self._seen, self._label = self.forest.grown, {}
        for side, tree, shift in ((0, self.a, 0), *(() if self.same else ((1, self.b, self.shift),))):
            low = high = self.forest.root[shift : shift + len(tree.fps)]
            made = [low]
            for level in tree.levels[1:]:
                cuts = FANOUT * np.arange(len(level[0]))
                low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
                made.append(np.where(low == high, low, -1 - side))
            self._label[side] = made

    def _leaves(self, tree: GrayTree, at: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of i, fingerprint) of all fingerprints below the nodes i."""
        wide = FANOUT ** min(at, len(tree.levels) - 1)
        first = i * wide
        count = np.minimum(first + wide, len(tree.fps)) - first
        which = np.repeat(np.arange(len(i)), count)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]

    def run(self) -> Forest:
        a, b, same = self.a, self.b, self.same
        for step in (1, 2, 3, 4):
            # Neighbours of either tree, to begin with.
            for tree, shift in ((a, 0), *(() if same else ((b, self.shift),))):
                close = np.flatnonzero(np.bitwise_count(tree.fps[step:] ^ tree.fps[:-step]) <= self.most) + shift
                self.forest.add(close, close + step)
        # The trees may differ in height: the lower one's root stands for itself above.
        top = max(len(a.levels), len(b.levels)) - 1

        def level(t: GrayTree, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return t.levels[min(i, len(t.levels) - 1)]

        i, j = (x.reshape(-1).astype(np.int32) for x in np.meshgrid(np.arange(len(level(a, top)[0])), np.arange(len(level(b, top)[0])), indexing="ij"))
        if same:
            i, j = i[i <= j], j[i <= j]
        # Differences so far are kept with the pair; `known` are the bits they were counted in.
        stack = [(top, i, j, np.zeros(len(i), np.uint8), np.zeros(len(i), np.uint64))]
        while stack:
            at, i, j, d, known = stack.pop()
            if len(i) > self.piece:
                half = len(i) // 2
                stack.append((at, *(x[half:].copy() for x in (i, j, d, known))))
                stack.append((at, *(x[:half].copy() for x in (i, j, d, known))))
                continue
            self.visited += len(i)
            self._labels()
            la, lb = (self._label[0 if same or k == 0 else 1][min(at, len(t.levels) - 1)] for k, t in enumerate((a, b)))
            open_ = np.flatnonzero((la[i] != lb[j]) | (la[i] < 0))
            i, j, d, known = i[open_], j[open_], d[open_], known[open_]
            (_, va, ma), (_, vb, mb) = level(a, at), level(b, at)
            now = ma[i] & mb[j]
            off = (va[i] ^ vb[j]) & now
            d = d + np.bitwise_count(off & ~known)
            keep = np.flatnonzero((d <= self.most) & ((off & self.agree) == 0))
            i, j, d, known = i[keep], j[keep], d[keep], now[keep]
            if not len(i):
                continue
            if at <= 1:
                # What is left are fingerprints: all bits of each against each below the two nodes.
                off = np.bitwise_count(a.below(at)[i][:, :, None] ^ b.below(at)[j][:, None, :])
                k, x, y = np.nonzero(off <= self.most)
                i, j = i[k] * (FANOUT if at and len(a.levels) > 1 else 1) + x, j[k] * (FANOUT if at and len(b.levels) > 1 else 1) + y
                ok = (i < len(a.fps)) & (j < len(b.fps)) & ((i < j) if same else True)
                self.forest.add(i[ok], j[ok] + self.shift)
                continue
            whole = d + np.bitwise_count(~known) <= self.most
            if whole.any():
                wi, wj = i[whole].astype(np.int64), j[whole].astype(np.int64)
                (ka, leaf_a), (kb, leaf_b) = self._leaves(a, at, wi), self._leaves(b, at, wj)
                first_a, first_b = wi * FANOUT ** min(at, len(a.levels) - 1), wj * FANOUT ** min(at, len(b.levels) - 1)
                self.forest.add(np.concatenate([first_a[kb], leaf_a]), np.concatenate([leaf_b, first_b[ka]]) + self.shift)
                i, j, d, known = (x[~whole] for x in (i, j, d, known))
            steps_a = FANOUT if at < len(a.levels) else 1
            steps_b = FANOUT if at < len(b.levels) else 1
            da, db = (x.reshape(-1).astype(np.int32) for x in np.meshgrid(np.arange(steps_a), np.arange(steps_b), indexing="ij"))
            i = (i[:, None] * steps_a + da).reshape(-1)
            j = (j[:, None] * steps_b + db).reshape(-1)
            d, known = np.repeat(d, len(da)), np.repeat(known, len(da))
            ok = (i < len(level(a, at - 1)[0])) & (j < len(level(b, at - 1)[0]))
            if same:
                ok &= i <= j
            stack.append((at - 1, i[ok], j[ok], d[ok], known[ok]))
        return self.forest


def link_forest(a: np.ndarray, b: np.ndarray | None, most: int, agree: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within a, or between a and b, of fingerprints that agree in some bits, as two
    arrays of fingerprints. (Links of fingerprints that don't agree there may be among them.)"""
    search = Search(GrayTree(a, agree), None if b is None else GrayTree(b, agree), most, agree)
    made = search.run().links
    u, v = (np.concatenate([*(x[k] for x in made), np.zeros(0, np.int64)]).astype(np.int64) for k in (0, 1))
    return search.every[u], search.every[v]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, most: int = 4, shard: int = 1 << 14) -> DataFrame:
    """(u, v): links between the distinct fingerprints (column fp) that join all that are connected."""
    n = distinct.count()
    masks = choices(n, most, shard)
    per = max(1, -(-n // shard))
    # A row for each choice of blocks; a bucket is of one choice.
    agreed = F.explode(F.array(*(F.struct(F.lit(c).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for c, m in enumerate(masks))))
    dealt = distinct.select("fp", agreed.alias("x")).select("fp", "x.choice", (F.col("x.choice") * per + F.pmod(F.xxhash64("x.bits"), F.lit(per)).cast("int")).alias("bucket"))
    sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * shard)
    # A bucket of more than its share, by a large group, is searched in pairs of pieces. `shard` rows stand for one of these at least.
    parts = dealt.join(sizes.select("bucket", F.ceil(F.col("n") / shard).cast("int").alias("parts")), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    goes = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(F.col("mine"), q).alias("p"), F.greatest(F.col("mine"), q).alias("q")))
    spread = parts.withColumn("mine", mine).select("fp", "choice", "bucket", (F.col("parts") > 1).alias("cut"), "mine", F.explode(goes).alias("to")).select("fp", "choice", "bucket", "cut", "mine", "to.p", "to.q")

    def search(group: pa.Table) -> pa.Table:
        fps, at = group["fp"].to_numpy().view(np.uint64), group["mine"].to_numpy()
        p, q = group["p"][0].as_py(), group["q"][0].as_py()
        u, v = link_forest(np.sort(fps[at == p]), None if p == q else np.sort(fps[at == q]), most, masks[group["choice"][0].as_py()])
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    tasks = min(2 * len(masks) * per, 8192)
    return spread.repartition(tasks, "bucket", "p", "q").groupBy("bucket", "p", "q").applyInArrow(search, "u long, v long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, most: int = 4, shard: int = 1 << 14) -> DataFrame:
    """Columns key, fp (signed long) and component_id, the smallest key reachable by links."""
    docs = written(fingerprints(df, key, text, shingle).withColumnRenamed(key, "__key"), "fingerprints")
    first = written(docs.groupBy("fp").agg(F.min("__key").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    labels = written(components(links(first, most, shard)), "labels")
    joined = first.join(labels, first.fp == labels.node)
    groups = joined.groupBy("label").agg(F.min("first").alias("least"))
    named = labels.join(groups, "label").select(F.col("node").alias("fp"), "least")
    reach = first.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), "n")
    return hot_join(docs, written(reach, "reach"), "fp", "n").select(F.col("__key").alias(key), "fp", "component_id")
