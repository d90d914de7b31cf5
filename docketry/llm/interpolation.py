"""Language-model scores by deleted interpolation.

P(w | v) = a2 c(v w) / c(v) + a1 c(w) / N + a0 / (V + 1): maximum-likelihood estimates of a bigram and a unigram and a
uniform share, over tokens that are lower-cased (A-Z) words and one end a text. The weights depend on how often
the context v was seen, in buckets of powers of two. They are learned by expectation-maximisation: a tenth of
the training texts is held out, the estimates are counted on the others, and the weights maximise the
probability of the held-out counts. Scores then use the counts of all training texts.

All texts are turned once into blocks of some MB: sorted 64-bit hashes of distinct tokens, and the texts as places
in them. Counting is by request and reply: a block sends its distinct keys with its own counts to buckets of the key
range, a bucket adds up what all blocks have of a key, and answers each block in the order of its keys. So a token
that is everywhere is one entry for a block, buckets are of bounded size (their number follows the input), and
each key moves once. Only weights, sums and one number a context bucket come to the driver. Tokens, and pairs of them, are told
apart by their 64-bit hashes alone.

Null text is taken as empty: one end. Without training texts the scores are those of the uniform share and
the base's smoothing alone; without held-out ones the weights stay as they began. Repeated rows and null keys are
rows as any other; an empty input gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.frames import lists, rows, trim, utf8, written
from docketry.llm.words import PLAIN, mix, texts_of, words

END, BEGIN = np.uint64(0x0E0D0E0D0E0D0E0D), np.uint64(0x0B0E0B0E0B0E0B0E)
#: Folds of texts: counted, held out for the weights (but counted in the end), not learned from.
COUNTED, TUNING, APART = 0, 1, 2
BUCKETS = 24
#: Keys a bucket of the key range is meant to hold.
BUCKET_KEYS = 1 << 20


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, not below 0, in as few bytes as the largest needs, by planes, compressed."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    wide = 1 if width == 1 else 4 if width <= 4 else 8
    planes = x.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide)[:, :width].T
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(planes), 1)


def unpacked(data: bytes) -> np.ndarray:
    """The numbers, in one, four or eight bytes each."""
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    wide = 1 if data[0] == 1 else 4 if data[0] <= 4 else 8
    out = np.zeros((planes.shape[1], wide), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view(f"<u{wide}").reshape(-1)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct keys, as steps."""
    steps = np.diff(keys, prepend=np.uint64(0))
    x = steps.astype("<u8")
    width = max(1, (int(x[1:].max()).bit_length() + 7) // 8) if len(x) > 1 else 1
    head = keys[:1].astype("<u8").tobytes()
    return bytes([width]) + head + np.ascontiguousarray(x[1:].view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    width, head = data[0], data[1:9]
    if not head:
        return np.zeros(0, np.uint64)
    rest = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(rest) + 1, 8), np.uint8)
    out[0] = np.frombuffer(head, np.uint8)
    out[1:, :width] = rest
    return np.cumsum(out.view("<u8").reshape(-1), dtype=np.uint64)


class Block:
    """Texts as places in a sorted table of distinct tokens."""

    def __init__(self, vocab: np.ndarray, tokens: np.ndarray, first: np.ndarray, folds: np.ndarray):
        self.vocab, self.tokens, self.first, self.folds = vocab, tokens, first, folds

    def fold_of_tokens(self) -> np.ndarray:
        return np.repeat(self.folds, np.diff(self.first))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys of (context, token), a context (len(vocab): a text's beginning) and a token of each, and
        each place's key."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.first[:-1]] = len(self.vocab)
        h = np.append(self.vocab, BEGIN)
        keys = mix(h[before] * np.uint64(0x9E3779B97F4A7C15) + h[self.tokens])
        distinct, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        return distinct, before[at], self.tokens[at], inverse


def _blocks(docs: DataFrame, kind: str, block_bytes: int) -> DataFrame:
    def made(parts: list, ids: list, folds: list) -> pa.RecordBatch:
        tokens = np.concatenate([p[0] for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        vocab, places = np.unique(tokens, return_inverse=True)
        fold = np.concatenate(folds).astype(np.uint8)
        learned = fold != APART
        keys = pa.chunked_array(ids).combine_chunks()
        one = [
            pa.array([uuid.uuid4().hex]), lists(keys, [len(keys)]), pa.array([fold.tobytes()], pa.binary()), pa.array([packed(counts)], pa.binary()), pa.array([packed_keys(vocab)], pa.binary()),
            pa.array([packed(places)], pa.binary()), pa.array([len(vocab)], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([int(counts[learned].sum())], pa.int64()), pa.array([int(counts[fold == TUNING].sum())], pa.int64()),
            pa.array([int(learned.sum())], pa.int64()), pa.array([int((fold == TUNING).sum())], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(one, names=["block", "ids", "folds", "counts", "vocab", "tokens", "n_vocab", "n_tokens", "learned", "tuned", "learned_texts", "tuned_texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ids, folds, size = [], [], [], 0
        for batch in batches:
            fold = rows(batch, "fold").to_numpy(zero_copy_only=False)
            for lo, hi, buf, offsets in texts_of(rows(batch, "said")):
                w = words(buf, offsets, PLAIN)
                h = w.hashes(lower=True)
                docs = hi - lo
                counts = w.counts() + 1
                tokens = np.full(len(h) + docs, END, np.uint64)
                tokens[np.arange(len(h)) + np.repeat(np.arange(docs), counts - 1)] = h
                parts.append((tokens, counts))
                ids.append(rows(batch, "id").slice(lo, docs))
                folds.append(fold[lo:hi])
                size += len(buf) + 8 * docs
                if size >= block_bytes:
                    yield made(parts, ids, folds)
                    parts, ids, folds, size = [], [], [], 0
        if parts:
            yield made(parts, ids, folds)
        parts, ids, folds = [], [], []
        trim()

    return docs.mapInArrow(run, f"block string, ids array<{kind}>, folds binary, counts binary, vocab binary, tokens binary, n_vocab long, n_tokens long, learned long, tuned long, learned_texts long, tuned_texts long")


def _block(folds: bytes, counts: bytes, vocab: bytes, tokens: bytes) -> Block:
    return Block(unpacked_keys(vocab), unpacked(tokens).astype(np.int64), np.append(0, np.cumsum(unpacked(counts).astype(np.int64))), np.frombuffer(folds, np.uint8))


_BLOCK = ("folds", "counts", "vocab", "tokens")


def _counts(blocks: DataFrame, pairs: bool, buckets: int) -> DataFrame:
    """(block, pairs, bucket, learned, tuned, types): for each block and bucket of the key range the counts over all
    training texts, and over the held-out ones, of the block's keys there in order; types: the bucket's keys
    with a count."""
    shift = np.uint64(64 - max(1, (buckets - 1).bit_length()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                b = _block(*(rows(one, c)[0].as_py() for c in _BLOCK))
                keys, at = (b.pairs()[0], b.pairs()[3]) if pairs else (b.vocab, b.tokens)
                fold = b.fold_of_tokens()
                learned = np.bincount(at[fold != APART], minlength=len(keys))
                tuned = np.bincount(at[fold == TUNING], minlength=len(keys))
                # Only buckets that the block has keys of: at most a message a key, however many buckets there are.
                bucket = (keys >> shift).astype(np.int64)
                begins = np.flatnonzero(np.append(True, np.diff(bucket) != 0)[: len(bucket)])
                ends, full = np.append(begins[1:], len(bucket))[: len(begins)].tolist(), bucket[begins].tolist()
                parts = [[f(x[a:b]) for a, b in zip(begins.tolist(), ends, strict=True)] for f, x in ((packed_keys, keys), (packed, learned), (packed, tuned))]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([rows(one, "block")[0].as_py()] * len(full), pa.string()), *(pa.array(p, pa.binary()) for p in parts)], names=["bucket", "block", "keys", "learned", "tuned"])

    def answer(group: pa.Table) -> pa.Table:
        keys = [unpacked_keys(x) for x in group["keys"].to_pylist()]
        flat = np.concatenate(keys)
        distinct, at = np.unique(flat, return_inverse=True)
        sums = [np.bincount(at, np.concatenate([unpacked(x) for x in group[c].to_pylist()]).astype(float), len(distinct)).astype(np.int64) for c in ("learned", "tuned")]
        cuts = np.append(0, np.cumsum([len(k) for k in keys])).tolist()
        parts = [[packed(s[at[cuts[i] : cuts[i + 1]]]) for i in range(len(keys))] for s in sums]
        types, counted = int((sums[0] > 0).sum()), int((sums[0] > sums[1]).sum())
        del flat, distinct, at
        trim()
        return pa.table({"block": group["block"], "pairs": pa.array([pairs] * len(keys)), "bucket": group["bucket"], "learned": pa.array(parts[0], pa.binary()), "tuned": pa.array(parts[1], pa.binary()), "types": pa.array([types] * len(keys), pa.int64()), "types_counted": pa.array([counted] * len(keys), pa.int64())})

    asked = blocks.select("block", *_BLOCK).mapInArrow(ask, "bucket int, block string, keys binary, learned binary, tuned binary")
    return asked.groupBy("bucket").applyInArrow(answer, "block string, pairs boolean, bucket int, learned binary, tuned binary, types long, types_counted long")


class _Sides:
    """A block with the corpus's counts of its tokens and pairs."""

    def __init__(self, group: pa.Table):
        cols = {c: group[c].to_pylist() for c in ("pairs", "bucket", "learned", "tuned", *_BLOCK, "ids")}
        own = next(i for i, p in enumerate(cols["pairs"]) if p is None)
        self.b = _block(*(cols[c][own] for c in _BLOCK))
        self.ids = group["ids"].combine_chunks()[own].values
        told = {}
        for kind in (False, True):
            order = sorted((i for i, p in enumerate(cols["pairs"]) if p is kind), key=lambda i: cols["bucket"][i])
            told[kind] = [np.concatenate([unpacked(cols[c][i]) for i in order]).astype(np.int64) for c in ("learned", "tuned")]
        self.one, self.one_tuned = told[False]
        self.two, self.two_tuned = told[True]


def _bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for a context never seen, then by powers of two."""
    return np.minimum(np.frexp(count.astype(float))[1], BUCKETS - 1)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def mixture(p2: np.ndarray, p1: np.ndarray, p0: float, weights: np.ndarray) -> np.ndarray:
    """weights: a row (a2, a1, a0) for each entry."""
    return weights[:, 0] * p2 + weights[:, 1] * p1 + weights[:, 2] * p0


def shares(bucket: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected counts (buckets, 3) of the mixture's parts for n occurrences each."""
    mine = weights[bucket]
    total = mixture(p2, p1, p0, mine)
    parts = [mine[:, 0] * p2, mine[:, 1] * p1, mine[:, 2] * p0]
    return np.stack([np.bincount(bucket, n * x / total, BUCKETS) for x in parts], axis=1)


def learn_weights(tuning: DataFrame, p0: float, rounds: int) -> np.ndarray:
    weights = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    for _ in range(rounds):
        now = weights

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((BUCKETS, 3))
            for batch in batches:
                for b, p2, p1, n in zip(*(rows(batch, c).to_pylist() for c in ("b", "p2", "p1", "n")), strict=True):
                    total += shares(np.frombuffer(b, np.uint8).astype(np.int64), np.frombuffer(p2, np.float32).astype(float), np.frombuffer(p1, np.float32).astype(float), p0, unpacked(n).astype(float), now)
            yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS), pa.int32()), *(pa.array(total[:, k].copy()) for k in range(3))], names=["b", "x2", "x1", "x0"])

        sums = tuning.mapInArrow(expect, "b int, x2 double, x1 double, x0 double").groupBy("b").agg(*(F.sum(c).alias(c) for c in ("x2", "x1", "x0"))).collect()  # BUCKETS rows
        weights = weights.copy()
        for r in sums:
            if (total := r.x2 + r.x1 + r.x0) > 0:
                weights[r.b] = [r.x2 / total, r.x1 / total, r.x0 / total]
    return weights


RESULT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(df: DataFrame, training: Column, tuning: Column, key: str = "doc_id", text: str = "text", rounds: int = 8, block_bytes: int = 8 << 20) -> DataFrame:
    """Columns key, RESULT. training: whether a row is learned from; tuning: whether, of those, it is held out for the weights."""
    kind = df.schema[key].dataType.simpleString()
    fold = F.when(~training, F.lit(APART)).when(tuning, F.lit(TUNING)).otherwise(F.lit(COUNTED)).cast("int")
    blocks = written(_blocks(df.select(F.col(f"`{key}`").alias("id"), utf8(F.col(f"`{text}`")).alias("said"), fold.alias("fold")), kind, block_bytes), "blocks")
    r = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_vocab", "n_tokens", "learned", "tuned", "learned_texts", "tuned_texts"))).first()
    counted = written(_counts(blocks, False, -(-r.n_vocab // BUCKET_KEYS)).unionByName(_counts(blocks, True, -(-r.n_tokens // BUCKET_KEYS))), "counts")
    v = counted.where(~F.col("pairs")).groupBy("bucket").agg(F.max("types").alias("t"), F.max("types_counted").alias("u")).agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.coalesce(F.sum("u"), F.lit(0)).alias("u")).first()
    n, types, texts = r.learned, v.t, r.learned_texts
    n_counted, texts_counted = n - r.tuned, texts - r.tuned_texts
    both = counted.select("block", "pairs", "bucket", "learned", "tuned").unionByName(blocks.select("block", "ids", *_BLOCK), allowMissingColumns=True)

    def tune(group: pa.Table) -> pa.Table:
        s = _Sides(group)
        _, before, token, inverse = s.b.pairs()
        times = np.bincount(inverse[s.b.fold_of_tokens() == TUNING], minlength=len(token))
        use = np.flatnonzero(times)
        context = np.append(s.one - s.one_tuned, texts_counted)[before[use]]
        p2, p1 = _ratio((s.two - s.two_tuned)[use], context), _ratio((s.one - s.one_tuned)[token[use]], np.full(len(use), n_counted))
        columns = [_bucket_of(context).astype(np.uint8).tobytes(), p2.astype(np.float32).tobytes(), p1.astype(np.float32).tobytes(), packed(times[use])]
        return pa.table({c: pa.array([x], pa.binary()) for c, x in zip(("b", "p2", "p1", "n"), columns, strict=True)})

    table = written(both.groupBy("block").applyInArrow(tune, "b binary, p2 binary, p1 binary, n binary"), "tuning")
    weights = learn_weights(table, 1 / (v.u + 1), rounds)

    def rate(group: pa.Table) -> pa.Table:
        s = _Sides(group)
        _, before, token, inverse = s.b.pairs()
        context = np.append(s.one, texts)[before]
        p = mixture(_ratio(s.two, context), s.one[token] / max(n, 1), 1 / (types + 1), weights[_bucket_of(context)])
        base = np.log10((s.one + 0.1) / (n + 0.1 * (types + 1)))
        first = s.b.first[:-1]
        out = {key: s.ids, "n_tokens": np.diff(s.b.first), "n_known": np.add.reduceat((s.one > 0).astype(np.int64)[s.b.tokens], first), "train_tokens": np.full(len(first), n, np.int64)}
        out |= {"base_score": np.add.reduceat(base[s.b.tokens], first), "score": np.add.reduceat(np.log10(p)[inverse], first)}
        del s, p, base, inverse
        trim()
        return pa.table(out)

    return both.groupBy("block").applyInArrow(rate, f"`{key}` {kind}, {RESULT}")
