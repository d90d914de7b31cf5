"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import components, frames, interpolation, licenses, pieces, ppm, queries, repeats, sharding, simhash, tiff, toxicity, winnow
from docketry.llm import words as wd

PLAIN = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "A é 日本 \x00x ﬁ"), (903, "A é 日本 \x00x ﬁ"), (904, "b" * 5000), (None, "no key"), (905, "word " * 30_000)]


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def made(seed, n, size, vocabulary=("a", "B", "b1", "é", "x", "Y2", "zz", "q", "the", "Mit")):
    r = random.Random(seed)
    return "".join(r.choice(vocabulary) + r.choice([" ", "\n", "  ", ", "]) for _ in range(r.randint(n, size)))


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


def key(x):
    return tuple(map(str, x))


def test_words_are_those_of_regular_expressions():
    import pyarrow as pa

    texts = [made(i, 0, 60) for i in range(40)] + [t or "" for _, t in ODD]
    seen = {}
    for lo, hi, buf, offsets in wd.texts_of(pa.array(texts), 700):
        for is_word, pattern in ((wd.PLAIN, PLAIN), (wd.ALNUM, None)):
            w = wd.words(buf, offsets, is_word)
            raw, h = buf.tobytes(), w.hashes(lower=False)
            for d in range(hi - lo):
                got = [raw[w.starts[i] : w.ends[i]] for i in range(w.first[d], w.first[d + 1])]
                want = pattern.findall(texts[lo + d].encode()) if pattern else [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", texts[lo + d])]
                assert got == want
                for word, x in zip(got, h[w.first[d] : w.first[d + 1]].tolist(), strict=True):
                    assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("w", [1, 2, 5, 9, 35])
def test_sliding_min(w):
    x = np.random.default_rng(1).integers(0, 1000, 200).astype(np.uint64)
    assert (wd.sliding_min(x, w) == [x[i : i + w].min() for i in range(200)]).all()


# op1


def test_tiff_round_trip_of_every_layout():
    r = random.Random(1)
    for data in [b"", b"a", b"aaaa" * 99, bytes(40_000), bytes(r.randrange(256) for _ in range(30_000)), b"abc" * 9000]:
        assert tiff.unlzw(tiff.lzw(data)) == data and tiff.unpackbits(tiff.packbits(data)) == data
    seen = set()
    for i in range(60):
        payload = tiff.padded(made(i, 0, 400).encode() * (i % 3 * 40 + 1))
        found = list(tiff.pages(tiff.write(payload)))
        assert b"".join(p.pixels for p in found) == payload
        seen |= {(p.compression, p.tiled) for p in found}
    assert {c for c, _ in seen} == {tiff.LZW, tiff.DEFLATE, tiff.PACKBITS} and {t for _, t in seen} == {True, False}


def test_tiff_of_the_other_byte_order_planar_and_sixteen_bits():
    import struct

    image = np.arange(24, dtype=">u2").reshape(3, 4, 2)
    planes = [np.ascontiguousarray(image[:, :, k]).tobytes() for k in range(2)]
    head = b"MM\0*" + struct.pack(">I", 8 + 48)
    fields = [(256, 3, 1, 4 << 16), (257, 3, 1, 3 << 16), (258, 3, 2, 16 << 16 | 16), (259, 3, 1, 1 << 16), (273, 4, 2, 56 + 2 + 9 * 12 + 4), (277, 3, 1, 2 << 16), (278, 3, 1, 3 << 16), (279, 4, 2, 56 + 2 + 9 * 12 + 12), (284, 3, 1, 2 << 16)]
    ifd = struct.pack(">H", 9) + b"".join(struct.pack(">HHII", *f) for f in fields) + struct.pack(">I", 0)
    media = head + planes[0] + planes[1] + ifd + struct.pack(">IIII", 8, 32, 24, 24)
    (page,) = tiff.pages(media)
    assert (page.width, page.height, page.samples, page.bits) == (4, 3, 2, 16)
    assert np.frombuffer(page.pixels, ">u2").reshape(3, 4, 2).tolist() == image.tolist()


def test_tiff_faults_give_rows(spark):
    good = tiff.write(tiff.padded(b"x" * 60_000))
    loop = bytearray(good)
    df = spark.createDataFrame([(1, None), (2, b""), (3, b"II*\0\x08\0\0\0"), (4, bytes(loop[: len(loop) // 2])), (5, good)], "doc_id int, media binary")
    rows = {}
    for r in tiff.read_tiff(df, ["doc_id"]).collect():
        rows.setdefault(r.doc_id, []).append(r.error)
    assert rows[1] == ["null"] and rows[2][-1] and rows[3][-1] and rows[4][-1] and set(rows[5]) == {None} and len(rows[5]) == 2


def one_page(**changed):
    """A file of one deflated 4 x 2 grey page, with fields changed."""
    import struct

    fields = {256: 4, 257: 2, 258: 8, 259: 8, 262: 1, 273: 8, 277: 1, 278: 2, 279: 0} | {int(k[1:]): v for k, v in changed.items()}
    body = zlib.compress(bytes(range(8)))
    fields[279] = len(body)
    ifd = struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", tag, 4, 1, v) for tag, v in sorted(fields.items())) + b"\0\0\0\0"
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + ifd


def test_tiff_sizes_of_zero_and_beyond_the_file_are_rows(spark):
    bombs = [one_page(), one_page(t278=0), one_page(t256=0), one_page(t277=0), one_page(t256=1 << 30, t257=1 << 20), one_page(t322=0, t323=16, t324=8, t325=8)]
    got = {r.i: r for r in tiff.read_tiff(spark.createDataFrame(list(enumerate(bombs)), "i int, media binary"), ["i"]).collect()}
    assert got[0].error is None and bytes(got[0].pixels) == bytes(range(8))
    assert all(got[i].error and got[i].pixels is None for i in range(1, 6))
    flood = zlib.compress(bytes(50_000_000))
    assert len(tiff._inflate(flood, 100)) == 100 and len(tiff.unlzw(tiff.lzw(bytes(300_000)), 100)) < 5000 and len(tiff.unpackbits(tiff.packbits(bytes(300_000)), 100)) < 300


def test_tiff_codecs_take_equal_shares():
    assert Counter(how for how, _, _ in tiff.LAYOUTS) == {tiff.DEFLATE: 4, tiff.PACKBITS: 4, tiff.LZW: 4} and len(set(tiff.LAYOUTS)) == 12


def test_op1(spark, tmp_path):
    docs = [(i, made(i, 0, 900)) for i in range(30)] + ODD
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((key((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in queries.op1_tiff_pages(spark, str(tmp_path)).collect()))
    want = []
    for i, t in docs:
        b = (t or "").encode()
        p = b.ljust(max(1, -(-len(b) // 192)) * 192, b" ")
        want.append(key((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))))
    assert got == sorted(want)


# op2


def brute_repeats(docs, window):
    owner, tokens = {}, []
    for i, t in docs:
        w = PLAIN.findall((t or "").encode())
        tokens.append((i, w))
        for k in range(len(w) - window + 1) if i is not None else ():
            s = tuple(w[k : k + window])
            owner[s] = min(i, owner.get(s, i))
    out = []
    for i, w in tokens:
        gone = {j for k in range(len(w) - window + 1) if i is not None and owner[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=key)


def repeating(seed):
    r = random.Random(seed)
    base = [made(seed * 100 + i, 60, 60).split() for i in range(6)]
    docs = []
    for i in range(90):
        text = []
        for _ in range(r.randint(0, 6)):
            b, a = r.choice(base), r.randint(0, 40)
            text += b[a : a + r.randint(5, 40)] if r.random() < 0.6 else made(r.random(), 0, 20).split()
        docs.append((i, r.choice([" ", "\n"]).join(text)))
    docs += [(200, docs[3][1]), (200, docs[4][1]), (200, docs[4][1]), (None, docs[5][1]), (201, None), (-5, docs[7][1]), (202, "")]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize(("window", "gram", "options"), [(10, 4, {}), (10, 4, {"task_bytes": 900, "shards": 5}), (8, 1, {"task_bytes": 2000, "shards": 2})])
def test_op2(spark, window, gram, options):
    docs = repeating(window + gram)
    got = sorted((tuple(r) for r in repeats.kept_digests(frame(spark, docs).repartition(3), window=window, gram=gram, **options).collect()), key=key)
    assert got == brute_repeats(docs, window)


def test_op2_cuts_text_and_keeps_columns(spark):
    docs = [(i, t) for i, t in repeating(4) if i not in (200, None)]
    df = frame(spark, docs).withColumn("same", F.lit(1)).withColumn("begins", F.lit("clash"))
    out = repeats.cut_texts(df, window=10, gram=4)
    assert out.columns == df.columns
    want = {i: h for i, _, _, h in brute_repeats(docs, 10)}
    texts = {r.doc_id: r.text for r in out.collect()}
    assert len(texts) == len(docs) and texts[201] is None
    assert all(hashlib.sha256(b" ".join(PLAIN.findall((t or "").encode()))).hexdigest() == want[i] for i, t in texts.items())
    untouched = {i for i, _, gone, _ in brute_repeats(docs, 10) if not gone}
    assert all(texts[i] == t for i, t in docs if i in untouched)


def test_op2_of_nothing(spark):
    assert repeats.kept_digests(frame(spark, [])).count() == 0


# op3


@pytest.mark.parametrize("broadcast_bytes", [1 << 25, 0])
def test_op3(spark, broadcast_bytes):
    r = random.Random(3)
    vocabulary = ("a", "B", "b1", "é", "x")
    items = [(i, made(i, n, n, vocabulary)) for i, n in enumerate([0, 1, 2, 3, 5, 7, 13, 14, 20, 40] * 2)] + [(3, "a b"), (77, None)]
    docs = [(i, made(i + 500, 0, 200, vocabulary)) for i in range(60)] + ODD[:5] + [(None, items[6][1]), (906, items[9][1].upper() + " k")]
    r.shuffle(docs)

    def words(s):
        return ALNUM.findall(lower(s))

    def brute(text):
        w, hit, found = words(text), set(), set()
        for i, t in items:
            iw = words(t)
            n = min(13, len(iw))
            for a in range(len(iw) - n + 1) if iw else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[a : a + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(i))
        return len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)

    df = winnow.decontaminate(frame(spark, docs).withColumn("n_hit", F.lit("clash")), frame(spark, items, "item_id int, text string"), ["doc_id", "n_hit"], broadcast_bytes=broadcast_bytes)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in df.collect()), key=key)
    assert got == sorted(((i, *brute(t)) for i, t in docs), key=key)


@pytest.mark.parametrize("broadcast_bytes", [1 << 25, 0])
def test_op3_one_word_items_in_adjacent_texts(spark, broadcast_bytes):
    texts = ["yes", "Yes", "", "YES", None, "no yes", "yEs no", "yeS", "no"]
    docs = frame(spark, list(enumerate(texts))).coalesce(1)
    got = winnow.decontaminate(docs, frame(spark, [(1, "yes")], "item_id int, text string"), ["doc_id"], broadcast_bytes=broadcast_bytes).collect()
    want = [(i, int("yes" in lower(t)), ["1"] if "yes" in lower(t) else []) for i, t in enumerate(texts)]
    assert sorted((r.doc_id, r.n_hit, r["items"]) for r in got) == want


def test_op3_of_nothing(spark):
    none = frame(spark, [], "item_id int, text string")
    assert [r.contaminated for r in winnow.decontaminate(frame(spark, [(1, "a b c")]), none, ["doc_id"]).collect()] == [False]
    assert winnow.decontaminate(frame(spark, []), none, ["doc_id"], broadcast_bytes=-1).count() == 0


# op4


def test_op4_base_and_mixture(spark):
    docs = [(i, made(i, 0, 80)) for i in range(120)] + ODD[:6]
    f = queries.remainder("doc_id", 10)
    got = interpolation.score(frame(spark, docs).repartition(4), f != 0, f == 1, block_bytes=2_000).collect()
    tokens = [(i, [w for w in PLAIN.findall((t or "").encode().lower())] + [None]) for i, t in docs]
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    c = Counter(w for i, t in tokens if fold(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for i, t in tokens)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_op4_score_is_the_mixture_learned_by_expectation_maximisation(spark):
    docs = [(i, made(i % 37, 0, 60)) for i in range(120)] + [(200, None), (201, ""), (202, "Only here"), (202, "Only here"), (203, " ".join(thue_morse(1024)))]
    df = frame(spark, docs).repartition(3)
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 4)) for r in interpolation.score(df, F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 == 1, rounds=6, block_bytes=1500).collect())
    tokens = [(i, [x.lower() for x in PLAIN.findall((t or "").encode())] + [None]) for i, t in docs]

    def counts(texts):
        one, two, context = Counter(), Counter(), Counter()
        for t in texts:
            one.update(t)
            two.update(zip(["begin", *t], t))
            context.update(["begin", *t[:-1]])
        return one, two, context

    def parts(model, v, w):
        one, two, _ = model
        # A context is counted wherever it stands, an end as the beginning of nothing.
        seen = model[2]["begin"] if v == "begin" else one[v]
        return min(seen.bit_length(), interpolation.BUCKETS - 1), (two[v, w] / seen if seen else 0.0), one[w] / max(1, sum(one.values())), 1 / (len(one) + 1)

    tuning = [t for i, t in tokens if i % 5 == 1]
    model = counts([t for i, t in tokens if i % 5 not in (0, 1)])
    weights = {b: [0.5, 0.4, 0.1] if b else [0.0, 0.8, 0.2] for b in range(interpolation.BUCKETS)}
    for _ in range(6):
        sums = {}
        for t in tuning:
            for v, w in zip(["begin", *t], t):
                b, *p = parts(model, v, w)
                mine = [x * y for x, y in zip(weights[b], p)]
                sums[b] = [x + y / sum(mine) for x, y in zip(sums.get(b, [0, 0, 0]), mine)]
        weights |= {b: [y / sum(x) for y in x] for b, x in sums.items()}
    model = counts([t for i, t in tokens if i % 5])
    one, n = model[0], sum(model[0].values())
    want = []
    for i, t in tokens:
        score = 0.0
        for v, w in zip(["begin", *t], t):
            b, *p = parts(model, v, w)
            score += math.log10(sum(x * y for x, y in zip(weights[b], p)))
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (len(one) + 1))) for w in t)
        want.append((i, len(t), sum(one[w] > 0 for w in t), n, round(base, 6), round(score, 4)))
    assert all(a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-5 and abs(a[5] - b[5]) < 2e-3 for a, b in zip(got, sorted(want), strict=True))


def test_op4_beats_the_base_where_words_go_in_pairs(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice(("red house", "blue tree", "old river", "big stone")) for _ in range(30))) for i in range(150)]
    f = queries.remainder("doc_id", 10)
    apart = [x for x in interpolation.score(frame(spark, docs), f != 0, f == 1).collect() if zlib.crc32(str(x.doc_id).encode()) % 10 == 0]
    assert apart and sum(x.score for x in apart) > 0.8 * sum(x.base_score for x in apart)


def test_op4_probabilities_add_up():
    """Over all words and the unknown the mixture is a distribution; EM never lowers the likelihood."""
    r = np.random.default_rng(0)
    counts = r.integers(0, 5, 20)
    p2, p1 = counts / counts.sum(), r.dirichlet(np.ones(20))
    weights = np.tile([0.5, 0.4, 0.1], (21, 1))
    p = interpolation.mixture(np.append(p2, 0), np.append(p1, 0), 1 / 21, weights)
    assert p.sum() == pytest.approx(1)
    bucket, n = r.integers(0, 3, 20), r.integers(1, 9, 20).astype(float)
    w, last = np.tile([0.5, 0.4, 0.1], (interpolation.BUCKETS, 1)), -np.inf
    for _ in range(6):
        now = (n * np.log(interpolation.mixture(p2, p1, 1 / 21, w[bucket]))).sum()
        assert now >= last - 1e-9
        last, x = now, interpolation.shares(bucket, p2, p1, 1 / 21, n, w)
        w = np.where(x.sum(1, keepdims=True) > 0, x / np.maximum(x.sum(1, keepdims=True), 1e-300), w)


def test_op4_packing():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2))
    for k in (keys, keys[:1], keys[:0]):
        assert (interpolation.unpacked_keys(interpolation.packed_keys(k)) == k).all()
        assert (interpolation.unpacked(interpolation.packed(k)) == k).all()


def test_op4_of_nothing(spark):
    assert interpolation.score(frame(spark, []), F.lit(True), F.lit(False)).count() == 0


# op5


def test_op5_is_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer())
    r = random.Random(5)
    parts = [" ", "▁", "a", "é", "\n", "日", "😀", "̀", "<", "0x", "s>", "  ", "\r", "ﬁ", "\x7f", "_", ".", ":", "²", "the", "Hello"]
    docs = ODD + [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for i in range(400)]
    got = {}
    for row in pieces.encode(frame(spark, docs), queries.tokenizer(), block_bytes=900).collect():
        got.setdefault(row.doc_id, []).append((row.n_tokens, list(row.ids), row.decoded))
    want = {}
    for i, t in docs:
        ids = sp.encode(t or "")
        want.setdefault(i, []).append((len(ids), ids, sp.decode(ids)))
    assert got == want
    hashes = {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in pieces.encode(frame(spark, docs), queries.tokenizer(), digests=True).collect()}
    assert hashes == {(i, hashlib.sha256(",".join(map(str, x[1])).encode()).hexdigest(), hashlib.sha256(x[2].encode()).hexdigest()) for i, xs in want.items() for x in xs}


def test_op5_chunks_of_one_hash_are_told_apart(spark, monkeypatch):
    one, other = thue_morse(1024)
    docs = [(1, one), (2, other), (3, one + " " + other), (4, "a b  c\n\nd")]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer())
    got = {r.doc_id: (list(r.ids), r.decoded) for r in pieces.encode(frame(spark, docs), queries.tokenizer()).collect()}
    assert got == {i: (sp.encode(t), sp.decode(sp.encode(t))) for i, t in docs}
    cut = pieces.cuts(open(queries.tokenizer(), "rb").read()).cut
    texts = [t.encode() for _, t in docs]
    want = pieces.chunks(texts, cut)
    monkeypatch.setattr(wd.Octets, "hashes", lambda self, starts, ends, seed=0: np.zeros(len(starts), np.uint64))
    said, place, first = pieces.chunks(texts, cut)
    assert [said[k] for k in place] == [want[0][k] for k in want[1]] and (first == want[2]).all()


def test_op5_ranks_pack_without_loss():
    r = np.random.default_rng(2)
    for x in (np.zeros(0, np.int32), np.array([254, 255, 256, 0]), r.integers(0, 400_000, 5_000), r.integers(0, 255, 100), r.integers(255, 70_000, 100)):
        assert (pieces.unpacked_ranks(pieces.packed_ranks(x)) == x).all()


def test_op5_of_nothing_and_clashing_columns(spark):
    assert pieces.encode(frame(spark, []), queries.tokenizer()).count() == 0
    df = frame(spark, [(1, "a b"), (1, "a b"), (2, None)]).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2))
    assert sorted((r.doc_id, r.n_tokens, r.decoded) for r in pieces.encode(df, queries.tokenizer()).collect()) == [(1, 2, "a b"), (1, 2, "a b"), (2, 0, "")]


# op6


def test_op6_learns_and_handles_edges(spark):
    bad = ("scum", "moron", "trash")
    r = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        text = [r.choice(("house", "tree", "river", "stone", "bird", "cloud")) for _ in range(30)] + ([r.choice(bad) for _ in range(3)] if toxic else [])
        docs.append((i, " ".join(text)))
        if i % 2 or i % 10 == 0:
            labels.append((i, int(i % 7 > 0), int(toxic)))
    labels += [(0, 1, 1), (5000, 1, 1), (3, None, 0)]
    chain = toxicity.learn(frame(spark, docs + ODD), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), queries.categories(), sample_rows=300)
    out = toxicity.score(frame(spark, docs + ODD).withColumn("rejected", F.lit("clash")), chain, ["doc_id", "rejected"]).collect()
    assert len(out) == 400 + len(ODD)
    assert all(r.rejected == (r.doc_id % 5 == 0) for r in out if r.doc_id is not None and r.doc_id < 400)
    assert not any(r.rejected for r in out if r.doc_id is None or r.doc_id >= 900)
    blank = toxicity.learn(frame(spark, docs), spark.createDataFrame([], "doc_id long, quality int, toxic int"), queries.categories())
    assert {r.p_toxic for r in toxicity.score(frame(spark, docs[:3]), blank, ["doc_id"]).collect()} == {0.5}


def test_op6_later_models_get_out_of_fold_odds():
    r = np.random.default_rng(0)
    row, name = np.repeat(np.arange(200), 5), r.integers(0, 40, 1000).astype(np.uint64)
    row, name = toxicity._unique(row, name)
    labels = r.integers(0, 2, (200, 2))
    chain = toxicity.Chain(["a", "b"]).fit(row, name, labels, np.arange(200) % 4, 20, 2)
    assert chain.models[1].v.shape == (1,) and abs(chain.models[1].v[0]) < 1.0


def test_op6_learns_from_12000_rows_in_little_memory():
    import inspect
    import tracemalloc

    assert inspect.signature(toxicity.learn).parameters["sample_rows"].default == 12_000
    r = np.random.default_rng(6)
    sets = [np.unique(r.zipf(1.3, 300).clip(0, 200_000)).astype(np.uint32) for _ in range(4_000)]
    row, name = np.repeat(np.arange(4_000), [len(x) for x in sets]), np.concatenate(sets)
    labels = np.column_stack([r.random(4_000) < 0.3, [len(x) % 3 == 0 for x in sets]]).astype(int)
    tracemalloc.start()
    chain = toxicity.Chain(["a", "b"]).fit(row, name, labels, np.arange(4_000) % 4, 2_048, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 35 * len(name)
    # What is selected is what whole sums over all entries select.
    for i, model in enumerate(chain.models):
        y = labels[:, i].astype(float)
        df, hit = np.bincount(name), np.bincount(name, y[row])
        keep = np.flatnonzero((df >= 4) & (df < 4_000))
        d, h, n, pos = df[keep], hit[keep], 4_000, y.sum()
        chi = n * (h * n - d * pos) ** 2 / (d * (n - d) * pos * (n - pos))
        assert model.names.tolist() == np.sort(keep[np.lexsort((keep, -chi))[:2_048]]).tolist()


# op7


def test_op7_code_lengths_are_those_of_the_trees():
    samples = {"x": [b"the cat sat on the mat", b"the hat"], "y": [b"der hund und die katze"], "z": [b""]}
    model = ppm.Model(samples)
    trees = {}
    for lang, texts in samples.items():
        tree = Counter()
        for t in texts:
            b = b"\n\n\n" + t
            for i in range(3, len(b)):
                for n in range(4):
                    tree[(b[i - n : i], b[i])] += 1
        trees[lang] = tree

    def cost(tree, context, byte):
        if context is None:
            return 8.0
        seen = {s: c for (ctx, s), c in tree.items() if ctx == context}
        rest = context[1:] if context else None
        if not seen:
            return cost(tree, rest, byte)
        total = sum(seen.values()) + len(seen)
        return -math.log2(seen[byte] / total) if byte in seen else -math.log2(len(seen) / total) + cost(tree, rest, byte)

    texts = [b"the cat", b"katze und hund", b"", b"\xff\x00 zq the", b"e"]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    got = model.lengths(buf, np.append(0, np.cumsum([len(t) for t in texts])))
    for t, row in zip(texts, got, strict=True):
        b = b"\n\n\n" + t
        for lang, x in zip(model.langs, row, strict=True):
            assert x == pytest.approx(sum(cost(trees[lang], b[i - 3 : i], b[i]) for i in range(3, len(b))))


def test_op7_edges(spark):
    docs = [(i, ("the house and the tree " if i % 2 else "das haus und der baum ") * 5, "en" if i % 2 else "de") for i in range(80)] + [(i, t, None) for i, t in ODD] + [(950, "123 !!", "en")]
    df = frame(spark, docs, "doc_id long, text string, lang string")
    model = ppm.learn(df, "doc_id", "text", "lang", queries.remainder("doc_id", 4) != 2, 20)
    got = {r.doc_id: r for r in ppm.predict(df, model).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and 0.9 < got[i].score <= 1 for i in range(80))
    assert {got[i].lang_pred for i in (900, 901, 902, 950)} == {"und"} and got[900].score == 0
    empty = ppm.learn(df.where("false"), "doc_id", "text", "lang", F.lit(True), 5)
    assert {r.lang_pred for r in ppm.predict(df, empty).collect()} == {"und"}


# op8


def test_op8_table_is_even_and_stable():
    shards = [f"s{i}" for i in range(10)]
    a = sharding.lookup_table(shards, 1009)
    held = Counter(a)
    assert max(held.values()) - min(held.values()) <= 1
    b = sharding.lookup_table(shards[:-1], 1009)
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 9)
    assert moved < 0.15 * 1009
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(shards, 1000)


def test_op8_placement(spark):
    df = frame(spark, [(1, "a"), (1, "b"), (None, "c")]).withColumn("slot", F.lit("clash"))
    rows = sharding.place(df, ["x", "y"], size=101).collect()
    slot = int(hashlib.md5(b"1").hexdigest()[:15], 16) % 101
    assert [r.slot for r in rows if r.doc_id == 1] == [slot, slot] and all(r.shard in "xy" for r in rows) and len(rows) == 3


# op9


def brute_components(fps, most=4):
    names = sorted(set(fps))
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if bin(a ^ b).count("1") <= most:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in names}


@pytest.mark.parametrize(("n", "shard"), [(1, 8), (7, 2), (400, 1 << 15), (400, 40)])
def test_op9_links(spark, n, shard):
    r = random.Random(n)
    base = [r.getrandbits(64) for _ in range(max(1, n // 4))]
    fps = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) & (2**64 - 1) for b in base for _ in range(4)} | {0, 1, 2**64 - 1})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    pairs = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in simhash.links(df, 4, shard).collect()]
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        assert bin(a ^ b).count("1") <= 4
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = brute_components(fps)
    assert {x: find(x) for x in fps} == want


def test_op9_components_of_long_chains(spark):
    r = random.Random(1)
    nodes = list(range(300))
    r.shuffle(nodes)
    edges = [(nodes[i], nodes[i + 1]) for i in range(299) if i % 50 != 49] + [(7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[x] == min(nodes[k : k + 50]) for k in range(0, 300, 50) for x in nodes[k : k + 50])
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_op9(spark):
    import xxhash

    docs = [(i, made(i % 40, 0, 40) + (" extra" if i > 60 else "")) for i in range(80)] + ODD
    fps = []
    for _, t in docs:
        w = PLAIN.findall((t or "").encode().lower())
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = brute_components(fps)
    least = {}
    for (i, _), f in zip(docs, fps, strict=True):
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    want = sorted(((i, f"{f:016x}", least.get(group[f])) for (i, _), f in zip(docs, fps, strict=True)), key=key)
    got = simhash.near_duplicates(frame(spark, docs)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    assert sorted((tuple(r) for r in got), key=key) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


# op10


def test_op10(spark):
    templates = [(label, t.split()) for label, t in licenses.TEMPLATES]
    docs = [(i, made(i, 0, 200)) for i in range(40)] + ODD[:5] + [(None, "cc-BY-nc")]
    r = random.Random(9)
    for i in range(60):
        said = list(r.choice(templates)[1])
        for _ in range(r.randrange(6)):
            said.insert(r.randrange(len(said) + 1), r.choice(("x", "the", "mit")))
        if r.random() < 0.5 and len(said) > 2:
            said.pop(r.randrange(len(said)))
        docs.append((1000 + i, made(i, 0, 90) + " ".join(said).upper() + " " + made(i + 1, 0, 90)))

    def brute(text):
        w = ALNUM.findall(lower(text))
        at = [(p, label) for phrase, label in licenses.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        blocks = [set(w[b * 32 : b * 32 + 64]) for b in range(len(w) // 32 + 1) if b == 0 or len(w) > (b + 1) * 32]
        met = [(label, len(set(t) & b) / len(set(t))) for b in blocks for label, t in templates if len(set(t) & b) >= licenses.needed(len(set(t)), 0.8)]
        base = sorted({x for _, x in at})
        places = [p for p, _ in at]
        return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted({*base, *(x for x, _ in met)})), round(max((s for _, s in met), default=0.0), 9)

    got = sorted(((r.doc_id, *r[1:7], round(r.score, 9)) for r in licenses.scan(frame(spark, docs)).collect()), key=key)
    assert got == sorted(((i, *brute(t)) for i, t in docs), key=key)
    assert licenses.scan(frame(spark, [])).count() == 0


# frames and pipeline


def test_written_tables_go_to_the_named_folder(spark):
    assert frames.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert frames.written(spark.range(3).toDF("x"), "t").count() == 3


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, folder, "documents")
    seen = [docs.count()]
    for name, stage in cp.STAGES:
        before = docs
        docs = frames.written(stage(spark, docs, folder), name)
        seen.append(docs.count())
        if name != "encoding":
            assert docs.schema == before.schema
    assert seen == sorted(seen, reverse=True) and seen[-1] == seen[-2] > 0 and seen[2] < seen[1]


def _pipeline_rows():
    """(doc_id, text, toxic): copies, near copies, shared passages, benchmark text, toxic text, null ids and texts."""
    r = random.Random(11)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    base, passage, item = [say(r.randint(20, 300)) for _ in range(60)], say(70), say(16)
    rows = [(i, t, 0) for i, t in enumerate(base)]
    rows += [(100 + i, t, 0) for i, t in enumerate(base[:6])]  # copies
    rows += [(110 + i, " ".join([*t.split()[:-1], "other"]), 0) for i, t in enumerate(base[:20])]  # near copies
    rows += [(130 + i, f"{say(150)} {passage}\n{say(90)}", 0) for i in range(5)] + [(-7, f"{say(20)} {passage[: len(passage) // 2]}", 0)]
    rows += [(140, f"{say(30)} {item.upper()} {say(20)}", 0), (141, f"{say(900)} {item} {say(100)}", 0), (142, item, 0)]
    rows += [(150 + i, f"{say(40)} vile hateful {say(40)}", 1) for i in range(20)] + [(170, None, 0), (171, "", 0), (172, " \n", 0)]
    rows += [(None, base[7], 0), (None, f"{say(60)} {passage}", 0), (None, f"{say(30)} vile hateful {say(10)}", 1), (None, item, 0), (None, None, 0)]
    r.shuffle(rows)
    return rows, item


def _pipeline_tables(spark, folder, rows, item):
    docs = frame(spark, [(i, t, "en", "s", len(t or "")) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("component_id", "fp", "begins", "same"):
        docs = docs.withColumn(c, F.lit("clash"))
    frame(spark, [(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    frame(spark, [("b1", item), ("b2", None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return docs


def _brute_near(docs):
    import xxhash

    def fp(text):
        w = (text or "").encode().lower().split()
        grams = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in docs]
    group = brute_components(fps)
    least = {}
    for (i, _), x in zip(docs, fps, strict=True):
        if i is not None:
            least[group[x]] = min(i, least.get(group[x], i))
    return [(i, t) for (i, t), x in zip(docs, fps, strict=True) if i is None or least[group[x]] == i]


def _brute_clean_of(docs, item):
    find = lambda t: ALNUM.findall(lower(t))
    known, out = find(item), []
    windows = {tuple(known[k : k + 13]) for k in range(len(known) - 12)}
    for i, t in docs:
        w = find(t)
        hit = {j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for j in range(k, k + 13)}
        if not hit or 20 * len(hit) < len(w):
            out.append((i, t))
    return out


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as cp

    rows, item = _pipeline_rows()
    df = _pipeline_tables(spark, str(tmp_path), rows, item)
    stages, pairs = dict(cp.STAGES), lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=key)
    run = lambda name, d: frames.written(stages[name](spark, d, str(tmp_path)), name)
    said = lambda t: hashlib.sha256(b" ".join(PLAIN.findall((t or "").encode()))).hexdigest()

    df = run("toxicity", df)
    want = [(i, t) for i, t, toxic in rows if not toxic]
    assert pairs(df) == sorted(want, key=key)

    df = run("near_duplicates", df)
    near, before = _brute_near(want), len(want)
    assert pairs(df) == sorted(near, key=key) and 5 < before - len(near) < 30

    df = run("substring_dedup", df)
    cut = brute_repeats(near, 50)
    got = df.collect()
    assert sorted(((r.doc_id, said(r.text)) for r in got), key=key) == sorted(((i, h) for i, _, _, h in cut), key=key)
    assert sum(n > 0 for _, _, n, _ in cut) >= 4 and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got)

    left = pairs(df)
    df = run("decontamination", df)
    clean = _brute_clean_of(left, item)
    assert pairs(df) == sorted(clean, key=key) and 0 < len(left) - len(clean) <= 3

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer())
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in run("encoding", df).collect()), key=key)
    assert got == sorted(((i, ids := sp.encode(t or ""), sp.decode(ids)) for i, t in clean), key=key)


def test_pipeline_stages_of_nothing(spark, tmp_path):
    import corpus_pipeline as cp

    df = _pipeline_tables(spark, str(tmp_path), [], "a b")
    for name, stage in cp.STAGES:
        df = frames.written(stage(spark, df, str(tmp_path)), name)
        assert df.count() == 0


def test_sql_of_queries(spark):
    from compare import database, same_rows

    con = database("/root/testdata/sf0.001")
    for name, sql in queries.oracle_sql().items():
        same_rows(queries.queries()[name](spark, "/root/testdata/sf0.001"), con, sql)


def as_texts(texts, window, gram):
    return repeats.Windows(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])), window, gram)


@pytest.mark.parametrize("letters", [1, 2, 127])
def test_op2_shard_tells_words_of_one_letter_apart(monkeypatch, letters):
    monkeypatch.setattr(repeats, "LETTERS", letters)
    docs = [(i, t) for i, t in repeating(11) if i is not None and i != 200]
    texts, keys = [(t or "").encode() for _, t in docs], [i for i, _ in docs]
    x = as_texts(texts, 10, 4)
    shard = repeats.Shard(10, 4)
    shard.read(as_texts([b" ".join(t.split()) for t in texts], 10, 4), keys)
    shard.compile()
    inside = shard.spans(x, keys)
    got = {(i, int(inside[x.w.first[d] : x.w.first[d + 1]].sum())) for d, (i, _) in enumerate(docs)}
    assert got == {(i, gone) for i, _, gone, _ in brute_repeats(docs, 10)}
    # What the automaton doesn't locate isn't removed.
    monkeypatch.setattr(shard, "automaton", type("Empty", (), {"iter": lambda self, line: iter(())})())
    assert not shard.spans(x, keys).any()


def test_op2_hashes_alone_remove_nothing(monkeypatch):
    """Windows whose hashes are all the same are told apart by their words."""
    docs = [(i, t) for i, t in repeating(12) if i is not None and i != 200]
    texts, keys = [(t or "").encode() for _, t in docs], [i for i, _ in docs]
    x, shard = as_texts(texts, 10, 4), repeats.Shard(10, 4)
    shard.read(as_texts(texts, 10, 4), keys)
    shard.compile()
    shard.said = shard.said + 1_000_000
    assert not shard.spans(x, keys).any()


def test_op2_words_that_polynomials_mix_up(spark):
    one, other = thue_morse(1024)
    docs = [(i, " ".join(["w%d" % k for k in range(25)] + [t] + ["v%d" % k for k in range(24)])) for i, t in enumerate((one, other, one))] + [(9, "word " * 30_000), (10, "word " * 60)]
    got = sorted((tuple(r) for r in repeats.kept_digests(frame(spark, docs)).collect()), key=key)
    assert got == brute_repeats(docs, 50) and dict((r[0], r[2]) for r in got) == {0: 0, 1: 0, 2: 50, 9: 0, 10: 60}


def thue_morse(n):
    """A text of n letters and its complement; polynomials over them are equal modulo 2**64 for any odd base."""
    said = "a"
    while len(said) < n:
        said += said.translate(str.maketrans("ab", "ba"))
    return said, said.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_mix_up_have_hashes_of_their_own():
    for n in (1024, 4096):
        raw = " ".join(thue_morse(n)).encode()
        buf = np.frombuffer(raw, np.uint8)
        w = wd.words(buf, np.array([0, len(buf)]), wd.PLAIN)
        assert len(set(w.hashes(False).tolist())) == 2
        letters = wd.words(np.frombuffer(" ".join(raw.decode().replace(" ", "")).encode(), np.uint8), np.array([0, 4 * n - 1]), wd.PLAIN).hashes(False)
        g = wd.grams(letters, n)
        assert g[0] != g[n]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 12, 13, 50])
def test_grams_are_those_of_equal_words(k):
    r = random.Random(k)
    said = [r.randrange(2) for _ in range(400)]
    g = wd.grams(np.array([11, 12], np.uint64)[said], k).tolist()
    runs = [tuple(said[i : i + k]) for i in range(400 - k + 1)]
    assert len(set(g[: len(runs)])) == len(set(runs)) and all(g[i] == g[runs.index(x)] for i, x in enumerate(runs)) and not any(g[len(runs) :])


def test_same_bytes():
    raw = b"abcdefgh12 abcdefgh12 abcdefgh13 " + b"x" * 1500 + b" " + b"x" * 1500 + b" " + b"x" * 1499 + b"y"
    w = wd.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), wd.PLAIN)
    left = w.ends - w.starts
    a, b = np.array([0, 0, 3, 3]), np.array([1, 2, 4, 5])
    assert wd.Octets(w.buf).same(w.starts[a], w.starts[b], left[a]).tolist() == [True, False, True, False]


@pytest.mark.parametrize(("n", "bits", "most_share"), [(2016, 2, 0.01), (20_001, 3, 0.01), (20_000, 4, 0.02)])
def test_op9_a_large_group_around_one_centre_is_not_searched_pair_by_pair(n, bits, most_share):
    import tracemalloc

    r = random.Random(n)
    centre = r.getrandbits(64)
    fps = set()
    while len(fps) < n:
        fps.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, bits))))
    fps = np.array(sorted(fps), np.uint64)
    tracemalloc.start()
    search = simhash.Search(simhash.GrayTree(fps), None, 4)
    forest = search.run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(np.unique(forest.root)) == 1 and sum(len(i) for i, _ in forest.links) == n - 1
    assert search.visited < most_share * n * (n - 1) / 2 and peak < 100e6
    for i, j in forest.links:
        assert (np.bitwise_count(search.every[i] ^ search.every[j]) <= 4).all()


@pytest.mark.parametrize("n", [1, 10, 300_000_000, 10**12])
def test_op9_fingerprints_that_are_near_agree_in_a_choice(n):
    masks = simhash.choices(n, 4, 1 << 14)
    r = random.Random(n)
    for _ in range(2000):
        off = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        assert any(not off & m for m in masks)


def test_op9_pieces_of_a_hot_group(spark):
    r = random.Random(5)
    centre = r.getrandbits(64)
    fps = sorted({centre ^ (r.getrandbits(9) << 20) ^ (r.getrandbits(3) << 50) for _ in range(500)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    pairs = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in simhash.links(df, 1, 30).collect()]
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {x: find(x) for x in fps} == brute_components(fps, 1)


def plain_chain(docs, labels, most, least, folds, steps=120, ridge=0.05):
    """The chain in plain loops over dictionaries of features: (models, odds of a text)."""

    def of(text):
        found = set()
        for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
            w = bytes(b + 32 if 65 <= b <= 90 else b for b in w)
            buf = np.frombuffer(w, np.uint8)
            for size in (0, 4, 5):
                if not size or len(w) > size:
                    found.add(int(wd.Octets(buf).hashes(np.array([0]), np.array([size or len(w)]), size)[0]) >> 32)
        return found

    sets = [of(t) for t in docs]
    df = Counter(f for x in sets for f in x)

    def select(y, use):
        seen, hit = Counter(f for i in use for f in sets[i] if df[f] >= least), Counter(f for i in use for f in sets[i] if y[i])
        n, pos = len(use), sum(y[i] for i in use)
        if not 0 < pos < n:
            return []
        chi = {f: n * (hit[f] * n - c * pos) ** 2 / (c * (n - c) * pos * (n - pos)) for f, c in seen.items() if least <= c < n}
        return sorted(sorted(chi, key=lambda f: (-chi[f], f))[:most])

    def fit(names, y, use, extra):
        x = np.array([[f in sets[i] for f in names] for i in use], float).reshape(len(use), len(names))
        x, t = np.column_stack([x, extra[use], np.ones(len(use))]), np.array([y[i] for i in use], float)
        theta = np.zeros(x.shape[1])
        share = min(max(t.mean(), 1e-4), 1 - 1e-4)
        theta[-1] = math.log(share / (1 - share))
        a, b = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, steps + 1 if 0 < t.sum() < len(t) else 0):
            grad = x.T @ (1 / (1 + np.exp(-np.clip(x @ theta, -30, 30))) - t)
            grad[:-1] += ridge * theta[:-1]
            a, b = 0.9 * a + 0.1 * grad, 0.99 * b + 0.01 * grad**2
            theta -= 0.15 * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
        return names, theta

    def odds(model, found, extra):
        names, theta = model
        return sum(theta[j] for j, f in enumerate(names) if f in found) + float(np.dot(theta[len(names) : -1], extra)) + theta[-1]

    n, models, extra = len(docs), [], np.zeros((len(docs), 0))
    for i in range(len(labels[0])):
        y = [x[i] for x in labels]
        models.append(fit(select(y, range(n)), y, list(range(n)), extra))
        if i + 1 < len(labels[0]):
            held = np.zeros(n)
            for f in range(folds):
                use = [k for k in range(n) if k % folds != f]
                model = fit(select(y, use), y, use, extra)
                for k in range(f, n, folds):
                    held[k] = odds(model, sets[k], extra[k])
            extra = np.column_stack([extra, held])

    def told(text):
        found, out = of(text), []
        for m in models:
            out.append(odds(m, found, np.array(out)))
        return out

    return told


def test_op6_is_the_plain_chain(spark):
    r = random.Random(66)
    words = ["house", "trees", "rivers", "stone", "birds", "clouds", "Moron", "trashy", "é", "a1", "hus"]
    docs = [(i, " ".join(r.choice(words[:6] if i % 4 else words) for _ in range(r.randint(0, 25)))) for i in range(160)]
    labels = [(i, int(r.random() < (0.3 if "Moron" in t else 0.8)), int("trashy" in t)) for i, t in docs]
    df = frame(spark, docs).repartition(3)
    chain = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), queries.categories(), most=12, least=3, folds=4)
    order = {x.doc_id: k for k, x in enumerate(frame(spark, docs).select("doc_id").orderBy("doc_id").collect())}
    told = plain_chain([t for _, t in sorted(docs, key=lambda d: order[d[0]])], [(1 - q, t) for i, q, t in sorted(labels)], 12, 3, 4)
    got = {x.doc_id: (x.p_degraded, x.p_toxic) for x in toxicity.score(df, chain, ["doc_id"]).collect()}
    for i, t in docs:
        assert got[i] == pytest.approx(tuple(1 / (1 + math.exp(-o)) for o in told(t)), abs=1e-6)


def test_op8_shards_claim_by_turns_what_they_prefer():
    shards, size = [f"node-{i}" for i in range(7)], 101
    wish = []
    for name in shards:
        d = hashlib.md5(name.encode()).digest()
        at, skip = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:], "big") % (size - 1) + 1
        wish.append([(at + j * skip) % size for j in range(size)])
    assert all(sorted(w) == list(range(size)) for w in wish)
    owner, turn = {}, 0
    while len(owner) < size:
        owner[next(s for s in wish[turn % 7] if s not in owner)] = turn % 7
        turn += 1
    assert sharding.lookup_table(shards, size) == [owner[s] for s in range(size)]


CLASHING = ("fp", "component_id", "n_tokens", "score", "n_words", "lang_pred", "rejected", "p_toxic", "items", "contaminated", "labels", "ids", "media", "page", "slot", "hit_starts", "places", "phrase", "block")


def clashing(spark, rows):
    df = frame(spark, rows)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("clash"))
    return df.withColumn("lang", F.lit("en"))


def every_operator(spark, df):
    """Results of all operators over rows of documents, by name."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    fold = queries.remainder("doc_id", 10)
    return {
        "op1": tiff.page_digests(tiff.read_tiff(tiff.write_tiff(df), ["doc_id"]), ["doc_id"]), "op2": repeats.kept_digests(df), "op3": winnow.decontaminate(df, frame(spark, [(1, "b b b")], "item_id int, text string"), ["doc_id"]),
        "op4": interpolation.score(df, fold != 0, fold == 1), "op5": pieces.encode(df, queries.tokenizer(), digests=True), "op6": toxicity.score(df, toxicity.learn(df, labels, queries.categories()), ["doc_id"]),
        "op7": ppm.predict(df, ppm.learn(df, "doc_id", "text", "lang", F.lit(True), 9)), "op8": sharding.place(df, ["x", "y"], size=101), "op9": simhash.near_duplicates(df), "op10": licenses.scan(df),
    }


def test_columns_that_clash_change_nothing(spark):
    rows = ODD + [(1, "b b b"), (2, "under the MIT license"), (2, "under the MIT license")]
    plain, other = every_operator(spark, frame(spark, rows).withColumn("lang", F.lit("en"))), every_operator(spark, clashing(spark, rows))
    for name, df in plain.items():
        columns = [c for c in df.columns if c != "lang"]
        assert sorted(map(key, df.select(columns).collect())) == sorted(map(key, other[name].select(columns).collect())), name
        assert df.count() == len(rows)


def test_empty_tables_give_empty_results(spark):
    for name, df in every_operator(spark, clashing(spark, [])).items():
        assert df.count() == 0, name


def test_pipeline_stages_keep_columns_of_clashing_names(spark, tmp_path):
    import corpus_pipeline as cp

    rows, item = _pipeline_rows()
    df = _pipeline_tables(spark, str(tmp_path), rows, item)
    for c in ("rejected", "p_toxic", "p_degraded", "n_words", "n_hit", "items", "contaminated", "hit_starts"):
        df = df.withColumn(c, F.lit("mine"))
    df = frames.written(df, "documents")
    for name, stage in cp.STAGES[:-1]:
        before = df
        df = frames.written(stage(spark, df, str(tmp_path)), name)
        assert df.schema == before.schema and {r.rejected + r["items"] + r.contaminated for r in df.collect()} == {"mine" * 3}
