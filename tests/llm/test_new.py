"""Ropes, importance resampling and web archives against brute force."""

import base64
import gzip
import hashlib
import io
import math
import random
import re
import zlib

import pytest

from docketry.llm import infill, queries, resample, warc

ODD = [(900, None), (901, ""), (902, " \n\t \n\n"), (903, "A é 日本 \x00x ﬁ\n𝄞"), (903, "A é 日本 \x00x ﬁ\n𝄞"), (904, "b" * 5000), (None, "no\nkey"), (905, "wörd\n" * 30_000), (906, "has a <M>\nmark"), (907, "<\nP>\n<P\n"), (908, "no end")]


def made(seed, n, vocabulary=("a", "B", "b1", "é", "日本", "x<", "<P", "S>", "𝄞", "the", "Mit")):
    r = random.Random(seed)
    return "".join(r.choice(vocabulary) + r.choice([" ", "\n", "\n\n", ", "]) for _ in range(r.randint(0, n)))


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


def key(x):
    return tuple(map(str, x))


# op11


def lines(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def brute_infill(i, t, percent=100, spm=50, unit=lines):
    t = t or ""
    d = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = unit(t)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in infill.SENTINELS) or h[2] % 100 >= percent:
        return len(u), "plain", None, None, t
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size", [1, 3, 16, 2048])
def test_ropes_split_and_join_as_texts_do(monkeypatch, size):
    monkeypatch.setattr(infill, "LEAF_BYTES", size)
    for i in range(25):
        t = made(i, 120)
        r = infill.rope(t.encode())
        assert bytes(r) == t.encode() and (r.chars, r.size, infill.units(r, "lines")) == (len(t), len(t.encode()), len(lines(t)))
        for unit, cut in (("lines", lines), ("chars", list)):
            u = cut(t)
            for rank in {0, 1, 2, len(u) // 2, max(0, len(u) - 1), len(u)}:
                a, b = infill.split(r, rank, unit)
                assert (bytes(a).decode(), bytes(b).decode()) == ("".join(u[:rank]), "".join(u[rank:]))
                back = infill.concat(b, a)
                assert bytes(back) == bytes(b) + bytes(a) and back.chars == len(t) and back.ends == t.count("\n")


def test_ropes_stay_shallow(monkeypatch):
    monkeypatch.setattr(infill, "LEAF_BYTES", 4)
    r, rnd = infill.rope(b"ab\n" * 4000), random.Random(1)
    for _ in range(200):
        a, b = infill.split(r, rnd.randrange(4001), "lines")
        r = infill.concat(b, a)
    assert r.height <= 2 * math.log2(3000) + 2 and bytes(r) == b"ab\n" * 4000


def test_sentinels_that_could_arise_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("<P<", "<S>", "<M>"), ("ab", "ba", "c"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError, match="sentinels"):
            infill.checked(bad)


@pytest.mark.parametrize(("unit", "percent"), [("lines", 100), ("chars", 100), ("lines", 40)])
def test_op11(spark, unit, percent):
    docs = [(i, made(i, 60)) for i in range(60)] + ODD
    df = infill.infill(frame(spark, docs).selectExpr("*", "'clash' AS form", "1 AS extra", "'clash' AS output"), unit=unit, percent=percent)
    out = infill.restore(df).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output.decode()) for r in out), key=key)
    assert got == sorted(((i, *brute_infill(i, t, percent, unit=lines if unit == "lines" else list)) for i, t in docs), key=key)
    assert all(r.restored.decode() == (r.text or "") and r.extra == 1 for r in out) and len({r.form for r in out}) == 3


def test_op11_of_nothing_and_of_no_output(spark):
    assert infill.restore(infill.infill(frame(spark, []))).count() == 0
    with pytest.raises(ValueError, match="no output"):
        infill.original(b"<P>a<S>b", "psm", infill.checked(infill.SENTINELS))


# op12


def said(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_runs(t, n):
    w = said(t)
    return [" ".join(w[a:b]) for b in range(1, len(w) + 1) for a in range(max(0, b - n), b)]


def brute_resample(docs, items, n, buckets, percent, least):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    runs = [[bucket(x) for x in brute_runs(t, n)] for _, t in docs]
    target = [bucket(x) for _, t in items for x in brute_runs(t, n)]
    every = [b for f in runs for b in f]
    gain = {b: math.floor(1000 * math.log((target.count(b) + 1) * (len(every) + buckets) / ((every.count(b) + 1) * (len(target) + buckets)))) for b in set(every)}
    out = []
    for (i, t), f in zip(docs, runs, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        out.append([i, len(said(t)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    can = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(can[: len(can) * percent // 100], 1):
        r[5] = k
    return out


@pytest.mark.parametrize("stretch", [7, 1 << 20])
@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_ring_of_states_is_the_crc_of_each_run(monkeypatch, n, stretch):
    monkeypatch.setattr(resample, "TURN_BYTES", stretch)
    for i in range(30):
        t = made(i, 40)
        found = list(resample.runs(t.encode(), n))
        assert [x for _, f in found for x in f] == [zlib.crc32(r.encode()) for r in brute_runs(t, n)]
        assert sum(k for k, _ in found) == len(said(t))


@pytest.mark.parametrize(("n", "percent"), [(1, 10), (2, 50), (3, 100)])
def test_op12(spark, n, percent):
    docs = [(i, made(i % 70, 60)) for i in range(120)] + [x for x in ODD if x[0] != 905] + [(905, "wörd " * 3000), (5, made(5, 60))]
    items = [(i, made(i + 500, 30)) for i in range(5)] + [(9, None)]
    df = frame(spark, docs).selectExpr("*", "'clash' AS score", "'clash' AS rank", "'clash' AS n_words")
    out = resample.resample(df.repartition(5), frame(spark, items), n=n, buckets=50, percent=percent, least=5)
    want = brute_resample(docs, items, n, 50, percent, 5)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(key, out.collect())) == sorted(map(key, want))


def test_op12_features(spark):
    docs = [(i, made(i, 30)) for i in range(20)] + ODD[:6]
    got = resample.features(frame(spark, docs).selectExpr("*", "'clash' AS n_words"), n=2, buckets=97, keep=["doc_id", "n_words"]).collect()
    assert sorted((key((r.doc_id, r.n_words, r.buckets)) for r in got)) == sorted(key((i, len(said(t)), [zlib.crc32(x.encode()) % 97 for x in brute_runs(t, 2)])) for i, t in docs)


def test_op12_of_nothing(spark):
    none = frame(spark, [])
    assert resample.resample(none, none).count() == 0
    assert [(r.weight, r.rank) for r in resample.resample(frame(spark, [(1, "a " * 30)]), none, percent=100).collect()] == [(math.floor(1000 * math.log(10_030 / (31 * 10_000))), 1)]


def test_op12_equal_scores_take_ranks_by_key(spark):
    scored = spark.createDataFrame([(i, 20, 1, 0, s) for i, s in [(7, 5), (3, 5), (9, 8), (None, 5), (4, 5), (4, 5), (1, 4)]], "doc_id long, n_words long, n_features long, weight long, score long")
    got = sorted(((r.rank, r.doc_id) for r in resample.drawn(scored, percent=80).collect() if r.rank), key=key)
    assert got == [(1, 9), (2, 3), (3, 4), (4, 4), (5, 7)]


# op13


def web(seed):
    r = random.Random(seed)
    big = [f"<p>é{i} " + "x" * r.choice([900, 1000, 5000]) + "</p>" for i in range(6)]
    rows = [(i, f"http://a.b/{i}", r.choice([*big, f"small {i % 7}", "", None, "y" * 999, "y" * 1000])) for i in range(90)]
    rows += [rows[3], rows[4], rows[4], (None, None, big[0]), (None, "u", "x"), (None, "v", "z" * 2000), (None, "v", "z" * 2000), (500, "http://a b\r\nX-Evil: 1\n", big[1]), (-3, "w", big[2]), (501, "w", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 90)]
    r.shuffle(rows)
    return rows


def brute_archive(rows):
    out = []
    for i, _, h in rows:
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and bool(same) and i != max(same)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(map(key, out))


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_op13(spark, tmp_path, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        rows = web(1)
        frame(spark, rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS digest", "'clash' AS head", "1 AS payload").repartition(4).write.parquet(str(tmp_path / "pages.parquet"))
        df = queries.op13_warc_source(spark, str(tmp_path))
        assert df.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        assert sorted(map(key, df.collect())) == brute_archive(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_op13_reads_what_is_asked_for(spark, tmp_path):
    path, rows = str(tmp_path / "archive"), web(2)
    warc.archive(frame(spark, rows, "page_id long, url string, html string").repartition(3), path, file_bytes=3000)
    files = sorted(x.name for x in (tmp_path / "archive").iterdir())
    assert len(files) > 3 and all(x.startswith("part-") for x in files)
    df = warc.read(spark, path, split_bytes=4000)
    assert df.rdd.getNumPartitions() > 1 and {f.name for f in df.schema} >= {*warc.HEADERS}
    got = df.collect()
    kinds = [r.record_type for r in got]
    assert kinds.count("warcinfo") == len(files) and kinds.count("response") + kinds.count("revisit") == len(rows) and not any(r.error for r in got)
    assert all(r.http_status == 200 and r.http_headers["content-type"].startswith("text/html") and r.headers["warc-type"] == r.record_type for r in got if r.record_type != "warcinfo")
    assert {r.target_uri for r in got if r.record_id == "urn:page:500"} == {"http://a%20b%0D%0AX-Evil:%201%0A"}
    narrow = warc.read(spark, path, ["record_id", "record_type", "content_length"]).where("record_type = 'revisit' AND content_length > 0 AND record_id LIKE 'urn:page:%' AND record_id <> 'urn:page:7'")
    assert "Filter (" not in narrow._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.record_id for r in narrow.collect()) == sorted(r.record_id for r in got if r.record_type == "revisit" and r.record_id != "urn:page:7")
    both = warc.read(spark, path, ["record_type", "payload"]).where("record_type = 'response' AND octet_length(payload) > 950")
    assert both.count() == sum(r.record_type == "response" and len(r.payload) > 950 for r in got)
    warc.archive(frame(spark, rows[:2], "page_id long, url string, html string"), path)
    assert warc.read(spark, path, ["record_type"]).where("record_type <> 'warcinfo'").count() == len(rows) + 2


def foreign(*bodies, kind="response", http=True, **more):
    out = []
    for i, b in enumerate(bodies):
        head = b"HTTP/1.1 404 Not Found\r\nX-Long: a\r\n b\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in more.items()).encode() + b"\r\n" if http else b""
        out.append(f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Type: {'application/http' if http else 'text/plain'}\r\nContent-Length: {len(head) + len(b)}\r\n\r\n".encode() + head + b + b"\r\n\r\n")
    return out


def read_bytes(data, name, wanted=("payload", "http_headers", "http_status"), filters=()):
    import pyarrow as pa

    return list(warc.records(pa.PythonFile(io.BytesIO(data), "r"), name, set(wanted), list(filters)))


def test_warc_files_of_others():
    chunked = b"4;x=1\r\nWiki\r\n5\r\npedia\r\n0\r\n\r\n"
    plain = foreign(b"one", b"", b"x" * 700_000, b"WARC/1.0\r\n\r\n") + foreign(chunked, Transfer_Encoding="chunked") + foreign(b"as it is", http=False, kind="resource")
    want = [b"one", b"", b"x" * 700_000, b"WARC/1.0\r\n\r\n", b"Wikipedia", b"as it is"]
    whole = b"".join(plain)
    for data, name in ((whole, "a.warc"), (gzip.compress(whole), "b.warc.gz"), (b"".join(map(gzip.compress, plain)), "c.warc.gz"), (b"".join(warc._member(x, 6) for x in plain), "d.warc.gz"), (warc._member(whole, 1), "e.warc.gz")):
        got = read_bytes(data, name)
        assert [r.get("payload") for r in got] == want and not any(r.get("error") for r in got)
        assert got[0]["http_status"] == 404 and got[0]["http_headers"]["x-long"] == "a b" and got[5].get("http_status") is None
        assert [r["record_type"] for r in read_bytes(data, name, ["record_type"])] == ["response"] * 5 + ["resource"]


def test_warc_payloads_that_nobody_wants_are_not_inflated(monkeypatch):
    import pyarrow as pa

    noise = random.Random(1).randbytes(3_000_000)
    data = b"".join(warc._member(x, 1) for x in foreign(noise, b"end", noise))
    read = []
    inflate = warc.zlib.decompressobj

    class Watched:
        def __init__(self, *a):
            self.inner = inflate(*a)

        def decompress(self, raw, *a):
            read.append(len(raw))
            return self.inner.decompress(raw, *a)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Watched)
    rows = list(warc.records(pa.PythonFile(io.BytesIO(data), "r"), "x.warc.gz", {"record_id"}, []))
    assert [r["record_id"] for r in rows] == ["urn:x:0", "urn:x:1", "urn:x:2"] and sum(read) < 100_000


def test_warc_faults_are_rows(spark, tmp_path):
    good = foreign(b"one", b"two" * 1000)
    cases = {
        "cut.warc": b"".join(good)[:-2000], "cut.warc.gz": gzip.compress(good[0]) + gzip.compress(good[1])[:-30], "junk.warc": good[0] + b"junk\r\n", "junk.warc.gz": b"junk" * 9, "noend.warc": good[0][:-4] + good[1],
        "size.warc": b"WARC/1.0\r\nContent-Length: -5\r\n\r\n", "colon.warc": b"WARC/1.0\r\nnothing\r\n\r\n", "empty.warc": b"", "_aside.warc": b"junk", "other.txt": b"junk",
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in warc.read(spark, str(tmp_path)).collect():
        got.setdefault(r.file.rpartition("/")[2], []).append((r.payload, bool(r.error)))
    one = (b"one", False)
    assert got == {"cut.warc": [one, (None, True)], "cut.warc.gz": [one, (None, True)], "junk.warc": [one, (None, True)], "junk.warc.gz": [(None, True)], "noend.warc": [(None, True)], "size.warc": [(None, True)], "colon.warc": [(None, True)]}
    assert warc.read(spark, str(tmp_path), ["record_type"]).where("record_type = 'response'").count() == 3
    (tmp_path / "none").mkdir()
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_warc_pushed_predicates():
    rows = [{"record_type": k, "content_length": n} for k in ("a", "b", None) for n in (1, 5)]
    at, size = ("record_type",), ("content_length",)

    def kept(*filters):
        return [(r["record_type"], r["content_length"]) for r in rows if warc._holds(filters, r)]

    assert kept(warc.EqualTo(at, "a"), warc.GreaterThan(size, 1)) == [("a", 5)] and kept(warc.IsNull(at), warc.LessThanOrEqual(size, 1)) == [(None, 1)]
    assert kept(warc.Not(warc.EqualTo(at, "a")), warc.LessThan(size, 5)) == [("b", 1)] and kept(warc.EqualTo(at, None)) == [] and kept(warc.EqualNullSafe(at, None), warc.GreaterThanOrEqual(size, 5)) == [(None, 5)]
    assert kept(warc.In(at, ("b", None))) == [("b", 1), ("b", 5)] and kept(warc.Not(warc.In(at, ("b", None)))) == [] and kept(warc.StringStartsWith(at, "a")) == kept(warc.StringContains(at, "a")) == kept(warc.StringEndsWith(at, "a")) == [("a", 1), ("a", 5)]
    assert not warc._judged(warc.EqualTo(("payload",), b"")) and not warc._judged(warc.EqualTo(("headers", "x"), "")) and warc._judged(warc.Not(warc.IsNull(at)))


def test_warc_digests_and_columns(spark):
    raw = hashlib.sha1(b"x").digest()
    assert warc._sha1("sha1:" + base64.b32encode(raw).decode()) == warc._sha1("SHA1:" + raw.hex().upper()) == raw.hex() and warc._sha1("md5:abc") is warc._sha1(None) is warc._sha1("sha1:zz") is None
    with pytest.raises(Exception, match="record_id"):
        warc.register(spark)
        frame(spark, [(1, "x")]).write.format("warc").mode("append").save("/tmp/never")


def test_op13_of_nothing(spark, tmp_path):
    frame(spark, [], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.op13_warc_source(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op11_rope_infill", "op12_crc_resampling", "op13_warc_source"])
def test_sql_over_odd_rows(spark, tmp_path, name):
    import duckdb

    docs = [(i, made(i, 90)) for i in range(80)] + [x for x in ODD if x[0] != 905] + [(905, "wörd\n" * 500)]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, [(i, made(i + 500, 30)) for i in range(5)] + [(9, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame(spark, web(5), "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, str(tmp_path))
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(key, df.collect())) == sorted(key(r[i] for i in at) for r in want.fetchall())
