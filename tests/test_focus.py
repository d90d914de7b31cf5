"""Focused context against a plain version that takes chunk by chunk."""

import math
import random
import re

from pyspark.sql import functions as F

from docketry.operators import focus


def plain(sources, question, total, shares=(3, 2, 2), least=400, cap=3):
    """{(place, pos): (turn, text)} of one query; sources: (place, text)."""
    parts = []
    for place, text in sources:
        words = (text or "").split()
        for pos, at in enumerate(range(0, max(0, len(words) - 26) + 1, 95)) if words else ():
            parts.append((place, pos, " ".join(words[at : at + 120])))
    grams = lambda t: (w := re.findall("[a-zæøå0-9]+", t.lower())) + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    n, df = len(parts), {}
    for _, _, said in parts:
        for g in set(grams(said)):
            df[g] = df.get(g, 0) + 1
    idf = {g: 1 + math.log((1 + n) / (1 + c)) for g, c in df.items()}
    vector = lambda t: {g: (1 + math.log(grams(t).count(g))) * idf[g] for g in set(grams(t)) if g in idf}
    q = vector(question or "")
    ranked = {}
    for place, pos, said in parts:
        v = vector(said)
        top, length = sum(v[g] * q.get(g, 0) for g in v), math.sqrt(sum(x * x for x in v.values())) * math.sqrt(sum(x * x for x in q.values()))
        ranked.setdefault(place, []).append((-(round(top / length * 1e6) if length else 0), pos, said))
    places = sorted(ranked)
    part = {p: shares[p] if p < len(shares) else 1 for p in places}
    fair, caps, out, spent = max(least, total // max(1, len(places))), {p: cap * (3 if p == 0 else 2 if p < 3 else 1) for p in places}, {}, 0
    left = {}
    for p in places:
        able = [c for k, c in enumerate(sorted(ranked[p])[: caps[p]]) if k == 0 or -c[0] > 0]
        share, before, rest = max(least, total * part[p] // sum(part.values())), 0, []
        for c in able:
            if share - before >= 200:
                out[p, c[1]] = (1, c[2], share - before)
                before += len(c[2]) + 7
            else:
                rest.append(c)
        spent += min(before, share)
        left[p] = rest
    for p in places:
        spare = total - spent
        if spare < 300:
            break
        room, gone = min(spare, 2 * fair), 0
        for c in left[p]:
            if room - gone >= 200:
                out[p, c[1]] = (2, c[2], room - gone)
                gone += len(c[2]) + 7
        spent += min(gone, room)
    cut = lambda t, r: t if len(t) <= r else t[:r].rsplit(" ", 1)[0] + " …"
    return {k: (turn, cut(said, room)) for k, (turn, said, room) in out.items()}


def made(seed):
    r = random.Random(seed)
    words = [f"ord{int(60 * r.random() ** 2)}" for _ in range(500)]
    return [(p, " ".join(r.choice(words) for _ in range(r.choice([0, 5, 40, 120, 300, 900])))) for p in range(r.randint(1, 8))] + [(20, None)], " ".join(r.choice(words) for _ in range(8))


def test_focus_is_the_plain_one(spark):
    cases = {q: made(q) for q in range(14)} | {50: ([(0, "a b c"), (1, "x " * 400)], None)}
    sources = spark.createDataFrame([(q, p, 100 * q + p, t) for q, (s, _) in cases.items() for p, t in s], "query int, place int, doc int, text string")
    questions = spark.createDataFrame([(q, t) for q, (_, t) in cases.items()], "query int, text string")
    for total in (1500, 4000, 30_000):
        got = {}
        for r in focus.focused(sources, questions, total).collect():
            assert r.doc == 100 * r.query + r.place
            got.setdefault(r.query, {})[r.place, r.pos] = (r.turn, r.said)
        assert got == {q: w for q, (s, t) in cases.items() if (w := plain(s, t, total))}
        assert all(sum(len(x) + 7 for _, x in chosen.values()) <= max(total, 400 * 9) + 9 * 20 for chosen in got.values())


def test_heads_are_paid_first_and_contexts_keep_the_texts_order(spark):
    sources = spark.createDataFrame([(1, p, p, " ".join(f"w{i % 37}" for i in range(700)), "H" * 50) for p in range(3)], "query int, place int, doc int, text string, head string")
    questions = spark.createDataFrame([(1, "w1 w2")], "query int, text string")
    taken = focus.focused(sources, questions, 2000, F.col("head"))
    (context,) = [r.context for r in focus.contexts(taken, sources).collect()]
    assert context.count("H" * 50) == 3 and len(context) <= 2000 + 3 * 10
    assert focus.focused(sources.limit(0), questions).count() == 0


def test_nothing_is_scored_without_words(spark):
    sources = spark.createDataFrame([(1, 0, 7, "a " * 500), (1, 1, 8, "")], "query int, place int, doc int, text string")
    got = focus.focused(sources, spark.createDataFrame([(1, "")], "query int, text string"), 5000).collect()
    assert [(r.place, r.pos, r.score, r.turn) for r in got] == [(0, 0, 0, 1)]
