"""Small fixtures with answers worked out by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docketry.functions import dates, rules, vectors
from docketry.functions import text as tx
from docketry.functions.snowball_da import stem, stems
from docketry.operators import evaluate, filters, index, ordered, paragraphs, passages, rank, reasoning


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'string' if isinstance(values[n], str) or values[n] is None else 'double'}" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("title", "text", "given", "want"),
    [
        ("Vandskade. Selskab medhold.", "", "", "Ikke medhold"),
        ("Tag. Klager delvis mehold.", "", "", "Delvis medhold"),
        ("Tag. Sag afvist.", "", "", "Afvist"),
        ("Råd. Klager medhold.", "", "", "Medhold"),
        ("Uden resultat", "Herefter b e s t e m m e s: Klagen kan ikke tages til følge.", "", "Ikke medhold"),
        ("Uden resultat", "Derfor bestemmes: Selskabet skal anerkende dækning.", "", "Medhold"),
        ("Uden resultat", "intet", "Afvist", "Afvist"),
        (None, None, None, "Ukendt"),
    ],
)
def test_outcome(spark, title, text, given, want):
    df = spark.createDataFrame([(title, text, given)], "t string, x string, g string")
    assert df.select(rules.outcome(F.col("t"), F.col("x"), F.col("g"))).first()[0] == want


def test_defects_take_words_not_parts(spark):
    df = spark.createDataFrame([("Klagen tages til følge", "selskabet har foretaget rådgivning"), ("Skimmel på loftet", ""), ("x", "utæt undertag og fugt")], "t string, x string")
    assert [r[0] for r in df.select(rules.defects(F.col("t"), F.col("x"))).collect()] == [["Andet"], ["Skimmel/fugt", "Konstruktion/bærende"], ["Skimmel/fugt", "Tag/tagdækning"]]


def test_cover_and_its_denial():
    assert reasoning.cover("Klageren har tegnet udvidet ejerskifteforsikring.") == "Udvidet"
    assert reasoning.cover("Klageren har tegnet en basis ejerskifteforsikring.") == "Basis"
    assert reasoning.cover("Klageren har ikke, men har tegnet udvidet ejerskifteforsikring uden") == "Basis"
    assert reasoning.cover("Selskabet skal anerkende, at klageren har tegnet udvidet ejerskifteforsikring.") == "Udvidet"
    assert reasoning.cover("") == "Ikke angivet"


def test_html(spark):
    html = "<h2>Af&oslash;rste</h2><p><b>Fed</b></p><p>Tekst&nbsp;her<br>ny&#8217;</p><script>"
    assert one(spark, tx.strip_html(F.col("h")), h=html) == "Aførste Fed Tekst her ny"
    assert one(spark, tx.strip_html(F.col("h"), headings=True), h=html) == "## Aførste\n\n#### Fed\nTekst her\nny"
    assert one(spark, tx.strip_html(F.col("h")), h=None) == ""
    assert passages.main_content("<body><nav>menu menu menu menu</nav><article><p>Sagen</p></article></body>") == "Sagen"


def test_citations(spark):
    said = "som i [Kilde 3, 5 og 7], [Kilder 2–4] og [Kilde 14, basis] samt [Kilde 1-99]"
    assert one(spark, tx.citation_numbers(F.col("a"), 8), a=said) == [3, 5, 7, 2, 4, 1, 6, 8]
    assert one(spark, tx.citation_numbers(F.col("a"), 8), a=None) == []


def test_dates(spark):
    found = one(spark, dates.in_text(F.col("a")), a="den 16. maj 2019, 1.2.1990 og 31.02.2001")
    assert [d.isoformat() for d in found] == ["2019-05-16", "1990-02-01"]
    assert one(spark, dates.shown(F.lit("2020-03-01").cast("date"), F.lit(True)), a="x") == "ca. 01.03.2020"
    assert one(spark, dates.parsed(F.col("a")), a="2020-13-01") is None


def test_repaired_neighbour_prefers_the_lower(spark):
    df = spark.createDataFrame([(1, 10, "a"), (1, 12, None), (1, 14, "b"), (1, 15, None), (2, 1, None)], "g int, p int, v string")
    got = {(r.g, r.p): (r.nearest_place, r.nearest_value) for r in ordered.nearest(df, ["g"], "p", F.col("v")).collect()}
    assert got == {(1, 10): (10, "a"), (1, 12): (10, "a"), (1, 14): (14, "b"), (1, 15): (14, "b"), (2, 1): (None, None)}


def test_budgets(spark):
    df = spark.createDataFrame([(1, 5), (2, 10), (3, 1)], "i int, n int")
    assert [r.i for r in ordered.within_budget(df, [], ["i"], F.col("n"), 16).orderBy("i").collect()] == [1]
    assert spark.sql("SELECT array(5, 10, 1) AS n").select(ordered.filled(F.col("n"), 12, 2)).first()[0] == [1, 3]


def test_windows(spark):
    w = spark.sql("SELECT transform(sequence(1, 10), x -> cast(x AS string)) AS w")
    assert [len(x) for x in w.select(tx.windows(F.col("w"), 4, 1)).first()[0]] == [4, 4, 4, 1]
    assert [len(x) for x in w.select(tx.windows(F.col("w"), 4, 1, stop_at_end=True)).first()[0]] == [4, 4, 4]


def test_bm25_order(spark):
    docs = spark.createDataFrame([(1, "undertaget er ikke ført sammen ved kip"), (2, "skimmel på loftet"), (3, "gulvet"), (4, "skimmel fra undertag")], "doc_id int, text string")
    terms = index.query_terms(spark.createDataFrame([(1, "undertaget ikke ført sammen kip"), (2, "skimmel undertag"), (3, "findes ej")], "query_id int, text string"))
    best = {r.query: r.doc for r in rank.top(index.bm25(index.build(docs), terms), 1).collect()}
    assert best == {1: 1, 2: 4}


@pytest.mark.parametrize("most", [1, 2, 3])
def test_tfidf_of_runs_of_stems(spark, most):
    import math
    from collections import Counter

    from docketry.functions.snowball_da import stemmed

    texts = {1: "Skimmel på lofterne. Skimmel på loftet og på vinduet", 2: "taget er utæt ved skorstenen", 3: "loftet", 4: None, 5: "utæt skorsten, skimmel på loftet"}
    asked = {1: "skimmel på lofter", 2: "utætte skorsten", 3: "loft", 4: ""}

    def terms(text):
        w = stems(re.findall("[a-zæøå][a-zæøå-]+", (text or "").lower()))
        return Counter(" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1))

    counts = {d: terms(t) for d, t in texts.items()}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: 1 + math.log((1 + len(texts)) / (1 + n)) for t, n in df.items() if n >= 2}
    unit = lambda w: {t: x / math.sqrt(sum(v * v for v in w.values())) for t, x in w.items()}
    weights = {d: unit({t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}) for d, c in counts.items()}
    wanted = {q: unit({t: idf[t] for t in terms(said) if t in idf}) for q, said in asked.items()}
    want = {(q, d): s for q, x in wanted.items() for d, w in weights.items() if (s := sum(x[t] * w.get(t, 0) for t in x)) > 0.01}
    built = index.build(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), most=most, words=stemmed)
    sought = index.query_terms(spark.createDataFrame(list(asked.items()), "query_id int, text string"), most=most, words=stemmed)
    got = {(r.query, r.doc): r.score / index.SCALE**2 for r in index.tfidf_scores(*index.tfidf(built), sought).collect()}
    assert got == pytest.approx(want, abs=1e-5) and len(want) > 4
    assert most == 1 or any(" " in r.term for r in index.tfidf(built)[1].collect())


def _paragraph_bm25(docs, query):
    """(score, place in docs, section, paragraph) of the paragraphs that hold a query term, best first, by brute force."""
    import math

    units = [(d, s, i, re.findall("[a-zæøå0-9]+", f"{t} {p}".lower())) for d, text in enumerate(docs) for s, (t, ps) in enumerate(passages.sections(text)) for i, p in enumerate(x for x in ps if len(x) >= 20)]
    mean, terms, out = sum(len(u[3]) for u in units) / len(units), list(dict.fromkeys(re.findall("[a-zæøå0-9]+", query.lower()))), []
    for d, s, i, w in units:
        score, matched = 0.0, 0
        for t in terms:
            if tf := w.count(t):
                df, matched = sum(t in u[3] for u in units), matched + 1
                score += math.log(1 + (len(units) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
        if matched:
            out.append((score * (1 + min(0.5, 0.08 * (matched - 1))), d, s, i))
    return sorted(out, key=lambda x: (-x[0], *x[1:]))


def _paragraph_docs(seed, n):
    r = random.Random(seed)
    return ["\n\n".join(("## Skimmel " + r.choice("ab") if r.random() < 0.3 else " ".join(r.choice("skimmel loft tag utæt rør gulv kælder fugt".split()) for _ in range(r.randint(1, 25)))) for _ in range(r.randint(0, 9))) for _ in range(n)]


def test_paragraph_bm25_over_all_texts(spark):
    docs = [*_paragraph_docs(1, 12), None]
    terms = index.query_terms(spark.createDataFrame([(1, "skimmel på loft"), (2, "utæt tag, utæt rør"), (3, "findes ej")], "query_id int, text string"))
    got = paragraphs.hits(spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string"), terms, 15).orderBy("query", "rank").collect()
    for q, said in ((1, "skimmel på loft"), (2, "utæt tag, utæt rør")):
        want = _paragraph_bm25(docs, said)[:15]
        assert [(r.doc, r.section, r.paragraph, r.rank) for r in got if r.query == q] == [(*x[1:], i + 1) for i, x in enumerate(want)]
        assert [r.score / index.SCALE for r in got if r.query == q] == pytest.approx([x[0] for x in want], abs=1e-5)
    assert {r.query for r in got} == {1, 2}


def test_refinement_by_the_paragraphs_of_the_candidates_alone(spark):
    docs, base, said = _paragraph_docs(2, 30), [17, 3, 8, 21, 5, 11], "utæt tag i kælder"
    found = _paragraph_bm25([docs[d] for d in base], said)[: max(40, 3 * len(base))]
    points = {}
    for rank, (score, d, *_) in enumerate(found, 1):
        points.setdefault(d, []).append((1 / (20 + rank), score))
    total = {base[d]: sum(a + 0.001 * s for a, s in x[:3]) for d, x in points.items()}
    order = sorted(total, key=lambda d: (-total[d], d))
    fused = {d: 1 / (21 + i) + (2 / (21 + order.index(d)) if d in order else 0) for i, d in enumerate(base)}
    lists = spark.createDataFrame([(q, d, i) for q in (1, 2) for i, d in enumerate(base)], "query int, doc int, rank int")
    terms = index.query_terms(spark.createDataFrame([(1, said), (2, said)], "query_id int, text string"))
    texts = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    got = paragraphs.refined(lists, texts, terms, exact=spark.createDataFrame([(1,)], "query int"), final=5).orderBy("query", "rank").collect()
    want = sorted(fused, key=lambda d: (-fused[d], d))[:5]
    assert [r.doc for r in got if r.query == 1] == want != base[:5]
    assert [r.doc for r in got if r.query == 2] == base[:5]


def test_fusion(spark):
    lists = [spark.createDataFrame([(1, d, i) for i, d in enumerate(x)], "query int, doc string, rank int") for x in (["b", "c"], ["a", "b"])]
    assert [r.doc for r in rank.top(rank.fuse(lists), 9).orderBy("rank").collect()] == ["b", "a", "c"]


def test_fusion_and_ranking_hold_whatever_the_partitions(spark):
    rows = [(q, d, (q * 7 + d * 13) % 50) for q in range(3) for d in range(60)]
    a, b = (rank.top(spark.createDataFrame(rows, "query int, doc int, score int").repartition(n), 20).orderBy("query", "rank").collect() for n in (1, 7))
    assert a == b


def test_defects_have_a_sentence_for_each_label(spark):
    said = {
        "Skimmel/fugt": ["opstigende grundfugt", "kondens indvendigt"],
        "Tag/tagdækning": ["et gammelt stråtag", "nyt eternittag", "et sadeltag", "vand fra taget", "et fladt tag"],
        "Kloak/dræn": ["drænet virker ikke"],
        "Installationer": ["en defekt varmepumpe", "el-installationen", "pejsen", "ulovligt oliefyr"],
        "Fundament": ["revner i soklen og fundamentet"],
        "Vinduer/døre": ["punkterede termoruder", "terrassedøren binder", "vinduerne"],
        "Murværk/facade": ["manglende murbindere", "en binder", "fugerne smuldrer"],
        "Råd/svamp/insekt": ["angreb af ægte hussvamp", "myrer", "rotter", "råd"],
        "Konstruktion/bærende": ["bjælkelaget", "etageadskillelsen", "manglende isolering på loftet"],
        "Badeværelse/vådrum": ["badeværelset"],
        "Gulv": ["trægulvet", "et klinkegulv", "plankgulv", "betongulvet"],
        "Ulovlige forhold": ["manglende byggetilladelse"],
    }
    assert [label for label, _ in rules.DEFECTS] == list(said)
    rows = [(label, x) for label, sentences in said.items() for x in sentences]
    df = spark.createDataFrame(rows, "label string, said string")
    for title_, text in ((F.col("said"), F.lit(None)), (F.lit(""), F.initcap("said"))):
        for r in df.select("label", "said", rules.defects(title_, text, rules.DEFECTS).alias("d")).collect():
            assert r.label in r.d, r
    bad = {"skimmelsvamp": ["Skimmel/fugt"], "en rådgiver har foretaget": ["Andet"], "forbinderen": ["Andet"], "ulovligt oliefyr": ["Installationer", "Ulovlige forhold"], "": ["Andet"]}
    assert {x: one(spark, rules.defects(F.col("a"), F.lit(""), rules.DEFECTS), a=x) for x in bad} == bad


def test_danish_outcomes_finds_every_kind_of_defect(spark, tmp_path):
    from docketry.plans.queries import QUERIES

    rows = [(1, "Varmepumpen og et utæt vindue"), (2, "Sag 7\nHussvamp i bjælkelaget"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.defects for r in QUERIES["danish_outcomes"](spark, str(tmp_path)).collect()}
    assert got == {1: "Installationer,Vinduer/døre", 2: "Råd/svamp/insekt,Konstruktion/bærende", 3: "Andet"}


def test_query_planner_sees_whole_turns(spark, tmp_path):
    from docketry.plans.queries import QUERIES

    turns = [(1, 0, "one two three the"), (1, 1, "one two three four five the"), (1, 2, "der the"), (1, 3, None)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    cut, whole = ({r.turn: r.added for r in QUERIES[n](spark, str(tmp_path)).collect()} for n in ("query_planner", "query_planner_turns"))
    assert whole == {0: "thing,of the,that", 1: "", 2: "thing,of the,that,und,haus", 3: ""} == cut
    long = [(2, 0, "the two three four five six")]
    spark.createDataFrame(long, "conv_id long, turn int, text string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    assert [r.added for r in QUERIES["query_planner"](spark, str(tmp_path)).collect()] == ["thing,of the,that"]
    assert [r.added for r in QUERIES["query_planner_turns"](spark, str(tmp_path)).collect()] == [""]


def test_facets(spark):
    df = spark.createDataFrame([(1, 2019, ["a"], "x"), (2, None, ["b"], "y"), (3, 2021, [], "x")], "i int, y int, l array<string>, v string")
    assert filters.facets(F.col("y")) is None
    assert [r.i for r in df.where(filters.facets(F.col("y"), 2020)).collect()] == [3]
    assert [r.i for r in df.where(filters.facets(F.col("y"), None, 2020)).collect()] == [1]
    assert [r.i for r in df.where(filters.facets(lists={"l": ["b", "a"]}, values={"v": ["x"]})).collect()] == [1]


def test_undefined_metrics_are_null(spark):
    run = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 5, 0)], "query int, doc int, rank int")
    qrels = spark.createDataFrame([(1, 2, 2)], "query int, doc int, rel int")
    got = {r.query: r for r in evaluate.graded(run, qrels).collect()}
    assert (got[1].ndcg, got[1].judged, got[1].first, got[1].precision) == (0.63093, 0.5, 2, 1.0)
    assert (got[2].ndcg, got[2].judged, got[2].first, got[2].precision) == (None, 0.0, None, None)


def test_gate_fails_on_missing_values(spark):
    a, b = (spark.createDataFrame(x, "metric string, value double") for x in ([("rr", 0.5), ("recall_20", 0.5), ("old", 1.0)], [("rr", 0.47), ("recall_20", 0.475), ("new", 1.0)]))
    assert {r.metric: r.passed for r in evaluate.gate(a, b).collect()} == {"rr": True, "recall_20": False, "old": False, "new": False}


def test_conflicts():
    answer = "I [Kilde 1] fik klageren medhold. Selskabet fik medhold i [Kilde 2]. Blandt 10 kendelser fik klageren medhold [Kilde 3]."
    assert passages.conflicts(answer, ["Ikke medhold", "Ikke medhold", "Ikke medhold"]) == [(1, "Medhold", "Ikke medhold")]


def test_quotes():
    assert passages.quotes('"kort" og "en meget længere ordret gengivelse"') == ["en meget længere ordret gengivelse"]
    assert passages.supported("en  længere ordret … gengivelse af teksten", "En længere ordret, men her udvidet, gengivelse af teksten.")
    assert not passages.supported("noget helt andet end det der står i kilden", "Kilden siger noget.")


def test_sections_and_paragraphs(spark):
    text = "Indledning her er lang nok.\n\n## Vurdering\nNævnet finder, at taget er utæt.\nDerfor dækkes skaden.\n\nKort."
    assert passages.sections(text) == [("Kendelse", ["Indledning her er lang nok."]), ("Vurdering", ["Nævnet finder, at taget er utæt. Derfor dækkes skaden.", "Kort."])]
    df = passages.paragraphs(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string"))
    assert [(r.section, r.paragraph) for r in df.orderBy("section").collect()] == [(0, 0), (1, 0)]
    assert "utæt" in passages.decision_core(text, "utæt tag")
    assert passages.key_sections("x\n## Andet\nintet\n## Konklusion\nDækket.", 100) == "[KONKLUSION]\nDækket."


def test_stems():
    for word, want in (("afgørelser", "afgør"), ("planloven", "planlov"), ("indtage", "indtag"), ("underfundig", "underfund"), ("løsladt", "løslad")):
        assert stem(word) == want
    assert stems(["rodvækst", "rødderne"]) == ["rødder", "rødder"]


def test_intent(spark):
    said = ["find sag nr. 12345/2", 'hvor står "ordret gengivet tekst"', "hvordan står jeg", "hvad er praksis", "hvad er fristen?", "tag"]
    df = spark.createDataFrame([(s,) for s in said], "t string").select(rules.intent(F.col("t")).alias("x"))
    assert [r.x.intent for r in df.collect()] == ["specific", "exact", "case", "practice", "factual", "exploratory"]


def test_rate_limiter_ignores_denied(spark):
    from docketry.streaming.feeds import limited

    rows = [(i, 1, s) for i, s in enumerate((0, 1, 2, 3, 61, 62))]
    df = spark.createDataFrame(rows, "event_id int, user_id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert [(r.allowed, r.wait) for r in limited(df, 2, 60).orderBy("event_id").collect()] == [(True, 0.0), (True, 0.0), (False, 58.0), (False, 57.0), (True, 0.0), (True, 0.0)]


def test_zipped_and_plain_csv(spark, tmp_path):
    import zipfile

    from docketry.sources import readers

    body = 'Dato,Titel,Link,Tekst,Mangeltype\n2020-01-01,"A ""b""",l1,"<h2>Q</h2>to\nlinjer","Tag, Gulv"\n'
    (tmp_path / "a.csv").write_text(body)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("b.csv", body)
    (tmp_path / "c.zip").write_text("no zip")
    plain = readers.read_csv(spark, str(tmp_path / "a.csv"), ("Dato", "Titel", "Link", "Tekst", "Mangeltype"))
    zipped = readers.read_zipped_csv(spark, str(tmp_path / "*.zip"), ("Dato", "Titel", "Link", "Tekst", "Mangeltype"))
    assert plain.collect() == zipped.collect() and plain.count() == 1
    row = readers.cleaned(plain).first()
    assert (row.Titel, row.Excerpt, row.Mangeltype) == ('A "b"', "Q to linjer", ["Tag", "Gulv"])


def test_judgements(spark):
    from docketry.sources.readers import read_judgements

    df = spark.createDataFrame([("q", "c", "2", "0.9"), ("q", "d", "-1", "1"), ("q", "", "1", "1"), ("q", "e", "x", "1"), ("q", "f", "1", "0.1")], "question_id string, case_number string, relevance string, confidence string")
    assert [r.case_number for r in read_judgements(df, 0.5).collect()] == ["c"]
    assert [r.case_number for r in read_judgements(df, 0.5, uncertain=True).collect()] == ["c", "d"]


def test_vectors(spark):
    df = spark.sql("SELECT array(3.0d, 4.0d) AS a, array(0.0d, 0.0d) AS z")
    assert df.select(vectors.normalised(F.col("a")), vectors.normalised(F.col("z"))).first()[:] == ([0.6, 0.8], [0.0, 0.0])


def test_vector_search_holds_against_brute_force(spark):
    random.seed(2)
    rows = [(i, [random.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc int, v array<double>")
    got = {(r.query, r.doc): r.score for r in rank.vector_scores(df, df.where("doc % 20 = 0").select(F.col("doc").alias("query"), F.col("v").alias("qv"))).collect()}
    want = {(q, d): round(sum(a * b for a, b in zip(x, y)), 10) for q, x in rows if q % 20 == 0 for d, y in rows}
    assert got == {k: v for k, v in want.items() if v > 0.15}
