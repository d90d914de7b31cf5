"""Documents by their kind, cached tables, blocked vector products, phrases, board parts, whole rules."""

import io
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.functions import lexicon_da as lex
from docketry.operators import lookups, rank, reasoning
from docketry.operators.index import Index, build, query_terms
from docketry.sources import documents, readers, tables


def docx(*paragraphs):
    out, space = io.BytesIO(), "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p[:3]}</w:t></w:r><w:r><w:t>{p[3:]}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pdf(*lines):
    shown = b"BT " + b" T* ".join(b"(%s) Tj" % x.encode("cp1252") for x in lines) + b" ET"
    return b"%PDF-1.4\n1 0 obj <<>>\nstream\n" + zlib.compress(shown) + b"\nendstream\nendobj\n2 0 obj\nstream\nBT [(de)-20(l)] TJ ET\nendstream\n%%EOF"


def test_documents_of_all_kinds(spark):
    held = [docx("Første afsnit", "Andet"), pdf("Nævnet finder", r"\(ja\)"), bytes.fromhex("D0CF11E0A1B11AE100"), b"<html>x</html>", "﻿Hej å".encode(), b"PK\x03\x04broken", b"\xff\xfe", None]
    df = spark.createDataFrame(list(enumerate(held)), "i int, content binary")
    got = {r.i: (r.kind, r.said) for r in df.select("i", documents.kind(F.col("content")).alias("kind"), documents.text_of(F.col("content")).alias("said")).collect()}
    assert got == {0: ("docx", "Første afsnit\nAndet"), 1: ("pdf", "Nævnet finder\n(ja)\ndel"), 2: ("doc", None), 3: ("html", "<html>x</html>"), 4: ("text", "Hej å"), 5: ("docx", None), 6: ("text", None), 7: (None, None)}


def test_cached_tables_follow_their_files(spark, tmp_path):
    source, made = str(tmp_path / "rows"), []

    def make():
        made.append(1)
        return spark.read.parquet(source).groupBy().count()

    spark.range(5).write.parquet(source)
    read = lambda code=lookups: tables.cached(spark, "rows", [source], [code], make).first()[0]
    assert (read(), read(), len(made)) == (5, 5, 1)
    spark.range(3).write.mode("append").parquet(source)
    assert (read(), len(made)) == (8, 2) and (read(rank), len(made)) == (8, 3)
    home = [p for p in (tmp_path.parent.glob("*")) if p.is_dir()]
    assert home
    place = tables.folder(spark)
    import glob

    assert len(glob.glob(f"{place}/cache/rows-*/*")) == 1


def test_no_local_folder_on_a_cluster():
    class Spark:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        tables.folder(Spark)


@pytest.mark.parametrize(("rows", "k"), [(4096, None), (16, None), (16, 3), (8, 1)])
def test_vector_scores_in_blocks(spark, rows, k):
    r = np.random.default_rng(3)
    v = r.normal(size=(70, 5)).astype(np.float32)
    v[9] = v[11]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "doc long, v array<float>")
    asked = df.where("doc % 7 = 0").select(F.col("doc").alias("query"), F.col("v").alias("qv"))
    got = rank.vector_scores(df, asked, 0.15, k, rows)
    if k:
        got = rank.top(got, k)
    found = sorted((x.query, x.doc, x.score) for x in got.collect())
    want = []
    for q in range(0, 70, 7):
        scores = sorted(((-round(float(v[q].astype(float) @ x.astype(float)), 10), i) for i, x in enumerate(v)))
        want += [(q, i, -s) for s, i in scores if -s > 0.15][:k]
    assert [x[:2] for x in found] == [x[:2] for x in sorted(want)] and np.allclose([x[2] for x in found], [x[2] for x in sorted(want)], atol=1e-9)
    assert rank.vector_scores(df.where("false"), asked, rows=rows).count() == 0


def test_an_index_of_terms_has_their_postings(spark):
    df = spark.createDataFrame([(1, "a b b c"), (2, "c d"), (3, None)], "doc_id long, text string")
    index = build(df)
    terms = query_terms(spark.createDataFrame([(0, "b d x")], "query_id int, text string"))
    few, joined = index.of(terms), index.of(terms, most=0)
    rows = lambda i: sorted((r.doc, r.term, r.tf) for r in i.postings.collect())
    assert isinstance(few, Index) and rows(few) == rows(joined) == [(1, "b", 2), (2, "d", 1)] and (few.docs, few.mean) == (3, index.mean)


def test_phrases_short_and_long(spark):
    units = spark.createDataFrame([(1, "der er fugt i taget"), (2, "fugt i tagrender og fugt i taget her"), (3, "intet")], "unit long, said string")
    phrases = spark.createDataFrame([(0, "fugt i taget"), (0, "i tag"), (1, ""), (2, "er fu"), (3, "ugt i tagr")], "query long, phrase string")
    got = [tuple(r) for r in lookups.phrase_hits(units, phrases).orderBy("query", "rank").collect()]
    assert got == [(0, 1, 2, 12, 1), (0, 2, 2, 12, 2), (2, 1, 1, 5, 1), (3, 2, 1, 10, 1)]


def test_first_wins_by_columns_and_by_order(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 2), (None, "c", 1), (None, "d", 1), (2, None, None)], "k long, v string, o long")
    up = sorted(map(tuple, readers.first_wins(df, ["k"], ["o", "v"]).collect()), key=str)
    assert up == sorted([(1, "b", 2), (None, "c", 1), (2, None, None)], key=str)
    down = sorted(map(tuple, readers.first_wins(df, ["k"], [F.desc("o"), "v"]).collect()), key=str)
    assert down == sorted([(1, "a", 3), (None, "c", 1), (2, None, None)], key=str)


def test_lexicon_join_is_the_labels_of_tokens(spark):
    said = ["Taget er utæt efter slid og ælde", "Skimmel i badeværelset, ikke dækket", None, ""]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id int, text string")
    want = {(r.doc_id, f, label) for r in lex.metadata(df, ["doc_id"]).collect() for f in lex.FIELDS for label in r[f]}
    assert {tuple(r) for r in lex.label_rows(df, "doc_id").collect()} == want and want


def test_every_rule_of_conclusions_and_boards_is_there():
    assert len(reasoning.CONCLUSION_SIGNALS) == 25 and len(reasoning.DECISION_SIGNALS) == 20 and len(reasoning.BOARD_SPEAKS) == 10
    assert all(reasoning.concludes(f"Nævnet siger: {s.upper()}.") for s in reasoning.CONCLUSION_SIGNALS)


def test_statements_of_outcomes():
    assert reasoning.statements("[Kilde 1]: delvist medhold; [Kilde 2] (ikke medhold)") == [(1, "Delvis medhold"), (2, "Ikke medhold")]
    assert reasoning.statements("Køberen fik medhold [Kilde 1], hvorimod selskabet fik medhold [Kilde 2].") == [(1, "Medhold"), (2, "Ikke medhold")]
    assert reasoning.statements("Blandt 9 sager fik klageren medhold [Kilde 1]. I [Kilde 2-5] fik klageren medhold.") == []


def test_rendering_cuts_the_last_paragraph():
    assert reasoning.rendered(["a" * 100, "b" * 300], 290) == "a" * 100 + "\n\n" + "b" * 187 + "…"
    assert reasoning.rendered(["a" * 100, "b" * 300], 280) == "a" * 100 and reasoning.rendered([], 10) == ""
