"""The search chain over a made corpus: each document is dealt a sentence by its id, whose features the SQL has by hand."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from docketry.functions import lexicon_da, snowball_da
from docketry.functions import text as tx
from docketry.operators import blocks as bl
from docketry.operators import chain, hybrid, passages
from docketry.operators import index as ix
from docketry.operators import paragraphs as pg
from docketry.operators import vocabulary as vb
from docketry.plans.registry import query, table
from docketry.plans.ranking import _POST, _TFIDF, _TOK, _ranked
from docketry.sources.tables import cached
from docketry.sources.tables import stored as written

#: Sentences and the features that the lexicon finds in them.
SENTENCES = (
    ("Taget er utæt og der er fugt i loftet", ("consequences:utæthed", "causes:fugt/vand")),
    ("Der er skimmel og fugt bag klinker i badeværelse", ("consequences:skimmel", "causes:fugt/vand", "materials:klinker", "building_parts:badeværelse/vådrum")),
    ("Revner i soklen efter sætninger i jorden", ("building_parts:fundament/sokkel",)),
    ("Råd i vindue efter manglende vedligeholdelse", ("consequences:råd", "building_parts:vindue", "causes:manglende vedligeholdelse", "exclusions:slid/vedligeholdelse")),
    ("Kloakken er utæt og afløb er tilstoppet", ("consequences:utæthed", "building_parts:kloak/afløb")),
    ("Parketgulv af træ med slid og ælde", ("building_parts:gulv", "materials:træ", "causes:slid og ælde")),
    ("Taget af tagpap er udtjent levetid er udløbet", ("materials:tagpap", "causes:udløbet levetid")),
    ("Fugt i kælder og puds på facade", ("causes:fugt/vand", "building_parts:murværk/facade")),
)
#: Questions: as asked, with the board's words, as planned, kind, number, phrase, features.
QUESTIONS = (
    ("fugt og skimmel", "fugt og skimmel", "fugt og skimmel fugtskade opfugtning vandindtrængning skimmelsvamp", "exploratory", None, None, ("causes:fugt/vand", "consequences:skimmel")),
    ("sag nr. AF-10012", "sag nr. AF-10012", "sag nr. AF-10012", "specific", "af-10012", None, ()),
    ('hvor står "revner i soklen"', 'hvor står "revner i soklen"', 'hvor står "revner i soklen"', "exact", None, "revner i soklen", ("building_parts:fundament/sokkel",)),
    ("råd i vindue", "råd i vindue", "råd i vindue rådskade rådskadet", "exploratory", None, None, ("consequences:råd", "building_parts:vindue")),
    ("utæt kloak efter rodindvækst", "utæt kloak efter rodindvækst rødder", "utæt kloak efter rodindvækst rødder utæthed vandindtrængning", "exploratory", None, None, ("consequences:utæthed", "building_parts:kloak/afløb")),
)


def _text(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_text, xs)) + "]::VARCHAR[]"


_CASES = ", ".join(f"({i}, {_text(s)}, {_list(f)})" for i, (s, f) in enumerate(SENTENCES))
_ASKED = ", ".join(f"({i}, {', '.join(map(_text, q[1:6]))}, {_list(q[6])})" for i, q in enumerate(QUESTIONS))
_POSTED = _POST.replace("FROM documents", "FROM d").replace("SELECT doc_id AS doc,", "SELECT doc,").replace(f"SELECT DISTINCT item_id AS query, unnest({_TOK.format('text')}) AS term FROM benchmark", f"SELECT DISTINCT query, unnest({_TOK.format('planned')}) AS term FROM q")


def _weights(place: int) -> str:
    from docketry.functions.lexicon_da import WEIGHTS

    return ", ".join(f"('{f}', {w[place]}::DOUBLE)" for f, w in WEIGHTS.items())


def _moved(source: str, score: str, k: int) -> str:
    return f"(SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY {score} DESC, rank, doc) - 1 AS rank FROM {source} QUALIFY rank < {k})"


SQL = f"""WITH cases(i, sentence, feats) AS (VALUES {_CASES}),
    d AS (SELECT doc_id AS doc, 'af-' || (10000 + doc_id) AS number, sentence || ' kode' || doc_id % 5 || ' blok' || doc_id % 17 AS text, feats FROM documents JOIN cases ON doc_id % {len(SENTENCES)} = i),
    q(query, outer_, planned, kind, ident, phrase, feats) AS (VALUES {_ASKED}), {_POSTED}, {_TFIDF.replace(_POST + ',', '')},
    base AS (SELECT query, doc, rank FROM {_ranked('tfidf', 100)}),
    points AS (SELECT query, doc, coalesce(CASE WHEN number = ident THEN 400 WHEN contains(number, ident) THEN 180 END, 0) + CASE WHEN contains(' ' || lower(text) || ' ', ' ' || phrase || ' ') THEN 120 ELSE 0 END AS score
               FROM d, q WHERE kind IN ('exact', 'specific') AND (contains(number, ident) OR contains(' ' || lower(text) || ' ', ' ' || phrase || ' '))),
    hits AS (SELECT query, doc, rank FROM {_ranked('points', 100)}),
    fused AS (SELECT query, doc, sum(w)::BIGINT AS score FROM (SELECT query, doc, 2 * round_even(1e7 / (21.0e0 + rank), 0)::BIGINT AS w FROM hits UNION ALL SELECT query, doc, round_even(1e7 / (21.0e0 + rank), 0)::BIGINT FROM base WHERE query IN (SELECT query FROM hits)) GROUP BY ALL),
    routed AS (SELECT query, doc, rank FROM base WHERE query NOT IN (SELECT query FROM hits) UNION ALL SELECT query, doc, rank FROM {_ranked('fused', 100)}),
    cand AS (SELECT r.*, regexp_extract_all('kendelse ' || lower(text), '[a-zæøå0-9]+') AS said FROM routed r JOIN d USING (doc) JOIN q USING (query) WHERE kind = 'exact'),
    lsize AS (SELECT query, count(*)::DOUBLE AS docs, avg(len(said))::DOUBLE AS mean FROM cand GROUP BY query),
    lterms AS (SELECT DISTINCT query, unnest({_TOK.format('outer_')}) AS term FROM q),
    lpost AS (SELECT query, doc, rank, len(said) AS n, term, len(list_filter(said, lambda w: w = term)) AS tf FROM cand JOIN lterms USING (query) WHERE list_contains(said, term)),
    lfreq AS (SELECT query, term, count(*) AS df FROM lpost GROUP BY ALL),
    lsum AS (SELECT query, doc, any_value(rank) AS first, count(*) AS matched, sum(round_even(ln(1.0e0 + (docs - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * n / mean))) * 1e7, 0)::BIGINT) AS total
             FROM lpost JOIN lfreq USING (query, term) JOIN lsize USING (query) GROUP BY query, doc),
    lscore AS (SELECT *, round_even(total * (1.0e0 + least(0.5e0, 0.08e0 * (matched - 1))), 0)::BIGINT AS score FROM lsum),
    lrank AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, first) AS place FROM lscore WHERE score > 0),
    lpoint AS (SELECT query, doc, round_even(1e7 / (20.0e0 + place), 0)::BIGINT + round_even(score * 0.001e0, 0)::BIGINT AS score FROM lrank WHERE place <= greatest(40, 3 * (SELECT max(docs) FROM lsize))),
    lorder AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) - 1 AS rank FROM lpoint),
    pfused AS (SELECT query, doc, sum(w)::BIGINT AS score FROM (SELECT query, doc, 2 * round_even(1e7 / (21.0e0 + rank), 0)::BIGINT AS w FROM lorder UNION ALL SELECT query, doc, round_even(1e7 / (21.0e0 + rank), 0)::BIGINT FROM routed) GROUP BY ALL),
    refined AS (SELECT query, doc, rank FROM {_ranked('pfused', 100)}),
    shared_ AS (SELECT query, doc, rank, f, split_part(f, ':', 1) AS field FROM (SELECT query, r.doc, r.rank, unnest(list_intersect(q.feats, d.feats)) AS f FROM refined r JOIN d USING (doc) JOIN q USING (query))),
    overlap AS (SELECT query, doc, sum(w) AS overlap FROM shared_ JOIN (VALUES {_weights(1)}) m(field, w) USING (field) GROUP BY query, doc),
    meta AS (SELECT r.*, round_even((1.0e0 / (20 + rank) + least(coalesce(overlap, 0.0e0), 10.0e0) * 0.004e0) * 1e7, 0)::BIGINT AS score FROM refined r LEFT JOIN overlap USING (query, doc)),
    moved AS {_moved('meta', 'score', 100)},
    pool AS (SELECT query, count(*)::DOUBLE AS of_ FROM moved GROUP BY query),
    seen AS (SELECT query, f, count(*) AS df FROM shared_ GROUP BY ALL),
    bonus AS (SELECT query, doc, sum(round_even(w * (1.0e0 + ln((of_ + 1.0e0) / (df + 1.0e0))) * 1e7, 0)::BIGINT) AS bonus FROM shared_ JOIN seen USING (query, f) JOIN pool USING (query) JOIN (VALUES {_weights(2)}) m(field, w) USING (field) GROUP BY query, doc),
    feat AS (SELECT m.*, round_even(1.0e0 / (rank + 1.0e0) * 1e7, 0)::BIGINT + round_even(coalesce(bonus, 0) * 0.12e0, 0)::BIGINT AS score FROM moved m LEFT JOIN bonus USING (query, doc)),
    last_ AS {_moved('feat', 'score', 100)},
    named AS (SELECT l.query, l.doc FROM last_ l JOIN d USING (doc) JOIN q USING (query) WHERE kind = 'specific' AND contains(number, ident)),
    chosen AS (SELECT * FROM last_ WHERE query NOT IN (SELECT query FROM named) UNION ALL SELECT l.* FROM last_ l JOIN named USING (query, doc))"""


def corpus(spark, sf_dir):
    made = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SENTENCES)], "i long, sentence string")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % len(SENTENCES)).alias("i")).join(F.broadcast(made), "i")
    i = F.col("doc_id")
    text = F.concat("sentence", F.lit(" kode"), (i % 5).cast("string"), F.lit(" blok"), (i % 17).cast("string"))
    return docs.select(i.alias("doc"), F.concat(F.lit("AF-"), (10_000 + i).cast("string")).alias("number"), F.lit("").alias("link"), F.lit("").alias("title"), text.alias("text"))


def stored(spark, sf_dir, name: str, docs, words=ix.tokens, most: int = 1, vectors: bool = False) -> hybrid.Corpus:
    """A corpus with its words, their rarities, features, paragraphs and vectors, made once and read then; no postings or weights are kept."""
    code = [ix, vb, bl, tx, passages, pg, chain, hybrid, lexicon_da, snowball_da, sys.modules[__name__]]
    kept = lambda part, make: cached(spark, f"{name}-{part}", [f"{sf_dir}/documents.parquet"], code, make)
    held = kept("docs", lambda: docs)
    lists = kept("said", lambda: bl.said(held, "doc", "text", words, tuple(c for c in ("lang", "source") if c in held.columns)))

    def rare():
        listed = vb.counted(lists, vb.cut(lists, most, store=lambda x: written(x, "runs")).terms, most)
        return bl.rarities(listed.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), held.count())

    rarities = kept("rarities", rare)
    feats = kept("features", lambda: chain.features(held, "doc").groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("field", "value"))).alias("feats")))
    units = kept("units", lambda: pg.units(held, "doc"))
    return hybrid.Corpus(held, lists, rarities, feats, units, kept("vectors", lambda: hybrid.embedded(lists, rarities, most)) if vectors else None, most)


@query(f"{SQL} SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY rank) - 1 AS rank FROM chosen QUALIFY rank < 20")
def lexical_chain_topk(spark, sf_dir):
    """The whole chain: plan, lexical base, direct matches, paragraphs, metadata, features, number."""
    asks = spark.createDataFrame([(i, q[0], 100, 20) for i, q in enumerate(QUESTIONS)], "query int, text string, retrieve int, final int")
    return hybrid.search(stored(spark, sf_dir, "dealt", corpus(spark, sf_dir)), asks)


_LABELS = ", ".join(f"({i}, {_list(f)})" for i, (_, f) in enumerate(SENTENCES))


@query(f"WITH cases(i, feats) AS (VALUES {_LABELS}) SELECT doc_id AS doc, split_part(f, ':', 1) AS field, split_part(f, ':', 2) AS value FROM (SELECT doc_id, unnest(feats) AS f FROM documents JOIN cases ON doc_id % {len(SENTENCES)} = i)")
def feature_rows(spark, sf_dir):
    """The lexicon joined with the texts' runs of words, with laws and years."""
    return chain.features(corpus(spark, sf_dir), "doc")


@query(f"WITH cases(i, feats) AS (VALUES {_LABELS}) SELECT doc_id AS doc, doc_id % {len(SENTENCES)} IN (0, 1, 7) AS damp FROM documents")
def category_precedents(spark, sf_dir):
    """Whether the chain, kept to decisions on damp, could give a document."""
    rows = chain.features(corpus(spark, sf_dir), "doc").where("field = 'causes' and value = 'fugt/vand'").select("doc", F.lit(True).alias("damp"))
    return corpus(spark, sf_dir).select("doc").join(rows, "doc", "left").select("doc", F.coalesce("damp", F.lit(False)).alias("damp"))
