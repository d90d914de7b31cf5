"""The hybrid chain and smart retrieval over whole documents.

Each document has one of the chain's Danish sentences planted after its first line, each conversation's last user turn one of its questions at
its end; everything runs over the whole texts, and the SQL reads the same texts. What a question is (its kind, the number or phrase that it names, the
board's word for one of its words) is the SQL's only knowledge that isn't read from a table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import lexicon_da as lex
from docketry.functions.snowball_da import sql as snowball_sql
from docketry.functions.snowball_da import stemmed
from docketry.operators import hybrid
from docketry.plans import chain as ch
from docketry.plans.ranking import _POST, _STEM_WORD, _TFIDF, _TOK, LOCAL, UNITS
from docketry.plans.registry import query, table

#: Pools that conversations are kept to, by number; null: all documents.
POOLS = ("en", "fr", "de", "es", None)


def planted(spark, sf_dir):
    """doc, number, link, title, text, lang, source: documents with a sentence after their first line."""
    made = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(ch.SENTENCES)], "i long, sentence string")
    docs = table(spark, sf_dir, "documents").withColumn("i", F.col("doc_id") % len(ch.SENTENCES)).join(F.broadcast(made), "i")
    said = F.coalesce("text", F.lit(""))
    line = F.substring_index(said, "\n", 1)
    text = F.concat(line, F.lit("\n"), "sentence", F.lit("."), F.expr("substring(coalesce(text, ''), length(substring_index(coalesce(text, ''), '\n', 1)) + 1)"))
    return docs.select(F.col("doc_id").alias("doc"), F.concat(F.lit("AF-"), (10_000 + F.col("doc_id")).cast("string")).alias("number"), F.lit("").alias("link"), F.lit("").alias("title"), text.alias("text"), "lang", "source")


def talks(spark, sf_dir):
    """query, text, lang (a pool): the last user turn of each conversation and a question."""
    made = spark.createDataFrame([(i, q[0]) for i, q in enumerate(ch.QUESTIONS)], "i long, asked string")
    pools = spark.createDataFrame(list(enumerate(POOLS)), "p long, lang string")
    last = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("query")).agg(F.max_by("text", "turn").alias("said"))
    last = last.withColumns({"i": F.col("query") % len(ch.QUESTIONS), "p": F.floor(F.col("query") / len(ch.QUESTIONS)) % len(POOLS)})
    return last.join(F.broadcast(made), "i").join(F.broadcast(pools), "p").select("query", F.concat_ws(" ", "said", "asked").alias("text"), "lang")


def _asks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pools = docs.groupBy(F.col("lang").alias("pool")).agg(F.count("*").alias("n")).where("pool IS NOT NULL").unionByName(docs.agg(F.count("*").alias("n")).withColumn("pool", F.lit(None).cast("string")))
    return hybrid.sizes(talks(spark, sf_dir).withColumn("pool", F.col("lang")), pools).drop("pool")


def _corpus(spark, sf_dir):
    return ch.stored(spark, sf_dir, "planted", planted(spark, sf_dir), stemmed, 2, vectors=True)


_Q = ", ".join(f"({i}, {', '.join(map(ch._text, (q[0], q[1][len(q[0]) :], *q[3:6])))})" for i, q in enumerate(ch.QUESTIONS))
_P = ", ".join(f"({i}, {ch._text(p)})" for i, p in enumerate(POOLS))
_LEX = ", ".join(f"('{f}', {ch._text(label)}, {ch._text(run)})" for f, label, run, _ in lex.needles())
_CASE = ", ".join(f"({i}, {ch._text(s)})" for i, (s, _) in enumerate(ch.SENTENCES))
_SIZED = "CASE WHEN n > 500 THEN {0} WHEN n > 200 THEN {1} ELSE {2} END"
#: The corpus, the questions, their features, words and lists of the base.
_SOURCE = f"""
    cases(i, sentence) AS (VALUES {_CASE}), asked_(i, said, board, kind, ident, phrase) AS (VALUES {_Q}), pools_(i, lang) AS (VALUES {_P}),
    d AS (SELECT doc_id AS doc, 'af-' || (10000 + doc_id) AS number, lang, source, split_part(coalesce(text, ''), chr(10), 1) || chr(10) || sentence || '.' || substr(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 1) AS text FROM documents JOIN cases ON doc_id % {len(ch.SENTENCES)} = i),
    pool_sizes AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT NULL, count(*) FROM documents),
    q AS (SELECT conv_id AS query, t.said || ' ' || a.said || board AS text, kind, ident, phrase, p.lang, {_SIZED.format(100, 70, 40)} AS retrieve, {_SIZED.format(15, 12, 8)} AS final
          FROM (SELECT conv_id, arg_max(text, turn) AS said FROM conversations WHERE role = 'user' GROUP BY conv_id) t JOIN asked_ a ON conv_id % {len(ch.QUESTIONS)} = a.i JOIN pools_ p ON conv_id // {len(ch.QUESTIONS)} % {len(POOLS)} = p.i JOIN pool_sizes z ON z.lang IS NOT DISTINCT FROM p.lang)"""


def _index(asked: str) -> str:
    """TF-IDF of stems and hashed vectors of d and of the CTE asked (query, text)."""
    tail = _TFIDF.replace(_POST + ",", "")
    return f"""
    words_ AS (SELECT doc, NULL AS query, {_STEM_WORD.format('text')} AS words FROM d UNION ALL SELECT NULL, query, {_STEM_WORD.format('text')} FROM {asked}),
    placed AS (SELECT doc, query, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM words_),
    every_word AS (SELECT DISTINCT w FROM placed), {snowball_sql('every_word')},
    lists AS (SELECT doc, query, flatten(list(stems ORDER BY i)) AS s FROM placed JOIN stemmed USING (w) GROUP BY doc, query),
    runs AS (SELECT doc, query, unnest(list_concat(s, list_transform(range(1, len(s)), lambda k: s[k] || ' ' || s[k + 1]))) AS term FROM lists),
    sizes AS (SELECT count(*)::DOUBLE AS docs FROM documents),
    post AS (SELECT doc, term, count(*) AS tf FROM runs WHERE query IS NULL GROUP BY ALL),
    freq AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY term),
    terms AS (SELECT DISTINCT query, term FROM runs WHERE doc IS NULL), {tail},
    hashes AS (SELECT term, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS place, CASE WHEN substr(md5(term), 5, 1) < '8' THEN 1 ELSE -1 END AS sign FROM kept),
    dparts AS (SELECT doc, place, sum(sign * round_even(w / dlen.length * 1e7, 0)::BIGINT)::DOUBLE AS w FROM raw JOIN dlen USING (doc) JOIN hashes USING (term) GROUP BY doc, place),
    qparts AS (SELECT query, place, sum(sign * round_even(idf * 1e7, 0)::BIGINT)::DOUBLE AS w FROM terms JOIN kept USING (term) JOIN hashes USING (term) GROUP BY query, place),
    dlens AS (SELECT doc, sqrt(sum(round_even(w / 1000, 0) * round_even(w / 1000, 0))) AS length FROM dparts GROUP BY doc),
    qlens AS (SELECT query, sqrt(sum(round_even(w / 1000, 0) * round_even(w / 1000, 0))) AS length FROM qparts GROUP BY query),
    dvec AS (SELECT doc, place, round_even(w / (length * 1000) * 1000000, 0)::BIGINT AS v FROM dparts JOIN dlens USING (doc) WHERE length > 0),
    qvec AS (SELECT query, place, round_even(w / (length * 1000) * 1000000, 0)::BIGINT AS v FROM qparts JOIN qlens USING (query) WHERE length > 0),
    near AS (SELECT query, doc, sum(dvec.v * qvec.v) AS score FROM dvec JOIN qvec USING (place) GROUP BY query, doc HAVING score > 150000000000)"""


def _limited(source: str, limits: str, score: str = "score DESC, doc", most: str = "retrieve") -> str:
    return f"(SELECT * EXCLUDE (k) FROM (SELECT x.*, row_number() OVER (PARTITION BY query ORDER BY {score}) - 1 AS rank, l.{most} AS k FROM {source} x JOIN {limits} l USING (query)) WHERE rank < k)"


def _base(asked: str, kept: str) -> str:
    """The CTE base (query, doc, rank) of asked (query, retrieve, ...); kept: what a document d must have for it."""
    return f"""
    lex_in AS (SELECT t.query, t.doc, t.score FROM tfidf t JOIN d USING (doc) JOIN {asked} q USING (query) WHERE {kept}),
    dense_in AS (SELECT t.query, t.doc, t.score FROM near t JOIN d USING (doc) JOIN {asked} q USING (query) WHERE {kept}),
    both_lists AS (SELECT query, doc, rank FROM {_limited('lex_in', asked)} UNION ALL SELECT query, doc, rank FROM {_limited('dense_in', asked)}),
    fused_base AS (SELECT query, doc, sum(round_even(1e7 / (61.0e0 + rank), 0)::BIGINT)::BIGINT AS score FROM both_lists GROUP BY query, doc),
    base AS (SELECT query, doc, rank FROM {_limited('fused_base', asked)})"""


_RRF = "round_even(1e7 / (21.0e0 + {0}), 0)::BIGINT"
_CHAIN = f"""WITH {_SOURCE}, {_index('q')}, {_base('q', '(q.lang IS NULL OR d.lang = q.lang)')},
    lexicon(field, label, run) AS (VALUES {_LEX}),
    flat AS (SELECT doc, NULL AS query, ' ' || array_to_string({_TOK.format('text')}, ' ') || ' ' AS said FROM d UNION ALL SELECT NULL, query, ' ' || array_to_string({_TOK.format('text')}, ' ') || ' ' FROM q),
    feats AS (SELECT DISTINCT doc, query, field, label FROM flat, lexicon WHERE contains(said, ' ' || run || ' ')),
    plain_said AS (SELECT doc, ' ' || lower(trim(regexp_replace(' ' || text, '[ \\t\\n\\r\\f]+', ' ', 'g'))) || ' ' AS said FROM d),
    points AS (SELECT query, doc, coalesce(CASE WHEN number = ident THEN 400 WHEN contains(number, ident) THEN 180 END, 0) + CASE WHEN contains(p.said, ' ' || phrase || ' ') THEN 120 ELSE 0 END AS score
               FROM d JOIN plain_said p USING (doc), q WHERE (q.lang IS NULL OR d.lang = q.lang) AND kind IN ('exact', 'specific') AND (contains(number, ident) OR contains(p.said, ' ' || phrase || ' '))),
    hits AS (SELECT query, doc, rank FROM {_limited('points', 'q')}),
    cands AS (SELECT query, doc, min(base) AS base, min(hit) AS hit FROM (SELECT query, doc, rank AS base, NULL AS hit FROM base UNION ALL SELECT query, doc, NULL, rank FROM hits) GROUP BY query, doc),
    routing AS (SELECT *, max((hit IS NOT NULL)::INT) OVER (PARTITION BY query) AS direct FROM cands),
    scored1 AS (SELECT query, doc, CASE WHEN direct = 1 THEN 2 * coalesce({_RRF.format('hit')}, 0) + coalesce({_RRF.format('base')}, 0) ELSE -base END AS score FROM routing),
    routed AS (SELECT query, doc, rank FROM {_limited('scored1', 'q')}),
    {UNITS},
    first_ AS (SELECT r.* FROM routed r JOIN q USING (query) WHERE kind = 'exact'),
    lterms AS (SELECT DISTINCT query, unnest({_TOK.format('text')}) AS term FROM q), {LOCAL},
    scored2 AS (SELECT r.query, r.doc, coalesce(2 * {_RRF.format('l.rank')}, 0) + {_RRF.format('r.rank')} AS score FROM routed r LEFT JOIN lorder l USING (query, doc)),
    refined AS (SELECT query, doc, rank FROM {_limited('scored2', 'q')}),
    shared_ AS (SELECT r.query, r.doc, a.field, a.label FROM refined r JOIN feats a ON a.doc = r.doc JOIN feats b ON b.query = r.query AND a.field = b.field AND a.label = b.label),
    overlap AS (SELECT query, doc, sum(w) AS overlap FROM shared_ JOIN (VALUES {ch._weights(1)}) m(field, w) USING (field) GROUP BY query, doc),
    scored3 AS (SELECT r.query, r.doc, r.rank AS was, round_even((1.0e0 / (20 + r.rank) + least(coalesce(overlap, 0.0e0), 10.0e0) * 0.004e0) * 1e7, 0)::BIGINT AS score FROM refined r LEFT JOIN overlap USING (query, doc)),
    moved AS (SELECT query, doc, rank FROM {_limited('scored3', 'q', 'score DESC, was, doc')}),
    pool AS (SELECT query, count(*)::DOUBLE AS of_ FROM moved GROUP BY query),
    seen AS (SELECT query, field, label, count(*) AS df FROM shared_ GROUP BY ALL),
    bonus AS (SELECT query, doc, sum(round_even(w * (1.0e0 + ln((of_ + 1.0e0) / (df + 1.0e0))) * 1e7, 0)::BIGINT) AS bonus FROM shared_ JOIN seen USING (query, field, label) JOIN pool USING (query) JOIN (VALUES {ch._weights(2)}) m(field, w) USING (field) GROUP BY query, doc),
    scored4 AS (SELECT m.query, m.doc, m.rank AS was, round_even(1.0e0 / (m.rank + 1.0e0) * 1e7, 0)::BIGINT + round_even(coalesce(bonus, 0) * 0.12e0, 0)::BIGINT AS score FROM moved m LEFT JOIN bonus USING (query, doc)),
    last_ AS (SELECT query, doc, rank FROM {_limited('scored4', 'q', 'score DESC, was, doc')}),
    naming AS (SELECT l.*, coalesce(kind = 'specific' AND contains(number, ident), false) AS named FROM last_ l JOIN d USING (doc) JOIN q USING (query)),
    chosen AS (SELECT query, doc, rank AS was FROM naming QUALIFY named OR NOT bool_or(named) OVER (PARTITION BY query))
    SELECT query, doc, rank FROM {_limited('chosen', 'q', 'was', 'final')}"""


@query(_CHAIN)
def hybrid_chain_topk(spark, sf_dir):
    """The chain with a dense and a lexical list as its base, for all conversations at once, each with its pool's sizes."""
    return hybrid.search(_corpus(spark, sf_dir), _asks(spark, sf_dir), stemmed, 2, within=("lang",))


def _earlier(spark, sf_dir):
    """query, doc, turn, rank: the sources of a conversation's assistant turns, which the tables don't have: by the turn's words."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    said = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    docs = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: ((said * (i + 1)) % 97).cast("long"))
    return turns.select(F.col("conv_id").alias("query"), "turn", F.posexplode(docs).alias("rank", "doc"))


_SMART = f"""WITH {_SOURCE.replace("|| board AS text", "AS text")},
    parts AS (SELECT query, generate_subscripts(p, 1) AS place, unnest(p) AS text FROM (SELECT query, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, ' ' || chr(10))), lambda x: length(x) >= 20)[1:3] AS p FROM q) WHERE len(p) > 1),
    filters AS (SELECT query, CASE WHEN query % 3 = 0 THEN (SELECT min(source) FROM documents) END AS source FROM q),
    a AS (SELECT query || '#0' AS query, query AS conv, 0 AS place, text, lang, NULL AS source, retrieve, retrieve AS keep FROM q
          UNION ALL SELECT p.query || '#' || p.place, p.query, p.place, p.text, lang, NULL, greatest(20, retrieve // 2), greatest(10, retrieve // 3) FROM parts p JOIN q ON q.query = p.query
          UNION ALL SELECT query || '#-1', query, -1, text, lang, f.source, retrieve, retrieve FROM q JOIN filters f USING (query) WHERE f.source IS NOT NULL),
    {_index('a')}, {_base('a', '(q.lang IS NULL OR d.lang = q.lang) AND (q.source IS NULL OR d.source = q.source)')},
    found AS (SELECT a.conv AS query, place, b.doc, b.rank FROM base b JOIN a USING (query) WHERE b.rank < keep),
    first1 AS (SELECT query, doc, sum(round_even(1e7 / (61.0e0 + rank), 0)::BIGINT)::BIGINT AS score, min([place, rank]) AS seen FROM found WHERE place >= 0 GROUP BY query, doc),
    asked1 AS (SELECT query, doc, rank FROM {_limited('first1', 'q', 'score DESC, seen[1], seen[2], doc')}),
    second AS (SELECT query, doc, sum(round_even(1e7 / (61.0e0 + rank), 0)::BIGINT)::BIGINT AS score, min([place, rank]) AS seen FROM (SELECT query, 1 AS place, doc, rank FROM asked1 UNION ALL SELECT query, 0, doc, rank FROM found WHERE place = -1) GROUP BY query, doc),
    asked2 AS (SELECT query, doc, rank FROM {_limited('second', 'q', 'score DESC, seen[1], seen[2], doc')}),
    best AS (SELECT b.* FROM asked2 b JOIN q USING (query) WHERE rank < final),
    talk AS (SELECT conv_id AS query, turn, i - 1 AS rank, len(string_split(coalesce(text, ''), ' ')) * i % 97 AS doc FROM conversations, (SELECT unnest([1, 2, 3]) AS i) WHERE role = 'assistant'),
    earlier AS (SELECT query, doc, max(turn) AS turn, arg_min(rank, [-turn, rank]) AS rank FROM talk JOIN q USING (query) ANTI JOIN best USING (query, doc) GROUP BY query, doc),
    every AS (SELECT query, doc, false AS carried, 0 AS turn, rank FROM best UNION ALL SELECT query, doc, true, turn, rank FROM earlier)
    SELECT query, doc, place, carried FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY carried, turn DESC, rank, doc) - 1 AS place FROM every) JOIN q USING (query) WHERE place < greatest(12, final + 4)"""


@query(_SMART.replace("JOIN q USING (query) ANTI JOIN best USING (query, doc)", "SEMI JOIN q USING (query) ANTI JOIN best USING (query, doc)"))
def smart_retrieval_talks(spark, sf_dir):
    """Smart retrieval of all conversations: the question, its sentences, a list that a source helps, and sources carried over from the talk."""
    asks = _asks(spark, sf_dir)
    source = table(spark, sf_dir, "documents").agg(F.min("source")).first()[0]
    asks = asks.withColumn("source", F.when(F.col("query") % 3 == 0, F.lit(source)))
    split = F.slice(F.filter(F.transform(F.split("text", r"\."), lambda x: F.trim(x, F.lit(" \n"))), lambda x: F.length(x) >= 20), 1, 3)
    parts = asks.select("query", split.alias("p")).where(F.size("p") > 1).select("query", F.posexplode("p").alias("part", "text"))
    return hybrid.smart(_corpus(spark, sf_dir), asks, parts, _earlier(spark, sf_dir), ("lang",), ("source",), stemmed, 2)
