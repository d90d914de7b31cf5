"""Queries from rankings to evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import lexicon_da
from docketry.operators import answers as an
from docketry.operators import focus
from docketry.operators import rank as rk
from docketry.plans import ranking as r
from docketry.plans.registry import query, table
from docketry.sources.tables import stored


@query(f"WITH {r._BM25}, inside AS (SELECT b.* FROM bm25 b JOIN documents d ON d.doc_id = b.doc WHERE lang = 'en'), fused AS (SELECT query, doc, sum(round_even(1e7 / (61.0e0 + rank), 0)::BIGINT)::BIGINT AS score FROM (SELECT query, doc, rank FROM {r._ranked('bm25', 100)} UNION ALL SELECT query, doc, rank FROM {r._ranked('inside', 100)}) GROUP BY ALL) SELECT query, doc, score, rank FROM {r._ranked('fused', 15)}")
def smart_retrieval(spark, sf_dir):
    """A list of all and one of English texts fused, sizes by the pool."""
    docs = table(spark, sf_dir, "documents")
    retrieve, final = an.sizes(max(501, docs.count()), 60, 8)
    every, inside = (r.bm25(spark, sf_dir, retrieve, lang).select("query", "doc", "score") for lang in (None, "en"))
    return rk.top(rk.fuse([rk.top(every, retrieve), rk.top(inside, retrieve)]), final)


@query(f"WITH {r._BM25}, first_ AS (SELECT query, b.doc, b.rank, CASE WHEN b.doc % 3 <> 0 THEN n_chars % 97 END AS said FROM {r._ranked('bm25', 40)} b JOIN documents d ON d.doc_id = b.doc) SELECT query, doc, said, row_number() OVER (PARTITION BY query ORDER BY said DESC NULLS LAST, rank) - 1 AS rank FROM first_")
def rerank_candidates(spark, sf_dir):
    """A pluggable scorer over forty candidates; what it leaves out comes last."""
    chars = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "n_chars")
    first = rk.top(r.bm25(spark, sf_dir, 50), 50).join(chars, "doc")
    return an.reranked(first, lambda df: F.when(F.col("doc") % 3 != 0, F.col("n_chars") % 97)).select("query", "doc", "said", "rank")


@query(f"WITH {r._BM25}, hits AS (SELECT query, b.doc, b.rank, source, text FROM {r._ranked('bm25', 100)} b JOIN documents d ON d.doc_id = b.doc), each AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query, source ORDER BY rank) <= 2), kept AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS source_number FROM each QUALIFY source_number <= 12) SELECT query, doc, source_number, used FROM (SELECT *, (sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY query ORDER BY source_number) - 2)::BIGINT AS used FROM kept) WHERE used <= 12000")
def citation_context(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source", "text")
    hits = rk.top(r.bm25(spark, sf_dir, 100), 100).join(docs, "doc")
    return an.citation_context(hits, "source", "text").select("query", "doc", "source_number", "used")


@query()
def metadata_fields(spark, sf_dir):
    """Fields of the Danish lexicon, laws and years of construction of all texts."""
    return lexicon_da.metadata(table(spark, sf_dir, "documents"), ["doc_id"])


_CHUNKS = """
    words_ AS (SELECT query, doc, place, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f]+', ' ', 'g')), ' '), lambda w: w <> '') AS l FROM sources),
    starts AS (SELECT *, range(0, greatest(0, len(l) - 26) + 1, 95) AS s FROM words_ WHERE len(l) > 0),
    parts AS (SELECT query, doc, place, len(s) AS of_, generate_subscripts(s, 1) - 1 AS pos, array_to_string(l[unnest(s) + 1 : unnest(s) + 120], ' ') AS said FROM starts)"""
_GRAMS = "list_concat({0}, list_transform(range(1, len({0})), lambda k: {0}[k] || ' ' || {0}[k + 1]))"
_LOCAL_TFIDF = f"""
    said_ AS (SELECT query, place, pos, {r._TOK.format('said')} AS t FROM parts),
    lterm AS (SELECT query, place, pos, term, count(*) AS tf FROM (SELECT query, place, pos, unnest({_GRAMS.format('t')}) AS term FROM said_) GROUP BY ALL),
    ln_ AS (SELECT query, count(*) AS n FROM parts GROUP BY query),
    lidf AS (SELECT query, term, 1.0e0 + ln((1.0e0 + n) / (1.0e0 + df)) AS idf FROM (SELECT query, term, count(*) AS df FROM lterm GROUP BY ALL) JOIN ln_ USING (query)),
    qterm AS (SELECT query, term, (1.0e0 + ln(count(*))) * any_value(idf) AS q FROM (SELECT item_id AS query, unnest({_GRAMS.format('t')}) AS term FROM (SELECT item_id, {r._TOK.format('text')} AS t FROM benchmark)) JOIN lidf USING (query, term) GROUP BY query, term),
    held_ AS (SELECT query, place, pos, term, (1.0e0 + ln(tf)) * idf AS w FROM lterm JOIN lidf USING (query, term)),
    wlen AS (SELECT query, place, pos, sqrt(sum(round_even(w * w * 1e6, 0)::BIGINT) / 1e6) AS wl FROM held_ GROUP BY ALL),
    qlen_ AS (SELECT query, sqrt(sum(round_even(q * q * 1e6, 0)::BIGINT) / 1e6) AS ql FROM qterm GROUP BY query),
    dots AS (SELECT query, place, pos, sum(round_even(w * q * 1e7, 0)::BIGINT) AS dot FROM held_ JOIN qterm USING (query, term) GROUP BY ALL),
    marks AS (SELECT p.*, coalesce(round_even(dot / 10.0e0 / (wl * ql), 0)::BIGINT, 0) AS plain FROM parts p LEFT JOIN (dots JOIN wlen USING (query, place, pos) JOIN qlen_ USING (query)) USING (query, place, pos))"""
_FOCUS = f"""WITH {r._BM25}, sources AS (SELECT query, b.doc, rank AS place, text, '[Kilde ' || (rank + 1) || '] ' || source AS head FROM {r._ranked('bm25', 6)} b JOIN documents ON doc_id = b.doc), {_CHUNKS}, {_LOCAL_TFIDF},
    budget AS (SELECT query, 6000 - sum(length(head) + 2) AS total, count(*) AS heads FROM sources GROUP BY query),
    weighed AS (SELECT DISTINCT query, place, CASE WHEN place = 0 THEN 3 WHEN place < 3 THEN 2 ELSE 1 END AS part FROM parts),
    each_ AS (SELECT query, sum(part) AS parts_, count(*) AS n FROM weighed GROUP BY query),
    ranked_ AS (SELECT m.query, m.place, m.pos, m.doc, m.said, plain + CASE WHEN pos * 3 >= 2 * of_ THEN 50000 ELSE 0 END AS score, length(m.said) AS size, greatest(400, floor(total * part / parts_))::BIGINT AS share, greatest(400, floor(total / n))::BIGINT AS fair, total,
                       3 * CASE WHEN m.place = 0 THEN 3 WHEN m.place < 3 THEN 2 ELSE 1 END AS cap FROM marks m JOIN weighed USING (query, place) JOIN each_ USING (query) JOIN budget USING (query)),
    numbered AS (SELECT *, row_number() OVER o AS k, coalesce(sum(size + 7) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked_ WINDOW o AS (PARTITION BY query, place ORDER BY score DESC, pos)),
    able AS (SELECT *, share - before >= 200 AS first FROM numbered WHERE k <= cap AND (k = 1 OR score > 0)),
    per AS (SELECT query, place, coalesce(least(max(CASE WHEN first THEN before + size + 7 END), max(share)), 0)::BIGINT AS used, coalesce(list(size ORDER BY k) FILTER (NOT first), []) AS rest, max(fair) AS fair, max(total) AS total FROM able GROUP BY query, place),
    gathered AS (SELECT query, max(total)::BIGINT AS total, sum(used)::BIGINT AS spent, list({{'place': place, 'rest': rest, 'fair': fair}} ORDER BY place) AS s FROM per GROUP BY query),
    RECURSIVE_TURNS
    rooms AS (SELECT query, s[i].place AS place, room FROM turns),
    again AS (SELECT a.*, room, coalesce(sum(size + 7) OVER (PARTITION BY query, place ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM able a JOIN rooms USING (query, place) WHERE NOT first),
    taken AS (SELECT query, place, doc, pos, score, said, 1 AS turn, least(size, share - before) AS room FROM able WHERE first UNION ALL SELECT query, place, doc, pos, score, said, 2, least(size, room - gone) FROM again WHERE room - gone >= 200),
    shown AS (SELECT query, place, doc, pos, score, turn, CASE WHEN length(said) <= room THEN said ELSE regexp_replace(said[1:room::BIGINT], ' [^ ]*$', '') || ' …' END AS said FROM taken)"""
#: The second turn as a recursion over a query's sources: room and what is spent then.
_TURNS = """turns AS (
        SELECT query, total, spent, s, 0 AS i, 0::BIGINT AS room FROM gathered
        UNION ALL
        SELECT query, total, spent + least(list_reduce(list_concat([0::BIGINT], s[i + 1].rest), lambda a, c: CASE WHEN new_room - a >= 200 THEN a + c + 7 ELSE a END), new_room) AS spent, s, i + 1, new_room
        FROM (SELECT *, CASE WHEN total - spent < 300 THEN 0 ELSE least(total - spent, 2 * s[i + 1].fair) END::BIGINT AS new_room FROM turns) WHERE i < len(s)),"""


def _focus_parts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", "source")
    top = stored(rk.top(r.bm25(spark, sf_dir, 6), 6).select("query", F.col("rank").alias("place"), "doc"), "first").join(docs, "doc")
    head = F.concat(F.lit("[Kilde "), (F.col("place") + 1).cast("string"), F.lit("] "), F.col("source"))
    sources = top.withColumn("head", head)
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return sources, focus.focused(sources, questions, 6_000, F.col("head"), F.when(F.col("pos") * 3 >= 2 * F.col("of"), 50_000).otherwise(0))


_FOCUS = _FOCUS.replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_TURNS", _TURNS)


@query(f"{_FOCUS} SELECT query, place, doc, pos, score, turn, said FROM shown")
def focused_passages(spark, sf_dir):
    """The passages of six sources that make up an item's context of 6,000 characters."""
    return _focus_parts(spark, sf_dir)[1]


@query(f"{_FOCUS}, told AS (SELECT query, place, string_agg(said, chr(10) || '[…]' || chr(10) ORDER BY pos) AS told FROM shown GROUP BY query, place), blocks_ AS (SELECT s.query, s.place, head || coalesce(chr(10) || told, '') AS block FROM sources s LEFT JOIN told USING (query, place)) SELECT query, string_agg(block, chr(10) || chr(10) ORDER BY place) AS context FROM blocks_ GROUP BY query")
def focused_contexts(spark, sf_dir):
    """The context of each item, with the headings of its sources."""
    sources, taken = _focus_parts(spark, sf_dir)
    return focus.contexts(taken, sources)


def _scorer(batch):
    """A scorer that sees a batch: it refuses some, leaves out every third document and measures the others against the batch's least."""
    if batch["doc"].iloc[0] % 7 == 0:
        raise ValueError("no answer")
    value = batch["n_chars"] % 97
    return (value - value.min()).where(batch["doc"] % 3 != 0)


@query(f"""WITH {r._BM25}, first_ AS (SELECT query, b.doc, b.rank, n_chars % 97 AS v, count(*) OVER (PARTITION BY query) AS n FROM {r._ranked('bm25', 40)} b JOIN documents d ON d.doc_id = b.doc),
    held AS (SELECT *, unnest(range(greatest(0, ceil((rank - 13) / 7.0)::BIGINT), greatest(greatest(0, ceil((rank - 13) / 7.0)::BIGINT), least(rank // 7, ceil(greatest(0, n - 14) / 7.0)::BIGINT)) + 1)) AS batch FROM first_),
    told AS (SELECT *, v - min(v) OVER (PARTITION BY query, batch) AS points, first_value(doc) OVER (PARTITION BY query, batch ORDER BY rank) % 7 = 0 AS refused FROM held),
    best AS (SELECT query, doc, min(rank) AS was, max(CASE WHEN NOT refused AND doc % 3 <> 0 THEN points END)::DOUBLE AS score FROM told GROUP BY query, doc)
    SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC NULLS LAST, was) - 1 AS rank FROM best""")
def rerank_batches(spark, sf_dir):
    """Forty candidates scored in batches of 14, each seven after the one before: a candidate's best score counts."""
    from docketry.operators import hybrid

    chars = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "n_chars")
    return hybrid.batched(rk.top(r.bm25(spark, sf_dir, 40), 40).join(chars, "doc"), _scorer, ["n_chars"], 40, 14, 7)
