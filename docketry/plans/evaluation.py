"""Evaluation queries. The runs are the BM25 and the TF-IDF lists of ``benchmark`` items; judgements come from ``labels``: a
document of the source that goes with a query is relevant (2 good, 1 poor, 0 toxic)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import evaluate as ev
from docketry.operators import rank as rk
from docketry.plans import ranking as r
from docketry.plans.registry import query, table


def qrels(spark, sf_dir):
    docs, labels, items = (table(spark, sf_dir, t) for t in ("documents", "labels", "benchmark"))
    rel = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    known = docs.select("doc_id", "source").join(labels, "doc_id")
    return known.join(items.select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source")), "source").select(F.col("item_id").alias("query"), F.col("doc_id").alias("doc"), rel.alias("rel"))


_QRELS = "qrels AS (SELECT item_id AS query, d.doc_id AS doc, CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS rel FROM documents d JOIN labels USING (doc_id) JOIN benchmark ON d.source = 'src' || (item_id % 20)::VARCHAR)"
_RUNS = f"{r._BM25}, {r._TFIDF.replace(r._POST + ',', '')}, base AS {r._ranked('bm25', 20)}, cand AS {r._ranked('tfidf', 20)}, {_QRELS}"


def _graded(run: str) -> str:
    return f"""(SELECT query, round_even(dcg / ideal, 6) AS ndcg, round_even(known::DOUBLE / shown, 6) AS judged, first, round_even(CASE WHEN known > 0 THEN good::DOUBLE / known END, 6) AS precision
      FROM (SELECT query, sum((pow(2.0e0, coalesce(rel, 0)) - 1) / log2(rank + 2)) AS dcg, count(rel) AS known, count(*) AS shown, coalesce(sum((rel > 0)::INT), 0) AS good, min(CASE WHEN rel > 0 THEN rank + 1 END) AS first FROM {run} LEFT JOIN qrels USING (query, doc) WHERE rank < 10 GROUP BY query)
      LEFT JOIN (SELECT query, sum((pow(2.0e0, rel) - 1) / log2(place + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rel DESC, doc) AS place FROM qrels WHERE rel > 0 QUALIFY place <= 10) GROUP BY query) USING (query))"""


def _binary(run: str) -> str:
    cuts = ", ".join(f"round_even(coalesce(h{c}, 0)::DOUBLE / wanted, 6) AS recall_{c}" for c in (5, 10, 20))
    sums = ", ".join(f"sum((rank < {c})::INT) AS h{c}" for c in (5, 10, 20))
    return f"(SELECT query, {cuts}, round_even(coalesce(1.0e0 / (lead_ + 1), 0), 6) AS rr FROM (SELECT query, count(*) AS wanted FROM qrels WHERE rel > 0 GROUP BY query) LEFT JOIN (SELECT query, {sums}, min(rank) AS lead_ FROM {run} JOIN qrels USING (query, doc) WHERE rel > 0 GROUP BY query) USING (query))"


def base_run(spark, sf_dir):
    return rk.top(r.bm25(spark, sf_dir, 20), 20)


def both_runs(spark, sf_dir):
    """The two runs, made in one pass over the texts and written once."""
    return r.both(spark, sf_dir, 20)


@query(f"WITH {_RUNS} SELECT * FROM {_binary('base')}")
def eval_binary(spark, sf_dir):
    return ev.binary(base_run(spark, sf_dir), qrels(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT * FROM {_graded('base')}")
def eval_graded_judged(spark, sf_dir):
    return ev.graded(base_run(spark, sf_dir), qrels(spark, sf_dir))


@query(f"WITH {_RUNS}, topics AS (SELECT query % 10 AS topic, query % 2 AS split, avg(rr) AS rr FROM {_binary('base')} GROUP BY ALL) SELECT split, count(*) AS topics, round_even(avg(rr), 6) AS rr FROM topics GROUP BY split")
def macro_topic_avg(spark, sf_dir):
    """Queries averaged to topics, topics to splits."""
    per = ev.binary(base_run(spark, sf_dir), qrels(spark, sf_dir))
    topics = per.groupBy((F.col("query") % 10).alias("topic"), (F.col("query") % 2).alias("split")).agg(F.avg("rr").alias("rr"))
    return topics.groupBy("split").agg(F.count(F.lit(1)).alias("topics"), F.bround(F.avg("rr"), 6).alias("rr"))


def _means(run: str) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, round_even(avg({m}), 6) AS value FROM {_binary(run)}" for m in ("recall_5", "recall_10", "recall_20", "rr"))


def means(per):
    """(metric, value), nulls left out of the means."""
    names = ["recall_5", "recall_10", "recall_20", "rr"]
    return per.agg(*(F.bround(F.avg(m), 6).alias(m) for m in names)).unpivot([], names, "metric", "value")


@query(f"WITH {_RUNS}, a AS ({_means('base')}), b AS ({_means('cand')}) SELECT metric, a.value AS base, b.value AS candidate, coalesce(b.value - a.value >= -(CASE metric WHEN 'recall_20' THEN 0.02e0 ELSE 0.03e0 END + 1e-12), false) AS passed FROM a FULL JOIN b USING (metric)")
def regression_gate(spark, sf_dir):
    judged = qrels(spark, sf_dir)
    return ev.gate(*(means(ev.binary(run, judged)) for run in both_runs(spark, sf_dir)))


@query(f"WITH {_RUNS}, a AS {_graded('base')}, b AS {_graded('cand')} SELECT sum((b.ndcg - a.ndcg > 1e-12)::INT)::BIGINT AS win, sum((abs(b.ndcg - a.ndcg) <= 1e-12)::INT)::BIGINT AS tie, sum((b.ndcg - a.ndcg < -1e-12)::INT)::BIGINT AS loss FROM a JOIN b USING (query)")
def win_tie_loss(spark, sf_dir):
    judged = qrels(spark, sf_dir)
    a, b = (ev.graded(run, judged).select("query", "ndcg") for run in both_runs(spark, sf_dir))
    d = F.col("other") - F.col("ndcg")
    n = lambda c: F.sum(c.cast("int"))
    return a.join(b.withColumnRenamed("ndcg", "other"), "query").agg(n(d > 1e-12).alias("win"), n(F.abs(d) <= 1e-12).alias("tie"), n(d < -1e-12).alias("loss"))


_CHANGES = """sides AS (SELECT query, doc, sum(s) AS s FROM (SELECT query, doc, 1 AS s FROM base UNION ALL SELECT query, doc, 2 FROM cand) GROUP BY ALL),
    counts AS (SELECT query, sum((s = 1)::INT)::BIGINT AS missing, sum((s = 2)::INT)::BIGINT AS extra FROM sides GROUP BY query),
    firsts AS (SELECT query, min(CASE WHEN a.doc IS DISTINCT FROM b.doc THEN rank + 1 END) AS first_different FROM (SELECT query, rank, doc FROM base) a FULL JOIN (SELECT query, rank, doc FROM cand) b USING (query, rank) GROUP BY query)"""


@query(f"WITH {_RUNS}, {_CHANGES} SELECT query, missing, extra, first_different FROM counts JOIN firsts USING (query)")
def run_reproducibility(spark, sf_dir):
    return ev.run_changes(*both_runs(spark, sf_dir))


@query(f"WITH {_RUNS}, {_CHANGES} SELECT count(*) AS queries, sum((first_different IS NOT NULL)::INT)::BIGINT AS changed, sum((extra > 5)::INT)::BIGINT AS violations FROM counts JOIN firsts USING (query)")
def planner_effect(spark, sf_dir):
    changes = ev.run_changes(*both_runs(spark, sf_dir))
    return changes.agg(F.count(F.lit(1)).alias("queries"), F.sum(F.col("first_different").isNotNull().cast("int")).alias("changed"), F.sum((F.col("extra") > 5).cast("int")).alias("violations"))


@query(f"WITH {_RUNS} SELECT query, doc, string_agg(DISTINCT system, ',' ORDER BY system) AS systems, min(rank) + 1 AS best, sha256('pool|' || query || '|' || doc) AS blind FROM (SELECT query, doc, rank, 'bm25' AS system FROM base WHERE rank < 10 UNION ALL SELECT query, doc, rank, 'tfidf' FROM cand WHERE rank < 10) GROUP BY query, doc")
def blind_pool(spark, sf_dir):
    return ev.pool(dict(zip(("bm25", "tfidf"), both_runs(spark, sf_dir), strict=True)), 10, "pool")


@query("WITH said AS (SELECT lang, quality = 1 AS truth, n_chars >= 500 AS said FROM documents JOIN labels USING (doc_id)), n AS (SELECT lang, sum((truth AND said)::INT)::BIGINT AS tp, sum((NOT truth AND said)::INT)::BIGINT AS fp, sum((truth AND NOT said)::INT)::BIGINT AS fn FROM said GROUP BY lang) SELECT *, round_even(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round_even(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall FROM n")
def role_confusion(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return ev.confusion(both, F.col("quality") == 1, F.col("n_chars") >= 500, "lang")


@query("WITH said AS (SELECT CASE WHEN toxic = 1 THEN 'unsupported' WHEN quality = 1 THEN 'supported' ELSE 'partly' END AS verdict, source FROM labels JOIN documents USING (doc_id)) SELECT source, count(*) AS claims, sum((verdict = 'supported')::INT)::BIGINT AS supported, sum((verdict = 'partly')::INT)::BIGINT AS partly, sum((verdict = 'unsupported')::INT)::BIGINT AS unsupported, round_even(100.0e0 * sum((verdict = 'supported')::INT) / count(*), 1) AS share FROM said GROUP BY source")
def verdict_tally(spark, sf_dir):
    """Verdicts with their other names read as the three known ones, anything else as unsupported."""
    said = F.when(F.col("toxic") == 1, "no").when(F.col("quality") == 1, "fully supported").otherwise("partial")
    names = F.create_map(*(F.lit(x) for pair in {"supported": "supported", "fully supported": "supported", "partly": "partly", "partial": "partly"}.items() for x in pair))
    verdict = F.coalesce(F.try_element_at(names, said), F.lit("unsupported"))
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").withColumn("verdict", verdict)
    n = lambda v: F.sum((F.col("verdict") == v).cast("int"))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("claims"), n("supported").alias("supported"), n("partly").alias("partly"), n("unsupported").alias("unsupported"), F.bround(n("supported") * 100.0 / F.count(F.lit(1)), 1).alias("share"))


@query("WITH seen AS (SELECT lang, avg((quality = 1)::INT) AS recall FROM documents JOIN labels USING (doc_id) GROUP BY lang), prior AS (SELECT lang, count(*)::DOUBLE AS prior FROM documents GROUP BY lang) SELECT round_even(sum(prior / (SELECT sum(prior) FROM prior) * recall), 6) AS accuracy, round_even(avg(recall), 6) AS macro FROM seen JOIN prior USING (lang)")
def prior_weighted_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    seen = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.avg((F.col("quality") == 1).cast("int")).alias("recall"))
    prior = docs.groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("prior"))
    total = docs.where("lang is not null").count()
    return seen.join(prior, "lang").agg(F.bround(F.sum(F.col("prior") / F.lit(float(total or 1)) * F.col("recall")), 6).alias("accuracy"), F.bround(F.avg("recall"), 6).alias("macro"))


@query("WITH key_ AS (SELECT doc_id, substr(sha256('ab' || doc_id), 1, 1) < '8' AS swapped FROM labels), votes AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'A' WHEN toxic = 1 THEN 'tie' ELSE 'B' END AS vote FROM labels) SELECT CASE WHEN vote = 'tie' THEN 'tie' WHEN (vote = 'A') <> swapped THEN 'first' ELSE 'second' END AS winner, count(*) AS n FROM votes JOIN key_ USING (doc_id) GROUP BY ALL")
def ab_tally(spark, sf_dir):
    """Blind votes read through the key that says which side was which."""
    labels = table(spark, sf_dir, "labels")
    key = labels.select("doc_id", (F.substring(F.sha2(F.concat(F.lit("ab"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 1) < "8").alias("swapped"))
    votes = labels.select("doc_id", F.when(F.col("quality") == 1, "A").when(F.col("toxic") == 1, "tie").otherwise("B").alias("vote"))
    winner = F.when(F.col("vote") == "tie", "tie").when((F.col("vote") == "A") != F.col("swapped"), "first").otherwise("second")
    return votes.join(key, "doc_id").groupBy(winner.alias("winner")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, round_even(avg(TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS DOUBLE)), 2) AS mean, count(*) AS reviews FROM events GROUP BY event_type")
def mean_review(spark, sf_dir):
    """Means of scores given as text; what isn't a number is left out."""
    said = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.bround(F.avg(said.try_cast("double")), 2).alias("mean"), F.count(F.lit(1)).alias("reviews"))


@query("SELECT source, count(*) AS n, sha256(string_agg(sha256('{\"doc_id\":' || doc_id || ',\"n_chars\":' || n_chars || '}'), ',' ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def row_digest(spark, sf_dir):
    """A digest of each source's rows, in the order of their ids, over digests of canonical JSON."""
    one = F.sha2(F.to_json(F.struct("doc_id", "n_chars")).cast("binary"), 256)
    rows = table(spark, sf_dir, "documents").select("source", F.struct("doc_id", one.alias("d")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.d), ",")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sha2(joined.cast("binary"), 256).alias("digest"))


@query("WITH bad AS (SELECT item_id, 'too long' AS error FROM benchmark WHERE length(text) > 250 UNION ALL SELECT item_id, 'repeated' FROM benchmark QUALIFY count(*) OVER (PARTITION BY split_part(text, ' ', 1)) > 1 UNION ALL SELECT item_id, 'too many words' FROM benchmark WHERE len(regexp_extract_all(lower(text), '[a-zæøå0-9]+')) > 40) SELECT item_id, error FROM bad")
def spec_validation(spark, sf_dir):
    """Violations of a query set's rules, one row each."""
    from functools import reduce

    from pyspark.sql import DataFrame, Window

    from docketry.functions.text import tokens

    items = table(spark, sf_dir, "benchmark").withColumn("same", F.count(F.lit(1)).over(Window.partitionBy(F.substring_index("text", " ", 1))))
    rules = {"too long": F.length("text") > 250, "repeated": F.col("same") > 1, "too many words": F.size(tokens(F.col("text"))) > 40}
    return reduce(DataFrame.unionByName, [items.where(c).select("item_id", F.lit(e).alias("error")) for e, c in rules.items()])


@query(f"""WITH {_RUNS}, strength AS (SELECT unnest([0.0e0, 0.02e0, 0.05e0, 0.08e0, 0.12e0]) AS s), moved AS (SELECT s, query, doc, row_number() OVER (PARTITION BY s, query ORDER BY round_even((1.0e0 / (rank + 1) + s * matched) * 1e7, 0) DESC, doc) - 1 AS rank FROM base, strength)
    SELECT s AS strength, round_even(avg(CASE WHEN lead_ IS NULL THEN 0 ELSE 1.0e0 / (lead_ + 1) END), 6) AS rr FROM (SELECT s, query, min(CASE WHEN rel > 0 THEN rank END) AS lead_ FROM moved LEFT JOIN qrels USING (query, doc) GROUP BY s, query) GROUP BY s""")
def rerank_sweep(spark, sf_dir):
    """The mean reciprocal rank for each strength of a rerank."""
    from pyspark.sql import Window

    from docketry.operators.index import fixed

    each = base_run(spark, sf_dir).withColumn("strength", F.explode(F.array(*map(F.lit, (0.0, 0.02, 0.05, 0.08, 0.12)))))
    order = Window.partitionBy("strength", "query").orderBy(F.desc(fixed(1.0 / (F.col("rank") + 1) + F.col("strength") * F.col("matched"))), "doc")
    moved = each.withColumn("rank", F.row_number().over(order) - 1).join(qrels(spark, sf_dir), ["query", "doc"], "left")
    lead = moved.groupBy("strength", "query").agg(F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("lead"))
    return lead.groupBy("strength").agg(F.bround(F.avg(F.coalesce(1.0 / (F.col("lead") + 1), F.lit(0.0))), 6).alias("rr"))


@query(f"WITH {_RUNS}, fused AS (SELECT query, doc, sum(w)::BIGINT AS score FROM (SELECT query, doc, round_even(1e7 / (61.0e0 + rank), 0)::BIGINT AS w FROM base UNION ALL SELECT query, doc, round_even(1e7 / (61.0e0 + rank), 0)::BIGINT FROM cand) GROUP BY ALL) SELECT 'lexical' AS stage, query, rank, doc FROM base UNION ALL SELECT 'weights', query, rank, doc FROM cand UNION ALL SELECT 'fused', query, rank, doc FROM {r._ranked('fused', 20)}")
def stage_trace(spark, sf_dir):
    """What each stage of a chain of rankings returned."""
    a, b = both_runs(spark, sf_dir)
    stages = {"lexical": a, "weights": b, "fused": rk.top(rk.fuse([a, b]), 20)}
    parts = [x.select(F.lit(name).alias("stage"), "query", "rank", "doc") for name, x in stages.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {r._EXACT}, {r._POST}, terms_in AS (SELECT query, doc, count(*) AS terms FROM post JOIN terms USING (term) GROUP BY ALL), judged AS (SELECT t.query, t.doc, least(t.terms, 12) * 0.5e0 + coalesce(e.score, 0) / 60.0e0 - CASE WHEN n_chars < 200 THEN 3.0e0 ELSE 0.0e0 END AS points FROM terms_in t LEFT JOIN exact e USING (query, doc) JOIN documents d ON d.doc_id = t.doc) SELECT query, doc, CASE WHEN points >= 8 THEN 2 WHEN points >= 3.5 THEN 1 WHEN points > -2.5 THEN 0 ELSE -1 END AS relevance, round_even(least(0.99e0, 0.5e0 + abs(points) / 20), 6) AS confidence FROM judged")
def relevance_bootstrap(spark, sf_dir):
    """Judgements by rule: points for the query's words and sentences, fewer for very short texts; thresholds 8, 3.5, -2.5."""
    items = r.items(spark, sf_dir)
    terms = r.posted(spark, sf_dir, items).join(items, "term").groupBy("query", "doc").agg(F.count(F.lit(1)).alias("terms"))
    exact = rk.exact_scores(r.plain(spark, sf_dir), r.phrases(spark, sf_dir))
    both = terms.join(exact, ["query", "doc"], "left").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "n_chars"), "doc")
    points = F.least("terms", F.lit(12)) * 0.5 + F.coalesce("score", F.lit(0)) / 60.0 - F.when(F.col("n_chars") < 200, 3.0).otherwise(0.0)
    told = both.withColumn("points", points)
    relevance = F.when(F.col("points") >= 8, 2).when(F.col("points") >= 3.5, 1).when(F.col("points") > -2.5, 0).otherwise(-1)
    return told.select("query", "doc", relevance.alias("relevance"), F.bround(F.least(F.lit(0.99), 0.5 + F.abs("points") / 20), 6).alias("confidence"))
