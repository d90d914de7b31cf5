"""The search chain without a language model: words of the board for the user's, a lexical base, direct matches of what is quoted
or numbered, paragraphs, metadata, features, and the decision that is asked for by number.

Every stage takes and gives rankings (query, doc, rank), ranks from 0, for all queries at once; it moves candidates and adds
none but direct matches. Scores are whole numbers, ties go by the rank before, so results don't depend on how rows are dealt out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import danish
from docketry.functions import lexicon_da as lex
from docketry.functions.text import folded, quoted
from docketry.operators import index as ix
from docketry.operators import lookups as lk
from docketry.operators import paragraphs as pg
from docketry.operators.rank import exact_scores, fuse, top
from docketry.sources.tables import stored


@dataclass
class Corpus:
    """docs: doc, number, link, title, text; weights and rarities of its TF-IDF index; features: doc, field, value."""

    docs: DataFrame
    weights: DataFrame
    rarities: DataFrame
    features: DataFrame


def features(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, field, value): the lexicon's labels, laws and years of construction that a text shows."""
    said = df.select(F.col(key), F.col(text).alias("__said"))
    row = lambda field, values: F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.cast("string").alias("value")))
    told = said.select(key, F.explode(F.concat(row("laws", lex.laws(F.col("__said"))), row("construction_years", lex.years(F.col("__said"))))).alias("x")).select(key, "x.*")
    return lex.label_rows(df, key, text).withColumnRenamed("label", "value").unionByName(told)


def corpus(docs: DataFrame) -> Corpus:
    """A corpus with its index and its features, written for the searches to come."""
    weights, rarities = ix.tfidf(ix.build(docs, "doc"))
    return Corpus(docs, stored(ix.laid_out(weights), "weights"), stored(rarities, "rarities"), stored(features(docs, "doc"), "features"))


def asked(queries: DataFrame) -> DataFrame:
    """(query, text, planned, kind, identifiers, phrases): the text with the board's words, and as the planner widens it; what
    kind of search that is, and what it names."""
    said = queries.select("query", danish.expanded(F.col("text")).alias("text"))
    plan = said.withColumn("planned", danish.query_plan(F.col("text"))["expanded"])
    inner = F.col("planned")
    return plan.select("query", "text", "planned", danish.intent(inner)["intent"].alias("kind"), F.transform(danish.identifiers(inner), F.lower).alias("identifiers"), F.transform(quoted(inner), F.lower).alias("phrases"))


def reordered(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, ties by the rank before."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rank", "doc")
    return scores.withColumn("__new", (F.row_number().over(order) - 1).cast("long")).where(F.col("__new") < k).select("query", "doc", F.col("__new").alias("rank"))


def direct(at: Corpus, found: DataFrame, k: int) -> DataFrame:
    """Decisions that hold what searches for exact words or for a number name, by points."""
    mine = found.where(F.col("kind").isin("exact", "specific"))
    by_number = lk.exact_points(at.docs, mine.select("query", F.explode("identifiers").alias("identifier")), "number", "link", "title")
    said = at.docs.select("doc", folded(F.concat_ws(" ", "title", "text")).alias("said"))
    by_phrase = exact_scores(said, mine.select("query", F.explode("phrases").alias("phrase"))).select("query", "doc", F.col("score").cast("long").alias("score"))
    return top(by_number.unionByName(by_phrase).groupBy("query", "doc").agg(F.sum("score").alias("score")), k)


def routed(base: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The base with direct matches, which count twice, where there are any."""
    some = hits.select("query").distinct()
    mine = base.join(some, "query", "left_semi")
    others = base.join(some, "query", "left_anti").select("query", "doc", "rank")
    return others.unionByName(top(fuse([hits, hits, mine], 20), k).select("query", "doc", "rank"))


def _shared(ranking: DataFrame, wanted: DataFrame, held: DataFrame, weights: int) -> DataFrame:
    """(query, doc, field, value, weight): features of queries that their candidates have."""
    table = F.create_map(*(F.lit(x) for field, w in lex.WEIGHTS.items() for x in (field, w[weights])))
    both = ranking.select("query", "doc").join(wanted, "query").join(held, ["doc", "field", "value"])
    return both.select("query", "doc", "field", "value", F.coalesce(F.try_element_at(table, "field"), F.lit(1.0)).alias("weight"))


def by_metadata(ranking: DataFrame, wanted: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """1 / (20 + rank) and 0.004 for each point of weight shared, ten at most; queries without features stay as they are."""
    points = _shared(ranking, wanted, held, 1).groupBy("query", "doc").agg(F.sum("weight").alias("overlap"))
    scored = ranking.join(points, ["query", "doc"], "left")
    score = ix.fixed(1.0 / (20 + F.col("rank")) + F.least(F.coalesce("overlap", F.lit(0.0)), F.lit(10.0)) * F.lit(0.004))
    return reordered(scored.withColumn("score", score), k)


def by_features(ranking: DataFrame, wanted: DataFrame, held: DataFrame, k: int, strength: float = 0.12) -> DataFrame:
    """1 / (rank + 1) and a share of the weights of features shared, rarer ones among the query's candidates counting more."""
    pool = ranking.groupBy("query").agg(F.count(F.lit(1)).cast("double").alias("of"))
    shared = _shared(ranking, wanted, held, 2)
    seen = shared.groupBy("query", "field", "value").agg(F.count(F.lit(1)).alias("df"))
    rare = F.col("weight") * (1.0 + F.ln((F.col("of") + 1.0) / (F.col("df") + 1.0)))
    points = shared.join(seen, ["query", "field", "value"]).join(pool, "query").groupBy("query", "doc").agg(F.sum(ix.fixed(rare)).alias("bonus"))
    scored = ranking.join(points, ["query", "doc"], "left")
    score = ix.fixed(1.0 / (F.col("rank") + 1.0)) + F.bround(F.coalesce("bonus", F.lit(0)) * F.lit(strength), 0).cast("long")
    return reordered(scored.withColumn("score", score), k)


def specific(ranking: DataFrame, found: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Of a search by number the decisions that the number names, if there are any; else all."""
    wanted = found.where("kind = 'specific'").select("query", F.explode("identifiers").alias("identifier"))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    named = ranking.join(wanted, "query").join(docs.select("doc", "number", "link", "title"), "doc")
    hit = named.where(F.contains(low("number"), F.col("identifier")) | F.contains(low("link"), F.col("identifier")) | F.contains(low("title"), F.col("identifier"))).select("query", "doc").distinct()
    kept = ranking.join(hit, ["query", "doc"], "left_semi").unionByName(ranking.join(hit.select("query").distinct(), "query", "left_anti").select("query", "doc", "rank"))
    return reordered(kept.withColumn("score", F.lit(0)), k)


def search(at: Corpus, queries: DataFrame, k: int = 20, retrieve: int = 100, dense: DataFrame | None = None, keep: Column | None = None) -> DataFrame:
    """(query, doc, rank): the chain for all queries; with a dense ranking both are fused in the end. keep: the decisions to
    search among. A stage's ranking has ``retrieve`` rows a query at most and is written, as later stages read it several times."""
    docs = at.docs if keep is None else at.docs.where(keep)
    found = stored(asked(queries), "asked")
    weights = at.weights if keep is None else at.weights.join(docs.select("doc"), "doc", "left_semi")
    terms = ix.query_terms(found, "query", "planned")
    base = stored(top(ix.tfidf_scores(weights, at.rarities, terms), retrieve).select("query", "doc", "rank"), "base")
    hits = stored(direct(Corpus(docs, weights, at.rarities, at.features), found, retrieve).select("query", "doc", "rank"), "direct")
    ranking = stored(routed(base, hits, retrieve), "routed")
    exact = found.where("kind = 'exact'").select("query")
    ranking = stored(pg.refined(ranking, docs, ix.query_terms(found, "query", "text"), exact, retrieve, doc="doc").select("query", "doc", "rank"), "refined")
    wanted = stored(features(found, "query"), "wanted")
    ranking = stored(by_metadata(ranking, wanted, at.features, retrieve), "by-metadata")
    ranking = stored(by_features(ranking, wanted, at.features, retrieve), "by-features")
    ranking = specific(ranking, found, docs, k)
    return ranking if dense is None else top(fuse([ranking, dense], 60), k).select("query", "doc", "rank")
