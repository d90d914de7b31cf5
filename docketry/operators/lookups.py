"""Lookups and joins that go by more than one key, phrases in paragraphs, sources of answers, folders, reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import folded
from docketry.operators.ordered import first_per_group


def found(wanted: DataFrame, rows: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """wanted (column ``key``) with the row that the first of several keys names; of several rows of a key the first in order."""
    named = rows.select(F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), k.alias("key")) for i, k in enumerate(keys)))).alias("__k"), F.struct(*rows.columns).alias("row"), F.col(order).alias("__order"))
    named = named.select("__k.*", "row", "__order").where("key is not null and key <> ''")
    best = wanted.select("key").distinct().join(named, "key").groupBy("key").agg(F.min_by("row", F.struct("rank", "__order")).alias("row"))
    return wanted.join(best, "key", "left").select(*wanted.columns, "row.*")


def judged_by_any(results: DataFrame, keys: Column, judgements: DataFrame, place: str, key: str) -> DataFrame:
    """results with the first judgement, by its place, that any of their keys meets; results without one are left out."""
    each = results.withColumn("__key", F.explode(F.array_distinct(keys)))
    met = each.join(judgements.withColumnRenamed(key, "__key"), "__key").drop("__key")
    return first_per_group(met, results.columns, [place], 1).drop("place") if place != "place" else met


def phrase_hits(units: DataFrame, phrases: DataFrame, limit: int = 20) -> DataFrame:
    """(query, unit, matches, longest, rank): texts that hold phrases, those with more of them first, then with longer ones,
    then shorter texts. units: (unit, said), phrases: (query, phrase); both folded.

    A phrase of three words or more is looked for by the longest of its inner words, which must stand whole in the text; a
    shorter one by comparing the texts with those phrases, which are broadcast as their number is a query's.
    """
    wanted = phrases.where("phrase <> ''").distinct().withColumn("words", F.split("phrase", " "))
    inner = F.slice("words", F.lit(2), F.greatest(F.size("words") - 2, F.lit(0)))
    longest = F.array_sort(inner, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))
    keyed = wanted.withColumn("word", F.get(longest, 0))
    words = units.select("unit", F.explode(F.array_distinct(F.split("said", " "))).alias("word"))
    pairs = words.join(keyed.where("word is not null").select("query", "phrase", "word"), "word").select("query", "phrase", "unit")
    long = pairs.join(units, "unit").where(F.contains("said", F.col("phrase"))).select("query", "unit", "phrase", F.length("said").alias("size"))
    short = units.join(F.broadcast(keyed.where("word is null").select("query", "phrase")), F.contains(F.col("said"), F.col("phrase"))).select("query", "unit", "phrase", F.length("said").alias("size"))
    hits = long.unionByName(short).groupBy("query", "unit").agg(F.count(F.lit(1)).alias("matches"), F.max(F.length("phrase")).cast("long").alias("longest"), F.max("size").alias("size"))
    ranked = first_per_group(hits, ["query"], [F.desc("matches"), F.desc("longest"), "size", "unit"], limit)
    return ranked.select("query", "unit", "matches", "longest", F.col("place").alias("rank"))


def exact_points(rows: DataFrame, queries: DataFrame, number: str, link: str, title: str, same: int = 400, within: int = 180) -> DataFrame:
    """(query, doc, score): points for identifiers that are a row's case number, or stand in its number, link or title.
    queries: (query, identifier), a stated set that is broadcast and compared with every row's short fields."""
    wanted = F.broadcast(queries.where("identifier <> ''").distinct())
    n, low = F.lower(F.trim(F.col(number))), lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    named = F.contains(n, F.col("identifier")) | F.contains(low(link), F.col("identifier")) | F.contains(low(title), F.col("identifier"))
    hit = rows.join(wanted, (n == F.col("identifier")) | named)
    return hit.groupBy("query", "doc").agg(F.sum(F.when(n == F.col("identifier"), same).otherwise(within)).cast("long").alias("score"))


def numbered_context(hits: DataFrame, sources: DataFrame, label: Column, text: str, each: int = 3, budget: int = 14_000) -> DataFrame:
    """(query, doc, place, number, block, used): paragraphs as blocks "[Kilde number] label", ``each`` of a source, in the order of
    their rank, until one doesn't fit the budget. hits: (query, doc, rank, text); sources: (query, doc, number)."""
    both = hits.join(sources, ["query", "doc"])
    mine = first_per_group(both, ["query", "doc"], ["rank"], each).drop("place")
    block = F.concat(F.lit("[Kilde "), F.col("number").cast("string"), F.lit("] "), label, F.lit("\n"), F.col(text))
    w = Window.partitionBy("query").orderBy("rank")
    used = F.sum(F.length("block") + 2).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 2
    return mine.withColumn("block", block).withColumn("used", used).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("used") <= budget).select("query", "doc", "place", "number", "block", "used")


def grounding_budget(documents: Column) -> Column:
    """(each, total): characters for a document's core and for all."""
    each = F.greatest(F.lit(550), F.least(F.lit(1400), F.floor(12_000 / documents).cast("int")))
    return F.when(documents <= 0, F.struct(F.lit(0).alias("each"), F.lit(0).alias("total"))).otherwise(F.struct(each.alias("each"), F.least(F.lit(18_000), 500 + documents * (each + 180)).cast("int").alias("total")))


def grounding_blocks(cores: DataFrame, group: str, order: str, text: str, lead: tuple[int, ...] = (4000, 2200, 2200), intro: int = 100) -> DataFrame:
    """(group, place, size, used): cores cut to their budget (the first ones' a larger one), until one doesn't fit the total.
    A block has a head of 40 characters and a blank line before it; ``intro`` characters come first."""
    w = Window.partitionBy(group)
    numbered = cores.withColumn("place", F.row_number().over(w.orderBy(order)).cast("int")).withColumn("b", grounding_budget(F.count(F.lit(1)).over(w)))
    allowed = F.greatest(F.col("b.each"), F.coalesce(F.get(F.array(*map(F.lit, lead)), F.col("place") - 1), F.lit(0)))
    sized = numbered.withColumn("size", F.least(F.length(text), allowed) + 42)
    used = intro + F.sum("size").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sized.withColumn("used", used).where(F.col("used") <= F.col("b.total")).select(group, "place", "size", "used")


def folders_without(folders: DataFrame, folder: Column) -> DataFrame:
    """Folders (id, name, default) less one; was it the default, the first of the others is."""
    left = folders.where(~folder)
    first = left.agg(F.min("id").alias("__first"), F.coalesce(F.max(F.col("default").cast("int")), F.lit(0)).alias("__has"))
    # One row: the first folder, and whether there is a default.
    return left.join(F.broadcast(first)).withColumn("default", F.when(F.col("__has") == 1, F.col("default")).otherwise(F.col("id") == F.col("__first"))).drop("__first", "__has")


def first_folder(items: DataFrame, folder: str, link: str, place: str) -> DataFrame:
    """(link, folder, folders): the first folder that each link is saved in, and how many."""
    return items.groupBy(link).agg(F.min_by(folder, F.struct(place, folder)).alias(folder), F.countDistinct(folder).alias("folders"))


def review_faults(reviews: DataFrame, source: DataFrame, key: str, label: str, reviewer: str, labels: tuple[str, ...]) -> DataFrame:
    """(key, fault): what keeps a review from being frozen."""
    said, blank = F.lower(F.trim(F.coalesce(F.col(label), F.lit("")))), lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    checks = [("missing label", said == ""), ("unknown label", (said != "") & ~said.isin(*labels)), ("missing reviewer", (said != "") & blank(reviewer))]
    own = reviews.select(key, F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks)))).alias("fault"))
    twice = reviews.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate").alias("fault"))
    alien = reviews.join(source, key, "left_anti").select(key, F.lit("not in source").alias("fault")).distinct()
    absent = source.join(reviews, key, "left_anti").select(key, F.lit("not reviewed").alias("fault")).distinct()
    return reduce(DataFrame.unionByName, [own, twice, alien, absent])


def fingerprint(df: DataFrame, group: str, row: Column) -> DataFrame:
    """(group, rows, digest): a digest of a group's rows that doesn't depend on their order, added up where they lie."""
    part = F.conv(F.substring(F.md5(row.cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.sum(part).cast("string").alias("digest"))


def compared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, state): whether two fingerprint tables agree on a group."""
    both = a.select(key, F.struct("rows", "digest").alias("x")).join(b.select(key, F.struct("rows", "digest").alias("y")), key, "full_outer")
    return both.select(key, F.when(F.col("x").isNull(), "only second").when(F.col("y").isNull(), "only first").when(F.col("x") == F.col("y"), "same").otherwise("different").alias("state"))


def statute_hits(said: Column, sections: Column) -> Column:
    """Sections (para, chapter, title, text) that a query means: by number ("§ 35", "35"), else by its words; all for an empty one."""
    q = F.trim(F.coalesce(said, F.lit("")))
    number = F.regexp_extract(q, r"^§?\s*(\d+\s*\w*)\s*$", 1)
    line = lambda s: F.lower(F.concat_ws(" ", s["para"], s["chapter"], s["title"], s["text"]))
    by_number = F.filter(sections, lambda s: F.lower(s["para"]) == F.lower(F.concat(F.lit("§ "), F.trim(number))))
    return F.when(q == "", sections).when(number != "", by_number).otherwise(F.filter(sections, lambda s: F.contains(line(s), F.lower(q))))


def guideline_chunks(chunks: Column, query: Column, least: int = 3, fallback: int = 5, most: int = 8) -> Column:
    """Chunks that hold any word of the query of ``least`` letters, ``most`` of them; the first ``fallback`` if none does."""
    words = F.filter(F.split(folded(query), " "), lambda w: F.length(w) >= least)
    hit = F.filter(chunks, lambda c: F.exists(words, lambda w: F.contains(F.lower(c), w)))
    return F.when(F.size(hit) > 0, F.slice(hit, 1, most)).otherwise(F.slice(chunks, 1, fallback))


def excerpt_blocks(prompt: Column) -> Column:
    """(source, text) of the blocks of a prompt that begin with "[Kilde n]" or "[AFGØRELSESKERNE Kilde n]"."""
    head = r"(?m)^\[(?:AFGØRELSESKERNE )?Kilde (\d+)\]"
    said = F.coalesce(prompt, F.lit(""))
    numbers, bodies = F.regexp_extract_all(said, F.lit(head), F.lit(1)), F.split(said, head, -1)
    return F.transform(numbers, lambda n, i: F.struct(n.cast("int").alias("source"), F.trim(F.regexp_replace(F.get(bodies, i + 1), r"\s+", " ")).alias("text")))
