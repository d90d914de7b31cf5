"""Focused context: one budget of characters apportioned over the sources of each query.

Each source is cut into overlapping chunks, which are scored against the question by TF-IDF among the query's own chunks. A source's share of the
budget goes by its place (3 : 2 : 2 : 1 ...), with a least share; within it its best chunks are taken, as many as its cap allows, a chunk that
doesn't fit being cut to what is left. What all have left over goes to the first sources again, in turn. Chunks come back in the order
of the text.

Shares and the first turn are running sums; the second turn is a fold over a query's sources, of which there are a few, by the sums of what each has
left; texts aren't part of it. A chunk that is cut uses its room up. Sources without chunks have no rows; a question without words scores 0 everywhere,
so that each source gives its first chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import squeezed, tokens, windows
from docketry.operators.index import fixed, runs
from docketry.sources.tables import stored

#: Room below which nothing more is taken, what is left over below which the second turn ends, and what stands between chunks.
ROOM, SPARE, BETWEEN = 200, 300, 7


def chunks(sources: DataFrame, size: int = 120, overlap: int = 25, text: str = "text") -> DataFrame:
    """(query, place, doc, pos, of, said): the sources (query, place, doc, text) in overlapping runs of words; of is how many a source has."""
    words = F.filter(F.split(squeezed(F.coalesce(F.col(text), F.lit(""))), " "), lambda w: w != "")
    cut = F.when(F.size(words) > 0, F.transform(windows(words, size, overlap, stop_at_end=True), lambda w: F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
    return sources.select("query", "place", "doc", cut.alias("__cut")).select("query", "place", "doc", F.size("__cut").alias("of"), F.posexplode("__cut").alias("pos", "said"))


def scored(parts: DataFrame, questions: DataFrame, most: int = 2, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """(query, place, pos, score): the cosine with the question (query, text) of TF-IDF among the query's chunks, in millionths."""
    term = parts.select("query", "place", "pos", words(F.col("said")).alias("t")).select("query", "place", "pos", F.explode(runs(F.col("t"), most)).alias("term")).groupBy("query", "place", "pos", "term").agg(F.count(F.lit(1)).alias("tf"))
    term = stored(term, "terms")
    n = parts.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    idf = term.groupBy("query", "term").agg(F.count(F.lit(1)).alias("df")).join(n, "query").select("query", "term", (1.0 + F.ln((1.0 + F.col("n")) / (1.0 + F.col("df")))).alias("idf"))
    asked = questions.select("query", words(F.coalesce(F.col("text"), F.lit(""))).alias("t")).select("query", F.explode(runs(F.col("t"), most)).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf")).join(idf, ["query", "term"])
    asked = asked.select("query", "term", ((1.0 + F.ln("qtf")) * F.col("idf")).alias("q"))
    square = lambda c: F.sqrt(F.sum(fixed(F.col(c) * F.col(c), 1_000_000)) / F.lit(1e6))
    held = term.join(idf, ["query", "term"]).join(asked, ["query", "term"], "left").select("query", "place", "pos", ((1.0 + F.ln("tf")) * F.col("idf")).alias("w"), "q")
    sums = held.groupBy("query", "place", "pos").agg(square("w").alias("wl"), F.sum(fixed(F.col("w") * F.col("q"))).alias("dot"))
    found = sums.where("dot IS NOT NULL").join(asked.groupBy("query").agg(square("q").alias("ql")), "query")
    score = F.bround(F.col("dot") / F.lit(10.0) / (F.col("wl") * F.col("ql")), 0).cast("long")
    return parts.select("query", "place", "pos").join(found.select("query", "place", "pos", score.alias("score")), ["query", "place", "pos"], "left").withColumn("score", F.coalesce("score", F.lit(0)))


def apportioned(ranked: DataFrame, budgets: DataFrame, shares: tuple[int, ...] = (3, 2, 2), least: int = 400, cap: int = 3) -> DataFrame:
    """Of chunks (query, place, pos, score, size) those that are taken, with room: how many of their characters fit, and turn. budgets: (query, total)."""
    by = Window.partitionBy("query", "place").orderBy(F.desc("score"), "pos")
    before = lambda w: F.coalesce(F.sum(F.col("size") + BETWEEN).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.coalesce(F.get(F.array(*map(F.lit, shares)), F.col("place").cast("int")), F.lit(1))
    weighed = ranked.select("query", "place").distinct().withColumn("part", part)
    each = weighed.groupBy("query").agg(F.sum("part").alias("parts"), F.count(F.lit(1)).alias("n")).join(budgets, "query")
    share = F.greatest(F.lit(least), F.floor(F.col("total") * F.col("part") / F.col("parts")))
    rows = ranked.join(weighed, ["query", "place"]).join(each, "query").withColumns({"share": share, "fair": F.greatest(F.lit(least), F.floor(F.col("total") / F.col("n"))), "cap": F.lit(cap) * F.when(F.col("place") == 0, 3).when(F.col("place") < 3, 2).otherwise(1)})
    rows = rows.withColumns({"k": F.row_number().over(by), "before": before(by)})
    rows = rows.where((F.col("k") <= F.col("cap")) & ((F.col("k") == 1) | (F.col("score") > 0)))
    rows = rows.withColumn("first", F.col("share") - F.col("before") >= ROOM)
    used = F.least(F.max(F.when(F.col("first"), F.col("before") + F.col("size") + BETWEEN)), F.max("share"))
    # What each source has left over, as sums before and after each chunk in the order of scores.
    rest = F.array_sort(F.collect_list(F.when(~F.col("first"), F.struct("k", "size"))))
    held = rows.groupBy("query", "place").agg(F.coalesce(used, F.lit(0)).alias("used"), rest.alias("rest"), F.max("fair").alias("fair"), F.max("total").alias("total"))
    held = held.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "used", "rest", "fair"))).alias("sources"), F.max("total").alias("total"), F.sum("used").alias("spent"))

    def turn(state: Column, source: Column) -> Column:
        spare = F.col("total") - state["spent"]
        room = F.when(spare < SPARE, F.lit(0).cast("long")).otherwise(F.least(spare, 2 * source["fair"]).cast("long"))
        # Chunk by chunk: what is used when it comes, and whether it still has room.
        gone = F.aggregate(source["rest"], F.lit(0).cast("long"), lambda a, c: F.when(room - a >= ROOM, a + c["size"] + BETWEEN).otherwise(a))
        return F.struct((state["spent"] + F.least(gone, room)).alias("spent"), F.concat(state["rooms"], F.array(F.struct(source["place"].alias("place"), room.alias("room2")))).alias("rooms"))

    place = ranked.schema["place"].dataType.simpleString()
    start = F.struct(F.col("spent").cast("long").alias("spent"), F.array().cast(f"array<struct<place:{place},room2:bigint>>").alias("rooms"))
    rooms = held.select("query", F.explode(F.aggregate("sources", start, turn)["rooms"]).alias("x")).select("query", "x.place", "x.room2")
    again = rows.where(~F.col("first")).join(rooms, ["query", "place"]).withColumn("before", before(by)).where(F.col("room2") - F.col("before") >= ROOM)
    taken = rows.where("first").select("query", "place", "pos", "score", "size", F.least(F.col("size"), F.col("share") - F.col("before")).alias("room"), F.lit(1).alias("turn"))
    return taken.unionByName(again.select("query", "place", "pos", "score", "size", F.least(F.col("size"), F.col("room2") - F.col("before")).alias("room"), F.lit(2).alias("turn")))


def fitted(said: Column, room: Column) -> Column:
    """The text, or where it is longer than its room as many whole words of it as fit, marked."""
    return F.when(F.length(said) <= room, said).otherwise(F.concat(F.regexp_replace(F.substring(said, F.lit(1), room.cast("int")), r" [^ ]*$", ""), F.lit(" …")))


def focused(sources: DataFrame, questions: DataFrame, total: int = 26_000, head: Column | None = None, bonus: Column | None = None, most: int = 2, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """(query, place, doc, pos, score, turn, said): the chunks of sources (query, place, doc, text, ...) that make up each query's context. head: a source's
    heading, whose length and two characters the budget pays first; bonus: what a chunk has more, in millionths."""
    heads = sources.select("query", (F.length(head) + 2 if head is not None else F.lit(0)).alias("h")).groupBy("query").agg((F.lit(total) - F.sum("h")).alias("total"))
    # Both are read several times: the chunks by what scores them, their scores by both turns.
    parts = stored(chunks(sources), "chunks")
    marks = scored(parts, questions, most, words).join(parts, ["query", "place", "pos"])
    marks = marks.withColumn("score", F.col("score") + (bonus if bonus is not None else F.lit(0))).withColumn("size", F.length("said"))
    taken = apportioned(stored(marks.select("query", "place", "pos", "score", "size"), "marks"), heads)
    return taken.join(parts, ["query", "place", "pos"]).select("query", "place", "doc", "pos", "score", "turn", fitted(F.col("said"), F.col("room")).alias("said"))


def contexts(taken: DataFrame, heads: DataFrame) -> DataFrame:
    """(query, context): headings (query, place, head) with the chunks taken below them, in the order of the text."""
    told = taken.groupBy("query", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), "\n[…]\n").alias("told"))
    block = F.concat_ws("\n", "head", "told")
    each = heads.select("query", "place", "head").join(told, ["query", "place"], "left").withColumn("block", block)
    return each.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "block"))), lambda x: x["block"]), "\n\n").alias("context"))
