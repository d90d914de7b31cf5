"""Sources and sinks run through: files written to the shared folder and read again, caches, appends, feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docketry.operators import lookups
from docketry.plans.registry import query, table
from docketry.sources import readers, tables
from docketry.streaming import feeds


def _place(spark, name: str) -> str:
    path = f"{tables.folder(spark)}/files/{name}-{uuid.uuid4().hex}"
    fs, place = tables._place(spark, path)
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return f"{path}/rows"


@query("SELECT CAST(c_custkey AS VARCHAR) AS number, '## Sag ' || c_custkey || chr(10) || chr(10) || 'Om ' || c_mktsegment || ' & mere' AS said, 'Sag ' || c_custkey || ' Om ' || c_mktsegment || ' & mere' AS excerpt, 'roof;floor' AS kinds FROM customer")
def csv_round_trip(spark, sf_dir):
    """Decisions written as CSV with line ends and quotes within, read, cleaned."""
    html = F.concat(F.lit("<h2>Sag "), F.col("c_custkey").cast("string"), F.lit('</h2>\n<p>Om <b class="x">'), F.col("c_mktsegment"), F.lit("</b> &amp; mere</p>"))
    rows = table(spark, sf_dir, "customer").select(F.lit("2020-01-01").alias("Dato"), F.lit("t").alias("Titel"), F.lit("l").alias("Link"), html.alias("Tekst"), F.col("c_custkey").cast("string").alias("Sagsnummer"), F.lit("roof, ,floor").alias("Mangeltype"))
    path = _place(spark, "csv")
    readers.append_csv(rows, path)
    got = readers.cleaned(readers.read_csv(spark, path, rows.columns))
    return got.select(F.col("Sagsnummer").alias("number"), F.col("Tekst").alias("said"), F.col("Excerpt").alias("excerpt"), F.array_join("Mangeltype", ";").alias("kinds"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'second' END AS part FROM orders")
def json_appends(spark, sf_dir):
    """Rows appended twice as lines of JSON, read with a schema."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = _place(spark, "json")
    for part, odd in (("first", 0), ("second", 1)):
        tables.append_json(orders.where(F.col("o_orderkey") % 2 == odd).withColumn("part", F.lit(part)), path)
    return readers.read_jsonl(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double, part string")


@query("SELECT p_brand, count(*) AS parts, 2::BIGINT AS reads FROM part GROUP BY p_brand")
def cached_counts(spark, sf_dir):
    """A table made once by its files and code, and read twice."""
    made = lambda: table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"))
    one, two = (tables.cached(spark, "brand-counts", [f"{sf_dir}/part.parquet"], [lookups], made) for _ in range(2))
    return one.unionByName(two).groupBy("p_brand", "parts").agg(F.count(F.lit(1)).alias("reads"))


@query("""SELECT role, reason, count(*) AS n FROM (SELECT role, unnest(CASE WHEN length(text) > 200 THEN ['long', 'even'][1:1 + (turn % 2)::INTEGER] ELSE ['short'] END) AS reason FROM conversations) GROUP BY role, reason""")
def feedback_reasons(spark, sf_dir):
    """Reasons of feedback, counted as the stream of it is read."""
    reasons = F.when(F.length("text") > 200, F.slice(F.array(F.lit("long"), F.lit("even")), F.lit(1), 1 + (F.col("turn") % 2).cast("int"))).otherwise(F.array(F.lit("short")))
    tally = lambda df: df.select("role", F.explode(reasons).alias("reason")).groupBy("role", "reason").agg(F.count(F.lit(1)).alias("n"))
    return feeds.drained(spark, f"{sf_dir}/conversations.parquet", tally, "complete")


@query("SELECT c_custkey, '{\"balance\":' || CAST(round(c_acctbal)::BIGINT AS VARCHAR) || ',\"nation\":' || c_nationkey || ',\"results\":[{\"rank\":1,\"segment\":\"' || c_mktsegment || '\"},{\"rank\":2,\"segment\":\"none\"}]}' AS said, 2::INTEGER AS n, 'none' AS last FROM customer")
def nested_json(spark, sf_dir):
    """Canonical JSON, keys in order, of nested results, and what is read from it."""
    result = lambda rank, segment: F.struct(F.lit(rank).alias("rank"), segment.alias("segment"))
    said = F.to_json(F.struct(F.round("c_acctbal").cast("long").alias("balance"), F.col("c_nationkey").alias("nation"), F.array(result(1, F.col("c_mktsegment")), result(2, F.lit("none"))).alias("results")))
    told = table(spark, sf_dir, "customer").select("c_custkey", said.alias("said"))
    read = F.from_json("said", "balance long, nation int, results array<struct<rank:int,segment:string>>")
    return told.select("c_custkey", "said", F.size(read.results).alias("n"), F.element_at(read.results, -1).segment.alias("last"))
