"""Filters, statistics, joins and ordered analytics over the relational tables and the event log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry.functions.text import title
from docketry.operators import filters, graph, ordered, stats
from docketry.plans.registry import query, table

#: Order states as outcomes.
OUTCOMES = {"F": "won", "O": "lost", "P": "rejected"}
_OUTCOME = "CASE o_orderstatus WHEN 'F' THEN 'won' WHEN 'O' THEN 'lost' ELSE 'rejected' END"


def outcome():
    return F.when(F.col("o_orderstatus") == "F", "won").when(F.col("o_orderstatus") == "O", "lost").otherwise("rejected")


def cases(spark, sf_dir):
    """Orders as cases: year, outcome, company (the customer's segment), labels."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    both = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return both.select("o_orderkey", F.year("o_orderdate").alias("year"), outcome().alias("outcome"), F.col("c_mktsegment").alias("company"), F.split("o_orderpriority", "-").alias("labels"), "o_totalprice")


_CASES = f"cases AS (SELECT o_orderkey, year(o_orderdate)::INT AS year, {_OUTCOME} AS outcome, c_mktsegment AS company, string_split(o_orderpriority, '-') AS labels, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"WITH {_CASES} SELECT o_orderkey, year, outcome, company FROM cases WHERE coalesce(year, 0) >= 1995 AND coalesce(year, 9999) <= 1997 AND list_has_any(labels, ['HIGH', 'URGENT']) AND outcome IN ('won', 'lost')")
def facet_filter(spark, sf_dir):
    condition = filters.facets(F.col("year"), 1995, 1997, lists={"labels": ["HIGH", "URGENT"]}, values={"outcome": ["won", "lost"], "company": []})
    return cases(spark, sf_dir).where(condition).select("o_orderkey", "year", "outcome", "company")


@query(f"WITH {_CASES} SELECT o_orderkey, array_to_string(labels, '-') AS labels FROM cases WHERE len(list_filter(labels, lambda x: x NOT IN ('2', 'HIGH', '1', 'URGENT', '3'))) = 0")
def facet_isolate(spark, sf_dir):
    return cases(spark, sf_dir).where(filters.isolated(F.col("labels"), ["2", "HIGH", "1", "URGENT", "3"])).select("o_orderkey", F.array_join("labels", "-").alias("labels"))


@query(f"WITH {_CASES} SELECT count(*) AS n, sum(year)::BIGINT AS years FROM cases WHERE outcome = 'won'")
def auto_filter_guard(spark, sf_dir):
    """A filter that leaves enough and takes enough is applied; one that leaves nearly all isn't."""
    held = filters.narrowed(cases(spark, sf_dir), F.col("outcome") == "won")
    return filters.narrowed(held, F.col("year") > 1900).agg(F.count(F.lit(1)).alias("n"), F.sum("year").alias("years"))


@query("SELECT facet, value FROM (SELECT DISTINCT 'lang' AS facet, lang AS value FROM documents UNION SELECT DISTINCT 'source', source FROM documents) WHERE trim(coalesce(value, '')) <> ''")
def facet_options(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    options = docs.select(F.explode(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")).alias("facet", "value"))
    return options.where(F.trim(F.coalesce("value", F.lit(""))) != "").distinct()


@query(f"WITH {_CASES} SELECT company AS label, sum((outcome = 'won')::INT)::BIGINT AS won, sum((outcome = 'lost')::INT)::BIGINT AS lost, sum((outcome = 'rejected')::INT)::BIGINT AS rejected, count(*) AS total FROM cases WHERE trim(company) <> '' GROUP BY company ORDER BY total DESC, label LIMIT 15")
def crosstab_total(spark, sf_dir):
    return stats.crosstab(cases(spark, sf_dir), F.col("company"), "outcome", list(OUTCOMES.values()), 15)


@query(f"WITH {_CASES}, facets AS (SELECT 'year' AS facet, year::VARCHAR AS label, outcome FROM cases UNION ALL SELECT 'label', unnest(labels), outcome FROM cases UNION ALL SELECT 'company', company, outcome FROM cases) SELECT facet, label, sum((outcome = 'won')::INT)::BIGINT AS won, sum((outcome = 'lost')::INT)::BIGINT AS lost, sum((outcome = 'rejected')::INT)::BIGINT AS rejected, count(*) AS total FROM facets WHERE trim(label) <> '' GROUP BY facet, label")
def stats_bundle(spark, sf_dir):
    """Crosstabs of several facets in one pass: facets are exploded and counted together."""
    pairs = F.concat(F.array(F.struct(F.lit("year").alias("facet"), F.col("year").cast("string").alias("label")), F.struct(F.lit("company").alias("facet"), F.col("company").alias("label"))), F.transform("labels", lambda x: F.struct(F.lit("label").alias("facet"), x.alias("label"))))
    each = cases(spark, sf_dir).select("outcome", F.inline(pairs)).where(F.trim("label") != "")
    return each.groupBy("facet", "label").agg(*(F.sum((F.col("outcome") == o).cast("int")).alias(o) for o in OUTCOMES.values()), F.count(F.lit(1)).alias("total"))


@query(f"WITH {_CASES} SELECT company, sum((outcome = 'won')::INT)::BIGINT AS won, sum((outcome IN ('won', 'lost'))::INT)::BIGINT AS decided, round_even(100.0e0 * sum((outcome = 'won')::INT) / sum((outcome IN ('won', 'lost'))::INT), 0) AS rate, round(100.0e0 * sum((outcome = 'won')::INT) / sum((outcome IN ('won', 'lost'))::INT), 0) AS shown_rate FROM cases GROUP BY company")
def success_rate_decided(spark, sf_dir):
    """Rates among decided cases: half to even for the interface, half up for the page."""
    won, decided = F.sum((F.col("outcome") == "won").cast("int")), F.sum(F.col("outcome").isin("won", "lost").cast("int"))
    return cases(spark, sf_dir).groupBy("company").agg(won.alias("won"), decided.alias("decided"), stats.success_rate(won, decided, 0).alias("rate"), stats.success_rate(won, decided, 0, half_even=False).alias("shown_rate"))


@query(f"WITH {_CASES} SELECT company, count(*) AS total, round_even(100.0e0 * sum((outcome = 'won')::INT) / count(*), 1) AS rate FROM cases GROUP BY company")
def success_rate_all(spark, sf_dir):
    won, every = F.sum((F.col("outcome") == "won").cast("int")), F.count(F.lit(1))
    return cases(spark, sf_dir).groupBy("company").agg(every.alias("total"), stats.success_rate(won, every, 1).alias("rate"))


@query(f"WITH {_CASES} SELECT label, count(*) AS n, round_even(100.0e0 * sum((outcome = 'won')::INT) / count(*), 1) AS rate FROM (SELECT unnest(labels) AS label, outcome FROM cases) GROUP BY label HAVING count(*) >= 3")
def label_rates(spark, sf_dir):
    won, every = F.sum((F.col("outcome") == "won").cast("int")), F.count(F.lit(1))
    return cases(spark, sf_dir).select(F.explode("labels").alias("label"), "outcome").groupBy("label").agg(every.alias("n"), stats.success_rate(won, every, 1).alias("rate")).where("n >= 3")


@query(f"WITH {_CASES} SELECT year, outcome, count(*) AS n FROM cases GROUP BY ALL")
def count_by_year_outcome(spark, sf_dir):
    return cases(spark, sf_dir).groupBy("year", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_name AS name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name ORDER BY n DESC, name LIMIT 15")
def top15(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("m"))
    named = lines.join(table(spark, sf_dir, "supplier"), lines.l_suppkey == F.col("s_suppkey"))
    return named.groupBy(F.col("s_name").alias("name")).agg(F.sum("m").alias("n")).orderBy(F.desc("n"), "name").limit(15)


@query("SELECT l_returnflag AS label, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, min(year(l_shipdate))::INT AS first_year, max(year(l_shipdate))::INT AS last_year, max(l_shipdate::DATE)::VARCHAR AS latest FROM lineitem GROUP BY ALL")
def distinct_and_bounds(spark, sf_dir):
    year = F.year("l_shipdate")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.max(F.to_date("l_shipdate")).cast("string").alias("latest"))


@query("SELECT d.doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title FROM documents d WHERE contains(lower(coalesce(text, '')), 'licensed under')")
def literal_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where(filters.holds(F.lit(" Licensed under "), F.col("text"))).select("doc_id", title(F.col("text")).alias("title"))


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = 'customer#000000007' OR starts_with(lower(c_name), 'customer#000000007 ') OR contains(lower(c_name), '(customer#000000007)')")
def case_number_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(filters.case_number(F.col("c_name"), F.lit("Customer#000000007"))).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, total FROM (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40), (SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F')")
def page_offset(spark, sf_dir):
    """The third page of twenty, newest first, with the count of all hits."""
    hits = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    total = hits.count()
    return filters.page(hits, [F.desc_nulls_last("o_orderdate"), "o_orderkey"], 40, 20).select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"), F.lit(total).cast("long").alias("total"))


@query("WITH both_ AS (SELECT doc_id, text, 0 AS part FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id, text, 1 FROM documents WHERE lang = 'en') SELECT doc_id, part FROM both_ QUALIFY row_number() OVER (PARTITION BY text ORDER BY part, doc_id) = 1")
def direct_first_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return filters.first_of([docs.where("source = 'src1'"), docs.where("lang = 'en'")], ["text"], ["doc_id"]).select("doc_id", "part")


@query("WITH known AS (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.text = d.text)")
def incremental_antijoin(spark, sf_dir):
    from docketry.sources.readers import unseen

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return unseen(docs, known, ["text"]).select("doc_id")


@query("WITH keyed AS (SELECT doc_id, CASE WHEN trim(coalesce(source, '')) <> '' THEN 'link:' || source || '/' || n_chars ELSE 'title:' || split_part(coalesce(text, ''), chr(10), 1) END AS key, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 200) AS head FROM documents) SELECT doc_id, key FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1")
def dedup_first_wins(spark, sf_dir):
    from docketry.sources.readers import first_wins, identity

    docs = table(spark, sf_dir, "documents").select("doc_id", identity(F.concat_ws("/", F.when(F.trim("source") != "", F.col("source")), F.when(F.trim("source") != "", F.col("n_chars").cast("string"))), F.lit(None).cast("string"), title(F.col("text"))).alias("key"))
    return first_wins(docs, ["key"], ["doc_id"])


@query("SELECT doc_id, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 200) AS head FROM documents QUALIFY row_number() OVER (PARTITION BY head ORDER BY doc_id) = 1")
def dedup_title_prefix(spark, sf_dir):
    from docketry.sources.readers import first_wins

    return first_wins(table(spark, sf_dir, "documents").select("doc_id", F.substring(title(F.col("text")), 1, 200).alias("head")), ["head"], ["doc_id"])


_NEAR = """
    marked AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day, dayofweek(o_orderdate) IN (0, 6) AND count(*) OVER (PARTITION BY o_orderdate::DATE) >= 3 AS suspect FROM orders),
    held AS (SELECT o_custkey, o_orderkey AS place, day FROM marked WHERE NOT suspect),
    near AS (SELECT m.o_custkey, m.o_orderkey, m.day, m.suspect,
             (SELECT max(place) FROM held h WHERE h.o_custkey = m.o_custkey AND h.place <= m.o_orderkey) AS lo, (SELECT min(place) FROM held h WHERE h.o_custkey = m.o_custkey AND h.place >= m.o_orderkey) AS hi FROM marked m),
    best AS (SELECT *, CASE WHEN hi IS NULL OR (lo IS NOT NULL AND o_orderkey - lo <= hi - o_orderkey) THEN lo ELSE hi END AS place FROM near)"""


def marked(spark, sf_dir):
    day = F.to_date("o_orderdate")
    shared = F.count(F.lit(1)).over(Window.partitionBy("day")) >= 3
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("day")).withColumn("suspect", F.dayofweek("day").isin(1, 7) & shared)


@query(f"WITH {_NEAR} SELECT best.o_custkey, o_orderkey, best.place AS nearest_place, held.day::VARCHAR AS nearest_day FROM best LEFT JOIN held ON held.o_custkey = best.o_custkey AND held.place = best.place")
def nearest_neighbour_date(spark, sf_dir):
    found = ordered.nearest(marked(spark, sf_dir), ["o_custkey"], "o_orderkey", F.when(~F.col("suspect"), F.col("day")), ("nearest_place", "nearest_day"))
    return found.select("o_custkey", "o_orderkey", "nearest_place", F.col("nearest_day").cast("string").alias("nearest_day"))


@query(f"WITH {_NEAR} SELECT o_orderkey, (CASE WHEN suspect THEN held.day ELSE best.day END)::VARCHAR AS day, suspect AS estimated FROM best LEFT JOIN held ON held.o_custkey = best.o_custkey AND held.place = best.place")
def repair_dates(spark, sf_dir):
    """A weekend date that three rows or more share is replaced by that of the nearest trusted case of the customer."""
    found = ordered.nearest(marked(spark, sf_dir), ["o_custkey"], "o_orderkey", F.when(~F.col("suspect"), F.col("day")))
    return found.select("o_orderkey", F.when(F.col("suspect"), F.col("nearest_value")).otherwise(F.col("day")).cast("string").alias("day"), F.col("suspect").alias("estimated"))


@query("SELECT conv_id, turn, role, substr(text, 1, 300) AS said FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def history_tail(spark, sf_dir):
    return ordered.first_per_group(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], 4).select("conv_id", "turn", "role", F.substring("text", 1, 300).alias("said"))


@query("WITH each AS (SELECT conv_id, turn, unnest(range(0, len(w))) AS pos, unnest(w) AS link FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-zæøå0-9]+')[1:5] AS w FROM conversations WHERE role = 'assistant')), best AS (SELECT conv_id, link, min((-turn, pos)) AS at_ FROM each GROUP BY ALL) SELECT conv_id, link, row_number() OVER (PARTITION BY conv_id ORDER BY at_) AS place FROM best QUALIFY place <= 8")
def source_carry_over(spark, sf_dir):
    """The first words of assistants' turns as their sources."""
    from docketry.functions.text import tokens

    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.slice(tokens(F.col("text")), 1, 5).alias("sources"))
    return ordered.carried_sources(turns, "sources", 8)


@query("SELECT source, doc_id, used FROM (SELECT source, doc_id, (sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY source ORDER BY doc_id) - 2)::BIGINT AS used FROM documents) WHERE used <= 12000")
def budget_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return ordered.within_budget(docs, ["source"], ["doc_id"], F.col("size"), 12_000).select("source", "doc_id", "used")


@query("SELECT lang, source, doc_id, place FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 2")
def diverse_topk(spark, sf_dir):
    return ordered.first_per_group(table(spark, sf_dir, "documents"), ["lang", "source"], [F.desc("n_chars"), "doc_id"], 2).select("lang", "source", "doc_id", "place")


@query("SELECT doc_id, lang, round FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('gold' || doc_id), doc_id) AS round FROM documents) ORDER BY round, lang LIMIT 60")
def sampled_strata(spark, sf_dir):
    return ordered.strata(table(spark, sf_dir, "documents"), "lang", "doc_id", 60, "gold").select("doc_id", "lang", "round")


@query("SELECT source, doc_id, ((row_number() OVER (PARTITION BY source ORDER BY sha256('review' || doc_id), doc_id) - 1) // 15 + 1)::BIGINT AS batch FROM documents")
def batches(spark, sf_dir):
    blind = F.sha2(F.concat(F.lit("review"), F.col("doc_id").cast("string")).cast("binary"), 256)
    w = Window.partitionBy("source").orderBy(blind, "doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id", (F.floor((F.row_number().over(w) - 1) / 15) + 1).cast("long").alias("batch"))


@query("SELECT event_type AS rating, count(*) AS n, count(DISTINCT user_id) AS users, round_even(avg(value), 2) AS mean FROM events GROUP BY ALL")
def feedback_summary(spark, sf_dir):
    from docketry.streaming.feeds import tally

    return tally(table(spark, sf_dir, "events"))


@query("SELECT event_id, user_id, (count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))::BIGINT AS in_window FROM events")
def rate_window(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.count(F.lit(1)).over(w).alias("in_window"))


@query()
def rate_limiter(spark, sf_dir):
    """Who is let through at five an hour, where denied calls don't count; waiting seconds for the others."""
    from docketry.streaming.feeds import limited

    return limited(table(spark, sf_dir, "events"), most=5, seconds=3600)


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def event_log_tail(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "user_id")


@query("SELECT (ts::DATE)::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf_dir):
    """The event log read as a stream of files, run to its end."""
    from docketry.streaming.feeds import drained

    counted = lambda df: df.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return drained(spark, f"{sf_dir}/events.parquet", counted, "complete")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def stream_ingest_dedup(spark, sf_dir):
    from docketry.streaming.feeds import drained

    return drained(spark, f"{sf_dir}/events.parquet", lambda df: df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id"), "append")


_FEATURES = "features AS (SELECT p_partkey AS doc, 'brand:' || p_brand AS feature, 3.0e0 AS weight FROM part UNION ALL SELECT p_partkey, 'type:' || p_type, 2.0e0 FROM part UNION ALL SELECT p_partkey, 'size:' || p_size, 1.0e0 FROM part)"


def features(spark, sf_dir):
    pairs = F.array(*(F.struct(F.concat(F.lit(f"{n}:"), F.col(f"p_{n}").cast("string")).alias("feature"), F.lit(w).alias("weight")) for n, w in (("brand", 3.0), ("type", 2.0), ("size", 1.0))))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.inline(pairs))


def _related_sql(features: str) -> str:
    return f"""sums AS (SELECT doc, sum(round_even(weight * 1e6, 0)::BIGINT) AS sum FROM {features} GROUP BY doc),
    met AS (SELECT q.doc AS query, f.doc, count(*) AS shared, sum(round_even(f.weight * 1e6, 0)::BIGINT) AS met FROM {features} f JOIN {features} q USING (feature) WHERE q.doc % 20 = 0 AND q.doc <> f.doc GROUP BY ALL)
    SELECT query, doc, shared, score FROM (SELECT query, met.doc, shared, round_even(met::DOUBLE / (a.sum + b.sum - met), 6) AS score FROM met JOIN sums a ON a.doc = met.doc JOIN sums b ON b.doc = query) WHERE score >= 0.05"""


@query(f"WITH {_FEATURES}, {_related_sql('features')}")
def graph_jaccard(spark, sf_dir):
    each = features(spark, sf_dir)
    return graph.related(each, each.where("doc % 20 = 0").select("doc").distinct())


@query(f"WITH {_FEATURES}, seen AS (SELECT feature, count(*) AS df FROM features GROUP BY feature), rare AS (SELECT doc, feature, round_even(weight * (1.0e0 + ln(((SELECT count(*) FROM part) + 1.0e0) / (df + 1.0e0))), 6) AS weight FROM features JOIN seen USING (feature)), {_related_sql('rare')}")
def graph_rarity(spark, sf_dir):
    each = features(spark, sf_dir)
    return graph.related(each, each.where("doc % 20 = 0").select("doc").distinct(), rarity=True, total=table(spark, sf_dir, "part").count())


@query(f"WITH {_FEATURES} SELECT 'item' AS kind, count(DISTINCT doc) AS n FROM features UNION ALL SELECT 'feature', count(DISTINCT feature) FROM features UNION ALL SELECT 'edge', count(*) FROM (SELECT DISTINCT doc, feature FROM features)")
def graph_stats(spark, sf_dir):
    return graph.nodes(features(spark, sf_dir))
