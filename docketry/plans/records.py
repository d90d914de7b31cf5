"""Queries over registers, joins by several keys, folders, exports and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import text as tx
from docketry.operators import records as rc
from docketry.plans.registry import query, table


@query("SELECT c_custkey, array_to_string(list_filter(p, lambda x, i: x <> '' AND list_position(p, x) = i), ',') AS parts FROM (SELECT c_custkey, list_transform(string_split(c_mktsegment || '| ' || c_nationkey || '||' || c_mktsegment, '|'), lambda x: trim(x)) AS p FROM customer)")
def pipe_lists(spark, sf_dir):
    said = F.concat("c_mktsegment", F.lit("| "), F.col("c_nationkey").cast("string"), F.lit("||"), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(rc.pipe_list(said), ",").alias("parts"))


@query("WITH registry(source, name, grp) AS (VALUES ('src1', 'Planning', 'boards'), ('src2', 'Environment', 'boards')) SELECT doc_id, coalesce(name, upper(substr(source, 1, 1)) || lower(substr(source, 2))) AS name, coalesce(grp, 'other') AS grp FROM documents LEFT JOIN registry USING (source)")
def category_registry(spark, sf_dir):
    registry = spark.createDataFrame([("src1", "Planning", "boards"), ("src2", "Environment", "boards")], "stem string, name string, group string")
    return rc.named(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", registry).select("doc_id", "name", F.col("group").alias("grp"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "pages", "orders", "events")))
def row_counts(spark, sf_dir):
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "pages", "orders", "events")])


@query("SELECT doc_id, length(CASE WHEN better THEN new ELSE text END) AS chars, length(CASE WHEN better THEN text END) AS summary_chars FROM (SELECT doc_id, text, new, coalesce(length(text) < 8000 AND length(new) > length(text), false) AS better FROM documents LEFT JOIN (SELECT doc_id, text || ' more' AS new FROM documents WHERE doc_id % 3 = 0) USING (doc_id))")
def refresh_merge(spark, sf_dir):
    from docketry.sources.readers import refreshed

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    new = docs.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" more")))
    return refreshed(docs, new, "doc_id", "text").select("doc_id", F.length("text").cast("long").alias("chars"), F.length("text_summary").cast("long").alias("summary_chars"))


@query("SELECT o_orderkey, 'Case ' || lpad(o_orderkey::VARCHAR, 7, '0') || ' (' || strftime(o_orderdate, '%d.%m.%Y') || '): ' || o_orderstatus || ', ' || printf('%.2f', o_totalprice) AS line FROM orders")
def text_export(spark, sf_dir):
    line = F.format_string("Case %s (%s): %s, %.2f", F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.date_format("o_orderdate", "dd.MM.yyyy"), "o_orderstatus", "o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))


@query("SELECT '{\"id\":\"part:' || p_partkey || '\",\"kind\":\"part\"}' AS json FROM part UNION ALL SELECT '{\"relation\":\"has_brand\",\"source\":\"part:' || p_partkey || '\",\"target\":\"' || p_brand || '\"}' FROM part")
def graph_export(spark, sf_dir):
    """Nodes and edges as canonical JSON, fields by name."""
    part = table(spark, sf_dir, "part").withColumn("id", F.concat(F.lit("part:"), F.col("p_partkey").cast("string")))
    nodes = part.select(F.to_json(F.struct("id", F.lit("part").alias("kind"))).alias("json"))
    return nodes.unionByName(part.select(F.to_json(F.struct(F.lit("has_brand").alias("relation"), F.col("id").alias("source"), F.col("p_brand").alias("target"))).alias("json")))


@query("WITH v(value) AS (VALUES ('house'), ('HOUSEHOLD'), ('automobiler'), ('Buildings'), ('furnitur'), ('zzz')), o AS (SELECT DISTINCT c_mktsegment AS option FROM customer), p AS (SELECT value, option, CASE WHEN lower(value) = lower(option) THEN 0 WHEN regexp_replace(lower(value), '(ernes|erne|ene|er|en|et|e|s)$', '') = regexp_replace(lower(option), '(ernes|erne|ene|er|en|et|e|s)$', '') THEN 1 WHEN (starts_with(lower(option), lower(value)) OR starts_with(lower(value), lower(option))) AND abs(length(value) - length(option)) <= 3 THEN 2 END AS kind FROM v JOIN o ON substr(lower(value), 1, 3) = substr(lower(option), 1, 3)), b AS (SELECT * FROM p WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY value ORDER BY kind, option) = 1) SELECT value, option, kind FROM v LEFT JOIN b USING (value)")
def value_reconcile(spark, sf_dir):
    values = spark.createDataFrame([(v,) for v in ("house", "HOUSEHOLD", "automobiler", "Buildings", "furnitur", "zzz")], "value string")
    return rc.reconciled(values, table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("option")).distinct())


@query("SELECT source, doc_id FROM (SELECT *, coalesce(contains(lower(text), 'license'), false) AS held, max(coalesce(contains(lower(text), 'license'), false)) OVER (PARTITION BY source) AS any_ FROM documents) WHERE held OR NOT any_")
def keep_if_any(spark, sf_dir):
    return rc.keep_if_any(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", F.contains(F.lower("text"), F.lit("license"))).select("source", "doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY' AND (p_size = 11 OR p_size = 28 OR p_name LIKE '%ring%')")
def deck_filter(spark, sf_dir):
    """Cards of a subject that are for the chosen periods or for all."""
    periods = F.when(F.contains("p_name", F.lit("ring")), F.array(F.lit("all"))).otherwise(F.array(F.col("p_size").cast("string")))
    cards = table(spark, sf_dir, "part").withColumn("periods", periods)
    chosen = F.arrays_overlap("periods", F.array(F.lit("11"), F.lit("28"))) | F.array_contains("periods", "all")
    return cards.where((F.col("p_type") == "ECONOMY") & chosen).select("p_partkey", "p_name")


@query("SELECT vec_id AS id, round_even(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS score, CASE WHEN label IS NULL THEN '' ELSE label::VARCHAR END AS label FROM embeddings")
def api_record(spark, sf_dir):
    score = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.bround(score, 4).alias("score"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"))


@query("WITH hits AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') ELSE '' END AS number, 'nation-' || l_suppkey % 25 AS link FROM lineitem), rows_ AS (SELECT s_suppkey, s_name AS number, 'nation-' || s_nationkey AS link FROM supplier), b AS (SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY link ORDER BY s_suppkey) = 1) SELECT l_orderkey, l_linenumber, coalesce(a.s_suppkey, b.s_suppkey) AS found, count(*) AS n FROM hits h LEFT JOIN rows_ a ON a.number = h.number LEFT JOIN b ON b.link = h.link GROUP BY ALL")
def two_key_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    number = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))).otherwise("")
    hits = lines.select("l_orderkey", "l_linenumber", number.alias("number"), F.concat(F.lit("nation-"), (F.col("l_suppkey") % 25).cast("string")).alias("link"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("found"), F.col("s_name").alias("number"), F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("link"))
    return rc.by_either_key(hits, rows, "number", "link", "found").groupBy("l_orderkey", "l_linenumber", "found").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' ELSE lang END AS tag FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def override_by_membership(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("tag"))
    return rc.overridden(docs, table(spark, sf_dir, "labels"), "doc_id", "tag", F.lit("labelled"))


@query("WITH a AS (SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"quality\":' || quality || '}') AS digest FROM labels), b AS (SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"quality\":' || CASE WHEN doc_id % 10 = 0 THEN 1 - quality ELSE quality END || '}') AS digest FROM labels) SELECT doc_id, a.digest = b.digest AS same FROM a JOIN b USING (doc_id)")
def digest_join(spark, sf_dir):
    """Frozen rows against edited ones by the digest of their canonical JSON."""
    digest = lambda q: F.sha2(F.to_json(F.struct("doc_id", q.alias("quality"))).cast("binary"), 256)
    labels = table(spark, sf_dir, "labels")
    edited = F.when(F.col("doc_id") % 10 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    a, b = labels.select("doc_id", digest(F.col("quality")).alias("a")), labels.select("doc_id", digest(edited).alias("b"))
    return a.join(b, "doc_id").select("doc_id", (F.col("a") == F.col("b")).alias("same"))


@query("SELECT conv_id, role, count(*) AS n, string_agg((turn + 1)::VARCHAR, ',' ORDER BY turn) AS places FROM conversations GROUP BY conv_id, role")
def source_register(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("place", F.col("turn") + 1)
    return rc.register(turns, "conv_id", "role", "place")


@query("WITH r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?i)(licensed under|released under) (the )?[A-Za-z-]+( [A-Za-z-]+)?')) AS ref FROM documents) SELECT lower(ref) AS ref, count(*) AS n, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM r GROUP BY lower(ref)")
def reference_counts(spark, sf_dir):
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?i)(licensed under|released under) (the )?[A-Za-z-]+( [A-Za-z-]+)?"), F.lit(0))
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("ref"))
    return each.groupBy(F.lower("ref").alias("ref")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first"))


@query("SELECT o_orderkey, rank FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, sha256('sort' || o_orderkey), o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def outcome_order(spark, sf_dir):
    """A customer's first three cases by outcome, then in a blind order."""
    from docketry.operators.ordered import first_per_group

    place = F.create_map(*(F.lit(x) for pair in {"F": 0, "P": 1}.items() for x in pair))
    blind = F.sha2(F.concat(F.lit("sort"), F.col("o_orderkey").cast("string")).cast("binary"), 256)
    order = [F.coalesce(F.try_element_at(place, F.col("o_orderstatus")), F.lit(2)), blind, "o_orderkey"]
    return first_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], order, 3).select("o_orderkey", F.col("place").alias("rank"))


@query("SELECT user_id, arg_max(event_id, (value, -event_id)) AS first_max, arg_max(event_id, (value, event_id)) AS last_max FROM events GROUP BY user_id")
def first_and_last_max(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("first_max"), F.max_by("event_id", F.struct("value", "event_id")).alias("last_max"))


@query("WITH have AS (SELECT lang AS folder, source AS link, min(doc_id) AS doc FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL), new AS (SELECT lang AS folder, source AS link, min(doc_id) AS doc FROM documents GROUP BY ALL), every AS (SELECT * FROM have UNION ALL SELECT n.* FROM new n WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.folder = n.folder AND h.link = n.link)) SELECT folder, link, doc FROM every WHERE NOT (folder = 'de' AND link = 'src1') UNION ALL SELECT 'fr', link, doc FROM every e WHERE folder = 'de' AND link = 'src1' AND NOT EXISTS (SELECT 1 FROM every x WHERE x.folder = 'fr' AND x.link = 'src1')")
def folder_items(spark, sf_dir):
    """Items put into folders, none twice, then one moved."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("folder"), F.col("source").alias("link"), F.col("doc_id").alias("doc"))
    first = lambda df: df.groupBy("folder", "link").agg(F.min("doc").alias("doc"))
    return rc.moved(rc.added(first(docs.where("doc % 2 = 0")), first(docs)), "src1", "de", "fr")


@query("SELECT c_custkey, substr(sha256(c_name), 1, 10) AS mask, 'ga-' || substr(sha1(c_mktsegment || chr(31) || c_name), 1, 14) AS audit, regexp_extract('Case 12/2020 of ' || (c_custkey % 9999) || '/' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || ', see', '(?:^|[^0-9])([0-9]{1,4}/[0-9]{2})(?:[^0-9]|$)', 1) AS reference FROM customer")
def key_functions(spark, sf_dir):
    """Masks, audit ids and reference numbers."""
    said = F.concat(F.lit("Case 12/2020 of "), (F.col("c_custkey") % 9999).cast("string"), F.lit("/"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit(", see"))
    audit = F.concat(F.lit("ga-"), F.substring(F.sha1(F.concat_ws("\x1f", "c_mktsegment", "c_name").cast("binary")), 1, 14))
    return table(spark, sf_dir, "customer").select("c_custkey", F.substring(F.sha2(F.col("c_name").cast("binary"), 256), 1, 10).alias("mask"), audit.alias("audit"), F.regexp_extract(said, "(?:^|[^0-9])([0-9]{1,4}/[0-9]{2})(?:[^0-9]|$)", 1).alias("reference"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 'event-' || event_id AS title FROM events WHERE event_id % 2 = 0")
def key_value_rows(spark, sf_dir):
    """Arrays of (Key, Value) flattened to records; rows without a number are left out."""
    cell = lambda k, v: F.struct(F.lit(k).alias("Key"), v.alias("Value"))
    number = F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k"))
    cells = F.array(cell("Number", F.lit("old")), cell("Number", number), cell("Other", F.lit("x")))
    rows = table(spark, sf_dir, "events").select("event_id", cells.alias("cells"))
    title = F.coalesce(rc.key_value(F.col("cells"), "Title"), F.concat(F.lit("event-"), F.col("event_id").cast("string")))
    return rows.select("event_id", rc.key_value(F.col("cells"), "Number").alias("k"), title.alias("title")).where("k is not null")


@query("WITH t AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'Klagen' WHEN 1 THEN 'Nævnets vurdering' WHEN 2 THEN 'Konklusion' WHEN 3 THEN 'Klagers bemærkninger' ELSE 'Bilag' END AS title, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations), b AS (SELECT *, CASE WHEN title = 'Nævnets vurdering' THEN 100e0 + 25 + 15 WHEN title = 'Konklusion' THEN 93e0 ELSE 0e0 END AS base FROM t) SELECT conv_id, turn, title, round_even(CASE WHEN starts_with(title, 'Klag') THEN -100e0 WHEN base > 0 AND total > 1 THEN base + 4.0e0 * turn / (total - 1) ELSE base END, 6) AS points FROM b")
def board_points(spark, sf_dir):
    from pyspark.sql import Window

    kind = F.col("turn") % 5
    title = F.when(kind == 0, "Klagen").when(kind == 1, "Nævnets vurdering").when(kind == 2, "Konklusion").when(kind == 3, "Klagers bemærkninger").otherwise("Bilag")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", title.alias("title"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("total"))
    points = rc.board_points(F.col("title"), F.col("turn"), F.col("total"), ("klagen", "klagers"), ("nævnets vurdering", "konklusion"))
    return turns.select("conv_id", "turn", "title", F.bround(points, 6).alias("points"))


@query("SELECT '| ' || event_type || ' | ' || count(*) || ' | ' || printf('%.1f', round_even(avg(value), 1)) || ' |' AS line FROM events GROUP BY event_type")
def report_lines(spark, sf_dir):
    each = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("value"), 1).alias("mean"))
    return each.select(F.format_string("| %s | %d | %.1f |", "event_type", "n", "mean").alias("line"))


@query("SELECT doc_id, substr(concat_ws(chr(10), split_part(coalesce(text, ''), chr(10), 1), lang, source), 1, 1500) AS said, regexp_extract('Reason.' || chr(10) || 'UDFALD: ' || CASE WHEN doc_id % 2 = 0 THEN 'Medhold' ELSE 'Ikke medhold' END, 'UDFALD:[ ]*(Delvis medhold|Ikke medhold|Medhold|Afvist)', 1) AS predicted FROM documents")
def draft_and_prediction(spark, sf_dir):
    """The text a draft is searched by, and the outcome that a labelled last line predicts."""
    docs = table(spark, sf_dir, "documents")
    answer = F.concat(F.lit("Reason.\nUDFALD: "), F.when(F.col("doc_id") % 2 == 0, "Medhold").otherwise("Ikke medhold"))
    return docs.select("doc_id", F.substring(F.concat_ws("\n", tx.title(F.col("text")), "lang", "source"), 1, 1500).alias("said"), F.regexp_extract(answer, "UDFALD:[ ]*(Delvis medhold|Ikke medhold|Medhold|Afvist)", 1).alias("predicted"))
