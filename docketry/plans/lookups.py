"""Queries over lookups, joins by any of several keys, phrases, numbered contexts, folders, reviews, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import danish
from docketry.functions.text import folded, title
from docketry.operators import lookups as lk
from docketry.operators import ordered as od
from docketry.plans.danish import cases, joined
from docketry.plans.registry import query, table

_FOLD = r"lower(trim(regexp_replace(coalesce({0}, ''), '[ \t\n\r\f]+', ' ', 'g')))"


@query("""WITH wanted AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey * 3 AS VARCHAR) ELSE 'Customer#' || lpad(CAST(n_nationkey * 7 AS VARCHAR), 9, '0') END AS key FROM nation)
    SELECT n_nationkey, key, c_custkey, c_mktsegment FROM wanted LEFT JOIN customer ON key = CAST(c_custkey AS VARCHAR) OR key = c_name""")
def point_lookup(spark, sf_dir):
    """Customers by key, else by name."""
    n = F.col("n_nationkey")
    wanted = table(spark, sf_dir, "nation").select("n_nationkey", F.when(n % 2 == 0, (n * 3).cast("string")).otherwise(F.concat(F.lit("Customer#"), F.lpad((n * 7).cast("string"), 9, "0"))).alias("key"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return lk.found(wanted, rows, [F.col("c_custkey").cast("string"), F.col("c_name")], "c_custkey").select("n_nationkey", "key", "c_custkey", "c_mktsegment")


_PHRASES = f"""units AS (SELECT doc_id * 1000 + i AS unit, {_FOLD.format("lines[i]")} AS said FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)) WHERE i < 1000),
    words AS (SELECT item_id, string_split({_FOLD.format('text')}, ' ') AS w FROM benchmark),
    phrases AS (SELECT DISTINCT query, phrase FROM (SELECT item_id AS query, unnest([array_to_string(w[1:4], ' '), array_to_string(w[7:8], ' ')]) AS phrase FROM words) WHERE phrase <> '')"""


@query(f"""WITH {_PHRASES}, hits AS (SELECT query, unit, count(*) AS matches, max(length(phrase)) AS longest, max(length(said)) AS size FROM units JOIN phrases ON contains(said, phrase) GROUP BY query, unit)
    SELECT query, unit, matches, longest, row_number() OVER (PARTITION BY query ORDER BY matches DESC, longest DESC, size, unit) AS rank FROM hits QUALIFY rank <= 20""")
def phrase_paragraphs(spark, sf_dir):
    """Lines of documents that hold two phrases of a benchmark item: its first four words, and its seventh and eighth."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line")).where("i < 999")
    units = lines.select((F.col("doc_id") * 1000 + F.col("i") + 1).alias("unit"), folded(F.col("line")).alias("said"))
    w = F.split(folded(F.col("text")), " ")
    phrases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array(F.array_join(F.slice(w, 1, 4), " "), F.array_join(F.slice(w, 7, 2), " "))).alias("phrase"))
    return lk.phrase_hits(units, phrases)


@query("""WITH results AS (SELECT doc_id, ['id:' || doc_id, 'lang:' || coalesce(lang, '') || ':' || doc_id % 50] AS keys FROM documents WHERE doc_id % 3 = 0),
    qrels AS (SELECT doc_id AS pos, CASE WHEN doc_id % 2 = 0 THEN 'id:' || doc_id ELSE 'lang:' || coalesce(lang, '') || ':' || doc_id % 50 END AS key, doc_id % 3 AS rel FROM documents WHERE doc_id % 7 = 0)
    SELECT doc_id, pos, rel FROM (SELECT doc_id, unnest(keys) AS key FROM results) JOIN qrels USING (key) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1""")
def judgements_by_any_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    by_id, by_lang = F.concat(F.lit("id:"), F.col("doc_id").cast("string")), F.concat(F.lit("lang:"), F.coalesce("lang", F.lit("")), F.lit(":"), (F.col("doc_id") % 50).cast("string"))
    qrels = docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 2 == 0, by_id).otherwise(by_lang).alias("key"), (F.col("doc_id") % 3).alias("rel"))
    results = docs.where("doc_id % 3 = 0").select("doc_id", F.array(by_id, by_lang).alias("keys"))
    return lk.judged_by_any(results, F.col("keys"), qrels, "pos", "key").select("doc_id", "pos", "rel")


@query(f"""WITH n AS (SELECT count(*) AS n FROM benchmark), runs AS (SELECT item_id, doc_id, {_FOLD.format('d.text')} AS said, {_FOLD.format('b.text')} AS item FROM documents d, n JOIN benchmark b ON b.item_id = d.doc_id % n.n)
    SELECT item_id, count(*) AS results, count(*) FILTER (WHERE CAST(doc_id AS VARCHAR) = CAST(item_id AS VARCHAR) OR contains(said, array_to_string(string_split(item, ' ')[1:2], ' '))) AS expected FROM runs GROUP BY item_id""")
def expected_in_results(spark, sf_dir):
    """How many of the documents dealt to an item are the one expected by number or hold the item's first two words."""
    items = table(spark, sf_dir, "benchmark").select("item_id", folded(F.col("text")).alias("item"))
    runs = table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(items.count() or 1)).alias("item_id"), folded(F.col("text")).alias("said")).join(items, "item_id")
    hit = (F.col("doc_id") == F.col("item_id")) | F.contains("said", F.array_join(F.slice(F.split("item", " "), 1, 2), " "))
    return runs.groupBy("item_id").agg(F.count(F.lit(1)).alias("results"), F.sum(hit.cast("int")).cast("long").alias("expected"))


@query("""WITH hits AS (SELECT doc_id % 25 AS query, doc_id // 5 % 40 AS doc, doc_id AS rank, substr(coalesce(text, ''), 1, 900) AS text FROM documents),
    sources AS (SELECT DISTINCT query, doc, dense_rank() OVER (PARTITION BY query ORDER BY doc) AS number FROM hits WHERE doc % 2 = 0),
    mine AS (SELECT h.*, number FROM hits h JOIN sources USING (query, doc) QUALIFY row_number() OVER (PARTITION BY query, doc ORDER BY rank) <= 3),
    blocks AS (SELECT *, '[Kilde ' || number || '] ' || 'sag ' || doc || chr(10) || text AS block FROM mine)
    SELECT query, doc, row_number() OVER w AS place, number, block, (sum(length(block) + 2) OVER w - 2)::BIGINT AS used FROM blocks WINDOW w AS (PARTITION BY query ORDER BY rank) QUALIFY used <= 14000""")
def numbered_citation_context(spark, sf_dir):
    """Paragraphs of sources under their numbers, three of each, within 14,000 characters."""
    i = F.col("doc_id")
    hits = table(spark, sf_dir, "documents").select((i % 25).alias("query"), (F.floor(i / 5) % 40).alias("doc"), i.alias("rank"), F.substring(F.coalesce("text", F.lit("")), 1, 900).alias("text"))
    known = hits.where("doc % 2 = 0").select("query", "doc").distinct()
    sources = od.first_per_group(known, ["query"], ["doc"], 1 << 30).withColumnRenamed("place", "number")
    return lk.numbered_context(hits, sources, F.concat(F.lit("sag "), F.col("doc").cast("string")), "text")


@query("SELECT conv_id, turn, doc_id, substr(split_part(coalesce(d.text, ''), chr(10), 1), 1, 60) AS title, lang FROM conversations c JOIN documents d ON d.doc_id = c.conv_id * 3 + c.turn")
def history_sources(spark, sf_dir):
    """Documents that the turns of a talk refer to, by id."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 3 + F.col("turn")).alias("doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring(title(F.col("text")), 1, 60).alias("title"), "lang")
    return turns.join(docs, "doc_id").select("conv_id", "turn", "doc_id", "title", "lang")


@query("""WITH cores AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS docs FROM conversations),
    sized AS (SELECT *, greatest(550, least(1400, 12000 // docs)) AS each, least(n, greatest(greatest(550, least(1400, 12000 // docs)), CASE place WHEN 1 THEN 4000 WHEN 2 THEN 2200 WHEN 3 THEN 2200 ELSE 0 END)) + 42 AS size FROM cores)
    SELECT conv_id, place::INTEGER AS place, size::INTEGER AS size, (100 + sum(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM sized QUALIFY used <= least(18000, 500 + docs * (each + 180))""")
def grounding_budgets(spark, sf_dir):
    """Turns of a talk as cores within their budgets."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return lk.grounding_blocks(turns, "conv_id", "turn", "text")


@query("SELECT o_orderkey, year(o_orderdate) AS year, o_totalprice FROM orders WHERE year(o_orderdate) >= 1995 AND o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 50000 AND 200000")
def sampling_filter(spark, sf_dir):
    year = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").where((year >= 1995) & F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(50_000, 200_000)).select("o_orderkey", year.cast("long").alias("year"), "o_totalprice")


@query("SELECT year(o_orderdate) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) >= (SELECT max(year(o_orderdate)) FROM orders) - 4 GROUP BY 1")
def recent_years(spark, sf_dir):
    """The last five years that there are."""
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year"))
    return orders.groupBy("year").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(orders.agg(F.max("year").alias("last"))), F.col("year") >= F.col("last") - 4).select("year", "n")


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_name, p_partkey) AS place FROM part QUALIFY place <= 5")
def tie_key_order(spark, sf_dir):
    """The five first of a brand by four keys."""
    return od.first_per_group(table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_size"), F.desc("p_retailprice"), "p_name", "p_partkey"], 5).select("p_brand", "p_partkey", "place")


@query("""WITH joined_ AS (SELECT lang, l.doc_id, quality = 1 AND toxic = 0 AS passed, n_chars % 4 AS wanted, least(n_chars % 4, n_chars % 3) AS got, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS leaked, n_chars % 2 + 1 AS forbidden FROM labels l JOIN documents d USING (doc_id))
    SELECT coalesce(lang, 'uncategorised') AS category, count(*) AS cases, count(*) FILTER (WHERE passed) AS passed, round_even(sum(got) / sum(wanted), 6) AS term_recall, round_even(sum(leaked) / sum(forbidden), 6) AS leakage FROM joined_ GROUP BY 1""")
def pass_and_leak_rates(spark, sf_dir):
    """Cases by category: passed, terms found of those wanted, forbidden ones leaked."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    wanted, share = F.col("n_chars") % 4, lambda a, b: F.bround(F.sum(a) / F.sum(b), 6)
    passed = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return both.groupBy(F.coalesce("lang", F.lit("uncategorised")).alias("category")).agg(
        F.count(F.lit(1)).alias("cases"), F.sum(passed.cast("int")).cast("long").alias("passed"), share(F.least(wanted, F.col("n_chars") % 3), wanted).alias("term_recall"),
        share(F.when(F.col("toxic") == 1, 1).otherwise(0), F.col("n_chars") % 2 + 1).alias("leakage"),
    )


@query("""WITH m AS (SELECT doc_id AS query, CASE WHEN quality = 1 THEN doc_id % 11 / 10.0e0 END AS recall, CASE WHEN doc_id % 5 > 0 THEN 1.0e0 / (doc_id % 5) END AS rr FROM labels)
    SELECT (SELECT count(*) FROM m) AS questions, (SELECT round_even(avg(recall), 6) FROM m) AS mean_recall, (SELECT round_even(avg(rr), 6) FROM m) AS mrr,
           (SELECT count(*) FROM labels ANTI JOIN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0) r USING (doc_id)) AS missing, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id) WHERE doc_id % 4 <> 0) AS unbenchmarked""")
def report_aggregate(spark, sf_dir):
    """Means over the queries that have a metric, and questions without results or without judgements."""
    labels, results = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("doc_id % 4 <> 0").select("doc_id")
    i = F.col("doc_id")
    means = labels.agg(F.count(F.lit(1)).alias("questions"), F.bround(F.avg(F.when(F.col("quality") == 1, (i % 11) / F.lit(10.0))), 6).alias("mean_recall"), F.bround(F.avg(F.when(i % 5 > 0, 1.0 / F.when(i % 5 > 0, i % 5))), 6).alias("mrr"))
    missing = labels.join(results, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    alien = results.join(labels, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("unbenchmarked"))
    # Three tables of one row.
    return means.crossJoin(missing).crossJoin(alien)


@query("""WITH rows_ AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 'guardrail' ELSE 'treated' END AS cohort, CASE WHEN conv_id % 2 = 0 THEN 'dev' ELSE 'holdout' END AS split, conv_id % 7 AS topic, length(text) % 3 = 0 AS changed, length(text) % 6 = 0 AS listed FROM conversations)
    SELECT cohort, split, count(*) AS queries, count(*) FILTER (WHERE changed) AS applied, count(DISTINCT CASE WHEN changed THEN topic END) AS topics, count(*) FILTER (WHERE listed) AS lists, count(*) FILTER (WHERE cohort = 'guardrail' AND (changed OR listed)) AS violations FROM rows_ GROUP BY cohort, split""")
def cohort_effect(spark, sf_dir):
    """What a planner changes, by cohort and split; any change of a guardrail is a violation."""
    i, n = F.col("conv_id"), F.length("text")
    rows = table(spark, sf_dir, "conversations").select(
        F.when(i % 3 == 0, "guardrail").otherwise("treated").alias("cohort"), F.when(i % 2 == 0, "dev").otherwise("holdout").alias("split"), (i % 7).alias("topic"), (n % 3 == 0).alias("changed"), (n % 6 == 0).alias("listed")
    )
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return rows.groupBy("cohort", "split").agg(
        F.count(F.lit(1)).alias("queries"), count(F.col("changed")).alias("applied"), F.countDistinct(F.when(F.col("changed"), F.col("topic"))).alias("topics"), count(F.col("listed")).alias("lists"),
        count((F.col("cohort") == "guardrail") & (F.col("changed") | F.col("listed"))).alias("violations"),
    )


@query("""WITH source AS (SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0), reviews AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN 'maybe' ELSE 'Direct_Support' END AS label, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'ab' END AS reviewer FROM labels
        UNION ALL SELECT doc_id, 'uncertain', 'ab' FROM labels WHERE doc_id % 17 = 0),
    said AS (SELECT id, lower(trim(label)) AS label, trim(reviewer) AS reviewer FROM reviews)
    SELECT id, fault FROM (SELECT id, 'missing label' AS fault FROM said WHERE label = '' UNION ALL SELECT id, 'unknown label' FROM said WHERE label NOT IN ('', 'direct_support', 'indirect_support', 'not_useful', 'uncertain') UNION ALL SELECT id, 'missing reviewer' FROM said WHERE label <> '' AND reviewer = ''
        UNION ALL SELECT id, 'duplicate' FROM said GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT id, 'not in source' FROM said WHERE id NOT IN (SELECT id FROM source) UNION ALL SELECT id, 'not reviewed' FROM source WHERE id NOT IN (SELECT id FROM said))""")
def review_validation(spark, sf_dir):
    labels, i = table(spark, sf_dir, "labels"), F.col("doc_id")
    source = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(i.alias("id"))
    first = labels.select(i.alias("id"), F.when(i % 11 == 0, "").when(i % 13 == 0, "maybe").otherwise("Direct_Support").alias("label"), F.when(i % 5 == 0, " ").otherwise("ab").alias("reviewer"))
    second = labels.where("doc_id % 17 = 0").select(i.alias("id"), F.lit("uncertain").alias("label"), F.lit("ab").alias("reviewer"))
    return lk.review_faults(first.unionByName(second), source, "id", "label", "reviewer", ("direct_support", "indirect_support", "not_useful", "uncertain"))


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('review|' || doc_id), doc_id) AS place, CASE WHEN quality = 1 THEN 2 WHEN quality = 0 THEN 0 ELSE -1 END AS relevance FROM labels QUALIFY place <= 100")
def review_preparation(spark, sf_dir):
    """The first hundred rows in a blind order, with what their label is worth when frozen."""
    blind = F.sha2(F.concat(F.lit("review|"), F.col("doc_id").cast("string")).cast("binary"), 256)
    worth = F.when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 0).otherwise(-1)
    first = table(spark, sf_dir, "labels").select("doc_id", blind.alias("blind"), worth.alias("relevance")).orderBy("blind", "doc_id").limit(100)
    return od.first_per_group(first.withColumn("all", F.lit(1)), ["all"], ["blind", "doc_id"], 100).select("doc_id", "place", "relevance")


@query("""WITH a AS (SELECT source, sum(('0x' || substr(md5(doc_id || '|' || coalesce(lang, '')), 1, 12))::BIGINT)::VARCHAR AS digest, count(*) AS n FROM documents GROUP BY source),
    b AS (SELECT source, sum(('0x' || substr(md5(CASE WHEN doc_id % 29 = 0 THEN doc_id + 1 ELSE doc_id END || '|' || coalesce(lang, '')), 1, 12))::BIGINT)::VARCHAR AS digest, count(*) AS n FROM documents WHERE source NOT LIKE '%1' GROUP BY source)
    SELECT coalesce(a.source, b.source) AS source, CASE WHEN b.source IS NULL THEN 'only first' WHEN a.digest = b.digest AND a.n = b.n THEN 'same' ELSE 'different' END AS state FROM a LEFT JOIN b USING (source)""")
def package_fingerprints(spark, sf_dir):
    """Two packages of documents compared by source."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    row = lambda n: F.concat_ws("|", n.cast("string"), F.coalesce("lang", F.lit("")))
    other = lk.fingerprint(docs.where(~F.endswith("source", F.lit("1"))), "source", row(F.when(i % 29 == 0, i + 1).otherwise(i)))
    return lk.compared(lk.fingerprint(docs, "source", row(i)), other, "source")


@query("SELECT n_nationkey AS id, n_name AS name, n_nationkey = 1 AS \"default\" FROM nation WHERE n_nationkey <> 0")
def folder_deletion(spark, sf_dir):
    """Folders after the default one is deleted."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_nationkey") == 0).alias("default"))
    return lk.folders_without(nations, F.col("id") == 0)


@query("SELECT l_partkey AS link, min_by(l_orderkey % 50, struct_pack(a := l_orderkey, b := l_orderkey % 50)) AS folder, count(DISTINCT l_orderkey % 50) AS folders FROM lineitem GROUP BY l_partkey")
def links_and_folders(spark, sf_dir):
    """All saved links with the first folder of each."""
    saved = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("link"), (F.col("l_orderkey") % 50).alias("folder"), F.col("l_orderkey").alias("place"))
    return lk.first_folder(saved, "folder", "link", "place")


@query("SELECT o_orderkey, o_orderpriority || ' / ' || o_orderstatus AS category, CASE WHEN o_orderkey % 3 = 0 THEN 'engang i 19' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def folder_item_rows(spark, sf_dir):
    """Rows as folder items: categories in one text, the date as it parses, else its first characters."""
    said = F.when(F.col("o_orderkey") % 3 == 0, F.lit("engang i 1997, måske")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    day = F.coalesce(F.date_format(F.try_to_timestamp(said, F.lit("yyyy-MM-dd HH:mm:ss")), "yyyy-MM-dd"), F.substring(said, 1, 11))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" / ", F.array("o_orderpriority", "o_orderstatus")).alias("category"), day.alias("day"))


@query("WITH registry(lang, names) AS (VALUES ('en', 'planning;zoning'), ('*', 'general')) SELECT doc_id, coalesce(r.names, g.names, '') AS names FROM documents d LEFT JOIN registry r ON r.lang = d.lang JOIN registry g ON g.lang = '*'")
def guideline_lookup(spark, sf_dir):
    """The guidelines of a document's kind, else the general ones."""
    registry = spark.createDataFrame([("en", "planning;zoning"), ("*", "general")], "lang string, names string")
    general = registry.where("lang = '*'").select(F.col("names").alias("general"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(F.broadcast(registry.where("lang <> '*'")), "lang", "left").crossJoin(F.broadcast(general)).select("doc_id", F.coalesce("names", "general", F.lit("")).alias("names"))


@query("""WITH cards AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('quiz' || p_partkey), p_partkey) AS place, p_size % 4 AS said, p_partkey % 4 AS meant FROM part QUALIFY place <= 10)
    SELECT p_brand, count(*) AS cards, count(*) FILTER (WHERE said = meant) AS right_, round(100.0e0 * count(*) FILTER (WHERE said = meant) / count(*))::BIGINT AS score FROM cards GROUP BY p_brand""")
def quiz_scores(spark, sf_dir):
    """Ten cards of each deck in a seeded order, and the share answered right."""
    blind = F.sha2(F.concat(F.lit("quiz"), F.col("p_partkey").cast("string")).cast("binary"), 256)
    cards = od.first_per_group(table(spark, sf_dir, "part").withColumn("blind", blind), ["p_brand"], ["blind", "p_partkey"], 10)
    right = F.sum((F.col("p_size") % 4 == F.col("p_partkey") % 4).cast("int")).cast("long")
    return cards.groupBy("p_brand").agg(F.count(F.lit(1)).alias("cards"), right.alias("right_"), F.round(100.0 * right / F.count(F.lit(1))).cast("long").alias("score"))


@query("SELECT doc_id, 'SAG ' || doc_id || chr(10) || 'Kilde: ' || coalesce(source, '–') || chr(10) || 'Sprog: ' || coalesce(upper(lang), '–') || chr(10) || repeat('-', 20) AS said FROM documents")
def board_text_export(spark, sf_dir):
    dash = F.lit("–")
    return table(spark, sf_dir, "documents").select("doc_id", F.format_string("SAG %d\nKilde: %s\nSprog: %s\n%s", F.col("doc_id"), F.coalesce("source", dash), F.coalesce(F.upper("lang"), dash), F.lit("-" * 20)).alias("said"))


@query("SELECT count(DISTINCT label) AS documents, count(*) AS vectors, min(len(embedding)) AS narrowest, max(len(embedding)) AS widest, count(*) = count(DISTINCT vec_id) AND min(len(embedding)) = max(len(embedding)) AS valid FROM embeddings")
def vector_table_check(spark, sf_dir):
    """Whether a table of vectors is one that can be searched: each id once, all of one length."""
    v, n = table(spark, sf_dir, "embeddings"), F.size("embedding")
    return v.agg(F.countDistinct("label").alias("documents"), F.count(F.lit(1)).alias("vectors"), F.min(n).cast("long").alias("narrowest"), F.max(n).cast("long").alias("widest"), ((F.count(F.lit(1)) == F.countDistinct("vec_id")) & (F.min(n) == F.max(n))).alias("valid"))


@query("""WITH each AS (SELECT 'decision:' || p_partkey AS source, f[1] AS field, lower(f[2]) AS value FROM (SELECT p_partkey, unnest([['brands', p_brand], ['types', p_type], ['sizes', CAST(p_size AS VARCHAR)]]) AS f FROM part)),
    edges AS (SELECT DISTINCT source, 'feature:' || field || ':' || substr(sha1(field || ':' || value), 1, 14) AS target, 'has_' || regexp_replace(field, 's$', '') AS relation, value, field FROM each)
    SELECT 'edge' AS kind, source AS id, target AS other, relation AS label FROM edges UNION ALL SELECT DISTINCT 'node', target, field, value FROM edges UNION ALL SELECT DISTINCT 'node', source, 'decision', '' FROM edges""")
def graph_build(spark, sf_dir):
    """Nodes and edges of the graph of decisions and their features, each once."""
    pair = lambda f, c: F.struct(F.lit(f).alias("field"), F.lower(F.col(c).cast("string")).alias("value"))
    each = table(spark, sf_dir, "part").select(F.concat(F.lit("decision:"), F.col("p_partkey").cast("string")).alias("source"), F.explode(F.array(pair("brands", "p_brand"), pair("types", "p_type"), pair("sizes", "p_size"))).alias("x")).select("source", "x.*")
    short = F.substring(F.sha1(F.concat_ws(":", "field", "value").cast("binary")), 1, 14)
    edges = each.select("source", F.concat(F.lit("feature:"), F.col("field"), F.lit(":"), short).alias("target"), F.concat(F.lit("has_"), F.regexp_replace("field", "s$", "")).alias("relation"), "value", "field").distinct()
    row = lambda kind, *c: [F.lit(kind).alias("kind"), *(x.alias(n) for x, n in zip(c, ("id", "other", "label"), strict=True))]
    nodes = edges.select(*row("node", F.col("target"), F.col("field"), F.col("value"))).distinct().unionByName(edges.select(*row("node", F.col("source"), F.lit("decision"), F.lit(""))).distinct())
    return edges.select(*row("edge", F.col("source"), F.col("target"), F.col("relation"))).unionByName(nodes)


cases("phrase_matches", "said phrase", "held", [
    ("Taget er\n utæt", "taget er  utæt", True), ("Taget er utæt", "TAGET ER", True), ("Taget", "", False), ("Tag", "taget", False), (None, "tag", False),
], lambda said, phrase: [(folded(phrase) != "") & F.contains(folded(said), folded(phrase))])

_SECTIONS = (("§ 1", "1", "Formål", "Loven skal sikre"), ("§ 35", "7", "Landzoner", "Udstykning kræver tilladelse"), ("§ 35 a", "7", "Landzoner", "Uden tilladelse"))
cases("statute_lookup", "said", "found", [
    ("§ 35", "§ 35"), ("35 a", "§ 35 a"), ("landzoner", "§ 35;§ 35 a"), ("TILLADELSE", "§ 35;§ 35 a"), ("", "§ 1;§ 35;§ 35 a"), ("§ 99", ""), (None, "§ 1;§ 35;§ 35 a"),
], lambda said: [joined(F.transform(lk.statute_hits(said, F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(s, ("para", "chapter", "title", "text"), strict=True))) for s in _SECTIONS))), lambda s: s["para"]))])

cases("guideline_chunk_filter", "query", "chunks", [
    ("støj", "Om støj;Mere støj"), ("af lugt", "Lugt"), ("xyz", "Om støj;Lugt;Mere støj;Lys;Vand"), ("om", "Om støj;Lugt;Mere støj;Lys;Vand"),
], lambda query: [joined(lk.guideline_chunks(F.array(*map(F.lit, ("Om støj", "Lugt", "Mere støj", "Lys", "Vand", "Jord"))), query))])

cases("prompt_excerpts", "said", "found", [
    ("Intro\n[Kilde 1] A\nmere\n[AFGØRELSESKERNE Kilde 2] B", "1:A mere;2:B"), ("Ingen [Kilde 1] midt i", ""), (None, ""),
], lambda said: [joined(F.transform(lk.excerpt_blocks(said), lambda x: F.concat_ws(":", x["source"].cast("string"), x["text"])))])

cases("reference_contexts", "said ref", "around", [
    ("Se vejledning om støj her.", "Vejledning om støj", "Se vejledning om støj her.…"), ("x" * 150 + " vejledning om støj", "Vejledning om støj", "…" + "x" * 99 + " vejledning om støj…"), ("Intet", "Vejledning", ""),
], lambda said, ref: [danish.reference_context(said, ref)])

cases("term_variants", "term said", "held", [
    ("taget", "Et nyt tag", False), ("vinduet", "to vinduer", True), ("kælderen", "i en kælder", True), ("under taget", "under tag", False), ("tag", "taget", True),
], lambda term, said: [F.contains(folded(said), folded(term)) | ((F.length(folded(term)) >= 6) & folded(term).rlike("^[^ ]+(en|et)$") & F.contains(folded(said), F.regexp_replace(folded(term), "(en|et)$", "")))])

_TOKENS = {"words": "[a-zæøå0-9]+", "letters": "[a-zæøå][a-zæøå-]+", "long": "[a-zæøå0-9_]{4,}"}


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(lower(coalesce(text, '')), '{p}'))::INTEGER AS {n}" for n, p in _TOKENS.items()) + " FROM documents")
def tokenisers(spark, sf_dir):
    """How many tokens of three kinds a text has."""
    low = F.lower(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", *(F.size(F.regexp_extract_all(low, F.lit(p), F.lit(0))).alias(n) for n, p in _TOKENS.items()))


cases("match_stems", "word", "loose tight", [
    ("skaderne", "skad", "skad"), ("tagene", "tagen", "tagen"), ("husene", "husen", "husen"), ("gulvet", "gulv", "gulv"), ("afgørelsernes", "afgørelsernes", "afgørels"), ("taget", "taget", "taget"), ("boligens", "boligens", "boligen"),
], lambda word: [F.regexp_replace(word, "^(.{4,}?)(?:erne|ene|er|en|et|e)$", "$1"), lex_stem(word)])


def lex_stem(word):
    """The word without the first of the reasoning's endings that leaves four letters."""
    from docketry.operators.reasoning import SUFFIXES

    cut = [F.when(F.endswith(word, F.lit(s)) & (F.length(word) - len(s) >= 4), F.substring(word, F.lit(1), F.length(word) - len(s))) for s in SUFFIXES]
    return F.coalesce(*cut, word)


@query("""WITH r AS (SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part)
    SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size % 5 > 0 THEN p_size END DESC NULLS LAST, p_partkey) AS down, row_number() OVER (ORDER BY CASE WHEN p_size % 5 > 0 THEN p_size END ASC NULLS LAST, p_partkey) AS up FROM r QUALIFY down <= 30""")
def nulls_last_both_ways(spark, sf_dir):
    """The thirty first by size downwards, nulls last, with their place upwards, nulls last."""
    from pyspark.sql import Window

    sized = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 5 > 0, F.col("p_size")).alias("size"))
    # Places come from counts by size, so that no window holds all rows.
    counts = sized.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    all_sizes = Window.orderBy
    down = counts.withColumn("before_down", F.coalesce(F.sum("n").over(all_sizes(F.desc_nulls_last("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = down.withColumn("before_up", F.coalesce(F.sum("n").over(all_sizes(F.asc_nulls_last("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n").withColumnRenamed("size", "of")
    # A row for a size.
    held = sized.join(F.broadcast(both), F.col("size").eqNullSafe(F.col("of"))).where("before_down < 30")
    place = F.row_number().over(Window.partitionBy("size").orderBy("p_partkey"))
    return held.select("p_partkey", (F.col("before_down") + place).alias("down"), (F.col("before_up") + place).alias("up")).where("down <= 30")


@query("""WITH hits AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title, text, 2000 + doc_id % 20 AS year FROM documents WHERE contains(lower(coalesce(text, '')), 'en d'))
    SELECT doc_id, year, row_number() OVER (ORDER BY year DESC, doc_id) AS place FROM hits QUALIFY place <= 50""")
def newest_literal_hits(spark, sf_dir):
    """The fifty newest texts that hold the words as they are, case aside."""
    from docketry.operators.filters import holds

    docs = table(spark, sf_dir, "documents").select("doc_id", title(F.col("text")).alias("title"), "text", (2000 + F.col("doc_id") % 20).alias("year"))
    first = docs.where(holds(F.lit("en d"), F.col("title"), F.col("text"))).select("doc_id", "year").orderBy(F.desc("year"), "doc_id").limit(50)
    return od.first_per_group(first.withColumn("all", F.lit(1)), ["all"], [F.desc("year"), "doc_id"], 50).select("doc_id", "year", "place")


@query("""WITH q(query, identifier) AS (VALUES (0, 'customer#000000012'), (1, '00003'), (2, 'building')),
    rows_ AS (SELECT c_custkey AS doc, lower(c_name) AS number, '' AS link, lower(c_mktsegment) AS title FROM customer)
    SELECT query, doc, (CASE WHEN number = identifier THEN 400 ELSE 180 END)::BIGINT AS score FROM rows_, q WHERE contains(number, identifier) OR contains(title, identifier)""")
def identifier_points(spark, sf_dir):
    """Points for numbers that a row has or holds."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.col("c_name").alias("number"), F.lit("").alias("link"), F.col("c_mktsegment").alias("title"))
    return lk.exact_points(rows, spark.createDataFrame([(0, "customer#000000012"), (1, "00003"), (2, "building")], "query int, identifier string"), "number", "link", "title")


@query("""WITH f AS (SELECT p_partkey AS doc, unnest(['brand:' || p_brand, 'type:' || p_type]) AS feature FROM part), seen AS (SELECT feature, count(*) AS df FROM f GROUP BY feature), n AS (SELECT count(*) AS n FROM part),
    mine AS (SELECT doc AS query, feature FROM f)
    SELECT query, doc, feature, round_even(1.0e0 + ln((n + 1.0e0) / (df + 1.0e0)), 6) AS contribution FROM f JOIN mine USING (feature) JOIN seen USING (feature), n WHERE query <> doc""")
def feature_contributions(spark, sf_dir):
    """What each shared feature adds to two items' relation, for all pairs of items."""
    from docketry.operators.graph import contributions

    parts = table(spark, sf_dir, "part")
    each = parts.select(F.col("p_partkey").alias("doc"), F.explode(F.array(F.concat(F.lit("brand:"), "p_brand"), F.concat(F.lit("type:"), "p_type"))).alias("feature"))
    return contributions(each, F.lit(True), F.lit(True), parts.count())


@query("""WITH run AS (SELECT doc_id % 40 AS query, doc_id AS doc, doc_id // 40 AS rank, coalesce(text, '') AS text FROM documents WHERE doc_id // 40 < 20), rel AS (SELECT doc_id AS doc FROM labels WHERE quality = 1),
    judged AS (SELECT r.*, rel.doc IS NOT NULL AS good FROM run r LEFT JOIN rel USING (doc)),
    per AS (SELECT query, sum(CASE WHEN good AND rank < 10 THEN 1.0e0 / log2(rank + 2.0e0) ELSE 0 END) AS dcg, count(*) FILTER (WHERE good) AS wanted, count(DISTINCT doc) AS decisions, bool_or(contains(lower(text), 'an the')) AS phrase,
                   (CASE WHEN bool_or(contains(lower(text), 'the')) THEN 1 ELSE 0 END + CASE WHEN bool_or(contains(lower(text), 'und')) THEN 1 ELSE 0 END) / 2.0e0 AS terms FROM judged GROUP BY query)
    SELECT query, round_even(dcg / (SELECT sum(1.0e0 / log2(i + 2.0e0)) FROM range(0, least(10, wanted)) t(i)), 6) AS ndcg, terms, phrase, decisions FROM per WHERE wanted > 0""")
def eval_binary_rest(spark, sf_dir):
    """Binary NDCG at 10, the share of terms that the first twenty texts hold, whether a phrase is hit, how many decisions."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    run = docs.where("floor(doc_id / 40) < 20").select((i % 40).alias("query"), i.alias("doc"), F.floor(i / 40).cast("int").alias("rank"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select(i.alias("doc"), F.lit(True).alias("good"))
    both = run.join(good, "doc", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    has = lambda s: F.max(F.contains("text", F.lit(s)))
    per = both.groupBy("query").agg(
        F.sum(F.when(F.col("good") & (F.col("rank") < 10), 1.0 / F.log2(F.col("rank") + 2.0)).otherwise(0.0)).alias("dcg"), F.sum(F.col("good").cast("int")).cast("int").alias("wanted"), F.countDistinct("doc").alias("decisions"), has("an the").alias("phrase"),
        ((has("the").cast("int") + has("und").cast("int")) / F.lit(2.0)).alias("terms"),
    )
    ideal = F.aggregate(F.sequence(F.lit(0), F.least(F.lit(10), F.col("wanted")) - 1), F.lit(0.0), lambda a, x: a + 1.0 / F.log2(x + 2.0))
    return per.where("wanted > 0").select("query", F.bround(F.col("dcg") / ideal, 6).alias("ndcg"), "terms", "phrase", "decisions")


@query("""WITH f AS (SELECT p_partkey AS doc, p_brand AS feature FROM part WHERE p_size > 5) SELECT 'isolated' AS kind, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT doc FROM f) UNION ALL SELECT 'linked', count(DISTINCT doc) FROM f""")
def isolated_nodes(spark, sf_dir):
    """Items without a feature, and with one."""
    parts = table(spark, sf_dir, "part")
    linked = parts.where("p_size > 5").select("p_partkey").distinct()
    alone = parts.join(linked, "p_partkey", "left_anti").agg(F.lit("isolated").alias("kind"), F.count(F.lit(1)).alias("n"))
    return alone.unionByName(linked.agg(F.lit("linked").alias("kind"), F.count(F.lit(1)).alias("n")))


@query("""WITH b(metric, value, ms) AS (VALUES ('ndcg', 0.70e0, 100), ('recall_20', 0.90e0, 100), ('mrr', 0.50e0, 100)), c(metric, value, ms) AS (VALUES ('ndcg', 0.68e0, 120), ('recall_20', 0.87e0, 120), ('hits', 0.50e0, 120))
    SELECT coalesce(b.metric, c.metric) AS metric, coalesce(c.value - b.value >= -(CASE WHEN b.metric = 'recall_20' THEN 0.02e0 ELSE 0.03e0 END + 1e-12), false) AND coalesce(c.ms / b.ms::DOUBLE <= 1.25e0, false) AS passed FROM b FULL JOIN c ON b.metric = c.metric""")
def gate_with_latency(spark, sf_dir):
    """Metrics within tolerance, at no more than 1.25 times the time."""
    from docketry.operators.evaluate import gate

    base, cand = (spark.createDataFrame(rows, "metric string, value double, ms double") for rows in ([("ndcg", 0.70, 100.0), ("recall_20", 0.90, 100.0), ("mrr", 0.50, 100.0)], [("ndcg", 0.68, 120.0), ("recall_20", 0.87, 120.0), ("hits", 0.50, 120.0)]))
    times = base.select("metric", F.col("ms").alias("a")).join(cand.select("metric", F.col("ms").alias("b")), "metric", "full_outer")
    both = gate(base, cand).join(times, "metric")
    return both.select("metric", (F.col("passed") & F.coalesce(F.col("b") / F.col("a") <= 1.25, F.lit(False))).alias("passed"))
