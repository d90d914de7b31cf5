"""Text queries: cleaning, tokens, chunks, sections, ids, rules, query planning, citations, quotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import dates, rules, vectors
from docketry.functions import text as tx
from docketry.functions.snowball_da import sql as snowball_sql
from docketry.functions.snowball_da import stemmed
from docketry.operators import ordered, passages
from docketry.plans.registry import query, table

_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-zæøå0-9]+')"
_SQUEEZE = r"trim(regexp_replace({0}, '[ \t\n\r\f]+', ' ', 'g'))"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _entities(x: str) -> str:
    for entity, said in tx.ENTITIES.items():
        x = f"replace({x}, '{entity}', '{said}')"
    return f"regexp_replace({x}, '&#[0-9]+;', ' ', 'g')"


_PLAIN = _entities("regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g')")


@query(f"SELECT page_id, {_SQUEEZE.format(_PLAIN)} AS said FROM pages")
def clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html")).alias("said"))


def _headed() -> str:
    x = "coalesce(html, '')"
    ws = r"[ \t\n\r]*"
    for tag, mark in (("h2", "##"), ("h3", "###"), ("h[456]", "####")):
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>{ws}(.*?){ws}</{tag}>', chr(10) || '{mark} \\1' || chr(10), 'g')"
    x = f"regexp_replace({x}, '(?is)<p[^>]*>{ws}<(?:strong|b)[^>]*>{ws}(.*?){ws}</(?:strong|b)>{ws}</p>', chr(10) || '#### \\1' || chr(10), 'g')"
    x = f"regexp_replace({x}, '(?i)</p>|<br{ws}/?>|</div>', chr(10), 'g')"
    x = _entities(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")
    x = f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')"


@query(f"SELECT page_id, {_headed()} AS said FROM pages")
def clean_html_headings(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html"), headings=True).alias("said"))


@query()
def html_main_content(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", passages.main_content_of(F.col("html")).alias("said"))


@query(r"SELECT doc_id, substr(" + _SQUEEZE.format("regexp_replace(coalesce(text, ''), '(?m)^#{2,3} ', '', 'g')") + ", 1, 280) AS excerpt FROM documents")
def excerpts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.excerpt(F.coalesce("text", F.lit(""))).alias("excerpt"))


@query(r"WITH said AS (SELECT doc_id, " + _SQUEEZE.format("coalesce(text, '')") + r" AS said FROM documents), spot AS (SELECT *, instr(lower(said), 'license') AS spot FROM said), ends AS (SELECT *, CASE WHEN spot > 0 THEN greatest(0, spot - 1 - 106) ELSE 0 END AS lo FROM spot), cut AS (SELECT *, least(length(said), lo + 320) AS hi FROM ends) SELECT doc_id, (CASE WHEN lo > 0 THEN '…' ELSE '' END) || substr(said, lo + 1, hi - lo) || (CASE WHEN hi < length(said) THEN '…' ELSE '' END) AS snippet FROM cut")
def excerpt_snippet(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.snippet(F.col("text"), F.lit("License")).alias("snippet"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY term")
def tokens_df(spark, sf_dir):
    from docketry.operators.index import postings

    return postings(docs(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


_W = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+')"


@query(f"SELECT doc_id, i // 420 AS chunk, array_to_string(w[i + 1 : i + 500], ' ') AS said FROM (SELECT doc_id, w, unnest(range(0, len(w), 420)) AS i FROM (SELECT doc_id, {_W} AS w FROM documents) WHERE len(w) > 0)")
def chunk_windows(spark, sf_dir):
    """500 words with 80 of overlap; the last chunk may be overlap alone."""
    w = docs(spark, sf_dir).select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\r\f]+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    return w.select("doc_id", F.posexplode(tx.windows(F.col("w"), 500, 80)).alias("chunk", "c")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.array_join("c", " ").alias("said"))


@query(f"SELECT doc_id, i // 655 AS chunk, array_to_string(w[i + 1 : i + 770], ' ') AS said FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 115), 655)) AS i FROM (SELECT doc_id, {_W} AS w FROM documents) WHERE len(w) > 0) WHERE i // 655 < 80")
def embedding_chunks(spark, sf_dir):
    """770 words with 115 of overlap, none past the end, 80 at most."""
    w = docs(spark, sf_dir).select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\r\f]+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    chunks = F.slice(tx.windows(F.col("w"), 770, 115, stop_at_end=True), 1, 80)
    return w.select("doc_id", F.posexplode(chunks).alias("chunk", "c")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.array_join("c", " ").alias("said"))


@query("WITH lines AS (SELECT doc_id, unnest(range(0, len(l))) AS line, trim(unnest(l)) AS said FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)), marked AS (SELECT *, (starts_with(said, '#') OR (length(said) BETWEEN 3 AND 120 AND regexp_full_match(said, '[A-ZÆØÅ0-9 ,.!]+'))) AS head FROM lines WHERE said <> ''), numbered AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM marked) SELECT doc_id, section::BIGINT AS section, max(CASE WHEN head THEN said END) AS title, sum((NOT head)::INT)::BIGINT AS lines FROM numbered GROUP BY doc_id, section")
def section_split(spark, sf_dir):
    """Lines of # marks or capitals open sections."""
    from pyspark.sql import Window

    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "said")).select("doc_id", "line", F.trim("said").alias("said")).where("said <> ''")
    head = F.startswith("said", F.lit("#")) | (F.length("said").between(3, 120) & F.col("said").rlike("^[A-ZÆØÅ0-9 ,.!]+$"))
    section = F.sum(F.col("head").cast("int")).over(Window.partitionBy("doc_id").orderBy("line"))
    numbered = lines.withColumn("head", head).withColumn("section", section)
    return numbered.groupBy("doc_id", "section").agg(F.max(F.when(F.col("head"), F.col("said"))).alias("title"), F.sum((~F.col("head")).cast("int")).alias("lines"))


@query()
def paragraph_split(spark, sf_dir):
    return passages.paragraphs(docs(spark, sf_dir))


@query()
def key_section_text(spark, sf_dir):
    title = tx.title(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.concat_ws(" ", title, title, title, passages.key_sections_of(F.col("text"), 6_000)).alias("said"))


@query()
def decision_cores(spark, sf_dir):
    """The part of each text that the first words of a benchmark item, dealt by id, are about."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"))
    n = items.count()
    both = docs(spark, sf_dir).join(items, F.pmod("doc_id", F.lit(n or 1)) == F.col("item_id"), "left")
    return both.select("doc_id", passages.decision_cores(F.col("text"), F.col("q")).alias("core"))


@query()
def cover_level(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", passages.cover_of(F.col("text")).alias("cover"))


@query("SELECT doc_id, 'dec-' || substr(sha1(lower(source) || chr(31) || doc_id), 1, 12) AS id, substr(sha1(source), 1, 12) AS short, 'feature:lang:' || substr(sha1('lang:' || lang), 1, 14) AS feature FROM documents")
def stable_ids(spark, sf_dir):
    feature = F.concat(F.lit("feature:lang:"), F.substring(F.sha1(F.concat(F.lit("lang:"), "lang").cast("binary")), 1, 14))
    return docs(spark, sf_dir).select("doc_id", tx.stable_id(F.lower("source"), F.col("doc_id").cast("string"), prefix="dec").alias("id"), tx.stable_id(F.col("source")).alias("short"), feature.alias("feature"))


@query("SELECT doc_id, concat_ws(' ', t, t, t, right(coalesce(text, ''), 6000)) AS said FROM (SELECT doc_id, text, split_part(coalesce(text, ''), chr(10), 1) AS t FROM documents)")
def index_text(spark, sf_dir):
    """The title three times, then the end of a text without key sections."""
    t = tx.title(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.concat_ws(" ", t, t, t, F.right(F.coalesce("text", F.lit("")), F.lit(6000))).alias("said"))


@query(r"""SELECT conv_id, turn, array_to_string(list_distinct_ordered, '|') AS phrases FROM (SELECT conv_id, turn, list_filter(q, lambda x, i: x <> '' AND list_position(q, x) = i) AS list_distinct_ordered FROM (SELECT conv_id, turn, list_transform(regexp_extract_all('„' || replace(text, '.', '”.„') || '”', '["“”„«»]([^"“”„«»]{3,250})["“”„«»]', 1), lambda x: trim(regexp_replace(x, '[ \t\n\r\f]+', ' ', 'g'))) AS q FROM conversations))""")
def quoted_phrases(spark, sf_dir):
    """Sentences put in quotation marks, then found as quotations."""
    said = F.concat(F.lit("„"), F.replace("text", F.lit("."), F.lit("”.„")), F.lit("”"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(tx.quoted(said), "|").alias("phrases"))


@query("SELECT doc_id, CASE WHEN regexp_matches(said, 'licensed under|released under') THEN 'license' WHEN regexp_matches(said, '[a-z0-9._]+@[a-z0-9.]+') THEN 'contact' WHEN regexp_matches(said, '!!') THEN 'shout' ELSE 'plain' END AS label FROM (SELECT doc_id, lower(coalesce(text, '')) AS said FROM documents)")
def rule_single_label(spark, sf_dir):
    table_ = (("license", "licensed under|released under"), ("contact", "[a-z0-9._]+@[a-z0-9.]+"), ("shout", "!!"))
    return docs(spark, sf_dir).select("doc_id", rules.first_label(F.lower(F.coalesce("text", F.lit(""))), table_, "plain").alias("label"))


@query("SELECT doc_id, CASE WHEN labels = '' THEN 'other' ELSE labels END AS labels FROM (SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(said, 'licen[sc]e') THEN 'license' END, CASE WHEN regexp_matches(said, '@') THEN 'contact' END, CASE WHEN regexp_matches(said, '[0-9]{4}') THEN 'number' END], lambda x: x IS NOT NULL), ',') AS labels FROM (SELECT doc_id, lower(coalesce(text, '')) AS said FROM documents))")
def rule_multi_label(spark, sf_dir):
    table_ = (("license", "licen[sc]e"), ("contact", "@"), ("number", "[0-9]{4}"))
    found = rules.all_labels(F.lower(F.coalesce("text", F.lit(""))), table_)
    return docs(spark, sf_dir).select("doc_id", F.when(F.size(found) > 0, F.array_join(found, ",")).otherwise("other").alias("labels"))


@query()
def danish_outcomes(spark, sf_dir):
    """The Danish rule tables over all texts: outcome and kinds of defects."""
    title = tx.title(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", rules.outcome(title, F.col("text"), F.lit("")).alias("outcome"), F.array_join(rules.defects(title, F.col("text")), ",").alias("defects"))


_LEXICON = {"article": ("the", "der", "le", "el"), "copula": ("is", "ist", "est", "es"), "pair": ("of the", "de la", "in der")}


@query(f"SELECT doc_id, array_to_string(list_filter([CASE WHEN list_has_any(w, ['the', 'der', 'le', 'el']) THEN 'article' END, CASE WHEN list_has_any(w, ['is', 'ist', 'est', 'es']) THEN 'copula' END, CASE WHEN contains(line, ' of the ') OR contains(line, ' de la ') OR contains(line, ' in der ') THEN 'pair' END], lambda x: x IS NOT NULL), ',') AS labels FROM (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line FROM (SELECT doc_id, {_TOK} AS w FROM documents))")
def lexicon_labels(spark, sf_dir):
    w = docs(spark, sf_dir).select("doc_id", tx.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    return w.select("doc_id", F.array_join(rules.lexicon_labels(F.col("w"), _LEXICON), ",").alias("labels"))


_CUES = {"exact": ("license",), "case": ("the other",), "practice": ("and the", "et les", "und die"), "factual": ("is", "que", "der")}


def _cue(kind: str) -> str:
    return " + ".join(f"contains(said, '{c}')::INT" for c in _CUES[kind])


@query(rf"""WITH said AS (SELECT conv_id, turn, lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g'))) AS said FROM conversations),
    n AS (SELECT *, {_cue('exact')} AS e, {_cue('case')} AS c, {_cue('practice')} AS p, {_cue('factual')} AS f, len(string_split(said, ' ')) <= 14 AND ends_with(said, '?') AS short, regexp_matches(said, '["“”„«»][^"“”„«»]{{3,250}}["“”„«»]') AS q FROM said),
    k AS (SELECT *, CASE WHEN q OR e > 0 THEN 'exact' WHEN c > 0 THEN 'case' WHEN p > 0 THEN 'practice' WHEN f > 0 OR short THEN 'factual' ELSE 'exploratory' END AS intent FROM n)
    SELECT conv_id, turn, intent, round_even(CASE intent WHEN 'exact' THEN 0.95e0 WHEN 'case' THEN 0.93e0 WHEN 'practice' THEN least(0.98e0, 0.78e0 + p * 0.05e0) WHEN 'factual' THEN CASE WHEN f > 0 THEN 0.84e0 ELSE 0.62e0 END ELSE 0.55e0 END, 2) AS confidence,
           CASE intent WHEN 'exact' THEN 120 WHEN 'case' THEN 100 WHEN 'practice' THEN 120 WHEN 'factual' THEN 60 ELSE 100 END AS retrieve, CASE intent WHEN 'exact' THEN 20 WHEN 'case' THEN 15 WHEN 'practice' THEN 18 WHEN 'factual' THEN 8 ELSE 15 END AS final FROM k""")
def query_intent(spark, sf_dir):
    plan = rules.intent(F.col("text"), _CUES, number="^case number [0-9]{4}$")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", plan.alias("x")).select("conv_id", "turn", "x.intent", "x.confidence", "x.retrieve", "x.final")


_CONCEPTS = ((("the", "and the"), ("thing", "of the", "that")), (("der", "die"), ("und", "haus")), (("le", "la"), ("les", "maison")))


@query(f"""WITH t AS (SELECT conv_id, turn, {_TOK}[1:5] AS w FROM conversations), l AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line FROM t),
    a AS (SELECT *, list_concat(list_concat(CASE WHEN contains(line, ' the ') OR contains(line, ' and the ') THEN ['thing', 'of the', 'that'] ELSE [] END, CASE WHEN contains(line, ' der ') OR contains(line, ' die ') THEN ['und', 'haus'] ELSE [] END), CASE WHEN contains(line, ' le ') OR contains(line, ' la ') THEN ['les', 'maison'] ELSE [] END) AS added FROM l)
    SELECT conv_id, turn, array_to_string(list_filter(added, lambda x: NOT contains(line, ' ' || x || ' ')), ',') AS added FROM a""")
def query_planner(spark, sf_dir):
    """Terms that concepts add to the first five words of a turn."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.slice(tx.tokens(F.coalesce("text", F.lit(""))), 1, 5).alias("w"))
    return w.select("conv_id", "turn", F.array_join(rules.planned_terms(F.col("w"), _CONCEPTS), ",").alias("added"))


@query()
def query_planner_turns(spark, sf_dir):
    """Terms that concepts add to a turn, by all its words; a turn of more words than the planner takes adds none."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    return w.select("conv_id", "turn", F.array_join(rules.planned_terms(F.col("w"), _CONCEPTS), ",").alias("added"))


def _pii() -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{k}' END" for k, p in tx.PERSONAL.items())
    return f"SELECT doc_id, array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',') AS kinds FROM documents"


@query(_pii())
def pii_flags(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(tx.personal_data(F.col("text")), ",").alias("kinds"))


@query("WITH a AS (SELECT conv_id, turn, 'See [Kilde ' || (turn % 7) || ', ' || (conv_id % 5) || '-' || (conv_id % 5 + turn % 4) || '] and [kilder 3]' AS answer FROM conversations), p AS (SELECT conv_id, turn, list_concat(list_concat([turn % 7], range(conv_id % 5, conv_id % 5 + turn % 4 + 1)), [3::BIGINT]) AS n FROM a) SELECT conv_id, turn, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i AND x >= 1 AND x <= 6), ',') AS sources FROM p")
def citation_refs(spark, sf_dir):
    """Numbers cited in answers made from the turn: lists and ranges, each once, in order, from 1 to 6."""
    c = table(spark, sf_dir, "conversations")
    low = F.col("conv_id") % 5
    answer = F.concat(F.lit("See [Kilde "), F.col("turn") % 7, F.lit(", "), low, F.lit("-"), low + F.col("turn") % 4, F.lit("] and [kilder 3]"))
    return c.select("conv_id", "turn", F.array_join(F.transform(tx.citation_numbers(answer, 6), lambda x: x.cast("string")), ",").alias("sources"))


@query(r"WITH q AS (SELECT item_id, trim(regexp_replace(lower(text), '[ \t\n\r\f]+', ' ', 'g')) AS quote FROM benchmark WHERE length(text) >= 25), d AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r\f]+', ' ', 'g')) AS said FROM documents) SELECT item_id, count(doc_id) AS sources, min(doc_id) AS first FROM q LEFT JOIN d ON contains(' ' || said || ' ', ' ' || quote || ' ') GROUP BY item_id")
def quote_check(spark, sf_dir):
    """Which texts have an item word for word. Items and texts meet on an item's rarest word."""
    items = table(spark, sf_dir, "benchmark").where(F.length("text") >= 25).select("item_id", F.lower(tx.squeezed(F.col("text"))).alias("quote"))
    texts = docs(spark, sf_dir).select("doc_id", F.lower(tx.squeezed(F.coalesce("text", F.lit("")))).alias("said"))
    words = texts.select("doc_id", F.explode(F.array_distinct(F.split("said", " "))).alias("word"))
    wanted = items.select("item_id", F.explode(F.array_distinct(F.split("quote", " "))).alias("word"))
    seen = words.join(wanted.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rare = wanted.join(seen, "word", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("x")).select("item_id", "x.word")
    near = words.join(rare, "word").select("item_id", "doc_id").join(texts, "doc_id").join(items, "item_id")
    held = near.where(F.contains(F.concat(F.lit(" "), "said", F.lit(" ")), F.concat(F.lit(" "), "quote", F.lit(" "))))
    counted = held.groupBy("item_id").agg(F.count(F.lit(1)).alias("sources"), F.min("doc_id").alias("first"))
    return items.select("item_id").join(counted, "item_id", "left").select("item_id", F.coalesce("sources", F.lit(0)).alias("sources"), "first")


@query("SELECT o_orderkey, day::VARCHAR AS day, (make_date(year(day), 5, 16))::VARCHAR AS ruled, round_even(1.0e0 + greatest(0.0e0, least(0.15e0, (year(day) - 1995) * 0.02e0)), 4) AS factor, strftime(day, '%d.%m.%Y') AS shown FROM (SELECT o_orderkey, o_orderdate::DATE AS day FROM orders)")
def date_functions(spark, sf_dir):
    """Dates read back from Danish text, a recency factor, and how a date is shown."""
    day = F.to_date("o_orderdate")
    said = F.concat(F.lit("Afgørelse af 16. maj "), F.year(day).cast("string"), F.lit(", klage af 1.2.1990 og 31.02.2001"))
    found = F.array_max(dates.in_text(said))
    return table(spark, sf_dir, "orders").select("o_orderkey", day.cast("string").alias("day"), found.cast("string").alias("ruled"), F.bround(dates.recency(F.year(day), base=1995), 4).alias("factor"), dates.shown(day, F.lit(False)).alias("shown"))


@query("SELECT vec_id, round_even(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS length FROM embeddings")
def vector_lengths(spark, sf_dir):
    e = F.col("embedding")
    unit = vectors.normalised(e)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.bround(F.sqrt(vectors.dot(unit, unit)) * F.sqrt(vectors.dot(e, e)), 5).alias("length"))


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(lower(url), 'æ', 'ae'), 'ø', 'oe'), 'å', 'aa'), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM pages")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name"))


@query()
def budget_fill(spark, sf_dir):
    """Texts of a source that fill 12,000 characters in turn, those that don't fit left out."""
    sizes = docs(spark, sf_dir).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n")))).alias("x"))
    taken = ordered.filled(F.col("x.n"), 12_000, 2)
    return sizes.select("source", F.explode(F.transform(taken, lambda i: F.element_at(F.col("x.doc_id"), i))).alias("doc_id"))


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-zæøå][a-zæøå-]+')"


@query(f"WITH placed AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM (SELECT doc_id, {_WORDS} AS words FROM documents)), every_word AS (SELECT DISTINCT w FROM placed), {snowball_sql('every_word')}, joined AS (SELECT doc_id, array_to_string(flatten(list(stems ORDER BY i)), ' ') AS stems FROM placed JOIN stemmed USING (w) GROUP BY doc_id) SELECT doc_id, coalesce(stems, '') AS stems FROM documents LEFT JOIN joined USING (doc_id)")
def danish_stems(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(stemmed(F.col("text")), " ").alias("stems"))


@query()
def source_claims(spark, sf_dir):
    """Sentences of assistants' turns that cite a source put at their end."""
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    said = F.concat(F.substring_index("text", ".", 1), F.lit(" [Kilde "), (F.col("turn") % 3 + 1).cast("string"), F.lit("]."))
    return answers.select("conv_id", "turn", F.inline(passages.claims_of(said)))


@query()
def statute_sections(spark, sf_dir):
    """Statutes of two sections made from each item."""
    t = F.concat(F.lit("Kapitel 1\nAlmindeligt\n§ 1. "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n§ 2 a. "), F.substring_index("text", " ", 3))
    return table(spark, sf_dir, "benchmark").select("item_id", F.inline(passages.statutes_of(t)))
