"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

Words are runs of ASCII letters (A-Z as a-z), digits and characters beyond ASCII. A block is 2 * STRIDE
consecutive words of a text; blocks begin every STRIDE words, so what spans STRIDE words at most lies whole
in some block. A template meets a block if the block holds ``threshold`` of its distinct words or more.

0. Texts are cut into words once; a table keeps of each text the number of words, and place and word of those that are in
   the templates or the phrases. All that follows reads this table.
1. Global order: the template words' document frequencies over all texts, rare words first, ties by word.
2. Prefix filter: of a template with n words of which c must be met, one of the first n - c + 1 in that order is
   in every block that meets it. Only blocks around such words are made, and only they are joined, by an
   equi-join of those words with the templates' prefixes.
3. Length filter: the block has c template words at least. Positional filter: of the match at place i of the
   template and place j of the block's template words, in global order, what follows on both sides suffices for c.
4. The pairs that are left are verified on the whole sets.

The templates are a parameter of known size, so what is broadcast doesn't grow with the texts. Null and empty
texts have no words and no blocks. Repeated rows get the same result each. Null keys are kept. Columns of the
input other than the key and the text aren't looked at; an empty input gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.frames import written

STRIDE = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII that is in no word.
GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())

#: Phrases whose places are counted, and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: (label, words) of license notices (fixed values, from the public texts of the licenses).
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def words_of(text: Column) -> Column:
    """Runs of letters (A-Z as a-z), digits and characters beyond ASCII; null as empty."""
    said = F.translate(F.coalesce(text, F.lit("")), GAPS + UPPER, " " * len(GAPS) + LOWER)
    return F.array_remove(F.split(said, " "), "")


def told(docs: DataFrame, key: list[str], text: str = "text", templates=TEMPLATES) -> DataFrame:
    """Key columns, n_words, held: place and word of each word that is in a template or a phrase, in order."""
    known = sorted({w for said in [*(t for _, t in templates), *PHRASES] for w in said.split()})
    split = docs.select(*key, words_of(F.col(text)).alias("words"))
    placed = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    return split.select(*key, F.size("words").cast("long").alias("n_words"), F.filter(placed, lambda x: x.word.isin(known)).alias("held"))


def needed(n: int, threshold: float) -> int:
    """How many of n words must be met."""
    return max(1, math.ceil(n * threshold - 1e-9))


def global_order(told: DataFrame, templates) -> list[str]:
    """The templates' words, rare ones first, by the number of texts that hold them."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    counts = {r.word: r["count"] for r in told.select(F.explode(F.array_distinct("held.word")).alias("word")).groupBy("word").count().collect()}  # a row for a template word at most
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def meets(told: DataFrame, key: list[str], templates=TEMPLATES, threshold: float = 0.8, order: list[str] | None = None) -> DataFrame:
    """Key columns, block, template (its place), label, containment: every block and template that meet, from told()."""
    spark = told.sparkSession
    order = order or global_order(told, templates)
    place = {w: i for i, w in enumerate(order)}
    index = []
    for t, (label, said) in enumerate(templates):
        ordered = sorted(set(said.split()), key=place.__getitem__)
        c = needed(len(ordered), threshold)
        index += [(w, t, label, ordered, c, i) for i, w in enumerate(ordered[: len(ordered) - c + 1])]
    index_rows = spark.createDataFrame(index, "word string, template int, label string, wanted array<string>, need int, i int")
    prefixes = sorted({r[0] for r in index})
    known = F.array(*map(F.lit, order))
    wide = 2 * STRIDE
    numbered = F.transform("held", lambda x, k: F.struct(k.alias("k"), x["at"].alias("at"), x["word"].alias("word")))
    hit = told.select(*key, "n_words", "held", F.filter(numbered, lambda x: x["word"].isin(prefixes)).alias("hits")).where(F.size("hits") > 0)
    # A block is taken at the first prefix word in it.
    before = lambda h: F.coalesce(F.get("hits", h - 1)["at"], F.lit(-1))
    leads = lambda x, h, b: F.when((b >= 0) & (before(h) < b * STRIDE) & ((b == 0) | (F.col("n_words") > (b + 1) * STRIDE)), F.struct(b.alias("block"), x["k"].alias("k")))
    last = lambda x: F.floor(x["at"] / STRIDE).cast("int")
    blocks = F.array_compact(F.flatten(F.transform("hits", lambda x, h: F.array(leads(x, h, last(x)), leads(x, h, last(x) - 1)))))
    # The block's template words in global order, each once: they are among the 2 * wide - 1 known words around this one.
    near = F.slice("held", F.greatest(F.col("x.k") - (wide - 1), F.lit(0)) + 1, F.lit(2 * wide - 1))
    inside = F.filter(near, lambda y: (y["at"] >= F.col("x.block") * STRIDE) & (y["at"] < F.col("x.block") * STRIDE + wide))
    made = hit.select(*key, "held", F.explode(blocks).alias("x")).select(*key, "x.block", F.array_intersect(known, F.transform(inside, lambda y: y["word"])).alias("held"))
    tokens = made.select(*key, "block", "held", F.posexplode("held").alias("j", "word")).where(F.col("word").isin(prefixes))
    # The index has a row for each word of the templates' prefixes.
    pairs = tokens.join(F.broadcast(index_rows), "word").where(
        (F.size("held") >= F.col("need")) & (1 + F.least(F.size("wanted") - F.col("i") - 1, F.size("held") - F.col("j") - 1) >= F.col("need"))
    )
    overlap = F.size(F.array_intersect("wanted", "held"))
    # A pair comes once for each word of the prefix that it shares; the first such word stands for it.
    leads = F.col("word") == F.element_at(F.filter(F.slice("wanted", 1, F.size("wanted") - F.col("need") + 1), lambda w: F.array_contains("held", w)), 1)
    return pairs.where(leads & (overlap >= F.col("need"))).select(*key, "block", "template", "label", (overlap / F.size("wanted")).alias("containment"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """A row for each text: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    docs = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")).withColumn("__same", F.xxhash64("__text"))
    held = written(told(docs, ["__key", "__same"], "__text", templates), "held")
    met = meets(held, ["__key", "__same"], templates, threshold)
    best = met.groupBy("__key", "__same").agg(F.array_sort(F.collect_set("label")).alias("met"), F.max("containment").alias("score"))

    def places(phrase: str) -> Column:
        first, *others = phrase.split()

        def stands(x: Column, k: Column) -> Column:
            out = x["word"] == first
            for step, word in enumerate(others, 1):
                then = F.get("held", k + step)
                out = out & F.coalesce((then["word"] == word) & (then["at"] == x["at"] + step), F.lit(False))
            return out

        return F.transform(F.filter("held", stands), lambda x: x["at"])

    base = held.select("__key", "__same", "n_words", *(places(p).alias(f"at{i}") for i, p in enumerate(PHRASES)))
    every = F.concat(*(F.col(f"at{i}") for i in range(len(PHRASES))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"at{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values()))))
    base = base.select("__key", "__same", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base"))
    both = base.join(best.withColumnsRenamed({"__key": "__key2", "__same": "__same2"}), F.col("__key").eqNullSafe(F.col("__key2")) & (F.col("__same") == F.col("__same2")), "left")
    none = F.array().cast("array<string>")
    return both.select(
        F.col("__key").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("met", none))), ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def sql(templates=TEMPLATES, threshold: float = 0.8) -> str:
    """The rows of scan() over documents, in DuckDB SQL, by brute force."""
    text = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    wanted = []
    for label, said in templates:
        ordered = sorted(set(said.split()))
        wanted.append(f"('{label}', {ordered!r}, {needed(len(ordered), threshold)})")
    phrases = ", ".join(f"('{label}', {p.split()!r})" for p, label in PHRASES.items())
    return f"""
    WITH templates(label, wanted, need) AS (VALUES {", ".join(wanted)}),
         phrases(label, said) AS (VALUES {phrases}),
         docs AS (SELECT row_number() OVER () AS r, doc_id, {text} AS words FROM documents),
         places AS (SELECT r, label, unnest(list_filter(range(0, len(words)), lambda i: words[i + 1 : i + len(said)] = said)) AS spot FROM docs, phrases),
         based AS (SELECT r, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list_sort(list_distinct(list(label))) AS base FROM places GROUP BY r),
         blocks AS (SELECT r, words[b * {STRIDE} + 1 : b * {STRIDE} + {2 * STRIDE}] AS held
                    FROM (SELECT r, words, unnest(range(0, len(words) // {STRIDE} + 1)) AS b FROM docs) WHERE b = 0 OR len(words) > (b + 1) * {STRIDE}),
         met AS (SELECT r, label, len(list_intersect(wanted, held)) / len(wanted) AS containment FROM blocks, templates WHERE len(list_intersect(wanted, held)) >= need),
         best AS (SELECT r, list_distinct(list(label)) AS met, max(containment) AS score FROM met GROUP BY r)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
           coalesce(array_to_string(base, ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(met, [])))), ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
    FROM docs LEFT JOIN based USING (r) LEFT JOIN best USING (r)"""
