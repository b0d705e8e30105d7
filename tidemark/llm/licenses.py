"""License scans by an exact set-similarity join of text blocks with license templates.

A template of m words has blocks of ceil(m / threshold) consecutive words of a text, wherever they begin and whatever
lines they cross. Tokens are ordered by their frequency over all documents, rarest first. A template of n tokens asks for
need = ceil(threshold * n) of them, so a block that has enough holds one of the template's n - need + 1 rarest (prefix
filter): only blocks around the places of such tokens are looked at, and of these only those that begin with a token of the
template, as moving a block's start to its first one loses none. A text needs `need` of a template's tokens in all (length
filter), and a block as many places left after its start as tokens asked for (positional filter). What passes is verified.
The templates are a short list given by the caller, so the join is a projection of each document against literals: no
shuffle but that of the token counts, no row left out.

Null and empty texts have no words and no labels. Repeated rows, and rows without a doc_id, are scanned each; other columns
of docs are not read; an empty docs gives no rows. Texts are of any length. Only built-in functions are used.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# License statements and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("all rights reserved", "all-rights-reserved"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
)
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """text with A-Z lower-cased, and no other letter."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, NOT_WORD), lambda w: w != "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def token_order(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """The rank of every vocabulary token by frequency in docs (text), rarest first; as many rows as the vocabulary has."""
    words = docs.select(F.explode(F.split(lowered(F.col("text")), NOT_WORD)).alias("word"))
    counts = {r["word"]: r["n"] for r in words.where(F.col("word").isin(*sorted(vocabulary))).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def _stands(parts: list[str]) -> Callable[[Column], Column]:
    """Whether the words from place i on are parts."""

    def test(i: Column) -> Column:
        here = F.get("words", i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            here = here & (F.get("words", i + j) == part)
        return F.coalesce(here, F.lit(False))

    return test


def _among(tokens: list[str]) -> Callable[[Column], Column]:
    """Whether the word at place i is one of tokens."""
    return lambda i: F.coalesce(F.get("words", i).isin(tokens), F.lit(False))


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=None, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and blocks for every row of docs.

    score is 1 where a phrase stands, else the highest containment of a template in a block, if it meets the threshold,
    else 0. blocks lists (first word from 0, label, containment) of the blocks that meet it and begin with one of its tokens.
    Labels of equal containment all stand; tokens of equal frequency are ordered by the alphabet.
    """
    phrases = PHRASES if phrases is None else phrases
    sets = [(sorted(set(text.split())), label, math.ceil(len(text.split()) / threshold - 1e-9)) for text, label in templates]
    order = token_order(docs, {w for tokens, *_ in sets for w in tokens})
    sets = [(sorted(tokens, key=order.get), label, math.ceil(threshold * len(tokens) - 1e-9), length) for tokens, label, length in sets]

    low = lowered(F.col("text"))
    base = docs.select("doc_id", low.alias("low")).select("doc_id", "low", F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"))

    # Words are only listed in texts that hold every word of a phrase, or a prefix token of a template with enough others.
    every = lambda words: reduce(lambda a, b: a & b, [F.contains("low", F.lit(w)) for w in words])
    hint = lambda tokens, need: F.col("low").rlike("|".join(re.escape(w) for w in tokens[: len(tokens) - need + 1]))
    enough = lambda tokens, need: reduce(lambda a, b: a + b, [F.contains("low", F.lit(w)).cast("int") for w in tokens]) >= need
    phrased = reduce(lambda a, b: a | b, [every(p.split()) for p in phrases], F.lit(False))
    base = base.withColumns({f"met{k}": hint(tokens, need) & enough(tokens, need) for k, (tokens, _, need, _) in enumerate(sets)})
    met_any = reduce(lambda a, b: a | b, [F.col(f"met{k}") for k in range(len(sets))], F.lit(False))
    base = base.withColumn("words", F.when(phrased | met_any, words_of(F.col("low"))))
    for k, phrase in enumerate(phrases):
        spots = F.filter(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0))), _stands(phrase.split()))
        base = base.withColumn(f"spots{k}", F.when(F.col("words").isNotNull(), spots).otherwise(F.array().cast("array<int>")))
    spots = F.concat(*[F.col(f"spots{k}") for k in range(len(phrases))])
    base_labels = F.array_sort(F.array_distinct(F.concat(*[F.when(F.size(f"spots{k}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for k, label in enumerate(phrases.values())])))

    def met(k: int, tokens: list[str], label: str, need: int, length: int) -> Column:
        inside, rare = _among(tokens), _among(tokens[: len(tokens) - need + 1])
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0))), rare)
        near = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(F.greatest(p - (length - 1), F.lit(0)), p))))
        starts = F.filter(near, lambda i: inside(i) & (F.size("words") - i >= need))

        def block(i: Column) -> Column:
            held = F.size(F.array_intersect(F.slice("words", i + 1, F.lit(length)), _strings(tokens)))
            return F.struct(i.alias("first"), F.lit(label).alias("label"), (held / F.lit(float(len(tokens)))).alias("containment"))

        found = F.filter(F.transform(starts, block), lambda x: x["containment"] * len(tokens) >= need - 1e-9)
        return F.when(F.col(f"met{k}"), found).otherwise(F.array().cast("array<struct<first:int,label:string,containment:double>>"))

    base = base.withColumn("blocks", F.concat(*[met(k, *s) for k, s in enumerate(sets)]))
    labels = F.array_sort(F.array_union(F.col("base"), F.transform("blocks", lambda x: x["label"])))
    out = base.withColumn("spots", spots).withColumn("base", base_labels)
    best = F.coalesce(F.array_max(F.transform("blocks", lambda x: x["containment"])), F.lit(0.0))
    return out.select(
        "doc_id",
        "n_words",
        F.size("spots").cast("long").alias("n_base"),
        F.array_min("spots").cast("long").alias("first_word"),
        F.array_max("spots").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("spots") > 0, 1.0).otherwise(best).alias("score"),
        F.array_sort("blocks").alias("blocks"),
    )


def scan_sql(templates=TEMPLATES, phrases=None, threshold: float = 0.8) -> str:
    """license_scan, without blocks, as DuckDB SQL over documents: every block against every template."""
    phrases = PHRASES if phrases is None else phrases
    literal = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ", ".join(f"({literal(sorted(set(t.split())))}, '{label}', {math.ceil(threshold * len(set(t.split())) - 1e-9)}, {math.ceil(len(t.split()) / threshold - 1e-9)})" for t, label in templates)
    spots = " UNION ALL ".join(
        f"SELECT r, '{label}' AS label, unnest(list_filter(range(len(words)), lambda i: words[i + 1 : i + {len(p.split())}] = {literal(p.split())})) AS spot FROM w" for p, label in phrases.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(low, '{WORD}') AS words FROM d),
spots AS ({spots}),
b AS (SELECT r, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list_distinct(list(label)) AS base FROM spots GROUP BY r),
t AS (SELECT * FROM (VALUES {rows}) AS v(words, label, need, length)),
c AS (SELECT r, w.words AS own, t.* FROM w, t WHERE len(list_intersect(list_distinct(w.words), t.words)) >= need),
i AS (SELECT r, label, words, need, own[i + 1 : i + length] AS block FROM (SELECT *, unnest(list_filter(range(len(own)), lambda i: list_contains(words, own[i + 1]))) AS i FROM c)),
m AS (SELECT r, label, len(list_intersect(list_distinct(block), words)) / len(words)::DOUBLE AS share FROM i WHERE len(list_intersect(list_distinct(block), words)) >= need),
g AS (SELECT r, list_distinct(list(label)) AS found, max(share) AS best FROM m GROUP BY r)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN g USING (r)"""
