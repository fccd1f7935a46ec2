"""License scan: known phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line, as the set of its words; it matches a template when it holds at least CONTAINED of the
template's words. Template words are ordered by how often all documents use them, rarest first. A match
must share a word among the template's first size - needed + 1 (prefix filter), the block must have enough
words of the vocabulary (length filter), and enough must follow in both orders after the shared word
(positional filter). What passes is counted in full. Column expressions and joins only.

Templates are a parameter, a short list in the program, which bounds what is broadcast.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ascii_lower, written

# Phrases with their labels, and wordings of well-known licenses.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
]
CONTAINED = 0.9

APART = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD = f"[^{APART}]+"


def phrase_pattern(phrase: str) -> str:
    return f"(?i)(?<![^{APART}])" + f"[{APART}]+".join(phrase.split()) + f"(?![^{APART}])"


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def phrase_starts(text: Column, phrase: str) -> Column:
    """Numbers of the words at which the phrase begins."""
    pattern, length = phrase_pattern(phrase), len(phrase.split())
    before = F.transform(F.split(text, pattern, -1), lambda piece: words_in(piece))
    walked = F.aggregate(
        F.slice(before, 1, F.size(before) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, n: F.struct(
            (acc["at"] + n + length).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out")
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast("array<int>"))


def vocabulary(docs: DataFrame, templates: list[tuple[str, str]]) -> list[str]:
    """All template words, the rarest in the documents first. One row for each template word reaches the driver."""
    words = sorted({w for _, t in templates for w in words_of(t)})
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in words], "word string"))
    used = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), f"[{APART}]+")).alias("word")).join(wanted, "word")
    counts = {r.word: r.n for r in used.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def words_of(text: str) -> list[str]:
    return re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in text))


def template_matches(docs: DataFrame, templates: list[tuple[str, str]], contained: float) -> DataFrame:
    """(doc_id, digest, label, containment): the best containment of each label in a block of the text."""
    spark, order = docs.sparkSession, vocabulary(docs, templates)
    rank = {w: i for i, w in enumerate(order)}
    made, prefix = [], []
    for n, (label, text) in enumerate(templates):
        own = sorted(set(words_of(text)), key=rank.get)
        needed = math.ceil(contained * len(own) - 1e-9)
        made.append((n, label, own, needed))
        prefix += [(w, n, i, len(own), needed) for i, w in enumerate(own[: len(own) - needed + 1])]
    rare = sorted({p[0] for p in prefix})
    text = F.col("text").cast("string")
    some = F.lit(False)
    for word in rare:
        some = some | F.contains(F.lower(text), F.lit(word))
    ordered = F.array(*map(F.lit, order))
    blocks = (
        docs.filter(some)
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), F.explode(F.split(ascii_lower("text"), "\n")).alias("block"))
        .withColumn("words", F.split("block", f"[{APART}]+"))
        .filter(F.arrays_overlap("words", F.array(*map(F.lit, rare))))
        .select("doc_id", "digest", F.filter(ordered, lambda w: F.array_contains("words", w)).alias("words"))
    )
    starts = F.broadcast(spark.createDataFrame(prefix, "word string, template int, place int, size int, needed int"))
    whole = F.broadcast(spark.createDataFrame(made, "template int, label string, own array<string>, needed int"))
    candidates = (
        blocks.select("doc_id", "digest", "words", F.posexplode("words").alias("at", "word"))
        .join(starts, "word")
        .filter(F.size("words") >= F.col("needed"))
        .filter(1 + F.least(F.col("size") - F.col("place"), F.size("words") - F.col("at")) - 1 >= F.col("needed"))
        .select("doc_id", "digest", "words", "template")
    )
    shared = F.size(F.array_intersect("words", "own"))
    return (
        candidates.join(whole, "template")
        .filter(shared >= F.col("needed"))
        .groupBy("doc_id", "digest", "label")
        .agg(F.max(shared / F.size("own")).alias("containment"))
    )


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of documents.

    score is 1 where a phrase stands, else the largest containment of a matched template, else 0. A null
    text is empty: no words, no labels. first_word and last_word are null without a phrase. Repeated rows
    and rows without doc_id stay, each with its own answer. An empty table gives no rows; extra columns are
    ignored.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    each = {label: f"_{label}" for label in PHRASES.values()}
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("digest"),
        words_in(F.col("text")).cast("long").alias("n_words"),
        *[phrase_starts(F.col("text"), phrase).alias(each[label]) for phrase, label in PHRASES.items()],
    )
    starts = F.concat(*each.values())
    base = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for label, c in each.items()]))
    found = found.select(
        "doc_id",
        "digest",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        base.alias("base"),
    )
    matched = template_matches(docs, templates, contained)
    matched = written(
        matched.groupBy("doc_id", "digest").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best")), "license-matches"
    )
    # rows of one document are equal (same id and text), so the match of one is that of all
    matched = matched.withColumnsRenamed({"doc_id": "match_id", "digest": "match_digest"})
    joined = found.join(matched, F.col("doc_id").eqNullSafe(F.col("match_id")) & (F.col("digest") == F.col("match_digest")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def check_sql() -> str:
    """The same in DuckDB: every block against every template."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({quoted(label)}, {sorted(set(words_of(t)))!r})" for label, t in TEMPLATES)
    places = " union all ".join(
        f"select id, {quoted(label)} as label, i - 1 as pos from numbered where "
        + " and ".join(f"w[i + {k}] = {quoted(p)}" for k, p in enumerate(phrase.split()))
        for phrase, label in PHRASES.items()
    )
    return f"""
with d as (select row_number() over () as id, doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') as t from documents),
worded as (select id, regexp_extract_all(t, '{word}') as w from d),
numbered as (select id, w, unnest(range(1, len(w) + 1)) as i from worded),
places as ({places}),
base as (select id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as labels from places group by id),
templates(label, own) as (values {rows}),
blocks as (select id, list_distinct(regexp_extract_all(b, '{word}')) as w from (select id, unnest(string_split(t, chr(10))) as b from d)),
more as (
  select id, list(distinct label) as labels, max(len(list_intersect(w, own)) / len(own)) as best
  from blocks, templates where len(list_intersect(w, own)) >= ceil({CONTAINED} * len(own) - 1e-9) group by id
)
select doc_id, cast(len(worded.w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, more.labels))), ','), '') as labels,
  case when n_base > 0 then 1.0::double else coalesce(best, 0.0::double) end as score
from d join worded using (id) left join base using (id) left join more using (id)
"""
