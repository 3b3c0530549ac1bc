"""License scans by an exact set-similarity join, in DataFrame functions only.

A text is a sequence of words: runs of letters and digits, A-Z lower-cased. A template is a notice in a few words; its class is
the power of two that holds them. For each class w the blocks of a text are 2w words long and start at every w-th word, so that any w
words in a row are within one of them. A block matches a template if it has at least ``threshold`` of the template's different words.

All words of templates are counted over the corpus and ordered, rarest first. A template needs ``need`` common words, so one of the first
size - need + 1 in that order must be in the block (prefix filter); the block must have ``need`` template words (length filter);
and what is left of both behind the first common word must do for the rest (positional filter). Pairs that pass are counted out.
Beside the join, places where a phrase's words stand in a row are found in the word array itself.

Only words of templates leave the rows of their text, and only from texts that have a word of some prefix. Templates
are a parameter: their words, at most MOST_WORDS, are all that is collected or broadcast. Texts are told apart by
two hashes and their size, so equal texts are joined once; their rows join the results by shuffle, which AQE splits where hot.

Defined results: null text counts as empty and has no words; a word counts once in a block, however often it is there; a text
whose last block is shorter than 2w words is matched all the same; templates met in several blocks count once for labels, and the
largest share is the score; a phrase in a row counts as 1; ties don't arise (sets and maxima); repeated rows stay
repeated; an empty table gives no rows; doc_id may be null or of any type; other columns stay, ours get longer names where they clash.
U+212A, which other lower-casing turns into k, stays a letter of its own.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cut, fresh

#: What a word is, after A-Z became lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose words must stand in a row, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Labels and the usual words of their notices.
TEMPLATES = (
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
)
#: Different words of all templates together: they are literals of the plan and a broadcast table.
MOST_WORDS = 20_000
#: Lower-casing would make these an ASCII letter; any other letter stands in for them while words are told apart.
KELVIN, OTHER = "\u212a", "\u00e5"


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    width: int
    words: tuple[str, ...]
    need: int


def plain_words(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def parsed(templates: Sequence[tuple[str, str]], threshold: float) -> list[Template]:
    """Templates with their class, different words and the least number of words that a block must have of them."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold is a share above 0")
    out = []
    for i, (label, text) in enumerate(templates):
        found = plain_words(text)
        if not found:
            raise ValueError(f"template {i} has no words")
        distinct = tuple(sorted(set(found)))
        out.append(Template(i, label, 1 << (len(found) - 1).bit_length(), distinct, math.ceil(threshold * len(distinct) - 1e-9)))
    if len({w for t in out for w in t.words}) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} different words")
    return out


def words_of(text: Column) -> Column:
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(OTHER)))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few given rows as a table, without leaving the JVM."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def word_ranks(texts: DataFrame, templates: list[Template]) -> dict[str, int]:
    """Words of templates by the number of texts that have them, rarest first (from 1)."""
    vocabulary = sorted({w for t in templates for w in t.words})
    counted = texts.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    n = {r["word"]: r["n"] for r in counted.collect()}
    return {w: i + 1 for i, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}


def matches(texts: DataFrame, templates: list[Template]) -> DataFrame:
    """key, other, size, template, label, start and end (words of the block) and share of every block and template that meet, from texts with key, other, size and words."""
    spark = texts.sparkSession
    rank = word_ranks(texts, templates)
    ordered = {t.number: sorted(rank[w] for w in t.words) for t in templates}
    word_at = {r: w for w, r in rank.items()}
    prefix = {t.number: ordered[t.number][: len(t.words) - t.need + 1] for t in templates}
    vocabulary = small_table(spark, [{"word": w, "rank": rank[w], "width": x} for w, x in sorted({(w, t.width) for t in templates for w in t.words})], "word: string, rank: int, width: int")
    index = small_table(
        spark,
        [{"width": t.width, "rank": r, "template": t.number, "label": t.label, "need": t.need, "place": i, "those": ordered[t.number]} for t in templates for i, r in enumerate(prefix[t.number])],
        "width: int, rank: int, template: int, label: string, need: int, place: int, those: array<int>",
    )
    some = texts.filter(F.arrays_overlap("words", _strings(sorted({word_at[r] for p in prefix.values() for r in p}))))
    hits = some.select("key", "other", "size", F.posexplode("words").alias("at", "word")).join(F.broadcast(vocabulary), "word")
    number = F.floor(F.col("at") / F.col("width")).cast("int")
    placed = hits.select("key", "other", "size", "width", "rank", F.explode(F.when(number > 0, F.array(number - 1, number)).otherwise(F.array(number))).alias("block"))
    of = ["key", "other", "size", "width", "block"]
    blocks = placed.groupBy(*of).agg(F.sort_array(F.collect_set("rank")).alias("these"))
    left, rest = F.size("these") - F.col("i"), F.size("those") - F.col("place")
    met = blocks.select(*of, "these", F.posexplode("these").alias("i", "rank")).join(F.broadcast(index), ["width", "rank"])
    passing = met.filter((F.size("these") >= F.col("need")) & (F.least(left, rest) >= F.col("need")))
    common = F.size(F.array_intersect("these", "those"))
    counted = passing.dropDuplicates([*of, "template"]).filter(common >= F.col("need"))
    start = F.col("width") * F.col("block")
    return counted.select("key", "other", "size", "template", "label", start.cast("long").alias("start"), (start + 2 * F.col("width")).cast("long").alias("end"), (common / F.size("those")).alias("share"))


def phrase_places(words: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """start and label of all places where a phrase's words stand in a row, phrase by phrase."""
    def places(parts: list[str], label: str) -> Column:
        def stands(i: Column) -> Column:
            same = F.get(words, i) == parts[0]
            for k, part in enumerate(parts[1:], 1):
                same &= F.get(words, i + k) == part
            return F.coalesce(same, F.lit(False))

        has = F.size(F.array_intersect(words, _strings(sorted(set(parts))))) == len(set(parts))
        starts = F.filter(F.sequence(F.lit(0), F.size(words)), stands)
        found = F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))
        return F.when(has, found).otherwise(F.array().cast("array<struct<start: bigint, label: string>>"))

    return F.concat(*[places(plain_words(phrase), label) for phrase, label in phrases])


def license_scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = 0.8) -> DataFrame:
    """``docs`` with n_words, places (of phrases: start, label), blocks (that match: template, label, start, end, share), labels (sorted) and score."""
    known = parsed(templates, threshold)
    ours = {n: fresh(docs, n) for n in ("key", "other", "size", "words", "n_words", "places", "blocks", "labels", "score")}
    c = {n: F.col(name) for n, name in ours.items()}
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = {"key": F.xxhash64(text), "other": F.xxhash64(F.lit("second"), text), "size": F.octet_length(text)}
    found = matches(docs.select(*[k.alias(n) for n, k in keys.items()], words_of(F.col("text")).alias("words")), known)
    each = F.collect_set(F.struct("template", "label", "start", "end", "share")).alias(ours["blocks"])
    by_text = cut(found.groupBy("key", "other", "size").agg(each).withColumnsRenamed({n: ours[n] for n in keys}))
    rows = docs.withColumns({ours[n]: k for n, k in keys.items()} | {ours["words"]: words_of(F.col("text"))})
    based = rows.withColumns({ours["n_words"]: F.size(c["words"]).cast("long"), ours["places"]: phrase_places(c["words"], phrases)}).drop(ours["words"])
    joined = based.join(by_text.hint("merge"), [ours[n] for n in keys], "left")  # grows with the corpus: never broadcast
    blocks = F.coalesce(F.array_sort(c["blocks"]), F.array().cast(by_text.schema[ours["blocks"]].dataType))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform(c["places"], lambda p: p["label"]), F.coalesce(F.transform(c["blocks"], lambda b: b["label"]), F.array().cast("array<string>")))))
    best = F.coalesce(F.array_max(F.transform(c["blocks"], lambda b: b["share"])), F.lit(0.0))
    return joined.select(
        *[col(name) for name in docs.columns],
        ours["n_words"],
        ours["places"],
        blocks.alias(ours["blocks"]),
        labels.alias(ours["labels"]),
        F.when(F.size(c["places"]) > 0, 1.0).otherwise(best).alias(ours["score"]),
    )


def digest(scanned: DataFrame) -> DataFrame:
    """One row per document: numbers and first and last place of phrases, labels of phrases and of all, score."""
    starts = F.transform("places", lambda p: p["start"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def sql(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> str:
    """The rows of :func:`digest` by counting common words of all blocks and templates."""
    known = parsed(templates, threshold)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({t.number}, {quote(t.label)}, {t.width}, {len(t.words)}, {t.need}, {quote(w)})" for t in known for w in t.words)
    phrase = " UNION ALL ".join(
        f"SELECT w0.doc, w0.pos, {quote(label)} AS label FROM l w0 " + " ".join(f"JOIN l w{k} ON w{k}.doc = w0.doc AND w{k}.pos = w0.pos + {k} AND w{k}.word = {quote(p)}" for k, p in enumerate(parts[1:], 1)) + f" WHERE w0.word = {quote(parts[0])}"
        for parts, label in ((plain_words(p), label) for p, label in PHRASES)
    )
    return rf"""
    WITH t AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
    v(template, label, width, size, need, word) AS (VALUES {values}),
    l AS MATERIALIZED (SELECT doc, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM t),
    b AS (SELECT DISTINCT doc, template, label, size, need, v.word, pos // width - back AS block FROM l JOIN v ON l.word = v.word, (VALUES (0), (1)) x(back) WHERE pos // width >= back),
    m AS (SELECT doc, label, count(*) / size AS share FROM b GROUP BY doc, template, label, size, need, block HAVING count(*) >= need),
    p AS ({phrase}),
    a AS (SELECT doc, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc),
    s AS (SELECT doc, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc, label FROM m UNION ALL SELECT doc, label FROM p) GROUP BY doc),
    g AS (SELECT doc, max(share) AS share FROM m GROUP BY doc)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
    FROM t LEFT JOIN a USING (doc) LEFT JOIN s USING (doc) LEFT JOIN g USING (doc)"""


