"""License scan: known phrases, and an exact set-similarity join with licence templates (DataFrame expressions only).

A text's words are cut into overlapping blocks of 2 g words that begin every g words, so a
passage of up to g words lies whole in one of them; g is a template's level, the smallest of
``LEVELS`` that leaves a quarter more room than its words.  A block meets a template if it
holds ``CONTAINMENT`` percent of the template's distinct words, say a of n.

Blocks keep their words that occur in some template of the level, ordered by how many
blocks hold them in the whole corpus, rarest first; templates are ordered alike.  If a
words are shared, the first shared one stands at places i and j so that at least a words are
left from there on either side.  So only blocks of a words or more (length filter) are asked,
only the first n - a + 1 words of a template are joined (prefix filter), and a meeting
counts only if n - i and the block's words from j on are a or more (positional filter).
What is left is verified on the sets; no block that meets the threshold is lost.

Templates are a parameter of at most ``MAX_TOKENS`` words, since every task holds them.
The corpus' own words are never gathered: only the counts of template words are.

Edge cases: null and empty texts have no words and no labels; very long texts are scanned
whole; a text may hold any number of templates, in any order and more than once; equal
frequencies are ordered by word; repeated rows and null ids are answered each; an empty
table gives an empty result, no templates leave the phrases; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprism.llm.common import lower_ascii, stored

#: Phrases and their labels.
PHRASES: tuple[tuple[str, str], ...] = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Sentences of public licences and notices, with the names of their licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("gpl", "This work is licensed under the GNU General Public License, version"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("cc-by-nc", "Licensed under CC BY-NC"),
    ("cc-by-sa", "Licensed under CC BY-SA"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution International License"),
)
#: Percent of a template's distinct words that a block must hold; templates of fewer than ten must be there whole.
CONTAINMENT = 90
#: Words of a template at most, by level; and of all templates together.
LEVELS, MAX_TOKENS = (16, 128, 1024, 8192), 200_000
#: What separates words, once A-Z are lower case.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_in(text: Column) -> Column:
    """Array of the words of ``text`` in lower case (null: none)."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAKS), "")


def template_words(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(BREAKS, low) if w]


def needed(n: int, percent: int = CONTAINMENT) -> int:
    """Words of ``n`` that make ``percent``."""
    return -(-n * percent // 100)


def level_of(words: int) -> int:
    for g in LEVELS:
        if 4 * g >= 5 * words:
            return g
    raise ValueError(f"a template of {words} words is longer than {4 * LEVELS[-1] // 5}")


def prepared(templates: Sequence[tuple[str, str]], percent: int = CONTAINMENT) -> list[tuple[str, int, list[str], int]]:
    """Label, level, distinct words and number of words needed of every template."""
    out = []
    for label, text in templates:
        words = template_words(text)
        if words:
            distinct = list(dict.fromkeys(words))
            out.append((label, level_of(len(words)), distinct, needed(len(distinct), percent)))
    if sum(len(t[2]) for t in out) > MAX_TOKENS:
        raise ValueError(f"templates of more than {MAX_TOKENS} words")
    return out


def literal(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def places(words: Column, phrase: str) -> Column:
    """Where the words of ``phrase`` stand one after the other, from 0."""
    parts = template_words(phrase)
    there = reduce(and_, [F.size(words) >= len(parts), *(F.array_contains(words, p) for p in parts)])
    last = F.size(words) - len(parts)
    fits = lambda i: reduce(and_, [F.get(words, i + k) == p for k, p in enumerate(parts)])
    return F.when(there, F.filter(F.sequence(F.lit(0), last), fits)).otherwise(F.array().cast("array<int>"))


def blocks_of(words: Column, level: int, vocabulary: Sequence[str], least: int) -> Column:
    """Array of (g, words of the vocabulary) of each block that has at least ``least`` of them."""
    near = F.array_intersect(words, literal(vocabulary))
    count = F.greatest(F.lit(1), F.ceil(F.size(words) / level).cast("int") - 1)
    cut = lambda near: F.transform(
        F.sequence(F.lit(0), count - 1), lambda k: F.struct(F.lit(level).alias("g"), F.array_intersect(near, F.slice(words, k * level + 1, 2 * level)).alias("words"))
    )
    none = F.array().cast("array<struct<g:int,words:array<string>>>")
    # a one-element array names the text's words of the vocabulary for use in every block
    return F.flatten(F.transform(F.array(near), lambda n: F.when(F.size(n) >= least, F.filter(cut(n), lambda b: F.size(b["words"]) >= least)).otherwise(none)))


def scanned(docs: DataFrame, known: list[tuple[str, int, list[str], int]], phrases: Sequence[tuple[str, str]]) -> DataFrame:
    """rid, doc_id, n_words, places and base labels of every text, and its blocks."""
    words = docs.select("doc_id", words_in(F.col("text")).alias("words"))
    w = F.col("words")
    cut = []
    for g in sorted({t[1] for t in known}):
        own = [t for t in known if t[1] == g]
        cut.append(blocks_of(w, g, sorted({x for t in own for x in t[2]}), min(t[3] for t in own)))
    blocks = F.concat(*cut) if cut else F.array().cast("array<struct<g:int,words:array<string>>>")
    met = words.select("doc_id", F.size(w).cast("long").alias("n_words"), F.array(*(F.struct(F.lit(label).alias("label"), places(w, phrase).alias("at")) for phrase, label in phrases)).alias("met"), blocks.alias("blocks"))
    at = F.flatten(F.transform("met", lambda m: m["at"]))
    labels = F.transform(F.filter("met", lambda m: F.size(m["at"]) > 0), lambda m: m["label"])
    return met.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n_words", at.alias("at"), labels.alias("base"), "blocks")


def joined(rows: DataFrame, known: list[tuple[str, int, list[str], int]]) -> DataFrame:
    """rid, found (labels) and share (the largest containment) of the texts that meet a template; ``rows`` have rid and blocks."""
    spark = rows.sparkSession
    blocks = rows.select("rid", F.explode("blocks").alias("b")).select("rid", "b.g", "b.words")
    counts = {r["word"]: r["n"] for r in blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # template words only
    rank = lambda w: (counts.get(w, 0), w)
    order = sorted({w for t in known for w in t[2]}, key=rank)
    prefixes = []
    for label, g, distinct, a in known:
        ordered = sorted(distinct, key=rank)
        prefixes += [(g, w, i, label, ordered, a) for i, w in enumerate(ordered[: len(ordered) - a + 1])]
    side = F.broadcast(spark.createDataFrame(prefixes, "g int, word string, i int, label string, template array<string>, a int"))
    met = blocks.withColumn("words", F.array_intersect(literal(order), "words")).select("rid", "g", "words", F.posexplode("words").alias("j", "word")).join(side, ["g", "word"])
    near = met.where((F.size("words") >= F.col("a")) & (F.size("template") - F.col("i") >= F.col("a")) & (F.size("words") - F.col("j") >= F.col("a")))
    shared = near.withColumn("shared", F.size(F.array_intersect("words", "template"))).where(F.col("shared") >= F.col("a"))
    return shared.groupBy("rid").agg(F.collect_set("label").alias("found"), F.max(F.col("shared") / F.size("template")).alias("share"))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, percent: int = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of ``docs``.

    The score is 1 where a phrase stands, else the largest share of a template that
    was met, else 0.
    """
    known = prepared(templates, percent)
    rows = stored(scanned(docs, known, phrases))
    out = rows.drop("blocks").join(joined(rows, known), "rid", "left") if known else rows.withColumn("found", F.array().cast("array<string>")).withColumn("share", F.lit(0.0))
    shown = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"), shown(F.col("base")).alias("base_labels"),
        shown(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"), F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
