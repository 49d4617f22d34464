"""License scan: an exact set-similarity join of text blocks with license templates, in Spark's own functions alone.

A block is 48 consecutive words; blocks start every 24 words, so that any run of up to 25 words lies whole in one. A
template is found in a block that holds at least ``threshold`` of its distinct words. The join is exact:

* Tokens are ordered by their frequency in all texts, the rarest first; words of no template come before all others,
  which is as good an order as any and lets blocks keep template words only.
* Prefix filter: a template of m words that needs a of them must share one of its first m - a + 1 with the block, so
  blocks are only built around such words and joined by them.
* Length filter: the block must have a template words at all.
* Positional filter: if the first shared word is the i-th of the template and the j-th of the block (from 0), no more
  than min(m - i, size - j) can be shared.
* What passes is verified by the intersection.

What depends on the templates alone (their words, counted) passes through the driver; texts and blocks never do.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut

#: Phrases that name a license, and their labels.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]

#: Notices of public licenses, and their labels. At most STEP + 1 words each.
TEMPLATES = [
    ("agpl", "GNU Affero General Public License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: Words from one block's start to the next's; a block has twice as many.
STEP = 24
#: The share of a template's distinct words that a block must hold.
THRESHOLD = 0.9
#: What stands between words once A-Z is lower-cased.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """A text's words in order: A-Z lower-cased, runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]; null as empty.

    Spark's lower() also lower-cases other letters, which moves no word's ends; the only letter that it makes an ASCII
    one, the Kelvin sign, is replaced by another letter before, so that no other word becomes a template's.
    """
    t = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ĸ"))
    return F.array_remove(F.split(F.lower(t), SEPARATORS), "")


def tokens(text: str) -> list[str]:
    """The same for a template or phrase, which is ASCII."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


@dataclass(frozen=True)
class Template:
    """A template with its words by the global order: ranks ascend, the rarest word first."""

    id: int
    label: str
    ranks: list[int]
    needed: int

    @property
    def prefix(self) -> list[int]:
        return self.ranks[: len(self.ranks) - self.needed + 1]


def ordered(docs: DataFrame, templates: Sequence[tuple[str, str]], threshold: float, text: str) -> tuple[list[str], list[Template]]:
    """The templates' vocabulary by its frequency in all texts (ties by the word), and the templates in that order. Only a
    count for each word of the templates comes to the driver."""
    sets = [sorted(set(tokens(t))) for _, t in templates]
    vocabulary = sorted({w for s in sets for w in s})
    if not vocabulary:
        return [], []
    found = docs.select(F.explode(words(F.col(text))).alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    n = dict(found.collect())  # a row for each word of the templates at most
    vocabulary.sort(key=lambda w: (n.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(vocabulary)}
    out = []
    for i, ((label, _), s) in enumerate(zip(templates, sets)):
        if s:
            out.append(Template(i, label, sorted(rank[w] for w in s), math.ceil(threshold * len(s) - 1e-9)))
    return vocabulary, out


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def places(phrases: Sequence[tuple[str, str]]) -> Column:
    """Of a column ``words``: an array of (at, label), one for each place where a phrase's words stand one after the other."""
    split = [(label, tokens(p)) for label, p in phrases]
    firsts = sorted({p[0] for _, p in split if p})
    if not firsts:
        return F.array().cast("array<struct<at:int,label:string>>")
    w = F.col("words")
    starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(firsts))

    def of(label: str, p: list[str]) -> Column:
        def stands(i: Column) -> Column:
            both = F.get(w, i) == p[0]
            for k, word in enumerate(p[1:], 1):
                both = both & (F.get(w, i + k) == word)
            return both

        return F.transform(F.filter(starts, stands), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    found = F.flatten(F.array(*[of(label, p) for label, p in split if p]))
    return F.when(F.arrays_overlap(w, strings(firsts)), found).otherwise(F.array().cast("array<struct<at:int,label:string>>"))


def blocks(vocabulary: list[str], prefixes: Sequence[int], step: int) -> Column:
    """Of a column ``words``: an array of (block, ranks), one for each block that holds a word of some template's prefix;
    ranks: the template words of the block, in the global order."""
    none = F.array().cast("array<struct<block:int,ranks:array<int>>>")
    if not prefixes:
        return none
    w, wanted, order = F.col("words"), [vocabulary[r - 1] for r in prefixes], strings(vocabulary)
    hits = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(wanted))
    at = F.flatten(F.transform(hits, lambda i: F.array(F.floor(i / step).cast("int"), F.greatest(F.floor(i / step).cast("int") - 1, F.lit(0)))))

    def ranks(b: Column) -> Column:
        own = F.transform(F.array_distinct(F.slice(w, b * step + 1, F.lit(2 * step))), lambda x: F.array_position(order, x).cast("int"))
        return F.array_sort(F.filter(own, lambda r: r > 0))

    found = F.transform(F.array_distinct(at), lambda b: F.struct(b.alias("block"), ranks(b).alias("ranks")))
    return F.when(F.arrays_overlap(w, strings(wanted)), found).otherwise(none)


def contained(spark, found: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(row, block, template, label, shared, size): every block of ``found`` (row, block, ranks) with every template of
    which it holds enough. Joined by the templates' prefixes; the index has a row for each template and prefix word."""
    index = spark.createDataFrame([(t.id, r, i, len(t.ranks), t.needed) for t in templates for i, r in enumerate(t.prefix)], "template int, rank int, i int, size int, needed int")
    whole = spark.createDataFrame([(t.id, t.label, t.ranks) for t in templates], "template int, label string, wanted array<int>")
    each = found.select("row", "block", "ranks", F.posexplode("ranks").alias("j", "rank"))
    pairs = each.join(F.broadcast(index), "rank").where(F.size("ranks") >= F.col("needed"))  # bounded by the templates given
    # the first word that both have, in the order of both
    pairs = pairs.groupBy("row", "block", "template", "size", "needed").agg(F.min(F.struct("i", "j")).alias("first"), F.max("ranks").alias("ranks"))
    pairs = pairs.where(F.least(F.col("size") - F.col("first.i"), F.size("ranks") - F.col("first.j")) >= F.col("needed"))
    pairs = pairs.join(F.broadcast(whole), "template").withColumn("shared", F.size(F.array_intersect("ranks", "wanted")))
    return pairs.where("shared >= needed").select("row", "block", "template", "label", "shared", "size")


def scan(
    docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, step: int = STEP, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches), one row for each row of docs.

    n_base: places of phrases, all of them; first_word, last_word: their smallest and largest start, null without one.
    labels: of phrases and templates; score: 1 where a phrase stands, else the largest share of a template that a block
    holds, 0 below the threshold; matches: (block, label, share) of every template found, by block.

    Null and empty texts have no words, no labels and score 0. Very long texts are read whole. Repeated rows and null
    doc_ids are answered one by one. Words that a template repeats count once; templates that tie are all found. An
    empty table gives no rows, an empty list of templates no matches. Extra columns are left out.
    """
    spark = docs.sparkSession
    vocabulary, known = ordered(docs, templates, threshold, text)
    prefixes = sorted({r for t in known for r in t.prefix})
    read = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("words"))
    rows = cut(read.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), places(phrases).alias("places"), blocks(vocabulary, prefixes, step).alias("blocks")))
    found = rows.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    share = F.col("shared") / F.col("size")
    by = contained(spark, found, known).groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max(share).alias("share"), F.array_sort(F.collect_list(F.struct("block", "label", share.alias("share")))).alias("matches")
    )
    both = rows.join(by, "row", "left")
    at = F.transform("places", lambda p: p["at"].cast("long"))
    named = F.array_distinct(F.transform("places", lambda p: p["label"]))
    return both.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(named), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(named, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.coalesce("matches", F.array().cast("array<struct<block:int,label:string,share:double>>")).alias("matches"),
    )
