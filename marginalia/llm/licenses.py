"""License scans as an exact set-similarity join of text blocks with license templates.

A text is a sequence of words; blocks are runs of ``BLOCK`` words that start
every ``BLOCK / 2`` words, so any run of up to half a block lies inside one. A
block matches a template if it contains at least ``THRESHOLD`` of the template's
different words. The words of templates are ordered by their document frequency
in the corpus, rarest first. Three filters, none of which can lose a match:

* prefix: a match shares one of the first |T| - ceil(t |T|) + 1 words of T;
* length: a match has at least ceil(t |T|) different words of the templates;
* position: behind the first shared prefix word at place i of T, at most
  |T| - i words can still be shared.

Texts without any prefix word leave at once; the others are cut into blocks and
verified in their row. Templates are a bounded parameter and are sent along as
literals, so the join has no shuffle; only the document frequencies of template
words are aggregated (at most one row per word and task).

Besides the templates, fixed phrases are located word by word (base labels).
Null and empty texts have no words and no labels. Repeated rows give repeated
results. Empty table: empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.arrays import running
from marginalia.functions.text import let
from marginalia.llm.common import table, text_of

THRESHOLD = 0.8
BLOCK = 64

# Phrases of the contract with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices of public licenses, with labels.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
# The words, beside a high share of the others, that tell each notice from its relatives.
TELLING = [
    "mit",
    "",
    "apache 2",
    "gnu 3",
    "gnu 2",
    "lesser 3",
    "affero 3",
    "cc by",
    "cc nc",
    "cc sa",
    "attribution",
    "noncommercial",
    "sharealike",
    "",
    "mozilla",
    "unencumbered",
]

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """The words in lower case (A-Z only), joined by single spaces."""
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _NOT_WORD, " "))


def _template_words(text: str) -> list[str]:
    words = "".join(c.lower() if c.isascii() and c.isalnum() else " " if c.isascii() else c for c in text).split()
    return list(dict.fromkeys(words))


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of documents with each of the given words (a bounded list)."""
    wanted = F.array(*map(F.lit, vocabulary))
    found = docs.select(F.explode(F.array_intersect(F.split(normal(text_of()), " "), wanted)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return {r["w"]: r["n"] for r in found.collect()}


def ordered_templates(templates: list[tuple[str, str]], df: dict[str, int], threshold: float) -> list[tuple[str, list[str], int]]:
    """(label, words from rare to frequent, least overlap) of each template."""
    out = []
    for label, text in templates:
        words = sorted(_template_words(text), key=lambda w: (df.get(w, 0), w))
        if words:
            out.append((label, words, math.ceil(threshold * len(words) - 1e-9)))
    return out


def blocks_of(words: Column, block: int = BLOCK) -> Column:
    """All blocks of an array of words; the last one may be shorter."""
    step = block // 2
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - step - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(words, s + 1, block).alias("words")))


def block_matches(words: Column, templates: list[tuple[str, list[str], int]], block: int = BLOCK) -> Column:
    """Array of (start, label, template, score, words) of the blocks that reach a template's least overlap; words are the shared ones."""
    vocabulary = F.array(*[F.lit(w) for w in dict.fromkeys(w for _, ws, _ in templates for w in ws)])

    def verify(b: Column) -> Column:
        # Different template words of the block: overlaps and the length filter need no others.
        own = F.array_intersect(b["words"], vocabulary)

        def against(held: Column) -> Column:
            found = []
            for k, (label, ws, least) in enumerate(templates):
                prefix = ws[: len(ws) - least + 1]
                # Place of the rarest shared prefix word; the words from there on bound the overlap.
                place = F.coalesce(*[F.when(F.array_contains(held, w), F.lit(i)) for i, w in enumerate(prefix)], F.lit(len(ws)))
                possible = (F.size(held) >= least) & (F.lit(len(ws)) - place >= least)
                shared = F.array_intersect(held, F.array(*map(F.lit, ws)))
                overlap = F.size(shared)
                hit = F.when(possible, F.when(overlap >= least, F.struct(b["start"].alias("start"), F.lit(label).alias("label"), F.lit(k).alias("template"), (overlap / len(ws)).alias("score"), shared.alias("words"))))
                found.append(hit)
            return F.filter(F.array(*found), lambda x: x.isNotNull())

        return F.flatten(F.transform(F.array(own), against))

    return F.flatten(F.transform(blocks_of(words, block), verify))


def license_blocks(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per (document, matching block, template): all columns of ``docs`` with start, label, template and score."""
    found = scan(docs, templates, threshold, [c for c in docs.columns if c not in ("start", "label", "template", "score")])
    rows = found.withColumn("__m", F.explode("matches")).drop("matches", "normal")
    return rows.select(*[c for c in rows.columns if c != "__m"], "__m.start", "__m.label", "__m.template", "__m.score")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with ``normal`` (the joined words) and ``matches``."""
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for _, t in templates for w in _template_words(t)})
    ordered = ordered_templates(templates, frequencies(docs, vocabulary), threshold)
    prefixes = sorted({w for _, ws, least in ordered for w in ws[: len(ws) - least + 1]})
    narrow = docs.select(*(keep or ["doc_id"]), normal(text_of()).alias("normal"))
    none = F.array().cast("array<struct<start:int,label:string,template:int,score:double,words:array<string>>>")
    words = F.split("normal", " ")
    rough = F.col("normal").rlike("|".join(f"(?:{w})" for w in prefixes))
    exact = F.arrays_overlap(words, F.array(*map(F.lit, prefixes)))
    return narrow.withColumn("matches", F.when(rough, F.when(exact, block_matches(words, ordered))).otherwise(none)).withColumn("matches", F.coalesce("matches", none))


def phrase_places(joined: Column, phrase: str) -> Column:
    """First word of every place of a phrase in joined words."""
    marked = F.concat(F.lit(" "), joined, F.lit(" "))
    parts = F.split(marked, f"(?<= ){phrase}(?= )", -1)
    size = len(phrase.split())
    # Words before a place: those of the earlier parts, and the phrases between them.
    count = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))) - 1)
    places = let(running(F.transform(count, lambda c: c + size)), lambda before: F.transform(count, lambda c, i: (F.get(before, i) + c).cast("int")))
    return F.when(F.contains(marked, F.lit(f" {phrase} ")), places).otherwise(F.array().cast("array<int>"))


def digest(docs: DataFrame) -> DataFrame:
    """Word counts, phrase places and labels of every document."""
    found = scan(docs)
    size = F.when(F.col("normal") == "", F.lit(0)).otherwise(F.length("normal") - F.length(F.replace("normal", F.lit(" "), F.lit(""))) + 1)
    for k, phrase in enumerate(PHRASES):
        found = found.withColumn(f"__p{k}", phrase_places(F.col("normal"), phrase))
    places = F.concat(*[F.col(f"__p{k}") for k in range(len(PHRASES))])
    base = F.array_compact(F.array(*[F.when(F.size(f"__p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]))
    telling = F.array(*[F.array(*map(F.lit, words.split())).cast("array<string>") for words in TELLING])

    # A similar notice also reaches the threshold. It is no find of its own without the words that tell it from its
    # relatives, nor where one that is as good matches through all of its words and more.
    def is_own(m: Column) -> Column:
        told = F.size(F.array_except(F.get(telling, m["template"]), m["words"])) == 0
        wider = F.exists(
            "matches",
            lambda o: (o["start"] == m["start"]) & (o["score"] >= m["score"]) & ((o["score"] > m["score"]) | (F.size(o["words"]) > F.size(m["words"]))) & (F.size(F.array_except(m["words"], o["words"])) == 0),
        )
        return told & ~wider

    own = F.transform(F.filter("matches", is_own), lambda m: m["label"])
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))
    return found.select(
        "doc_id",
        size.cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
