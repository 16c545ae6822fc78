"""Operator 3: licence scan, an exact containment join with licence templates; built-in functions only.

A text block (a line of a document) contains a template when at least ``threshold`` of the
template's different words are among the block's. All words of the templates are put
into one global order, from the word that the fewest blocks hold to the most common.
Only the first ``|T| - a + 1`` words of a template in that order (``a`` is the overlap
needed) are looked up, for a block that shares none of them can't reach ``a`` (prefix
filter); blocks with under ``a`` template words are left out (length filter), and so are
hits after which too few words remain in either (positional filter). What passes is
verified on the whole sets, so the result is exact.

With ``wrapped``, a run of as many adjacent words as the template has is a block too, wherever
its lines end. A text's own words go through the same filters, as a run's are among them; of
what passes, every run that begins with one of the template's words is verified.

Phrases are found apart from that: every place in a text where a phrase's words stand
consecutively.

Templates are broadcast up to ``BROADCAST_TEMPLATES``; more are joined by the word instead.

Defined results: a null text counts as empty, which has no words and no labels; a repeated row
gets the same result; rows with a null doc_id are scanned like any other; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import whole_text

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
BROADCAST_TEMPLATES = 1000

#: Phrases and their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str

    @property
    def words(self) -> list[str]:
        return sorted(set(self.sequence))

    @property
    def sequence(self) -> list[str]:
        return "".join(c if c.isalnum() else " " for c in self.text.lower()).split()


#: Short notices by which works state their licence (fixed values, public texts).
TEMPLATES = (
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def lowered(text: Column) -> Column:
    """A-Z in lower case. Other letters may change too, but none becomes one of ``a-z``: the two that would are put by two that don't."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u212b")), F.lit("\u0130"), F.lit("\u00cd")))


def contained_templates(docs: DataFrame, templates: Iterable[Template] = TEMPLATES, threshold: float = THRESHOLD, wrapped: bool = False) -> DataFrame:
    """doc_id, text_hash, block (its line from 0, -1 for the best run of words), label, template (its number) and containment of every match."""
    templates = list(templates)
    words = [t.words for t in templates]
    vocabulary = sorted({w for t in words for w in t})
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(lowered(whole_text()), "\n")).alias("block", "line"))

    def blocks(order: list[str]) -> DataFrame:
        """Of every block the template words that it holds, in the given order."""
        held = F.array_intersect(F.array(*map(F.lit, order)), F.split("line", NOT_WORD))
        return lines.select("doc_id", "text_hash", "block", held.alias("held")).where(F.size("held") > 0)

    # As many counts as the templates have words.
    counts = {r["word"]: r["n"] for r in blocks(vocabulary).select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    index = []
    for number, own in enumerate(words):
        own = sorted(own, key=place.__getitem__)
        needed = max(1, math.ceil(round(threshold * len(own), 9)))
        index += [(w, i, number, templates[number].label, own, needed, len(templates[number].sequence)) for i, w in enumerate(own[: len(own) - needed + 1])]
    prefixes = docs.sparkSession.createDataFrame(index, "word string, i int, template int, label string, own array<string>, needed int, length int")
    if len(templates) <= BROADCAST_TEMPLATES:
        prefixes = F.broadcast(prefixes)
    least = min((x[5] for x in index), default=1)
    hits = blocks(order).where(F.size("held") >= least).select("*", F.posexplode("held").alias("j", "word"))
    left = F.least(F.size("own") - F.col("i"), F.size("held") - F.col("j"))  # of either from the shared word on
    pairs = hits.join(prefixes, "word").where((F.size("held") >= F.col("needed")) & (left >= F.col("needed")))
    overlap = F.size(F.array_intersect("own", "held"))
    found = pairs.where(overlap >= F.col("needed")).select("doc_id", "text_hash", "block", "label", "template", (overlap / F.size("own")).alias("containment"))
    if wrapped and index:
        first = F.array(*[F.lit(w) for w in sorted({x[0] for x in index})])
        texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), lowered(whole_text()).alias("low"))
        texts = texts.withColumn("held", F.array_intersect(F.array(*map(F.lit, order)), F.split("low", NOT_WORD))).where(F.size("held") >= least)
        hits = texts.select("*", F.explode(F.array_intersect(first, "held")).alias("word")).withColumn("j", F.array_position("held", F.col("word")) - 1)
        pairs = hits.join(prefixes, "word").where((F.size("held") >= F.col("needed")) & (left >= F.col("needed")) & (overlap >= F.col("needed")))
        runs = pairs.select("doc_id", "text_hash", F.lit(-1).alias("block"), "label", "template", "needed", F.size("own").alias("n"), most_in_a_run().alias("most")).where("most >= needed")
        found = found.unionByName(runs.select("doc_id", "text_hash", "block", "label", "template", (F.col("most") / F.col("n")).alias("containment")))
    return found.distinct()


def most_in_a_run() -> Column:
    """The most words of ``own`` in ``length`` adjacent words of ``low``; the words are bound by a lambda, so that they are split once."""

    def most(words: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_contains("own", F.get(words, i - 1)))
        return F.array_max(F.transform(begins, lambda i: F.size(F.array_intersect("own", F.slice(words, i, F.col("length"))))))

    return F.transform(F.array(F.array_remove(F.split("low", NOT_WORD), "")), most)[0]


def phrase_places(docs: DataFrame, phrases: Iterable[tuple[str, str]] = PHRASES) -> DataFrame:
    """doc_id, text_hash, n_words, n_base, first_word, last_word and base_found (labels) of every row."""
    phrases = list(phrases)
    # Each word between blanks of its own, so that adjacent phrases share none.
    spaced = F.trim(F.regexp_replace("low", NOT_WORD, "  "))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), lowered(whole_text()).alias("low"))
    rows = rows.select("doc_id", "text_hash", F.when(spaced == "", F.lit("")).otherwise(F.concat(F.lit(" "), spaced, F.lit(" "))).alias("spaced"))

    def n_words(s: Column) -> Column:
        return ((F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("long")

    def parts(phrase: str) -> Column:
        needle = " " + "  ".join(phrase.split()) + " "
        return F.when(F.contains("spaced", F.lit(needle)), F.split("spaced", needle))

    rows = rows.select("doc_id", "text_hash", n_words(F.col("spaced")).alias("n_words"), *[parts(p).alias(f"parts_{k}") for k, (p, _) in enumerate(phrases)])
    firsts = [n_words(F.col(f"parts_{k}")[0]) for k in range(len(phrases))]
    lasts = [F.col("n_words") - len(p.split()) - n_words(F.element_at(f"parts_{k}", -1)) for k, (p, _) in enumerate(phrases)]
    places = [F.coalesce(F.size(F.col(f"parts_{k}")) - 1, F.lit(0)) for k in range(len(phrases))]
    labels = F.array_compact(F.array(*[F.when(F.col(f"parts_{k}").isNotNull(), F.lit(label)) for k, (_, label) in enumerate(phrases)]))
    least, most = (F.least, F.greatest) if len(phrases) > 1 else ((lambda x: x),) * 2
    return rows.select("doc_id", "text_hash", "n_words", sum(places[1:], places[0]).cast("long").alias("n_base"), least(*firsts).alias("first_word"), most(*lasts).alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base_found"))


def scan_licenses(docs: DataFrame, templates: Iterable[Template] = TEMPLATES, phrases: Iterable[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD, wrapped: bool = False) -> DataFrame:
    """Labels of every row: those of its phrases and those of the templates that its blocks contain.

    score: the largest containment of a matched template, 1 where a phrase was found, else 0.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    matched = contained_templates(docs, templates, threshold, wrapped).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"), F.count("*").alias("n_matches"))
    base = phrase_places(docs, phrases)
    same = base["doc_id"].eqNullSafe(matched["doc_id"]) & (base["text_hash"] == matched["text_hash"])
    rows = base.join(matched, same, "left").select(base["*"], F.coalesce("found", F.array().cast("array<string>")).alias("found"), "best", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))
    has_base = F.size("base_found") > 0
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_found", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base_found", "found")), ",").alias("labels"), F.when(has_base, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "n_matches")
