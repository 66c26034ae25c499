"""License texts in documents by an exact set-similarity join.

A text block meets a template when it contains at least the given share of the
template's distinct words. Blocks are lines and, for notices wrapped over several lines,
windows of consecutive words a little longer than the template. Template words are ordered by how many blocks of the
whole corpus hold them, rarest first. Then

* prefix: a block with k of a template's n words holds one of its first n - k + 1;
* length: a block with fewer than k words of the vocabulary is out;
* position: the first common word, at places i and j of the two ordered sets, leaves
  room for min(n - i, m - j) common words at most;

and what passes is counted. The prefixes are rare words, so few blocks reach the join.
Templates are part of the plan, so their vocabulary has a known size. All steps are
column expressions; nothing runs outside the JVM.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices and opening sentences of public licenses, in plain words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
)
# Phrases that name a license by themselves.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Words: letters, digits and all non-ASCII characters; A-Z before they are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def folded(text: Column) -> Column:
    """Text with A-Z in lower case. Other letters may change too, but none becomes an
    ASCII one: the two that would are left alone by the slower way."""
    odd = text.contains("İ") | text.contains("K")
    upper = "".join(map(chr, range(65, 91)))
    return F.when(odd, F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def _literals(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def phrase_places(words: Column, phrases=PHRASES) -> Column:
    """array<struct<at, label>>: word positions where a phrase starts, from 0."""
    every = F.sequence(F.lit(0), F.size(words) - 1)

    def found(phrase: str, label: str) -> Column:
        parts = phrase.split()

        def starts(i):
            hit = F.get(words, i) == parts[0]
            for k, part in enumerate(parts[1:], 1):
                hit = hit & F.coalesce(F.get(words, i + k) == part, F.lit(False))
            return hit

        return F.transform(F.filter(every, starts), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    return F.when(F.size(words) > 0, F.flatten(F.array(*[found(*p) for p in phrases])))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select("doc_id", F.md5("text").alias("text_hash"), folded(F.col("text")).alias("low"))


def _lines(docs: DataFrame) -> DataFrame:
    return _texts(docs).select("doc_id", "text_hash", F.posexplode(F.split("low", "\n")).alias("block", "line"))


def prefixes(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8):
    """Template words from rare to frequent in ``docs``, templates in that order as
    (number, label, words, words needed, words in a window), and prefix words as
    (word, template, place)."""
    sets = [(n, label, text.split()) for n, (label, text) in enumerate(templates)]
    vocabulary = sorted({w for _, _, words in sets for w in words})
    # One row per word of the templates comes back, whatever the corpus.
    found = F.explode(F.array_intersect(F.split("line", GAP), _literals(vocabulary)))
    seen = {r[0]: r[1] for r in _lines(docs).select(found.alias("word")).groupBy("word").count().collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    ranked = []
    for n, label, words in sets:
        distinct = sorted(set(words), key=order.__getitem__)
        if distinct:
            ranked.append((n, label, distinct, max(1, math.ceil(round(threshold * len(distinct), 9))), math.ceil(round(len(words) / threshold, 9))))
    return order, ranked, [(w, n, i) for n, _, words, needed, _ in ranked for i, w in enumerate(words[: len(words) - needed + 1])]


def _joined(spark, ranked, prefix) -> tuple[DataFrame, DataFrame]:
    index = spark.createDataFrame(prefix, "word string, template int, i int")
    return index, spark.createDataFrame(ranked, "template int, label string, expected array<string>, needed int, span int")


def matching_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8, known=None) -> DataFrame:
    """Every line of ``docs`` (doc_id, text) that meets a template: doc_id,
    text_hash (md5 of the text), block (line number from 0), label, template (number
    in ``templates``) and containment. ``known`` is what ``prefixes`` gave."""
    lines = _lines(docs)
    order, ranked, prefix = known or prefixes(docs, templates, threshold)
    if not prefix:
        return lines.limit(0).select("doc_id", "text_hash", "block", F.lit("").alias("label"), F.lit(0).alias("template"), F.lit(0.0).alias("containment"))

    index, whole = _joined(docs.sparkSession, ranked, prefix)
    # The intersection comes in the order of its first argument: rarest word first.
    held = lines.select("doc_id", "text_hash", "block", F.array_intersect(_literals(order), F.split("line", GAP)).alias("words"))
    probes = held.select("*", F.posexplode("words").alias("j", "word"))
    met = probes.join(F.broadcast(index), "word").groupBy("doc_id", "text_hash", "block", "template", "words").agg(F.min(F.struct("i", "j")).alias("first"))
    candidates = met.join(F.broadcast(whole), "template")
    room = F.least(F.size("expected") - F.col("first.i"), F.size("words") - F.col("first.j"))
    common = F.size(F.array_intersect("words", "expected"))
    near = candidates.where((F.size("words") >= F.col("needed")) & (room >= F.col("needed"))).where(common >= F.col("needed"))
    return near.select("doc_id", "text_hash", "block", "label", "template", (common / F.size("expected")).alias("containment"))


def matching_windows(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8, known=None) -> DataFrame:
    """Every template that words in a row of a text of ``docs`` meet, whatever line feeds
    stand between them: doc_id, text_hash, label, template and containment, the best of
    the windows that are 1 / ``threshold`` times as long as the template.

    A window that meets a template holds a word of its prefix, so only the words around
    those are looked at; texts without one are not split."""
    texts = _texts(docs)
    _, ranked, prefix = known or prefixes(docs, templates, threshold)
    if not prefix:
        return texts.limit(0).select("doc_id", "text_hash", F.lit("").alias("label"), F.lit(0).alias("template"), F.lit(0.0).alias("containment"))

    index, whole = _joined(docs.sparkSession, ranked, prefix)
    rare, reach = sorted({w for w, _, _ in prefix}), max(span for *_, span in ranked) - 1
    some = reduce(operator.or_, [F.col("low").contains(w) for w in rare])
    split = texts.where(some & F.col("low").contains("\n")).select("doc_id", "text_hash", _words(F.col("low")).alias("words"))

    def around(at):
        first = F.greatest(at - reach, F.lit(0))
        return F.struct(F.get("words", at).alias("word"), (at - first).alias("at"), F.slice("words", first + 1, at - first + reach + 1).alias("near"))

    every = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))
    places = F.transform(F.filter(every, lambda i: F.array_contains(_literals(rare), F.get("words", i))), around)
    probes = split.select("doc_id", "text_hash", F.explode(places).alias("p")).select("doc_id", "text_hash", "p.*")
    candidates = probes.join(F.broadcast(index), "word").join(F.broadcast(whole), "template")
    close = candidates.where(F.size(F.array_intersect("near", "expected")) >= F.col("needed"))
    starts = F.sequence(F.greatest(F.col("at") - F.col("span") + 1, F.lit(0)), F.col("at"))
    common = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("near", i + 1, F.col("span")), F.col("expected")))))
    near = close.withColumn("common", common).where("common >= needed")
    return near.groupBy("doc_id", "text_hash", "label", "template").agg(F.max(F.col("common") / F.size("expected")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base (places of
    ``phrases``), first_word and last_word (smallest and largest such place, from 0,
    else null), base_labels and labels (base ones and those of templates met by a
    line or by a window over several lines; distinct, sorted, comma-joined) and score (1 with a phrase, else the best
    containment of a template met, else 0).

    Null text counts as empty. Results depend on the text alone, so rows with null or
    repeated doc_id are right too. Other columns are not looked at; an empty table
    gives an empty result.
    """
    named = F.col("text").rlike("(?i)" + "|(?i)".join(sorted({p.split()[-1] for p, _ in phrases})))
    counted = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    split = docs.select("doc_id", F.md5("text").alias("text_hash"), counted.alias("n_words"), F.when(named, _words(folded(F.col("text")))).alias("words"))
    places = F.when(F.col("words").isNotNull(), phrase_places(F.col("words"), phrases))
    rows = split.select("doc_id", "text_hash", "n_words", F.coalesce(places, F.array().cast("array<struct<at: bigint, label: string>>")).alias("places"))
    known = prefixes(docs, templates, threshold)
    columns = ["doc_id", "text_hash", "label", "containment"]
    blocks = matching_blocks(docs, templates, threshold, known).select(columns).unionByName(matching_windows(docs, templates, threshold, known).select(columns))
    found = blocks.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
