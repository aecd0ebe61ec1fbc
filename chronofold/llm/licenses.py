"""License scan by diagonal voting.

Every rolling word k-gram of every text is hashed, and all hashes are joined in Spark to the positions of the same hash in
license templates. Words are compared with the templates' words byte by byte, so an equal hash of other words is no hit.
Hits of a document and template are counted by diagonal (place in the text less place in the template); neighbouring
diagonals with enough votes merge into one span, which stands for a copy with a few words added or left out. A span is
verified on its aligned words: of all chains of hits that move forward both in the text and in the template the one with the most
matched words less inserted ones counts, and the matched words must be enough of the template's and the inserted ones together.
So a text that repeats one line of a notice is not a copy of it. Words that tell licenses apart count more: a template names
those that its copy must hold (``need``) and those that must not stand inside it (``never``), which are looked up by the same join.
Phrases use the shortest k-gram that they hold; they and short mentions must be there whole.

The templates are a parameter of fixed size, so their side of the join is broadcast. The hits of a span are gathered for its
verification: a span lies within one text, which one task has read whole before.

Defined cases: a null text is empty and has no words; a text shorter than k has no k-grams; a text of any length is scanned
whole; repeated rows are scanned one by one; overlapping spans of one template count once each by their start; a null
doc_id is kept as it is; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm import textops
from chronofold.scratch import Scratch

PHRASE_K, NOTICE_K = 2, 4
#: Share of a notice's words, and of words inserted into it, that must match.
COVER = 0.6
#: Diagonals this near to each other merge.
NEAR = 6
#: K-grams of a batch on their way to the join.
GRAM_ROWS = 1 << 17


@dataclass(frozen=True)
class Template:
    """``whole``: a copy has all words and no others between. ``need``: words that it holds in any case; ``never``: words that it doesn't hold."""

    label: str
    text: str
    phrase: bool = False
    whole: bool = False
    need: str = ""
    never: str = ""


# The phrases of the base labels.
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)

# Opening words of widely used notices, and usual short mentions.
NOTICES = (
    Template("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", need="free charge software"),
    Template("apache-notice", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License", need="apache compliance"),
    Template("apache-mention", "Licensed under the Apache License, Version 2.0.", whole=True),
    Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", need="gnu general redistribute", never="lesser library affero"),
    Template("gpl-mention", "This work is licensed under the GNU General Public License, version 3.", whole=True),
    Template("mit-mention", "Released under the MIT License.", whole=True),
    Template("cc-by-mention", "This work is licensed under a Creative Commons Attribution 4.0 International License", whole=True),
    Template("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", need="redistribution binary permitted conditions", never="not"),
    Template("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", need="modify software fee", never="not"),
    Template("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", need="mozilla public 2"),
    Template("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means", need="no reproduced"),
)


def _words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = textops.LOWER[np.frombuffer(text.encode(), np.uint8)]
    start, end, first = textops.words(data, np.array([0, len(data)]), textops.ALNUM_LOWER)
    return data, start, end, first, textops.span_hashes(data, start, end)


class Vocabulary:
    """The templates' words: their numbers by hash, confirmed on their bytes."""

    def __init__(self, templates: tuple[Template, ...]) -> None:
        words = sorted({w for t in templates for w in self.split(f"{t.text} {t.never}")})
        tokens = np.concatenate([_words_of(w.decode())[4] for w in words])
        order = np.argsort(tokens)
        self.words, self.tokens = [words[i] for i in order], tokens[order]
        self.length = np.array([len(w) for w in self.words])
        self.bytes = np.zeros((len(words), self.length.max()), np.uint8)
        for i, w in enumerate(self.words):
            self.bytes[i, : len(w)] = np.frombuffer(w, np.uint8)
        never = {w for t in templates for w in self.split(t.never)}
        self.never = np.array([w in never for w in self.words])

    @staticmethod
    def split(text: str) -> list[bytes]:
        data, start, end, _, _ = _words_of(text)
        return [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The number of each word in the vocabulary, or -1."""
        out = np.full(len(tokens), -1, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        maybe = np.flatnonzero((self.tokens[at] == tokens) & (self.length[at] == end - start))
        at = at[maybe]
        same = np.ones(len(maybe), bool)
        for j in range(self.bytes.shape[1]):
            inside = j < self.length[at]
            same[inside] &= data[start[maybe[inside]] + j] == self.bytes[at[inside], j]
        out[maybe[same]] = at[same]
        return out

    def codes(self, numbers: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """One number for the words of each k-gram that starts at ``at``, or -1 where one isn't in the vocabulary."""
        out, known = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for i in range(k):
            word = numbers[at + i]
            known &= word >= 0
            out = out * len(self.words) + word
        return np.where(known, out, -1)


def template_grams(templates: tuple[Template, ...], vocabulary: Vocabulary) -> list[tuple[int, int, int, int, int, int]]:
    """(hash, k, template, place, code, words of the template) of every k-gram of the templates; with k = 1 and place -1 those of their ``never`` words."""
    out = []
    for t, x in enumerate(templates):
        data, start, end, _, tokens = _words_of(x.text)
        k = PHRASE_K if x.phrase else NOTICE_K
        if len(tokens) < k:
            raise ValueError(f"the template {x.label} is shorter than {k} words")
        places = np.arange(len(tokens) - k + 1)
        codes = vocabulary.codes(vocabulary.numbers(data, start, end, tokens), places, k)
        out += [(int(h.astype(np.int64)), k, t, int(i), int(c), len(tokens)) for i, h, c in zip(places, textops.gram_hashes(tokens, k), codes, strict=True)]
        if x.never:
            data, start, end, _, never = _words_of(x.never)
            out += [(int(h.astype(np.int64)), 1, t, -1, int(c), len(tokens)) for h, c in zip(textops.gram_hashes(never, 1), vocabulary.numbers(data, start, end, never), strict=True)]
    return out


def _gram_rows(docs: DataFrame, vocabulary: Vocabulary, ks: tuple[int, ...]) -> DataFrame:
    """row (one a document) and hash, k, place, code of every rolling k-gram of the text, and with k = 1 of its words that some template never holds; one row with k = 0 for each document, with its doc_id and n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        for b in textops.long_rows(batches):
            data, offsets = textops.text_bytes(b.column("text"))
            for lo, hi in textops.pieces(offsets):
                part, off = textops.LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
                start, end, first = textops.words(part, off, textops.ALNUM_LOWER)
                tokens = textops.span_hashes(part, start, end)
                numbers = vocabulary.numbers(part, start, end, tokens)
                rows = base + np.arange(lo, hi)
                none, zero = pa.nulls(hi - lo, pa.int64()), pa.array(np.zeros(hi - lo, np.int32))
                yield _batch(rows, b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(first)), zero, zero, none, none)
                for k in ks:
                    at, counts = textops.gram_starts(first, k)
                    own = np.repeat(np.arange(hi - lo), counts)
                    if k == 1:
                        marked = vocabulary.never[numbers[at]] & (numbers[at] >= 0)
                        at, own = at[marked], own[marked]
                    grams = textops.gram_hashes(tokens, k)[at].view(np.int64)
                    codes, places = vocabulary.codes(numbers, at, k), (at - first[own]).astype(np.int32)
                    for some in range(0, len(at), GRAM_ROWS):
                        cut = slice(some, some + GRAM_ROWS)
                        n = len(at[cut])
                        yield _batch(rows[own[cut]], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, k, np.int32)), pa.array(places[cut]), pa.array(grams[cut]), pa.array(codes[cut]))
            base += b.num_rows

    def _batch(rows: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows), *columns], names=["row", "doc_id", "n_words", "k", "place", "hash", "code"])

    return docs.select("doc_id", "text").mapInArrow(run, "row long, doc_id long, n_words long, k int, place int, hash long, code long")


def _chain(pairs: list[tuple[int, int]], k: int) -> tuple[int, int, int, int]:
    """(words matched, words inserted, first word, last word) of the best chain of hits (place, place in the template) that rises in both.

    Best: the most matched less inserted words, then the most matched. From a hit to the next one as many words are newly matched as
    the lesser of their distances in text and template, k at most; the text's other words between them are inserted. Hits come in the order
    of places; of those k or more places back only the best for each place of the template counts, since what lies between is
    inserted whichever it was.
    """
    recent: list[tuple[int, int, tuple[int, int, int]]] = []  # place, place in the template, (matched - inserted, matched, - first place)
    settled: dict[int, tuple[int, int, int]] = {}  # by place in the template, as if it ended at place 0
    best, last = (-1, 0, 0), 0
    for i, j in sorted(set(pairs)):
        while recent and recent[0][0] <= i - k:
            was, t, (value, matched, first) = recent.pop(0)
            settled[t] = max(settled.get(t, (value + was, matched, first)), (value + was, matched, first))
        own = (k, k, -i)
        for t, (value, matched, first) in settled.items():
            if t < j:
                new = min(j - t, k)
                own = max(own, (value - i + 2 * new, matched + new, first))
        for was, t, (value, matched, first) in recent:
            if was < i and t < j:
                new = min(i - was, j - t)
                own = max(own, (value + 2 * new - (i - was), matched + new, first))
        recent.append((i, j, own))
        if own > best:
            best, last = own, i + k - 1
    value, matched, first = best
    return matched, matched - value, -first, last


def _verified(spans: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """row, k, template, t_words, hits of spans -> row, template, first_word, last_word, cover of those that hold enough of their template."""
    needed = []
    for t in templates:
        words, need = Vocabulary.split(t.text), set(Vocabulary.split(t.need))
        needed.append({w: [i for i, x in enumerate(words) if x == w] for w in need})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textops.long_rows(batches):
            out = []
            for row, k, template, t_words, hits in zip(*(b.column(c).to_pylist() for c in ("row", "k", "template", "t_words", "hits")), strict=True):
                pairs = [(h["place"], h["t_place"]) for h in hits]
                covered = {j + a for j in {j for _, j in pairs} for a in range(k)}
                if not all(covered.intersection(places) for places in needed[template].values()):
                    continue
                matched, inserted, first, last = _chain(pairs, k)
                cover = matched / (t_words + inserted)
                if cover >= (1 if _whole(templates[template]) else COVER):
                    out.append((row, template, first, last, cover))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["row", "template", "first_word", "last_word", "cover"])

    return spans.mapInArrow(run, "row long, template int, first_word long, last_word long, cover double")


def _whole(t: Template) -> bool:
    return t.phrase or t.whole


def license_spans(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES) -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc_id, n_words), and a row a verified span: row, label, phrase, first_word, last_word, cover."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(templates)
    grams = template_grams(templates, vocabulary)
    ks = tuple(sorted({g[1] for g in grams}))
    places = spark.createDataFrame(grams, "hash long, t_k int, template int, t_place int, t_code long, t_words int")
    labels = spark.createDataFrame([(i, t.label, t.phrase) for i, t in enumerate(templates)], "template int, label string, phrase boolean")
    whole = F.col("template").isin([i for i, t in enumerate(templates) if _whole(t)])
    # the templates' side has a row a word of the templates: a parameter, not data
    met = _gram_rows(docs, vocabulary, ks).join(F.broadcast(places), "hash", "left").where((F.col("k") == 0) | ((F.col("k") == F.col("t_k")) & (F.col("code") == F.col("t_code"))))
    met = Scratch(spark).save(met.select("row", "doc_id", "n_words", "k", "place", "template", "t_place", "t_words"), "hits")
    hits = met.where("k > 1").withColumn("diagonal", F.col("place") - F.col("t_place"))
    votes = hits.groupBy("row", "k", "template", "t_words", "diagonal").agg(F.count("*").alias("votes"), F.collect_list(F.struct("place", "t_place")).alias("hits"))
    # neighbouring diagonals of a document and notice: a new span where the step is wide
    w = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > F.when(whole, 0).otherwise(NEAR), F.lit(True))
    chained = votes.withColumn("span", F.sum(apart.cast("int")).over(w))
    spans = chained.groupBy("row", "k", "template", "t_words", "span").agg(F.sum("votes").alias("votes"), F.flatten(F.collect_list("hits")).alias("hits"))
    enough = F.col("votes") + (F.col("k") - 1) * F.size("hits") >= F.when(whole, F.col("t_words")).otherwise(COVER * F.col("t_words"))
    held = _verified(spans.where(enough), templates)
    never = met.where("k = 1").select(F.col("row").alias("_row"), F.col("template").alias("_template"), F.col("place").alias("_place"))
    inside = (F.col("row") == F.col("_row")) & (F.col("template") == F.col("_template")) & F.col("_place").between(F.col("first_word"), F.col("last_word"))
    good = held.join(never, inside, "left_anti").join(F.broadcast(labels), "template")
    return met.where("k = 0").select("row", "doc_id", "n_words"), good.select("row", "label", "phrase", "first_word", "last_word", "cover")


def scan_documents(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES) -> DataFrame:
    """A row a document: doc_id, n_words, n_base, first_word and last_word (where the first and the last phrase starts), base_labels, labels, score (the best cover of a template; 1 for a phrase)."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    rows, spans = license_spans(docs, templates)
    found = spans.groupBy("row").agg(
        F.count_if("phrase").alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("first_word"))).alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("first_word"))).alias("last_word"),
        joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("cover").alias("score"),
    )
    empty = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    out = rows.join(found, "row", "left").drop("row")
    return out.select("doc_id", "n_words", *(F.coalesce(c, empty[c]).alias(c) if c in empty else c for c in found.columns if c != "row"))
