"""License scans: base phrases by place, and notices by an exact set-similarity join of text blocks with templates.

A text block is a window of 2 W words, at every multiple of W, and a template meets the blocks whose W is the least power
of two (4 at least) that holds its words: wherever a notice stands, over line ends too, some block has it whole.  A block
carries a template if it holds ``CONTAINMENT`` percent of the template's distinct words.  Found exactly:

* tokens are ordered by their frequency over all texts, rare first; that is one count over the whole table;
* prefix filter: a block that holds ``need`` of a template's ``size`` words holds one of its first ``size - need + 1``, so
  blocks without such a word are never made, and the join's key is such a word;
* length filter: the block has ``need`` template words at all;
* positional filter: after a shared word at place i of the template and j of the block, no more than the rest of the
  shorter remainder can be shared;
* the survivors are counted out.

A text is read once: the places of the words that any template or phrase has are written as a narrow table, and frequencies,
phrases and blocks come from that.  Templates are a small table of the caller's; the planner decides how to join it.

Defined results: a null text is an empty one and has no words; repeated rows repeat their results; equal frequencies are
ordered by the word; a block's words count once; the score is the largest containment, 1 where a base phrase stands, 0 where
nothing is found; a block that holds the words of several templates carries all their labels; templates without words match nothing; no rows give no rows.  Input columns named like results give way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labourlens.session import stored

CONTAINMENT = 90
LEAST_WIDTH = 4
PIECE = 1 << 20  # bytes of a text that are cut into words at once
#: On lower-cased UTF-8: ASCII letters and digits, and all that is not ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Names of licenses and notices by which they are usually stated.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("reserved", "All rights reserved"),
]


class Vocabulary(dict):
    """Word to number, -1 for all others."""

    def __missing__(self, word: bytes) -> int:
        return -1


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


def width(words: int) -> int:
    """Least power of two that holds so many words."""
    return max(LEAST_WIDTH, 1 << (words - 1).bit_length())


def needed(size: int, containment: int = CONTAINMENT) -> int:
    return -(-size * containment // 100)


def known_places(text: str, vocabulary: Vocabulary) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, and the places and numbers of those in the vocabulary; piece by piece."""
    data, at, n, places, numbers = text.encode().lower(), 0, 0, [], []
    while at < len(data):
        gap = GAP.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = gap.end() if gap else len(data)
        words = WORD.findall(data, at, end)
        known = np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))
        hits = np.flatnonzero(known >= 0)
        places.append(hits + n)
        numbers.append(known[hits])
        n, at = n + len(words), end
    return n, np.concatenate(places or [np.zeros(0, int)]), np.concatenate(numbers or [np.zeros(0, np.int32)])


def phrase_starts(places: np.ndarray, numbers: np.ndarray, phrase: Sequence[int]) -> np.ndarray:
    """Places at which the phrase's words stand one after another."""
    m = len(places) - len(phrase) + 1
    if m <= 0 or not phrase:
        return places[:0]
    fits = np.ones(m, bool)
    for k, word in enumerate(phrase):
        fits &= (numbers[k : k + m] == word) & (places[k : k + m] == places[:m] + k)
    return places[:m][fits]


def scanned(df: DataFrame, text: str, phrases: Mapping[str, str], vocabulary: Vocabulary) -> DataFrame:
    """``row`` (all columns but the text), ``rid``, ``n_words``, base phrases, and the known words' ``places`` and ``numbers``."""
    columns = [c for c in df.columns if c != text]
    rows = df.select(F.struct(*(columns or [F.lit(0).alias("n_words")])).alias("row"), F.monotonically_increasing_id().alias("rid"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["row"], rows.schema["rid"], *T.StructType().add("n_words", T.LongType()).add("n_base", T.LongType()).add("first_word", T.LongType())
                           .add("last_word", T.LongType()).add("base", T.ArrayType(T.StringType())).add("places", T.ArrayType(T.LongType())).add("numbers", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)
    sought = {label: [vocabulary[w] for w in words_of(phrase)] for label, phrase in phrases.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in range(7)]
            for value in b.column(2):
                n, places, numbers = known_places(value.as_py() or "", vocabulary)
                starts = {label: phrase_starts(places, numbers, phrase) for label, phrase in sought.items()}
                found = np.concatenate([*starts.values(), places[:0]])
                base = sorted(label for label, s in starts.items() if len(s))
                for to, v in zip(out, (n, len(found), int(found.min()) if len(found) else None, int(found.max()) if len(found) else None, base, places, numbers)):
                    to.append(v)
            made = [pa.array(v, f.type) for v, f in zip(out, list(arrow)[2:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=arrow.names)

    return stored(rows.mapInArrow(run, schema), "words")


def block_rows(places: np.ndarray, ranks: np.ndarray, n: int, w: int, prefix: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, distinct ranks in order) of the windows of 2 w words that hold a prefix word and ``least`` known ones."""
    hits = np.unique(places[prefix[ranks]] // w)
    for k in np.union1d(hits, hits[hits > 0] - 1):
        if k and (k + 1) * w >= n:  # a window that the one before holds
            continue
        low, high = np.searchsorted(places, [k * w, (k + 2) * w])
        block = np.unique(ranks[low:high])
        if len(block) >= least:
            yield int(k) * w, block


def blocks(scan: DataFrame, templates: DataFrame, words: int) -> DataFrame:
    """Every block that meets a template: ``rid, template, label, start, containment``.  ``templates``: template, label, width,
    tokens (numbers below ``words``), need."""
    spark = scan.sparkSession
    counted = dict.fromkeys(range(words), 0) | {r["w"]: r["n"] for r in scan.select(F.explode("numbers").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = sorted(counted, key=lambda w: (counted[w], w))  # numbers follow the words' own order
    rank = np.empty(words, np.int64)
    rank[order] = np.arange(words)
    held = [(r["template"], r["label"], r["width"], sorted(int(rank[t]) for t in r["tokens"]), r["need"]) for r in templates.collect()]
    prefixes = [(t, label, w, tokens, need, i, tokens[i]) for t, label, w, tokens, need in held for i in range(len(tokens) - need + 1)]
    masks = {}
    for _, _, w, _, _, _, token in prefixes:
        masks.setdefault(w, np.zeros(words, bool))[token] = True
    least = {w: min(need for _, _, x, _, need in held if x == w) for w in masks}
    schema = T.StructType().add("rid", T.LongType()).add("width", T.IntegerType()).add("start", T.LongType()).add("block", T.ArrayType(T.LongType()))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, arrow)], schema=arrow)
            for v in out:
                v.clear()
            return made

        for b in batches:
            for i in range(b.num_rows):
                rid, n = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                places, numbers = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3))
                for w, mask in masks.items():
                    for start, block in block_rows(places, rank[numbers], n, w, mask, least[w]):
                        for to, v in zip(out, (rid, w, start, block)):
                            to.append(v)
                        if len(out[0]) >= 4096:
                            yield batch()
        if out[0]:
            yield batch()

    found = scan.select("rid", "n_words", "places", "numbers").where(F.size("numbers") > 0).mapInArrow(run, schema)
    index = spark.createDataFrame(prefixes, "template int, label string, width int, tokens array<long>, need int, i int, token long")
    size = F.size("block")
    shared = found.select("*", F.posexplode("block").alias("j", "token")).join(index, ["width", "token"])
    shared = shared.where((size >= F.col("need")) & (F.least(F.size("tokens") - F.col("i"), size - F.col("j")) >= F.col("need")))
    shared = shared.withColumn("common", F.size(F.array_intersect("block", "tokens"))).where("common >= need")
    return shared.select("rid", "template", "label", "start", (F.col("common") / F.size("tokens")).alias("containment")).distinct()


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]], vocabulary: Vocabulary, containment: int) -> DataFrame:
    rows = []
    for k, (label, text) in enumerate(templates):
        words = words_of(text)
        if words:
            tokens = sorted({vocabulary[w] for w in words})
            rows.append((k, label, width(len(words)), tokens, needed(len(tokens), containment)))
    return spark.createDataFrame(rows, "template int, label string, width int, tokens array<int>, need int")


def scan(df: DataFrame, text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES,
         containment: int = CONTAINMENT) -> DataFrame:
    """All columns but the text, with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``
    and ``found``: template, label, start (a word's place) and containment of every block that meets a template."""
    if not 0 < containment <= 100:
        raise ValueError("containment is a percentage")
    known = sorted({w for t in [*phrases.values(), *(t for _, t in templates)] for w in words_of(t)})
    vocabulary = Vocabulary((w, k) for k, w in enumerate(known))
    read = scanned(df, text, phrases, vocabulary)
    met = blocks(read, template_table(df.sparkSession, templates, vocabulary, containment), len(known))
    met = met.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "template", "label", "containment"))).alias("found"))
    out = read.drop("places", "numbers").join(met, "rid", "left")
    found = F.coalesce("found", F.array().cast(met.schema["found"].dataType))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform(found, lambda x: x["label"]))))
    best = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(found, lambda x: x["containment"])), F.lit(0.0)))
    made = {"n_words": F.col("n_words"), "n_base": F.col("n_base"), "first_word": F.col("first_word"), "last_word": F.col("last_word"),
            "base_labels": F.array_join("base", ","), "labels": F.array_join(labels, ","), "score": best, "found": found}
    row = [F.col("row").getField(c).alias(c) for c in read.schema["row"].dataType.names if c not in made]
    return out.select(*row, *[v.alias(k) for k, v in made.items()])
