"""License scans by diagonal voting.

Templates are phrases and notices with a label each.  Every run of k words of every document is
hashed; Spark joins all of them to the templates' positions.  A match votes for a diagonal: its
place in the document less its place in the template.  Votes are counted per document, template and
diagonal; diagonals that lie next to each other and follow on are merged (words put in or left out);
a merged span counts if enough of the template's words are found in it, and it has few others.

The templates are a small table of stated size, which is sent to all tasks; documents are read once
and only matches leave a task.

Defined results: null and empty texts have no words, labels or spans and a score of 0; null and
repeated ids are rows of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from herdwatch.llm import store
from herdwatch.llm.words import ALNUM, keys, mix, parts, words

K = 3
#: Diagonals at most so far apart, with at most so many words between, belong to one span.
SHIFT, GAP = 4, 12
#: Share of a template's words that a span must have, and of the span's words that must be the template's.
COVER, DENSITY = 0.8, 0.6
#: Templates of fewer words differ by single words (version numbers): they must be found whole.
SHORT = 12
#: Templates beyond so many words are refused: they would not be small enough to send to all tasks.
MOST_WORDS = 200_000

# The base phrases with their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# The standard notices of well-known licenses, as their stewards publish them.
NOTICES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ],
    "apache-2": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"],
    "gpl-2": ["GNU General Public License, version 2"],
    "gpl-3": [
        "GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "lgpl": ["GNU Lesser General Public License"],
    "agpl-3": ["GNU Affero General Public License, version 3"],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "cc-by": ["Licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
}

HITS = "row bigint, doc_id bigint, n_words bigint, grams array<bigint>"


def _grams(hashed: np.ndarray) -> np.ndarray:
    """The hash of every run of K words."""
    out = np.zeros(max(0, len(hashed) - K + 1), np.uint64)
    for i, key in enumerate(keys(K, 41)):
        out += mix(hashed[i : i + len(out)] ^ key)
    return mix(out).view(np.int64)


def templates(base: Mapping[str, str] = BASE, notices: Mapping[str, Sequence[str]] = NOTICES) -> list[tuple[str, bool, np.ndarray]]:
    """(label, whether it is a base phrase, word hashes) of every template of at least K words."""
    listed = [(label, True, text) for text, label in base.items()] + [(label, False, t) for label, texts in notices.items() for t in texts]
    hashed = [(label, exact, words(pa.array([t]), ALNUM)[0]) for label, exact, t in listed]
    if sum(len(h) for _, _, h in hashed) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words")
    if any(len(h) < K for _, _, h in hashed):
        raise ValueError(f"a template has fewer than {K} words")
    return hashed


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with the hashes of its runs of words; the first entry stands for the document itself."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for part in parts(batch, "text"):
            hashed, first, _, _ = words(part["text"], ALNUM)
            every = np.append(_grams(hashed), np.zeros(K - 1, np.int64))[: len(hashed)]
            counts = np.diff(first)
            kept = np.maximum(counts - K + 1, 0)
            ends = np.append(0, np.cumsum(kept + 1))
            flat = np.zeros(ends[-1], np.int64)
            at = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
            flat[np.repeat(ends[:-1] + 1, kept) + at] = every[np.repeat(first[:-1], kept) + at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(part.num_rows)), part["doc_id"], pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))],
                names=["row", "doc_id", "n_words", "grams"],
            )
            row += part.num_rows


def diagonals(docs: DataFrame, known: list[tuple[str, bool, np.ndarray]]) -> DataFrame:
    """All votes: (row, doc_id, n_words, template, diagonal, votes, places in the template, first, last).

    Every document has one row with template -1 beside its votes.
    """
    spark = docs.sparkSession
    store.bounded_batches(spark)
    positions = [(0, -1, -1)] + [(int(g), t, i) for t, (_, _, h) in enumerate(known) for i, g in enumerate(_grams(h))]
    sent = F.broadcast(spark.createDataFrame(positions, "gram bigint, template int, place int"))
    plain = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    every = plain.mapInArrow(_hashed, HITS).select("row", "doc_id", "n_words", F.posexplode("grams").alias("at", "gram"))
    hits = every.join(sent, "gram").filter((F.col("template") >= 0) | (F.col("at") == 0))
    place = F.col("at") - 1
    return store.keep(
        hits.groupBy("row", "doc_id", "n_words", "template", (place - F.col("place")).alias("diagonal")).agg(
            F.count(F.lit(1)).alias("votes"), F.array_sort(F.collect_set("place")).alias("places"),
            F.min(place).alias("first"), F.max(place).alias("last"),
        ),
        "diagonals",
    )


def merged(votes: DataFrame, known: list[tuple[str, bool, np.ndarray]]) -> DataFrame:
    """Spans of the templates: neighbouring diagonals as one, with the share of template words found.

    (row, doc_id, label, first, last, cover, needed, density); first and last are words of the
    document, ``needed`` is the cover from which the span counts.
    """
    spark = votes.sparkSession
    names = spark.createDataFrame([(t, label, len(h)) for t, (label, _, h) in enumerate(known)], "template int, label string, size int")
    order = Window.partitionBy("row", "template").orderBy("first", "diagonal")
    before, reach = F.lag("diagonal").over(order), F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = before.isNull() | (F.abs(F.col("diagonal") - before) > SHIFT) | (F.col("first") - reach > GAP)
    spans = votes.filter("template >= 0").withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(order))
    spans = spans.groupBy("row", "doc_id", "template", "span").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first"), (F.max("last") + K - 1).alias("last")
    )
    # The words of the template that the span's votes stand for, each counted once.
    found = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + K - 1)))))
    spans = spans.join(F.broadcast(names), "template")
    return spans.select(
        "row", "doc_id", "label", "first", "last",
        (found / F.col("size")).alias("cover"), F.when(F.col("size") < SHORT, 1.0).otherwise(COVER).alias("needed"),
        F.least(F.lit(1.0), found / (F.col("last") - F.col("first") + 1)).alias("density"),
    )


def scan(docs: DataFrame, known: list[tuple[str, bool, np.ndarray]] | None = None) -> DataFrame:
    """Per document: places of the base phrases, labels, and the best share of a template found."""
    known = known or templates()
    votes = diagonals(docs, known)
    spark = docs.sparkSession
    phrases = spark.createDataFrame([(t, label, len(h) - K + 1) for t, (label, exact, h) in enumerate(known) if exact], "template int, label string, needed int")
    # A base phrase stands where all its runs vote for one diagonal, which is where it starts.
    exact = votes.join(F.broadcast(phrases), "template").filter("votes = needed").groupBy("row").agg(
        F.count(F.lit(1)).alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base")
    )
    spans = merged(votes, known)
    counted = (F.col("cover") >= F.col("needed")) & (F.col("density") >= DENSITY)
    loose = spans.groupBy("row").agg(F.collect_set(F.when(counted, F.col("label"))).alias("more"), F.max(F.col("cover") * F.col("density")).alias("score"))
    rows = votes.filter("template = -1").select("row", "doc_id", "n_words")
    out = rows.join(exact, "row", "left").join(loose, "row", "left")
    none = F.array().cast("array<string>")
    base, more = F.coalesce("base", none), F.coalesce("more", none)
    zero = F.lit(0).cast("bigint")
    return out.select(
        "doc_id", "n_words",
        F.coalesce("n_base", zero).alias("n_base"),
        F.col("first_word").cast("bigint").alias("first_word"),
        F.col("last_word").cast("bigint").alias("last_word"),
        F.array_sort(base).alias("base_labels"),
        F.array_sort(F.array_union(base, more)).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )


def op3_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("base_labels", F.concat_ws(",", "base_labels")).withColumn("labels", F.concat_ws(",", "labels"))
