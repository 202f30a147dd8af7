"""Operator 9: licence scans by diagonal voting.

Texts are lower-cased (A-Z) and split into runs of digits, letters a-z and characters beyond ASCII. Every rolling
``k``-word hash of every text is joined, by Spark, to the positions of the same hash in the templates. A hit at
word ``pos`` of a text and ``tpos`` of a template votes for the diagonal ``pos - tpos``; votes are summed by
diagonal, neighbouring diagonals (at most ``max_gap`` apart: words were put in or left out) merge into one span, and
a span is verified when its hits cover at least ``min_cover`` of the template's words.

The templates are a fixed list of this module and so bounded; only they are broadcast. Base places are exact phrase
matches; the method's labels come on top of the base labels. The score is the largest share of a template that a
verified span covers, 1 where a base phrase stands.

Null and empty texts have no words, no labels and score 0. Votes are kept by id and text hash, so each row, with an id of its
own, a shared one or none, gets what its own text holds; equal rows vote together. A text of any length is scanned whole, and
a template that stands in it many times gives a span each time its diagonals are apart. Other columns are ignored. An
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm._spark import row_key, ship
from corpusloom.llm._text import ALNUM, Words, buffer, pieces, rolling, starts_of, word_hash

#: The phrases of the base and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Excerpts of public licence notices, as (label, text).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)
K, MAX_GAP, MIN_COVER = 3, 4, 0.75


def template_rows(templates=TEMPLATES, k: int = K) -> list[tuple[int, int, int]]:
    """(hash, template, tpos) of every rolling k-word hash of the templates."""
    rows = []
    for t, (_, text) in enumerate(templates):
        h = rolling(np.array([word_hash(w) for w in text.split()], np.uint64), k)
        rows += [(int(x), t, i) for i, x in enumerate(h.view(np.int64))]
    return rows


def grams(docs: DataFrame, k: int = K) -> DataFrame:
    """Every rolling k-word hash of every text: doc_id, th, pos, gram."""

    def run(batches):
        for b in pieces(batches):
            w = Words(*buffer(b.column("text")), ALNUM, lower=True)
            at = starts_of(w.first, k)
            if len(at):
                owner = np.searchsorted(w.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), b.column(1).take(pa.array(owner)), pa.array((at - w.first[owner]).astype(np.int32)), pa.array(rolling(w.hashes(), k)[at].view(np.int64))], ["doc_id", "th", "pos", "gram"])

    return docs.mapInArrow(run, "doc_id long, th long, pos int, gram long")


def base(docs: DataFrame) -> DataFrame:
    """Per row: the words and the places of the base phrases."""
    phrases = [([word_hash(x) for x in text.split()], label) for text, label in BASE]

    def run(batches):
        for b in pieces(batches):
            w = Words(*buffer(b.column("text")), ALNUM, lower=True)
            h, n = w.hashes(), b.num_rows
            total, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
            found = []
            for words, label in phrases:
                at = starts_of(w.first, len(words))
                for i, x in enumerate(words):
                    at = at[h[at + i] == np.uint64(x)]
                owner = np.searchsorted(w.first, at, "right") - 1
                pos = at - w.first[owner]
                total += np.bincount(owner, minlength=n)
                np.minimum.at(first, owner, pos)
                np.maximum.at(last, owner, pos)
                has = np.zeros(n, bool)
                has[owner] = True
                found.append((label, has))
            labels = [sorted(label for label, has in found if has[i]) for i in range(n)]
            none = total == 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(w.counts.astype(np.int64)), pa.array(total), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(labels, pa.list_(pa.string()))],
                ["doc_id", "th", "n_words", "n_base", "first_word", "last_word", "base"],
            )

    return docs.mapInArrow(run, "doc_id long, th long, n_words long, n_base long, first_word long, last_word long, base array<string>")


def spans(docs: DataFrame, templates=TEMPLATES, k: int = K, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> DataFrame:
    """Verified spans: doc_id, th, label, first_word, end_word, cover (the share of the template's words)."""
    spark = ship(docs.sparkSession)
    index = F.broadcast(spark.createDataFrame(template_rows(templates, k), "gram long, template int, tpos int"))
    sizes = spark.createDataFrame([(t, label, len(text.split())) for t, (label, text) in enumerate(templates)], "template int, label string, size int")
    votes = grams(docs, k).join(index, "gram").groupBy("doc_id", "th", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("hits"))
    order = W.partitionBy("doc_id", "th", "template").orderBy("diagonal")
    islands = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > max_gap).cast("int")).withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(order))
    merged = islands.groupBy("doc_id", "th", "template", "island").agg(
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.min(F.col("diagonal") + F.array_min("hits")).alias("first_word"),
        F.max(F.col("diagonal") + F.array_max("hits") + k).alias("end_word"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda t: F.sequence(t, t + k - 1)))))
    return merged.join(F.broadcast(sizes), "template").withColumn("cover", covered / F.col("size")).where(F.col("cover") >= min_cover).select("doc_id", "th", "label", "first_word", "end_word", "cover")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **method) -> DataFrame:
    """One row per document: words, base places and labels, all labels, score."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    found = spans(docs, **method).groupBy("doc_id", "th").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover")).withColumnsRenamed({"doc_id": "found_id", "th": "found_th"})
    rows = base(docs).join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("th") == F.col("found_th")), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("cover", F.lit(0.0)))).alias("score"),
    )


_VALUES = ", ".join(f"({t}, '{label}', '{text}')" for t, (label, text) in enumerate(TEMPLATES))
_PHRASES = ", ".join(f"('{label}', {text.split()!r})" for text, label in BASE)
#: DuckDB SQL for scan's rows, over distinct ids that are not null.
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t(template, label, text) AS (VALUES {_VALUES}), tw AS (SELECT template, label, string_split(text, ' ') AS ws FROM t),
tg AS (SELECT template, tpos, array_to_string(ws[tpos + 1:tpos + {K}], ' ') AS gram FROM (SELECT *, unnest(range(0, len(ws) - {K - 1})) AS tpos FROM tw)),
g AS (SELECT doc_id, pos, array_to_string(ws[pos + 1:pos + {K}], ' ') AS gram FROM (SELECT *, unnest(range(0, len(ws) - {K - 1})) AS pos FROM d)),
votes AS (SELECT DISTINCT doc_id, template, pos - tpos AS diagonal, tpos FROM g JOIN tg USING (gram)),
steps AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER w > {MAX_GAP}, false) AS new FROM (SELECT DISTINCT doc_id, template, diagonal FROM votes) WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
islands AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM steps),
covered AS (SELECT v.doc_id, v.template, island, count(DISTINCT tpos + k) AS n FROM votes v JOIN islands USING (doc_id, template, diagonal), range({K}) AS r(k) GROUP BY ALL),
spans AS (SELECT doc_id, label, n / len(ws) AS cover FROM covered JOIN tw USING (template) WHERE n / len(ws) >= {MIN_COVER}),
p(label, phrase) AS (VALUES {_PHRASES}),
places AS (SELECT doc_id, label, pos FROM (SELECT doc_id, label, ws, phrase, unnest(range(0, len(ws) - len(phrase) + 1)) AS pos FROM d, p) WHERE ws[pos + 1:pos + len(phrase)] = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM spans) GROUP BY doc_id),
best AS (SELECT doc_id, max(cover) AS cover FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE least(1.0, coalesce(cover, 0.0)) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""
