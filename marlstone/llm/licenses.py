"""License scan by diagonal voting, with built-in functions only.

All rolling k-gram hashes of all texts are joined with the positions of the license templates. A
hit at word p of a text and word t of a template votes for the diagonal p - t. Votes are summed by
diagonal, neighbouring diagonals (small insertions or deletions) are merged, and what has enough
votes is verified word by word against the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import count_alnum_words, few_files, table, text_or_empty, written
from marlstone.llm.windows import row_keys, with_window_hashes, words_of

K = 3

# Phrases and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Passages of public licenses.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution ShareAlike 4.0 International License"),
)


def template_grams(spark: SparkSession, templates, k: int = K) -> DataFrame:
    """(template, at, hash, gram, grams): all k-grams of the templates; a bounded, fixed table."""
    rows = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(templates)], "template int, text string")
    hashed = with_window_hashes(rows.withColumn("__w", words_of(F.col("text"))), "__w", {k: "__x"})
    placed = hashed.select("template", "__w", F.size("__x").alias("grams"), F.posexplode_outer("__x").alias("at", "hash"))
    return placed.select("template", "at", "hash", "grams", F.array_join(F.slice("__w", F.col("at") + 1, F.lit(k)), " ").alias("gram"))


def find_spans(docs: DataFrame, templates, exact: int, text: str, keys: tuple[Column, Column], k: int = K, reach: int = 3, least_share: float = 0.6) -> DataFrame:
    """(k1, k2, template, first, last, share): verified spans of templates in the texts.

    The first ``exact`` templates must be met word for word on a single diagonal; for the others,
    diagonals at most ``reach`` apart are merged and at least ``least_share`` of the template's
    k-grams must stand in the span. Votes go by hash; a span is verified by the words of its grams,
    which the scan writes beside each vote.
    """
    grams = F.broadcast(template_grams(docs.sparkSession, templates, k))  # fixed size
    keyed = docs.select(keys[0].alias("k1"), keys[1].alias("k2"), words_of(F.col(text)).alias("__w"))
    hashed = with_window_hashes(keyed, "__w", {k: "__x"})
    votes = hashed.select("k1", "k2", "__w", F.posexplode_outer("__x").alias("start", "hash")).join(grams, "hash")
    same = F.array_join(F.slice("__w", F.col("start") + 1, F.lit(k)), " ") == F.col("gram")
    hits = written(votes.select("k1", "k2", "template", "grams", "at", (F.col("start") - F.col("at")).alias("diagonal"), same.alias("same")), "votes", small=True)
    # Equal rows have equal keys: sets count their votes once.
    tally = hits.groupBy("k1", "k2", "template", "grams", "diagonal").agg(
        F.collect_set("at").alias("ats"), F.collect_set(F.when(F.col("same"), F.col("at"))).alias("met")
    )
    along = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along), F.lit(reach + 1)) > F.when(F.col("template") < exact, 0).otherwise(reach)
    islands = (
        tally.withColumn("__new", apart.cast("int"))
        .withColumn("__island", F.sum("__new").over(along))
        .groupBy("k1", "k2", "template", "grams", "__island")
        .agg(
            F.flatten(F.collect_list("ats")).alias("ats"),
            F.flatten(F.collect_list("met")).alias("met"),
            F.min(F.col("diagonal") + F.array_min("met")).alias("first"),
            F.max(F.col("diagonal") + F.array_max("met") + (k - 1)).alias("last"),
        )
    )
    needed = F.when(F.col("template") < exact, F.col("grams")).otherwise(F.col("grams") * least_share)
    voted = islands.filter(F.size(F.array_distinct("ats")) >= needed)
    verified = voted.withColumn("__met", F.size(F.array_distinct("met"))).filter(F.col("__met") >= needed)
    return verified.select("k1", "k2", "template", F.col("first").cast("long"), F.col("last").cast("long"), (F.col("__met") / F.col("grams")).alias("share"))


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and license spans.

    Phrases have at least ``K`` words. Null texts have no words and no labels. Rows equal in key and
    text get equal results; columns with the names of the results are replaced.
    """
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "license_spans")
    docs = docs.drop(*names)
    spark = docs.sparkSession
    every = [*phrases, *templates]
    keys = row_keys(F.col(key), F.col(text))
    spans = find_spans(docs, every, len(phrases), text, keys)
    label = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(every)], "template int, label string")
    base = F.col("template") < len(phrases)
    per_row = written(
        spans.join(F.broadcast(label), "template")
        .groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("first"))).alias("first_word"),
            F.max(F.when(base, F.col("first"))).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("share").alias("score"),
            F.array_sort(F.collect_list(F.struct("first", "last", "label", "share"))).alias("license_spans"),
        ),
        "license-rows", small=True
    )
    counted = docs.withColumn("n_words", count_alnum_words(text_or_empty(text)))
    joined = counted.withColumn("__k1", keys[0]).withColumn("__k2", keys[1]).join(per_row, ["__k1", "__k2"], "left").drop("__k1", "__k2")
    return joined.fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})


def op8_license_diagonals(spark, sf_dir: str) -> DataFrame:
    """License phrases and passages of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return few_files(scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))


def _sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate((*PHRASES, *TEMPLATES)))
    words = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words.format("text")} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3),
g AS (SELECT doc_id, i - 1 AS p, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM p),
t AS (SELECT template, label, {words.format("txt")} AS ws FROM (VALUES {rows}) v(template, label, txt)),
ti AS (SELECT template, ws, len(ws) - 2 AS grams, unnest(range(1, len(ws) - 1)) AS i FROM t),
tg AS (SELECT template, grams, i - 1 AS tpos, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM ti),
hits AS (SELECT DISTINCT doc_id, template, grams, p - tpos AS diagonal, tpos FROM g JOIN tg USING (gram)),
dg AS (SELECT DISTINCT doc_id, template, diagonal FROM hits),
nw AS (SELECT doc_id, template, diagonal, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= CASE WHEN template < {len(PHRASES)} THEN 0 ELSE 3 END THEN 0 ELSE 1 END AS n FROM dg),
isl AS (SELECT doc_id, template, diagonal, sum(n) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM nw),
sp AS (SELECT h.doc_id, h.template, i.island, grams, count(DISTINCT tpos) AS met, min(h.diagonal + tpos) AS begins
  FROM hits h JOIN isl i ON h.doc_id = i.doc_id AND h.template = i.template AND h.diagonal = i.diagonal
  GROUP BY h.doc_id, h.template, i.island, grams HAVING count(DISTINCT tpos) >= CASE WHEN h.template < {len(PHRASES)} THEN grams ELSE grams * 0.6 END),
lab AS (SELECT sp.doc_id, sp.template, begins, CAST(met AS DOUBLE) / grams AS share, label FROM sp JOIN t USING (template)),
base AS (SELECT doc_id, count(*) AS n_base, min(begins) AS first_word, max(begins) AS last_word FROM lab WHERE template < {len(PHRASES)} GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM lab WHERE template < {len(PHRASES)}) GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM lab) GROUP BY doc_id),
sc AS (SELECT doc_id, max(share) AS score FROM lab GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN sc USING (doc_id)
"""


SQL = _sql()
