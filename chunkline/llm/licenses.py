"""License scans by diagonal voting. DataFrame functions only.

The rolling hashes of all runs of ``size`` words of a text are joined with those of the license templates. A hit at word
d of the text and word t of the template votes for the diagonal d - t, the place where the template would begin. Votes
are counted by diagonal; neighbouring diagonals (words put in or left out shift the rest) are merged into one span; a span
is verified by the words of the template that stand in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkline.llm.common import staged
from chunkline.llm.decontaminate import with_windows

#: Phrases whose words in a row make a base label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Passages of public licenses and usual notices. (label, passage)
PASSAGES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "released under the mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("all-rights", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: all of ASCII but digits and small letters (and capitals, before they are lower-cased).
BETWEEN, WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SIZE, SLACK, COVERED = 3, 6, 0.8


def words_of(text: Column) -> Column:
    """The words of a text with A-Z in lower case."""
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def templates(spark: SparkSession, size: int, base: dict[str, str], passages: list[tuple[str, str]]) -> DataFrame:
    """(tid, label, is_base, m, grams, tpos, h, gram): the runs of the templates, a table that only the lists above make."""
    rows = [(i, label, is_base, text.split(" ")) for i, (is_base, label, text) in enumerate([(True, b, a) for a, b in base.items()] + [(False, a, b) for a, b in passages])]
    if short := [" ".join(r[3]) for r in rows if len(r[3]) < size]:
        raise ValueError(f"shorter than {size} words: {short}")
    t = spark.createDataFrame(rows, "tid int, label string, is_base boolean, toks array<string>").withColumn("m", F.size("toks"))
    t = with_windows(t, lambda w: w, size).select("tid", "label", "is_base", "m", "toks", F.posexplode("w").alias("tpos", "h"))
    return t.select("tid", "label", "is_base", "m", (F.col("m") - (size - 1)).alias("grams"), "tpos", "h", F.slice("toks", F.col("tpos") + 1, size).alias("gram"))


def diagonals(docs: DataFrame, *, size: int, base: dict[str, str], passages: list[tuple[str, str]]) -> DataFrame:
    """(row, tid, label, is_base, m, grams, diag, ts): the template's runs that a diagonal of a text has. ``docs``: (row, text)."""
    rows = with_windows(docs.select("row", words_of(F.coalesce("text", F.lit(""))).alias("toks")), lambda w: w, size)
    places = rows.select("row", "toks", F.posexplode_outer("w").alias("dpos", "h"))
    found = places.join(F.broadcast(templates(docs.sparkSession, size, base, passages)), "h")
    # equal hashes are checked by the words themselves
    found = found.where(F.slice("toks", F.col("dpos") + 1, size) == F.col("gram"))
    votes = found.groupBy("row", "tid", "label", "is_base", "m", "grams", (F.col("dpos") - F.col("tpos")).alias("diag"))
    return votes.agg(F.collect_set("tpos").alias("ts"))


def spans(diags: DataFrame, *, size: int, slack: int) -> DataFrame:
    """(row, label, start, end, score): neighbouring diagonals of a template merged; score is the share of its words there."""
    of = ["row", "tid", "label", "m"]
    by_place = Window.partitionBy(*of).orderBy("diag")
    d = diags.withColumn("new", F.coalesce(F.col("diag") - F.lag("diag").over(by_place) > slack, F.lit(True)).cast("int"))
    d = d.withColumn("span", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.min(F.col("diag") + F.array_min("ts")), F.max(F.col("diag") + F.array_max("ts") + size)
    d = d.groupBy(*of, "span").agg(F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"), first.alias("start"), last.alias("end"))
    words = F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + (size - 1)))))
    return d.select("row", "label", "start", "end", (F.size(words) / F.col("m")).alias("score"))


def scan_licenses(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, slack: int = SLACK, covered: float = COVERED, base: dict[str, str] = BASE, passages: list[tuple[str, str]] = PASSAGES
) -> tuple[DataFrame, DataFrame]:
    """((id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row, (id_col, label, start, end, score) of the spans).

    ``labels`` adds those of templates of which a span has ``covered`` of the words; ``score`` is the largest such share, 0
    without any run of a template. Null and empty texts have no words. Repeated rows have the same result; rows of one
    id and several texts are scanned one by one, and their spans carry the id. A null id comes back as null. Empty tables
    give empty tables. Other columns are ignored, whatever their names.
    """
    text = F.col(text_col)
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("sig")).alias("row"), text.alias("text"))
    diags = staged(diagonals(rows, size=size, base=base, passages=passages), "license-diagonals")
    exact = diags.where(F.col("is_base") & (F.size("ts") == F.col("grams")))
    places = exact.groupBy("row").agg(F.count("*").alias("n_base"), F.min("diag").cast("long").alias("first_word"), F.max("diag").cast("long").alias("last_word"), F.collect_set("label").alias("base"))
    whole = spans(diags, size=size, slack=slack)
    named = whole.groupBy("row").agg(F.collect_set(F.when(F.col("score") >= covered, F.col("label"))).alias("more"), F.max("score").alias("score"))
    none = F.array().cast("array<string>")
    out = rows.select("row", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    out = out.join(named.join(places, "row", "left"), "row", "left")
    joined = lambda *a: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.coalesce(x, none) for x in a]))), ",")
    result = out.select(
        F.col("row.id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", joined("base").alias("base_labels"),
        joined("base", "more").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    return result, whole.select(F.col("row.id").alias(id_col), "label", "start", "end", "score")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))[0]


_ROWS = ", ".join(f"({i}, '{label}', {b}, '{text}')" for i, (b, label, text) in enumerate([("true", b, a) for a, b in BASE.items()] + [("false", a, b) for a, b in PASSAGES]))
OP12_SQL = rf"""
WITH t AS (SELECT tid, label, is_base, string_split(p, ' ') AS w FROM (VALUES {_ROWS}) v(tid, label, is_base, p)),
tg AS (SELECT tid, label, is_base, len(w) AS m, i AS tpos, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT *, unnest(range(len(w) - 2)) AS i FROM t)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT doc_id, i AS dpos, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT *, unnest(range(len(w) - 2)) AS i FROM d)),
diag AS (SELECT doc_id, tid, label, is_base, m, dpos - tpos AS place, list(DISTINCT tpos) AS ts FROM dg JOIN tg USING (g) GROUP BY ALL),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS b FROM diag WHERE is_base AND len(ts) = m - 2 GROUP BY doc_id),
steps AS (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY doc_id, tid ORDER BY place) <= {SLACK} THEN 0 ELSE 1 END AS new FROM diag),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, tid ORDER BY place) AS span FROM steps),
words AS (SELECT doc_id, tid, label, m, span, unnest(ts) + k AS word FROM numbered, range(3) r(k)),
span AS (SELECT doc_id, label, count(DISTINCT word) / m AS score FROM words GROUP BY doc_id, tid, label, m, span),
named AS (SELECT doc_id, list(DISTINCT label) FILTER (score >= {COVERED}) AS b, max(score) AS score FROM span GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.b), ','), '') AS base_labels, array_to_string(list_sort(list_distinct(coalesce(base.b, []) || coalesce(named.b, []))), ',') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id)"""
