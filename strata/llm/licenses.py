"""License scan by diagonal voting, in DataFrame operations only.

All rolling GRAM-word hashes of all texts are joined with the places of the same hashes in license templates. A match votes
for the diagonal (place in the text minus place in the template); diagonals of one template that lie within SLACK words of
each other are merged, so that inserted or missing words do not split a notice; a merged diagonal is a span of that license if
enough of the template's grams stand on it. Base phrases are found by themselves and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
GRAM = 3
SLACK = 2
COVERED = 0.6
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
KELVIN = "\u212a"  # the one character beyond ASCII that lower-casing makes an ASCII letter
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Notices as licenses ask for them, and their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
)


def template_grams() -> list[tuple[int, str, int, int, str]]:
    """(template, label, place, grams of the template, gram)."""
    out = []
    for number, (label, text) in enumerate(TEMPLATES):
        words = text.split()
        n = len(words) - GRAM + 1
        out += [(number, label, i, n, " ".join(words[i : i + GRAM])) for i in range(n)]
    return out


def _hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _words(text: Column) -> Column:
    lower = F.when(F.contains(text, F.lit(KELVIN)), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(F.coalesce(lower, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def _phrase_places(words: Column, ends: Column, phrase: str, label: str) -> Column:
    """(label, place) wherever the phrase's words stand up to one of the places in `ends`."""
    parts = phrase.split()
    back = len(parts) - 1

    def stands(end: Column) -> Column:
        same = F.lit(True)
        for k, word in enumerate(parts):
            same = same & F.coalesce(F.when(end + k >= back, F.get(words, end + k - back) == word), F.lit(False))
        return same

    return F.transform(F.filter(ends, stands), lambda end: F.struct(F.lit(label).alias("label"), (end - back).cast("long").alias("place")))


def _base_places(text: Column) -> Column:
    """(label, place) of base phrases; a text without the word that ends all phrases is not cut into words."""

    def places(words: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: F.get(words, i) == "license")
        found = [_phrase_places(words, ends, phrase, label) for phrase, label in PHRASES]
        return F.concat(*found)

    none = F.array().cast("array<struct<label: string, place: long>>")
    once = F.get(F.transform(F.array(_words(text)), places), F.lit(0))  # a lambda's variable, so that a text is cut only once
    return F.when(F.contains(F.lower(text), F.lit("license")), once).otherwise(none)


def license_spans(docs: DataFrame) -> DataFrame:
    """(doc_key, text_key, label, first, last, coverage): verified spans, word places from 0, last included.

    Templates are fixed values, a few hundred grams, so every task can have them.
    """
    spark = docs.sparkSession
    rows = spark.createDataFrame(template_grams(), "template int, label string, at int, grams int, gram string")
    rows = rows.withColumn("hash", _hash([F.split_part("gram", F.lit(" "), F.lit(k + 1)) for k in range(GRAM)])).drop("gram")
    words = docs.select(C("doc_id").alias("doc_key"), F.xxhash64("text").alias("text_key"), _words(C("text")).alias("w"))
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - GRAM), lambda i: _hash([F.get("w", i + k) for k in range(GRAM)]))
    grams = words.select("doc_key", "text_key", F.posexplode(F.when(F.size("w") >= GRAM, hashes)).alias("place", "hash"))
    key = ["doc_key", "text_key", "template", "label", "grams"]
    votes = grams.join(F.broadcast(rows), "hash").select(*key, "place", "at", (C("place") - C("at")).alias("diagonal")).distinct()
    diagonals = votes.groupBy(*key, "diagonal").agg(F.collect_set("at").alias("ats"), F.min("place").alias("first"), F.max("place").alias("last"))
    along = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.coalesce((C("diagonal") - F.lag("diagonal").over(along) > SLACK).cast("int"), F.lit(0))
    merged = diagonals.withColumn("apart", apart).withColumn("run", F.sum("apart").over(along)).groupBy(*key, "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n"), F.min("first").alias("first"), (F.max("last") + GRAM - 1).alias("last")
    )
    return merged.withColumn("coverage", C("n") / C("grams")).filter(C("coverage") >= COVERED).select("doc_key", "text_key", "label", "first", "last", "coverage")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (label and place of each base phrase), spans (label, first, last, coverage), for each row of `docs`.

    Texts are lower-cased (A-Z); words are runs of a-z, digits and all beyond ASCII, counted from 0. Null and empty texts have
    no words. Rows with equal id (null is one id) and equal text get equal answers, so repeated rows do not add votes.
    Texts may be of any length; other columns of `docs` are ignored; no rows give no rows.
    """
    spans = license_spans(docs).groupBy("doc_key", "text_key").agg(F.sort_array(F.collect_list(F.struct("first", "last", "label", "coverage"))).alias("spans"))
    n = F.coalesce(F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), n.alias("n_words"), _base_places(F.coalesce("text", F.lit(""))).alias("base"))
    none = F.array().cast("array<struct<first: int, last: int, label: string, coverage: double>>")
    met = rows.join(spans.withColumnRenamed("text_key", "k"), C("doc_id").eqNullSafe(C("doc_key")) & (C("text_key") == C("k")), "left")
    return met.select("doc_id", "n_words", "base", F.coalesce("spans", none).alias("spans"))


def license_digest(docs: DataFrame) -> DataFrame:
    found = scan_licenses(docs)
    base = F.array_distinct("base.label")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.place").alias("first_word"), F.array_max("base.place").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, C("spans.label")))), ",").alias("labels"),
        F.coalesce(F.array_max("spans.coverage"), F.lit(0.0)).alias("score"),
    )


def digest_sql() -> str:
    """The digest in SQL."""
    values = ", ".join(f"({t}, '{label}', {at}, {n}, '{gram}')" for t, label, at, n, gram in template_grams())
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t(template, label, tpos, grams, gram) AS (VALUES {values}),
phrase(p, label, k) AS (VALUES {phrases}),
place AS (SELECT doc_id, i - 1 AS place, ws[i] AS a, ws[i:i + 1] AS ab, ws[i:i + 2] AS abc FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
base AS (SELECT doc_id, place, label FROM place JOIN phrase ON (k = 2 AND array_to_string(ab, ' ') = p) OR (k = 3 AND array_to_string(abc, ' ') = p)),
bases AS (SELECT doc_id, count(*) AS n, min(place) AS f, max(place) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id),
vote AS (SELECT doc_id, template, label, grams, place, tpos, place - tpos AS diagonal FROM (SELECT * FROM place WHERE len(abc) = 3) JOIN t ON array_to_string(abc, ' ') = gram),
step AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {SLACK} THEN 1 ELSE 0 END AS apart
         FROM (SELECT DISTINCT doc_id, template, diagonal FROM vote)),
run AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM step),
span AS (SELECT doc_id, template, label, count(DISTINCT tpos) / CAST(grams AS DOUBLE) AS coverage FROM vote JOIN run USING (doc_id, template, diagonal)
         GROUP BY doc_id, template, label, grams, run HAVING count(DISTINCT tpos) / CAST(grams AS DOUBLE) >= CAST({COVERED} AS DOUBLE)),
label_ AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM span) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(x.labels, '') AS labels, coalesce(s.coverage, CAST(0 AS DOUBLE)) AS score
FROM d LEFT JOIN bases b USING (doc_id) LEFT JOIN label_ x USING (doc_id) LEFT JOIN (SELECT doc_id, max(coverage) AS coverage FROM span GROUP BY doc_id) s USING (doc_id)"""
