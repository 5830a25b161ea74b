"""License scans with a positional rare-token index, with DataFrame functions only.

Templates are the phrases that name a license and clauses of its text, each with mandatory key phrases. The index has a posting
(word, template, place) for the words of a template's key phrases that are rarest over all files. A file's words are joined to the postings: those of
highest IDF that it has say where a template would have to start, and a start on which all postings of the template agree is a
candidate. Each is confirmed by the key phrases, word by word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.llm.common import BROADCAST_ROWS, Scratch, table
from boxtrail.llm.op3_winnowing import words_of

#: Fixed values: (label, whether the label is one of the base ones, the template's words, its mandatory key phrases).
TEMPLATES = (
    ("mit", True, "mit license", ("mit license",)),
    ("apache", True, "apache license", ("apache license",)),
    ("gpl", True, "general public license", ("general public license",)),
    (
        "mit",
        False,
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "obtaining a copy of this software"),
    ),
    (
        "mit",
        False,
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        ("this permission notice shall be included", "substantial portions of the software"),
    ),
    ("mit", False, "the software is provided as is without warranty of any kind express or implied", ("the software is provided as is", "without warranty of any kind")),
    ("apache", False, "licensed under the apache license version 2 0", ("licensed under the apache license",)),
    ("apache", False, "you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    (
        "apache",
        False,
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        ("required by applicable law or agreed to in writing", "distributed on an as is basis"),
    ),
    (
        "bsd",
        False,
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "the following conditions are met"),
    ),
    ("bsd", False, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain",)),
    ("bsd", False, "redistributions in binary form must reproduce the above copyright notice", ("redistributions in binary form must reproduce",)),
    ("bsd", False, "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", ("nor the names of its contributors", "endorse or promote products")),
    (
        "isc",
        False,
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted"),
    ),
    ("zlib", False, "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ("origin of this software must not be misrepresented",)),
    ("gpl", False, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("redistribute it and or modify it", "terms of the gnu general public license")),
    ("gpl", False, "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", ("without even the implied warranty", "see the gnu general public license")),
    ("lgpl", False, "gnu lesser general public license", ("lesser general public license",)),
    ("lgpl", False, "gnu library general public license", ("library general public license",)),
    ("agpl", False, "gnu affero general public license", ("affero general public license",)),
    ("mpl", False, "mozilla public license", ("mozilla public license",)),
    ("mpl", False, "this source code form is subject to the terms of the mozilla public license", ("this source code form is subject to the terms",)),
    ("epl", False, "eclipse public license", ("eclipse public license",)),
    ("eupl", False, "european union public licence", ("european union public licence",)),
    ("boost", False, "boost software license version 1 0", ("boost software license",)),
    ("unlicense", False, "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("wtfpl", False, "do what the fuck you want to public license", ("what the fuck you want to public license",)),
    ("cc", False, "creative commons attribution", ("creative commons attribution",)),
    ("cc0", False, "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("waived all copyright and related or neighboring rights",)),
    ("proprietary", False, "all rights reserved", ("all rights reserved",)),
)
RARE = 4  # postings of a template, at most


def key_places(template: int) -> list[tuple[int, list[str]]]:
    """(place in the template, words) of each key phrase."""
    _, _, text, keys = TEMPLATES[template]
    words = text.split()
    return [(next(i for i in range(len(words)) if words[i : i + len(k)] == k), k) for k in (key.split() for key in keys)]


def key_words(template: int) -> dict[str, int]:
    """The words of a template's key phrases, each with the first place in the template at which a key phrase has it."""
    found = {}
    for at, key in key_places(template):
        for i, word in enumerate(key):
            found.setdefault(word, at + i)
    return found


def document_frequencies(rows: DataFrame) -> dict[str, int]:
    """In how many rows each license word occurs, over all rows; as many numbers as the templates have words."""
    vocab = F.lit(sorted({w for t in range(len(TEMPLATES)) for w in key_words(t)}))
    found = rows.select(F.explode(F.array_intersect("words", vocab)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return {r["word"]: r["n"] for r in found.collect()}


def postings(frequency: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(word, template, place, bit, all bits) of the rarest key words of each template; ties go to the word that stands first."""
    out = []
    for t in range(len(TEMPLATES)):
        rare = sorted(key_words(t).items(), key=lambda x: (frequency.get(x[0], 0), x[1]))[:RARE]
        out += [(word, t, at, 1 << i, (1 << len(rare)) - 1) for i, (word, at) in enumerate(rare)]
    return out


def candidates(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(template, start) on which all postings of the template agree, in a list for each (doc_id, text_hash) that has any."""
    # outer, as else Spark would split every text once more, in a filter for empty ones before
    tokens = rows.select("doc_id", "text_hash", F.posexplode_outer("words").alias("pos", "word"))
    votes = tokens.join(F.broadcast(index), "word").groupBy("doc_id", "text_hash", "template", (F.col("pos") - F.col("at")).alias("start"), "full").agg(F.bit_or("bit").alias("bits"))
    return votes.where("bits = full").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("template", "start")).alias("starts"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    docs needs doc_id and text; other columns are ignored. A template stands where all its key phrases stand at their places, words between them
    may differ. n_base counts the places of base phrases, first_word and last_word are the least and greatest word (from 0) at which one starts, null if
    there is none. labels has the labels of all templates that stand somewhere, base_labels those of base phrases. score: the share of the templates of the found labels that
    stand somewhere, 0 without a label. A null or empty text has no words; repeated rows get the same result, rows that share an id are told apart by
    their text; an empty table gives no rows.

    The index has at most RARE postings for each template and is broadcast. Files are read three times: for the frequencies, of which the driver gets one number for each
    license word; for the votes, which are shuffled; and to confirm candidates, which are broadcast while they are few and else joined by a shuffle. Work
    is in proportion to a text's length.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words_of("text").alias("words"))
    index = spark.createDataFrame(postings(document_frequencies(rows)), "word string, template int, at int, bit int, full int")
    found = scratch.save(candidates(rows, index), "candidates").toDF("its_id", "its_hash", "starts")
    size = found.agg(F.coalesce(F.sum(F.size("starts") + 3), F.lit(0))).first()[0]
    found = F.broadcast(found) if size <= BROADCAST_ROWS else found
    rows = rows.join(found, rows.doc_id.eqNullSafe(F.col("its_id")) & (F.col("text_hash") == F.col("its_hash")), "left")

    keys = F.array(*[F.array(*[F.struct(F.lit(at).alias("at"), F.lit(key).alias("words")) for at, key in key_places(t)]) for t in range(len(TEMPLATES))])
    label, base = F.lit([x[0] for x in TEMPLATES]), F.lit([x[1] for x in TEMPLATES])
    of_label = F.create_map(*[F.lit(v) for x in sorted({t[0] for t in TEMPLATES}) for v in (x, sum(t[0] == x for t in TEMPLATES))])

    def stands(c):
        place = lambda k: c["start"] + k["at"]
        return F.forall(F.get(keys, c["template"]), lambda k: (place(k) >= 0) & (F.slice("words", F.greatest(place(k), F.lit(0)) + 1, F.size(k["words"])) == k["words"]))

    named = lambda places: F.array_sort(F.array_distinct(F.transform(places, lambda c: F.get(label, c["template"]))))
    none = F.array().cast("array<struct<template:int,start:int>>")
    rows = rows.withColumn("places", F.coalesce(F.filter("starts", stands), none))
    rows = rows.withColumn("bases", F.filter("places", lambda c: F.get(base, c["template"])))
    rows = rows.withColumns({"labels": named("places"), "base_starts": F.transform("bases", lambda c: c["start"])})
    confirmed = F.size(F.array_distinct(F.transform("places", lambda c: c["template"])))
    of_found = F.aggregate("labels", F.lit(0), lambda n, x: n + F.element_at(of_label, x))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("bases").cast("long").alias("n_base"),
        F.array_min("base_starts").cast("long").alias("first_word"),
        F.array_max("base_starts").cast("long").alias("last_word"),
        F.array_join(named("bases"), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        F.round(F.coalesce(F.try_divide(confirmed.cast("double"), of_found.cast("double")), F.lit(0.0)), 6).alias("score"),
    )


def op10_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _values() -> str:
    return ", ".join(f"({t}, '{label}', {base}, '{text}', '{key}')" for t, (label, base, text, keys) in enumerate(TEMPLATES) for key in keys)


#: The same rows by looking for every key phrase at every place of every document, without an index.
OP10_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(id, label, base, body, phrase) AS (VALUES {_values()}),
k AS (SELECT *, len(string_split(phrase, ' ')) AS n, len(string_split(split_part(' ' || body || ' ', ' ' || phrase || ' ', 1), ' ')) - 1 AS place FROM t),
word AS (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d),
hit AS (SELECT r, id, phrase, i - 1 - place AS s FROM word JOIN k ON w[i] = split_part(phrase, ' ', 1) AND array_to_string(w[i:i + n - 1], ' ') = phrase),
stands AS (SELECT r, id, s FROM hit GROUP BY r, id, s HAVING count(DISTINCT phrase) = (SELECT count(*) FROM k WHERE k.id = hit.id)),
kind AS (SELECT id, any_value(label) AS label, any_value(base) AS base FROM t GROUP BY id),
bases AS (SELECT r, count(*) AS n, min(s) AS lo, max(s) AS hi FROM stands JOIN kind USING (id) WHERE base GROUP BY r),
labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, count(DISTINCT id) AS confirmed FROM stands JOIN kind USING (id) GROUP BY r),
whole AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, label FROM stands JOIN kind USING (id)) JOIN kind USING (label) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(bases.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, round(coalesce(confirmed / whole.n, 0), 6)::DOUBLE AS score
FROM d LEFT JOIN bases USING (r) LEFT JOIN labels USING (r) LEFT JOIN whole USING (r)
"""
