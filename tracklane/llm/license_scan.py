"""License scans: phrases, and an exact set-similarity join of text blocks with notices.

A block is ``BLOCK`` consecutive words of a text; blocks start every ``STEP`` words, so
that any ``STEP`` consecutive words lie whole in one block. A notice is found in a block when at
least ``CONTAINMENT`` of its distinct words stand there, in any order.

The join: the words of the notices are ordered by how many documents hold them, rarest
first. A block that meets the threshold holds one of the first ``n - need + 1`` words of
the notice (prefix filter), has ``need`` distinct words (length filter), and has enough
words left behind the shared one in that order (positional filter). What passes
is verified. The order only decides how much is verified, never what is found.

The notices are a parameter, broadcast: a list written by people. Everything is
DataFrame functions; a text is cut into blocks only if it holds a prefix word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm.common import table, text_of

BLOCK, STEP = 48, 24
CONTAINMENT = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of a text in lower case
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# label, notice
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "free software you can redistribute it and modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("all-rights", "copyright all rights reserved no part may be reproduced without permission"),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def document_frequency(texts: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """In how many texts each word of a short list occurs, over all texts."""
    found = F.array_intersect(F.split(F.lower(text_of(text)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(vocabulary))
    rows = texts.select(F.explode(found).alias("word")).groupBy("word").count().collect()  # as many rows as words
    return {word: 0 for word in vocabulary} | {r["word"]: r["count"] for r in rows}


def prefix_index(frequency: dict[str, int], notices: list[tuple[str, str]], containment: float) -> list[tuple]:
    """(word, position, notice, label, ordered words, need) for the prefix words of each notice."""
    order = {w: i for i, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
    rows = []
    for k, (label, notice) in enumerate(notices):
        words = sorted(set(notice.split()), key=order.__getitem__)
        need = math.ceil(round(containment * len(words), 9))
        rows += [(w, i, k, label, words, need) for i, w in enumerate(words[: len(words) - need + 1])]
    return rows


def notice_blocks(
    docs: DataFrame, keys: list[str], text: str = "text", notices=NOTICES, containment: float = CONTAINMENT
) -> DataFrame:
    """Every (block, notice) at or above the threshold: keys, block, notice, label, containment."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, notice in notices for w in notice.split()})
    frequency = document_frequency(docs, vocabulary, text)
    rank = sorted(vocabulary, key=lambda w: (frequency[w], w))
    rows = prefix_index(frequency, notices, containment)
    index = spark.createDataFrame(rows, "word string, place int, notice int, label string, tokens array<string>, need int")
    prefix = "|".join(sorted({r[0] for r in rows}))
    held = docs.filter(text_of(text).rlike(rf"(?i)(?<![0-9a-z\x{{80}}-\x{{10FFFF}}])({prefix})(?![0-9a-z\x{{80}}-\x{{10FFFF}}])"))
    words = held.select(*keys, words_of(text_of(text)).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("words") - BLOCK) / STEP), F.lit(0)).cast("int"))
    blocks = words.filter(F.size("words") > 0).select(
        *keys, F.posexplode(F.transform(starts, lambda i: F.slice("words", i * STEP + 1, BLOCK))).alias("block", "words")
    )
    # the distinct words of the block that occur in a notice, in the global order
    blocks = blocks.select(
        *keys, "block", F.size(F.array_distinct("words")).alias("n"), F.array_intersect(F.lit(rank), "words").alias("ordered")
    )
    tokens = blocks.select(*keys, "block", "n", "ordered", F.posexplode("ordered").alias("at", "word"))
    left = F.least(F.size("tokens") - F.col("place"), F.size("ordered") - F.col("at"))
    first_shared = F.array_position("ordered", F.array_intersect("tokens", "ordered")[0]) == F.col("at") + 1
    overlap = F.size(F.array_intersect("tokens", "ordered"))
    return (
        tokens.join(F.broadcast(index), "word")
        .filter((F.col("n") >= F.col("need")) & (left >= F.col("need")) & first_shared)
        .filter(overlap >= F.col("need"))
        .select(*keys, "block", "notice", "label", (overlap / F.size("tokens")).alias("containment"))
    )


def phrase_places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand one after another, counted from 0."""
    parts = phrase.split()
    last = F.size(words) - len(parts)
    stands = lambda i: F.forall(
        F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(parts)]),
        lambda p: F.get(words, i + p["k"]) == p["w"],
    )
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), stands)).otherwise(F.array().cast("array<int>"))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: words, phrase places, labels of phrases and of notices.

    A null text is empty: no word, no label, score 0. A null key stays null. Rows that
    repeat key and text get equal results. ``score`` is the largest containment of a
    notice, 1 where a phrase stands.
    """
    docs = docs.select(F.col(key).alias("key"), text_of(text).alias("text")).withColumn("digest", F.xxhash64("text"))
    words = words_of(F.col("text"))
    held = F.col("text").rlike("(?i)license")
    n_words = F.regexp_count("text", F.lit(ANY_CASE_WORD)).cast("long").alias("n_words")
    base = docs.select("key", "digest", n_words, F.when(held, words).alias("words")).select(
        "key",
        "digest",
        "n_words",
        *[F.when(F.col("words").isNotNull(), phrase_places(F.col("words"), p)).alias(label) for p, label in PHRASES.items()],
    )
    none = F.array().cast("array<int>")
    places = F.concat(*[F.coalesce(F.col(label), none) for label in PHRASES.values()])
    labels = F.array_compact(F.array(*[F.when(F.size(F.col(x)) > 0, F.lit(x)) for x in PHRASES.values()]))
    base = base.select("key", "digest", "n_words", places.alias("places"), labels.alias("base"))
    found = (
        notice_blocks(docs, ["key", "digest"])
        .groupBy("key", "digest")
        .agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
        .withColumnsRenamed({"key": "_key", "digest": "_digest"})
    )
    joined = base.join(found, F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest")), "left")
    everything = F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))
    return joined.select(
        F.col("key").alias(key),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(everything), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_license_scan": op3_license_scan}


def _sql() -> str:
    notices = ",\n    ".join(f"({k}, '{label}', {sorted(set(n.split()))!r})" for k, (label, n) in enumerate(NOTICES))
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), notices(k, label, t) AS (VALUES
    {notices}
), places AS (
  SELECT doc_id, i - 1 AS place,
         CASE WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN 'mit'
              WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN 'apache'
              WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END AS label
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license'))
), base AS (
  SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS z, list(DISTINCT label) AS labels
  FROM places WHERE label IS NOT NULL GROUP BY doc_id
), blocks AS (
  SELECT doc_id, list_distinct(w[b * {STEP} + 1:b * {STEP} + {BLOCK}]) AS w
  FROM (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - {BLOCK}) / {STEP}), 0)::BIGINT + 1)) AS b FROM d WHERE len(w) > 0)
), found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS best
  FROM (SELECT doc_id, label, len(list_intersect(t, w)) / len(t) AS c, len(list_intersect(t, w)) AS n, len(t) AS size
        FROM blocks, notices WHERE list_has_any(w, t))
  WHERE n >= ceil(round({CONTAINMENT} * size, 9)) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""


SQL = {"op3_license_scan": _sql()}
