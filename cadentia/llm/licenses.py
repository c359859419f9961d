"""License scans by diagonal voting.

Every rolling word pair of every text is joined to the places where it stands in
the notice templates. A hit at word ``p`` of the text and word ``t`` of a template
votes for the diagonal ``p - t``. A diagonal that holds all pairs of a template is a
literal occurrence; neighbouring diagonals (words inserted or lost) are merged. A merged span is
verified before it counts: its pairs must follow each other in the template as they do in the text, on at
most ``BAND`` + 1 diagonals, and no template word may stand in two places. Where a span moves to another
diagonal, the pair between the two parts is therefore lost. It is accepted if the best such path shows at
least ``cover`` of the template.

Scale: one pass over the texts, a broadcast join against the template pairs (a
constant of this module, at most 64 words each), and a shuffle of hits only. A hot
template only adds hits to many documents; no group holds more than one document's hits.

Edge cases: null and empty texts have no words and no labels. Repeated rows and equal
or null doc_ids are scanned and returned row by row. Only doc_id and text are read, so other
columns cannot clash. An empty table gives an empty result. The input frame must be
deterministic (a table scan), since rows are told apart by their place in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadentia.llm.text import word_array

# The phrases and labels of the base rule.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Notice sentences by which this module recognises further licences.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("gnu general public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

SENTINEL = -1


def template_pairs(spark: SparkSession, base=BASE, notices=NOTICES) -> DataFrame:
    """``h, ga, gb, template, label, base, tpos, pairs`` per word pair; one extra row marks texts."""
    rows = []
    for number, (phrase, label) in enumerate((*base, *notices)):
        words = phrase.split()
        if not 2 <= len(words) <= 64:
            raise ValueError(f"a template has 2 to 64 words, not {len(words)}: {phrase}")
        for at, (a, b) in enumerate(zip(words, words[1:], strict=False)):
            rows.append((a, b, number, label, number < len(base), at, len(words) - 1))
    rows.append(("", "", SENTINEL, "", False, 0, 1))
    names = ("ga", "gb", "template", "label", "base", "tpos", "pairs")
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])
    hashed = F.when(F.col("template") == SENTINEL, F.lit(0)).otherwise(F.xxhash64("ga", "gb"))
    return spark.range(1).select(F.inline(table)).withColumn("h", hashed)


def diagonals(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """One row per (text, template, diagonal) with hits, and one per text with its word count."""
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.concat(F.array(F.lit("")), word_array(F.col("text"))).alias("w"),
    )
    # Place 0 is an empty word that stands for the text itself.
    grams = texts.select("row", "doc_id", "w", F.posexplode("w").alias("p", "a")).select(
        "row",
        "doc_id",
        "p",
        "a",
        F.get("w", F.col("p") + 1).alias("b"),
        (F.size("w") - 1).alias("n"),
        F.when(F.col("p") == 0, F.lit(0)).otherwise(F.xxhash64("a", F.get("w", F.col("p") + 1))).alias("h"),
    )
    same = ((F.col("template") == SENTINEL) & (F.col("p") == 0)) | (
        (F.col("a") == F.col("ga")) & (F.col("b") == F.col("gb")) & (F.col("p") > 0)
    )
    # The table is a constant of at most a few hundred rows.
    pairs = F.broadcast(template_pairs(docs.sparkSession, base, notices))
    hits = grams.join(pairs, "h").where(same)
    return (
        hits.withColumn("diagonal", F.when(F.col("template") == SENTINEL, 0).otherwise(F.col("p") - 1 - F.col("tpos")))
        .groupBy("row", "doc_id", "template", "diagonal")
        .agg(
            F.expr("bit_or(shiftleft(1L, tpos))").alias("seen"),
            F.min("tpos").alias("lo"),
            F.max("tpos").alias("hi"),
            F.max("pairs").alias("pairs"),
            F.max(F.col("base").cast("int")).alias("base"),
            F.max("n").alias("n_words"),
        )
    )


BAND = 2


def longest_path(seen: list[Column], pairs: Column) -> Column:
    """Most pairs on one way through a template along neighbouring diagonals.

    ``seen`` are the bit sets of the diagonals. A step stays on its diagonal, or moves to another one and passes over a pair:
    two pairs next to each other share a word, which has only one place.
    """
    width = len(seen)
    zeros = F.array(*[F.lit(0)] * width)

    def step(state: Column, place: Column) -> Column:
        now = []
        for k, bits in enumerate(seen):
            moved = [F.get(state["earlier"], F.lit(j)) for j in range(width) if j != k]
            now.append(F.getbit(bits, place).cast("int") + F.greatest(F.get(state["last"], F.lit(k)), *moved))
        return F.struct(F.array(*now).alias("last"), state["last"].alias("earlier"))

    begun = F.struct(zeros.alias("last"), zeros.alias("earlier"))
    return F.aggregate(F.sequence(F.lit(0), pairs - 1), begun, step, lambda s: F.array_max(s["last"]))


def merged(votes: DataFrame) -> DataFrame:
    """Merge diagonals of a template that lie at most ``BAND`` apart into one span of words, and verify it.

    ``coverage`` is the best share of the template on a path that begins at any of the span's diagonals,
    ``start`` and ``end`` are the words of the diagonals it may use.
    """
    along = W.partitionBy("row", "template").orderBy("diagonal")
    starts = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > BAND).cast("int"), F.lit(1))
    literal = F.bit_count("seen") == F.col("pairs")
    ahead = {k: F.lead(F.struct("diagonal", "seen", "hi"), k).over(along) for k in range(1, BAND + 1)}
    near = votes.withColumn("starts", starts).withColumns({f"ahead{k}": row for k, row in ahead.items()})

    def on(k: int, what: str) -> Column:
        """A value of the diagonal ``k`` further on, if it has hits."""
        return F.coalesce(
            *[F.when(F.col(f"ahead{j}.diagonal") == F.col("diagonal") + k, F.col(f"ahead{j}.{what}")) for j in range(1, k + 1)]
        )

    bits = [F.col("seen"), *[F.coalesce(on(k, "seen"), F.lit(0).cast("long")) for k in range(1, BAND + 1)]]
    ends = F.greatest(F.col("diagonal") + F.col("hi"), *[F.col("diagonal") + k + on(k, "hi") for k in range(1, BAND + 1)])
    path = F.struct(
        (longest_path(bits, F.col("pairs")) / F.col("pairs")).alias("coverage"),
        (-F.col("diagonal")).alias("before"),
        (F.col("diagonal") + F.col("lo")).alias("start"),
        (ends + 2).alias("end"),
    )
    return (
        near.withColumn("span", F.sum("starts").over(along.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("path", path)
        .groupBy("row", "doc_id", "template", "span")
        .agg(
            F.max("path").alias("path"),
            F.max("base").alias("base"),
            F.max("n_words").alias("n_words"),
            F.sum(literal.cast("long")).alias("literals"),
            F.min(F.when(literal, F.col("diagonal"))).alias("first"),
            F.max(F.when(literal, F.col("diagonal"))).alias("last"),
        )
        .select("*", "path.coverage", "path.start", "path.end")
    )


def license_spans(docs: DataFrame, cover: float = 0.8, base=BASE, notices=NOTICES) -> DataFrame:
    """``doc_id, label, start, end, coverage`` per accepted span, in words, end exclusive."""
    names = F.array(*[F.lit(label) for _, label in (*base, *notices)])
    return (
        merged(diagonals(docs, base, notices))
        .where((F.col("template") != SENTINEL) & (F.col("coverage") >= cover))
        .select("doc_id", F.get(names, F.col("template")).alias("label"), "start", "end", "coverage")
    )


def license_report(docs: DataFrame, cover: float = 0.8, base=BASE, notices=NOTICES) -> DataFrame:
    """Per row of ``docs``: word count, literal base places, labels and the best verified coverage."""
    names = F.array(*[F.lit(label) for _, label in (*base, *notices)])
    label = F.get(names, F.col("template"))
    real = F.col("template") != SENTINEL
    based = real & (F.col("base") == 1) & (F.col("literals") > 0)
    joined = lambda test: F.concat_ws(",", F.array_sort(F.collect_set(F.when(test, label))))
    return (
        merged(diagonals(docs, base, notices))
        .groupBy("row", "doc_id")
        .agg(
            F.max(F.when(~real, F.col("n_words"))).cast("long").alias("n_words"),
            F.coalesce(F.sum(F.when(based, F.col("literals"))), F.lit(0)).alias("n_base"),
            F.min(F.when(based, F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(based, F.col("last"))).cast("long").alias("last_word"),
            joined(based).alias("base_labels"),
            joined(based | (real & (F.col("coverage") >= cover))).alias("labels"),
            F.coalesce(F.max(F.when(real, F.col("coverage"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )


def _values() -> str:
    rows = []
    for number, (phrase, label) in enumerate((*BASE, *NOTICES)):
        words = phrase.split()
        for at, (a, b) in enumerate(zip(words, words[1:], strict=False)):
            rows.append(f"('{a}','{b}',{number},'{label}',{int(number < len(BASE))},{at},{len(words) - 1})")
    return ",".join(rows)


ORACLE = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
pairs(ga, gb, template, label, base, tpos, pairs) AS (VALUES {_values()}),
votes AS (
  SELECT r, template, i - 1 - tpos AS diagonal, any_value(label) AS label, any_value(base) AS base,
    any_value(pairs) AS pairs, count(DISTINCT tpos) AS seen, list(DISTINCT tpos) AS spots
  FROM places JOIN pairs ON w[i] = ga AND w[i + 1] = gb GROUP BY r, template, i - 1 - tpos),
marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= 2
    THEN 0 ELSE 1 END AS starts FROM votes),
numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM marked),
near AS (
  SELECT a.r, a.template, a.diagonal, a.pairs, a.spots AS s0, coalesce(b.spots, []) AS s1, coalesce(c.spots, []) AS s2
  FROM votes a LEFT JOIN votes b ON a.r = b.r AND a.template = b.template AND b.diagonal = a.diagonal + 1
    LEFT JOIN votes c ON a.r = c.r AND a.template = c.template AND c.diagonal = a.diagonal + 2),
path AS (
  SELECT *, 0 AS t, 0 AS a0, 0 AS a1, 0 AS a2, 0 AS b0, 0 AS b1, 0 AS b2 FROM near
  UNION ALL
  SELECT r, template, diagonal, pairs, s0, s1, s2, t + 1, list_contains(s0, t)::INTEGER + greatest(a0, b1, b2),
    list_contains(s1, t)::INTEGER + greatest(a1, b0, b2), list_contains(s2, t)::INTEGER + greatest(a2, b0, b1), a0, a1, a2
  FROM path WHERE t < pairs),
best AS (SELECT r, template, diagonal, greatest(a0, a1, a2) AS found FROM path WHERE t = pairs),
spans AS (
  SELECT r, template, span, any_value(label) AS label, any_value(base) AS base, max(found) / any_value(pairs) AS coverage,
    sum(CASE WHEN seen = pairs THEN 1 ELSE 0 END) AS literals,
    min(CASE WHEN seen = pairs THEN diagonal END) AS first,
    max(CASE WHEN seen = pairs THEN diagonal END) AS last
  FROM numbered JOIN best USING (r, template, diagonal) GROUP BY r, template, span),
found AS (
  SELECT r, sum(CASE WHEN base = 1 THEN literals ELSE 0 END) AS n_base,
    min(CASE WHEN base = 1 THEN first END) AS first_word, max(CASE WHEN base = 1 THEN last END) AS last_word,
    list_sort(list(DISTINCT label) FILTER (base = 1 AND literals > 0)) AS base_labels,
    list_sort(list(DISTINCT label) FILTER ((base = 1 AND literals > 0) OR coverage >= 0.8)) AS labels,
    max(coverage) AS score FROM spans GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(base_labels, ','), '') AS base_labels,
  coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0.0) AS score
FROM texts LEFT JOIN found USING (r)
"""
