"""Benchmark decontamination by a prefix-filtered set join.

A window is 13 consecutive words of an item (the whole item if shorter). A document
holds a window only if it holds every word shingle of it, so with the shingles
of a window ordered by how rare they are in all documents, the rarest one alone is a
sufficient prefix (containment 1). Document shingles are joined to these prefix
tokens; a hit fixes where the window would start (positional bound) and whether it
fits into the text (length bound); the words of the window are then compared.

Scale: two passes over the documents (rarity, search), both broadcast joins with a
shuffle of counts or hits only. The broadcast side is cut into blocks of at most
``block_rows`` rows, one pass per block, so that a large benchmark costs passes, not memory.
The words of a text travel only inside the task that scans it.

Edge cases: null and empty texts and items have no words and no windows. Repeated rows and
null or equal doc_ids are judged row by row; rows of items with one item_id count as one
item. The windows of an item with a null item_id hit words, but the item is not listed or
counted. Only the named columns are read. Empty tables give an empty result, an empty
benchmark gives clean documents. The documents must be a deterministic frame.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadentia.llm.text import word_array
from cadentia.session import materialise


def _shingle(words: str, at: Column, length: int) -> Column:
    """Hash of ``length`` words from place ``at``; the length is part of the hash."""
    return F.xxhash64(F.lit(length), *[F.get(words, at + i) for i in range(length)])


def windows(benchmark: DataFrame, width: int = 13, shingle: int = 5) -> DataFrame:
    """``item_id, win, long, offset, k, h``: the shingles of every window of every item."""
    items = benchmark.select("item_id", word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    placed = items.withColumn("long", F.least(F.lit(width), F.size("w"))).select(
        "item_id", "w", "long", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("long"))).alias("at")
    )
    cut = placed.select(
        "item_id",
        "long",
        F.expr("slice(w, at + 1, long)").alias("w"),
        F.least(F.lit(shingle), F.col("long")).alias("k"),
    )
    shingled = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("long") - F.col("k"))).alias("offset"))
    hashed = F.coalesce(
        *[F.when(F.col("k") == k, _shingle("w", F.col("offset"), k)) for k in range(1, shingle + 1)]
    )
    return shingled.select(
        "item_id", F.concat_ws(" ", "w").alias("win"), "long", "offset", "k", hashed.alias("h")
    )


def _places(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """One row per word place and shingle length, and one with ``h`` 0 that stands for the text."""
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.concat(F.array(F.lit("")), word_array(F.col("text"))).alias("w"),
    )
    spots = texts.select("row", "doc_id", "w", F.posexplode("w").alias("p", "word"))
    rows = []
    for n, k in enumerate(lengths):
        inside = F.col("p") + k <= F.size("w")
        h = F.when(F.col("p") == 0, F.lit(0 if n == 0 else None).cast("long")).when(inside, _shingle("w", F.col("p"), k))
        rows.append(h)
    h = rows[0] if len(rows) == 1 else F.explode(F.array(*rows))
    return spots.select("row", "doc_id", "w", "p", h.alias("h"))


def rarity(docs: DataFrame, vocabulary: DataFrame, lengths: list[int], blocks: int) -> DataFrame:
    """``h, seen``: how often each shingle of the benchmark stands in the documents."""
    found = None
    for block in range(blocks):
        part = vocabulary.where(F.pmod("h", F.lit(blocks)) == block)
        hits = _places(docs, lengths).join(F.broadcast(part), "h").groupBy("h").agg(F.count("*").alias("seen"))
        found = hits if found is None else found.unionByName(hits)
    return vocabulary.join(found, "h", "left").select("h", F.coalesce("seen", F.lit(0)).alias("seen"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """Per row of ``docs``: words, hit words, items found, their digest, and the verdict."""
    return judged(docs, benchmark, **settings).drop("row")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    rows = docs.withColumn("judged_row", F.monotonically_increasing_id())
    bad = judged(docs, benchmark, **settings).where("contaminated").select(F.col("row").alias("judged_row"))
    # Stored, so that its size is known when the texts meet it: they are shuffled only if the numbers are many.
    return rows.join(materialise(bad, "contaminated"), "judged_row", "left_anti").drop("judged_row")


def judged(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 13,
    shingle: int = 5,
    share: int = 20,
    block_rows: int = 200_000,
) -> DataFrame:
    """The verdict per row of ``docs``, with ``row``, the place of the row in a scan of them.

    A text is contaminated if at least one ``share``-th of its words is hit.
    """
    table = materialise(windows(benchmark, width, shingle), "windows")
    n_rows = table.count()
    lengths = [r.k for r in table.select("k").distinct().collect()] or [shingle]  # at most `shingle` values
    blocks = max(1, math.ceil(n_rows / block_rows))
    seen = rarity(docs, table.select("h").distinct(), sorted(lengths, reverse=True), blocks)
    # The rarest shingle of each window; ties go to the smaller hash, then to the first place.
    rarest = F.min(F.struct("seen", "h", "offset"))
    prefix = (
        table.join(seen, "h")
        .groupBy("item_id", "win", "long")
        .agg(rarest.alias("r"))
        .select("item_id", "win", "long", F.col("r.offset").alias("offset"), F.col("r.h").alias("h"))
    )
    prefix = materialise(prefix, "prefix")
    hits = None
    for block in range(blocks):
        part = prefix.where(F.pmod("h", F.lit(blocks)) == block)
        if block == 0:
            mark = docs.sparkSession.range(1).select(
                F.lit(None).cast(prefix.schema["item_id"].dataType).alias("item_id"),
                F.lit("").alias("win"),
                F.lit(0).alias("long"),
                F.lit(0).alias("offset"),
                F.lit(0).cast("long").alias("h"),
            )
            part = part.unionByName(mark)
        start = F.col("p") - F.col("offset")
        fits = (F.col("p") > 0) & (F.col("long") > 0) & (start >= 1) & (start + F.col("long") <= F.size("w"))
        equal = F.concat_ws(" ", F.expr("slice(w, p - offset + 1, long)")) == F.col("win")
        text_itself = (F.col("p") == 0) & (F.col("long") == 0)
        joined = _places(docs, sorted(lengths, reverse=True)).join(F.broadcast(part), "h")
        kept = joined.where(text_itself | (fits & equal)).select(
            "row",
            "doc_id",
            F.when(text_itself, F.size("w") - 1).alias("n"),
            F.when(~text_itself, F.struct(start.alias("start"), (start + F.col("long")).alias("end"))).alias("hit"),
            F.col("item_id").cast("string").alias("item"),
        )
        hits = kept if hits is None else hits.unionByName(kept)
    # Spans of one text, ordered by start: every span adds what lies behind the furthest end so far.
    covered = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["start"]))).alias("n"),
            F.greatest(s["end"], x["end"]).alias("end"),
        ),
        lambda s: s["n"],
    )
    return (
        hits.groupBy("row", "doc_id")
        .agg(
            F.max("n").cast("long").alias("n_words"),
            F.collect_set("hit").alias("hits"),
            F.array_sort(F.collect_set("item")).alias("items"),
        )
        .withColumn("n_hit", covered)
        .select(
            "row",
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        )
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
spots AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
found AS (SELECT r, n, i, item_id FROM spots JOIN win USING (n, win)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, array_to_string(list_sort(list(CAST(item_id AS VARCHAR))), ',') AS ids
  FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
