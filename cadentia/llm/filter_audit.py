"""How five document filters overlap, for every order in which they can be applied.

A document's failures are a mask of five bits. For one mask the outcome of each of the 600 steps
(120 orders, five steps) is known beforehand, so every mask is mapped to one wide integer with a
field per step and outcome, holding 1 or 0. The integers of a part's documents are summed and the
sum is cut into its fields again. A field is as wide as the number of documents of the part, so no
field runs over into the next one.

Scale: the texts are read once and leave the scan as a digest and a mask. Two shuffles follow, of
one small row per document and of one row per distinct text. Documents of equal mask and labels
are counted before their integer is multiplied and added, so a part sums at most 128 products
whatever its size. Neither a part nor a group of copies is ever collected.

Edge cases: null text counts as empty and null lang as the part "". Null doc_ids have no labels,
are no copy of another row and make none of one. Rows that share doc_id and text are not copies of
each other. Several label rows of one doc_id count once: quality or toxic is 1 if any row says so.
Only doc_id, text, lang and doc_id, quality, toxic are read, so other columns may have any name. An
empty table has no parts and gives no rows.
"""

from __future__ import annotations

from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
BIT = {name: 1 << place for place, name in enumerate(FILTERS)}
OUTCOMES = ("kept", "removed", "redundant")
FIELDS = len(ORDERS) * len(FILTERS) * len(OUTCOMES)
COPY = BIT["E"]

RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }
    return sum((F.when(fails[name], BIT[name]).otherwise(0) for name in fails), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, n``: how many documents of a part fail exactly the filters of a mask."""
    text = F.coalesce("text", F.lit(""))
    said = labels.select("doc_id", "quality", "toxic").where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    rows = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text_failures(text).alias("mask"),
    )
    kinds = ["part", "mask", "good", "toxic"]
    none = F.lit(0)
    counted = (
        rows.join(said, "doc_id", "left")
        .select("doc_id", "digest", "part", "mask", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
        .groupBy("digest", "doc_id", *kinds)
        .agg(F.count("*").alias("n"))
    )
    # Joined on text and doc_id, so that the rows of one text stay spread over all tasks.
    first = counted.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    copy = F.when(F.col("is_first").isNull() & F.col("doc_id").isNotNull(), COPY).otherwise(0)
    return (
        counted.join(first, ["digest", "doc_id"], "left")
        .select("part", (F.col("mask") + copy).alias("mask"), "good", "toxic", "n")
        .groupBy(*kinds)
        .agg(F.sum("n").alias("n"))
    )


def outcome_fields(mask: int) -> list[int]:
    """For every order, step and outcome whether a document of this mask has it, as 0 or 1."""
    fields = []
    for order in ORDERS:
        gone = False
        for name in order:
            fails = bool(mask & BIT[name])
            fields += [not gone and not fails, fails and not gone, fails and gone]
            gone |= fails
    return [int(f) for f in fields]


def packed(fields: list[int], width: int) -> int:
    """One integer whose consecutive fields of ``width`` bytes hold the values, the first one lowest."""
    return int.from_bytes(b"".join(f.to_bytes(width, "little") for f in fields), "little")


def unpacked(total: int, width: int, count: int = FIELDS) -> list[int]:
    data = total.to_bytes(width * count, "little")
    return [int.from_bytes(data[i : i + width], "little") for i in range(0, width * count, width)]


def part_report(counts: pd.DataFrame) -> pd.DataFrame:
    """The 600 rows of one part from its counts of masks and labels."""
    rows = [(int(r.mask), int(r.good), int(r.toxic), int(r.n)) for r in counts.itertuples()]
    # No field can exceed the number of documents, which fits into so many bytes.
    width = (sum(n for *_, n in rows).bit_length() + 7) // 8
    wide = {mask: packed(outcome_fields(mask), width) for mask in {r[0] for r in rows}}
    every = unpacked(sum(n * wide[mask] for mask, _, _, n in rows), width)
    good = unpacked(sum(n * wide[mask] for mask, is_good, _, n in rows if is_good), width)
    toxic = unpacked(sum(n * wide[mask] for mask, _, is_toxic, n in rows if is_toxic), width)
    alone = {name: sum(n for mask, _, _, n in rows if mask == BIT[name]) for name in FILTERS}
    part, out, shares, at = counts["part"].iloc[0], [], dict.fromkeys(FILTERS, 0), 0
    for order in ORDERS:
        for step, name in enumerate(order, 1):
            kept, removed, redundant = every[at : at + 3]
            shares[name] += removed
            out.append([part, order, step, kept, removed, redundant, alone[name], good[at + 1], toxic[at + 1]])
            at += 3
    names = [column.split()[0] for column in RESULT.split(", ")]
    return pd.DataFrame([[*row, shares[row[1][row[2] - 1]]] for row in out], columns=names)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order and step: what the filter keeps, removes, and would have removed."""
    return masks(docs, labels).groupBy("part").applyInPandas(part_report, RESULT)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT filter_order, step, filter_order[step] AS name, filter_order[1:step - 1] AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
j AS (
  SELECT part, filter_order, step, name, n, good, toxic, fails, contains(fails, name) AS bad,
    len(list_intersect(string_split(before, ''), string_split(fails, ''))) > 0 AND before <> '' AND fails <> '' AS gone
  FROM m, s),
r AS (
  SELECT part, filter_order, step, name, sum(CASE WHEN NOT bad AND NOT gone THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = name THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bad AND NOT gone THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN bad AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM j GROUP BY part, filter_order, step, name)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, name) AS BIGINT) AS shapley
FROM r
"""
