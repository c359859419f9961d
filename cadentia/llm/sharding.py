"""Byte-balanced sharding by Karmarkar-Karp differencing.

Documents with equal text form an indivisible group. Every group starts as a partial
partition that holds it in one of ``shards`` parts. The two partial partitions with the largest
spread are combined, the heavier parts of one with the lighter parts of the other,
until one is left. Its parts are the shards; law: ``bytes``.

Scale: differencing is sequential, so it runs in layers of group size and in cells. Layer 0 holds
the groups of at least 1/4800 of all bytes, of which there are at most 4800. Every further layer
holds groups down to a sixteenth of the size before, dealt by hash into cells of about
``cell_groups`` groups that are differenced in parallel. A cell starts from its share of what the parts
already hold, so lighter groups level what heavier ones leave; what remains uneven comes
from the lightest groups alone. Only one sum per shard goes through the driver
per layer, and the number of layers grows with the logarithm of the bytes. Copies are counted
before groups are dealt, so a hot group is one row.
Slots come from counts per (shard, bucket), so no shard is numbered in one task.

Edge cases: null and empty texts weigh 8 bytes; nulls are one group with the empty
text. Repeated rows and null doc_ids are placed like any other, each with its own slot. A group
heavier than an even share makes a shard heavier than the others: groups are not divided.
Only doc_id and text are read. An empty table gives an empty result. The input must be deterministic.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadentia.session import materialise

HEAVY = 200
FACTOR = 16
CELL_GROUPS = 250


def differenced(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of part sums) into one.

    Returns where each part of each row went, and the sums of the combined parts.
    """
    n, k = sums.shape
    parts = [row.copy() for row in sums]
    joined: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    heap = [(-float(row.max() - row.min()), i) for i, row in enumerate(parts)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        down, up = np.argsort(-parts[a], kind="stable"), np.argsort(parts[b], kind="stable")
        both = parts[a][down] + parts[b][up]
        joined.append((a, b, down, up))
        parts[a] = parts[b] = None
        parts.append(both)
        heapq.heappush(heap, (-float(both.max() - both.min()), len(parts) - 1))
    total = parts[-1]
    # Walk back: a node's label says where each of its parts ended up.
    labels: list = [None] * len(parts)
    labels[-1] = np.arange(k)
    for node in range(len(parts) - 1, n - 1, -1):
        a, b, down, up = joined[node - n]
        labels[a], labels[b] = np.empty(k, int), np.empty(k, int)
        labels[a][down] = labels[node]
        labels[b][up] = labels[node]
        labels[node] = None
    return np.array(labels[:n]).reshape(n, k), total


def _cell(shards: int, before: np.ndarray, layer_bytes: int):
    """Difference one cell's groups together with its share of what the parts already hold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "group"], ascending=[False, True], ignore_index=True)
        sums = np.zeros((len(pdf) + 1, shards), np.int64)
        sums[0] = before * (int(pdf["bytes"].sum()) / layer_bytes)
        sums[1:, 0] = pdf["bytes"].to_numpy()
        labels, _ = differenced(sums)
        # Name the combined parts after the earlier parts they contain.
        named = np.empty(shards, np.int32)
        named[labels[0]] = np.arange(shards)
        return pd.DataFrame({"group": pdf["group"], "bytes": pdf["bytes"], "shard": named[labels[1:, 0]]})

    return run


def assign_groups(
    groups: DataFrame, shards: int = 24, heavy: int = HEAVY, factor: int = FACTOR, cell_groups: int = CELL_GROUPS
) -> DataFrame:
    """``group, shard`` for rows ``group string, bytes long``; groups are distinct."""
    groups = materialise(groups, "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    # Layer 0 holds at most shards * heavy groups, each next one sizes down to a factor-th of it.
    bounds = [total / (shards * heavy)]
    while bounds[-1] > 8:
        bounds.append(bounds[-1] / factor)
    layer = sum((F.col("bytes") < b).cast("int") for b in bounds)
    layered = groups.withColumn("layer", layer)
    sizes = {r.layer: (r.n, r.b) for r in layered.groupBy("layer").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()}
    held, placed = np.zeros(shards, np.int64), None
    for number in sorted(sizes):
        n, n_bytes = sizes[number]
        n_cells = 1 if number == 0 else math.ceil(n / cell_groups)
        dealt = layered.where(F.col("layer") == number).withColumn("cell", F.pmod(F.xxhash64("group"), F.lit(n_cells)))
        run = _cell(shards, held, n_bytes)
        done = dealt.groupBy("cell").applyInPandas(run, "group string, bytes long, shard int")
        done = materialise(done, "layer")
        for r in done.groupBy("shard").agg(F.sum("bytes").alias("b")).collect():  # one row per shard
            held[r.shard] += r.b
        done = done.select("group", "shard")
        placed = done if placed is None else placed.unionByName(done)
    if placed is None:
        return groups.select("group", F.lit(0).alias("shard"))
    return placed


def shard_documents(docs: DataFrame, shards: int = 24, buckets: int = 64, **tree) -> DataFrame:
    """Per row of ``docs``: size, text crc, law, shard and its gapless slot there."""
    text = F.coalesce("text", F.lit(""))
    rows = materialise(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text, 256).alias("group"),
        ),
        "sizes",
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    placed = rows.join(assign_groups(groups, shards, **tree), "group").withColumn(
        "bucket", F.pmod(F.xxhash64("row"), F.lit(buckets))
    )
    placed = materialise(placed.drop("group"), "placed")
    # Slots: counts per (shard, bucket) say where a bucket begins, a window numbers its rows.
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    begins = (
        placed.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    )
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("row"))
    # At most shards x buckets rows.
    return (
        placed.withColumn("place", within)
        .join(F.broadcast(begins), ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("begin") + F.col("place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
