"""Best-fit packing of token sequences in bulk-synchronous rounds.

A document is its token ids and an end id. Documents longer than the capacity are cut into
pieces of full length and a shorter first piece. Pieces longer than half the capacity open a
sequence each, as no two of them fit together. The rest is placed in rounds:

1. Pieces and gaps are ranged by size, pieces before gaps of the same size.
2. A sweep pairs every gap with the largest piece at or below it that no smaller gap has
   taken. Read in order of size, pieces open brackets and gaps close them: a piece's depth
   is its rank, and a piece and a gap at the same depth that follow each other belong together.
3. Conflicts need no retry: depth ranks are unique, so a piece meets one gap at most.
4. Gaps shrink by what they took, and the next round begins. A gap of several times the largest piece counts as
   several gaps of equal share. Sequences are opened where pieces outweigh all gaps or nothing fits.

Scale: depths are running sums. Counts per (kind, size, salt) cell, at most
2 x capacity x ``SALTS`` rows, are summed in order of size; inside a cell a window ranks the rows, so a
size that a third of all pieces share is ranked in several tasks. Rows meet by depth, where a
key has at most one row per cell. Every round is one written table. A round places every
piece that fits a gap of its depth, so few rounds are needed (seven on the check tables).

Edge cases: null and empty texts are one end id. Repeated rows and null doc_ids are packed like
any other. Only doc_id and text are read. An empty table gives an empty result. The written
piece table makes row ids stable.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadentia.llm.tokens import token_ids
from cadentia.session import materialise

CAPACITY = 2048
END = 0
SALTS = 8
STATE = "kind int, id long, size long, used long, piece long, piece_size long, at long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, added: tuple = ()) -> DataFrame:
    """``row, doc_id, piece, start, length, ids_crc32`` of every piece of every document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], "<u4")
        for batch in batches:
            took, parts = [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.concatenate([token_ids(text.as_py(), vocabulary, added), end])
                first = len(ids) % capacity or min(len(ids), capacity)
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    took.append(i)
                    parts.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = np.array(parts, np.int64).reshape(-1, 4).T
            own = batch.select(["row", "doc_id"]).take(pa.array(took, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])],
                names=["row", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = f"row long, doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(cut, schema)


def _sweep(cells: pd.DataFrame, capacity: int, first_new: int) -> tuple[pd.DataFrame, int]:
    """Depths at which the cells begin, and how many sequences to open.

    ``cells`` counts pieces (kind 0) and gaps (kind 1) per size and salt.
    """
    pieces, gaps = cells[cells.kind == 0], cells[cells.kind == 1]
    least, most = pieces["size"].min(), pieces["size"].max()
    gaps = gaps[gaps["size"] >= least]
    weight = int((pieces["size"] * pieces.n).sum())
    new = max(0, math.ceil((weight - int((gaps["size"] * gaps.n).sum())) / capacity))
    if not new and gaps.empty:
        new = math.ceil(weight / capacity)
    if new:
        salts = np.arange(SALTS)
        # Opened sequences are numbered -first_new, -first_new - 1, ... and salted by that.
        counts = [len(range((-s - first_new) % SALTS + first_new, first_new + new, SALTS)) for s in salts]
        opened = pd.DataFrame({"kind": 1, "size": capacity, "salt": salts, "n": counts})
        gaps = pd.concat([gaps, opened[opened.n > 0]]).groupby(["kind", "size", "salt"], as_index=False).n.sum()
    share = max(1, math.ceil(pieces.n.sum() / gaps.n.sum()))
    table = pd.concat([pieces, gaps], ignore_index=True)
    table["parts"] = np.where(table.kind == 0, 1, np.clip(table["size"] // most, 1, share))
    table["room"] = table["size"] // table.parts
    table = table.sort_values(["room", "kind", "size", "salt"], ignore_index=True)
    depth, begins = 0, []
    for kind, n, parts in zip(table.kind, table.n, table.parts, strict=True):
        begins.append(depth)
        depth = depth + n if kind == 0 else max(0, depth - n * parts)
    table["depth"], table["cell"] = begins, np.arange(len(table))
    return table, new


def _round(state: DataFrame, table: DataFrame, opened: DataFrame) -> DataFrame:
    """One sweep: pieces left, gaps with what they took, and pieces placed."""
    rows = state.where("kind < 2").select("kind", "id", "size", "used").unionByName(opened)
    salted = rows.withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int"))
    ranked = (
        salted.join(F.broadcast(table.drop("n", "room")), ["kind", "size", "salt"])
        .withColumn("rank", F.row_number().over(W.partitionBy("kind", "size", "salt").orderBy("id")))
        .withColumn("sub", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    )
    step = (F.col("rank") - 1) * F.col("parts") + F.col("sub")
    placed = ranked.withColumn(
        "level", F.when(F.col("kind") == 0, F.col("depth") + step).otherwise(F.col("depth") - step + 1)
    )
    # Gaps below level 1 have no piece left to take; they keep apart, so that no level gathers them.
    key = F.when(F.col("level") > 0, F.struct("level", F.lit(0).cast("long").alias("own"))).otherwise(
        F.struct(F.lit(0).cast("long").alias("level"), (F.col("id") * 4096 + F.col("sub")).alias("own"))
    )
    along = W.partitionBy("key").orderBy("cell")
    met = placed.withColumn("level", F.col("level").cast("long")).withColumn("key", key)
    met = (
        met.withColumn("next_kind", F.lead("kind").over(along))
        .withColumn("piece", F.when((F.col("kind") == 1) & (F.lag("kind").over(along) == 0), F.lag("id").over(along)))
        .withColumn("piece_size", F.when(F.col("piece").isNotNull(), F.lag("size").over(along)))
        .where((F.col("kind") == 1) | F.col("next_kind").isNull() | (F.col("next_kind") == 0))
    )
    # The parts of one gap, at most capacity of them, lie behind each other.
    taken = F.coalesce("piece_size", F.lit(0))
    inside = W.partitionBy("kind", "id").orderBy("sub")
    before = F.coalesce(F.sum(taken).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(taken).over(W.partitionBy("kind", "id"))
    laid = met.withColumn("at", F.col("used") + before).withColumn("total", total)
    none = F.lit(None).cast("long")
    piece_left = F.struct(F.lit(0).alias("kind"), "id", "size", "used", none.alias("piece"), none.alias("piece_size"), none.alias("at"))
    gap_left = F.struct(
        F.lit(1).alias("kind"), "id", (F.col("size") - F.col("total")).alias("size"),
        (F.col("used") + F.col("total")).alias("used"), none.alias("piece"), none.alias("piece_size"), none.alias("at"),
    )
    fitted = F.struct(F.lit(2).alias("kind"), "id", "size", "used", "piece", "piece_size", "at")
    out = (
        F.when(F.col("kind") == 0, F.array(piece_left))
        .when((F.col("sub") == 1) & F.col("piece").isNotNull(), F.array(gap_left, fitted))
        .when(F.col("sub") == 1, F.array(gap_left))
        .when(F.col("piece").isNotNull(), F.array(fitted))
    )
    return laid.select(F.inline(out)).where("kind <> 1 OR size > 0")


def best_fit(items: DataFrame, capacity: int = CAPACITY, most_rounds: int = 200) -> DataFrame:
    """``id, sequence_id, offset`` for rows ``id long, length long`` with 1 <= length <= capacity."""
    spark = items.sparkSession
    none = F.lit(None).cast("long")
    big = F.col("length") * 2 > capacity
    alone = items.where(big).select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    state = items.select(
        F.when(big, 1).otherwise(0).alias("kind"),
        "id",
        F.when(big, capacity - F.col("length")).otherwise(F.col("length")).alias("size"),
        F.when(big, F.col("length")).otherwise(F.lit(0)).cast("long").alias("used"),
        none.alias("piece"), none.alias("piece_size"), none.alias("at"),
    ).where("size > 0")
    placed, opened_so_far = alone, 0
    for _ in range(most_rounds):
        # At most 2 x capacity x SALTS rows, whatever the input.
        cells = (
            state.where("kind < 2")
            .groupBy("kind", "size", F.pmod("id", F.lit(SALTS)).cast("int").alias("salt"))
            .agg(F.count("*").alias("n"))
            .toPandas()
        )
        if not (cells.kind == 0).any():
            return placed
        table, new = _sweep(cells, capacity, opened_so_far + 1)
        # Opened sequences have negative ids; pieces that opened one gave it theirs.
        opened = spark.range(opened_so_far + 1, opened_so_far + 1 + new).select(
            F.lit(1).alias("kind"), (-F.col("id")).alias("id"), F.lit(capacity).cast("long").alias("size"),
            F.lit(0).cast("long").alias("used"),
        )
        opened_so_far += new
        state = materialise(_round(state, spark.createDataFrame(table), opened), "round")
        fitted = state.where("kind = 2").select(
            F.col("piece").alias("id"), F.col("id").alias("sequence_id"), F.col("at").alias("offset")
        )
        placed = placed.unionByName(fitted)
    raise RuntimeError(f"pieces are left after {most_rounds} rounds")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, added: tuple = ()) -> DataFrame:
    """Per piece: its document, place there, length, digest of ids, sequence and offset in it."""
    pieces = materialise(token_pieces(docs, vocabulary, capacity, added), "pieces")
    numbered = materialise(pieces.withColumn("id", F.monotonically_increasing_id()), "numbered")
    placed = best_fit(numbered.select("id", "length"), capacity)
    return numbered.join(placed, "id").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
