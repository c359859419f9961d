"""Document fingerprints from closed syncmers.

A k-mer (k bytes of the UTF-8 text) is a closed syncmer if the smallest hash of
its inner s-mers stands at its first or last place. Whether it is one depends on the k-mer alone,
so an edit disturbs only the k-mers it touches, and a text can be cut into pieces that
overlap by k - 1 bytes without changing the result. The fingerprint keeps, for each
of 32 bins, the smallest 32-bit hash among the text's syncmers in that bin.

How alike two texts are is found from all their syncmers and where they stand. Equal syncmers of both texts are
matched, as many as the text with fewer of them has, and vote with the offset between their first places.
Offsets are counted in bands of 64 bytes; two neighbouring bands win, and likeness is the
share of all syncmers that the winners match (Dice). So texts must agree in order, not only in content; a passage that both
share counts with its length, and an insertion shorter than a band costs nothing. An edited text keeps its front in place, so
the bands around offset zero win there.

Scale: texts are shuffled twice, to the document and to the one in front of it; all syncmers of a pair are made, grouped and
counted in the task that holds both texts, in tasks of bounded bytes, and leave it as 32 numbers and two scores. (Where the
session asks for all keys of a grouping to be hashed, syncmers are shuffled too.) No plan grows with the number of
partitions. Bytes are exploded inside the scan. Long texts are cut into blocks, so no array grows with a text.

Edge cases: null text counts as empty. The empty text has 32 empty bins. A text without any syncmer puts the hash of the
whole text into bin 0; two texts without syncmers are alike (1.0) if they are equal, else 0.0. Repeated rows and equal
doc_ids are ordered by the hash of their text, null doc_ids come first; equal texts always get equal fingerprints. A single
row is its own successor. Only doc_id and text are read. An empty table gives an empty result. The input must be deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadentia.session import materialise

K, S, BINS, BLOCK, BAND = 12, 8, 32, 65_536, 64
# Bytes of text a task should hold, and how many times the usual number of partitions that may take.
TASK_BYTES, MOST_TIMES = 2 << 20, 16


def anchors(pieces: DataFrame, key: list[str], data: str = "data", k: int = K, s: int = S) -> DataFrame:
    """``key, place, h``: the closed syncmers of each row's bytes, with their byte offset."""
    n = F.octet_length(data)
    blocks = pieces.where(n >= k).select(
        *key, data, F.explode(F.sequence(F.lit(0), n - k, F.lit(BLOCK))).alias("from")
    )
    cut = blocks.select(
        *key, "from", F.substring(data, F.col("from") + 1, F.lit(BLOCK + k - 1)).alias("b")
    )
    spots = cut.select(
        *key, "from", "b", F.explode(F.sequence(F.lit(1), F.octet_length("b") - k + 1)).alias("p")
    )
    inner = [F.xxhash64(F.substring("b", F.col("p") + i, F.lit(s))) for i in range(k - s + 1)]
    # Written so that every hash is taken once.
    return spots.where(F.least(inner[0], inner[-1]) <= F.least(*inner[1:-1])).select(
        *key,
        (F.col("from") + F.col("p") - 1).alias("place"),
        F.xxhash64(F.substring("b", "p", F.lit(k))).alias("h"),
    )


def successors(docs: DataFrame) -> DataFrame:
    """``row, doc_id, next_row, n_bytes``: each row's successor by doc_id, after the last the first.

    Only ids, lengths and hashes are sorted, in ranges; a range's last row is followed by the first
    row of the next range that has one. That table has one row per range.
    """
    wanted = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "h", "row"]
    text = F.coalesce("text", F.lit(""))
    ids = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(text).alias("h"), F.octet_length(text).alias("n_bytes")
    )
    ranged = ids.repartitionByRange(wanted, *order).withColumn("slot", F.spark_partition_id())
    ranged = materialise(ranged, "order")
    heads = ranged.groupBy("slot").agg(F.min(F.struct(*order)).alias("head"))
    by_slot = W.orderBy("slot")
    after = F.coalesce(F.lead("head.row").over(by_slot), F.min_by("head.row", "slot").over(W.partitionBy()))
    along = W.partitionBy("slot").orderBy(*order)
    follows = ranged.select("row", "doc_id", "n_bytes", "slot", F.lead("row").over(along).alias("next_row"))
    return follows.join(heads.select("slot", after.alias("after")), "slot").select(
        "row", "doc_id", F.coalesce("next_row", "after").alias("next_row"), "n_bytes"
    )


def with_next(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``row, text, next_text``: each document beside the next one. ``pairs`` is a stored table of :func:`successors`.

    Both joins read the same two columns by the same key, so that texts are shuffled once to their own row and
    once to the row in front of them.
    """
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = pairs.agg(F.sum("n_bytes")).first()[0] or 0
    wanted = min(max(usual, held // TASK_BYTES), MOST_TIMES * usual)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.repartition(wanted, "row")
    ahead = pairs.select(F.col("row").alias("of"), "next_row")
    lent = texts.join(ahead, F.col("row") == F.col("next_row")).select(F.col("of").alias("row"), F.col("text").alias("next_text"))
    return texts.join(lent.repartition(wanted, "row"), "row")


def _joined(bins: Column) -> Column:
    shown = lambda x: F.when(x == -1, F.lit("-" * 8)).otherwise(F.lpad(F.lower(F.hex(x)), 8, "0"))
    return F.concat_ws("", F.transform(bins, shown))


# Which text a piece belongs to.
KEPT, OLD_TAIL, NEW_TAIL, NEXT = range(4)


def _matches(pieces: DataFrame) -> DataFrame:
    """Per row and hash: how often it stands in the text (t), its edited form (e) and the next text (x), and where first."""
    place = F.col("base") + F.col("place")
    of = lambda *which: F.col("piece").isin(*which)
    count = lambda *which: F.sum(F.when(of(*which), 1).otherwise(0))
    least = lambda *which: F.min(F.when(of(*which), place))
    return anchors(pieces, ["row", "piece", "base"]).groupBy("row", "h").agg(
        count(KEPT, OLD_TAIL).alias("t"), count(KEPT, NEW_TAIL).alias("e"), count(NEXT).alias("x"),
        least(KEPT, OLD_TAIL).alias("at_t"), least(KEPT, NEW_TAIL).alias("at_e"), least(NEXT).alias("at_x"),
    )


def compared(pieces: DataFrame) -> DataFrame:
    """Per row: bins of the text and its edited form, numbers of syncmers, and how many the winning bands match."""
    found = _matches(pieces).select(
        "row", "t", "e", "x",
        F.when((F.col("t") > 0) & (F.col("x") > 0), F.floor((F.col("at_t") - F.col("at_x")) / BAND)).alias("band"),
        F.least("t", "x").alias("next_votes"),
        F.when(F.abs(F.col("at_t") - F.col("at_e")) < BAND, F.least("t", "e")).otherwise(0).alias("edit_votes"),
        F.col("h").bitwiseAND(F.lit(BINS - 1)).cast("int").alias("bin"),
        F.shiftrightunsigned("h", 32).alias("v"),
    )
    sums = ["t", "e", "x", "edit_votes"]
    per_band = found.groupBy("row", "band", "bin").agg(
        F.sum("next_votes").alias("next_votes"), *[F.sum(c).alias(c) for c in sums],
        F.min(F.when(F.col("t") > 0, F.col("v"))).alias("old"), F.min(F.when(F.col("e") > 0, F.col("v"))).alias("new"),
    )
    # A band and the one below it vote together; only the first copy carries the rest.
    own = F.struct(F.col("band").alias("at"), F.lit(1).alias("first"))
    below = F.struct((F.col("band") - 1).alias("at"), F.lit(0).alias("first"))
    copies = F.when(F.col("band").isNull(), F.array(own)).otherwise(F.array(own, below))
    voted = per_band.select("*", F.inline(copies))
    mine = F.col("first") == 1
    least = lambda side, i: F.min(F.when(F.col("bin") == i, F.col(side)))
    bins = [(side, i) for side in ("old", "new") for i in range(BINS)]
    winners = voted.groupBy("row", "at").agg(
        F.sum(F.when(F.col("at").isNotNull(), F.col("next_votes"))).alias("next_votes"),
        *[F.sum(F.when(mine, F.col(c))).alias(c) for c in sums],
        *[least(side, i).alias(f"{side}{i}") for side, i in bins],
    )
    array = lambda side: F.array(*[F.coalesce(F.min(f"{side}{i}"), F.lit(-1)) for i in range(BINS)])
    return winners.groupBy("row").agg(
        F.coalesce(F.max("next_votes"), F.lit(0)).alias("next_votes"), *[F.sum(c).alias(c) for c in sums],
        array("old").alias("old"), array("new").alias("new"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they and neighbours are.

    Edited: the last quarter of the code points gives way to as many from the start of the next document.
    """
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    pairs = materialise(successors(docs), "successors")
    paired = (
        with_next(docs, pairs)
        .withColumn("kept", F.substring("text", F.lit(1), n - cut))
        .withColumn("edited", F.concat("kept", F.substring("next_text", F.lit(1), cut)))
    )
    whole = lambda c: F.when(F.length(c) == 0, F.lit(-1)).otherwise(F.shiftrightunsigned(F.xxhash64(c), 32))
    plain = paired.select(
        "row",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        whole("text").alias("whole"),
        whole("edited").alias("edited_whole"),
        (F.col("text") == F.col("edited")).alias("same_edited"),
        (F.col("text") == F.col("next_text")).alias("same_next"),
    )
    # Four pieces: what both forms share, the old and the new tail, and the next text.
    tail = F.greatest(F.lit(1), F.octet_length("kept") - K + 2)
    zero, most = F.lit(0), F.lit(2**31 - 1)
    piece = lambda number, base, data: F.struct(
        F.lit(number).alias("piece"), base.alias("base"), data.alias("data")
    )
    pieces = paired.select(
        "row",
        F.inline(
            F.array(
                piece(KEPT, zero, F.col("kept").cast("binary")),
                piece(OLD_TAIL, tail - 1, F.substring(F.col("text").cast("binary"), tail, most)),
                piece(NEW_TAIL, tail - 1, F.substring(F.col("edited").cast("binary"), tail, most)),
                piece(NEXT, zero, F.col("next_text").cast("binary")),
            )
        ),
    )
    blank = F.array_repeat(F.lit(-1).cast("long"), BINS)
    bins = lambda side, one: F.when(
        F.coalesce(F.array_max(side), F.lit(-1)) == -1, F.concat(F.array(F.col(one).cast("long")), F.slice(blank, 2, BINS - 1))
    ).otherwise(F.col(side))
    dice = lambda votes, other, same: F.when(
        F.coalesce(F.col("t") + F.col(other), zero) == 0, F.col(same).cast("int").cast("double")
    ).otherwise(2.0 * F.col(votes) / (F.col("t") + F.col(other)))
    found = plain.join(compared(pieces), "row", "left")
    return found.join(pairs.select("row", "doc_id"), "row").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _joined(bins("old", "whole")).alias("fingerprint"),
        _joined(bins("new", "edited_whole")).alias("edited_fingerprint"),
        dice("edit_votes", "e", "same_edited").alias("near_edited"),
        dice("next_votes", "x", "same_next").alias("near_next"),
    )
