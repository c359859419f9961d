"""SimHash near-duplicates with pigeonring filtering.

A fingerprint sets each of 64 bits by the vote of the XXH64 hashes of a text's 4-word
shingles. Fingerprints link at 4 or fewer differing bits. The 64 bits are five
segments on a ring. If two fingerprints differ in at most 4 bits, there is a segment from
which every chain of l consecutive segments differs in at most floor(4 l / 5) bits:
0 in one, 1 in two, 2 in three, 3 in four. A join finds the pairs that keep the budget
of a chain of two segments (26 bits): one side emits its five exact chains, the other those chains with at
most one bit flipped in the second segment. Longer chains prune the pairs before the full check.

Scale: documents are hashed once, in Arrow batches, and only (doc_id, fingerprint) is kept.
Equal fingerprints collapse first, so a group of copies is one node however large it is. The join is
an equi-join on 26 bits with 75 narrow rows per distinct fingerprint; its chance candidates grow
with the square of the distinct fingerprints divided by 2^26, its true links with the links there are.
Components come from checkpointed star rounds; nothing is collected.

Edge cases: null, empty and white-space texts have fingerprint zero and link like any other.
Repeated rows are returned as often as they came. Null doc_ids are kept; they count
only where no other doc_id is in the component, whose component_id is then null.
Only doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.operators.graph import components
from cadentia.session import materialise

SEED = 42
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
MOST = 4
# Words hashed at a time, so that a very long text needs no table of all its bits.
STEP = 1 << 16


def text_fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    n = len(words) - k + 1
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, STEP):
        part = words[start : min(n, start + STEP) + k - 1]
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths) + np.arange(len(part))
        begins = ends - lengths
        line = b" ".join(part)
        spans = zip(begins[: len(part) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(votes * 2 > n, bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, *more: str) -> DataFrame:
    """``doc_id, fp`` and further columns of ``docs``."""

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([text_fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select("doc_id", hashed("text").alias("fp"), *more)


def _rotated(x: str) -> str:
    """SQL: ``x`` turned so that the chain begins at bit 0."""
    return f"CASE WHEN s.at = 0 THEN {x} ELSE shiftrightunsigned({x}, s.at) | shiftleft({x}, 64 - s.at) END"


def _chains(flips: bool) -> str:
    """SQL array of (start, bit to flip, mask of two segments, masks of three and four)."""
    rows = []
    for i, (at, _) in enumerate(SEGMENTS):
        widths = [SEGMENTS[(i + j) % 5][1] for j in range(5)]
        two, three, four = (sum(widths[:n]) for n in (2, 3, 4))
        bits = [0] + [1 << b for b in range(widths[0], two)] * flips
        rows += [f"struct({i} AS i, {at} AS at, {b}L AS flip, {(1 << two) - 1}L AS two, "
                 f"{(1 << three) - 1}L AS three, {(1 << four) - 1}L AS four)" for b in bits]
    return f"array({', '.join(rows)})"


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: distinct fingerprints (column ``fp``) that differ in 1 to 4 bits, a < b."""
    key = f"shiftleft((({_rotated('fp')}) ^ s.flip) & s.two, 3) + s.i"

    def side(flips: bool, name: str) -> DataFrame:
        spread = fps.select("fp", F.explode(F.expr(_chains(flips))).alias("s"))
        more = ["s"] if flips else []
        return spread.select(F.col("fp").alias(name), F.expr(key).alias("key"), *more)

    pairs = side(True, "a").join(side(False, "b"), "key").where("a < b")
    turned = _rotated("(a ^ b)")
    kept = pairs.where(
        f"bit_count(({turned}) & s.three) <= 2 AND bit_count(({turned}) & s.four) <= 3 AND bit_count(a ^ b) <= {MOST}"
    )
    return kept.select("a", "b").distinct()


def _classes(found: DataFrame) -> DataFrame:
    """``fp, component, component_id`` of the fingerprints of ``found``."""
    nodes = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    edges = materialise(links(nodes.select("fp")), "simhash-links")
    grouped = components(edges, "a", "b").select(F.col("node").alias("fp"), "component")
    whole = nodes.join(grouped, "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    roots = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    return whole.join(roots, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``."""
    found = materialise(fingerprints(docs, shingle), "simhash")
    return found.join(_classes(found), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """One row of ``docs`` per component: that of the smallest doc_id, null last, and of repeated rows one."""
    rows = docs.withColumn("simhash_row", F.monotonically_increasing_id())
    found = materialise(fingerprints(rows, shingle, "simhash_row"), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "simhash_row"))
    kept = (
        found.join(_classes(found), "fp")
        .groupBy("component")
        .agg(first.alias("first"))
        .select(F.col("first.simhash_row").alias("simhash_row"))
    )
    return rows.join(kept, "simhash_row", "left_semi").drop("simhash_row")
