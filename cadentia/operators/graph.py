"""Two-hop fan-in and connected components of the transfer graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadentia.plans.ordered import range_slots
from cadentia.plans.reach import reach_counts
from cadentia.session import cut_lineage, materialise


# Senders in a row that count as standing together.
CHUNK = 1024


def dense_numbers(edge: DataFrame) -> DataFrame:
    """``src, num``: senders numbered 0, 1, ... without gaps, those of one account next to each other.

    A sender stands with its most popular payee, so the senders of a hub fill few chunks, and few blocks, however far
    apart their ids are. Payees follow one another by id, not by size: parts of the graph that have nothing to do with
    each other would else share them. The order is cut into ranges; a range's numbers begin where those before it end.
    """
    degree = edge.groupBy("dst").agg(F.count("*").alias("senders"))
    home = F.max(F.struct("senders", "dst")).alias("home")
    nodes = edge.join(degree, "dst").groupBy("src").agg(home).select("src", F.col("home")["dst"].alias("home"))
    ranged = range_slots(nodes.select("src", "home"), ["home"], ["src"], "slot")
    along = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    begins = ranged.groupBy("slot").agg(F.count("*").alias("n")).select("slot", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("begin"))
    place = F.row_number().over(Window.partitionBy("slot").orderBy("home", "src"))
    return ranged.select("src", "slot", place.alias("place")).join(begins, "slot").select(
        "src", (F.col("begin") + F.col("place") - 1).alias("num")
    )


def two_hop_fan_in(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Per account, other accounts that reach it in one or two transfers.

    Nodes must be whole numbers. The paths are formed and counted where blocks of the edges meet, see
    :mod:`cadentia.plans.reach`; neither paths nor sets of senders are stored or shuffled, and the count is exact.
    """
    edge = materialise(
        edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
        .where(F.col("src") != F.col("dst"))
        .distinct(),
        "edges",
    )
    counted = reach_counts(edge, materialise(dense_numbers(edge), "numbers"))
    return counted.select("account", F.col("n").alias("two_hop_fan_in"))


def components(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 100) -> DataFrame:
    """``node, component`` of an undirected graph; a component is named by its least node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) need about
    log(n) rounds. Only minima per node are grouped, never neighbour lists. Every
    round is checkpointed, so a lost executor does not replay earlier rounds.
    """
    u, v = F.col(a), F.col(b)
    # Stored, so that what lies upstream runs once for the nodes and the rounds. A null end stands alone, on either side.
    ends = F.when(u.isNull() | v.isNull(), F.struct(u.alias("u"), v.alias("v")))
    links = materialise(
        edges.select(F.coalesce(ends, F.struct(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))).alias("e"))
        .select("e.u", "e.v")
        .distinct(),
        "links",
    )
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    star = links.where(F.col("u") != F.col("v"))
    seen = _fingerprint(star)
    for _ in range(max_rounds):
        star = cut_lineage(_small_star(_large_star(star)))
        now = _fingerprint(star)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point within {max_rounds} rounds")
    roots = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def _fingerprint(star: DataFrame):
    return star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def _large_star(star: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node around it."""
    both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.join(least, "u").where(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(star: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m"))
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def component_size(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Per account, the number of accounts in its component."""
    found = materialise(components(edges, a, b), "components")
    sizes = found.groupBy("component").agg(F.count("*").alias("component_size"))
    return found.join(sizes, "component")
