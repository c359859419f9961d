"""The trie of shared beginnings of rebuilt conversations.

Conversation c is rebuilt from the first h turns of its base c - c % 5 and its own turns behind
the first h, h = crc32(c) % 9. Rebuilt conversations are never written out. A sequence of turns is an
element (length, value) of a monoid whose product is (n, v)(m, w) = (n + m, v + r**n * w), modulo a
prime, in three lanes with different r. Running products of the stored conversations are formed in slots
and put together; the value of a rebuilt beginning is the product of the base's head and the quotient of
two of the own running products, so it comes from a handful of numbers per conversation. A turn stored
once in a base stands for the base and for all its heirs.

Beginnings of equal depth and value form a node. That they are equal is verified, not assumed: all
members of a node must have the same parent node, and their last turns, found through stored row numbers, must have
the same role and text. By induction over the depth the whole beginnings are then equal. Should two
differ, everything is done again with other hashes.

Sums over subtrees need no walk down the tree. Every node belongs to its smallest member, so each
conversation owns the lower end of its path. What a conversation shares with smaller ones is then one
number (the bytes above its own end), and so is whether it ends in a leaf it owns; a node's
sums are plain sums of those numbers over its members.

Scale: texts are hashed inside the scan and read once more for turns whose node has several. All shuffles
carry a few numbers per stored turn. Rows are ordered by ranges over (conv_id, turn, digest, row), so a
conversation of any length is split into slots; nodes of any number of members are combined on the
map side; their numbers meet them by joins that Spark splits. The digest of the conversations that end in
one node is sequential, so one task streams that list in chunks, without holding it.

Edge cases: null role and text count as empty. Rows with a null conv_id belong to no conversation and are left
out. Turns of equal number are ordered by a digest of role and text, equal turns stay as
repeated turns. The base of a negative conv_id is taken with the sign of the dividend (-7 has base -5). Only conv_id,
turn, role and text are read, so other columns may have any name. An empty table has no root and gives no rows.
The input must be a deterministic frame, such as a table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadentia.plans.fold import ordered_fold
from cadentia.session import materialise

PRIME = 2**31 - 1
# One generator per lane; any numbers of large order do.
LANES = (1_220_703_125, 48_271, 630_360_016)
EVERY, HEADS = 5, 9
KEY = ["depth", "f0", "f1", "f2"]


def _power(base: int, exponent: Column) -> Column:
    """``base ** exponent`` modulo the prime for exponents below 2**32, digit by digit to base 16."""
    found = None
    for digit in range(8):
        step = pow(base, 16**digit, PRIME)
        table = F.array(*[F.lit(pow(step, i, PRIME)).cast("long") for i in range(16)])
        place = F.shiftright(exponent, 4 * digit).bitwiseAND(F.lit(15)).cast("int")
        found = F.get(table, place) if found is None else (found * F.get(table, place)) % PRIME
    return found


def numbered(conversations: DataFrame) -> DataFrame:
    """``ref, conv_id, turn, role, text`` of every row that has a conversation; ``ref`` is its place in a scan."""
    return conversations.select(
        F.monotonically_increasing_id().alias("ref"),
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).where(F.col("conv_id").isNotNull())


def running_products(conversations: DataFrame, seed: int) -> DataFrame:
    """Every turn with its place and product inside its slot of the conversation.

    ``i`` counts from 1. ``s0..s2`` are the products up to the turn, not yet reduced, ``o0..o2`` its own terms.
    """
    hashed = numbered(conversations).select(
        "ref",
        "conv_id",
        "turn",
        F.xxhash64("role", "text").alias("digest"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        *[F.pmod(F.xxhash64(F.lit(3 * seed + lane), "role", "text"), F.lit(PRIME)).alias(f"t{lane}") for lane in range(3)],
    )
    wanted = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["turn", "digest", "ref"]
    slots = hashed.repartitionByRange(wanted, "conv_id", *order).withColumn("slot", F.spark_partition_id())
    along = W.partitionBy("conv_id", "slot").orderBy(*order)
    upto = along.rowsBetween(W.unboundedPreceding, 0)
    placed = materialise(slots, "slots").withColumn("i", F.row_number().over(along).cast("long"))
    terms = placed.select(
        "*", *[((F.col(f"t{lane}") * _power(base, F.col("i"))) % PRIME).alias(f"o{lane}") for lane, base in enumerate(LANES)]
    )
    summed = terms.select(
        "ref",
        "conv_id",
        "slot",
        "i",
        "n_bytes",
        F.sum("n_bytes").over(upto).alias("s_bytes"),
        *[f"o{lane}" for lane in range(3)],
        *[F.sum(f"o{lane}").over(upto).alias(f"s{lane}") for lane in range(3)],
    )
    return materialise(summed, "products")


def carried(products: DataFrame) -> DataFrame:
    """What stands in front of each slot of a conversation, and the whole conversation's product.

    ``w0..w2`` move a product of the slot behind the ``before`` turns in front of it.
    """
    slots = products.groupBy("conv_id", "slot").agg(
        F.max("i").alias("n"), *[F.max(c).alias(c) for c in ("s_bytes", "s0", "s1", "s2")]
    )
    along = W.partitionBy("conv_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("conv_id")
    before = lambda c: F.coalesce(F.sum(c).over(along), F.lit(0))
    weighed = slots.withColumn("before", before("n")).select(
        "*", *[_power(base, F.col("before")).alias(f"w{lane}") for lane, base in enumerate(LANES)]
    )
    moved = weighed.select("*", *[_moved(F.col(f"s{lane}"), lane).alias(f"m{lane}") for lane in range(3)])
    return moved.select(
        "conv_id",
        "slot",
        "before",
        *[f"w{lane}" for lane in range(3)],
        before("s_bytes").alias("c_bytes"),
        *[(before(f"m{lane}") % PRIME).alias(f"c{lane}") for lane in range(3)],
        F.sum("n").over(whole).alias("n"),
        F.sum("s_bytes").over(whole).alias("all_bytes"),
        *[(F.sum(f"m{lane}").over(whole) % PRIME).alias(f"all{lane}") for lane in range(3)],
    )


def _moved(inside: Column, lane: int) -> Column:
    """A product inside a slot as a term of the whole conversation."""
    return (F.col(f"w{lane}") * (inside % PRIME)) % PRIME


def _whole_product(lane: int, own: bool = True) -> Column:
    """The product up to a turn, or up to the one before, from its slot's and what stands in front of it."""
    inside = F.col(f"s{lane}") if own else F.col(f"s{lane}") - F.col(f"o{lane}")
    return (F.col(f"c{lane}") + _moved(inside, lane)) % PRIME


def _rebuilt(lane: int, product: Column) -> Column:
    """The base's head times the quotient of an own product by that of the turns left out."""
    return (F.col(f"b{lane}") + F.pmod(product - F.col(f"h{lane}"), F.lit(PRIME)) * F.col(f"shift{lane}")) % PRIME


def rebuilding(products: DataFrame, slots: DataFrame) -> DataFrame:
    """Per conversation what its rebuilt form needs.

    ``m`` turns come from the base, with product ``b0..b2`` and ``b_bytes``; ``h`` own turns, with product
    ``h0..h2`` and ``h_bytes``, are left out; ``shift0..2`` move the own rest to its place. ``length``, ``e0..e2`` and
    ``e_bytes`` are those of the whole rebuilt conversation.
    """
    first = products.where(F.col("i") < HEADS).join(slots.where(F.col("before") < HEADS - 1), ["conv_id", "slot"])
    head = F.struct(
        (F.col("before") + F.col("i")).alias("place"),
        *[_whole_product(lane).alias(f"f{lane}") for lane in range(3)],
        (F.col("c_bytes") + F.col("s_bytes")).alias("bytes"),
    )
    # At most eight per conversation.
    heads = first.where(F.col("before") + F.col("i") < HEADS).groupBy("conv_id").agg(F.sort_array(F.collect_list(head)).alias("heads"))
    ends = slots.groupBy("conv_id").agg(F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("all_bytes", "all0", "all1", "all2")])
    stored = materialise(ends.join(heads, "conv_id"), "heads")
    base_id = F.col("conv_id") - F.col("conv_id") % EVERY
    left_out = F.crc32(F.col("conv_id").cast("string")) % HEADS
    is_base = F.col("conv_id") == F.col("base_id")
    bases = stored.select(F.col("conv_id").alias("base_id"), F.col("n").alias("base_n"), F.col("heads").alias("base_heads"))
    both = (
        stored.withColumn("base_id", base_id)
        .join(bases, "base_id", "left")
        .withColumn("h", F.when(is_base, F.lit(0)).otherwise(left_out))
        .withColumn("m", F.when(is_base, F.lit(0)).otherwise(F.least("h", F.coalesce("base_n", F.lit(0)))))
        .withColumn("b", F.get("base_heads", (F.col("m") - 1).cast("int")))
        .withColumn("left", F.get("heads", (F.col("h") - 1).cast("int")))
    )
    or_zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    backward = lambda base: F.array(*[F.lit(pow(base, -i, PRIME)).cast("long") for i in range(HEADS)])
    known = both.select(
        "conv_id",
        "base_id",
        "n",
        "h",
        "m",
        "all_bytes",
        *[f"all{lane}" for lane in range(3)],
        *[or_zero(f"b.f{lane}").alias(f"b{lane}") for lane in range(3)],
        or_zero("b.bytes").alias("b_bytes"),
        *[or_zero(f"left.f{lane}").alias(f"h{lane}") for lane in range(3)],
        or_zero("left.bytes").alias("h_bytes"),
        *[F.get(backward(base), (F.col("h") - F.col("m")).cast("int")).alias(f"shift{lane}") for lane, base in enumerate(LANES)],
    )
    own = F.col("n") > F.col("h")
    return known.select(
        *[c for c in known.columns if not c.startswith("all")],
        (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        *[F.when(own, _rebuilt(lane, F.col(f"all{lane}"))).otherwise(F.col(f"b{lane}")).alias(f"e{lane}") for lane in range(3)],
        F.when(own, F.col("b_bytes") + F.col("all_bytes") - F.col("h_bytes")).otherwise(F.col("b_bytes")).alias("e_bytes"),
    )


def heirs(convs: DataFrame, *values: str) -> DataFrame:
    """Per base the conversations that begin with its turns: at most eight, each with ``m`` and the values."""
    begun = convs.where(F.col("m") > 0)
    return begun.groupBy(F.col("base_id").alias("conv_id")).agg(F.collect_list(F.struct("m", *values)).alias("heirs"))


def occurrences(products: DataFrame, slots: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per stored turn that some rebuilt conversation holds, and one root row per conversation.

    ``w`` counts the conversations for which the row stands, ``least`` is the smallest of them.
    """
    known = slots.drop("n", "all_bytes", "all0", "all1", "all2").join(
        convs.join(heirs(convs, "conv_id"), "conv_id", "left").select(
            "conv_id", "h", "m", "b_bytes", "h_bytes", *[f"{c}{lane}" for c in ("b", "h", "shift") for lane in range(3)], "heirs"
        ),
        "conv_id",
    )
    place = F.col("before") + F.col("i")
    after = lambda k: k["m"] >= F.col("depth")
    turns = products.join(known, ["conv_id", "slot"]).where(place > F.col("h")).withColumn("depth", place - F.col("h") + F.col("m"))
    found = turns.select(
        "conv_id",
        "slot",
        "ref",
        "depth",
        *[_rebuilt(lane, _whole_product(lane)).alias(f"f{lane}") for lane in range(3)],
        *[_rebuilt(lane, _whole_product(lane, own=False)).alias(f"p{lane}") for lane in range(3)],
        (F.col("b_bytes") + F.col("c_bytes") + F.col("s_bytes") - F.col("n_bytes") - F.col("h_bytes")).alias("above"),
        F.filter("heirs", after).alias("with"),
    )
    zero = F.lit(0).cast("long")
    root = convs.select(
        "conv_id",
        F.lit(-1).alias("slot"),
        F.lit(None).cast("long").alias("ref"),
        zero.alias("depth"),
        *[zero.alias(f"{c}{lane}") for c in "fp" for lane in range(3)],
        zero.alias("above"),
        zero.alias("more"),
        F.col("conv_id").alias("least"),
    )
    counted = found.withColumn("more", F.coalesce(F.size("with"), F.lit(0)).cast("long")).withColumn(
        "least", F.least("conv_id", F.array_min(F.transform("with", lambda k: k["conv_id"])))
    )
    whole = counted.drop("with").withColumn("more", F.greatest("more", zero)).unionByName(root)
    return whole.withColumn("w", F.col("more") + 1).drop("more")


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row per node: owner, number of members, bytes above it, its parent, and how many stored turns form it."""
    spread = [f"p{lane}" for lane in range(3)] + ["above"]
    return rows.groupBy(*KEY).agg(
        F.min("least").alias("conv_id"),
        F.sum("w").alias("n_convs"),
        F.count("*").alias("n_refs"),
        *[F.min(c).alias(c) for c in spread],
        *[F.max(c).alias(f"max_{c}") for c in spread],
    )


def disagreements(conversations: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes whose members have different parents or whose stored last turns differ in role or text."""
    parents = nodes.where(
        (F.col("p0") != F.col("max_p0")) | (F.col("p1") != F.col("max_p1")) | (F.col("p2") != F.col("max_p2")) | (F.col("above") != F.col("max_above"))
    ).select(*KEY)
    several = nodes.where((F.col("n_refs") > 1) & (F.col("depth") > 0)).select(*KEY)
    refs = rows.where(F.col("depth") > 0).join(several, KEY).select("ref", *KEY)
    stored = numbered(conversations).select("ref", "role", "text")
    same = stored.join(refs, "ref").groupBy(*KEY).agg(
        F.min("role").alias("role"), F.max("role").alias("role2"), F.min("text").alias("text"), F.max("text").alias("text2")
    )
    return parents.unionByName(same.where((F.col("role") != F.col("role2")) | (F.col("text") != F.col("text2"))).select(*KEY))


def end_digests(convs: DataFrame) -> DataFrame:
    """Per node the digest of the ascending list of conversations that end there.

    The list is cut into chunks by ranges; a node of one chunk is hashed at once, the chunks of others are streamed in order.
    """
    wanted = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = convs.select(F.col("length").alias("depth"), *[F.col(f"e{lane}").alias(f"f{lane}") for lane in range(3)], "conv_id")
    chunks = (
        ends.repartitionByRange(wanted, *KEY, "conv_id")
        .withColumn("chunk", F.spark_partition_id())
        .groupBy(*KEY, "chunk")
        .agg(F.min("conv_id").alias("first"), F.concat_ws(",", F.sort_array(F.collect_list("conv_id")).cast("array<string>")).alias("ids"))
    )
    chunks = materialise(chunks, "ends")
    count = chunks.groupBy(*KEY).agg(F.count("*").alias("chunks"), F.max_by("ids", "first").alias("ids"))
    one = count.where(F.col("chunks") == 1).select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    several = chunks.join(count.where(F.col("chunks") > 1).select(*KEY), KEY).select(*KEY, "first", "ids")
    schema = T.StructType([several.schema[c] for c in (*KEY, "first")] + [T.StructField("ends_sha256", T.StringType())])
    streamed = ordered_fold(several, KEY, ["first"], _add_chunk, schema)
    last = streamed.groupBy(*KEY).agg(F.max_by("ends_sha256", "first").alias("ends_sha256"))
    return one.unionByName(last)


def _add_chunk(state, row):
    """Hash one more chunk of a list; the digest so far is the output."""
    if state is None:
        state = hashlib.sha256(row.ids.encode())
    else:
        state.update(b"," + row.ids.encode())
    return state, (state.hexdigest(),)


def prefix_trie(conversations: DataFrame, seeds: range = range(8)) -> DataFrame:
    """Every node of the trie with its members, children, leaves and the bytes that sharing it saves."""
    for seed in seeds:
        products = running_products(conversations, seed)
        slots = materialise(carried(products), "carried")
        convs = materialise(rebuilding(products, slots), "rebuilding")
        rows = materialise(occurrences(products, slots, convs), "occurrences")
        nodes = materialise(nodes_of(rows), "nodes")
        if disagreements(conversations, rows, nodes).isEmpty():
            return _report(slots, convs, rows, nodes)
    raise RuntimeError("different beginnings share their fingerprints under every seed")


def _report(slots: DataFrame, convs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    children = nodes.where(F.col("depth") > 0).groupBy(
        (F.col("depth") - 1).alias("depth"), *[F.col(f"p{lane}").alias(f"f{lane}") for lane in range(3)]
    ).agg(F.count("*").alias("n_children"))
    full = materialise(
        nodes.drop("n_refs", *[f"max_{c}" for c in ("p0", "p1", "p2", "above")])
        .join(children, KEY, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))),
        "children",
    )
    # What a conversation has above the part of its path that it owns, and whether it owns a leaf.
    owned = full.groupBy("conv_id").agg(
        F.min_by("above", "depth").alias("shared"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaf")
    )
    facts = convs.join(owned, "conv_id", "left").select(
        "conv_id", "base_id", "m", F.coalesce("shared", "e_bytes").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    facts = materialise(facts, "facts")
    own_facts = facts.select("conv_id", "shared", "leaf")
    by_slot = slots.select("conv_id", "slot").join(own_facts.join(heirs(facts, "shared", "leaf"), "conv_id", "left"), "conv_id")
    at_root = own_facts.withColumn("slot", F.lit(-1)).withColumn("heirs", F.lit(None).cast(by_slot.schema["heirs"].dataType))
    here = F.filter("heirs", lambda k: k["m"] >= F.col("depth"))
    total = lambda first, each: first + F.coalesce(F.aggregate(here, F.lit(0).cast("long"), lambda s, k: s + each(k)), F.lit(0))
    more = lambda shared: F.greatest(shared - F.col("above"), F.lit(0).cast("long"))
    sums = (
        rows.select("conv_id", "slot", *KEY, "above")
        .join(by_slot.unionByName(at_root), ["conv_id", "slot"])
        .groupBy(*KEY)
        .agg(
            F.sum(total(F.col("leaf"), lambda k: k["leaf"])).alias("n_leaves"),
            F.sum(total(more(F.col("shared")), lambda k: more(k["shared"]))).alias("saved_tokens"),
        )
    )
    parents = full.select(*[F.col(c).alias(f"parent_{c}") for c in KEY], F.col("conv_id").alias("parent_conv_id"))
    up = F.col("depth") - 1 == F.col("parent_depth")
    for lane in range(3):
        up &= F.col(f"p{lane}") == F.col(f"parent_f{lane}")
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        full.join(sums, KEY)
        .join(end_digests(convs), KEY, "left")
        .join(parents, up, "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS n,
    CASE WHEN conv_id % 5 = 0 THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      string_split(CAST(conv_id AS VARCHAR), ''), lambda s: list_concat([ascii(s)::BIGINT], list_transform(range(8), lambda k: -1::BIGINT))))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 9 END AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, t.i AS depth, x FROM c JOIN t ON t.conv_id = base AND t.i <= h WHERE c.conv_id <> base
  UNION ALL
  SELECT c.conv_id, t.i - h + CASE WHEN c.conv_id = c.base THEN 0 ELSE least(h, coalesce(b.n, 0)) END, x
  FROM c JOIN t USING (conv_id) LEFT JOIN (SELECT conv_id AS base, n FROM c) b ON b.base = c.base WHERE t.i > h),
p AS (
  SELECT conv_id, depth, list(x) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
  UNION ALL SELECT conv_id, 0, list_filter([{'role': '', 'text': ''}], lambda x: x.role <> '') FROM c),
n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * strlen(path[depth].text) END AS saved
  FROM p GROUP BY path, depth),
k AS (
  SELECT n.*, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.path[1:n.depth] = n.path) AS n_children FROM n),
s AS (
  SELECT a.path, a.depth, sum(b.saved) AS saved_tokens, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
  FROM k a JOIN k b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY a.path, a.depth),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
e AS (SELECT path, depth, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM p JOIN l USING (conv_id, depth) GROUP BY path, depth)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(k.n_convs AS BIGINT) AS n_convs,
  CAST(k.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM k JOIN s USING (path, depth) LEFT JOIN e USING (path, depth) LEFT JOIN n u ON u.depth = k.depth - 1 AND u.path = k.path[1:k.depth - 1]
"""
