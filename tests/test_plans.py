"""Ordered plans, quantiles, pairs and graph against brute force, with one hot key."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadentia.operators import graph as G
from cadentia.operators import sessions as SE
from cadentia.operators import transfers as TR
from cadentia.operators.splits import rep_rank
from cadentia.plans import reach as R
from cadentia.plans.ordered import head_per_key, range_slots, running, trailing
from cadentia.plans.pairs import grid_pairs
from cadentia.plans.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 3000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 12, n))
    return pd.DataFrame(
        {"key": key, "at": rng.integers(0, 4000, n), "id": np.arange(n), "v": rng.normal(0, 50, n).round(1)}
    )


@pytest.fixture(scope="module")
def rows(spark, frame):
    return spark.createDataFrame(frame).repartition(5)


def slot():
    return F.floor(F.col("at") / 100)


def test_running_matches_pandas(rows, frame):
    got = running(
        rows, ["key"], ["at", "id"], slot(), totals={"n": F.lit(1).cast("long"), "s": "v"},
        previous={"before": "at"}, whole={"all_n": "n"},
    ).toPandas().sort_values(["key", "at", "id"]).reset_index(drop=True)
    want = frame.sort_values(["key", "at", "id"]).reset_index(drop=True)
    by = want.groupby("key")
    assert (got.n == by.cumcount() + 1).all()
    assert np.allclose(got.s, by.v.cumsum())
    assert (got.before.fillna(-1) == by["at"].shift().fillna(-1)).all()
    assert (got.all_n == by.v.transform("size")).all()


def test_previous_skips_nulls(rows, frame):
    marked = rows.withColumn("m", F.when(F.col("v") > 60, F.col("id")))
    got = running(marked, ["key"], ["at", "id"], slot(), previous={"last": "m"}).toPandas()
    got = got.sort_values(["key", "at", "id"]).reset_index(drop=True)
    want = frame.sort_values(["key", "at", "id"]).reset_index(drop=True)
    want["m"] = want.id.where(want.v > 60)
    expected = want.groupby("key").m.transform(lambda m: m.ffill().shift())
    assert (got["last"].fillna(-1) == expected.fillna(-1)).all()


@pytest.mark.parametrize("step", [10, 50, 300])
def test_trailing_matches_brute_force(rows, frame, step):
    values = {"n": F.lit(1).cast("long"), "s": "v"}
    got = trailing(rows, ["key"], "at", values, {"a": 300, "b": 900}, step).toPandas()
    for row in got.sample(150, random_state=1).itertuples():
        past = frame[(frame.key == row.key) & (frame["at"] <= row.at)]
        for length, n, s in ((300, row.n_a, row.s_a), (900, row.n_b, row.s_b)):
            near = past[past["at"] >= row.at - length]
            assert n == len(near)
            assert s == pytest.approx(near.v.sum(), abs=1e-6)
    assert len(got) == len(frame)
    with pytest.raises(ValueError):
        trailing(rows, ["key"], "at", values, {"a": 301}, step)


def test_trailing_holds_its_input_once(rows):
    summed = rows.groupBy("key", "at").agg(F.sum("v").alias("v"))
    plan = trailing(summed, ["key"], "at", {"s": "v"}, {"a": 300, "b": 900}, 100)._jdf.queryExecution().optimizedPlan().toString()
    # Rows and copies come from one pass; the other one is for the sums of whole slices.
    assert "Union" not in plan and plan.count("Aggregate [key") <= 3


def test_head_per_key(rows, frame):
    got = head_per_key(rows, ["key"], ["at", "id"], 7, slot()).toPandas()
    want = frame.sort_values(["key", "at", "id"]).groupby("key").head(7)
    assert set(got.id) == set(want.id)


def test_exact_quantiles(rows, frame):
    got = exact_quantiles(rows, ["key"], "v", {"lo": 0.0, "q": 0.37, "m": 0.5, "hi": 1.0}).toPandas()
    for row in got.itertuples():
        values = frame[frame.key == row.key].v
        assert [row.lo, row.q, row.m, row.hi] == pytest.approx(list(np.quantile(values, [0, 0.37, 0.5, 1])))
    assert len(got) == frame.key.nunique()
    with pytest.raises(ValueError):
        exact_quantiles(rows, ["key"], "v", {"x": 1.5})


def test_grid_pairs_are_complete(spark):
    a = spark.range(13).withColumnRenamed("id", "a")
    b = spark.range(17).withColumnRenamed("id", "b")
    pairs = grid_pairs(a, b, "a", "b", F.col("a") != F.col("b"))
    assert pairs.count() == pairs.distinct().count() == 13 * 17 - 13
    assert "CartesianProduct" not in pairs._jdf.queryExecution().toString()
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString()


def test_no_window_spans_a_whole_key(rows):
    plan = running(rows, ["key"], ["at", "id"], slot(), previous={"b": "at"})._jdf.queryExecution()
    heavy = [line for line in plan.executedPlan().toString().splitlines() if "Window" in line and "at#" in line]
    assert heavy and all("_slot" in line.split("]")[1] or "_slot" in line for line in heavy)


def random_edges(seed=2):
    rng = np.random.default_rng(seed)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 60, (70, 2))}
    edges |= {(i, 100) for i in range(40)} | {(100, 200 + i) for i in range(20)}  # a hub
    return sorted(edges)


@pytest.mark.parametrize("sparse", [1, 10**13 + 7])
def test_two_hop_matches_brute_force(spark, sparse):
    edges = [(a * sparse, b * sparse) for a, b in random_edges()]
    edges += [(10**15 + 10**9 * i, 100 * sparse) for i in range(600)]
    into = {}
    for a, b in edges:
        if a != b:
            into.setdefault(b, set()).add(a)
    want = {
        d: len((s | set().union(*(into.get(m, set()) for m in s))) - {d}) for d, s in into.items()
    }
    found = G.two_hop_fan_in(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.account: r.two_hop_fan_in for r in found.collect()} == want
    assert G.two_hop_fan_in(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_two_hop_shuffles_counts_and_no_paths(spark):
    edges = spark.createDataFrame(random_edges(), "src long, dst long")
    plan = G.two_hop_fan_in(edges)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashJoin" not in plan and "MergeJoin" not in plan


@pytest.mark.parametrize(
    "links, pairs, marks", [(40, 10**6, 10**6), (700, 30, 800), (90, 2000, 300), (10**6, 500, 2000), (7, 5, 7)]
)
def test_blocks_that_meet_count_each_path_end_once(monkeypatch, links, pairs, marks):
    """Blocks that cut their first and last keys, targets with more pairs than a batch, marked and sorted batches."""
    monkeypatch.setattr(R, "PAIRS", pairs)
    monkeypatch.setattr(R, "MARKS", marks)
    edges = np.array([(a, b) for a, b in random_edges(5) if a != b] + [(100, a) for a in range(0, 60, 7)])
    edges = np.unique(edges, axis=0)
    place = np.random.default_rng(1).permutation(1000)[edges[:, 0]]

    def runs(order, key, node):
        columns = [np.arange(len(edges)) // 300, edges[order, key], edges[order, node]]
        parts = [[pa.array(c[i : i + 37]) for c in columns] for i in range(0, len(edges), 37)]
        return R._runs((pa.record_batch(p, ["slot", "key", "node"]) for p in parts), links)

    targets = [R._target_block(*run) for run in runs(np.lexsort((edges[:, 0], edges[:, 1])), 1, 0)]
    sources = [R._source_block(*run) for run in runs(np.lexsort((edges[:, 1], place)), 0, 1)]
    counts, listed, held = {}, set(), np.zeros(marks, np.int32)
    for t in targets:
        for s in sources:
            for account, source, n in R._meet(*t, *s, held):
                if source is None:
                    for a, m in zip(account.tolist(), n.tolist()):
                        counts[a] = counts.get(a, 0) + m
                else:
                    listed |= set(zip(account.tolist(), source.tolist()))
    for a, _ in listed:
        counts[a] = counts.get(a, 0) + 1
    into = {}
    for a, b in edges.tolist():
        into.setdefault(b, set()).add(a)
    assert counts == {d: len((s | set().union(*(into.get(m, set()) for m in s))) - {d}) for d, s in into.items()}


def test_senders_of_a_hub_fill_few_chunks(spark):
    """However far apart the ids of a hub's senders are, they cost about one bit each."""
    rnd = np.random.default_rng(4)
    senders = [int(x) for x in rnd.choice(10**15, 5000, replace=False)]
    edges = [(s, 1) for s in senders[:4000]] + [(s, 100 + i % 300) for i, s in enumerate(senders[3500:])]
    edge = spark.createDataFrame(edges, "src long, dst long").distinct()
    numbers = G.dense_numbers(edge).collect()
    assert sorted(r.num for r in numbers) == list(range(5000)) and {r.src for r in numbers} == set(senders)
    of = {r.src: r.num for r in numbers}
    chunks = {of[s] // G.CHUNK for s in senders[:4000]}
    assert len(chunks) <= 4000 // G.CHUNK + 2


def test_components_match_union_find(spark):
    edges = random_edges(9) + [(1000 + i, 1001 + i) for i in range(50)] + [(5000, 5000)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    found = G.component_size(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in found} == {x: root(x) for x in parent}
    sizes = pd.Series([root(x) for x in parent]).value_counts()
    assert all(r.component_size == sizes[r.component] for r in found)


def test_components_read_what_lies_upstream_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9), (None, 4), (4, None)], "src long, dst long")
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    found = G.component_size(edges.mapInPandas(passed, "src long, dst long")).collect()
    assert {r.node: r.component_size for r in found if r.node} == {1: 3, 2: 3, 3: 3, 7: 2, 8: 2, 9: 1, 4: 1}
    assert seen.value == 6


def test_snapshot_lookup_takes_newest_not_after(spark):
    ts = "timestamp '2024-01-%02d'"
    visits = spark.sql(f"SELECT 1 AS p, {ts % 5} AS ts, 'a' AS s UNION ALL SELECT 1, {ts % 10}, 'b' UNION ALL SELECT 2, {ts % 10}, 'c'")
    marks = spark.sql(f"SELECT 1 AS p, {ts % 6} AS computed_at, 10 AS v UNION ALL SELECT 1, {ts % 10}, 20 UNION ALL SELECT 1, {ts % 11}, 30")
    got = {r.s: (r.v, r.age_seconds) for r in TR.snapshot_lookup(visits, marks, "p", ["v"], slot_days=2).collect()}
    assert got == {"a": (None, None), "b": (20, 0.0), "c": (None, None)}


def test_duplicate_sequences_depend_on_order(spark):
    rows = [("a", 1, 5), ("a", 2, 7), ("b", 1, 5), ("b", 2, 7), ("c", 1, 7), ("c", 2, 5), ("d", 1, 5)]
    events = spark.createDataFrame(rows, "s string, pos int, gap int")
    prints = SE.sequence_fingerprints(events, ["s"], "pos", "gap")
    got = {r.s: r.copies for r in SE.duplicate_sequences(prints, ["s"]).collect()}
    assert got == {"a": 2, "b": 2, "c": 1}


@pytest.mark.parametrize("stretch", [4, 5, 1000])
def test_rolling_hash_crosses_stretches(spark, stretch):
    rows = [("u", i, i % 3) for i in range(1, 31)]
    events = spark.createDataFrame(rows, "u string, pos long, gap int")
    hashed = SE.rolling_interval_hash(events, ["u"], "pos", "gap", 4, stretch).toPandas()
    assert len(hashed) == 30 and hashed.rolling_hash.isna().sum() == 3
    assert hashed.rolling_hash.nunique() == 3


def test_range_slots_split_one_hot_key_by_a_composite_order(spark):
    rows = [("hot", 1, i % 997, i) for i in range(4000)] + [("cold", 2, 5, 1), (None, 1, 1, 1)]
    frame = spark.createDataFrame(rows, "subject string, session long, rep long, id long")
    ranged = range_slots(frame, ["subject"], ["session", "rep", "id"])
    sizes = [r["count"] for r in ranged.where("subject = 'hot'").groupBy("range_slot").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 2400
    ranks = rep_rank(frame, "subject", ["session", "rep", "id"]).where("subject = 'hot'").collect()
    order = sorted(ranks, key=lambda r: (r.session, r.rep, r.id))
    assert [r.rep_rank for r in order] == list(range(1, 4001))


def test_sessions_from_one_carry_table(spark):
    rnd = np.random.default_rng(6)
    rows = [(k, int(t), i) for i, (k, t) in enumerate(zip(rnd.choice(["hot", "hot", "a", None], 900), rnd.integers(0, 40 * 86_400, 900), strict=True))]
    rows += [("hot", None, 2000), ("b", None, 2001), ("b", 5, 2002), (None, None, 2003), ("c", 90_000, 2004), ("c", 90_000, 2005)]
    frame = spark.createDataFrame(rows, "u string, s long, id long").withColumn("ts", F.timestamp_seconds("s"))
    found = SE.sessionise(frame, "u", "ts", ["ts", "id"], 6000.0)
    got = {r.id: (r.gap, r.session_no) for r in found.collect()}
    want = {}
    for key in ("hot", "a", "b", "c", None):
        last, number = None, 0
        for _, s, i in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            gap = None if s is None or last is None else float(s - last)
            number += gap is None or gap > 6000
            want[i] = (gap, number)
            last = last if s is None else s
    assert got == want
    plan = SE.sessionise(frame, "u", "ts", ["ts", "id"], 6000.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") <= 2 and plan.count("Exchange hashpartitioning") <= 5


def test_parts_of_the_graph_are_numbered_one_after_the_other(spark):
    # Copies of one graph with shifted ids: hubs of 400 and 40 senders, sizes alike in all copies.
    one = [(s, 900 + int(s >= 400)) for s in range(440)]
    edges = [(1000 * copy + s, 1000 * copy + d) for copy in range(12) for s, d in one]
    numbers = {r.src: r.num for r in G.dense_numbers(spark.createDataFrame(edges, "src long, dst long")).collect()}
    for copy in range(12):
        mine = sorted(numbers[1000 * copy + s] for s, _ in one)
        assert mine == list(range(mine[0], mine[0] + 440))
