"""Snapshots by increments, evidence across sessions and refused updates against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cadentia.operators import adaptation as A
from cadentia.operators import fusion as U
from cadentia.operators import snapshots as N
from cadentia.operators import transfers as T
from cadentia.operators import trust

ORDER = ["ts", "transfer_id"]


def log(spark, rows):
    frame = spark.createDataFrame(rows, "sender string, payee string, at double, amount double, transfer_id long")
    return frame.withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).drop("at")


def transfers(rnd, n=400):
    rows = []
    for i in range(n):
        at = 1_700_000_000 + rnd.randint(0, 12 * 86_400)
        rows.append((rnd.choice(["a", "hot", "hot", None]), rnd.choice(["x", "y", None]), float(at), rnd.choice([1.0, 2.5, 9.0, None]), i))
    return [*rows, ("a", "x", None, 4.0, n), ("late", "x", 1_700_000_000 + 12 * 86_400.0, 4.0, n + 1)]


def shown(state):
    edges = {(r.sender, r.payee): (r.txn_count, r.cum_amount, r.first_seen, r.last_seen, r.interval_cv and round(r.interval_cv, 9))
             for r in N.edge_features(state).collect()}
    users = {r.sender: (r.p50, r.p95, r.transfers, tuple(r.hour_histogram)) for r in N.user_features(state, {"p50": 0.5, "p95": 0.95}).collect()}
    return edges, users


def test_increments_equal_one_run_and_replays_change_nothing(spark, tmp_path):
    rows = log(spark, transfers(random.Random(7)))
    days = [f"2023-11-{d}" for d in range(14, 28)]
    whole = shown(N.advance(rows, str(tmp_path / "one"), days[-1], ORDER))
    root = str(tmp_path / "many")
    for day in days:
        N.advance(rows, root, day, ORDER)
    assert N.versions(spark, root) == days
    assert shown(N.read_state(spark, root, days[-1])) == whole
    before = shown(N.read_state(spark, root, days[5]))
    for day in days[5:]:
        N.advance(rows, root, day, ORDER)
    assert shown(N.read_state(spark, root, days[5])) == before
    assert shown(N.read_state(spark, root, days[-1])) == whole
    edges, users = whole
    wanted = T.payee_edge_features(rows).collect()
    assert {k: v[:4] for k, v in edges.items()} == {(r.sender, r.payee): (r.txn_count, r.cum_amount, r.first_seen, r.last_seen) for r in wanted}
    regular = T.interval_regularity(rows, ORDER).collect()
    assert {k: v[4] for k, v in edges.items()} == {(r.sender, r.payee): r.interval_cv and pytest.approx(r.interval_cv) for r in regular}
    assert {r.payee: r.distinct_senders_7d for r in N.recent_senders(N.read_state(spark, root, days[-1]), days[-1], 7).collect()}["x"] == 4
    assert sum(u[2] for u in users.values()) == rows.count()


def test_a_night_that_broke_off_is_not_taken(spark, tmp_path):
    rows, root = log(spark, transfers(random.Random(8), 60)), str(tmp_path / "s")
    N.advance(rows, root, "2023-11-20", ORDER)
    spark.range(1).write.parquet(f"{root}/version=2023-11-21/edges")
    done = shown(N.advance(rows, root, "2023-11-30", ORDER))
    assert N.versions(spark, root) == ["2023-11-20", "2023-11-30"]
    assert done == shown(N.advance(rows, str(tmp_path / "t"), "2023-11-30", ORDER))
    empty = N.advance(rows.where("amount < 0"), str(tmp_path / "u"), "2023-11-30", ORDER)
    assert shown(empty) == ({}, {})


def test_cross_session_evidence_equals_a_walk(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["hot", "hot", "b", None]), 1e9 + rnd.randint(0, 10**7) / 7, i, rnd.choice([None, rnd.random()])) for i in range(300)]
    frame = spark.createDataFrame(rows, "u string, at double, id long, v double").withColumn(
        "ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))
    )
    found = {r.id: r.cross_session for r in U.cross_session_evidence(frame, "u", ["ts", "id"], "v", 2.0).collect()}
    for u, at, i, _ in rows:
        earlier = [(t, v or 0.0) for w, t, j, v in rows if w == u and (t, j) < (at, i)]
        assert found[i] == pytest.approx(sum(v * math.exp(-(at - t) / 86_400 / 2) for t, v in earlier), rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("nightly", [False, True])
def test_refusals_count_trust_and_budget(spark, nightly):
    start = spark.createDataFrame([("u", [0.0], [1.0])], "k string, centre array<double>, dispersion array<double>")
    day = 1_700_006_400.0
    rows = [("u", day + 3600.0 * i, i, 0.6, [0.1 if i < 5 else 50.0]) for i in range(13)]
    frame = spark.createDataFrame(rows, "k string, at double, event_id long, tau double, x array<double>")
    frame = frame.withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    settings = A.Settings(every=5, buffer=5, budget=1.0, nightly=nightly)
    epochs = A.re_anchor(A.epoch_candidates(frame, ["k"], ["ts", "event_id"], "x", settings), ["k"], start, settings)
    bounded = A.bounded_updates(frame, epochs, ["k"], ["ts", "event_id"], settings)
    # The first five stay within the budget; the next five do not, nor do the last three, whom only a night takes up.
    assert sorted(r.event_id for r in bounded.collect()) == [*range(5, 13 if nightly else 10)]
    low = spark.createDataFrame([("u", 0.1, 1.0, 1.0, 1.0), ("u", 0.0, 0.0, 1.0, 1.0)], "k string, tau double, c_stability double, c_device double, c_txn double")
    counted = {r.reason: r.rejected for r in trust.rejected_updates(low, "k", bounded=bounded).collect()}
    assert counted == {"low trust": 1, "recent change": 1, trust.SATURATED: 8 if nightly else 5}


def test_a_night_writes_its_day_only_and_chains_are_bounded(spark, tmp_path):
    rows, root = log(spark, transfers(random.Random(10))), str(tmp_path / "s")
    days = [f"2023-11-{d}" for d in range(14, 28)]
    for day in days:
        N.advance(rows, root, day, ORDER)
    chains = [N.chain(spark, root, day) for day in days]
    assert max(map(len, chains)) == N.CHAIN and all(c[-1] == day for c, day in zip(chains, days))
    # An increment counts the transfers of its day; a whole version all until then.
    of_day = {str(r.d): r.n for r in rows.groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n")).collect()}
    for day, parts in zip(days[1:], chains[1:]):
        written = spark.read.parquet(f"{root}/version={day}/edges").agg(F.sum("txn_count")).first()[0] or 0
        wanted = of_day.get(day, 0) if len(parts) > 1 else sum(n for d, n in of_day.items() if d <= day or d == "None")
        assert written == wanted
    # A version that is run later for a day in between is not part of a state that does not follow it.
    N.advance(rows, str(tmp_path / "gap"), days[0], ORDER)
    late = shown(N.advance(rows, str(tmp_path / "gap"), days[9], ORDER))
    N.advance(rows, str(tmp_path / "gap"), days[4], ORDER)
    assert shown(N.read_state(spark, str(tmp_path / "gap"), days[9])) == late
