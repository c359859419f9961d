"""Trust, adaptation, fusion and streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadentia.operators import adaptation as A
from cadentia.operators import fusion as U
from cadentia.operators import outcomes as D
from cadentia.operators import trust as T
from cadentia.sources import lake
from cadentia.streaming import streams as L

KEYS, ORDER = ["u", "d"], ["ts", "event_id"]


def gates(spark, rows):
    """Rows may end with the number of clean sessions; without it all prior ones were clean."""
    names = "step_up int, passkey int, enrolled int, prior_sessions int, recent_change int, txn_medium int, txn_stopped int, prior_clean int"
    full = [row if len(row) == 8 else (*row, row[3]) for row in rows]
    return T.trust_score(spark.createDataFrame(full, names)).collect()


def test_admission_truth_table(spark):
    rows = gates(spark, [
        (1, 1, 1, 10, 0, 0, 0), (1, 1, 1, 3, 0, 0, 0), (0, 1, 1, 10, 0, 0, 0), (0, 1, 1, 3, 0, 0, 0),
        (0, 0, 1, 10, 0, 0, 0), (1, 1, 1, 10, 0, 1, 0), (0, 1, 1, 10, 0, 1, 0), (1, 1, 1, 10, 1, 0, 0),
        (1, 1, 1, 10, 0, 0, 1), (1, 1, 1, 0, 0, 0, 0), (1, 1, 1, 12, 0, 0, 0, 9), (0, 1, 0, 12, 0, 0, 0),
    ])
    assert [round(r.tau, 6) for r in rows] == [1.0, 0.5, 0.6, 0.3, 0.3, 0.5, 0.3, 0.0, 0.0, 0.0, 0.5, 0.15]


def test_weiszfeld_finds_the_minimum():
    rng = np.random.default_rng(1)
    for _ in range(10):
        points, weights = rng.normal(0, 5, (9, 3)), rng.uniform(0.5, 1, 9)
        found = A.weiszfeld(points, weights, 1e-10, 5000)

        def cost(m):
            return (weights * np.linalg.norm(points - m, axis=1)).sum()

        assert all(cost(found) <= cost(found + d) + 1e-6 for d in rng.normal(0, 0.05, (50, 3)))
    heavy = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    assert A.weiszfeld(heavy, np.array([5.0, 1.0, 1.0]), 1e-9, 1000) == pytest.approx([0, 0], abs=1e-6)
    assert A.weighted_lower_median(np.array([3.0, 1.0, 2.0]), np.array([1.0, 1.0, 2.0])) == 2.0


@pytest.fixture(scope="module")
def history(spark):
    """One genuine user drifting slowly, one attacked by a steady pull from session 60 on."""
    rng = np.random.default_rng(4)
    rows = []
    for user in (1, 2):
        for i in range(160):
            pull = 0.0 if user == 1 else max(0, i - 60) * 0.05
            x = rng.normal([1.0 + pull, 2.0 + pull], 0.3)
            rows.append((user, 0, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=6 * i), i, x.tolist(), 0.6 + 0.4 * (i % 40 == 0), 1.0, int(user == 2 and i > 60)))
    frame = pd.DataFrame(rows, columns=["u", "d", "ts", "event_id", "x", "tau", "c_verify", "attack"])
    return spark.createDataFrame(frame).repartition(3).cache()


@pytest.fixture(scope="module")
def start(history):
    return A.cold_start(history, KEYS, ORDER, "x", n=20).cache()


SETTINGS = A.Settings(alpha=0.1, theta=6.0, budget=0.5, every=10, buffer=40)


def test_p1_matches_a_plain_loop(history, start):
    profile = {r.u: (np.array(r.centre), np.array(r.dispersion)) for r in start.collect()}
    got = A.ewma_replay(history, KEYS, ORDER, start, "x", "P1", SETTINGS).toPandas().sort_values(["u", "ts"])
    for user, part in history.toPandas().sort_values("ts").groupby("u"):
        centre, spread = profile[user]
        want = []
        for x in part.x:
            score = float(np.abs((np.array(x) - centre) / spread).sum())
            want.append(score)
            if score < 6.0:
                centre = 0.9 * centre + 0.1 * np.array(x)
        assert got[got.u == user].score.tolist() == pytest.approx(want)


def test_p2_replay_ends_at_the_closed_form(history, start):
    admitted = history.where(F.col("tau") >= SETTINGS.tau_min)
    final = {r.u: r.centre for r in A.ewma_profile(admitted, KEYS, ORDER, start, "x", 0.1).collect()}
    profile = {r.u: np.array(r.centre) for r in start.collect()}
    for user, part in history.toPandas().sort_values("ts").groupby("u"):
        centre = profile[user]
        for x in part.x:
            centre = 0.9 * centre + 0.1 * np.array(x)
        assert final[user] == pytest.approx(centre.tolist())


def test_budget_bounds_the_poisoned_profile(history, start):
    summary = {r.policy: r for r in A.policy_summary(
        A.replay_policies(history.where("u = 2"), KEYS, ORDER, start, "x", SETTINGS)).collect()}
    assert set(summary) == set(A.POLICIES)
    assert summary["P0"].max_displacement == 0.0
    assert summary["P2"].max_displacement > 3 * SETTINGS.budget


@pytest.mark.parametrize("triggers", [100, 1])
def test_epochs_stay_within_budget_and_stream_equals_batch(spark, history, start, tmp_path, triggers):
    admitted = history.where(F.col("tau") >= SETTINGS.tau_min)
    epochs = A.re_anchor(A.epoch_candidates(admitted, KEYS, ORDER, "x", SETTINGS), KEYS, start, SETTINGS)
    batch = epochs.toPandas().sort_values(["u", "epoch"]).reset_index(drop=True)
    assert (batch.budget_used <= SETTINGS.budget + 1e-9).all() and len(batch) == 32
    assert batch[batch.u == 2].saturated.sum() > batch[batch.u == 1].saturated.sum()
    path = str(tmp_path / "in")
    rows = history.select(*KEYS, "event_id", "ts", "x", "tau")
    # A later session of an unknown user lets the watermark pass all others.
    closing = rows.orderBy(F.desc("ts")).limit(1).withColumn("u", F.lit(99).cast(rows.schema["u"].dataType)).withColumns(
        {"ts": F.col("ts") + F.expr("INTERVAL 401 DAYS"), "tau": F.lit(1.0)})
    for part in (rows.repartition(7), closing):
        part.withColumn("at", F.unix_micros("ts") / 1e6).write.mode("append").parquet(path)
    live = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", triggers).parquet(path)
    done = L.run_to_table(L.stream_adapt(live, start, KEYS, SETTINGS, late="400 days" if triggers == 1 else "1 hour"), str(tmp_path), "out")
    stream = done.toPandas().sort_values(["u", "epoch"]).reset_index(drop=True)
    assert len(stream) == len(batch)
    assert np.allclose(np.stack(stream.centre), np.stack(batch.centre))
    assert stream.saturated.tolist() == batch.saturated.tolist()
    assert stream.re_anchored.tolist() == batch.re_anchored.tolist()


def fused(spark, rows, weights):
    cells = [(i, *map(float, z)) for i, z in enumerate(rows)]
    frame = spark.createDataFrame(cells, "id int, " + ", ".join(f"z_{c} double" for c in U.CHANNELS))
    return U.fuse_risk(frame, weights, 0.5)


def test_contributions_sum_to_the_log_odds(spark):
    weights = dict(zip(U.CHANNELS, (0.8, 0.6, 0.7, 0.4, 0.9)))
    frame = fused(spark, np.random.default_rng(0).normal(0, 2, (20, 5)).tolist(), weights)
    parts = U.risk_contributions(frame, weights, ["id"], count=5).groupBy("id").agg(F.sum("contribution").alias("s"))
    assert all(r.s == pytest.approx(r.log_odds - 0.5) for r in frame.join(parts, "id").collect())
    three = U.risk_contributions(frame, weights, ["id"]).toPandas()
    assert (three.groupby("id").size() == 3).all()


def test_behaviour_alone_never_goes_beyond_step_up(spark):
    weights = dict.fromkeys(U.CHANNELS, 1.0)
    rows = [[50.0, 0, 0, 0, 0], [50.0, 2, 0, 0, 0], [0, 50.0, 0, 0, 0], [0.0, 0, 0, 0, 0]]
    frame = fused(spark, rows, weights).withColumn("batch", F.lit(1))
    plain = {r.id: r.action for r in U.decide_action(frame).collect()}
    assert plain == {0: "step_up", 1: "block", 2: "restrict", 3: "step_up"}
    flagged = {r.id: r.action for r in U.decide_action(frame, batch_flag="batch").collect()}
    assert flagged[0] == "step_up" and flagged[2] == "block"


def test_missing_state_only_monitors(spark):
    frame = spark.createDataFrame([("block", 0.9, 0), ("block", 0.9, 1)], "action string, confidence double, has_profile int")
    assert [tuple(r)[:2] for r in U.fail_open(frame, ["has_profile"]).collect()] == [("monitor", 0.0), ("block", 0.9)]


def test_losses_stop_at_the_first_flag(spark):
    rows = [("c", "2024-01-01", 10.0, 0), ("c", "2024-01-02", 20.0, 0), ("c", "2024-01-04", 5.0, 1), ("c", "2024-01-05", 7.0, 0), ("n", "2024-01-01", 3.0, 0)]
    frame = spark.createDataFrame(rows, "k string, day string, amount double, flag int").withColumn("ts", F.to_timestamp("day"))
    got = {r.k: r for r in D.loss_before_detection(frame, ["k"], "flag").collect()}
    assert (got["c"].lost, got["c"].transfers_before, got["c"].days_to_detection) == (30.0, 2, 3.0)
    assert (got["n"].lost, got["n"].detected, got["n"].days_to_detection) == (3.0, 0, None)


def test_routing_a_batch_twice_changes_nothing(spark, tmp_path):
    frame = spark.sql(
        "SELECT 1 AS id, timestamp '2024-01-01' AS ts, 'block' AS action, 'decision.made' AS event_type "
        "UNION ALL SELECT 2, timestamp '2024-01-02', 'allow', 'stepup.verified'"
    )
    for _ in range(2):
        lake.route_events(frame, str(tmp_path), batch=4)
    counts = [spark.read.parquet(f"{tmp_path}/{t}").count() for t in ("lake", "adaptation", "alerts")]
    assert counts == [2, 1, 1]
    pruned = lake.scan_lake(spark, str(tmp_path), "2024-01-02", "2024-01-02")
    assert pruned.count() == 1
    assert "PartitionFilters: [isnotnull(date" in pruned._jdf.queryExecution().toString()


def test_a_channel_without_spread_says_nothing(spark):
    rows = spark.createDataFrame([(0.5, 1.0), (0.5, 3.0)], "flat double, wide double")
    channels = {f"{part}_{c}": F.col("wide") if c == "payee" else F.col("flat") for c in U.CHANNELS for part in "sc"}
    scored = rows.withColumns(channels)
    got = U.standardise(scored, U.channel_scales(scored)).collect()
    assert {r[f"z_{c}"] for r in got for c in U.CHANNELS if c != "payee"} == {0.0}
    assert sorted(r.z_payee for r in got) == pytest.approx([-1 / 2**0.5, 3 / 2**0.5])


def test_groups_solved_together_equal_groups_solved_alone():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 40, 300)
    points = rng.integers(0, 4, (sizes.sum(), 3)).astype(float) * rng.choice([1.0, 0.37], (sizes.sum(), 1))
    weights = rng.choice([0.5, 0.6, 1.0], sizes.sum())
    centres, spreads = A.medians_of(points, weights, sizes, A.TOLERANCE, A.MAX_ITERATIONS)
    ends = np.cumsum(sizes)
    for i, (a, b) in enumerate(zip(ends - sizes, ends)):
        alone = A.weiszfeld(points[a:b], weights[a:b], A.TOLERANCE, A.MAX_ITERATIONS)
        assert centres[i] == pytest.approx(alone, abs=1e-9)
        off = np.abs(points[a:b] - centres[i])
        assert spreads[i].tolist() == [A.weighted_lower_median(off[:, j], weights[a:b]) for j in range(3)]


def test_medians_of_keys_with_vectors_of_other_lengths(spark):
    rows = [(None, [1.0, 5.0]), (None, [1.0, 5.0]), (None, [9.0, 5.0]), ("a", [2.0])]
    frame = spark.createDataFrame([(k, x, 1.0) for k, x in rows], "k string, x array<double>, weight double")
    got = {r.k: (r.centre, r.spread, r.members) for r in A.geometric_median(frame.coalesce(1), ["k"], "x").collect()}
    assert got == {None: (pytest.approx([1.0, 5.0], abs=1e-5), pytest.approx([0.0, 0.0], abs=1e-5), 3), "a": ([2.0], [0.0], 1)}
    mixed = spark.createDataFrame([("a", [1.0], 1.0), ("a", [1.0, 2.0], 1.0)], frame.schema)
    with pytest.raises(Exception, match="different lengths"):
        A.geometric_median(mixed, ["k"], "x").collect()
