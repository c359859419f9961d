"""Ordered sums and quantiles keep rows with nulls and NaN."""

import math

import pytest
from pyspark.sql import functions as F

from cadentia.operators import fusion as U
from cadentia.operators import adaptation as A
from cadentia.operators.outcomes import friction_rate
from cadentia.plans.ordered import running, trailing
from cadentia.plans.quantiles import exact_quantiles

ROWS = [("a", 1, 5.0), ("a", 2, None), ("a", None, 2.0), (None, 1, 3.0), (None, 9, 4.0), ("b", 1, None), ("a", 30, 1.0)]


def test_running_keeps_null_keys_times_and_values(spark):
    rows = spark.createDataFrame(ROWS, "k string, t long, x double")
    done = running(rows, ["k"], ["t"], F.floor(F.col("t") / 10), totals={"s": "x"}, previous={"p": "x"})
    got = {(r.k, r.t): (r.s, r.p) for r in done.collect()}
    assert got == {
        ("a", None): (2.0, None), ("a", 1): (7.0, 2.0), ("a", 2): (7.0, 5.0), ("a", 30): (8.0, 5.0),
        (None, 1): (3.0, None), (None, 9): (7.0, 3.0), ("b", 1): (None, None),
    }


def test_trailing_keeps_nulls(spark):
    rows = spark.createDataFrame(ROWS, "k string, t long, x double")
    done = trailing(rows, ["k"], "t", {"x": "x"}, {"w": 20}, 10)
    got = {(r.k, r.t): r.x_w for r in done.collect()}
    assert got == {("a", None): 2.0, ("a", 1): 5.0, ("a", 2): 5.0, ("a", 30): 1.0, (None, 1): 3.0, (None, 9): 7.0, ("b", 1): None}


def test_quantiles_put_nan_last_and_keep_null_keys(spark):
    rows = [("a", x) for x in (0.5, 1.0, 2.0, 3.0, math.nan)] + [(None, 4.0), (None, 6.0), ("a", None)]
    found = exact_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", {"mid": 0.5, "top": 1.0})
    got = {r.k: (r.mid, r.top) for r in found.collect()}
    assert got["a"][0] == 2.0 and math.isnan(got["a"][1]) and got[None] == (5.0, 6.0)


def test_no_nested_loop_without_an_explicit_broadcast(spark):
    rows = spark.createDataFrame([(i % 2, float(i)) for i in range(40)], "label int, score double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = friction_rate(rows, "label", "score", 0.5)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and found.first().genuine == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_profile_in_force_keeps_to_the_budget(spark):
    start = spark.createDataFrame([("u", [0.0, 0.0], [1.0, 1.0])], "k string, centre array<double>, dispersion array<double>")
    steps = [("u", e, [3.0 * e, 0.0], [1.0, 1.0], 100 * e, 0) for e in range(1, 6)]
    epochs = spark.createDataFrame(
        steps, "k string, epoch long, centre array<double>, spread array<double>, epoch_end long, full_trust int"
    )
    walked = A.re_anchor(epochs, ["k"], start, A.Settings(budget=0.5)).collect()
    assert all(r.displacement <= 0.5 and r.moved <= 0.5 + 1e-9 and r.saturated == 1 for r in walked)
    with pytest.raises(ValueError, match="P9"):
        sessions = spark.createDataFrame([("u", 1, [0.0, 0.0], 1.0)], "k string, t long, x array<double>, tau double")
        A.eer_by_intensity(sessions, ["k"], ["t"], start, "x", F.lit(0), [1.0], policy="P9")


def test_session_context_keeps_sessions_and_moves_them_for_devices_edges_and_payees_only(spark):
    rows = [(1, "u", "d", "p"), (2, "u", None, "p"), (3, "u", "other", None), (4, None, "d", "p"), (5, "w", "d", "q"), (6, "u", "d", "p")]
    sessions = spark.createDataFrame(rows, "pad long, user string, device string, payee string")
    profiles = spark.createDataFrame([("u", "d", 1.0)], "user string, device string, centre double")
    devices = spark.createDataFrame([("u", "d", 2), ("w", "d", 1)], "user string, device string, seen int")
    edges = spark.createDataFrame([("u", "p", 7)], "user string, payee string, txn int")
    payees = spark.createDataFrame([("p", 3)], "payee string, senders int")
    users = spark.createDataFrame([("u", 9.0)], "user string, largest double")
    out = U.session_context(sessions, profiles, devices, edges, payees, users)
    names = ["pad", "centre", "seen", "txn", "senders", "largest", "has_profile", "has_device", "has_edge", "has_payee", "has_user"]
    assert sorted(map(tuple, out.select(*names).collect())) == [
        (1, 1.0, 2, 7, 3, 9.0, 1, 1, 1, 1, 1), (2, None, None, 7, 3, 9.0, 0, 0, 1, 1, 1), (3, None, None, None, None, 9.0, 0, 0, 0, 0, 1),
        (4, None, None, None, 3, None, 0, 0, 0, 1, 0), (5, None, 1, None, None, None, 0, 1, 0, 0, 0), (6, 1.0, 2, 7, 3, 9.0, 1, 1, 1, 1, 1),
    ]

    def joins(node):
        below = sum(joins(node.children().apply(i)) for i in range(node.children().size()))
        return below + (node.nodeName() == "Join" and "pad#" in node.output().toString())

    assert joins(out._jdf.queryExecution().optimizedPlan()) == 3
