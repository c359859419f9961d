"""Composed recursions, nightly epochs and refused vectors against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadentia.operators import adaptation as A
from cadentia.operators import evaluation as E
from cadentia.operators import profiles as P
from cadentia.plans.affine import affine_scan

SESSIONS = "k string, ts timestamp, event_id long, tau double, x array<double>"


def moment(seconds):
    return F.timestamp_micros((seconds * 1_000_000).cast("long"))


def sessions(spark, rows):
    frame = spark.createDataFrame(rows, "k string, at double, event_id long, tau double, x array<double>")
    return frame.select("k", moment(F.col("at")).alias("ts"), "event_id", "tau", "x")


@pytest.mark.parametrize("fan", [2, 16])
def test_affine_scan_equals_a_walk(spark, fan):
    rnd = random.Random(4)
    rows = []
    for key, n in (("hot", 700), ("a", 1), (None, 40), ("b", 16), ("c", 17)):
        for i in range(1, n + 1):
            gain = None if rnd.random() < 0.3 else [rnd.gauss(0, 1), rnd.gauss(0, 1)]
            rows.append((key, i, 1.0 if gain is None else 0.9, gain, f"{key}-{i}"))
    frame = spark.createDataFrame(rows, "k string, n long, keep double, gain array<double>, before_ string")
    found = affine_scan(frame, ["k"], "n", F.col("keep"), F.col("gain"), fan).collect()
    got = {r.before_: (r.before.keep, r.before.gain) for r in found}
    assert len(found) == len(rows)
    state = {}
    for key, _, keep, gain, name in rows:
        kept, moved = state.get(key, (1.0, np.zeros(2)))
        assert got[name][0] == pytest.approx(kept) and np.allclose(got[name][1] or np.zeros(2), moved)
        state[key] = (kept * keep, keep * moved + np.asarray(gain or [0.0, 0.0]))
    assert affine_scan(frame.where("n < 0"), ["k"], "n", F.col("keep"), F.col("gain")).count() == 0


def test_trusted_replay_equals_a_walk(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("uvw"), 1e9 + 4000.0 * i, i, rnd.choice([0.3, 0.6, 1.0]), [rnd.gauss(0, 1), rnd.gauss(3, 1)]) for i in range(300)]
    start = spark.createDataFrame([(k, [0.0, 3.0], [1.0, 2.0]) for k in "uv"], "k string, centre array<double>, dispersion array<double>")
    settings = A.Settings(alpha=0.3, theta=2.0)
    found = A.ewma_replay(sessions(spark, rows), ["k"], ["ts", "event_id"], start, "x", "P2", settings).collect()
    got = {r.event_id: (r.score, r.accepted, r.updated, r.displacement) for r in found}
    centre = {k: np.array([0.0, 3.0]) for k in "uv"}
    scale, want = np.array([1.0, 2.0]), {}
    for k, _, i, tau, x in rows:
        if k == "w":
            continue
        score = float(np.abs((np.asarray(x) - centre[k]) / scale).sum())
        if tau >= 0.5:
            centre[k] = 0.7 * centre[k] + 0.3 * np.asarray(x)
        moved = float(np.abs((centre[k] - [0.0, 3.0]) / scale).mean())
        want[i] = (pytest.approx(score), int(score < 2.0), int(tau >= 0.5), pytest.approx(moved))
    assert got == want


def walked_epochs(rows, every, size):
    """Epochs of one key in order: members, new ones and end, with a night behind every day that admits somebody."""
    buffer, fresh, out, day = [], [], [], None
    for at, event in rows:
        today = int(at // 86_400)
        if fresh and today > day:
            out.append((buffer[-size:], list(fresh), (day + 1) * 86_400))
            fresh = []
        buffer.append(event)
        fresh.append(event)
        day = today
        if len(fresh) == every:
            out.append((buffer[-size:], list(fresh), int(at)))
            fresh = []
    return out + ([(buffer[-size:], fresh, (day + 1) * 86_400)] if fresh else [])


@pytest.mark.parametrize(("every", "size"), [(1, 4), (3, 5), (4, 2), (50, 200)])
def test_nightly_epochs_equal_a_walk(spark, every, size):
    rnd = random.Random(every)
    rows = []
    for key, n, pace in (("hot", 150, 900), ("a", 30, 30_000), ("b", 1, 1), (None, 12, 50_000)):
        at = 1_700_000_000.0
        for i in range(n):
            at += rnd.random() * 2 * pace
            rows.append((key, at, len(rows), rnd.choice([0.2, 0.5, 1.0]), [float(i)]))
    settings = A.Settings(every=every, buffer=size, nightly=True)
    frame = sessions(spark, rows)
    members = A.epoch_members(frame.where("tau >= 0.5"), ["k"], ["ts", "event_id"], "x", settings).collect()
    got = {}
    for r in members:
        kept, fresh, ends = got.setdefault((r.k, r.epoch), ([], [], set()))
        kept.append(r.admitted_no)
        fresh += [r.admitted_no] * r.newest
        ends.add(r.epoch_end)
    want, before = {}, {}
    for key in ("hot", "a", "b", None):
        mine = [(at, n) for n, (at,) in enumerate([(r[1],) for r in rows if r[0] == key and r[3] >= 0.5], 1)]
        epochs = walked_epochs(mine, every, size)
        for e, (kept, fresh, end) in enumerate(epochs, 1):
            want[key, e] = (kept, fresh, {end})
        # A session meets the epochs that closed before it.
        for r in rows:
            if r[0] == key:
                first = sum(1 for n in mine if n[0] < r[1])
                closed = [e for e, (_, fresh, end) in enumerate(epochs, 1) if fresh[-1] <= first and (end <= r[1])]
                before[r[2]] = len(closed)
    assert {k: (sorted(a), sorted(b), c) for k, (a, b, c) in got.items()} == {k: (a, [x for x in b if x in a], c) for k, (a, b, c) in want.items()}
    numbered = A.nightly_numbers(frame, ["k"], ["ts", "event_id"], settings)
    inside = F.floor((F.col("day_no") - F.col("admitted")) / every)
    assert {r.event_id: r.e for r in numbered.select("event_id", (F.col("epochs_before") + inside).alias("e")).collect()} == before


PROFILE = "k string, centre array<double>, dispersion array<double>"


@pytest.mark.parametrize("bad", [[1.0, None], [math.nan, 1.0], [1.0], [1.0, 2.0, 3.0], None])
def test_scores_refuse_broken_vectors_and_name_the_key(spark, bad):
    profile = spark.createDataFrame([("good", [0.0, 0.0], [1.0, 1.0]), ("broken", [0.0, 0.0], [1.0, 1.0])], PROFILE)
    rows = spark.createDataFrame([("good", [1.0, 2.0]), ("broken", bad)], "k string, x array<double>")
    with pytest.raises(Exception, match="broken"):
        P.anomaly_score(rows, profile, "k", "x").collect()
    assert P.anomaly_score(rows.where("k = 'good'"), profile, "k", "x").first().score == 3.0


@pytest.mark.parametrize("bad", [[1.0, None], [math.nan, 1.0], [1.0]])
def test_evaluation_refuses_broken_vectors_and_null_scores(spark, bad):
    rnd = random.Random(6)
    rows = [(s, i, [rnd.gauss(j, 1), rnd.gauss(0, 1)]) for j, s in enumerate("abc") for i in range(12)]
    whole = spark.createDataFrame(rows, "s string, i long, features array<double>")
    assert E.evaluate(whole, "s", ["i"], n_enrol=5, k=3).count() == 3
    broken = spark.createDataFrame([*rows[:-1], ("c", 11, bad)], whole.schema)
    with pytest.raises(Exception, match=r"key \(s(ubject)?\) = c"):
        E.evaluate(broken, "s", ["i"], n_enrol=5, k=3).collect()
    scores = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None)], "subject string, label int, score double")
    with pytest.raises(Exception, match="null for subject a"):
        E.equal_error_rate(scores).collect()


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_take_the_predecessor_from_the_pass_that_finds_changes(spark, monkeypatch):
    from cadentia.catalog import adapting

    monkeypatch.setattr(adapting, "materialise", lambda df, name: df)
    rows = adapting.vectors(spark, "/root/testdata/sf0.001")
    assert optimised(rows).count("Join Inner") == 1


def test_nightly_members_read_their_numbers_from_one_stored_table(spark):
    settings = A.Settings(every=2, buffer=3, nightly=True)
    rows = spark.createDataFrame([("u", f"2024-01-0{d} 0{h}:00:00", 1.0, [float(h)]) for d in (1, 2) for h in range(3)], "k string, ts string, tau double, x array<double>")
    members = A.epoch_members(rows.withColumn("ts", F.col("ts").cast("timestamp")), ["k"], ["ts"], "x", settings)
    assert "Window" not in optimised(members)
    found = {(r.epoch, r.admitted_no) for r in members.collect()}
    assert found == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 3), (3, 4), (3, 5), (4, 4), (4, 5), (4, 6)}
