"""Fits of the risk model: stationary weights, exact isotonic curves, tiers and one user's decisions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadentia.operators import fusion as U
from cadentia.operators import outcomes as D
from cadentia.plans.isotonic import isotonic_blocks, isotonic_values
from cadentia.session import materialise


def pooled(points):
    """Pool adjacent violators over (score, label) rows, one after the other."""
    by_score = {}
    for x, y in points:
        total, n = by_score.get(x, (0.0, 0))
        by_score[x] = (total + y, n + 1)
    stack = []
    for x in sorted(by_score):
        lo, hi, total, n = x, x, *by_score[x]
        while stack and stack[-1][2] / stack[-1][3] >= total / n:
            a, _, t, m = stack.pop()
            lo, total, n = a, total + t, n + m
        stack.append((lo, hi, total, n))
    return [(lo, hi, total / n, n) for lo, hi, total, n in stack]


def value_at(blocks, x):
    lower = [b for b in blocks if b[0] <= x]
    upper = [b for b in blocks if b[0] >= x]
    if not lower:
        return upper[0][2]
    if not upper or x <= lower[-1][1]:
        return lower[-1][2]
    return lower[-1][2] + (x - lower[-1][1]) / (upper[0][0] - lower[-1][1]) * (upper[0][2] - lower[-1][2])


def test_isotonic_fit_is_exact(spark):
    rnd = random.Random(1)
    rows = [(round(rnd.gauss(0, 2), rnd.choice([0, 2, 9])),) for _ in range(3000)]
    rows = [(x, int(rnd.random() < 1 / (1 + math.exp(-x)))) for (x,) in rows]
    odd = [(None, 1), (math.nan, 1), (0.5, None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows + odd)], "id long, score double, label int").repartition(7)
    want = pooled(rows)
    found = sorted(tuple(r) for r in isotonic_blocks(frame, "score", "label").collect())
    assert [(a, b, pytest.approx(v), n) for a, b, v, n in found] == want and len(want) > 10
    asked = [(i, x) for i, x in enumerate([-99.0, 99.0, 0.0, want[3][1], want[4][0], None, math.nan, *[rnd.gauss(0, 2) for _ in range(200)]])]
    scored = spark.createDataFrame(asked, "id long, score double").withColumn("calibrated_", F.lit(1))
    got = {r.id: r.calibrated for r in U.calibrate(frame, scored, "score", "label", "isotonic").collect()}
    for i, x in asked:
        assert got[i] is None if x is None or math.isnan(x) else got[i] == pytest.approx(value_at(want, x))
    none = U.calibrate(frame.where("id < 0"), scored, "score", "label", "isotonic").collect()
    assert len(none) == len(asked) and {r.calibrated for r in none} == {None}


def test_isotonic_extremes(spark):
    rising = [(float(i), int(i >= 50)) for i in range(100)]
    falling = [(float(i), int(i < 50)) for i in range(100)]
    for rows, blocks in ((rising, [(0.0, 49.0, 0.0, 50.0), (50.0, 99.0, 1.0, 50.0)]), (falling, [(0.0, 99.0, 0.5, 100.0)])):
        found = isotonic_blocks(spark.createDataFrame(rows, "s double, y int"), "s", "y").collect()
        assert sorted(tuple(r) for r in found) == blocks
    with pytest.raises(ValueError, match="platt"):
        U.calibrate(spark.range(1), spark.range(1), "id", "id", "linear")


def test_fusion_fit_has_gradient_zero(spark):
    rnd = random.Random(2)
    rows = []
    for _ in range(2000):
        z = [rnd.gauss(0, 1) for _ in U.CHANNELS]
        odds = -0.4 + 0.8 * z[0] - 0.5 * z[1] + 0.3 * z[2] + 0.1 * z[4]
        rows.append((*z, int(rnd.random() < 1 / (1 + math.exp(-odds)))))
    names = ", ".join(f"z_{c} double" for c in U.CHANNELS)
    weights, intercept = U.fit_fusion(spark.createDataFrame(rows, f"{names}, label int"), "label")
    z, y = np.array([r[:-1] for r in rows]), np.array([r[-1] for r in rows])
    p = 1 / (1 + np.exp(-(intercept + z @ np.array([weights[c] for c in U.CHANNELS]))))
    gradient = np.append((p - y) @ z, (p - y).sum()) / len(y)
    assert np.abs(gradient).max() < 1e-4
    assert weights["behaviour"] > 0.5 > 0 > weights["automation"]


def test_calibrated_tiers_and_one_user(spark):
    rows = spark.createDataFrame([(0.1,), (0.25,), (0.5,), (0.9,)], "calibrated double")
    assert [r.tier for r in U.risk_tier(rows).orderBy("calibrated").collect()] == [1, 2, 3, 4]
    log = spark.createDataFrame([("u", 2, 1, "allow"), ("u", 1, 2, "block"), ("w", 0, 3, "allow"), (None, 5, 4, "allow")], "u string, ts long, id long, action string")
    assert [r.id for r in D.user_timeline(log, "u", "id", one="u").collect()] == [2, 1]
    assert [r.id for r in D.user_timeline(log, "u", "id").collect()] == [4, 2, 1, 3]


def test_scores_meet_both_neighbours_in_two_reads(spark):
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate([-5, 0, 1, 2, 3, 4, 9])], "id long, score_x double")
    blocks = spark.createDataFrame([(0.0, 1.0, 0.25, 2.0), (3.0, 3.0, 0.5, 1.0), (4.0, 5.0, 1.0, 3.0)], "lo double, hi double, value double, weight double")
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    found = isotonic_values(rows.mapInPandas(passed, rows.schema), blocks, "score_x", "y").collect()
    assert {r.score_x: r.y for r in found} == {-5: 0.25, 0: 0.25, 1: 0.25, 2: 0.375, 3: 0.5, 4: 1.0, 9: 1.0}
    assert seen.value <= 2 * 7


@pytest.mark.parametrize("rows, seed", [(600, 7), (26_000, 3)])
def test_boosted_scores_are_those_of_sparks_trees(spark, rows, seed):
    """With all rows as split candidates and with a sample of them; a sample may give a bin more than asked for."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    rnd = np.random.default_rng(seed)
    cells = {f"z_{c}": rnd.normal(size=rows).round(2 + i) * (rnd.random(rows) < 0.7 + 0.05 * i) for i, c in enumerate(U.CHANNELS)}
    lift = cells["z_behaviour"] * cells["z_payee"] + cells["z_context"]
    table = pd.DataFrame({"id": np.arange(rows), "label": (lift + rnd.normal(size=rows) > 0.8).astype(int), **cells})
    stored = materialise(spark.createDataFrame(table), "boosting")
    training, scored = stored.where("id % 3 > 0"), stored.where("id % 3 = 0")
    model = GBTClassifier(maxIter=6, maxDepth=3, seed=seed).fit(U._assembled(training, "label"))
    wanted = model.transform(U._assembled(scored, "label")).select("id", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
    want = dict(wanted.collect())
    found = U.boosted_scores(training, scored, "label", seed=seed, rounds=6)
    assert found.columns == [*scored.columns, "boosted"] and dict(found.dtypes)["label"] == "double"
    got = {r.id: r.boosted for r in found.collect()}
    assert got.keys() == want.keys() and len(set(want.values())) > 20
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_boosted_trees_hold_cells_and_no_rows(spark, monkeypatch):
    """Rows of the same bins and label are one cell: what is read in every pass does not grow with the rows."""
    from cadentia.plans import boosted as B

    rnd = np.random.default_rng(1)
    table = pd.DataFrame({"label": rnd.integers(0, 2, 400), **{f"z_{c}": rnd.integers(0, 2, 400) / 1.0 for c in U.CHANNELS}})
    seen = []
    packed = B.packed_cells
    monkeypatch.setattr(B, "packed_cells", lambda cells, n: seen.append(cells.agg(F.count("*"), F.sum("n")).first()) or packed(cells, n))
    frame = spark.createDataFrame(table)
    U.boosted_scores(frame, frame, "label", rounds=1)
    assert seen[0][0] <= 64 and seen[0][1] == 400
    for wrong, text in ((frame.withColumn("label", F.lit(2)), "labels"), (frame.withColumn("z_payee", F.lit(float("nan"))), "NaN")):
        with pytest.raises(Exception, match=text):
            U.boosted_scores(wrong, frame, "label", rounds=1)


def test_more_sampled_rows_than_expected_give_one_more_cut():
    from cadentia.plans import boosted as B

    values = np.arange(1.0, 10_301.0)
    assert len(B._cuts(values, 10_300)) == B.BINS - 1
    assert len(B._cuts(values, 10_000)) == B.BINS
