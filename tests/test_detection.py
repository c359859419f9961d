"""Profiles, scores and error rates against values worked out by hand or analytically."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadentia.operators import checks as C
from cadentia.operators import evaluation as E
from cadentia.operators import profiles as P
from cadentia.operators import splits as S
from cadentia.sources import files as files_source
from cadentia.sources import observations as O

# Four rows over three features; the middle one never varies.
ENROLMENT = [("p", [2.0, 7.0, -1.0]), ("p", [4.0, 7.0, -3.0]), ("p", [6.0, 7.0, 1.0]), ("p", [8.0, 7.0, 3.0])]
VECTORS = "subject string, features array<double>"
FEATURES = ["left", "still", "right"]


@pytest.fixture
def enrolment(spark):
    return spark.createDataFrame(ENROLMENT, VECTORS)


@pytest.fixture
def profile(enrolment):
    return P.fit_profiles(enrolment, "subject")


def sessions(spark, *rows):
    return spark.createDataFrame([("p", list(r)) for r in rows], VECTORS)


def test_fit_by_hand(profile, enrolment):
    row = profile.first()
    assert (row.centre, row.floored_features) == ([5.0, 7.0, 0.0], 1)
    assert row.dispersion == [2.0, 1e-4, 2.0]
    spread = P.fit_profiles(enrolment, "subject", scaling="std").first().dispersion
    assert spread[0] == pytest.approx(math.sqrt(20 / 3)) and spread[0] == pytest.approx(spread[2])


def test_fit_refusals(spark, enrolment):
    assert P.fit_profiles(enrolment.limit(1), "subject").count() == 0
    with pytest.raises(ValueError, match="fewer than 2"):
        P.require_fit_rows(enrolment.limit(1), "subject")
    with pytest.raises(ValueError, match="'iqr' is none of mad, std"):
        P.fit_profiles(enrolment, "subject", scaling="iqr")
    with pytest.raises(Exception, match="row has 2 values, expects 3"):
        P.require_width(sessions(spark, [1.0, 2.0]), "features", 3).collect()
    assert P.wrong_width(sessions(spark, [1.0], [1.0, 2.0, 3.0]), "features", 3).count() == 1


def test_scores_add_up_and_ties_keep_feature_order(spark, profile):
    # Deviations 2, 1.5 and -2.
    far = sessions(spark, [9.0, 7.00015, -4.0])
    assert P.anomaly_score(far, profile, "subject").first().score == pytest.approx(5.5)
    top = P.top_deviations(far, profile, "subject", FEATURES).orderBy("rank").collect()
    assert [(r.feature, round(r.deviation, 6)) for r in top] == [("left", 2.0), ("right", -2.0), ("still", 1.5)]
    assert [P.top_deviations(far, profile, "subject", FEATURES, count=n).count() for n in (0, 2, 10)] == [0, 2, 3]
    with pytest.raises(ValueError):
        P.top_deviations(far, profile, "subject", FEATURES, count=-2)
    halves = P.anomaly_score(sessions(spark, [9.0, 7.0, 0.0], [5.0, 7.0, -4.0]), profile, "subject").collect()
    assert sum(r.score for r in halves) == pytest.approx(4.0)


def score_frame(spark, genuine, impostor, subject="s"):
    rows = [(subject, 0, float(x)) for x in genuine] + [(subject, 1, float(x)) for x in impostor]
    return spark.createDataFrame(rows, "subject string, label int, score double")


def eer(spark, genuine, impostor):
    return E.equal_error_rate(score_frame(spark, genuine, impostor)).first().eer


def brute_eer(genuine, impostor):
    points = np.append(np.unique(np.concatenate([genuine, impostor])), np.inf)
    far = np.array([(impostor < t).mean() for t in points])
    frr = np.array([(genuine >= t).mean() for t in points])
    i = int(np.flatnonzero(far - frr >= 0)[0])
    before, after = far[i - 1] - frr[i - 1], far[i] - frr[i]
    return far[i - 1] - before / (after - before) * (far[i] - far[i - 1])


def test_eer_ignores_the_scale_and_the_partitions(spark):
    rng = np.random.default_rng(404)
    genuine, impostor = rng.gamma(2, 1, 83), rng.gamma(4, 1, 71)
    found = eer(spark, genuine, impostor)
    assert eer(spark, np.exp(genuine), np.exp(impostor)) == pytest.approx(found, abs=1e-9)
    split = score_frame(spark, genuine, impostor).repartition(5)
    assert E.equal_error_rate(split).first().eer == pytest.approx(found, abs=1e-9)
    # With the labels exchanged, every threshold that was right is wrong.
    assert eer(spark, impostor, genuine) == pytest.approx(1 - found, abs=2 / 71)


def test_eer_of_two_exponentials(spark):
    # With y = exp(-t / 3) the rates cross where y ** 3 + y = 1.
    y = float(np.roots([1, 0, 1, -1]).real[np.isreal(np.roots([1, 0, 1, -1]))][0])
    rng = np.random.default_rng(61)
    found = eer(spark, rng.exponential(1, 30_000), rng.exponential(3, 30_000))
    assert found == pytest.approx(1 - y, abs=0.01)


def test_eer_with_many_ties_equals_brute_force(spark):
    rng = np.random.default_rng(1812)
    frames, want = None, {}
    for i in range(12):
        genuine, impostor = rng.integers(0, 9 + i, 60 + i), rng.integers(i % 5, 14, 90)
        want[f"t{i}"] = brute_eer(genuine.astype(float), impostor.astype(float))
        one = score_frame(spark, genuine, impostor, f"t{i}")
        frames = one if frames is None else frames.unionByName(one)
    got = {r.subject: r.eer for r in E.equal_error_rate(frames).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_curve_runs_from_all_rejected_to_all_accepted(spark):
    rng = np.random.default_rng(5150)
    curve = E.error_curve(score_frame(spark, rng.gamma(2, 1, 150), rng.gamma(5, 1, 170)))
    rows = curve.orderBy("threshold").collect()
    steps = [(b.far - a.far, a.frr - b.frr) for a, b in zip(rows, rows[1:])]
    assert all(x >= 0 and y >= 0 for x, y in steps) and len(rows) == 321
    assert (rows[0].far, rows[0].frr, rows[-1].far, rows[-1].frr) == (0.0, 1.0, 1.0, 0.0)
    assert math.isinf(rows[-1].threshold)
    at = E.rates_at_threshold(curve, 2.5).first()
    assert min(abs(r.threshold - 2.5) for r in rows) == pytest.approx(abs(at.threshold - 2.5))


@pytest.mark.parametrize("genuine,impostor", [([], [1.0]), ([1.0], [])])
def test_empty_class_is_refused(spark, genuine, impostor):
    for operator in (E.equal_error_rate, E.error_curve):
        with pytest.raises(Exception, match="one of the two labels has no score"):
            operator(score_frame(spark, genuine, impostor)).collect()


NAMES = ["H.t", "DD.t.i", "UD.t.i"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Small timing file with dotted names, shuffled on disk, negative up-down times."""
    rows = [
        (f"k{u}", s, r, round(0.1 + u / 50 + (7 * r + s) % 11 / 400, 4), round(0.3 + (5 * r + u) % 7 / 300, 4),
         round(-0.05 + (3 * r + 2 * s + u) % 13 / 500, 4))
        for u in range(6) for s in (1, 2) for r in range(1, 11)
    ]
    rows.sort(key=lambda row: row[2] * 7919 % 101 + row[3])
    schema = O.timing_schema(NAMES)
    frame = spark.createDataFrame(rows, schema)
    path = str(tmp_path_factory.mktemp("corpus") / "csv")
    O.write_table(frame, path)
    return O.read_observations(spark, path, schema)


def test_corpus_contract(corpus):
    names = O.feature_columns(corpus)
    assert names == NAMES
    assert corpus.where(F.col("`UD.t.i`") < 0).count() > 0
    wanted = C.Expectations(subjects=6, rows=120, features=3, rows_per_subject=20)
    assert C.verify_dataset(corpus, "subject", names, wanted).where(~F.col("ok")).count() == 0
    with pytest.raises(ValueError, match="expected 51 subjects, found 6"):
        C.require_dataset(corpus, "subject", names, C.Expectations())
    assert C.uneven_subjects(corpus, "subject", 20).count() == 0
    assert {r.nulls for r in C.null_audit(corpus).collect()} == {0}
    assert O.select_features(corpus, ["subject"], []).columns == ["subject", *NAMES]
    assert O.select_features(corpus, ["subject"], ["H.t"]).columns == ["subject", "H.t"]


def test_protocol_on_the_corpus(spark, corpus):
    order = ["sessionIndex", "rep"]
    packed = O.pack_vector(corpus, ["subject", *order], NAMES)
    split = S.enrolment_split(packed, "subject", order, 10)
    roles = split.groupBy("subject", "role").count().collect()
    assert len(roles) == 12 and {r["count"] for r in roles} == {10}
    sessions_of = {(r.role, r.sessionIndex) for r in split.select("role", "sessionIndex").distinct().collect()}
    assert sessions_of == {("enrolment", 1), ("genuine", 2)}
    assert S.split_overlap(split, "features").count() == 0
    heads = S.head_per_subject(packed, "subject", order, 5)
    profiles = P.fit_profiles(split.where("role = 'enrolment'"), "subject")
    pairs = E.impostor_pairs(heads, profiles, "subject")
    assert pairs.count() == 6 * 5 * 5
    assert pairs.where("subject = impostor").count() == 0
    eers = E.evaluate(packed, "subject", order, n_enrol=10, k=5)
    again = E.evaluate(packed.repartition(7), "subject", order, n_enrol=10, k=5)
    assert sorted(eers.collect()) == sorted(again.collect())
    assert E.eer_summary(eers).first().subjects == 6
    with pytest.raises(ValueError, match="more than 20 are needed"):
        S.require_repetitions(packed, "subject", 20)
    assert S.insufficient_subjects(packed, "subject", 20).count() == 6


def test_missing_source_is_named(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        O.read_observations(spark, "/tmp/no/such/file", O.timing_schema(NAMES)).collect()


def test_swapped_header_and_bad_cell_are_refused(spark, tmp_path):
    schema = O.timing_schema(["H.t", "DD.t"])
    (tmp_path / "swapped.csv").write_text("subject,sessionIndex,rep,DD.t,H.t\na,1,1,0.2,0.1\n")
    (tmp_path / "bad.csv").write_text("subject,sessionIndex,rep,H.t,DD.t\na,1,1,oops,0.1\n")
    for name in ("swapped.csv", "bad.csv"):
        with pytest.raises(Exception):
            O.read_observations(spark, str(tmp_path / name), schema).collect()


def test_rejected_rows_name_the_feature(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, 1.0, float("nan"))], "id int, a double, b double")
    got = {r.id: r.reason for r in C.rejected_rows(rows, ["id"], ["a", "b"]).collect()}
    assert got == {2: "a is null", 3: "b is not finite"}


def test_files_against_manifest(spark, tmp_path):
    for name, text in (("good", "abc"), ("short", "ab"), ("wrong", "abd"), ("extra", "x")):
        (tmp_path / name).write_text(text)
    good = files_source.file_digests(spark, str(tmp_path)).where("file = 'good'").first()
    manifest = spark.createDataFrame(
        [(n, good.bytes, good.sha256) for n in ("good", "short", "wrong", "gone")], "file string, bytes long, sha256 string"
    )
    got = {r.file: r.status for r in files_source.verify_files(spark, str(tmp_path), manifest).collect()}
    assert got == {"good": "ok", "short": "size mismatch", "wrong": "checksum mismatch", "extra": "unexpected", "gone": "missing"}
