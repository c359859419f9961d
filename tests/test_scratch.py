"""Scratch scopes, expiry of lake partitions, refusals of the fit, keys without values."""

import datetime as dt
import pathlib
import time

import pytest
from pyspark.sql import functions as F

from cadentia.operators import evaluation as E
from cadentia.operators import fusion as U
from cadentia.operators import profiles as P
from cadentia.operators import sessions as S
from cadentia.plans.quantiles import exact_quantiles
from cadentia.session import DROP_SHUFFLES, materialise, scratch_path, scratch_scope
from cadentia.sources import lake


def test_scope_deletes_its_own_tables_only(spark):
    outer = materialise(spark.range(5), "outer")
    with scratch_scope(spark):
        inner = materialise(spark.range(3), "inner")
        with scratch_scope(spark):
            nested = materialise(spark.range(2), "nested")
        assert inner.count() == 3
        folders = [pathlib.Path(f.removeprefix("file:")).parent for t in (outer, inner, nested) for f in t.inputFiles()[:1]]
        assert [f.exists() for f in folders] == [True, True, False]
    assert [f.exists() for f in folders] == [True, False, False]


def test_expired_dates_are_deleted(spark):
    root = scratch_path(spark, "lake-test")
    stamps = [dt.datetime(2024, 1, d, 12) for d in (1, 2, 20)]
    rows = spark.createDataFrame([("decision.made", "allow", t) for t in stamps], "event_type string, action string, ts timestamp")
    lake.route_events(rows, root, 3)
    lake.route_events(rows, root, 3)
    assert lake.scan_lake(spark, root).count() == 3
    assert lake.expire(spark, root, "decision", "2024-02-01") == ["2024-01-01"]
    assert lake.scan_lake(spark, root).count() == 2
    assert lake.expire(spark, root, "decision", "2024-02-01") == []


VECTORS = "k string, v array<double>"


@pytest.mark.parametrize("bad", [[1.0, None], [1.0, float("nan")], None, [1.0]])
def test_fit_refuses_and_names_the_key(spark, bad):
    rows = spark.createDataFrame([("u7", [1.0, 2.0]), ("u7", bad), ("u8", [1.0, 2.0])], VECTORS)
    with pytest.raises(Exception, match="u7"):
        P.fit_profiles(rows, "k", "v").collect()


def test_score_refuses_other_lengths(spark):
    fitted = P.fit_profiles(spark.createDataFrame([("u7", [1.0, 2.0]), ("u7", [2.0, 5.0])], VECTORS), "k", "v")
    with pytest.raises(Exception, match="u7"):
        P.anomaly_score(spark.createDataFrame([("u7", [1.0])], VECTORS), fitted, "k", "v").collect()


def test_keys_without_values_have_null_quantiles(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), (None, None)], "k string, x double")
    got = {r.k: r.m for r in exact_quantiles(rows, ["k"], "x", {"m": 0.5}).collect()}
    assert got == {"a": 1.0, "b": None, None: None}


def test_both_scalings_from_one_run_equal_single_runs(spark):
    rows = spark.range(240).select(
        (F.col("id") % 4).alias("who"), F.col("id").alias("at"),
        F.array(F.sin(F.col("id")), F.cos(F.col("id") * (1 + F.col("id") % 4))).alias("features"),
    )
    both = {r.subject: (r.eer_mad, r.eer_std) for r in E.evaluate_scalings(rows, "who", ["at"], n_enrol=20, k=3).collect()}
    for place, scaling in enumerate(P.SCALINGS):
        one = E.evaluate(rows, "who", ["at"], scaling=scaling, n_enrol=20, k=3).collect()
        assert len(one) == 4
        for r in one:
            assert both[r.subject][place] == pytest.approx(r.eer)


def test_two_groups_of_sessions_are_told_from_one(spark):
    rows = [("two", i, float(i % 2) * 9 + i / 100, 1.0) for i in range(20)]
    rows += [("flat", i, 4.0, 2.0) for i in range(5)] + [("lone", 0, 1.0, 1.0), (None, 1, 2.0, None)]
    found = S.session_clusters(spark.createDataFrame(rows, "u string, s int, a double, b double"), "u", "s", ["a", "b"])
    got = {r.u: (r.sessions, r.minor_share, r.separation) for r in found.collect()}
    assert got["two"][:2] == (20, 0.5) and got["two"][2] > 20
    assert got["flat"] == (5, 0.0, None) and got["lone"] == (1, 0.0, None) and got[None][0] == 1


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {line for line in files.split("\n") if "/shuffle_" in line}


def test_shuffles_of_a_stored_frame_are_dropped(spark, tmp_path):
    before = shuffle_files(spark)
    rows = spark.range(20_000).groupBy((F.col("id") % 97).alias("k")).agg(F.sum("id").alias("x"))
    tables = [materialise(rows, "sums"), spark.read.parquet(lake.publish_features(rows, str(tmp_path / "p"), "2000-01-01", ["k"]))]
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert [t.count() for t in tables] == [97, 97]
    assert spark.conf.get(DROP_SHUFFLES, "false") == "false"
    # A frame that was stored can be read again all the same.
    assert rows.count() == len(rows.collect()) == 97
