import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from windowlab.operators import reshape

TALL = "scenario string, run string, y int, Metric string, Value double, StartTime double, EndTime double, Duration double"


def test_widen_means_absent_nan_and_duration(spark):
    nan = float("nan")
    t = spark.createDataFrame([
        ("b", "r1", 0, "a", 1.0, 0.0, 40.0, None), ("b", "r1", 0, "a", 3.0, 0.0, 42.0, None), ("b", "r1", 0, "a", nan, 0.0, 41.0, None),
        ("b", "r10", 1, "c", None, None, None, None), ("b", "r2", 1, "a", 5.0, 1.0, 2.0, 7.0),
    ], TALL)
    w = {r["run"]: r for r in reshape.widen(t, ["scenario", "run"], ["a", "c", "z"], label="y", timing=True, temporal=True).collect()}
    assert (w["r1"]["a"], w["r1"]["c"], w["r1"]["z"]) == (2.0, 0.0, 0.0)
    assert w["r1"]["_measurement_duration"] == 41.0 and w["r10"]["_measurement_duration"] == 40.0 and w["r2"]["_measurement_duration"] == 7.0
    assert w["r2"]["Duration_std"] == 0.0 and w["r1"]["TimeRange"] == 42.0 and w["r10"]["y"] == 1


def test_two_labels_in_a_window_raise(spark):
    t = spark.createDataFrame([("b", "r", 0, "a", 1.0, 0.0, 1.0, 1.0), ("b", "r", 1, "a", 1.0, 0.0, 1.0, 1.0)], TALL)
    with pytest.raises(PySparkException):
        reshape.widen(t, ["run"], ["a"], label="y").collect()


def test_melt_keeps_nulls_and_round_trip(spark):
    w = spark.createDataFrame([("r", 1.0, None)], "run string, a double, b double")
    assert {(r["Metric"], r["Value"]) for r in reshape.melt(w, ["run"], ["a", "b"]).collect()} == {("a", 1.0), ("b", None)}


def test_clean_project_and_checks(spark):
    w = spark.createDataFrame([(float("inf"), float("nan"), None, 2.0)], "a double, b double, c double, d double")
    assert tuple(reshape.clean_columns(w, ["a", "b", "c", "d"]).first()) == (0.0, 0.0, 0.0, 2.0)
    assert reshape.project_set(w, [], ["d", "CDR"]).first().asDict() == {"d": 2.0, "CDR": 0.0}
    with pytest.raises(ValueError):
        reshape.require_columns(w, ["zz"])
    with pytest.raises(ValueError):
        reshape.require_same_schema(w, w.drop("a"))


def test_sample_runs(spark):
    d = spark.range(100).withColumn("run", F.col("id") % 10)
    kept = reshape.sample_runs(d, "run", 4, 1)
    assert kept.select("run").distinct().count() == 4 and kept.count() == 40
    with pytest.raises(PySparkException):
        reshape.sample_runs(d, "run", 11, 1).collect()


def test_membership_and_disjoint(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "f string") for s in ("abc", "bcd"))
    got = {r["f"]: r["side"] for r in reshape.membership(a, b, "f").collect()}
    assert got == {"a": "only_left", "b": "both", "c": "both", "d": "only_right"}
    d = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "k int, p string")
    with pytest.raises(ValueError):
        reshape.assert_disjoint(d, "k", "p")
    assert reshape.assert_disjoint(d.where("k = 2"), "k", "p").count() == 1
