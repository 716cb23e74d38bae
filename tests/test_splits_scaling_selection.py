import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from windowlab.operators import resample, scaling, selection, splits


@pytest.fixture(scope="module")
def windows(spark):
    # Run 0 holds a third of all rows.
    return spark.range(900).select(
        F.lit("static").alias("domain"), F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 97 + 1).cast("string").alias("run"),
        F.col("id").cast("string").alias("row_key"), (F.col("id") % 2).cast("int").alias("label"))


def test_grouped_split_sizes_and_leak(windows):
    n = windows.select("run").distinct().count()
    s = splits.split_windows(windows, ["domain"], "run", [1, 2])
    for seed in (1, 2):
        parts = {r["run"]: set() for r in windows.select("run").distinct().collect()}
        for r in s.where(F.col("seed") == seed).select("run", "part").distinct().collect():
            parts[r["run"]].add(r["part"])
        assert all(len(p) == 1 for p in parts.values())
        count = lambda x: sum(p == {x} for p in parts.values())
        test = math.ceil(0.2 * n)
        assert count("test") == test and count("val") == math.ceil(0.25 * (n - test))
    assert s.count() == 1800
    table = {(r["run"], r["seed"]): r["part"] for r in splits.grouped_split(windows, ["domain"], "run", [1, 2]).collect()}
    assert all(table[(r["run"], r["seed"])] == r["part"] for r in s.collect())


def test_stratified_and_folds(windows):
    c = splits.stratified_split(windows, ["label"], "row_key", 3).groupBy("label", "part").count().collect()
    assert {(r["label"], r["part"]): r["count"] for r in c} == {(y, p): k for y in (0, 1) for p, k in (("test", 90), ("val", 90), ("train", 270))}
    f = splits.stratified_folds(windows, ["label"], "row_key", 3).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in f} == {150}
    g = splits.grouped_folds(windows, ["domain"], "run", 3).groupBy("fold").agg(F.count(F.lit(1)).alias("c")).collect()
    assert max(r["c"] for r in g) - min(r["c"] for r in g) <= 1


def test_fewshot_sizes(windows):
    pool = windows.select("domain", "run").distinct()
    c = splits.fewshot_runs(pool, ["domain"], "run", [5, 20, 500], 3).groupBy("r", "n_runs").count().collect()
    assert {(r["r"], r["n_runs"]): r["count"] for r in c} == {(i, n): n for i in range(3) for n in (5, 20)}


def test_scalers(spark):
    x = np.round(np.random.default_rng(0).normal(size=101), 3)
    d = spark.createDataFrame([(float(v), 7.0) for v in x], "a double, k double")
    s = {r["feature"]: r for r in scaling.fit_standard(d, [], ["a", "k"]).collect()}
    assert abs(s["a"]["scale"] - x.std()) < 1e-12 and s["k"]["scale"] == 1.0
    r = {r["feature"]: r for r in scaling.fit_robust(d, [], ["a", "k"]).collect()}
    assert abs(r["a"]["centre"] - np.median(x)) < 1e-12 and abs(r["a"]["scale"] - np.subtract(*np.quantile(x, [0.75, 0.25]))) < 1e-12 and r["k"]["scale"] == 1.0
    z = [q["a"] for q in scaling.apply_scaler(d, scaling.fit_standard(d, [], ["a", "k"]), [], ["a", "k"]).collect()]
    assert abs(np.mean(z)) < 1e-12 and abs(np.std(z) - 1) < 1e-12


def test_correlation_pruning_is_not_greedy(spark):
    # a~b and b~c correlate above the cut, a and c do not: both b and c go although b is gone before c.
    rng = np.random.default_rng(3)
    a = rng.normal(size=4000)
    b = a + 0.28 * rng.normal(size=4000)
    c = b + 0.28 * rng.normal(size=4000)
    d = spark.createDataFrame([(float(i), float(j), float(k), 5.0) for i, j, k in zip(a, b, c)], "a double, b double, c double, const double")
    r = np.corrcoef([a, b, c])
    assert r[0, 1] > 0.95 and r[1, 2] > 0.95 and r[0, 2] < 0.95
    assert selection.filter_features(d, ["a", "b", "c", "const"]) == ["a"]


def test_ranks_average_ties_and_anchor(spark):
    s = spark.createDataFrame([("m", "a", 3.0), ("m", "b", 3.0), ("m", "c", 1.0)], "method string, feature string, score double")
    assert {r["feature"]: r["mean_rank"] for r in selection.aggregate_ranks(s, [], 3).collect()} == {"a": 1.5, "b": 1.5, "c": 3.0}
    ranks = spark.createDataFrame([("static", "a", 0), ("static", "b", 1), ("static", "c", 2), ("mobile", "b", 0), ("mobile", "a", 1)], "domain string, feature string, rank int")
    got = selection.anchored_top_k(ranks, ["c"], [1, 2]).collect()
    assert {(r["K"], r["feature"]) for r in got} == {(1, "c"), (2, "c"), (2, "a")}
    with pytest.raises(PySparkException):
        selection.anchored_top_k(ranks, ["c"], [4]).collect()


def test_soft_set_fills_to_k(spark):
    rows = [("m", d, s, f, v) for d in ("static", "mobile") for s in range(3) for f, v in (("a", 9.0), ("b", 5.0 if d == "static" else 1.0), ("c", 4.0 if d == "static" else 2.0))]
    imp = spark.createDataFrame(rows, "method string, domain string, seed int, feature string, importance double")
    counts = selection.stable_counts(imp, [2])
    assert {r["feature"] for r in selection.universal_set(counts, 0.8, "strict").collect()} == {"a"}
    soft = selection.universal_set(counts, 0.8, "soft").collect()
    assert {r["feature"] for r in soft} == {"a", "b"} or {r["feature"] for r in soft} == {"a", "c"}
    assert len(soft) == 2


@pytest.mark.parametrize("p", [12, 13, 24, 25])
def test_matrix_sums_with_nulls(spark, p):
    """Correlations are pairwise complete and class sums complete, at any number of features."""
    rng = np.random.default_rng(p)
    x = np.round(rng.normal(size=(300, p)) + rng.normal(size=(300, 1)), 3)
    y = rng.integers(0, 2, 300)
    x[rng.random((300, p)) < 0.02] = np.nan
    x[:, p - 1] = 5.0
    f = [f"f{i}" for i in range(p)]
    d = spark.createDataFrame([("s", int(y[k]), *[None if np.isnan(v) else float(v) for v in x[k]]) for k in range(300)], "domain string, label int, " + ", ".join(f"{c} double" for c in f)).repartition(5)
    got = {(r["i"], r["j"]): r["r"] for r in selection.correlation_pairs(d, [], f).collect()}
    for (i, j), r in got.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        if j == p - 1:
            assert r is None
        else:
            assert abs(r - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9
    sums = {r["label"]: np.asarray(r["sums"]) for r in resample.full_grams(d, f, "label", "domain").collect()}
    full = ~np.isnan(x).any(1)
    for c in (0, 1):
        z = x[full & (y == c)]
        assert np.allclose(sums[c], np.concatenate([[len(z)], z.sum(0), (z.T @ z)[np.triu_indices(p)]]))


def test_wide_correlation_and_sketched_information(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 2000)
    x = np.round(rng.normal(size=(2000, 4)) + 1e4 + 0.7 * y[:, None], 3)
    d = spark.createDataFrame([("s" if i % 2 else "m", int(y[i]), *map(float, x[i])) for i in range(2000)], "domain string, y int, a double, b double, c double, e double")
    f = ["a", "b", "c", "e"]
    got = {(r["domain"], r["i"], r["j"]): r["r"] for r in selection.correlation_pairs(d, ["domain"], f).collect()}
    for dom in "sm":
        c = np.corrcoef(x[[i for i in range(2000) if (dom == "s") == bool(i % 2)]].T)
        assert all(abs(got[dom, i, j] - c[i, j]) < 1e-9 for i in range(4) for j in range(i + 1, 4))
    exact = {r["feature"]: r["mi"] for r in selection.mutual_information(d, [], f, "y").collect()}
    quick = {r["feature"]: r["mi"] for r in selection.mutual_information(d, [], f, "y", accuracy=10000).collect()}
    assert all(abs(exact[k] - quick[k]) < 0.01 and exact[k] > 0.02 for k in f)


def test_split_windows_query_shuffles_runs_once(spark, sf):
    """Runs leave the reading tasks as one row each; nothing is shuffled per run, seed and part (F14)."""
    from windowlab.plans import splitting

    plan = splitting.grouped_split_windows(spark, sf)._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert any("run_id" in k for k in keys)
    assert not any("run_id" in k and "seed" in k for k in keys)


def test_split_artifacts_join_parts_once_and_not_on_the_driver(spark, tmp_path, monkeypatch):
    from windowlab import fixtures
    from windowlab.plans import splitting

    line = "id + 1 AS l_orderkey, id % 7 AS l_partkey, id % 3 AS l_suppkey, 1 AS l_linenumber, CAST(id % 50 AS DOUBLE) AS l_quantity, 1000D * (id % 11) AS l_extendedprice, id % 10 / 100D AS l_discount, id % 9 / 100D AS l_tax"
    spark.range(300).selectExpr(*line.split(", "), "CASE WHEN id % 2 = 0 THEN 'F' ELSE 'O' END AS l_linestatus").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(6).selectExpr("id AS p_partkey", "CAST(id * id + 1 AS INT) AS p_size", "900D + id AS p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    made = []

    def counted(*a, **k):
        made.append(fixtures.wide(*a, **k))
        return made[-1]

    monkeypatch.setattr(splitting, "wide", counted)
    got = {(r["artifact"], r["item"]): r["value"] for r in splitting.split_artifacts(spark, str(tmp_path)).collect()}
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert len(made) == 1 and "ShuffledHashJoin" in plan and "Broadcast" not in plan
    rows = splitting.splits.split_windows(fixtures.wide(spark, str(tmp_path)), ["domain"], "run_id", [42]).where("part = 'train'").toPandas()
    for domain, of in rows.groupby("domain"):
        for f in fixtures.WIDE_FEATURES:
            assert abs(got["scaler", f"{domain}/{f}"] - of[f].mean()) < 1e-4
    assert sum(v for (a, _), v in got.items() if a == "splits") == sum(i % 7 < 6 for i in range(300)) and got["splits", "train"] == len(rows)
