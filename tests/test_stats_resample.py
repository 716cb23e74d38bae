import numpy as np
import pytest
from pyspark.sql import functions as F

from windowlab.functions import hashing, tails
from windowlab.operators import resample, stats


def test_t_tail_table_values():
    for t, df, p in ((2.0930240544, 19, 0.025), (1.3722, 10, 0.1), (12.7062, 1, 0.025), (3.0, 1e6, 0.00135)):
        assert abs(tails.t_upper(t, df) - p) < 1e-5
    assert abs(tails.t_critical(0.025, 19) - 2.0930240544) < 1e-8 and abs(tails.t_upper(-1.0, 5) + tails.t_upper(1.0, 5) - 1) < 1e-12


def test_paired_stats_undefined_cases(spark):
    d = spark.createDataFrame([("one", 0.1), ("flat", 0.2), ("flat", 0.2), ("ok", 0.1), ("ok", 0.3)], "g string, d double")
    r = {x["g"]: x for x in stats.paired_stats(d, ["g"], "d").collect()}
    assert r["one"]["paired_t"] is None and r["flat"]["paired_p"] is None and r["one"]["delta_std"] == 0.0
    assert abs(r["ok"]["paired_t"] - 2.0) < 1e-9 and abs(r["ok"]["paired_p"] - 0.2951672) < 1e-6


def test_cohens_d_constant_column(spark):
    d = spark.createDataFrame([(dom, y, 1.0, float(i + 3 * y)) for dom in ("static", "mobile") for y in (0, 1) for i in range(4)], "domain string, y int, k double, x double")
    r = {x["feature"]: x for x in stats.cohens_d(d, ["k", "x"], "y", "domain").collect()}
    assert r["k"]["static_d"] == 0.0 and abs(r["x"]["static_d"] - round(3 / np.std([0, 1, 2, 3], ddof=1), 4)) < 1e-9


def test_variance_ratio_ignores_single_window_runs(spark):
    d = spark.createDataFrame([("s", 1, 1.0), ("s", 1, 3.0), ("s", 2, 4.0), ("s", 2, 8.0), ("s", 3, 9.0)], "p string, run int, x double")
    r = stats.variance_ratio(d, ["p"], "run", ["x"]).first()
    assert abs(r["var_within"] - 5.0) < 1e-12 and abs(r["var_between"] - np.var([2, 6, 9], ddof=1)) < 1e-12


def test_failing_share(spark):
    imp = spark.createDataFrame([("m", "a", 3.0), ("m", "b", 1.0), ("m", "c", None), ("m", "d", 4.0), ("z", "a", 0.0)], "method string, feature string, importance double")
    ratio = spark.createDataFrame([("a", False), ("b", True), ("c", False), ("e", False)], "feature string, passes boolean")
    r = {x["method"]: x for x in stats.failing_share(imp, ratio, ["method"]).collect()}
    assert r["m"]["n_failing"] == 2 and abs(r["m"]["failing_share"] - 3 / 8) < 1e-12 and r["z"]["failing_share"] is None


def test_wasserstein(spark):
    rng = np.random.default_rng(4)
    a, b = np.round(rng.normal(size=300), 2), np.round(rng.normal(0.5, 2, 300), 2)
    d = spark.createDataFrame([("k", "a", float(v)) for v in a] + [("k", "b", float(v)) for v in b], "k string, s string, x double")
    assert abs(stats.wasserstein(d, ["k"], "s", "a", "x").first()["w1"] - np.abs(np.sort(a) - np.sort(b)).mean()) < 1e-9


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 300
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, 3)) + 0.8 * y[:, None]
    g = np.where(rng.random(n) < 0.4, "static", "mobile")
    d = spark.createDataFrame([(f"r{i}", str(g[i]), int(y[i]), *map(float, x[i])) for i in range(n)], "row_key string, domain string, label int, a double, b double, c double")
    return d, g, y, x


def separation_numpy(x, y):
    z = (x - x.mean(0)) / x.std(0)
    z0, z1 = z[y == 0], z[y == 1]
    s = ((len(z0) - 1) * np.cov(z0.T) + (len(z1) - 1) * np.cov(z1.T)) / (len(z) - 2)
    d = z1.mean(0) - z0.mean(0)
    within = ((z0 - z0.mean(0)).T @ (z0 - z0.mean(0)) + (z1 - z1.mean(0)).T @ (z1 - z1.mean(0))) / len(z)
    w = np.linalg.solve(within, d)
    p = z @ w
    sb = sum((y == c).mean() * (p[y == c].mean() - p.mean()) ** 2 for c in (0, 1))
    sw = sum(((p[y == c] - p[y == c].mean()) ** 2).sum() for c in (0, 1)) / len(z)
    return np.sqrt(d @ np.linalg.inv(s + 1e-6 * np.eye(3)) @ d), sb / sw


def test_separation_against_numpy(data):
    d, g, y, x = data
    got = {r["grp"]: r for r in resample.separation(resample.full_grams(d, ["a", "b", "c"], "label", "domain"), 3).collect()}
    for dom in ("static", "mobile"):
        m, l = separation_numpy(x[g == dom], y[g == dom])
        assert abs(got[dom]["mahalanobis"] - m) < 1e-9 and abs(got[dom]["lda_ratio"] - l) < 1e-9


def test_hash_twins_and_weights(spark, data):
    d = data[0]
    codes, more = np.array(d.select(hashing.key_code("row_key"), hashing.second_code("row_key")).collect(), dtype=np.int64).T
    coef = np.array(hashing.replicate_coefficients(42, 50), dtype=np.int64)
    w = np.searchsorted(np.array(hashing.poisson_cuts()), resample._hash_matrix(codes, more, coef), side="right")
    r = resample.replicates(d.select("row_key"), ["row_key"], 50, 42).groupBy("rep").agg(F.sum("w").alias("s")).collect()
    assert {x["rep"]: x["s"] for x in r} == dict(enumerate(w.sum(0).tolist()))
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06


def test_permutation_keeps_sizes(data):
    d, g, y, x = data
    r = resample.permutation_grams(d, ["a"], "label", "domain", ["row_key"], 20, 1).groupBy("rep", "grp").agg(F.sum(F.col("sums")[0]).alias("n")).collect()
    assert {(q["grp"], q["n"]) for q in r} == {("static", float((g == "static").sum())), ("mobile", float((g == "mobile").sum()))}
    assert len(r) == 40


def test_cluster_bootstrap_of_constant_and_hot_run(spark):
    d = spark.createDataFrame([(0, 1000, 900)] + [(i, 2, 1) for i in range(1, 300)], "run int, n int, k int")
    reps = resample.cluster_bootstrap(d, [], "run", ["n", "k"], lambda n, k: n / n, 30, 3)
    assert {r["value"] for r in reps.collect()} == {1.0}
    s = resample.replicate_summary(resample.cluster_bootstrap(d, [], "run", ["n", "k"], lambda n, k: k / n, 300, 3), []).first()
    assert s["n_replicates"] == 300 and s["ci_lo"] < (900 + 299) / 1598 < s["ci_hi"]


def test_column_shuffle_is_a_permutation(data):
    d, _, _, x = data
    out = resample.permute_column(d, "row_key", "a", 1, "s").select("a", "s").collect()
    assert sorted(r["a"] for r in out) == sorted(r["s"] for r in out) and any(r["a"] != r["s"] for r in out)


def test_many_feature_sums_take_the_matrix_path(data):
    d = data[0]
    f = [f"x{i}" for i in range(13)]
    w = d.withColumns({c: F.col("a") * (i + 1) + F.col("b") * F.lit(i % 3) for i, c in enumerate(f)})
    got = {(r["grp"], r["label"]): r["sums"] for r in resample.full_grams(w, f, "label", "domain").collect()}
    x = np.array([[r[c] for c in f] for r in w.where("domain = 'static' AND label = 1").collect()])
    iu = np.triu_indices(13)
    assert np.allclose(got[("static", 1)], np.concatenate([[len(x)], x.sum(0), (x.T @ x)[iu]]))


def _weights(spark, runs, n, seed):
    frame = spark.createDataFrame([(r,) for r in runs], "run int").select("run", hashing.key_code("run"), hashing.second_code("run")).collect()
    coef = np.array(hashing.replicate_coefficients(seed, n), dtype=np.int64)
    at = {r[0]: k for k, r in enumerate(frame)}
    u = resample._hash_matrix(np.array([r[1] for r in frame]), np.array([r[2] for r in frame]), coef)
    return resample._poisson_matrix(u).astype(float), at


@pytest.mark.parametrize("rows_at_once", [3, 16_384])
def test_auc_replicates_equal_weighted_pairs(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(resample, "ROW_BLOCK", rows_at_once)
    monkeypatch.setattr(resample, "REPLICATE_BLOCK", 7)
    r = np.random.Generator(np.random.PCG64(3))
    rows = [(m, int(k // 3), int(r.random() < 0.5), float(r.choice([0.2, 0.5]) if r.random() < 0.6 else round(r.random(), 3))) for m in "ab" for k in range(200)]
    rows += [("a", 5, 1, None)] + [("one", k, 1, 0.1 * k) for k in range(4)]
    d = spark.createDataFrame(rows, "model string, run int, y int, score double")
    got = {(x["model"], x["rep"]): x["value"] for x in resample.cluster_bootstrap_auc(d, ["model"], "run", "y", "score", 20, 9).collect()}
    w, at = _weights(spark, sorted({x[1] for x in rows}), 20, 9)
    assert len(got) == 60
    for m in ("a", "b", "one"):
        part = [x for x in rows if x[0] == m and x[3] is not None]
        run, y, s = np.array([at[x[1]] for x in part]), np.array([x[2] for x in part]), np.array([x[3] for x in part])
        pairs = (s[:, None] > s) + 0.5 * (s[:, None] == s)
        for rep in range(20):
            p, q = w[run, rep] * (y == 1), w[run, rep] * (y == 0)
            want = p @ pairs @ q / (p.sum() * q.sum()) if p.sum() * q.sum() else None
            assert got[m, rep] == (None if want is None else pytest.approx(want, abs=1e-12))


@pytest.mark.parametrize("first,width", [(1, 7.0), (37, 7.0), (100, 0.01), (300, 7.0)])
def test_permutation_cut_is_the_order_statistic(spark, monkeypatch, first, width):
    monkeypatch.setattr(resample, "REPLICATE_BLOCK", 5)
    d = spark.range(300).withColumnRenamed("id", "row_key")
    codes = np.array(d.select(hashing.key_code("row_key"), hashing.second_code("row_key")).collect(), dtype=np.int64)
    coef = np.array(hashing.replicate_coefficients(4, 12), dtype=np.int64)
    u = resample._hash_matrix(codes[:, 0], codes[:, 1], coef)
    got = {r["rep"]: (r["u"], r["x"], r["y"]) for r in resample.permutation_cuts(d, ["row_key"], first, 300, 12, 4, width).collect()}
    assert got == {k: sorted(zip(u[:, k].tolist(), *codes.T.tolist()))[first - 1] for k in range(12)}


def test_residue_equals_modulo():
    v = np.concatenate([np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 62, 5000), [0, hashing.PRIME - 1, hashing.PRIME, 2 * hashing.PRIME, hashing.PRIME**2, (1 << 62) - 1]])
    assert (resample._residue(v) == v % hashing.PRIME).all()


def test_hash_tiles_are_the_exact_hashes_and_make_a_unit_s_weights_once(spark, monkeypatch):
    x = np.array([0, 1, hashing.PRIME - 1, 12345, 2**30] * 150, np.int64)
    y = np.array([hashing.PRIME - 1, 0, hashing.PRIME - 1, 2**30, 7] * 150, np.int64)
    coef = np.array(hashing.replicate_coefficients(3, 300), dtype=np.int64)
    coef[0, 1:], coef[1, 1:] = hashing.PRIME - 1, 0
    want = [[((int(a) * int(p) + int(b)) * int(p) + int(c) + int(d) * int(q)) % hashing.PRIME for _, a, b, c, d in coef] for p, q in zip(x[:5], y[:5])]
    tiles = list((r, k, u.copy()) for r, k, u in resample._hash_tiles(resample._hash_keys(x, y), coef))
    got = np.zeros((750, 300))
    for r, k, u in tiles:
        got[r, k] = u
    assert (got == np.tile(np.array(want, np.float64), (150, 1)) + 0.25).all()
    # twelve cells of each of nine runs: every run's weights are the same in all its cells, null keys included
    rows = [(None if c == 0 else f"g{c % 4}", r, float(r * 12 + c)) for r in range(9) for c in range(12)]
    sums = resample.weighted_sums(spark.createDataFrame(rows, "g string, run int, v double"), ["g"], ["run"], ["v"], 300, 3).collect()
    codes = spark.range(9).select(hashing.key_code("id").alias("x"), hashing.second_code("id").alias("y")).collect()
    u = resample._hash_matrix(*(np.array([c[k] for c in codes], np.int64) for k in "xy"), np.array(hashing.replicate_coefficients(3, 300), dtype=np.int64))
    w = np.searchsorted(np.array(hashing.poisson_cuts()), u, side="right")
    assert len(sums) == 5 * 300
    for s in sums:
        assert s["v"] == sum(v * w[r, s["rep"]] for g, r, v in rows if g == s["g"])


def test_full_grams_need_no_hashes(spark, monkeypatch):
    monkeypatch.setattr(resample, "key_code", None)
    monkeypatch.setattr(resample, "second_code", None)
    rows = [(i % 2, "ab"[i % 3 % 2], float(i), float(i * i % 7) if i % 5 else None) for i in range(60)]
    got = {(r["grp"], r["label"]): r["sums"] for r in resample.full_grams(spark.createDataFrame(rows, "y int, g string, p double, q double"), ["p", "q"], "y", "g").collect()}
    for (g, c), s in got.items():
        v = np.array([(p, q) for y, h, p, q in rows if q is not None and (y, h) == (c, g)])
        assert s == [len(v), *v.sum(axis=0), *(v.T @ v)[np.triu_indices(2)]]
    assert len(got) == 4


def test_shares_are_the_exact_hashes_at_the_ends_of_their_range():
    r = np.random.Generator(np.random.PCG64(2))
    ends = [0, 1, 2, 0x7FFF, 0x8000, 0xFFFF, 0x10000, 2**30 - 1, 2**30, hashing.PRIME // 2, hashing.PRIME // 2 + 1, hashing.PRIME - 2, hashing.PRIME - 1]
    x, y = (np.concatenate([r.permutation(np.repeat(ends, 60)), r.integers(0, hashing.PRIME, 700)]) for _ in range(2))
    coef = np.column_stack([np.arange(300), *(np.concatenate([r.permutation(np.repeat(ends, 10)), r.integers(0, hashing.PRIME, 170)]) for _ in range(4))])
    _, a, b, c, d = (coef[:, k].astype(object) for k in range(5))
    want = ((a * x.astype(object)[:, None] ** 2 + b * x.astype(object)[:, None] + c + d * y.astype(object)[:, None]) % hashing.PRIME).astype(np.float64)
    start = coef[::-1, 1]
    for first, shifted in ((0, want), (start, (want - start) % hashing.PRIME)):
        got = np.zeros(want.shape)
        for rows, reps, u in resample._share_tiles(resample._hash_keys(x, y), coef, first):
            got[rows, reps] = u * hashing.PRIME - 0.5
        assert np.abs(got - shifted).max() < 1 / 6
    mask = r.random((37, 13)) < 0.05
    assert (np.array(resample._set_places(mask)) == np.array(np.nonzero(mask))).all()
    full = np.ones((600, 3), bool)
    assert resample._column_counts(full).tolist() == [600] * 3


def test_permutation_sums_use_all_cores_and_repeated_keys_stay_together(spark):
    rows = [(f"k{i // 3}", "static" if i % 3 else "mobile", i % 2, float(i)) for i in range(240)]  # every key three times, so cuts are tied
    d = spark.createDataFrame(rows, "row_key string, domain string, label int, a double").coalesce(1)
    parts = resample.gram_partials(d, ["a"], "label", "domain", ["row_key"], 4, 1, lambda u, codes, name, reps: (str(name), (u < 0.5).astype(float)))
    assert "REPARTITION_BY_NUM" in parts._jdf.queryExecution().toString()
    codes = {k: (x, y) for k, x, y in d.select("row_key", hashing.key_code("row_key"), hashing.second_code("row_key")).distinct().collect()}
    coef = np.array(hashing.replicate_coefficients(9, 12), dtype=np.int64)
    x, y = np.array([codes[r[0]] for r in rows], dtype=np.int64).T
    u = resample._hash_matrix(x, y, coef)
    first = sum(r[1] == "static" for r in rows) - 1
    d = d.withColumn("domain", F.when(F.col("a") == 1, "mobile").otherwise(F.col("domain")))  # 159 in the first: the cut is inside a key's three rows
    got = {(r["rep"], r["grp"], r["label"]): r["sums"] for r in resample.permutation_grams(d, ["a"], "label", "domain", ["row_key"], 12, 9).collect()}
    value, label = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    for rep in range(12):
        order = list(zip(u[:, rep].tolist(), x.tolist(), y.tolist()))
        inside = np.array([o <= sorted(order)[first - 1] for o in order])
        for c in (0, 1):
            for name, on in (("static", inside), ("mobile", ~inside)):
                v = value[on & (label == c)]
                assert np.allclose(got[rep, name, c], [len(v), v.sum(), (v * v).sum()])
