import numpy as np
import pytest
from pyspark.sql import functions as F

from windowlab.operators import metrics


def frame(spark, y, s):
    return spark.createDataFrame([("k", int(a), float(b)) for a, b in zip(y, s)], "k string, y int, s double")


def brute_threshold(y, s, cand):
    best, at = -1.0, None
    for t in cand:
        acc = ((s >= t) == (y == 1)).mean()
        if acc > best:
            best, at = acc, t
    return at, best


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_threshold_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 300)
    s = np.round(np.clip(0.4 * y + rng.random(300) * 0.7 - 0.05, 0, 1), 2 if seed % 2 else 4)  # on and off the grid
    r = metrics.best_threshold(frame(spark, y, s), ["k"], "y", "s").first()
    t, acc = brute_threshold(y, s, [i / 100 for i in range(10, 91)])
    assert r["t"] == round(t * 100) and abs(r["t_acc"] - acc) < 1e-12
    curve = {x["t"]: x["acc"] for x in metrics.accuracy_curve(metrics.score_histogram(frame(spark, y, s), ["k"], "y", "s"), ["k"]).collect()}
    assert len(curve) == 81 and all(abs(curve[i] - ((s >= i / 100) == (y == 1)).mean()) < 1e-12 for i in curve)


def test_threshold_edges(spark):
    r = metrics.best_threshold(frame(spark, [1, 1, 0], [0.5, 0.5, 0.5]), ["k"], "y", "s").first()
    assert r["t"] == 10 and abs(r["t_acc"] - 2 / 3) < 1e-12  # lowest of the ties
    r = metrics.best_threshold(frame(spark, [0, 1], [0.29, 0.57]), ["k"], "y", "s").first()
    assert r["t"] == 30  # .29 and .57 lie on the grid


def test_quantile_threshold_brute_force(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.normal(size=400) + y, 3)
    r = metrics.best_quantile_threshold(frame(spark, y, s), ["k"], "y", "s").first()
    t, acc = brute_threshold(y, s, np.quantile(s, np.linspace(0.05, 0.95, 81)))
    assert abs(r["t"] - t) < 1e-9 and abs(r["t_acc"] - acc) < 1e-12


def test_auc(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 200)
    s = np.round(rng.random(200) + 0.3 * y, 1)
    p, q = s[y == 1], s[y == 0]
    want = ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))
    assert abs(metrics.roc_auc(frame(spark, y, s), ["k"], "y", "s").first()["auc"] - want) < 1e-12
    assert metrics.roc_auc(frame(spark, [1, 1], [0.1, 0.2]), ["k"], "y", "s").first()["auc"] is None
    assert metrics.roc_auc(frame(spark, [1, 0], [0.5, 0.5]), ["k"], "y", "s").first()["auc"] == 0.5


def test_measures_on_known_counts(spark):
    c = spark.createDataFrame([(50, 10, 5, 35), (10, 0, 5, 0)], "tn long, fp long, fn long, tp long")
    a, b = metrics.measures(c).collect()
    assert abs(a["f1"] - 70 / 85) < 1e-12 and abs(a["mcc"] - (35 * 50 - 50) / np.sqrt(45 * 40 * 60 * 55)) < 1e-12
    assert abs(a["kappa"] - (0.85 - 0.51) / (1 - 0.51)) < 1e-12
    assert (b["precision"], b["recall"], b["f1"], b["mcc"]) == (0.0, 0.0, 0.0, 0.0)


def test_intervals(spark):
    d = spark.createDataFrame([(0.9, 100), (0.0, 0)], "accuracy double, n long")
    a, b = metrics.with_intervals(d).collect()
    assert abs(a["wilson_lo"] - 0.8256) < 1e-3 and abs(a["wilson_hi"] - 0.9448) < 1e-3
    assert (b["wilson_lo"], b["wilson_hi"]) == (0.0, 0.0)


def test_largest_remainder_sums_to_total(spark):
    d = spark.createDataFrame([("p", s, c, n) for s in range(3) for c, n in (("tn", 10 + s), ("fp", 3), ("fn", 4), ("tp", 7))], "k string, seed int, cell string, n long")
    r = metrics.rescaled_confusion(d, ["k"], "cell", "n", 1000).collect()
    assert sum(x["n"] for x in r) == 1000 and abs(sum(x["pct"] for x in r) - 100) < 1e-9
