import hashlib

import numpy as np
from pyspark.sql import functions as F

from windowlab.operators import ranking


def md5(seed, k):
    return hashlib.md5(f"{seed}|{k}".encode()).hexdigest()


def test_hash_ranks_and_cuts_match_a_plain_sort(spark):
    d = spark.range(500).select((F.col("id") % 3).alias("p"), F.concat(F.lit("run"), F.col("id")).alias("k"))
    got = {(r["p"], r["k"]): (r["rn"], r["n_part"]) for r in ranking.hash_ranks(d, ["p"], 7, "k").collect()}
    cuts = {r["p"]: r for r in ranking.hash_cuts(d, ["p"], 7, "k", {"a": F.ceil(F.col("n_part") * 0.2), "none": F.lit(0)}).collect()}
    first = ranking.hash_ranks(d, ["p"], 7, "k", limit=5).count()
    assert first == 15
    for p in range(3):
        keys = sorted((f"run{i}" for i in range(500) if i % 3 == p), key=lambda k: (md5(7, k), k))
        for i, k in enumerate(keys):
            assert got[(p, k)] == (i + 1, len(keys))
        at = -(-len(keys) * 2 // 10) - 1
        assert cuts[p]["cut_a"]["k"] == keys[at] and cuts[p]["cut_none"] is None


def test_prefix_sums_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.full(400, 0.5), np.round(rng.random(600), 3)])
    g = np.arange(1000) % 2
    d = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g int, x double")
    c = d.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    r = ranking.prefix_sums(c, ["g"], "x", ["n"], following="nx").collect()
    for row in r:
        xs = x[g == row["g"]]
        assert row["n_before"] == (xs < row["x"]).sum() and row["n_total"] == len(xs)
        above = xs[xs > row["x"]]
        assert row["nx"] == (above.min() if len(above) else None)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=777), 2)
    d = spark.createDataFrame([("a", float(v)) for v in x] + [("one", 3.0)], "g string, x double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    got = {(r["g"], r["prob"]): r["q"] for r in ranking.exact_quantiles(d, ["g"], "x", probs).collect()}
    for p in probs:
        assert abs(got[("a", p)] - np.quantile(x, p)) < 1e-12
        assert got[("one", p)] == 3.0
