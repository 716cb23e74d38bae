"""Feature filters, univariate scores, rank aggregation and stability selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from windowlab.constants import CORRELATION_CUT, FEATURE_CATEGORIES, VARIANCE_FLOOR
from windowlab.functions.expressions import dbl, first_match
from windowlab.operators.merging import merge_arrays
from windowlab.operators.ranking import prefix_sums, split_points, with_bucket
from windowlab.operators.stats import moments


def variances(df: DataFrame, keys: Sequence[str], features: Sequence[str], floor: float = VARIANCE_FLOOR) -> DataFrame:
    """Population variance per feature and whether it passes the floor."""
    m = moments(df, keys, features)
    return m.select(*keys, "feature", F.col("var_p").alias("variance"), (F.col("var_p") > floor).alias("kept"))


def correlation_pairs(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Pearson r of every pair i < j of an ordered feature list, each over the rows where both have a value.

    Nulls and NaN have no value; r is null where a feature does not vary in those rows.  Column means first,
    then four p x p matrices of centred sums per key and task, merged in a tree.
    """
    keys, names, p = list(keys), list(features), len(features)
    clean_cols = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in names]
    src = df.select(*keys, *clean_cols)
    key_of = lambda r: tuple(r[k] for k in keys)
    means = {key_of(r): [r[f] or 0.0 for f in names] for r in src.groupBy(*keys).agg(*[F.avg(f).alias(f) for f in names]).collect()}

    def partials(batches):
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False) if keys else [((), pdf)]
            for k, part in groups:
                k = tuple(None if pd.isna(v) else v for v in k)
                x = part[names].to_numpy(dtype=np.float64) - np.asarray(means[k])
                has = ~np.isnan(x)
                x, m = np.where(has, x, 0.0), has.astype(np.float64)
                acc[k] = acc.get(k, 0.0) + np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        for k, m in acc.items():
            yield pd.DataFrame({**{c: [v] for c, v in zip(keys, k)}, "m": [m.ravel()]})

    schema = T.StructType([*[src.schema[k] for k in keys], T.StructField("m", T.ArrayType(T.DoubleType()))])
    sums = merge_arrays(src.mapInPandas(partials, schema), keys, "m")

    def pairs(batches):
        i, j = np.triu_indices(p, 1)
        for pdf in batches:
            for row in pdf.to_dict("records"):
                n, t, q, c = np.asarray(row["m"]).reshape(4, p, p)
                with np.errstate(divide="ignore", invalid="ignore"):
                    cov = c - t * t.T / n
                    var = q - t * t / n  # [a, b]: spread of a where b has a value
                    flat = (var <= 1e-12 * np.maximum(q, 1e-300)) | (n < 2)
                    r = np.where(flat | flat.T, np.nan, cov / np.sqrt(np.where(flat, 1.0, var) * np.where(flat.T, 1.0, var.T)))
                values = [None if np.isnan(v) else float(v) for v in r[i, j]]
                at = np.asarray(names)
                yield pd.DataFrame({**{k: [row[k]] * len(i) for k in keys}, "i": i.astype(np.int32), "j": j.astype(np.int32), "feature_i": at[i], "feature_j": at[j], "r": pd.array(values, "Float64")})

    out = T.StructType([*[src.schema[k] for k in keys], *[T.StructField(n, t) for n, t in (
        ("i", T.IntegerType()), ("j", T.IntegerType()), ("feature_i", T.StringType()), ("feature_j", T.StringType()), ("r", T.DoubleType()))]])
    return sums.mapInPandas(pairs, out)


def correlated_to_drop(pairs: DataFrame, keys: Sequence[str], cut: float = CORRELATION_CUT) -> DataFrame:
    """Later members of any pair above the cut.  Not greedy: an earlier feature counts even if dropped itself."""
    return pairs.where(F.abs("r") > cut).select(*keys, F.col("feature_j").alias("feature")).distinct()


def correlation_report(pairs: DataFrame, keys: Sequence[str], cut: float = CORRELATION_CUT) -> DataFrame:
    above = (F.abs(F.col("r")) > cut)
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum(F.when(above, 1).otherwise(0)).alias("n_above"),
        (100.0 * F.sum(F.when(above, 1).otherwise(0)) / F.count(F.lit(1))).alias("pct_above"),
        F.count_distinct(F.when(above, F.col("feature_j"))).alias("n_dropped"),
    )


def filter_features(df: DataFrame, features: Sequence[str], floor: float = VARIANCE_FLOOR, cut: float = CORRELATION_CUT) -> list[str]:
    """Variance filter, then correlation pruning among the survivors; feature names only reach the driver."""
    kept = {r["feature"] for r in variances(df, [], features, floor).where("kept").collect()}
    alive = [f for f in features if f in kept]
    if len(alive) < 2:
        return alive
    gone = {r["feature"] for r in correlated_to_drop(correlation_pairs(df, [], alive), [], cut).collect()}
    return [f for f in alive if f not in gone]


def categorise(df: DataFrame, feature: str = "feature") -> DataFrame:
    return df.withColumn("category", first_match(F.lower(F.col(feature)), FEATURE_CATEGORIES, "other"))


def anova_f(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str) -> DataFrame:
    """Two-class F score in closed form from class counts, means and variances."""
    m = moments(df, [*keys, label], features)
    grand = m.groupBy(*keys, "feature").agg(
        F.sum("n").alias("_n"),
        F.count(F.lit(1)).alias("_k"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mu"),
        F.sum(F.col("n") * F.col("var_p")).alias("_within"),
        F.collect_list(F.struct("n", "mean")).alias("_cls"),  # one entry per class
    )
    between = F.aggregate("_cls", dbl(0), lambda s, c: s + c["n"] * (c["mean"] - F.col("_mu")) * (c["mean"] - F.col("_mu")))
    within = F.col("_within") / (F.col("_n") - F.col("_k"))
    return grand.select(*keys, "feature", (between / (F.col("_k") - 1) / F.when(within > 0, within)).alias("f_score"))


def _sketched_bins(df: DataFrame, keys: list[str], features: Sequence[str], label: str, bins: int, accuracy: int) -> DataFrame:
    """(keys, feature, bin, c0, c1) with bin edges from one pass of quantile sketches over all keys."""
    probs = [i / bins for i in range(1, bins)]
    edges = df.agg(*[F.percentile_approx(f, probs, accuracy).alias(f) for f in features]).first()  # features x bins numbers
    for f in features:
        df = with_bucket(df, f, sorted(set(edges[f] or []))).withColumnRenamed("_bucket", f"_bin_{f}")
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_bin_{f}").cast("int").alias("bin")) for f in features])
    one = F.col(label) == 1
    return df.select(*keys, label, F.inline(cells)).groupBy(*keys, "feature", "bin").agg(
        F.sum((~one).cast("bigint")).alias("c0"), F.sum(one.cast("bigint")).alias("c1")
    )


def mutual_information(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, bins: int = 32, accuracy: int | None = None
) -> DataFrame:
    """Plug-in mutual information of the quantile-binned feature and the label.

    Values are counted per (feature, value, label) first; a value's bin follows from the rank of its
    first copy, so equal values share a bin and no feature column is sorted in one task.  ``accuracy``
    takes the bin edges from quantile sketches instead, and then only bin counts are shuffled.
    """
    g = [*keys, "feature"]
    if accuracy:
        return _information(_sketched_bins(df, list(keys), features, label, bins, accuracy), g)
    long = df.unpivot([*keys, label], list(features), "feature", "value")
    counts = long.groupBy(*g, "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(label) == 1).cast("bigint")).alias("pos")
    )
    ranked = prefix_sums(counts, g, "value", ["n"], points=split_points(long, "value"))
    binned = ranked.withColumn("bin", F.floor(bins * F.col("n_before") / F.col("n_total")).cast("int"))
    return _information(binned.groupBy(*g, "bin").agg(F.sum("pos").alias("c1"), (F.sum("n") - F.sum("pos")).alias("c0")), g)


def _information(cells: DataFrame, g: list[str]) -> DataFrame:
    """Sum of p ln(p / (p_bin p_label)) over a contingency table of bins x 2 rows per feature."""
    cells = cells.select(*g, "bin", F.inline(F.array(
        F.struct(F.lit(0).alias("y"), F.col("c0").alias("c")), F.struct(F.lit(1).alias("y"), F.col("c1").alias("c"))
    )))
    w = lambda *p: Window.partitionBy(*g, *p)  # noqa: E731  (bins x 2 rows per feature)
    n, nb, ny = F.sum("c").over(w()), F.sum("c").over(w("bin")), F.sum("c").over(w("y"))
    c = F.col("c").cast("double")
    term = F.when(F.col("c") > 0, c / n * F.ln(c * n / (nb.cast("double") * ny))).otherwise(dbl(0))
    return cells.withColumn("_t", term).groupBy(*g).agg(F.sum("_t").alias("mi"))


def average_rank(score: str, by: Sequence[str]) -> Column:
    """Descending rank with ties averaged."""
    w = Window.partitionBy(*by).orderBy(F.desc(score))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, score))
    return F.rank().over(w) + (ties - 1) / 2.0


def aggregate_ranks(scores: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Mean of the per-method ranks of a (keys, method, feature, score) table; the ``n`` smallest."""
    r = scores.withColumn("_rank", average_rank("score", [*keys, "method"]))
    mean = r.groupBy(*keys, "feature").agg(F.avg("_rank").alias("mean_rank"))
    w = Window.partitionBy(*keys).orderBy("mean_rank", "feature")
    return mean.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def normalise_importance(imp: DataFrame, keys: Sequence[str], value: str = "importance") -> DataFrame:
    """Negative importances to 0, then shares that sum to 1 per fit."""
    v = F.greatest(F.col(value), dbl(0))
    total = F.sum(v).over(Window.partitionBy(*keys))
    return imp.withColumn(value, v / F.when(total > 0, total).otherwise(dbl(1)))


def importance_ranking(imp: DataFrame, keys: Sequence[str], value: str = "importance") -> DataFrame:
    """Seed-averaged importance and 0-based rank."""
    a = imp.groupBy(*keys, "feature").agg(F.avg(value).alias("mean_importance"))
    w = Window.partitionBy(*keys).orderBy(F.desc("mean_importance"), "feature")
    return a.withColumn("rank", F.row_number().over(w) - 1)


def stable_counts(imp: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(method, K, feature, n_hits, n_seeds, avg): seeds in which a feature is top-K in both domains.

    Importances are method x domain x seed x feature rows, so the rank windows are feature-sized.
    Every feature gets a row, with 0 hits if it is never in both lists.
    """
    w = Window.partitionBy("method", "domain", "seed").orderBy(F.desc("importance"), "feature")
    ranked = imp.withColumn("_rk", F.row_number().over(w))
    both = ranked.groupBy("method", "seed", "feature").agg(
        F.max("_rk").alias("_worst"), F.count(F.lit(1)).alias("_n"), F.avg("importance").alias("_avg")
    )
    worst = F.when(F.col("_n") == 2, F.col("_worst"))
    cells = F.array(*[
        F.struct(F.lit(int(k)).alias("K"), F.count(F.when(worst <= k, 1)).alias("n_hits")) for k in ks
    ])
    seeds = imp.groupBy("method").agg(F.count_distinct("seed").alias("n_seeds"))
    out = both.groupBy("method", "feature").agg(cells.alias("_c"), (F.sum("_avg")).alias("_sum"))
    return out.join(F.broadcast(seeds), "method").select(  # one row per method
        "method", "feature", "n_seeds", (F.col("_sum") / F.col("n_seeds")).alias("avg_importance"), F.inline("_c")
    )


def universal_set(counts: DataFrame, threshold: float, variant: str) -> DataFrame:
    """Stability selection per (method, K): ``strict`` keeps stable features, ``soft`` exactly K of them.

    Soft cuts the stable features, or fills up with others, by mean importance over both domains.
    """
    c = counts.withColumn("is_stable", F.col("n_hits") / F.col("n_seeds") >= threshold)
    if variant == "strict":
        return c.where("is_stable").select("method", "K", "feature", "is_stable")
    w = Window.partitionBy("method", "K").orderBy(F.desc("is_stable"), F.desc("avg_importance"), "feature")
    return c.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= F.col("K")).select("method", "K", "feature", "is_stable")


def stability_sensitivity(counts: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Number of features that pass each threshold, per method and K."""
    cells = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.count(F.when(F.col("n_hits") / F.col("n_seeds") >= t, 1)).alias("n_passing"))
        for t in thresholds
    ])
    return counts.groupBy("method", "K").agg(cells.alias("_c")).select("method", "K", F.inline("_c"))


def anchored_top_k(ranks: DataFrame, anchor: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """K features led by an anchor set, then by the mean of the static and mobile rank.

    ``ranks``: (domain, feature, rank) with 0-based ranks; a feature missing in a domain ranks last (n).
    K above the number of features is an error.
    """
    n = ranks.groupBy("domain").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("_n"))
    at = lambda d: F.max(F.when(F.col("domain") == d, F.col("rank")))
    both = ranks.groupBy("feature").agg(at("static").alias("_s"), at("mobile").alias("_m")).join(F.broadcast(n))
    both = both.select(
        "feature",
        F.col("feature").isin(*anchor).alias("is_anchor"),
        ((F.coalesce("_s", "_n") + F.coalesce("_m", "_n")) / 2.0).alias("mean_rank"),
    )
    w = Window.orderBy(F.desc("is_anchor"), "mean_rank", "feature")  # one row per feature
    pos = both.withColumns({"position": F.row_number().over(w), "_all": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    k_max = max(ks)
    pos = pos.where(
        F.when(F.col("_all") < k_max, F.raise_error(F.lit(f"K={k_max} exceeds the number of features")).cast("boolean")).otherwise(F.lit(True))
    )
    return pos.select(
        F.explode(F.filter(F.array(*[F.lit(int(k)) for k in ks]), lambda k: F.col("position") <= k)).alias("K"),
        "feature", "is_anchor", "mean_rank",
    )
