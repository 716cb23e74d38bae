"""Effect sizes, tests and interval statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from windowlab.functions.expressions import dbl, pooled_d
from windowlab.functions.tails import t_crit_975, t_two_sided, t_upper_tail
from windowlab.operators.ranking import prefix_sums, split_points


def moments(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long table (keys, feature, n, mean, var_s, var_p, lo, hi) from one pass and one small shuffle."""
    cells = F.array(*[
        F.struct(
            F.lit(f).alias("feature"),
            F.count(f).alias("n"),
            F.avg(f).alias("mean"),
            F.var_samp(f).alias("var_s"),
            F.var_pop(f).alias("var_p"),
            F.min(f).alias("lo"),
            F.max(f).alias("hi"),
        )
        for f in features
    ])
    return df.groupBy(*keys).agg(cells.alias("_m")).select(*keys, F.inline("_m"))


def cohens_d(df: DataFrame, features: Sequence[str], label: str, domain: str, digits: int = 4) -> DataFrame:
    """|d| between the classes per feature in both domains, with the change static -> mobile."""
    m = moments(df, [domain, label], features)

    def cell(d: str, y: int, stat: str) -> Column:
        return F.max(F.when((F.col(domain) == d) & (F.col(label) == y), F.col(stat)))

    def size(d: str) -> Column:
        raw = pooled_d(cell(d, 0, "mean"), cell(d, 0, "var_s"), cell(d, 0, "n"),
                       cell(d, 1, "mean"), cell(d, 1, "var_s"), cell(d, 1, "n"))
        return F.round(F.coalesce(F.abs(raw), dbl(0)), digits)

    return (
        m.groupBy("feature")
        .agg(size("static").alias("static_d"), size("mobile").alias("mobile_d"))
        .withColumn("delta", F.round(F.col("mobile_d") - F.col("static_d"), digits))
    )


def d_summary(d: DataFrame) -> DataFrame:
    return d.agg(
        F.avg("static_d").alias("mean_static"),
        F.avg("mobile_d").alias("mean_mobile"),
        F.sum((F.col("delta") > 0).cast("bigint")).alias("n_stronger"),
        F.sum((F.col("delta") < 0).cast("bigint")).alias("n_weaker"),
    )


def signed_d(df: DataFrame, cols: Sequence[str], accept: str) -> DataFrame:
    """Signed d of accepted against rejected rows, one row per column."""
    m = moments(df, [accept], cols)
    pick = lambda flag, s: F.max(F.when(F.col(accept) == flag, F.col(s)))
    return m.groupBy("feature").agg(
        pick(True, "n").alias("n_accept"),
        pick(False, "n").alias("n_reject"),
        pooled_d(pick(False, "mean"), pick(False, "var_s"), pick(False, "n"),
                 pick(True, "mean"), pick(True, "var_s"), pick(True, "n")).alias("d"),
    )


def paired_stats(df: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """Mean, spread, percentile interval, paired t, two-sided p and d of per-seed differences.

    ``df`` has one row per seed, so a group is bounded by the number of seeds.
    """
    sd = F.stddev_samp(delta)
    g = df.groupBy(*keys).agg(
        F.count(delta).alias("n_seeds"),
        F.avg(delta).alias("delta_mean"),
        F.coalesce(sd, dbl(0)).alias("delta_std"),
        F.percentile(delta, 0.025).alias("delta_ci_lo"),
        F.percentile(delta, 0.975).alias("delta_ci_hi"),
    )
    spread = F.when((F.col("n_seeds") >= 2) & (F.col("delta_std") > 0), F.col("delta_std"))
    g = g.withColumn("paired_t", F.col("delta_mean") / (spread / F.sqrt(F.col("n_seeds").cast("double"))))
    g = g.withColumn("cohens_d_paired", F.col("delta_mean") / spread)
    return g.withColumn("paired_p", t_two_sided(F.col("paired_t"), (F.col("n_seeds") - 1).cast("double")))


def mean_t_interval(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean with a two-sided 95% t interval, d = mean/sd and the one-sample p-value against 0."""
    g = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), dbl(0)).alias("std"),
    )
    se = F.when(F.col("n") > 1, F.col("std") / F.sqrt(F.col("n").cast("double"))).otherwise(dbl(0))
    dof = (F.col("n") - 1).cast("double")
    half = F.coalesce(t_crit_975(dof), dbl(0)) * se
    g = g.withColumn("_half", half).withColumn("_t", F.col("mean") / F.when((F.col("n") > 1) & (F.col("std") > 0), se))
    return g.select(
        *keys, "n", "mean", "std",
        (F.col("mean") - F.col("_half")).alias("ci_lo"),
        (F.col("mean") + F.col("_half")).alias("ci_hi"),
        (F.col("mean") / F.when(F.col("std") > 0, F.col("std"))).alias("cohens_d"),
        F.col("_t").alias("t_stat"),
        t_two_sided(F.col("_t"), dof).alias("p_value"),
    )


def cell_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, sample std and 2.5/97.5 percentiles of each metric per cell of per-seed results."""
    long = df.unpivot(list(keys) + ["seed"], list(metrics), "metric", "value")
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.percentile("value", 0.025).alias("ci_lo"),
        F.percentile("value", 0.975).alias("ci_hi"),
    )


def welch(df: DataFrame, keys: Sequence[str], group: str, low: str, high: str, value: str) -> DataFrame:
    """Welch t of group ``high`` over group ``low`` (one-sided) and d with the mean of both variances."""
    pick = lambda g: F.when(F.col(group) == g, F.col(value))
    g = df.groupBy(*keys).agg(
        *[f(pick(s)).alias(f"_{n}{i}") for i, s in ((0, low), (1, high)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    )
    e0, e1 = F.col("_v0") / F.col("_n0"), F.col("_v1") / F.col("_n1")
    diff = F.col("_m1") - F.col("_m0")
    g = (
        g.withColumn("mean_diff", diff)
        .withColumn("t_stat", diff / F.sqrt(F.when(e0 + e1 > 0, e0 + e1)))
        .withColumn("dof", F.pow(e0 + e1, 2) / F.when(e0 + e1 > 0, e0 * e0 / (F.col("_n0") - 1) + e1 * e1 / (F.col("_n1") - 1)))
        .withColumn("cohens_d", diff / F.sqrt(F.when(F.col("_v0") + F.col("_v1") > 0, 0.5 * (F.col("_v0") + F.col("_v1")))))
    )
    return g.select(*keys, "mean_diff", "t_stat", "dof", "cohens_d", t_upper_tail(F.col("t_stat"), F.col("dof")).alias("p_value"))


def permutation_summary(null: DataFrame, observed: DataFrame, keys: Sequence[str], value: str, obs: str) -> DataFrame:
    """One-sided permutation p with the +1 correction, and what the null looks like.

    ``observed`` has one row per key set and is joined to the replicate table.
    """
    j = null.join(observed, list(keys)) if keys else null.join(F.broadcast(observed))
    return j.groupBy(*keys).agg(
        F.max(obs).alias("observed"),
        F.count(value).alias("n_permutations"),
        F.sum((F.col(value) >= F.col(obs)).cast("bigint")).alias("n_exceed"),
        ((F.sum((F.col(value) >= F.col(obs)).cast("bigint")) + 1) / (F.count(value) + 1)).alias("p_value"),
        F.avg(value).alias("null_mean"),
        F.stddev_samp(value).alias("null_std"),
        F.max(value).alias("null_max"),
        (F.max(obs) / F.when(F.max(value) != 0, F.max(value))).alias("ratio_to_max"),
    )


def variance_ratio(df: DataFrame, parts: Sequence[str], run: str, features: Sequence[str], cut: float = 0.5) -> DataFrame:
    """R = mean within-run sample variance / sample variance of run means, per feature.

    First level: one row per run after map-side combining; second level: one row per part.
    A run with one window has no within variance and is ignored there.
    """
    runs = df.groupBy(*parts, run).agg(
        *[F.var_samp(f).alias(f"_w_{f}") for f in features], *[F.avg(f).alias(f"_b_{f}") for f in features]
    )
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.avg(f"_w_{f}").alias("var_within"), F.var_samp(f"_b_{f}").alias("var_between"))
        for f in features
    ])
    out = runs.groupBy(*parts).agg(cells.alias("_c")).select(*parts, F.inline("_c"))
    return out.withColumn("ratio", F.col("var_within") / (F.col("var_between") + 1e-12)).withColumn(
        "passes", F.col("ratio") >= cut
    )


def failing_share(imp: DataFrame, ratio: DataFrame, keys: Sequence[str], value: str = "importance") -> DataFrame:
    """Part of all importance that features failing the variance ratio hold, one row per key.

    ``imp`` has (keys, feature, value), ``ratio`` (a subset of keys, feature, passes) as ``variance_ratio`` gives it.  A feature
    without a ratio does not fail; null importances count nothing; where no importance is left the share is null.
    """
    on = [k for k in keys if k in ratio.columns] + ["feature"]
    fails = F.coalesce(~F.col("passes"), F.lit(False))
    sums = imp.join(ratio.select(*on, "passes"), on, "left").groupBy(*keys).agg(
        F.count(F.when(fails, 1)).alias("n_failing"), F.sum(F.when(fails, F.col(value)).otherwise(0.0)).alias("_f"), F.sum(value).alias("_t")
    )
    return sums.select(*keys, "n_failing", F.when(F.col("_t") > 0, F.col("_f") / F.col("_t")).alias("failing_share"))


def wasserstein_from_counts(counts: DataFrame, keys: Sequence[str], value: str, points: Sequence[float] | None = None) -> DataFrame:
    """W1 distance of two samples given as counts ``a`` and ``b`` per distinct value: the integral of |F - G|.

    The distribution functions are prefix sums over ordered buckets.
    """
    r = prefix_sums(counts, keys, value, ["a", "b"], points=points, following="_next")
    fa = (F.col("a_before") + F.col("a")) / F.col("a_total")
    fb = (F.col("b_before") + F.col("b")) / F.col("b_total")
    return r.groupBy(*keys).agg(F.coalesce(F.sum(F.abs(fa - fb) * (F.col("_next") - F.col(value))), dbl(0)).alias("w1"))


def wasserstein(df: DataFrame, keys: Sequence[str], side: str, first: str, value: str) -> DataFrame:
    """W1 distance between the ``first`` sample and the rest; distinct values are counted first."""
    counts = df.groupBy(*keys, value).agg(
        F.sum((F.col(side) == first).cast("bigint")).alias("a"),
        F.sum((F.col(side) != first).cast("bigint")).alias("b"),
    )
    return wasserstein_from_counts(counts, keys, value, split_points(df, value))


def share_of_total(df: DataFrame, value: str, total: Column, floor: float = 0.01) -> Column:
    """Percent of a total effect; null when the total is not above ``floor``."""
    return F.when(total > floor, 100 * F.col(value) / total)


def noise_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("n_controls"),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), dbl(0)).alias("std"),
        F.max(F.abs(F.col(value))).alias("max_abs"),
    )


def share_window(value: str, keys: Sequence[str]) -> Column:
    """Value over the sum of its (small) result group."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return F.col(value) / F.when(total != 0, total)
