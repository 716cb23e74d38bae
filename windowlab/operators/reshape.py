"""Tall <-> wide reshaping, column sets, profiles and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from windowlab.functions.expressions import clean, dbl, no_nan
from windowlab.functions.hashing import order_key
from windowlab.operators.ranking import hash_ranks

FALLBACK_DURATION = 40.0  # fixed value: seconds of a window whose times are unknown


def widen(
    tall: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str],
    label: str | None = None,
    timing: bool = False,
    temporal: bool = False,
    counts: bool = False,
    only_listed: bool = False,
) -> DataFrame:
    """One row per window: mean value per metric, 0 where a metric is absent.

    A window without any of the ``metrics`` is a row of zeros; with ``only_listed`` rows of other metrics are left out
    first, and such a window has no row.  The other flags only add columns.

    All aggregates sit in one ``groupBy`` (means per metric as conditional
    averages), so the table is shuffled once, after map-side combining.  Labels
    must agree inside a window; a window with two labels raises.
    """
    aggs = [F.coalesce(F.avg(F.when(F.col("Metric") == m, no_nan(F.col("Value")))), dbl(0)).alias(m) for m in metrics]
    if label:
        aggs.append(
            F.when(F.min(label) == F.max(label), F.min(label))
            .otherwise(F.raise_error(F.lit("a window carries two labels")).cast("int"))
            .alias(label)
        )
    if timing:
        aggs.append(
            F.coalesce(F.avg("Duration"), F.avg(F.col("EndTime") - F.col("StartTime")), dbl(FALLBACK_DURATION)).alias(
                "_measurement_duration"
            )
        )
    if temporal:
        aggs += [
            F.avg("StartTime").alias("StartTime_mean"),
            F.avg("EndTime").alias("EndTime_mean"),
            F.avg("Duration").alias("Duration_mean"),
            F.coalesce(F.stddev_samp("Duration"), dbl(0)).alias("Duration_std"),
            F.max("Duration").alias("Duration_max"),
            F.min("Duration").alias("Duration_min"),
            (F.max("EndTime") - F.min("StartTime")).alias("TimeRange"),
        ]
    if counts:
        aggs.append(F.count(F.lit(1)).alias("n_rows"))
    src = tall.where(F.col("Metric").isin(*metrics)) if only_listed else tall
    out = src.groupBy(*keys).agg(*aggs)
    return out.na.fill(0.0) if temporal else out


def melt(wide: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide -> tall; null metric values stay as rows."""
    return wide.unpivot(list(ids), list(metrics), "Metric", "Value")


def project_set(wide: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Named feature-set projection; a column of the set that the table lacks is 0."""
    have = set(wide.columns)
    return wide.select(*ids, *[F.col(f) if f in have else dbl(0).alias(f) for f in features])


def without(features: Sequence[str], removed: Sequence[str]) -> list[str]:
    """Feature list of an ablation, in the original order."""
    gone = set(removed)
    return [f for f in features if f not in gone]


def clean_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Infinities, NaN and nulls to 0 over all columns in one projection."""
    return df.withColumns({c: clean(F.col(c)) for c in cols})


def sample_runs(df: DataFrame, run: str, n: int, seed: int) -> DataFrame:
    """Keep the windows of ``n`` runs drawn without replacement; fewer runs than ``n`` is an error."""
    runs = hash_ranks(df.select(run).distinct(), [], seed, run, limit=n)
    picked = runs.where(
        F.when(F.col("n_part") < n, F.raise_error(F.lit(f"limit of {n} runs exceeds the number of runs")).cast("boolean"))
        .otherwise(F.col("rn") <= n)
    ).select(run)
    return df.join(F.broadcast(picked), run, "left_semi")  # at most n rows


def require_columns(df: DataFrame, needed: Sequence[str]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")


def require_same_schema(a: DataFrame, b: DataFrame) -> None:
    if a.columns != b.columns:
        raise ValueError(f"column lists differ: {a.columns} / {b.columns}")


def profile(df: DataFrame, keys: Sequence[str], label: str, run: str, approx: bool = False) -> DataFrame:
    """Rows and distinct runs per class."""
    distinct = F.approx_count_distinct(run) if approx else F.count_distinct(run)
    return df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n_rows"), distinct.alias("n_runs"))


def tag_union(static: DataFrame, mobile: DataFrame, tag: str = "mobility") -> DataFrame:
    """Union of two domains with a 0/1 tag."""
    require_same_schema(static, mobile)
    return static.withColumn(tag, F.lit(0)).unionByName(mobile.withColumn(tag, F.lit(1)))


def membership(a: DataFrame, b: DataFrame, key: str, left: str = "only_left", right: str = "only_right") -> DataFrame:
    """Each key of two sets with the side(s) it belongs to: both, only left, only right.

    One aggregate instead of two except-s and an intersect.
    """
    both = a.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        b.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    return both.groupBy(key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r")).select(
        key, F.when(F.col("_l") + F.col("_r") == 2, "both").when(F.col("_l") == 1, left).otherwise(right).alias("side")
    )


def overlap_count(df: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """Number of keys found in more than one part (0 means the parts are disjoint)."""
    return (
        df.groupBy(*keys)
        .agg((F.min(part) != F.max(part)).alias("_shared"))
        .agg(F.coalesce(F.sum(F.col("_shared").cast("bigint")), F.lit(0)).alias("n_shared"))
    )


def assert_disjoint(df: DataFrame, key: str, part: str) -> DataFrame:
    """``df`` itself, or a failure if one key lies in two parts."""
    if overlap_count(df, [key], part).first()["n_shared"]:
        raise ValueError(f"{key} occurs in more than one {part}")
    return df


def pick_features(features: DataFrame, seed: int, n: int, name: str = "feature") -> DataFrame:
    """``n`` features drawn by hash from a (small, one row per feature) table."""
    return features.withColumn("_h", order_key(seed, name)).orderBy("_h", name).limit(n).drop("_h")
