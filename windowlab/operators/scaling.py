"""Standard and robust scaling, fitted on a training part and applied elsewhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from windowlab.functions.expressions import dbl
from windowlab.operators.ranking import exact_quantiles


def fit_standard(train: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, feature, centre, scale): mean and population std; no spread scales by 1."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.avg(f).alias("centre"), F.stddev_pop(f).alias("scale")) for f in features])
    out = train.groupBy(*keys).agg(cells.alias("_c")).select(*keys, F.inline("_c"))
    return out.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(dbl(1)))


def fit_robust(train: DataFrame, keys: Sequence[str], features: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """(keys, feature, centre, scale): median and quartile range; no range scales by 1.

    Exact by default: values are counted per feature and ranked over ordered buckets.
    ``accuracy`` switches to one pass of quantile sketches of that accuracy.
    """
    probs = [0.25, 0.5, 0.75]
    if accuracy:
        cells = F.array(*[
            F.struct(F.lit(f).alias("feature"), F.percentile_approx(f, probs, accuracy).alias("q")) for f in features
        ])
        q = train.groupBy(*keys).agg(cells.alias("_c")).select(*keys, F.inline("_c"))
        q = q.select(*keys, "feature", F.col("q")[0].alias("q25"), F.col("q")[1].alias("centre"), F.col("q")[2].alias("q75"))
    else:
        long = train.unpivot(list(keys), list(features), "feature", "value")
        e = exact_quantiles(long, [*keys, "feature"], "value", probs)
        at = lambda p: F.max(F.when(F.col("prob") == p, F.col("q")))
        q = e.groupBy(*keys, "feature").agg(at(0.25).alias("q25"), at(0.5).alias("centre"), at(0.75).alias("q75"))
    spread = F.col("q75") - F.col("q25")
    return q.select(*keys, "feature", "centre", F.when(spread > 0, spread).otherwise(dbl(1)).alias("scale"))


def apply_scaler(df: DataFrame, params: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Scale ``features`` of ``df`` with the parameters of its key.

    The parameters are turned to one row per key set (keys x 2 values per feature), so the join
    side has as many rows as models were fitted and is broadcast.
    """
    pick = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))
    wide = params.groupBy(*keys).agg(*[pick(f, c).alias(f"_{c}_{f}") for f in features for c in ("centre", "scale")])
    if keys:
        j = df.join(F.broadcast(wide), list(keys))  # one row per fitted model
    else:
        j = df.join(F.broadcast(wide))  # exactly one row
    out = j.withColumns({f: (F.col(f) - F.col(f"_centre_{f}")) / F.col(f"_scale_{f}") for f in features})
    return out.drop(*[f"_{c}_{f}" for f in features for c in ("centre", "scale")])


def max_abs(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Largest absolute (scaled) value of a feature family."""
    per = [F.max(F.abs(F.col(f))) for f in features]
    return df.groupBy(*keys).agg((F.greatest(*per) if len(per) > 1 else per[0]).alias("max_abs"))
