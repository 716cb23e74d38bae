"""Thresholds, confusion counts, ROC and the measures built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from windowlab.constants import THRESHOLD_GRID
from windowlab.functions.expressions import dbl, grid_bucket, wald, wilson
from windowlab.operators.ranking import exact_quantiles, prefix_sums, split_points
from windowlab.session import stored


def best_threshold(df: DataFrame, keys: Sequence[str], y: str, score: str, grid: tuple[int, int] = THRESHOLD_GRID) -> DataFrame:
    """Accuracy-maximising threshold on an integer grid of hundredths, the lowest on ties: (keys, t, t_acc).

    One group-by into at most 101 buckets; accuracy at t is a suffix sum over them.  Accuracy changes only
    after an occupied bucket, so candidates are the grid start and the steps after occupied buckets.
    """
    lo, hi = grid
    return best_step(score_histogram(df, keys, y, score, grid), keys, lo, F.lit(hi)).withColumn("t", F.col("t").cast("int"))


def score_histogram(df: DataFrame, keys: Sequence[str], y: str, score: str, grid: tuple[int, int] = THRESHOLD_GRID) -> DataFrame:
    """(keys, _b, _p, _q): positives and negatives per hundredth, everything a grid threshold depends on."""
    lo, hi = grid
    b = F.greatest(F.least(grid_bucket(F.col(score)), F.lit(hi + 1)), F.lit(lo - 1))
    return df.groupBy(*keys, b.alias("_b")).agg(
        F.sum((F.col(y) == 1).cast("bigint")).alias("_p"), F.sum((F.col(y) == 0).cast("bigint")).alias("_q")
    )


def accuracy_curve(hist: DataFrame, keys: Sequence[str], grid: tuple[int, int] = THRESHOLD_GRID) -> DataFrame:
    """(keys, t, acc) for every threshold of the grid, from a score histogram."""
    lo, hi = grid
    zero = F.lit(0).cast("bigint")
    h = hist.groupBy(*keys, "_b").agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    dense = h.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(lo - 1), F.lit(hi + 1))).alias("_b"), zero.alias("_p"), zero.alias("_q")
    )
    h = h.unionByName(dense).groupBy(*keys, "_b").agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    part = Window.partitionBy(*keys)
    below = part.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    above = part.orderBy("_b").rowsBetween(0, Window.unboundedFollowing)
    right = F.sum("_p").over(above) + F.coalesce(F.sum("_q").over(below), F.lit(0))
    total = F.sum(F.col("_p") + F.col("_q")).over(part)
    return h.select(*keys, F.col("_b").alias("t"), (right / total).alias("acc")).where(F.col("t").between(lo, hi))


def best_step(hist: DataFrame, keys: Sequence[str], lo: int, hi: Column) -> DataFrame:
    """Best cut over a small histogram (keys, _b, _p, _q): positives at or above plus negatives below."""
    zero = F.lit(0).cast("bigint")
    steps = hist.select(*keys, F.inline(F.array(
        F.struct("_b", "_p", "_q"),
        F.struct((F.col("_b") + 1).alias("_b"), zero.alias("_p"), zero.alias("_q")),
        F.struct(F.lit(lo).alias("_b"), zero.alias("_p"), zero.alias("_q")),
    ))).groupBy(*keys, "_b").agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    below = part.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    above = part.orderBy("_b").rowsBetween(0, Window.unboundedFollowing)
    steps = steps.withColumns({
        "_right": F.sum("_p").over(above) + F.coalesce(F.sum("_q").over(below), F.lit(0)),
        "_all": F.sum(F.col("_p") + F.col("_q")).over(part),
    })
    return steps.where((F.col("_b") >= lo) & (F.col("_b") <= hi)).groupBy(*keys).agg(
        F.max_by("_b", F.struct(F.col("_right"), (-F.col("_b")).alias("_low"))).alias("t"),
        (F.max("_right") / F.max("_all")).alias("t_acc"),
    )


def best_quantile_threshold(df: DataFrame, keys: Sequence[str], y: str, score: str, n: int = 81, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """For unbounded scores: candidates are ``n`` quantiles of the scores themselves; (keys, t, t_acc)."""
    probs = [lo + (hi - lo) * i / (n - 1) for i in range(n)]
    points = split_points(df, score)
    cuts = stored(exact_quantiles(df, keys, score, probs, points=points).select(*keys, F.col("q").alias("_v")), "cuts")  # n rows per key
    zero = F.lit(0).cast("bigint")
    counts = df.groupBy(*keys, F.col(score).alias("_v")).agg(
        F.sum((F.col(y) == 1).cast("bigint")).alias("_p"), F.sum((F.col(y) == 0).cast("bigint")).alias("_q"), F.lit(False).alias("_cut")
    )
    # Candidates are laid between the scores as rows without weight; prefix sums then give their accuracy.
    both = counts.unionByName(cuts.select(*keys, "_v", zero.alias("_p"), zero.alias("_q"), F.lit(True).alias("_cut")))
    both = both.groupBy(*keys, "_v").agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"), F.max("_cut").alias("_cut"))
    r = prefix_sums(both, keys, "_v", ["_p", "_q"], points=points).where("_cut")
    right = F.col("_p_total") - F.col("_p_before") + F.col("_q_before")
    r = r.select(*keys, "_v", right.alias("_right"), (F.col("_p_total") + F.col("_q_total")).alias("_all"))
    return r.groupBy(*keys).agg(
        F.max_by("_v", F.struct(F.col("_right"), (-F.col("_v")).alias("_low"))).alias("t"), (F.max("_right") / F.max("_all")).alias("t_acc")
    )


def confusion(df: DataFrame, keys: Sequence[str], y: str, predicted: Column) -> DataFrame:
    """TN, FP, FN, TP and accuracy."""
    one = lambda a, b: F.sum(F.when((F.col(y) == a) & (predicted == b), 1).otherwise(0))
    c = df.groupBy(*keys).agg(one(0, 0).alias("tn"), one(0, 1).alias("fp"), one(1, 0).alias("fn"), one(1, 1).alias("tp"))
    return c.withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")))


def measures(c: DataFrame) -> DataFrame:
    """Precision, recall, F1, Matthews correlation and kappa from confusion counts; 0 where a ratio has no denominator."""
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), dbl(0))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    expected = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    return c.withColumns({
        "precision": precision,
        "recall": recall,
        "f1": ratio(dbl(2) * tp, dbl(2) * tp + fp + fn),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "kappa": ratio((tp + tn) / n - expected, dbl(1) - expected),
    })


def with_intervals(c: DataFrame, p: str = "accuracy", n: str = "n") -> DataFrame:
    w, a = wilson(F.col(p), F.col(n)), wald(F.col(p), F.col(n))
    return c.withColumns({"wilson_lo": w[0], "wilson_hi": w[1], "wald_lo": a[0], "wald_hi": a[1]})


def score_counts(df: DataFrame, keys: Sequence[str], y: str, score: str, weight: Column | None = None) -> DataFrame:
    """Positives and negatives per distinct score."""
    w = weight if weight is not None else F.lit(1).cast("bigint")
    return df.groupBy(*keys, score).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 0, w).otherwise(0)).alias("neg")
    )


def auc_from_counts(counts: DataFrame, keys: Sequence[str], score: str, points: Sequence[float]) -> DataFrame:
    r = prefix_sums(counts, keys, score, ["pos", "neg"], points=points)
    area = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0))
    p, q = F.max("pos_total").cast("double"), F.max("neg_total").cast("double")
    return r.groupBy(*keys).agg((area / F.when((p > 0) & (q > 0), p * q)).alias("auc"))


def roc_auc(df: DataFrame, keys: Sequence[str], y: str, score: str, weight: Column | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counting half; null with one class only.

    Scores are counted per distinct value, then prefix-summed over ordered buckets.
    """
    return auc_from_counts(score_counts(df, keys, y, score, weight), keys, score, split_points(df, score))


def roc_curve(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """(fpr, tpr) at every distinct score, from the highest down."""
    r = prefix_sums(score_counts(df, keys, y, score), keys, score, ["pos", "neg"], points=split_points(df, score))
    rate = lambda s: (F.col(f"{s}_total") - F.col(f"{s}_before")) / F.when(F.col(f"{s}_total") > 0, F.col(f"{s}_total"))
    return r.select(*keys, score, rate("neg").alias("fpr"), rate("pos").alias("tpr"))


def leaderboard(results: DataFrame, by: str, name: str, n: int) -> DataFrame:
    return results.orderBy(F.desc(by), name).limit(n)


def rescaled_confusion(cells: DataFrame, keys: Sequence[str], cell: str, count: str, total: int) -> DataFrame:
    """Seed-averaged cells rescaled to integers that sum to ``total`` (largest remainder), with percentages.

    ``cells`` holds a handful of rows per (key, seed).
    """
    mean = cells.groupBy(*keys, cell).agg(F.avg(count).alias("_mean"))
    w = Window.partitionBy(*keys)
    scaled = mean.withColumn("_s", F.col("_mean") * total / F.when(F.sum("_mean").over(w) > 0, F.sum("_mean").over(w)))
    scaled = scaled.withColumns({"_f": F.floor("_s"), "_rem": F.round(F.col("_s") - F.floor("_s"), 9)})
    place = F.row_number().over(w.orderBy(F.desc("_rem"), cell))
    deficit = F.lit(total) - F.sum("_f").over(w)
    out = scaled.withColumn("n", F.coalesce(F.col("_f") + F.when(place <= deficit, 1).otherwise(0), F.lit(0)))
    return out.select(*keys, cell, "n", (100.0 * F.col("n") / F.sum("n").over(w)).alias("pct"))


def histogram(df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts and density in equal bins; the upper end belongs to the last bin."""
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    h = df.where(F.col(value).between(lo, hi)).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return h.withColumn("density", F.col("n") / (F.sum("n").over(w) * width))


def model_scores(predictions: DataFrame, kind: str) -> Column:
    """Score of the positive class by what the model offers: proba, decision or hard."""
    from pyspark.ml.functions import vector_to_array

    if kind == "proba":
        return vector_to_array("probability")[1]
    if kind == "decision":
        return vector_to_array("rawPrediction")[1]
    return F.col("prediction").cast("double")


def score_type(columns: Sequence[str]) -> str:
    return "proba" if "probability" in columns else "decision" if "rawPrediction" in columns else "hard"
