"""Cross-domain experiments: threshold regimes, gap decomposition, few-shot curves, grids and summaries.

Thresholds live on a grid of hundredths, so a score table is reduced once to counts per
(domain, model, seed, part, hundredth, label).  Every regime, seed and accuracy after that
is arithmetic on this small histogram.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from windowlab.constants import BASELINE_TOLERANCE, NOISE_BAND, PLATEAU, TARGET_TEST_SIZE
from windowlab.functions.expressions import dbl, logit
from windowlab.functions.hashing import order_key
from windowlab.operators import metrics, splits, stats
from windowlab.operators.ranking import below_cut
from windowlab.session import stored

OTHER = {"static": "S_to_M", "mobile": "M_to_S"}  # direction a domain is the source of


def as_source(domain: str = "domain"):
    return F.when(F.col(domain) == "static", "S_to_M").otherwise("M_to_S")


def as_target(domain: str = "domain"):
    return F.when(F.col(domain) == "mobile", "S_to_M").otherwise("M_to_S")


def with_parts(scores: DataFrame, run: str, seeds: Sequence[int], target_test: float = TARGET_TEST_SIZE) -> DataFrame:
    """Scores per seed with their part as source (train/val/test) and as target (calib/test).

    Both parts follow from the run's hash and a few cut points; rows are not shuffled.
    """
    cuts = stored(splits.experiment_cuts(scores, ["domain"], run, seeds, target_test), "cuts")  # one row per domain and seed
    s = splits.with_seeds(scores, seeds).join(F.broadcast(cuts), ["domain", "seed"])
    return s.withColumn("_h", order_key(F.col("seed"), run)).withColumns({
        "src_part": F.when(below_cut("_h", run, "cut_test"), "test").when(below_cut("_h", run, "cut_val"), "val").otherwise("train"),
        "tgt_part": F.when(below_cut("_h", run, "cut_target"), "test").otherwise("calib"),
    }).drop("_h", "cut_test", "cut_val", "cut_target")


CELL = ["direction", "seed", "model"]


def part_histogram(parts: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """The one pass over the scores, written down because every regime reads it.

    It has at most domains x seeds x models x 6 x 83 rows.
    """
    return stored(metrics.score_histogram(parts, ["domain", "seed", "model", "src_part", "tgt_part"], y, score), "histogram")


def regimes(hist: DataFrame) -> DataFrame:
    """Per (direction, seed, model): thresholds and target-test accuracies of the three regimes.

    source = tuned on source validation, calib = tuned on the target pool, intest = tuned on the test fold itself.
    """
    src = hist.withColumn("direction", as_source())
    tgt = hist.withColumn("direction", as_target())
    best = lambda h: metrics.best_step(h.groupBy(*CELL, "_b").agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q")), CELL, 10, F.lit(90))
    t = (
        best(src.where("src_part = 'val'")).select(*CELL, F.col("t").alias("t_src"))
        .join(best(tgt.where("tgt_part = 'calib'")).select(*CELL, F.col("t").alias("t_orc")), CELL)
        .join(best(tgt.where("tgt_part = 'test'")).select(*CELL, F.col("t").alias("t_int")), CELL)
    )
    j = tgt.join(F.broadcast(t), CELL)  # directions x seeds x models rows

    def acc(cut: str, test_only: bool = True):
        right = F.when(F.col("_b") >= F.col(cut), F.col("_p")).otherwise(F.col("_q"))
        all_ = F.col("_p") + F.col("_q")
        if test_only:
            inside = F.col("tgt_part") == "test"
            right, all_ = F.when(inside, right), F.when(inside, all_)
        return F.sum(right) / F.sum(all_)

    return j.groupBy(*CELL, "t_src", "t_orc", "t_int").agg(
        acc("t_src").alias("acc_src"), acc("t_orc").alias("acc_orc"), acc("t_int").alias("acc_int"), acc("t_src", False).alias("acc_src_full")
    )


def decompose(reg: DataFrame, large: str, small: str) -> DataFrame:
    """Gap of the small over the large feature set, split into ranking and threshold parts (they add up by construction)."""
    at = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    cols = ["acc_src", "acc_orc", "acc_int", "acc_src_full", "t_src", "t_orc", "t_int"]
    w = reg.groupBy("direction", "seed").agg(*[at(m, c).alias(f"{c}_{k}") for c in cols for k, m in (("large", large), ("small", small))])
    total = F.col("acc_src_small") - F.col("acc_src_large")
    ranking = F.col("acc_orc_small") - F.col("acc_orc_large")
    return w.withColumns({"delta_total": total, "delta_ranking": ranking, "delta_threshold": total - ranking})


def ordering_flags(reg: DataFrame, slack: float = NOISE_BAND) -> DataFrame:
    """Expected order: in-test >= calibration >= source, within a slack."""
    return reg.withColumn("flags", F.array_compact(F.array(
        F.when(F.col("acc_int") + slack < F.col("acc_orc"), F.lit("in-test cut below calibrated cut")),
        F.when(F.col("acc_orc") + slack < F.col("acc_src"), F.lit("calibrated cut below source cut")),
    )))


def regime_summary(reg: DataFrame) -> DataFrame:
    """Direction x model x regime: mean accuracy over seeds with a t interval."""
    long = reg.unpivot(["direction", "seed", "model"], ["acc_src", "acc_orc", "acc_int"], "regime", "acc")
    return stats.mean_t_interval(long, ["direction", "model", "regime"], "acc")


def component_summary(dec: DataFrame) -> DataFrame:
    long = dec.unpivot(["direction", "seed"], ["delta_total", "delta_ranking", "delta_threshold"], "component", "value")
    return stats.mean_t_interval(long, ["direction", "component"], "value")


def threshold_share(components: DataFrame, cut: float = 0.5) -> DataFrame:
    """Share of the gap that the threshold explains and the verdict."""
    at = lambda c: F.max(F.when(F.col("component") == c, F.col("mean")))
    s = components.groupBy("direction").agg(at("delta_total").alias("total"), at("delta_threshold").alias("threshold"))
    share = F.when(F.abs("total") > 1e-9, F.col("threshold") / F.col("total"))
    return s.withColumn("share", share).withColumn(
        "verdict", F.when(F.col("share") >= cut, "due to the cut").when(F.col("share").isNotNull(), "due to the features")
    )


def mechanism(parts: DataFrame, reg: DataFrame, score: str = "score") -> DataFrame:
    """Threshold shift, logit drift and mean scores between source-test and target-test, over seeds."""
    n = parts.groupBy("domain", "seed", "model", F.col(score).alias("p")).agg(
        F.sum((F.col("src_part") == "test").cast("bigint")).alias("n_src"), F.sum((F.col("tgt_part") == "test").cast("bigint")).alias("n_tgt")
    )
    n = stored(n, "score-counts")  # one pass over the scores; both directions read it
    zero = F.lit(0).cast("bigint")
    sides = n.select(as_source().alias("direction"), "seed", "model", "p", F.col("n_src").alias("a"), zero.alias("b")).unionByName(
        n.select(as_target().alias("direction"), "seed", "model", "p", zero.alias("a"), F.col("n_tgt").alias("b"))
    )
    both = sides.groupBy(*CELL, "p").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") + F.col("b") > 0)
    both = both.withColumn("z", logit(F.col("p")))
    # Scores beyond the clipping bounds share a logit, so counts are summed once more per logit.
    w1 = stats.wasserstein_from_counts(both.groupBy(*CELL, "z").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), CELL, "z")
    mean = lambda c: F.sum(F.col(c) * F.col("p")) / F.sum(c)
    means = both.groupBy(*CELL).agg(mean("a").alias("p_src"), mean("b").alias("p_tgt"))
    j = reg.join(w1, CELL).join(means, CELL)
    shift = F.abs(F.col("t_src") - F.col("t_int")) / 100.0
    return j.groupBy("direction", "model").agg(
        (F.avg("t_src") / 100.0).alias("t_source"),
        (F.avg("t_int") / 100.0).alias("t_target"),
        F.avg(shift).alias("abs_t_shift"),
        F.avg("w1").alias("w1_logit"),
        F.stddev_samp("w1").alias("w1_logit_std"),
        F.avg("p_src").alias("mean_p_source"),
        F.avg("p_tgt").alias("mean_p_target"),
    )


# ---- few-shot recalibration ------------------------------------------------------------

def fewshot_cells(parts: DataFrame, sample: DataFrame, run: str, y: str = "y", score: str = "score") -> tuple[DataFrame, DataFrame]:
    """Histograms of the sampled runs per (direction, seed, model, n_runs, r), and of the test fold.

    The sampled runs are at most (largest n) x repeats per (domain, seed), so they are broadcast and all
    other rows drop out where they are read.  What is left is counted per (run, hundredth) before it meets
    the samples: a run with a third of the windows brings at most 101 rows per model into that join.
    """
    drawn = F.broadcast(sample.select("domain", "seed", run).distinct())
    pool = parts.where("tgt_part = 'calib'").join(drawn, ["domain", "seed", run], "left_semi")
    per_run = metrics.score_histogram(pool, ["domain", "seed", "model", run], y, score)
    per_run = per_run.withColumn("direction", as_target())
    j = per_run.join(sample, ["domain", "seed", run])
    pool = j.groupBy(*CELL, "n_runs", "r", "_b").agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    windows = j.groupBy(*CELL, "n_runs", "r").agg(F.sum(F.col("_p") + F.col("_q")).alias("n_windows"))
    return pool, windows


def fewshot_curve(parts: DataFrame, sample: DataFrame, reg: DataFrame, run: str, y: str = "y", score: str = "score", hist: DataFrame | None = None) -> DataFrame:
    """Accuracy on the target test fold against the number of labelled target runs, with both references.

    With ``hist``, the ``part_histogram`` of the same parts, the test fold is read from it and not counted again.
    """
    key = [*CELL, "n_runs", "r"]
    sample = stored(sample, "sample")
    pool, windows = fewshot_cells(parts, sample, run, y, score)
    t = metrics.best_step(pool, key, 10, F.lit(90))
    if hist is None:
        hist = metrics.score_histogram(parts, ["domain", "seed", "model", "tgt_part"], y, score)
    test = hist.where("tgt_part = 'test'").withColumn("direction", as_target())
    curve = metrics.accuracy_curve(test, CELL)
    acc = t.drop("t_acc").join(curve, [*CELL, "t"]).join(windows, key)
    per_seed = acc.groupBy(*CELL, "n_runs").agg(F.avg("acc").alias("acc"), F.avg("n_windows").alias("n_windows"))
    over_seeds = per_seed.groupBy("direction", "model", "n_runs").agg(
        F.avg("n_windows").alias("n_windows"),
        F.avg("acc").alias("acc_mean"),
        F.coalesce(F.stddev_samp("acc"), dbl(0)).alias("acc_std"),
    )
    refs = reg.groupBy("direction", "model").agg(F.avg("acc_src").alias("source_ref"), F.avg("acc_orc").alias("oracle_ref"))
    return over_seeds.join(refs, ["direction", "model"])


def pool_adjacent(score: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic fit of weighted means in score order."""
    level: list[list[float]] = []
    for m, w in zip(mean, weight):
        level.append([m, w, 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            b, a = level.pop(), level.pop()
            w2 = a[1] + b[1]
            level.append([(a[0] * a[1] + b[0] * b[1]) / w2, w2, a[2] + b[2]])
    return np.concatenate([np.full(int(n), m) for m, _, n in level])


def isotonic_cut(score: np.ndarray, fit: np.ndarray, at: float = 0.5) -> float:
    """Smallest score whose interpolated isotonic value reaches ``at`` (infinity when none does)."""
    hit = np.nonzero(fit >= at)[0]
    if len(hit) == 0:
        return float("inf")
    i = hit[0]
    if i == 0:
        return float("-inf")
    lo, hi = fit[i - 1], fit[i]
    return float(score[i - 1] + (at - lo) / (hi - lo) * (score[i] - score[i - 1]))


def isotonic_fewshot(parts: DataFrame, sample: DataFrame, run: str, min_runs: int = 250, y: str = "y", score: str = "score") -> DataFrame:
    """Isotonic arm of the few-shot curve: accuracy at the calibrated .5 cut, per (direction, seed, model, n_runs, r).

    The fit is on exact scores; a cell holds the distinct scores of its n_runs sampled runs.
    """
    key = [*CELL, "n_runs", "r"]
    sample = stored(sample.where(F.col("n_runs") >= min_runs), "sample")
    drawn = F.broadcast(sample.select("domain", "seed", run).distinct())
    pool = parts.where("tgt_part = 'calib'").join(drawn, ["domain", "seed", run], "left_semi")
    pooled = pool.groupBy("domain", "seed", "model", run, F.col(score).alias("s")).agg(
        F.sum(F.col(y).cast("double")).alias("p"), F.count(F.lit(1)).cast("double").alias("w")
    )
    cells = pooled.withColumn("direction", as_target()).join(sample, ["domain", "seed", run])
    points = cells.groupBy(*key, "s").agg(F.sum("p").alias("p"), F.sum("w").alias("w"))

    def cut(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        s, w = pdf["s"].to_numpy(), pdf["w"].to_numpy()
        fit = pool_adjacent(s, pdf["p"].to_numpy() / w, w)
        return pd.DataFrame([[*k, isotonic_cut(s, fit)]], columns=[*key, "cut"])

    cuts = points.groupBy(*key).applyInPandas(cut, "direction string, seed int, model string, n_runs int, r int, cut double")
    test = parts.where("tgt_part = 'test'").groupBy(as_target().alias("direction"), "seed", "model", score).agg(
        F.sum((F.col(y) == 1).cast("bigint")).alias("p"), F.sum((F.col(y) == 0).cast("bigint")).alias("q")
    )
    right = F.when(F.col(score) >= F.col("cut"), F.col("p")).otherwise(F.col("q"))
    return test.join(cuts, CELL).groupBy(*key).agg((F.sum(right) / F.sum(F.col("p") + F.col("q"))).alias("acc"))


# ---- result tables of sweeps and grids ---------------------------------------------------

def sweep_summary(results: DataFrame, keys: Sequence[str], seed: str = "seed", value: str = "acc") -> DataFrame:
    """Mean and sample std over seeds per direction, and the asymmetry of the two transfer directions."""
    g = results.groupBy(*keys, "direction").agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    at = lambda d, c: F.max(F.when(F.col("direction") == d, F.col(c)))
    dirs = ["S", "M", "SM", "MS"]
    out = g.groupBy(*keys).agg(*[at(d, c).alias(f"{n}_{d}") for d in dirs for c, n in (("_m", "acc"), ("_s", "std"))])
    return out.withColumn("asymmetry", F.abs(F.col("acc_SM") - F.col("acc_MS")))


def two_level_mean(results: DataFrame, keys: Sequence[str], classifier: str, metrics_: Sequence[str]) -> DataFrame:
    """Mean over seeds per classifier, then mean of those means."""
    per = results.groupBy(*keys, classifier).agg(*[F.avg(m).alias(m) for m in metrics_])
    return per.groupBy(*keys).agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics_])


def recommend_k(table: DataFrame, keys: Sequence[str], k: str, a: str, b: str, plateau: float = PLATEAU) -> DataFrame:
    """Smallest K whose mean of both directions reaches the plateau share of the best."""
    t = table.withColumn("_avg", (F.col(a) + F.col(b)) / 2.0)
    t = t.withColumn("max_acc_avg", F.max("_avg").over(Window.partitionBy(*keys)))  # one row per K
    t = t.where(F.col("_avg") >= plateau * F.col("max_acc_avg"))
    return t.groupBy(*keys).agg(
        F.min(k).alias("recommended_K"), F.max("max_acc_avg").alias("max_acc_avg"), F.min_by(a, k).alias(f"rec_{a}"), F.min_by(b, k).alias(f"rec_{b}")
    )


def baseline_drift(results: DataFrame, expected: dict[str, float], tol: float = BASELINE_TOLERANCE, value: str = "acc") -> DataFrame:
    """Mean per direction against a reference value."""
    ref = None
    for d, v in expected.items():
        ref = F.when(F.col("direction") == d, dbl(v)) if ref is None else ref.when(F.col("direction") == d, dbl(v))
    m = results.groupBy("direction").agg(F.avg(value).alias("mean")).withColumn("reference", ref)
    return m.withColumn("delta", F.col("mean") - F.col("reference")).withColumn("ok", F.abs("delta") <= tol)


def share_evaluations(cells: DataFrame, features: str) -> tuple[DataFrame, DataFrame]:
    """Cells keyed by their sorted feature list, and the distinct (list, other axes) that must be evaluated."""
    keyed = cells.withColumn("feature_key", F.array_join(F.array_sort(features), ";"))
    return keyed, keyed.select("feature_key", "classifier", "seed").distinct()


# ---- search bookkeeping --------------------------------------------------------------------

def best_candidates(candidates: DataFrame, keys: Sequence[str], score: str, params: Sequence[str]) -> DataFrame:
    """Best parameter combination per key; ties go to the smaller parameter values."""
    best = F.max_by(F.struct(*params, score), F.struct(F.col(score), *[(-F.col(p)).alias(p) for p in params]))
    return candidates.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def edge_params(best: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether a best value sits at an end of its numeric range.

    ``best``: (keys, param, value); ``grid``: (model, param, values) where null or -1 marks an open end: then
    only the minimum counts.  Fewer than two numbers never make an edge, nor does the open marker itself.
    """
    v = F.col("values")
    nums = F.filter(v, lambda x: x.isNotNull() & (x != -1))
    is_open = F.exists(v, lambda x: x.isNull() | (x == -1))
    is_open = F.coalesce(is_open, F.lit(False)) | (F.size(F.filter(v, lambda x: x.isNull())) > 0)
    low = F.col("value") == F.array_min(nums)
    high = (F.col("value") == F.array_max(nums)) & ~is_open
    edge = (F.size(nums) >= 2) & F.col("value").isNotNull() & (F.col("value") != -1) & (low | high)
    return best.join(grid, ["model", "param"]).select(*keys, "param", "value", F.coalesce(edge, F.lit(False)).alias("is_edge"))


def compare_runs(new: DataFrame, old: DataFrame, keys: Sequence[str], value: str, band: float = NOISE_BAND) -> DataFrame:
    """New against previous result: improvement or regression beyond the band, else noise."""
    j = new.join(old.select(*keys, F.col(value).alias("previous")), list(keys), "left").withColumn("delta", F.col(value) - F.col("previous"))
    note = F.when(F.col("previous").isNull(), "no previous").when(F.abs("delta") < band, "noise").when(F.col("delta") >= band, "improvement").otherwise("regression")
    return j.withColumn("note", note)


def merge_searches(base: DataFrame, focused: DataFrame, key: str, take: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """All entries of the base search, with the named models taken from the focused one where it has them."""
    cols = [c for c in base.columns if c != key]
    f = focused.where(F.col(key).isin(*take)).select(key, *[F.col(c).alias(f"_f_{c}") for c in cols], F.lit(True).alias("_hit"))
    j = base.join(f, key, "full_outer")
    out = j.select(
        key,
        *[F.when(F.col("_hit"), F.col(f"_f_{c}")).otherwise(F.col(c)).alias(c) for c in cols],
        F.when(F.col("_hit"), "focused").otherwise("extended").alias("origin"),
    )
    return out.where(~F.col(key).isin(*drop)) if drop else out


def still_to_do(grid: DataFrame, results: DataFrame, fits: DataFrame, key: Sequence[str], value: str = "test_accuracy", error: str = "error") -> DataFrame:
    """Grid rows without a valid finished result: accuracy present, no error, fit saved."""
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value)) & (F.coalesce(F.trim(F.col(error)), F.lit("")) == "")
    done = results.where(ok).join(fits.select(*key).distinct(), list(key), "left_semi")
    return grid.join(done.select(*key).distinct(), list(key), "left_anti")


def resolve_space(spaces: DataFrame, wanted: DataFrame) -> DataFrame:
    """Search space of the asked mode, or the narrow one when the model lacks it.

    ``spaces``: (model, mode, param, values); ``wanted``: (model, mode).
    """
    has = spaces.select("model", "mode").distinct().withColumn("_has", F.lit(True))
    pick = wanted.join(has, ["model", "mode"], "left").select(
        "model", F.col("mode").alias("asked"), F.when(F.col("_has"), F.col("mode")).otherwise("narrow").alias("mode")
    )
    return pick.join(spaces, ["model", "mode"]).select("model", "asked", "mode", "param", "values")
