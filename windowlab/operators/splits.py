"""Run-grouped and stratified splits, folds and run samples.

Runs are put in md5 order and cut at fixed positions, so a split is described by a
few cut points and every window finds its part by itself, with its run's hash.  The
windows of a run can never be separated, and no window is shuffled for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from windowlab.functions.hashing import order_key
from windowlab.operators.ranking import below_cut, hash_cuts, hash_ranks
from windowlab.session import stored


def with_seeds(df: DataFrame, seeds: Sequence[int], name: str = "seed") -> DataFrame:
    """Repeat the (run-level) table once per seed by exploding a constant."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def _positions(test: float, val: float) -> dict:
    """Cut positions: test = ceil(test * n), val = ceil(val * rest).  1e-9 keeps ceil from counting a rounding error."""
    n = F.col("n_part")
    n_test = F.ceil(n * test - 1e-9)
    out = {"test": n_test}
    if val > 0:
        out["val"] = n_test + F.ceil((n - n_test) * val - 1e-9)
    return out


def _with_part(df: DataFrame, seed, key: str, val: float) -> DataFrame:
    part = F.when(below_cut("_h", key, "cut_test"), "test")
    if val > 0:
        part = part.when(below_cut("_h", key, "cut_val"), "val")
    return df.withColumn("_h", order_key(seed, key)).withColumn("part", part.otherwise("train")).drop("_h", "cut_test", "cut_val")


def split_cuts(df: DataFrame, parts: Sequence[str], run: str, seeds: Sequence[int], test: float = 0.20, val: float = 0.25) -> DataFrame:
    """The split as cut points in the md5 order of the runs: one row per (parts, seed)."""
    runs = with_seeds(df.select(*parts, run).distinct(), seeds)
    return hash_cuts(runs, [*parts, "seed"], F.col("seed"), run, _positions(test, val))


def experiment_cuts(df: DataFrame, parts: Sequence[str], run: str, seeds: Sequence[int], target_test: float) -> DataFrame:
    """Source and target cut points together, from one pass over the runs."""
    runs = with_seeds(df.select(*parts, run).distinct(), seeds)
    positions = _positions(0.20, 0.25) | {"target": _positions(target_test, 0)["test"]}
    return hash_cuts(runs, [*parts, "seed"], F.col("seed"), run, positions)


def split_windows(df: DataFrame, parts: Sequence[str], run: str, seeds: Sequence[int], test: float = 0.20, val: float = 0.25) -> DataFrame:
    """Windows repeated per seed with the part of their run.

    A run's part follows from comparing its hash with the cut points, so the windows are neither
    shuffled nor joined on the run: a run with a third of all windows is no hot key.  The joined
    side has one row per (parts, seed).
    """
    cuts = split_cuts(df, parts, run, seeds, test, val)
    out = with_seeds(df, seeds).join(F.broadcast(cuts), [*parts, "seed"])
    return _with_part(out, F.col("seed"), run, val)


def grouped_split(df: DataFrame, parts: Sequence[str], run: str, seeds: Sequence[int], test: float = 0.20, val: float = 0.25) -> DataFrame:
    """(parts, run, seed, part), one row per run: test = ceil(.2 n) runs, val = ceil(.25 of the rest), train = what is left.

    ``val=0`` gives a train/test split.
    """
    return split_windows(df.select(*parts, run).distinct(), parts, run, seeds, test, val).select(*parts, run, "seed", "part")


def target_windows(df: DataFrame, parts: Sequence[str], run: str, seeds: Sequence[int], test: float = 0.40) -> DataFrame:
    """Windows of the target domain with part calib or test."""
    s = split_windows(df, parts, run, seeds, test=test, val=0)
    return s.withColumn("part", F.when(F.col("part") == "train", "calib").otherwise("test"))


def target_split(df: DataFrame, parts: Sequence[str], run: str, seeds: Sequence[int], test: float = 0.40) -> DataFrame:
    """Calibration pool and test fold of the target domain, by runs."""
    s = grouped_split(df, parts, run, seeds, test=test, val=0)
    return s.withColumn("part", F.when(F.col("part") == "train", "calib").otherwise("test"))


def stratified_split(df: DataFrame, strata: Sequence[str], key: str, seed: int, test: float = 0.20, val: float = 0.25) -> DataFrame:
    """Row-level split that keeps the share of every stratum, by cut points per stratum."""
    cuts = hash_cuts(df, strata, seed, key, _positions(test, val))
    out = df.join(F.broadcast(cuts), list(strata))  # one row per stratum
    return _with_part(out, seed, key, val)


def stratified_folds(df: DataFrame, strata: Sequence[str], key: str, seed: int, k: int = 3, fold: str = "fold") -> DataFrame:
    r = hash_ranks(df, strata, seed, key)
    return r.withColumn(fold, F.pmod(F.col("rn") - 1, F.lit(k)).cast("int")).drop("rn", "n_part")


def grouped_folds(df: DataFrame, parts: Sequence[str], run: str, k: int = 3, fold: str = "fold") -> DataFrame:
    """(parts, run, fold), balanced and without a seed.

    Runs are dealt out in turn, largest window count first (md5 order among equals).  The position of
    a run is the number of larger runs, from the small table of run sizes, plus its rank among equals.
    """
    runs = df.groupBy(*parts, run).agg(F.count(F.lit(1)).alias("n_windows"))
    r = hash_ranks(runs, [*parts, "n_windows"], 0, run)
    sizes = r.groupBy(*parts, "n_windows").agg(F.count(F.lit(1)).alias("_c"))
    larger = Window.partitionBy(*parts).orderBy(F.desc("n_windows")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*parts, "n_windows", F.coalesce(F.sum("_c").over(larger), F.lit(0)).alias("_larger"))
    pos = F.col("_larger") + F.col("rn") - 1
    return r.join(sizes, [*parts, "n_windows"]).select(*parts, run, "n_windows", F.pmod(pos, F.lit(k)).cast("int").alias(fold))


def fewshot_runs(pool: DataFrame, parts: Sequence[str], run: str, sizes: Sequence[int], repeats: int) -> DataFrame:
    """Runs drawn without replacement for every (n, repeat); sizes above the pool are skipped.

    ``pool`` has one row per (parts, run).  The draw order is one hash per (repeat, run) and the
    samples of one repeat are nested: the first n of the same order.
    """
    pool = stored(pool.select(*parts, run), "pool")  # one row per run; the ranking reads it twice per repeat
    reps = pool.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    key = F.concat_ws("|", *[F.col(p).cast("string") for p in parts], F.col("r").cast("string"))
    ranked = hash_ranks(reps.withColumn("_draw", key), [*parts, "r", "_draw"], F.col("_draw"), run, limit=max(sizes))
    fits = F.filter(
        F.array(*[F.lit(int(n)) for n in sizes]), lambda n: (n <= F.col("n_part")) & (F.col("rn") <= n)
    )
    return ranked.select(*parts, run, "r", F.explode(fits).alias("n_runs"))
