"""Bootstrap, cluster bootstrap and permutation by hashed replicate weights.

A replicate is a column of weights that every row can compute from its own key,
so data is read once for all replicates, and what is shuffled are sums per
replicate.  Drawing with replacement is Poisson(1) weighting, its large-sample limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from windowlab.functions.hashing import PRIME, key_code, poisson_cuts, poisson_weight, poly_hash, replicate_axis, replicate_coefficients, second_code
from windowlab.operators.merging import merge_arrays
from windowlab.operators.ranking import hash_ranks, split_points, with_bucket
from windowlab.session import core_count


def replicates(df: DataFrame, unit: Sequence[str], n: int, seed: int, weight: str = "w") -> DataFrame:
    """Rows repeated per replicate with the weight of their unit.

    The repetition happens inside the stage that aggregates; it is never shuffled as such.  The work is
    rows x replicates while the rows may be few bytes, so the rows are spread over all cores first:
    adaptive coalescing sizes partitions by bytes and would leave a few.
    """
    x = df.repartition(core_count(df.sparkSession), *df.columns).withColumn("_x", key_code(*unit)).withColumn("_y", second_code(*unit)).withColumn("_r", F.explode(replicate_axis(seed, n)))
    u = poly_hash(F.col("_x"), F.col("_y"), F.col("_r"))
    return x.withColumn(weight, poisson_weight(u)).withColumn("rep", F.col("_r.rep")).drop("_x", "_y", "_r")


def run_sums(df: DataFrame, keys: Sequence[str], run: str, **sums: Column) -> DataFrame:
    """One row per run with the sums a statistic needs."""
    return df.groupBy(*keys, run).agg(*[F.sum(c).alias(k) for k, c in sums.items()])


def _weighted_arrays(df: DataFrame, keys: Sequence[str], unit: Sequence[str], sums: Sequence[str], n: int, seed: int) -> DataFrame:
    """(keys, m): weighted sums of all replicates as one array per key, sums x replicates.

    Rows of a unit come together, so that its weights are made once for all its keys.  A task makes the weights of some units as a
    matrix (units x replicates, a tile at a time) and multiplies; no row is repeated.  Rows are few bytes and much work, so they are
    spread over all cores first.
    """
    keys, names = list(keys), list(sums)
    src = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in names], key_code(*unit).alias("_x"), second_code(*unit).alias("_y"))
    src = src.repartition(core_count(df.sparkSession), "_x", "_y").sortWithinPartitions("_x", "_y")
    coef = np.array(replicate_coefficients(seed, n), dtype=np.int64)

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            code = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(pdf), np.int64)
            seen = [tuple(None if pd.isna(v) else v for v in k) for k in pdf[keys].iloc[np.unique(code, return_index=True)[1]].itertuples(index=False)] if keys else [()]
            into = [acc.setdefault(k, np.zeros((len(names), n))) for k in seen]
            x, y, v = pdf["_x"].to_numpy(np.int64), pdf["_y"].to_numpy(np.int64), pdf[names].to_numpy(np.float64)
            first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            ends = np.append(first, len(x))
            made: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # tile of units -> the keys it has, keys x sums x units
            for rows, reps, u in _share_tiles(_hash_keys(x[first], y[first]), coef):
                u *= PRIME
                if rows.start not in made:
                    own = slice(ends[rows.start], ends[rows.stop])
                    found, at = np.unique(code[own], return_inverse=True)
                    m = np.zeros((len(found), len(names), rows.stop - rows.start))
                    np.add.at(m, (at, slice(None), np.searchsorted(first, np.arange(own.start, own.stop), side="right") - 1 - rows.start), v[own])
                    made[rows.start] = found, m
                found, m = made[rows.start]
                total = (m.reshape(-1, m.shape[2]) @ _poisson_matrix(u)).reshape(len(found), len(names), -1)
                for k, t in zip(found, total):
                    into[k][:, reps] += t
        for k, m in acc.items():
            yield pd.DataFrame({**{c: [v] for c, v in zip(keys, k)}, "m": [m.ravel()]})

    schema = T.StructType([*[src.schema[k] for k in keys], T.StructField("m", T.ArrayType(T.DoubleType()))])
    return merge_arrays(src.mapInPandas(partials, schema), keys, "m")


def weighted_sums(df: DataFrame, keys: Sequence[str], unit: Sequence[str], sums: Sequence[str], n: int, seed: int) -> DataFrame:
    """(keys, rep, sums): the sums of every replicate; a unit's rows share its weight."""
    arrays = _weighted_arrays(df, keys, unit, sums, n, seed)
    m = len(list(sums))
    row = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.struct(r.alias("rep"), *[F.get("m", r + k * n).alias(c) for k, c in enumerate(sums)])))
    return arrays.select(*keys, row.alias("_s")).select(*keys, "_s.*") if m else arrays


def cluster_bootstrap(runs: DataFrame, keys: Sequence[str], run: str, sums: Sequence[str], statistic: Callable[..., Column], n: int, seed: int, unit: Sequence[str] | None = None) -> DataFrame:
    """Replicates (keys, rep, value) of a statistic of run sums.

    ``statistic`` receives the weighted sums as columns and returns a column, so any ratio or paired
    difference of run-level sums stays inside the engine.  ``unit`` names what the draw depends on
    (the run; with a seed column in it, seeds are drawn independently).
    """
    g = weighted_sums(runs, keys, unit or [run], sums, n, seed)
    return g.select(*keys, "rep", statistic(*[F.col(s) for s in sums]).alias("value"))


ROW_BLOCK = 16_384  # rows of a score range that are weighted at once


def cluster_bootstrap_auc(df: DataFrame, keys: Sequence[str], run: str, y: str, score: str, n: int, seed: int) -> DataFrame:
    """Replicates of the AUC under run-level resampling; null where a replicate has one class only.  Null scores are left out.

    Scores are cut at quantiles.  Rows of one score value at a cut need no order: their weighted sums are combined in the tasks, however
    many they are.  The rows between two cuts, a bounded share, meet in one task that adds up their area for all replicates.  What
    leaves a range are three numbers per replicate, and the ranges are put together in order.
    """
    keys = list(keys)
    points = split_points(df.where(F.col(score).isNotNull()), score)
    cells = df.where(F.col(score).isNotNull()).groupBy(*keys, run, F.col(score).cast("double").alias("_score")).agg(
        F.sum((F.col(y) == 1).cast("bigint")).alias("_p"), F.sum((F.col(y) == 0).cast("bigint")).alias("_q")
    )
    on_cut = F.col("_score").isin(points) if points else F.lit(False)
    cells = with_bucket(cells, "_score", points).withColumn("_at", (F.col("_bucket") * 2 + F.when(on_cut, 0).otherwise(1)).cast("int"))
    tied = _weighted_arrays(cells.where(on_cut), [*keys, "_at"], [run], ["_p", "_q"], n, seed)
    coef = np.array(replicate_coefficients(seed, n), dtype=np.int64)

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_score")
        s, x, x2 = pdf["_score"].to_numpy(), pdf["_x"].to_numpy(np.int64), pdf["_y"].to_numpy(np.int64)
        p, q = pdf["_p"].to_numpy(np.float64)[:, None], pdf["_q"].to_numpy(np.float64)[:, None]
        out = np.zeros((3, n))  # positives, negatives, area
        for lo in range(0, n, REPLICATE_BLOCK):
            block = coef[lo : lo + REPLICATE_BLOCK]
            pos = neg = below = total = np.zeros(len(block))  # of the score value that is open
            for at in range(0, len(s), ROW_BLOCK):
                part = slice(at, at + ROW_BLOCK)
                w = _weight_matrix(x[part], x2[part], block)
                first = np.flatnonzero(np.concatenate([[True], s[part][1:] != s[part][:-1]]))
                a, b = np.add.reduceat(w * p[part], first), np.add.reduceat(w * q[part], first)
                if at and s[at] == s[at - 1]:
                    a[0] += pos
                    b[0] += neg
                else:
                    out[0, lo : lo + len(block)] += pos
                    total, below = total + pos * (below + neg / 2), below + neg
                before = below + np.cumsum(b, axis=0) - b
                total = total + (a[:-1] * (before[:-1] + b[:-1] / 2)).sum(axis=0)
                out[0, lo : lo + len(block)] += a[:-1].sum(axis=0)
                pos, neg, below = a[-1], b[-1], before[-1]
            out[0, lo : lo + len(block)] += pos
            out[1, lo : lo + len(block)] = below + neg
            out[2, lo : lo + len(block)] = total + pos * (below + neg / 2)
        return pd.DataFrame({**{k: pdf[k].iloc[:1].to_numpy() for k in [*keys, "_at"]}, "m": [out.ravel()]})

    schema = tied.schema
    between = cells.where(~on_cut).withColumns({"_x": key_code(run), "_y": second_code(run)}).groupBy(*keys, "_at").applyInPandas(area, schema)

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        below, positives, total = np.zeros(n), np.zeros(n), np.zeros(n)
        for m in pdf.sort_values("_at")["m"]:
            m = np.asarray(m).reshape(-1, n)
            inner = m[2] if len(m) == 3 else m[0] * m[1] / 2
            total, below, positives = total + inner + m[0] * below, below + m[1], positives + m[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(positives * below > 0, total / (positives * below), np.nan)
        return pd.DataFrame({**{k: [None if pd.isna(pdf[k].iloc[0]) else pdf[k].iloc[0]] * n for k in keys}, "rep": np.arange(n, dtype=np.int32), "value": value})

    out = T.StructType([*[df.schema[k] for k in keys], T.StructField("rep", T.IntegerType()), T.StructField("value", T.DoubleType())])
    return tied.unionByName(between).groupBy(*keys).applyInPandas(join_up, out)


def replicate_summary(reps: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, sample std and percentile interval over replicates (a group has as many rows as replicates)."""
    return reps.groupBy(*keys).agg(
        F.count(value).alias("n_replicates"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.percentile(value, 0.025).alias("ci_lo"),
        F.percentile(value, 0.975).alias("ci_hi"),
    )


def averaged_bootstrap(reps: DataFrame, keys: Sequence[str], seed: str = "seed", value: str = "value") -> DataFrame:
    """Replicate values averaged over seeds, then their percentile interval."""
    mean = reps.groupBy(*keys, "rep").agg(F.avg(value).alias(value))
    return replicate_summary(mean, keys, value)


# ---- second-moment partials ----------------------------------------------------

def gram_size(p: int) -> int:
    return 1 + p + p * (p + 1) // 2


def _design(x: np.ndarray) -> np.ndarray:
    """Columns 1, x_i and x_i x_j (i <= j)."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], axis=1)


def _residue(v: np.ndarray) -> np.ndarray:
    """``v`` modulo 2^31 - 1 without a division: the high bits count as ones."""
    v = (v & PRIME) + (v >> 31)
    v = (v & PRIME) + (v >> 31)
    v[v >= PRIME] -= PRIME
    return v


def _centred(v: np.ndarray) -> np.ndarray:
    """Residues between -p/2 and p/2."""
    return np.where(v > PRIME // 2, v - PRIME, v)


def _hash_keys(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """rows x 7: what a row's hash is a linear form of: x^2, x and y in two digits of 15 and 16 bits with their signs, and one."""
    digits = []
    for v in (_residue(x * x), x, y):
        v = _centred(v)
        low = ((v + 0x8000) & 0xFFFF) - 0x8000
        digits += [(v - low) >> 16, low]
    return np.column_stack([*digits, np.ones(len(x), np.int64)]).astype(np.float64)


def _share_tiles(keys: np.ndarray, coef: np.ndarray, start: np.ndarray | int = 0) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(rows, replicates, (hash + a half) / p): the numbers of :func:`poly_hash` as shares of the prime, in tiles that stay in the processor's cache.

    A hash is a x^2 + b x + d y + c modulo p, so a share is the fraction that is left of a sum of digits times coefficients over p. That
    sum stays below 2^17, where a double is off by 2^-37 at most; with the seven terms' own errors a share is off by less than 1/6 of
    1/p (2^-33.5), and the half keeps it on the right side of a whole number: hash < k is the same as share < k / p. A tile is overwritten by the next.
    With ``start`` it is (hash - start) modulo p, so that all hashes of a range that starts there lie below its length.
    """
    linear = [f(coef[:, k]) / PRIME for k in (1, 2, 4) for f in (lambda v: _centred(_residue(v << 16)), _centred)]
    c = np.stack([*linear, _centred((coef[:, 3] - start) % PRIME) / PRIME + 0.5 / PRIME])
    buffers = [np.empty(ROW_TILE * REPLICATE_BLOCK) for _ in range(2)]
    for lo in range(0, len(coef), REPLICATE_BLOCK):
        a = np.ascontiguousarray(c[:, lo : lo + REPLICATE_BLOCK])
        for at in range(0, len(keys), ROW_TILE):
            k = keys[at : at + ROW_TILE]
            u, q = (m[: len(k) * a.shape[1]].reshape(len(k), -1) for m in buffers)
            np.matmul(k, a, out=u)
            u -= np.floor(u, out=q)
            yield slice(at, at + len(k)), slice(lo, lo + a.shape[1]), u


def _hash_tiles(keys: np.ndarray, coef: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(rows, replicates, hashes plus a quarter) of :func:`_share_tiles`; a hash compares with a whole number as it would without the quarter."""
    for rows, reps, u in _share_tiles(keys, coef):
        u *= PRIME
        np.floor(u, out=u)
        u += 0.25
        yield rows, reps, u


def _column_counts(mask: np.ndarray) -> np.ndarray:
    """How many are set in every column, added up in bytes."""
    return sum(np.add.reduce(mask[at : at + 255].view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64) for at in range(0, len(mask), 255))


def _set_places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix with few set places: eight are looked at as one."""
    flat, width = np.ascontiguousarray(mask).reshape(-1), mask.shape[1]
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    inner = np.flatnonzero(flat[:whole].reshape(-1, 8)[eights])
    at = np.concatenate([eights[inner >> 3] * 8 + (inner & 7), whole + np.flatnonzero(flat[whole:])])
    return np.divmod(at, width)


def _poisson_matrix(u: np.ndarray) -> np.ndarray:
    """The same weights as :func:`poisson_weight` for a matrix of hashes; few of them are above the first cuts."""
    cuts = poisson_cuts()
    w = (u >= cuts[0]).astype(np.float64)
    for cut in cuts[1:COMMON_CUTS]:
        w += u >= cut
    row, rep = np.nonzero(w == COMMON_CUTS)
    w[row, rep] += np.searchsorted(cuts[COMMON_CUTS:], u[row, rep], side="right")
    return w


def _hash_matrix(x: np.ndarray, y: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """rows x replicates of hash values, the same numbers as :func:`poly_hash`."""
    out = np.empty((len(x), len(coef)), np.int64)
    for rows, reps, u in _hash_tiles(_hash_keys(x, y), coef):
        out[rows, reps] = u
    return out


def _weight_matrix(x: np.ndarray, y: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """rows x replicates of weights."""
    out = np.empty((len(x), len(coef)))
    for rows, reps, u in _share_tiles(_hash_keys(x, y), coef):
        u *= PRIME
        out[rows, reps] = _poisson_matrix(u)
    return out


GRAM_SCHEMA = T.StructType([
    T.StructField("rep", T.IntegerType()),  # in partials the first replicate of a block
    T.StructField("grp", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("sums", T.ArrayType(T.DoubleType())),
])

REPLICATE_BLOCK = 256  # replicates held as one weight matrix
ROW_TILE = 512  # rows of such a matrix
COMMON_CUTS = 4  # weights counted by comparing every hash; one row in 50 has a larger one


def complete(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with a value in every feature; nulls and NaN are none.  Moments of several features need all of them."""
    for f in features:
        df = df.where(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")))
    return df


def gram_partials(
    df: DataFrame, features: Sequence[str], label: str, group: str, unit: Sequence[str], n: int, seed: int,
    weights: Callable[[np.ndarray, tuple[np.ndarray, np.ndarray], str | None, slice], tuple[str, np.ndarray]], by_group: bool = True, rest: str | None = None,
) -> DataFrame:
    """Weighted counts, sums and cross products per (rep, group, class) of the complete rows: one array each per task,
    merged in a tree.

    ``weights(u, codes, group, replicates)`` turns a tile of hashes (as shares, see ``_share_tiles``) of one group's rows (of all rows
    without ``by_group``) into the output group and its weights; ``rest`` names a second one, of all that the first left.
    Memory per task is replicates x groups x classes x p^2/2, independent of the rows.  Rows are few bytes and much work, so they are
    spread over all cores first.
    """
    coef = np.array(replicate_coefficients(seed, n), dtype=np.int64)
    names = list(features)

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple[str, int], np.ndarray] = {}
        left: dict[int, np.ndarray] = {}  # per class the sums of all rows
        for pdf in batches:
            y, g = pdf["_label"].to_numpy(), pdf["_g"].to_numpy()
            codes = np.stack([pdf["_x"].to_numpy(dtype=np.int64), pdf["_y"].to_numpy(dtype=np.int64)])
            keys, z = _hash_keys(*codes), _design(pdf[names].to_numpy(dtype=np.float64))
            for name in np.unique(g) if by_group else [None]:
                for c in (0, 1):
                    m = np.flatnonzero((y == c) & (g == name) if by_group else y == c)
                    if not len(m):
                        continue
                    own, zs = codes[:, m], z[m]
                    for rows, reps, u in _share_tiles(keys[m], coef):
                        out, w = weights(u, own[:, rows], name, reps)
                        if (out, c) not in acc:
                            acc[out, c] = np.zeros((n, z.shape[1]))
                        acc[out, c][reps] += (zs[rows].T @ w.astype(np.float64, copy=False)).T
                    if rest is not None:
                        left[c] = left.get(c, 0.0) + zs.sum(axis=0)
        for c, s in left.items():
            acc[rest, c] = s - sum(v for (other, k), v in acc.items() if k == c)
        for (name, c), s in acc.items():
            for lo in range(0, n, REPLICATE_BLOCK):
                yield pd.DataFrame({"rep": [np.int32(lo)], "grp": name, "label": np.int32(c), "sums": [s[lo : lo + REPLICATE_BLOCK].ravel()]})

    src = complete(df, names).select(F.col(label).alias("_label"), F.col(group).alias("_g"), key_code(*unit).alias("_x"), second_code(*unit).alias("_y"), *names)
    src = src.repartition(core_count(df.sparkSession), "_x")
    return _unblocked(src.mapInPandas(partials, GRAM_SCHEMA), len(names))


def _unblocked(partials: DataFrame, p: int) -> DataFrame:
    """Partials of blocks of replicates, added up: a row per replicate."""

    def unblock(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                s = np.asarray(row.sums).reshape(-1, gram_size(p))
                yield pd.DataFrame({"rep": np.arange(row.rep, row.rep + len(s), dtype=np.int32), "grp": row.grp, "label": np.int32(row.label), "sums": list(s)})

    return merge_arrays(partials, ["rep", "grp", "label"], "sums").mapInPandas(unblock, GRAM_SCHEMA)


def bootstrap_grams(df: DataFrame, features: Sequence[str], label: str, group: str, unit: Sequence[str], n: int, seed: int) -> DataFrame:
    """Bootstrap partials per domain: Poisson weights, drawn inside each class by construction."""

    def weights(u, codes, name, reps):
        u *= PRIME
        return str(name), _poisson_matrix(u)

    return gram_partials(df, features, label, group, unit, n, seed, weights)


CUT_BINS = 64  # parts of the window in which a cut is looked for


def permutation_cuts(df: DataFrame, unit: Sequence[str], n_first: int, total: int, n: int, seed: int, width: float = 7.0) -> DataFrame:
    """Per replicate the n_first-th smallest (hash, codes): the exact cut that keeps the group sizes; ``tied`` if a row after it has its hash.

    Hashes are even, so the cut lies within a few standard errors of its expected place, in a window that is the same for all
    replicates.  One pass counts per replicate the rows below the window and in its parts; a second one gathers the rows of the one part that
    holds the cut, about ``sqrt(total)`` / 10 per replicate, and only they are ranked.  A window that misses a cut is widened.
    """
    if not 0 < n_first <= total:
        return df.sparkSession.createDataFrame([], "rep int, u bigint, x bigint, y bigint, tied boolean")
    share = n_first / total
    half = width * (share * (1 - share) / total) ** 0.5 + width / total
    low = max(0, int(PRIME * (share - half)))
    step = (min(PRIME, int(PRIME * (share + half)) + CUT_BINS) - low) // CUT_BINS + 1
    edges = low + step * np.arange(CUT_BINS + 1, dtype=np.int64)
    high = int(edges[-1])
    coef = np.array(replicate_coefficients(seed, n), dtype=np.int64)
    rows = df.select(key_code(*unit).alias("x"), second_code(*unit).alias("y")).repartition(core_count(df.sparkSession), "x")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((n, CUT_BINS + 1), np.int64)
        for pdf in batches:
            hits = []
            for _, reps, u in _share_tiles(_hash_keys(pdf["x"].to_numpy(np.int64), pdf["y"].to_numpy(np.int64)), coef):
                below = u < low / PRIME
                counts[reps, 0] += _column_counts(below)
                row, rep = _set_places((u < high / PRIME) ^ below)
                part = ((u[row, rep] * PRIME).astype(np.int64) - low) // step + 1
                hits.append((rep + reps.start) * (CUT_BINS + 1) + part)
            if hits:
                counts += np.bincount(np.concatenate(hits), minlength=counts.size).reshape(counts.shape)
        yield pd.DataFrame({"m": [counts.ravel()]})

    found = merge_arrays(rows.mapInPandas(tally, "m array<bigint>"), [], "m").first()  # bounded by the replicates
    ends = np.cumsum(np.asarray(found["m"]).reshape(n, CUT_BINS + 1), axis=1)
    if not ((ends[:, 0] < n_first) & (n_first <= ends[:, -1])).all():
        return permutation_cuts(df, unit, n_first, total, n, seed, width * 4)
    part = (ends < n_first).sum(axis=1)  # 1 is the first part of the window
    before, start = ends[np.arange(n), part - 1], edges[part - 1]

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = pdf["x"].to_numpy(np.int64), pdf["y"].to_numpy(np.int64)
            hits = []
            for rows, reps, u in _share_tiles(_hash_keys(x, y), coef, start):
                row, rep = _set_places(u < step / PRIME)
                hits.append((row + rows.start, rep + reps.start, (u[row, rep] * PRIME).astype(np.int64) + start[rep + reps.start]))
            row, rep, u = (np.concatenate(v) for v in zip(*hits)) if hits else [np.zeros(0, np.int64)] * 3
            yield pd.DataFrame({"rep": rep.astype(np.int32), "u": u, "x": x[row], "y": y[row], "need": n_first - before[rep]})

    inside = rows.mapInPandas(gather, "rep int, u bigint, x bigint, y bigint, need bigint")
    ordered = Window.partitionBy("rep").orderBy("u", "x", "y")
    ranked = inside.withColumns({"rn": F.row_number().over(ordered), "tied": F.coalesce(F.lead("u").over(ordered) == F.col("u"), F.lit(False))})
    return ranked.where("rn = need").select("rep", "u", "x", "y", "tied")


def permutation_grams(df: DataFrame, features: Sequence[str], label: str, group: str, unit: Sequence[str], n: int, seed: int, first: str = "static", second: str = "mobile", exact_sizes: bool = True) -> DataFrame:
    """Partials of both pseudo-domains per replicate of a shuffled domain label, class labels fixed.

    With ``exact_sizes`` the pseudo-domains have the sizes of the real ones.  Without, a row belongs to the
    first when its hash is below the size share; sizes then vary by about sqrt(rows)/2.
    """
    df = complete(df, features)
    sizes = df.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(group) == first).cast("bigint")).alias("k")).first()
    if exact_sizes:
        rows = sorted(permutation_cuts(df, unit, sizes["k"], sizes["n"], n, seed).collect())  # one row per replicate
        cut_u = np.array([r["u"] for r in rows], dtype=np.int64)
        cut_x, cut_y = (np.array([r[c] for r in rows], dtype=np.int64) for c in "xy")
        tied = np.array([r["tied"] for r in rows], dtype=bool)
    else:
        cut_u = np.full(n, int(PRIME * sizes["k"] / sizes["n"]), dtype=np.int64)
        cut_x = cut_y = np.full(n, -1, dtype=np.int64)
        tied = np.ones(n, dtype=bool)
    above = (cut_u + 1) / PRIME

    def weights(u, codes, name, reps):
        in_first = u < above[reps]
        some = np.flatnonzero(tied[reps])  # elsewhere no row after the cut has its hash
        if len(some):
            row, rep = np.nonzero(in_first[:, some] & (u[:, some] > (cut_u[reps] / PRIME)[some]))  # the hash is the cut's
            rep = some[rep]
            a, b, cx, cy = codes[0][row], codes[1][row], cut_x[reps][rep], cut_y[reps][rep]
            in_first[row, rep] = (a < cx) | ((a == cx) & (b <= cy))
        return first, in_first.view(np.uint8)

    return gram_partials(df, features, label, group, unit, n, seed, weights, by_group=False, rest=second)


def full_grams(df: DataFrame, features: Sequence[str], label: str, group: str) -> DataFrame:
    """The same sums over the plain data (replicate 0), for any number of features: a task multiplies its rows' matrix with itself."""
    names = list(features)

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple[str, int], np.ndarray] = {}
        for pdf in batches:
            y, g, x = pdf["_label"].to_numpy(), pdf["_g"].to_numpy(), pdf[names].to_numpy(dtype=np.float64)
            for name in np.unique(g):
                for c in (0, 1):
                    rows = x[(y == c) & (g == name)]
                    if len(rows):
                        sums = np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows)[np.triu_indices(len(names))]])
                        acc[str(name), c] = acc.get((str(name), c), 0.0) + sums
        for (name, c), s in acc.items():
            yield pd.DataFrame({"rep": [np.int32(0)], "grp": name, "label": np.int32(c), "sums": [s]})

    src = complete(df, names).select(F.col(label).alias("_label"), F.col(group).alias("_g"), *names)
    return _unblocked(src.mapInPandas(partials, GRAM_SCHEMA), len(names))


SEPARATION_SCHEMA = "rep int, grp string, mahalanobis double, lda_ratio double"


def separation_from_sums(s0: np.ndarray, s1: np.ndarray, p: int, ridge: float = 1e-6) -> tuple[float, float]:
    """Mahalanobis distance of the class means (pooled covariance + ridge) and the Fisher ratio, on standardised features."""
    iu = np.triu_indices(p)

    def unpack(s):
        m = np.zeros((p, p))
        m[iu] = s[1 + p :]
        return s[0], s[1 : 1 + p], m + np.triu(m, 1).T

    (n0, t0, c0), (n1, t1, c1) = unpack(s0), unpack(s1)
    n = n0 + n1
    if n0 < 1 or n1 < 1 or n <= 2:
        return float("nan"), float("nan")
    mu = (t0 + t1) / n
    sd = np.sqrt(np.maximum(np.diag(c0 + c1) / n - mu * mu, 0.0))
    sd[sd == 0] = 1.0
    m0, m1 = t0 / n0, t1 / n1
    within = (c0 - n0 * np.outer(m0, m0) + c1 - n1 * np.outer(m1, m1)) / np.outer(sd, sd)
    delta = (m1 - m0) / sd
    pooled = within / (n - 2) + ridge * np.eye(p)
    try:
        inv = np.linalg.inv(pooled)
    except np.linalg.LinAlgError:
        inv = np.linalg.pinv(pooled)
    dist = float(np.sqrt(max(delta @ inv @ delta, 0.0)))
    sw = within / n
    fisher = float(n0 * n1 / (n * n) * (delta @ np.linalg.pinv(sw, rcond=1e-10, hermitian=True) @ delta)) if np.any(sw) else float("inf")
    return dist, fisher


def separation(grams: DataFrame, p: int) -> DataFrame:
    """Distance and ratio per (rep, group).  A group holds two rows of p^2/2 sums, whatever the data size."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zero = np.zeros(gram_size(p))
        sums = lambda v: zero if v is None else np.asarray(v, dtype=np.float64)
        for pdf in batches:
            found = [separation_from_sums(sums(a), sums(b), p) for a, b in zip(pdf["_s0"], pdf["_s1"])]
            yield pdf[["rep", "grp"]].assign(mahalanobis=[d for d, _ in found], lda_ratio=[r for _, r in found])

    by_class = grams.groupBy("rep", "grp").agg(*[F.first(F.when(F.col("label") == c, F.col("sums")), ignorenulls=True).alias(f"_s{c}") for c in (0, 1)])
    return by_class.mapInPandas(solve, SEPARATION_SCHEMA)


def permute_column(df: DataFrame, key: str, column: str, seed: int, out: str) -> DataFrame:
    """Add ``out``: the values of ``column`` in random order, a true permutation.

    Rows are ranked in one hash order and values in another; equal ranks are joined.  Both ranks are bucketed.
    """
    rows = hash_ranks(df, [], f"rows{seed}", key).drop("n_part")
    values = hash_ranks(df.select(key, F.col(column).alias(out)), [], f"values{seed}", key).select("rn", out)
    return rows.join(values, "rn").drop("rn")
