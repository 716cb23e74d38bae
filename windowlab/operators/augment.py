"""Oversampling of the minority class by interpolation between exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from windowlab.functions.hashing import order_key, uniform
from windowlab.operators import models
from windowlab.operators.ranking import hash_ranks, split_points
from windowlab.session import stored

CELL_SIZE = 512     # distinct vectors aimed at per grid cell
PAIR_BLOCK = 1 << 19  # distances held at once in a task
GRID_DIMENSIONS = 3


def distance2(features: Sequence[str], a: str = "q_", b: str = "") -> Column:
    terms = [(F.col(a + f) - F.col(b + f)) * (F.col(a + f) - F.col(b + f)) for f in features]
    return sum(terms[1:], terms[0])


def _grid(points: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
    """Quantile cut points of up to three features, those with the most distinct values and no near copy before them."""
    names = list(features)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = points.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.approx_count_distinct(f).alias(f"_d_{f}") for f in names],
        *[F.corr(a, b).alias(f"_r_{a}|{b}") for a, b in pairs],
    ).first()
    bins = max(1, int((one["_n"] / CELL_SIZE) ** (1.0 / min(GRID_DIMENSIONS, len(names)))))
    near_copy = {frozenset(p) for p in pairs if abs(one[f"_r_{p[0]}|{p[1]}"] or 0.0) > 0.9}
    chosen: list[str] = []
    for f in sorted(names, key=lambda c: (-one[f"_d_{c}"], c)):
        if len(chosen) < GRID_DIMENSIONS and not any(frozenset((f, c)) in near_copy for c in chosen):
            chosen.append(f)
    return {f: (split_points(points, f, bins) if bins > 1 else []) for f in chosen}


def _with_cells(df: DataFrame, grid: dict[str, list[float]], prefix: str) -> DataFrame:
    for i, (f, cuts) in enumerate(grid.items()):
        if cuts:
            b = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=f, outputCol=f"_b{i}")
            df = b.transform(df).withColumn(f"{prefix}{i}", F.col(f"_b{i}").cast("int")).drop(f"_b{i}")
        else:
            df = df.withColumn(f"{prefix}{i}", F.lit(0))
    return df


def pooled(df: DataFrame, features: Sequence[str], key: str, extra: Sequence[str] = ()) -> DataFrame:
    """Distinct vectors with their number of copies and smallest key."""
    return df.groupBy(*features, *extra).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("vkey"))


def _nearest_inside(features: Sequence[str], columns: Sequence[str], k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The search inside one cell: for its queries the k first of its points by (d2, vkey), none beyond a query's bound."""
    names, out = list(features), ["qkey", "d2", *columns]

    def search(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("vkey", na_position="first")
        at, to, bound = q[names].to_numpy(np.float64), p[names].to_numpy(np.float64), q["_bound"].fillna(np.inf).to_numpy(np.float64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, PAIR_BLOCK // max(1, len(p)))
        for lo in range(0, len(q) if len(p) else 0, step):
            x = at[lo : lo + step]
            d = (x[:, :1] - to[:, 0]) ** 2
            for f in range(1, len(names)):
                d += (x[:, f : f + 1] - to[:, f]) ** 2
            most = bound[lo : lo + step]
            if len(p) > k:
                most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
            row, col = np.nonzero(d <= most[:, None])
            d2 = d[row, col]
            order = np.lexsort((col, d2, row))
            place = np.arange(len(row)) - np.searchsorted(row, row)
            order = order[place < k]
            found.append((row[order] + lo, col[order], d2[order]))
        row, col, d2 = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        near = p.iloc[col][list(columns)].reset_index(drop=True)
        return near.assign(qkey=q["qkey"].to_numpy()[row], d2=d2)[out]

    return search


def nearest(queries: DataFrame, points: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """The k nearest distinct vectors of every query, itself included: (qkey, vkey, copies, d2, other columns of points).

    ``queries``: (qkey, features); ``points``: pooled vectors with vkey, copies.  Exact.  Points lie in a
    quantile grid.  A query looks through its own cell first; its k-th distance found there bounds the
    true one, and it is final when the ball of that radius lies inside the cells searched.  Otherwise it
    comes back with exactly the cells its ball touches (or a wider ring, if it has not met k vectors yet).
    Queries and points meet cell by cell inside tasks; only the k first of a cell leave it, so pairs are
    never shuffled.  Identical vectors are one row, so copies never multiply.  A query with a missing feature has no distances;
    it gets the first vectors in order of their key.
    """
    points = stored(points.dropna(subset=list(features)), "vectors")
    grid = _grid(points, features)
    dims = list(grid)
    cells = [f"c{i}" for i in range(len(dims))]
    top = [len(c) for c in grid.values()]
    pts = stored(_with_cells(points, grid, "c"), "points")
    edges = {i: [float("-inf"), *grid[f], float("inf")] for i, f in enumerate(dims)}
    todo = _with_cells(queries.select("qkey", *features).dropna(subset=list(features)), grid, "h")
    for i in range(len(dims)):
        todo = todo.withColumns({f"lo{i}": F.col(f"h{i}"), f"hi{i}": F.col(f"h{i}")})
    todo = stored(todo.withColumns({"ring": F.lit(0), "_bound": F.lit(None).cast("double")}), "queries")
    keep = ["qkey", "d2", *points.columns]
    schema = T.StructType([todo.schema["qkey"], T.StructField("d2", T.DoubleType()), *[points.schema[c] for c in points.columns]])
    blank = queries.where(" OR ".join(f"`{f}` IS NULL" for f in features)).select("qkey")
    first = pts.orderBy("vkey").limit(k).select(F.row_number().over(Window.orderBy("vkey")).alias("rk"), F.lit(None).cast("double").alias("d2"), *points.columns)
    done = blank.crossJoin(F.broadcast(first)).select("rk", *keep)  # k rows
    while True:
        q = todo.select("qkey", *features, "_bound", *[f"{p}{i}" for i in range(len(dims)) for p in ("lo", "hi")])
        for i in range(len(dims)):
            q = q.withColumn(f"c{i}", F.explode(F.sequence(f"lo{i}", f"hi{i}"))).drop(f"lo{i}", f"hi{i}")
        # A radius found in an earlier round bounds the k-th distance: farther points stay in their cell.
        near = q.groupBy(*cells).cogroup(pts.groupBy(*cells)).applyInPandas(_nearest_inside(features, points.columns, k), schema)
        w = Window.partitionBy("qkey").orderBy("d2", "vkey")
        near = stored(near.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select("rk", *keep), "near")
        state = near.groupBy("qkey").agg(F.count(F.lit(1)).alias("_found"), F.max("d2").alias("_r2"))
        s = todo.join(state, "qkey", "left")
        r = F.sqrt("_r2") * (1 + 1e-12)
        full = F.lit(True)
        inside = F.lit(True)
        for i, f in enumerate(dims):
            cuts = F.array(*[F.lit(float(e)) for e in edges[i]])
            below, above = F.element_at(cuts, F.col(f"lo{i}") + 1), F.element_at(cuts, F.col(f"hi{i}") + 2)
            inside = inside & (F.col(f) - r > below) & (F.col(f) + r < above)
            full = full & (F.col(f"lo{i}") == 0) & (F.col(f"hi{i}") == top[i])
        final = full | ((F.coalesce("_found", F.lit(0)) >= k) & inside)
        s = stored(s.withColumn("_final", F.coalesce(final, F.lit(False))), "state")
        got = near.join(s.where("_final").select("qkey"), "qkey", "left_semi")
        done = done.unionByName(got)
        rest = s.where(~F.col("_final"))
        if rest.isEmpty():
            return done
        known = F.coalesce("_found", F.lit(0)) >= k
        rest = rest.withColumn("ring", F.col("ring") * 2 + 1)
        for i, f in enumerate(dims):
            ball = rest.withColumns({"_lo": F.col(f) - F.sqrt("_r2") * (1 + 1e-9), "_hi": F.col(f) + F.sqrt("_r2") * (1 + 1e-9)})
            if grid[f]:
                sp = [float("-inf"), *grid[f], float("inf")]
                for a, b in (("_lo", "_bl"), ("_hi", "_bh")):
                    ball = Bucketizer(splits=sp, inputCol=a, outputCol=b, handleInvalid="keep").transform(ball)
            else:
                ball = ball.withColumns({"_bl": F.lit(0.0), "_bh": F.lit(0.0)})
            rest = ball.withColumns({
                f"lo{i}": F.when(known, F.col("_bl").cast("int")).otherwise(F.greatest(F.col(f"h{i}") - F.col("ring"), F.lit(0))),
                # One cell more, since a ball that ends on an edge touches the next cell.
                f"hi{i}": F.when(known, F.least(F.col("_bh").cast("int"), F.lit(top[i]))).otherwise(F.least(F.col(f"h{i}") + F.col("ring"), F.lit(top[i]))),
            }).drop("_lo", "_hi", "_bl", "_bh")
        todo = stored(rest.select("qkey", *features, *[f"{p}{i}" for i in range(len(dims)) for p in ("h", "lo", "hi")], "ring",
                                    F.when(known, F.col("_r2")).alias("_bound")), "queries")


def neighbour_rows(near: DataFrame, features: Sequence[str], k: int, own: str = "own") -> DataFrame:
    """(qkey, neighbours): the k nearest other rows as vectors, copies repeated, the query itself counted out once."""
    near = near.withColumn("_c", F.col("copies") - F.col(own).cast("int"))
    w = Window.partitionBy("qkey").orderBy("d2", "vkey").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    take = F.least(F.col("_c"), F.lit(k) - F.col("_before"))
    near = near.withColumn("_take", take.cast("int")).where(F.col("_take") > 0)
    vec = F.struct("d2", "vkey", *features)
    lists = near.groupBy("qkey").agg(F.collect_list(F.struct("d2", "vkey", F.array_repeat(vec, F.col("_take")).alias("v"))).alias("_l"))  # at most k entries
    return lists.select("qkey", F.flatten(F.transform(F.array_sort("_l"), lambda x: x["v"])).alias("neighbours"))


def class_sizes(df: DataFrame, label: str) -> tuple[int, int, int, int]:
    """(minority label, its rows, majority rows) from one aggregate of two rows."""
    n = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    return (1, n1, n0, n0 + n1) if n1 <= n0 else (0, n0, n1, n0 + n1)


def interpolate(seeds: DataFrame, minority: DataFrame, features: Sequence[str], key: str, n_new: int, k: int, seed: int) -> DataFrame:
    """``n_new`` synthetic vectors x + u (neighbour - x); base rows drawn from ``seeds`` with replacement.

    Draw, neighbour and u are hashes of the draw number.  Only rows actually drawn look for neighbours.
    """
    spark = seeds.sparkSession
    m = seeds.count()
    if not m:
        raise ValueError("no rows to interpolate from")
    ranked = hash_ranks(seeds.select(key, *features), [], f"smote{seed}", key)
    draws = spark.range(n_new).select(
        F.col("id").alias("draw"),
        (F.floor(uniform(order_key(f"base{seed}", "id")) * m) + 1).alias("rn"),
        uniform(order_key(f"pick{seed}", "id")).alias("_pick"),
        uniform(order_key(f"gap{seed}", "id")).alias("_u"),
    )
    drawn = stored(draws.join(ranked, "rn").select("draw", "_pick", "_u", F.col(key).alias("qkey"), *features), "drawn")
    queries = drawn.groupBy(*features).agg(F.min("qkey").alias("qkey"))  # copies of a vector have the same neighbours
    near = nearest(queries, pooled(minority, features, key), features, k + 1)
    near = near.withColumn("own", F.col("d2") == 0)
    lists = neighbour_rows(near, features, k)
    lists = lists.join(queries, "qkey").select("neighbours", *[F.col(f).alias(f"q_{f}") for f in features])
    same = [F.col(f).eqNullSafe(F.col(f"q_{f}")) for f in features]
    out = drawn.join(lists, same).withColumn("_n", F.element_at("neighbours", (F.floor(F.col("_pick") * F.size("neighbours")) + 1).cast("int")))
    return out.select("draw", *[(F.col(f) + F.col("_u") * (F.col("_n")[f] - F.col(f))).alias(f) for f in features])


def smote(df: DataFrame, features: Sequence[str], label: str, key: str, ratio: float = 1.0, k: int = 5, seed: int = 42) -> DataFrame:
    """Original vectors and enough synthetic minority vectors to reach the ratio: (features, label)."""
    minor, n_min, n_maj, _ = class_sizes(df, label)
    base = df.select(*features, label)
    n_new = int(ratio * n_maj) - n_min
    if n_new <= 0:
        return base
    rows = df.where(F.col(label) == minor)
    return base.unionByName(interpolate(rows, rows, features, key, n_new, k, seed).drop("draw").withColumn(label, F.lit(minor)))


def danger_rows(df: DataFrame, features: Sequence[str], label: str, key: str, minor: int, m: int = 10) -> DataFrame:
    """Minority rows of which at least half, but not all, of the m nearest rows belong to the majority.

    Among equally distant rows the majority counts first.
    """
    rows = df.where(F.col(label) == minor)
    points = pooled(df.withColumn("_y", F.col(label)), features, key, ["_y"])
    points = points.withColumn("vkey", F.concat_ws("|", F.when(F.col("_y") == minor, "1").otherwise("0"), "vkey"))
    own = pooled(rows, features, key)  # copies of a vector have the same neighbours
    near = nearest(own.select(F.col("vkey").alias("qkey"), *features), points, features, m + 1)
    near = near.withColumn("_c", F.col("copies") - ((F.col("d2") == 0) & (F.col("_y") == minor)).cast("int"))
    w = Window.partitionBy("qkey").orderBy("d2", "vkey").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_take", F.greatest(F.least(F.col("_c"), F.lit(m) - F.coalesce(F.sum("_c").over(w), F.lit(0))), F.lit(0)))
    g = near.groupBy("qkey").agg(F.sum(F.when(F.col("_y") != minor, F.col("_take")).otherwise(0)).alias("n_major"))
    hit = g.where((F.col("n_major") >= m / 2) & (F.col("n_major") < m)).select(F.col("qkey").alias("vkey"))
    vectors = own.join(hit, "vkey", "left_semi").select(*features)
    return rows.join(vectors, list(features), "left_semi")


def borderline_smote(df: DataFrame, features: Sequence[str], label: str, key: str, ratio: float = 1.0, k: int = 5, m: int = 10, seed: int = 42) -> DataFrame:
    minor, n_min, n_maj, _ = class_sizes(df, label)
    n_new = int(ratio * n_maj) - n_min
    base = df.select(*features, label)
    if n_new <= 0:
        return base
    seeds = stored(danger_rows(df, features, label, key, minor, m).select(key, *features), "danger")
    rows = df.where(F.col(label) == minor)
    return base.unionByName(interpolate(seeds, rows, features, key, n_new, k, seed).drop("draw").withColumn(label, F.lit(minor)))


def margin_smote(df: DataFrame, features: Sequence[str], label: str, key: str, ratio: float = 1.0, k: int = 5, seed: int = 42, iterations: int = 20) -> DataFrame:
    """Seeds are the minority rows inside the margin of a linear support vector machine."""
    minor, n_min, n_maj, n = class_sizes(df, label)
    n_new = int(ratio * n_maj) - n_min
    base = df.select(*features, label)
    if n_new <= 0:
        return base
    svc = models.margin(1.0, n, iterations).fit(models.assemble(df.select(*features, label), features, label))
    rows = df.where(F.col(label) == minor)
    scored = models.scored(svc, models.assemble(rows, features, label), [key, *features])
    sign = 1.0 if minor == 1 else -1.0
    seeds = stored(scored.where(F.col("score") * sign <= 1.0).select(key, *features), "margin")
    return base.unionByName(interpolate(seeds, rows, features, key, n_new, k, seed).drop("draw").withColumn(label, F.lit(minor)))


def augment(df: DataFrame, features: Sequence[str], label: str, key: str, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """Union of the three strategies without duplicates; a strategy that fails repeats the one before it."""
    out, last = None, df.select(*features, label)
    for strategy in (smote, borderline_smote, margin_smote):
        try:
            last = strategy(df, features, label, key, ratio=ratio, seed=seed)
        except ValueError:
            pass
        out = last if out is None else out.unionByName(last)
    return out.dropDuplicates()
