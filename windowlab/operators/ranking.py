"""Exact ranks, prefix sums and quantiles without putting a group into one task.

A plain window over (domain) or (domain, label) would sort a whole domain in one
task.  Here rows are first cut into ordered buckets; the small table of bucket
totals (bounded by the number of buckets) is prefix-summed, and the window runs
inside a bucket only.  The result is the same number the plain window gives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from windowlab.functions.hashing import order_key

HASH_DIGITS = 4  # 65,536 buckets of md5 order: 10^11 rows of one part leave 1.5 million per bucket
CUT_DIGITS = 3  # 4,096 buckets where only those that hold a cut are ranked: 10^9 rows of one part leave 250,000 per bucket, and totals stay few


def hash_ranks(
    df: DataFrame, parts: Sequence[str], seed, key: str, rank: str = "rn", size: str = "n_part", limit: int | None = None
) -> DataFrame:
    """Add the 1-based position of each row in (md5(seed|key), key) order and the size of its part.

    With ``limit`` only the first rows of each part are kept; buckets beyond it are dropped before any shuffle.

    ``key`` is unique inside a part; md5 spreads the rows evenly over the buckets.
    ``seed`` is a value or a column that belongs to ``parts``.
    """
    parts = list(parts)
    work = df.withColumn("_h", order_key(seed, key))
    work = work.withColumn("_bucket", F.conv(F.substring("_h", 1, HASH_DIGITS), 16, 10).cast("int"))
    totals = work.groupBy(*parts, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_part = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
    before = by_part.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *parts,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(by_part).alias(size),
    )
    if limit is not None:
        # parts x the buckets that hold their first rows, usually one.
        offsets = F.broadcast(offsets.where(F.col("_offset") < limit))
    inside = Window.partitionBy(*parts, "_bucket").orderBy("_h", key)
    out = work.join(offsets, [*parts, "_bucket"]).withColumn(rank, F.col("_offset") + F.row_number().over(inside))
    if limit is not None:
        out = out.where(F.col(rank) <= limit)
    return out.drop("_h", "_bucket", "_offset")


def split_points(df: DataFrame, x: str, buckets: int | None = None) -> list[float]:
    """Approximate quantiles of ``x`` used only to balance buckets; the list is bounded by ``buckets``."""
    if buckets is None:
        buckets = max(8, min(1024, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    probs = [i / buckets for i in range(1, buckets)]
    return sorted(set(df.approxQuantile(x, probs, 1.0 / (4 * buckets))))


def with_bucket(df: DataFrame, x: str, points: Sequence[float]) -> DataFrame:
    """Add ``_bucket``, non-decreasing in ``x``."""
    if not points:
        return df.withColumn("_bucket", F.lit(0.0))
    splits = [float("-inf"), *points, float("inf")]
    return Bucketizer(splits=splits, inputCol=x, outputCol="_bucket", handleInvalid="keep").transform(df)


def prefix_sums(
    df: DataFrame,
    parts: Sequence[str],
    x: str,
    sums: Sequence[str],
    points: Sequence[float] | None = None,
    following: str | None = None,
    keep_bucket: bool = False,
) -> DataFrame:
    """For rows unique in (parts, x): ``<s>_before`` = sum of s over smaller x, ``<s>_total`` = sum over the part.

    With ``following`` given, that column holds the next larger x of the part (null at the end).
    """
    parts = list(parts)
    if points is None:
        points = split_points(df, x)
    work = with_bucket(df, x, points)
    totals = work.groupBy(*parts, "_bucket").agg(
        *[F.sum(s).alias(f"_t_{s}") for s in sums], F.min(x).alias("_first")
    )
    by_part = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
    ordered = by_part.orderBy("_bucket")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *parts,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(by_part).alias(f"{s}_total") for s in sums],
        F.lead("_first").over(ordered).alias("_next_first"),
    )
    inside = Window.partitionBy(*parts, "_bucket").orderBy(x)
    inside_before = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = work.join(offsets, [*parts, "_bucket"])
    for s in sums:
        out = out.withColumn(f"{s}_before", F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(inside_before), F.lit(0)))
    if following:
        out = out.withColumn(following, F.coalesce(F.lead(x).over(inside), F.col("_next_first")))
    return out.drop("_next_first", *([] if keep_bucket else ["_bucket"]), *[f"_o_{s}" for s in sums])


def exact_quantiles(
    df: DataFrame, parts: Sequence[str], x: str, probs: Sequence[float], prob: str = "prob", value: str = "q",
    points: Sequence[float] | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per part, as rows (parts, prob, q).

    Equal values are counted before the shuffle; bucket totals tell which bucket holds a wanted
    position and only its rows are compared with it, so no task sees a whole part.
    """
    parts = list(parts)
    counts = df.where(F.col(x).isNotNull()).groupBy(*parts, x).agg(F.count(F.lit(1)).alias("_c"))
    points = split_points(df, x) if points is None else points
    ranked = prefix_sums(counts, parts, x, ["_c"], points=points, keep_bucket=True)
    # Wanted positions per part, located in their bucket: parts x probs x 2 rows.
    by_part = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
    before = by_part.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = with_bucket(counts, x, points).groupBy(*parts, "_bucket").agg(F.sum("_c").alias("_n"))
    buckets = buckets.select(
        *parts, "_bucket", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.sum("_n").over(by_part).alias("_all")
    )
    pos = F.col(prob) * (F.col("_all") - 1)
    targets = (
        buckets.withColumn(prob, F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .select("*", F.inline(F.array(
            F.struct(F.lit(0).alias("_end"), F.floor(pos).alias("_pos"), (pos - F.floor(pos)).alias("_frac")),
            F.struct(F.lit(1).alias("_end"), F.ceil(pos).alias("_pos"), (pos - F.floor(pos)).alias("_frac")),
        )))
        .where((F.col("_pos") >= F.col("_offset")) & (F.col("_pos") < F.col("_offset") + F.col("_n")))
        .select(*parts, "_bucket", prob, "_end", "_pos", "_frac")
    )
    hits = ranked.join(targets, [*parts, "_bucket"]).where(
        (F.col("_pos") >= F.col("_c_before")) & (F.col("_pos") < F.col("_c_before") + F.col("_c"))
    )
    low, high = F.max(F.when(F.col("_end") == 0, F.col(x))), F.max(F.when(F.col("_end") == 1, F.col(x)))
    return hits.groupBy(*parts, prob).agg((low + (high - low) * F.max("_frac")).alias(value))


def hash_cuts(df: DataFrame, parts: Sequence[str], seed, key: str, positions: dict[str, Column]) -> DataFrame:
    """The keys standing at given positions of the (md5(seed|key), key) order, one row per part.

    ``positions`` are columns over ``n_part``.  Bucket totals tell which bucket holds a position and
    only that bucket (a 4,096th of the part) is ranked.  Returns ``cut_<name>`` structs (h, k); null for position 0.
    """
    parts = list(parts)
    work = df.select(*parts, F.col(key).alias("k"), order_key(seed, key).alias("h"))
    work = work.withColumn("_bucket", F.substring("h", 1, CUT_DIGITS))  # hexadecimal digits of one length are in order as text
    totals = work.groupBy(*parts, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_part = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
    before = by_part.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    located = totals.select(
        *parts,
        "_bucket",
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(by_part).alias("n_part"),
    ).select(
        *parts,
        "_bucket",
        "_n",
        "_offset",
        F.inline(F.array(*[F.struct(F.lit(n).alias("_name"), p.cast("bigint").alias("_pos")) for n, p in positions.items()])),
    )
    targets = located.where((F.col("_pos") > F.col("_offset")) & (F.col("_pos") <= F.col("_offset") + F.col("_n")))
    # parts x positions rows.
    hits = work.join(F.broadcast(targets), [*parts, "_bucket"])
    w = Window.partitionBy(*parts, "_name").orderBy("h", "k")
    hits = hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == F.col("_pos") - F.col("_offset"))
    found = hits.groupBy(*parts).agg(*[
        F.max(F.when(F.col("_name") == n, F.struct("h", "k"))).alias(f"cut_{n}") for n in positions
    ])
    return found


def below_cut(h: str, key: str, cut: str) -> Column:
    """Whether a row with order key ``h`` stands at or before the cut of its part."""
    return F.struct(F.col(h).alias("h"), F.col(key).alias("k")) <= F.col(cut)
