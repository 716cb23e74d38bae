"""Exact Jaccard join of shingle sets as a join in a metric space (distance d = 1 - J, links at d <= 1 - threshold).

1. Cells.  Every set is read in one global order of hashes, shingles that are frequent in a sample of the sets last (any
   order gives the same result).  The shingles of its beginning are one-element pivots; a set belongs to the cells of all
   pivots in a window long enough that two linked sets share at least ``need`` cells (needed differences are at most a
   quarter of the larger set).  Sets that share fewer cells with others have no links.
2. Regions.  In every cell the smallest set is a pivot.  A set goes to the pivot it shares most cells with and stays in
   its Voronoi region if the exact distance is a link; otherwise it is a region of its own.
3. Between regions that share a cell only pivots are compared.  By the triangle inequality members can be linked only if
   d(p, q) <= limit + radius(p) + radius(q).  What passes is joined again member by member, with the windows
   d(x, q) <= limit + radius(q) and |d(x, p) - d(y, p)| <= limit.
4. A cell of very many regions is left out of step 3.  Fresh pivots first connect the dense groups in such cells.  A pair
   that shares only such cells consists of two sets with ``need`` of them each: those sets draw their cells again, from a
   shorter window, and meet there, where sizes, places and bitmaps allow a link.

Equal sets are one set throughout, and sets known to be connected are not compared again, so a group of copies costs
its size and not its square, while no link between different texts is lost.  Sets are told apart by 64-bit hashes.

Results: null, empty and blank texts have no shingles and no links; fewer words than ``size`` make one shingle; repeated
rows belong to one class; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from windowlab.llm.arrays import Words, mix, pieces, shingles, text_bytes
from windowlab.llm.graph import components, jump
from windowlab.llm.store import extend, filter_slot, id_filter, in_filter, join_sizes, partitions, stored
from windowlab.session import compiled_code

SIZE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
LIMIT = 0.25
#: Regions of one cell that are compared pairwise; cells with more are split by pivots first.
CELL_REGIONS = 64
#: Bits of the bitmap that bounds a distance before whole sets are compared.
BITS = 1024
#: Rounds of fresh pivots that connect dense groups before crowded cells are joined; any number gives the same result.
MERGE_ROUNDS = 4
#: Frequent shingles are counted in one set of ``SHARE``, at least in ``SAMPLE`` sets; those found ``OFTEN`` times, at most
#: ``FREQUENT`` of them, stand last in the order of windows.  Any numbers give the same result.
SHARE, SAMPLE, OFTEN, FREQUENT = 16, 20_000, 4, 1_000_000


def least_common(n):
    """A partner shares at least three quarters of a set of n."""
    return -(-PERCENT * n // 100)


def need_of(n):
    """Cells that two linked sets share at least, by the size of the smaller one."""
    return 1 + n // 10


def set_rows(piece: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row: (hashes, first, n)."""
    words = Words(*text_bytes(piece.column("text")))
    row, h = shingles(words, words.hashes(), size)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    first = np.searchsorted(row, np.arange(words.rows + 1))
    return h, first, np.diff(first)


def set_keys(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each whole set (0 for an empty one): the sum of its mixed members."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(0x9E3779B97F4A7C15)), out=sums[1:])
    key = mix((sums[first[1:]] - sums[first[:-1]]) ^ mix(n.astype(np.uint64)))
    return np.where(n > 0, key, 0).view(np.int64)


def lists(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.Array:
    """The first ``count`` values of every row as an Arrow list column."""
    ends = np.cumsum(count)
    take = np.repeat(first[:-1] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values[take].view(np.int64)))


def read_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, key, n): the key of the set and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, first, n = set_rows(piece, size)
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(set_keys(h, first, n)), pa.array(n.astype(np.int64))], ["id", "key", "n"])

    return docs.mapInArrow(run, extend(docs.select("id"), "key bigint, n bigint"))


def frequent(docs: DataFrame, keys: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many sets hold, and a class of each that grows with its count in a sample of the sets.

    The sample decides the order in which windows are read and nothing else.
    """
    share = max(1 / SHARE, SAMPLE / max(keys.count(), 1))
    held = docs.sparkSession.sparkContext.broadcast(id_filter(keys.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20))), "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(np.asarray(batch.column("slot")), held.value)))
            for piece in pieces(batch, "text"):
                h, first, n = set_rows(piece, size)
                once = np.zeros(len(n), bool)
                once[np.unique(set_keys(h, first, n), return_index=True)[1]] = True
                token, c = np.unique(h[np.repeat(once, n)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(c)], ["token", "c"])

    made = docs.select(filter_slot("id").alias("slot"), "text").mapInArrow(run, "token bigint, c bigint").groupBy("token").agg(F.sum("c").alias("c"))
    found = made.filter(F.col("c") >= OFTEN).orderBy(F.desc("c"), "token").limit(FREQUENT).toPandas()
    token, c = (found[name].to_numpy(np.int64) for name in ("token", "c"))
    order = np.argsort(token.view(np.uint64))
    return token.view(np.uint64)[order], np.minimum(1 + 4 * np.log2(np.maximum(c[order], 1)), 255).astype(np.uint8)


def read_late(h: np.ndarray, n: np.ndarray, codes: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """Members of all sets, frequent ones at the end of their set, the most frequent last."""
    if not len(codes):
        return h
    at = np.minimum(np.searchsorted(codes, h), len(codes) - 1)
    late = np.where(codes[at] == h, grade[at], 0)
    return h[np.argsort((np.repeat(np.arange(len(n)), n) << 8) + late, kind="stable")]


def window_cells(docs: DataFrame, wanted: DataFrame, size: int, often: Broadcast) -> DataFrame:
    """(token, key): the shingles of each set's window, read from one text of every set (``wanted`` has its id).

    Texts are hashed a second time, which costs less than to keep the windows of all rows on disk.
    """
    held = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(np.asarray(batch.column("slot")), held.value)))
            for piece in pieces(batch, "text"):
                h, first, n = set_rows(piece, size)
                low = np.minimum(n, n - least_common(n) + need_of(n)) * (n > 0)
                tokens = lists(read_late(h, n, *often.value), first, low)
                yield pa.RecordBatch.from_arrays([tokens.flatten(), pa.array(np.repeat(set_keys(h, first, n), low))], ["token", "key"])

    return docs.select(filter_slot("id").alias("slot"), "text").mapInArrow(run, "token bigint, key bigint")


def parities(h: np.ndarray, n: np.ndarray) -> pa.Array:
    """A bitmap of every set: bit i is the parity of its members in slot i.  Two bitmaps differ in at most as many bits as the sets differ in members."""
    row = np.repeat(np.arange(len(n)), n)
    odd = np.bincount(row * BITS + (h & np.uint64(BITS - 1)).astype(np.int64), minlength=len(n) * BITS) & 1
    words = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (BITS // 64)), pa.array(words))


def least_distance(a: str, b: str, na: str, nb: str) -> Column:
    """A lower bound of the distance of two sets from their bitmaps and sizes."""
    differ = sum((F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    return 2 * differ / (F.col(na) + F.col(nb) + differ)


def full_sets(docs: DataFrame, wanted: DataFrame, size: int, often: Broadcast | None = None) -> DataFrame:
    """(key, members, bits): one row for each wanted key, however often its text is repeated; rows of other ids are left out before the shuffle.

    Members are in the order of the windows if ``often`` is given.
    """
    held = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task sends every set once
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(np.asarray(batch.column("slot")), held.value)))
            for piece in pieces(batch, "text"):
                h, first, n = set_rows(piece, size)
                key = set_keys(h, first, n)
                fresh = [i for i in np.sort(np.unique(key, return_index=True)[1]).tolist() if int(key[i]) not in seen]
                seen.update(key[fresh].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(key), lists(read_late(h, n, *often.value) if often else h, first, n), parities(h, n)], ["key", "members", "bits"]).take(pa.array(fresh, pa.int64()))

    # equal keys are equal sets, so any row of a wanted key will do, also one without an id
    made = docs.select(filter_slot("id").alias("slot"), "text").mapInArrow(run, "key bigint, members array<bigint>, bits array<bigint>")
    made = made.repartition(partitions(docs.sparkSession), "key").groupBy("key").agg(F.first("members").alias("members"), F.first("bits").alias("bits"))
    return made.join(wanted.select("key"), "key")


def shared_cells(rows: DataFrame) -> DataFrame:
    """(token, key) of the cells that hold at least two different sets; a cell streams through, whatever its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shared = None, False  # the last row, and whether its cell has an earlier one
        for batch in batches:
            t, k = (np.asarray(batch.column(c)) for c in ("token", "key"))
            if held is not None:
                t, k = (np.concatenate([[a], b]) for a, b in zip(held, (t, k)))
            if not len(t):
                continue
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
            t, k = t[new], k[new]
            same = np.zeros(len(t) + 1, bool)
            same[1:-1] = t[1:] == t[:-1]
            same[0] = shared
            keep = (same[:-1] | same[1:])[:-1]
            held, shared = (t[-1], k[-1]), bool(same[-2])
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in (t, k)], ["token", "key"])
        if held is not None and shared:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held], ["token", "key"])

    return rows.repartition(partitions(rows.sparkSession), "token").sortWithinPartitions("token", "key").mapInArrow(run, "token bigint, key bigint")


def measured(pairs: DataFrame, sets: DataFrame, most: Column) -> DataFrame:
    """The pairs (a, b, ...) at a distance ``d`` of at most ``most``, with ``common`` and ``total`` (sizes of intersection and union).

    Bitmaps leave out most of the others before whole sets are moved.
    """
    side = lambda k, c: sets.select(F.col("key").alias(k), c.alias(f"_{k}{k}"), F.size("members").alias(f"_n{k}"))
    near = pairs.join(side("a", F.col("bits")), "a").join(side("b", F.col("bits")), "b").filter(least_distance("_aa", "_bb", "_na", "_nb") <= most + 1e-9)
    near = near.drop("_aa", "_bb", "_na", "_nb")
    both = near.join(side("a", F.col("members")), "a").join(side("b", F.col("members")), "b").withColumn("common", F.size(F.array_intersect("_aa", "_bb")).cast("bigint"))
    both = both.withColumn("total", F.col("_na") + F.col("_nb") - F.col("common")).drop("_aa", "_bb", "_na", "_nb")
    return both.withColumn("d", 1 - F.col("common") / F.col("total")).filter(F.col("d") <= most + 1e-9)


def linked() -> Column:
    return 100 * F.col("common") >= PERCENT * F.col("total")


def near_sizes(a: str, b: str) -> Column:
    """Sizes that a link allows."""
    return (100 * F.col(a) >= PERCENT * F.col(b)) & (100 * F.col(b) >= PERCENT * F.col(a))


def needed_cells(a: str, b: str) -> Column:
    """Cells that two linked sets of these sizes share at least: of their ceil(3/7 (a + b)) common shingles, those that
    stand in the shorter window of the two; never less than ``need_of`` of either size."""
    return F.expr(f"(3 * ({a} + {b}) + 6) div 7 + least(1 + {a} div 10 - ({PERCENT} * {a} + 99) div 100, 1 + {b} div 10 - ({PERCENT} * {b} + 99) div 100)")


def merge_dense(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(links, (root, top)): groups of near copies in crowded cells (token, key, root), connected by fresh pivots.

    Every round draws one pivot per cell; a set tries the pivot of another root that it shares most cells with.  The work
    is one comparison per set and round, and what is connected here is not compared in pairs later.
    """
    links, top, spark = None, None, rows.sparkSession
    for k in range(MERGE_ROUNDS):
        drawn = rows.groupBy("token").agg(F.min_by(F.struct(F.col("key").alias("b"), F.col("root").alias("rb")), F.xxhash64("key", F.lit(k))).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        tried = rows.join(drawn.filter("lo <> hi").select("token", "p.b", "p.rb"), "token").filter("root <> rb").groupBy("key", "root", "b", "rb").agg(F.count("*").alias("c"))
        best = tried.groupBy("key", "root").agg(F.max(F.struct("c", "b", "rb")).alias("x")).select(F.col("key").alias("a"), F.col("x.b").alias("b"), F.col("root").alias("ra"), F.col("x.rb").alias("rb"))
        found = stored(measured(best, sets, F.lit(LIMIT)).filter(linked()).select("a", "b", "ra", "rb"), "found")
        links = found.select("a", "b") if links is None else links.unionByName(found.select("a", "b"))
        up = components(found.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
        if not up.limit(1).count():
            break
        rows = stored(rows.join(up, "root", "left").select("token", "key", F.coalesce("top", "root").alias("root")), "merged")
        if top is None:
            top = up
        else:
            top = stored(top.join(up.select(F.col("root").alias("top"), F.col("top").alias("higher")), "top", "left").select("root", F.coalesce("higher", "top").alias("top")).unionByName(up.join(top.select("root"), "root", "left_anti")), "top")
    return links, top if top is not None else spark.createDataFrame([], "root bigint, top bigint")


def split_hot(heavy: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, candidate pairs): both (a, b), of sets (key, n, root) that may meet in crowded cells only; equal roots are not paired.

    The cells are drawn once more, from the first quarter of the sets, where linked sets still meet.  A pair must fit the
    place of the shingle in both sets, their sizes and the distance that their bitmaps allow.
    """
    window = F.expr(f"cast(n - (({PERCENT} * n + 99) div 100) + 1 as int)")
    cells = stored(sets.join(heavy, "key").select("key", "n", "root", F.posexplode(F.slice("members", F.lit(1), window)).alias("before", "token")), "drawn")
    cells = cells.join(cells.groupBy("token").agg(F.count("*").alias("often")).filter("often > 1").select("token"), "token")
    # with ``before`` shingles ahead of the first common one, n - before bounds the intersection, ceil(3/7 (n + m));
    # so of two linked sets at least one has 7 * before <= n
    cells = stored(cells.select("token", "key", "n", "before", (7 * F.col("before") <= F.col("n")).alias("early"), "root"), "cells")
    links, top = merge_dense(cells.select("token", "key", "root"), sets)
    cells = stored(cells.join(top, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top"), "cells")
    by_root = cells.groupBy("token", "root").agg(F.count("*").alias("c"), F.max("early").alias("any"))
    useful = by_root.groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"), F.max("any").alias("any")).filter("roots > 1 and any")
    cells = cells.join(useful.select("token", "main"), "token").join(sets.select("key", "bits"), "key")
    # of two roots in a cell at least one is not its largest
    x, y = (cells.select("token", "main", *(F.col(c).alias(k + c) for c in ("key", "n", "before", "early", "root", "bits"))) for k in "xy")
    fits = lambda k: 7 * (F.col(f"{k}n") - F.col(f"{k}before")) >= 3 * (F.col("xn") + F.col("yn"))
    met = x.filter("xroot <> main").drop("main").join(y.drop("main"), "token").filter(
        (F.col("xroot") != F.col("yroot")) & (F.col("xearly") | F.col("yearly")) & near_sizes("xn", "yn") & fits("x") & fits("y") & (least_distance("xbits", "ybits", "xn", "yn") <= LIMIT + 1e-9)
    )
    return links, met.select(F.least("xkey", "ykey").alias("a"), F.greatest("xkey", "ykey").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, n, class): the size of each row's set and the smallest id reachable by links."""
    compiled_code(docs.sparkSession)  # bitmaps are compared in long expressions
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = stored(read_sets(docs, size), "sets")
    keys = stored(made.filter("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.count("*").alias("copies")), "keys")
    often = docs.sparkSession.sparkContext.broadcast(frequent(docs, keys, size))
    cells = stored(shared_cells(window_cells(docs, keys, size, often)), "cells")

    # sets that share too few cells have no links; what is left is cells between the others
    small = F.expr("1 + n div 10")
    counts = cells.groupBy("key").agg(F.count("*").alias("c"))
    live = stored(counts.join(keys.select("key", "id", "n"), "key").filter(F.col("c") >= small).select("key", "n", "id"), "live")
    cells = cells.join(live.select("key"), "key", "left_semi")
    pivot = cells.groupBy("token").agg(F.min("key").alias("pivot"), F.count("*").alias("m")).filter("m > 1")
    cells = stored(cells.join(pivot.select("token", "pivot"), "token"), "cells")
    sets = stored(full_sets(docs, live, size, often), "members")

    # regions
    best = cells.filter("key <> pivot").groupBy("key", "pivot").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", F.col("pivot"))).alias("b"))
    homes = stored(measured(best.select(F.col("key").alias("a"), F.col("b.pivot").alias("b")), sets, F.lit(LIMIT)).filter(linked()).select("a", "b", "d"), "homes")
    heads = homes.groupBy("b").agg(F.max("d").alias("radius"))
    roots = jump(stored(homes.select(F.col("a").alias("node"), F.col("b").alias("parent")), "homes"))
    region = live.select("key", "n").join(homes.select(F.col("a").alias("key"), F.col("b").alias("home"), "d"), "key", "left").join(heads.select(F.col("b").alias("key"), "radius"), "key", "left")
    region = region.join(roots.select(F.col("node").alias("key"), F.col("parent").alias("root")), "key", "left").select(
        "key", "n", F.coalesce("root", "key").alias("root"), F.coalesce("radius", F.lit(0.0)).alias("radius"),
        F.when(F.col("radius").isNotNull() | F.col("home").isNull(), F.col("key")).otherwise(F.col("home")).alias("region"),
        F.when(F.col("radius").isNotNull() | F.col("home").isNull(), F.lit(0.0)).otherwise(F.col("d")).alias("d"),
    )
    region = stored(region, "region")

    # cells that connect regions of different roots
    placed = cells.select("token", "key").join(region.select("key", "n", "region", "root"), "key")
    wide = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.approx_count_distinct("region").alias("regions")).filter("lo <> hi")
    placed = stored(placed.join(wide.select("token", (F.col("regions") > CELL_REGIONS).alias("hot")), "token"), "placed")
    merged = None
    if placed.filter("hot").limit(1).count():
        merged, top = merge_dense(placed.filter("hot").select("token", "key", "root"), sets)
        region = stored(region.join(top, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top"), "region")
        placed = stored(placed.drop("root").join(region.select("key", "root"), "key"), "placed")
    calm = placed.filter("not hot").select("token", "region", "root").distinct()
    # two sets share at least ``need`` cells; what their regions share, hot cells included, bounds that
    heat = placed.filter("hot").groupBy("key").agg(F.count("*").alias("h"))
    bound = region.join(heat, "key", "left").groupBy("region").agg(F.min(small).alias("need"), F.max(F.coalesce("h", F.lit(0))).alias("h"), F.min("n").alias("n"), F.max("n").alias("most"))
    x, y = (calm.select("token", F.col("region").alias(a), F.col("root").alias(r)) for a, r in (("a", "ra"), ("b", "rb")))
    pairs = x.join(y, "token").filter("a < b and ra <> rb").groupBy("a", "b").agg(F.count("*").alias("c"))
    side = lambda k: bound.select(F.col("region").alias(k), *(F.col(c).alias(c + k) for c in ("need", "h", "n", "most")))
    needed = F.when((F.col("na") == F.col("mosta")) & (F.col("nb") == F.col("mostb")), F.when(near_sizes("na", "nb"), needed_cells("na", "nb"))).otherwise(F.least("needa", "needb"))
    pairs = stored(pairs.join(side("a"), "a").join(side("b"), "b").filter(F.col("c") + F.least("ha", "hb") >= needed).select("a", "b"), "pairs")
    heavy = stored(heat.join(region.select("key", "n", "root"), "key").filter(F.col("h") >= small).select("key", "n", "root"), "heavy")
    radius = region.filter("key = region").select("key", "radius")
    placed_pairs = pairs.join(radius.select(F.col("key").alias("a"), F.col("radius").alias("ra")), "a").join(radius.select(F.col("key").alias("b"), F.col("radius").alias("rb")), "b")
    near = stored(measured(placed_pairs, sets, LIMIT + F.col("ra") + F.col("rb")), "near")
    links = homes.select("a", "b").unionByName(near.filter(linked()).select("a", "b"))
    links = stored(links if merged is None else links.unionByName(merged), "links")

    joined = components(links)

    # members of neighbouring regions that are still apart
    open_ = near.filter(~linked() & ((F.col("ra") > 0) | (F.col("rb") > 0)))
    if open_.limit(1).count():
        root = lambda c: joined.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        apart = open_.join(root("a"), "a", "left").join(root("b"), "b", "left").filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "ra", "rb")
        apart = stored(apart, "apart")
        m = region.select("region", "key", "n", F.col("d").alias("own"))
        left = apart.join(m.select(F.col("region").alias("a"), F.col("key").alias("x"), F.col("n").alias("nx"), F.col("own").alias("xa")), "a")
        right = apart.join(m.select(F.col("region").alias("b"), F.col("key").alias("y"), F.col("n").alias("ny"), F.col("own").alias("yb")), "b")
        left = measured(left.select(F.col("x").alias("a"), "b", F.col("a").alias("p"), F.col("b").alias("q"), "nx", "xa", "rb"), sets, LIMIT + F.col("rb"))
        right = measured(right.select(F.col("y").alias("b"), "a", F.col("a").alias("p"), F.col("b").alias("q"), "ny", "yb", "ra"), sets, LIMIT + F.col("ra"))
        left, right = stored(left.select("p", "q", F.col("a").alias("x"), "nx", "xa", F.col("d").alias("xb"), "common", "total"), "left"), stored(right.select("p", "q", F.col("b").alias("y"), "ny", "yb", F.col("d").alias("ya"), "common", "total"), "right")
        links = links.unionByName(left.filter(linked()).select(F.col("x").alias("a"), F.col("q").alias("b"))).unionByName(right.filter(linked()).select(F.col("y").alias("a"), F.col("p").alias("b")))
        inner = left.drop("common", "total").join(right.drop("common", "total"), ["p", "q"]).filter(
            near_sizes("nx", "ny") & (F.abs(F.col("xa") - F.col("ya")) <= LIMIT + 1e-9) & (F.abs(F.col("xb") - F.col("yb")) <= LIMIT + 1e-9) & (F.col("x") != F.col("y"))
        )
        links = links.unionByName(measured(inner.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), sets, F.lit(LIMIT)).filter(linked()).select("a", "b"))
    heavy = heavy.drop("root").join(joined.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    if heavy.limit(2).count() > 1:
        more, pairs = split_hot(heavy, sets)
        links = links.unionByName(more).unionByName(measured(pairs, sets, F.lit(LIMIT)).filter(linked()).select("a", "b"))

    joined = components(links)
    labels = keys.join(joined.select(F.col("node").alias("key"), "root"), "key", "left").select("key", "id", "copies", F.coalesce("root", "key").alias("root"))
    labels = stored(labels, "labels")
    least = labels.groupBy("root").agg(F.min("id").alias("class"), F.count("*").alias("sets"))
    by_key = join_sizes(labels.select("key", "copies", "root"), least, "root", "sets").select("key", "copies", "class")
    out = join_sizes(made.filter("n > 0").select("id", "n", "key"), by_key, "key", "copies").select("id", "n", "class")
    return out.unionByName(made.filter("n = 0").select("id", "n", F.col("id").alias("class")))
