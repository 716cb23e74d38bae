"""Removal of long repeated substrings by a common-prefix interval tree over an enhanced suffix array.

Every string of ``length`` bytes holds an anchor: the place of its smallest hash of ``GRAM`` bytes.  Equal strings have
it at the same offset, so the suffix array need only hold suffixes that begin at anchors (about one byte in 75), and of
them only those whose anchor gram occurs twice.  Suffixes of one gram are sorted by what follows the anchor; a stack
scan over their common prefix lengths gives the intervals of the tree: sets of suffixes that share their next R bytes.
In every interval the texts before the anchors are compared: those that share at least ``length`` - R bytes form a
maximal repeat, with all its occurrences.  Its windows are what is removed.

Equal contexts are one row with a weight, equal texts are one text.  A gram with very many different contexts is not
gathered: its windows are hashed and counted instead, which gives the same windows.
Contexts and texts are told apart by 64-bit hashes.

Results: null text is empty; texts shorter than ``length`` lose nothing; repeated rows are other occurrences of each
other; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from windowlab.llm.arrays import BYTE_CODE, mix, pieces, powers, text_bytes
from windowlab.llm.store import bit_filter, extend, in_filter, join_sizes, partitions, stored

LENGTH = 200
GRAM = 48
PLACE_BITS = 24
BLOCK = 1 << 22
#: Different contexts of one gram that one task sorts; grams with more are counted window by window.
CROWDED = 4000
FILTER_BITS = 1 << 26
#: Bytes of text whose anchors are found at once, about 150 bytes of memory each.
PIECE = 1 << 18


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, place, first window, last window, gram, sums): anchors of all strings of ``length`` bytes inside rows.

    Windows ``first`` to ``last`` (places in ``raw``) are those whose smallest gram is the anchor.
    """
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_CODE[raw] * up[: len(raw)], out=sums[1:])
    out = [np.zeros(0, np.int64)] * 3
    mask = np.uint64((1 << PLACE_BITS) - 1)
    span = length - GRAM + 1
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    for at in range(0, max(1, len(raw)), BLOCK):
        to = min(len(raw), at + BLOCK + length - 1)
        m = to - at - GRAM + 1
        if m < span:
            continue
        h = mix((sums[at + GRAM : to + 1] - sums[at : to - GRAM + 1]) * down[at : to - GRAM + 1])
        ranked = (h & ~mask) | np.arange(m, dtype=np.uint64)
        block = np.full(-(-m // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
        block[:m] = ranked
        block = block.reshape(-1, span)
        before = np.minimum.accumulate(block, axis=1).ravel()
        after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = m - span + 1
        least = (np.minimum(after[:windows], before[span - 1 : span - 1 + windows]) & mask).astype(np.int64) + at
        start = np.arange(at, at + windows)
        ok = start + length <= row_end[at : at + windows]
        start, least = start[ok], least[ok]
        if not len(start):
            continue
        edge = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1], [True]]))
        out = [np.concatenate([a, b]) for a, b in zip(out, (least[edge[:-1]], start[edge[:-1]], start[edge[1:] - 1]))]
    place, first, last = out
    row = np.searchsorted(offsets, place, side="right") - 1
    gram = mix((sums[place + GRAM] - sums[place]) * down[place]) if len(place) else np.zeros(0, np.uint64)
    return row, place, first, last, gram, sums


def chosen(batch: pa.RecordBatch, slots: bytes) -> pa.RecordBatch:
    """Rows of (slot, key, text) whose slot is set: done by the reader itself, as another step would hold the batch in another process."""
    return batch.filter(pa.array(in_filter(np.asarray(batch.column("slot")), slots)))


def read_grams(texts: DataFrame, slots, length: int) -> DataFrame:
    """(gram) of every anchor of the chosen texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(chosen(batch, slots.value), "text", PIECE):
                gram = anchors(*text_bytes(piece.column("text")), length)[4]
                if len(gram):
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], ["gram"])

    return texts.select("slot", "text").mapInArrow(run, "gram bigint")


def read_contexts(texts: DataFrame, slots, packed, bits: int, length: int) -> DataFrame:
    """(gram, context, key, begin, weight, anchor, body): anchors of the chosen texts whose gram may be repeated.

    ``context`` is the hash of the bytes of all windows of the anchor.  Their bytes stand in ``body`` once per batch, in the row
    whose ``weight`` is the number of equal contexts in its piece of text; a later piece of the batch that holds the context again
    states its number as a negative weight.  Memory follows a piece and the hashes of a batch, not the bytes of a batch.
    """
    names = ["gram", "context", "key", "begin", "weight", "anchor", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.zeros(0, np.uint64)
            for piece in pieces(chosen(batch, slots.value), "text", PIECE):
                raw, offsets = text_bytes(piece.column("text"))
                row, place, first, last, gram, sums = anchors(raw, offsets, length)
                hit = in_filter((gram & np.uint64(bits - 1)).astype(np.int64), packed.value)
                if not hit.any():
                    continue
                row, place, first, last, gram = (x[hit] for x in (row, place, first, last, gram))
                down, end = powers(len(raw) + 1)[1], last + length
                code = mix((sums[end] - sums[first]) * down[first]) ^ mix(((end - first) * 4096 + place - first).astype(np.uint64))
                found, once, count = np.unique(code, return_index=True, return_counts=True)
                old = np.isin(found, seen, assume_unique=True)
                seen = np.concatenate([seen, found[~old]])
                w = np.zeros(len(code), np.int64)
                w[once] = np.where(old, -count, count)
                key, begin, anchor = np.asarray(piece.column("key"))[row], first - offsets[row], place - first
                for at in range(0, len(code), 5000):
                    s = slice(at, at + 5000)
                    body = [raw[a:b].tobytes() if k > 0 else None for a, b, k in zip(first[s].tolist(), end[s].tolist(), w[s].tolist())]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[s].astype(np.int64)) for x in (gram.view(np.int64), code.view(np.int64), key, begin, w, anchor)), pa.array(body, pa.binary())], names)

    return texts.select("slot", "key", "text").mapInArrow(run, "gram bigint, context bigint, key bigint, begin bigint, weight bigint, anchor bigint, body binary")


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of the tree over an enhanced suffix array; ``lcp[i]`` is between suffix i-1 and i."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        value, left = lcp[i] if i < len(lcp) else -1, i - 1
        while stack and stack[-1][0] > value:
            depth, left = stack.pop()
            if depth:
                yield depth, left, i - 1
        if stack and stack[-1][0] < value:
            stack.append((value, left))


def maximal_repeats(contexts: list[tuple[int, int, bytes]], length: int) -> dict[int, list[tuple[int, int, int]]]:
    """context number -> (first window, last window, repeat) of the repeats among (weight, anchor, body) of one gram.

    ``repeat`` identifies the repeated string: all occurrences of a maximal repeat carry the same number.
    """
    out: dict[int, list[tuple[int, int, int]]] = {}
    for k, (weight, _, body) in enumerate(contexts):
        if weight > 1:
            out[k] = [(0, len(body) - length, int.from_bytes(hashlib.blake2b(body, digest_size=7).digest(), "big"))]
    order = sorted(range(len(contexts)), key=lambda k: contexts[k][2][contexts[k][1] :])
    right = [contexts[k][2][contexts[k][1] :] for k in order]
    lcp = [0] + [common(a, b) for a, b in zip(right[:-1], right[1:])]
    for depth, lo, hi in intervals(lcp):
        own = [k for k in order[lo : hi + 1] if contexts[k][1] >= length - depth]
        if len(own) < 2:
            continue
        # left extensions: neighbours in the order of the reversed texts share most
        left = sorted((contexts[k][2][: contexts[k][1]][::-1], k) for k in own)
        shared = [0, *(common(a[0], b[0]) for a, b in zip(left[:-1], left[1:])), 0]
        for i, (_, k) in enumerate(left):
            most = max(shared[i], shared[i + 1])
            if most >= length - depth:
                _, anchor, body = contexts[k]
                name = hashlib.blake2b(body[anchor - most : anchor + depth], digest_size=7).digest()
                out.setdefault(k, []).append((anchor - most, min(anchor + depth, len(body)) - length, int.from_bytes(name, "big")))
    return out


def tree_windows(rows: DataFrame, length: int) -> DataFrame:
    """(context, lo, hi, repeat) of the contexts (gram, context, weight, anchor, body), one gram at a time."""
    schema = "context bigint, lo bigint, hi bigint, repeat bigint"

    def close(group: dict[int, list]) -> list[tuple[int, int, int, int]]:
        if len(group) == 1 and next(iter(group.values()))[0] < 2:
            return []
        codes = list(group)
        return [(codes[k], *w) for k, found in maximal_repeats([tuple(v) for v in group.values()], length).items() for w in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, group, made = None, {}, []
        for batch in batches:
            for g, c, w, a, b in zip(*(batch.column(n).to_pylist() for n in ("gram", "context", "weight", "anchor", "body"))):
                if g != gram:
                    made += close(group) if group else []
                    gram, group = g, {}
                if c in group:
                    group[c][0] += abs(w)
                else:
                    group[c] = [w, a, b]
            if len(made) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*made)], ["context", "lo", "hi", "repeat"])
                made = []
        made += close(group) if group else []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*made)], ["context", "lo", "hi", "repeat"])

    return rows.repartition(partitions(rows.sparkSession), "gram").sortWithinPartitions("gram", "context", F.desc("weight")).mapInArrow(run, schema)


def counted_windows(rows: DataFrame, length: int) -> DataFrame:
    """The same for grams of very many contexts: every window is hashed, and equal ones are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "body", 1 << 18):
                raw, offsets = text_bytes(piece.column("body"))
                up, down = powers(len(raw) + 1)
                sums = np.zeros(len(raw) + 1, np.uint64)
                np.cumsum(BYTE_CODE[raw] * up[: len(raw)], out=sums[1:])
                count = np.diff(offsets) - length + 1
                row = np.repeat(np.arange(len(count)), count)
                lo = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = offsets[row] + lo
                code = mix((sums[at + length] - sums[at]) * down[at])
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(piece.column("context"))[row]), pa.array(lo), pa.array(code.view(np.int64)), pa.array(np.asarray(piece.column("weight"))[row])], ["context", "lo", "code", "weight"])

    each = rows.groupBy("context").agg(F.sum(F.abs("weight")).alias("weight"), F.first("body", ignorenulls=True).alias("body"))
    windows = stored(each.mapInArrow(run, "context bigint, lo bigint, code bigint, weight bigint"), "windows")
    sizes = windows.groupBy("code").agg(F.sum("weight").alias("all"), F.count("*").alias("rows")).filter(F.col("all") > 1)
    return join_sizes(windows.select("context", "lo", "code"), sizes.select("code", "rows"), "code", "rows").select("context", "lo", F.col("lo").alias("hi"), F.col("code").alias("repeat"))


def find_repeats(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """((id, key, n, sha, slot), (key, begin, end, repeat)): all rows, and the repeated runs of every different text."""
    spark = docs.sparkSession
    rows = docs.withColumn("key", F.xxhash64("text"))
    base = stored(rows.select("id", "key", F.octet_length("text").cast("bigint").alias("n"), F.sha2("text", 256).alias("sha"), F.xxhash64("id", "key").alias("slot")), "texts")
    sizes = stored(base.groupBy("key").agg(F.count("*").alias("copies"), F.min("slot").alias("slot")), "sizes")
    reps = spark.sparkContext.broadcast(bit_filter(sizes.select(F.pmod("slot", F.lit(1 << 24)).alias("slot")), 1 << 24))

    # one row of each different text, and by chance some more, which changes nothing
    once = rows.filter(F.octet_length("text") >= length).select(F.pmod(F.xxhash64("id", "key"), F.lit(1 << 24)).alias("slot"), "key", "text")
    grams = read_grams(once, reps, length).groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram")
    packed = spark.sparkContext.broadcast(bit_filter(grams.select(F.expr(f"gram & {FILTER_BITS - 1}").alias("slot")), FILTER_BITS))
    contexts = stored(read_contexts(once, reps, packed, FILTER_BITS, length), "contexts")
    bodies = contexts.filter("weight <> 0").select("gram", "context", "weight", "anchor", "body")
    crowd = contexts.filter("weight > 0").groupBy("gram").agg(F.count("*").alias("c")).filter(F.col("c") > CROWDED).select("gram")
    crowd = stored(crowd, "crowd")
    found = tree_windows(bodies.join(crowd, "gram", "left_anti"), length)
    if crowd.limit(1).count():
        found = found.unionByName(counted_windows(bodies.join(crowd, "gram", "left_semi"), length))
    found = stored(found.groupBy("context").agg(F.collect_set(F.struct("lo", "hi", "repeat")).alias("windows")), "windows")
    weight = contexts.groupBy("context").agg(F.count("*").alias("rows"))
    runs = join_sizes(contexts.select("context", "key", "begin"), found.join(weight, "context"), "context", "rows").select("key", "begin", F.explode("windows").alias("w"))
    return base, runs.select("key", (F.col("begin") + F.col("w.lo")).alias("begin"), (F.col("begin") + F.col("w.hi") + length).alias("end"), F.col("w.repeat").alias("repeat"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n, removed, spans, sha): what is left of every row when all repeated runs are removed at once."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    base, runs = find_repeats(docs, length)
    spans = stored(runs.groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("runs")), "spans")
    sizes = stored(base.groupBy("key").agg(F.count("*").alias("copies"), F.first("n").alias("n")), "copies")
    single = sizes.filter("copies = 1").select("key").join(spans, "key")
    held = spark.sparkContext.broadcast(bit_filter(single.select(F.pmod("key", F.lit(1 << 24)).alias("slot")), 1 << 24))

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(np.asarray(batch.column("slot")), held.value)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column("text"), batch.column("runs")):  # texts stay in the batch
                raw, kept, at, gone, count = memoryview(text.as_buffer()), hashlib.sha256(), 0, 0, 0
                for r in sorted((r["begin"], r["end"]) for r in own.as_py()):
                    if r[0] > at or not count:
                        kept.update(raw[at : r[0]])
                        count, gone, at = count + 1, gone + r[1] - r[0], r[1]
                    elif r[1] > at:
                        gone, at = gone + r[1] - at, r[1]
                kept.update(raw[at:])
                out.append((gone, count, kept.hexdigest()))
            gone, count, sha = map(list, zip(*out)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], ["key", "removed", "spans", "kept"])

    texts = docs.withColumn("key", F.xxhash64("text")).select("key", F.pmod("key", F.lit(1 << 24)).alias("slot"), "text")
    texts = texts.mapInArrow(touched, texts.schema).select("key", "text")
    done = texts.join(single, "key").mapInArrow(cut, "key bigint, removed bigint, spans bigint, kept string")
    whole = sizes.filter((F.col("copies") > 1) & (F.col("n") >= length))
    whole = whole.select("key", "copies", F.col("n").alias("removed"), F.lit(1).cast("bigint").alias("spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept"))
    change = stored(whole.unionByName(done.withColumn("copies", F.lit(1).cast("bigint")).select("key", "copies", "removed", "spans", "kept")), "change")
    out = join_sizes(base.select("id", "n", "sha", "key"), change, "key", "copies", "left")
    return out.select("id", "n", F.coalesce("removed", F.lit(0)).alias("removed"), F.coalesce("spans", F.lit(0)).alias("spans"), F.coalesce("kept", "sha").alias("sha"))
