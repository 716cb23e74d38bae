"""Importance resampling towards a target: documents are drawn without replacement, weighted by how much their features
look like the target's.

Features are runs of one to ``grams`` words, hashed into ``BUCKETS`` buckets.  Counts per bucket over all documents and all
target texts give one gain per bucket; a document's weight adds the gains of its features and its score adds a Gumbel
noise made from its id, so that taking the highest scores draws without replacement.  Scores are persisted.  The cutoff is
found by bisection: exact count jobs over the persisted scores, each settling ``HALVINGS`` halvings, first over the score, then
over the id among rows of the cutoff score, then over the row number among rows of one id.  Drawn rows are range-partitioned
by (score, id) and ranked within their range; sizes of the ranges before it complete a rank.  No row is sorted or
gathered but the drawn ones, and no task holds more than its range.

Results: a null or empty text has no features and weight 0; it counts as a document only from ``least_words`` words on, like any
other.  Every row is a document: repeated rows are drawn one by one.  A null id has the noise of an empty id and comes
last among equal scores.  Without target texts all target counts are 0.  Empty tables give no rows.  Other columns are not read.
Ids are integers.  Texts are split a mebibyte at a time.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from windowlab.llm.search import integer_id
from windowlab.llm.store import extend, partitions, stored

GRAMS, BUCKETS, SEED, LEAST_WORDS, SHARE = 1, 10_000, 2024, 20, 10
#: Halvings of the interval that one count job settles.
HALVINGS = 5
SLICE = 1 << 20
#: Features whose bucket a task remembers.
REMEMBERED = 1 << 19
#: Lower case for A-Z, a space for whatever is neither letter nor digit and below 0x80.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def runs(text: bytes, grams: int) -> Iterator[list[bytes]]:
    """Features of one text, in lists of bounded size; the first ``grams`` - 1 words of a list's end open the next one."""
    at, tail = 0, []
    while at < len(text):
        end = len(text) if len(text) - at <= SLICE else at + SLICE
        part = text[at:end].translate(FOLD)
        while end < len(text) and part[-1] != 0x20:  # complete the last word
            more = text[end : end + 256].translate(FOLD)
            stop = more.find(b" ")
            part, end = part + (more if stop < 0 else more[: stop + 1]), end + (len(more) if stop < 0 else stop + 1)
        new = part.split()
        out = list(new)
        words = tail + new
        for g in range(2, grams + 1):
            first = max(0, len(tail) - g + 1)  # runs that end in a new word
            out += [b" ".join(words[i : i + g]) for i in range(first, len(words) - g + 1)]
        yield out
        tail = words[len(words) - grams + 1 :] if grams > 1 else []
        at = end


class Buckets(dict):
    """Feature -> bucket, remembered up to a bound."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[feature] = zlib.crc32(feature) % self.buckets
        return out


def bucket_counts(texts: DataFrame, text_col: str, grams: int, buckets: int) -> np.ndarray:
    """How many features fall in each bucket, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                for features in runs(text.as_buffer().to_pybytes() if text.is_valid else b"", grams):
                    total += np.bincount(np.fromiter(map(of.__getitem__, features), np.int64, len(features)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    sums = texts.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket: the log ratio of smoothed shares, in thousandths, rounded down."""
    s, t, buckets = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise of an id, in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, grams: int, seed: int) -> DataFrame:
    """(id, words, features, weight, score, row) of every document, persisted; ``row`` tells equal rows apart."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Buckets(len(gain))
        for b in batches:
            out = []
            for text in b.column("text"):
                words = found = weight = 0
                for features in runs(text.as_buffer().to_pybytes() if text.is_valid else b"", grams):
                    words += sum(b" " not in f for f in features) if grams > 1 else len(features)
                    found += len(features)
                    weight += int(gain[np.fromiter(map(of.__getitem__, features), np.int64, len(features))].sum())
                out.append((words, found, weight))
            numbers = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(numbers[:, k]) for k in range(3)]], ["id", "words", "features", "weight"])

    rows = docs.select(integer_id(docs, id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    made = rows.mapInArrow(weigh, "id bigint, words bigint, features bigint, weight bigint")
    return stored(made.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id()), "scores")


def cutoff(rows: DataFrame, key: str, wanted: int) -> tuple[int, int]:
    """The largest value that at least ``wanted`` rows reach or exceed, and how many rows exceed it.

    ``wanted`` lies between 1 and the number of rows.  The interval that holds the value shrinks by 2^``HALVINGS`` with every job.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    above = 0  # rows beyond high
    while low < high:
        step = max(1, -(-(high - low + 1) >> HALVINGS))
        probes = list(range(low + step, high + 1, step))
        interval = sum(((F.col(key) >= F.lit(p).cast("bigint")).cast("int") for p in probes), F.lit(0))
        found = {r[0]: r[1] for r in rows.filter((F.col(key) >= low) & (F.col(key) <= high)).groupBy(interval.alias("k")).count().collect()}
        for k in range(len(probes), -1, -1):
            if above + found.get(k, 0) >= wanted:
                low, high = (probes[k - 1] if k else low), (probes[k] - 1 if k < len(probes) else high)
                break
            above += found.get(k, 0)
    return low, above


def drawn(scores: DataFrame, wanted: int, least_words: int) -> Column:
    """A condition that holds for exactly ``wanted`` rows: highest scores, ties to the smaller id, then to the smaller row number."""
    able = F.col("words") >= least_words
    if wanted <= 0:
        return F.lit(False)
    rows = scores.filter(able)
    score, above = cutoff(rows.select("score"), "score", wanted)
    left, tied = wanted - above, rows.filter(F.col("score") == score)
    named, n_tied = tied.agg(F.count("id"), F.count(F.lit(1))).first()
    if left == n_tied:
        return able & (F.col("score") >= score)
    # ascending order is descending order of the negated value; ~x = -x - 1 cannot overflow
    if left <= named:
        last, before = cutoff(tied.filter("id is not null").select(F.bitwise_not("id").alias("key")), "key", left)
        same, earlier = F.coalesce(F.col("id") == ~last, F.lit(False)), F.coalesce(F.col("id") < ~last, F.lit(False))
    else:
        before, same, earlier = named, F.col("id").isNull(), F.col("id").isNotNull()
    row, _ = cutoff(tied.filter(same).select(F.bitwise_not("row").alias("key")), "key", left - before)
    return able & ((F.col("score") > score) | ((F.col("score") == score) & (earlier | (same & (F.col("row") <= ~row)))))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with their rank by descending score, ascending id, row number: ranges are ranked apart."""
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            place = np.arange(at + 1, at + b.num_rows + 1)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part)), pa.array(place)], [*b.schema.names, "part", "place"])

    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = stored(dealt.mapInArrow(number, extend(rows, "part bigint, place bigint")), "placed")
    before, starts = 0, []
    for part, size in sorted((r[0], r[1]) for r in placed.groupBy("part").count().collect()):
        starts.append((part, before))
        before += size
    begin = rows.sparkSession.createDataFrame(starts, "part bigint, begin bigint")
    return placed.join(F.broadcast(begin), "part").withColumn("rank", F.col("begin") + F.col("place")).drop("part", "place", "begin")


def resample(
    docs: DataFrame, target: DataFrame, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(id, words, features, weight, score, rank) of every document; ``share`` percent of those with enough words are drawn and ranked."""
    gain = gains(bucket_counts(docs, text_col, grams, buckets), bucket_counts(target, target_text_col, grams, buckets))
    scores = weighed(docs, gain, id_col, text_col, grams, seed)
    wanted = share * scores.filter(F.col("words") >= least_words).count() // 100
    chosen = drawn(scores, wanted, least_words)
    rest = scores.filter(~chosen).withColumn("rank", F.lit(None).cast("bigint"))
    columns = ["id", "words", "features", "weight", "score", "rank"]
    return (ranked(scores.filter(chosen)).select(columns) if wanted > 0 else rest.limit(0).select(columns)).unionByName(rest.select(columns))
