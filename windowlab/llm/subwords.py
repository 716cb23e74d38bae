"""Quality by supervised subword embeddings: vectors of hashed words and character n-grams, averaged per text, softmax output.

Features of a whole text are its words, pairs of neighbouring words and the character n-grams (``GRAMS``) of every word
between its two boundaries, repeats counted.  A pair is hashed by the difference of its words' hashes, so a word said
twice in a row is the same feature whatever the word.  Case and signs are kept.  Every feature has a vector in a table of
``2^BITS`` rows; a text is the mean of its features' vectors, and a softmax layer turns that into class probabilities.

Training reads at most ``SAMPLE`` labelled rows (the first in order of a hash of their id), whole texts, stored once as
(feature, count) lists in ``SHARDS`` shards.  In every round a task per shard goes through its rows by stochastic gradient
descent in numpy, steps scaled by each row's past gradients, starting from the common model; the shards' models are
averaged.  A model is ``2^BITS x WIDTH`` floats, ``SHARDS`` of them at most pass through the driver.  As the output layer sees a mean, one
number per feature says what it adds to the difference of the two outputs: scoring looks these up and takes their mean.

Results: a text without features (null, empty, separators only) has the score of the output layer's bias; null labels and null ids
teach nothing, of several labels of an id the smallest counts, of several texts of an id the smallest.  Without
labelled rows all scores are .5.  Repeated rows are scored alike; empty tables give no rows; other columns are not read.
Memory follows a mebibyte of text or the longest single text, about 100 bytes for each of its characters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from windowlab.llm.arrays import pieces, text_bytes
from windowlab.llm.store import extend, stored

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 6_000
BITS, WIDTH = 16, 8
GRAMS = (3, 4)
#: Tasks that train side by side, rounds after which their models are averaged, passes over the rows in a round, first step.
SHARDS, ROUNDS, PASSES, RATE = 4, 4, 2, 1.0
SEED = 20240229
SPACE = 32
MULTIPLIER, SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a text column, separators as spaces, and the offsets of its rows."""
    raw, offsets = text_bytes(column)
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    return np.where((chars >= 9) & (chars <= 13), np.uint32(SPACE), chars), at


def bucket(h: np.ndarray, kind: int) -> np.ndarray:
    """Row of the table for a hash; ``kind`` keeps words, pairs and n-grams of each length apart."""
    h = (h ^ np.uint32(kind * 0x85EBCA6B & 0xFFFFFFFF)) * SPREAD
    h ^= h >> np.uint32(15)
    return ((h * MULTIPLIER) >> np.uint32(32 - BITS)).astype(np.int32)


def features(chars: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all features of a batch, kind by kind."""
    rows = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    inside = chars != SPACE
    edge = np.zeros(len(chars) + 1, bool)
    edge[at] = True
    opens = inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]]))
    closes = inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up = np.cumprod(np.concatenate([[1], np.full(len(chars), int(MULTIPLIER))]).astype(np.uint32), dtype=np.uint32)
    down = np.cumprod(np.concatenate([[1], np.full(len(chars), pow(int(MULTIPLIER), -1, 1 << 32))]).astype(np.uint32), dtype=np.uint32)
    mixed = (chars * SPREAD) ^ (chars >> np.uint32(7)) ^ np.uint32(0x5BD1E995)
    sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(mixed * up[:-1], dtype=np.uint32)])
    word = (sums[end] - sums[start]) * down[start]
    yield rows[start], bucket(word, 1)
    near = np.flatnonzero(rows[start[1:]] == rows[start[:-1]])
    yield rows[start[near]], bucket(word[near + 1] - word[near], 2)
    # n-grams: the middle is inside a word; what lies beyond a text's ends is a space like any other separator
    sign = np.concatenate([[SPACE], np.where(inside, mixed, np.uint32(SPACE)), [SPACE]]).astype(np.uint32)
    for n in GRAMS:
        length = end - start
        held = length + 2 >= n  # windows over a word and its two boundaries
        count = (length + 3 - n)[held]
        total = int(count.sum())
        first = np.repeat(start[held] - 1 - (np.cumsum(count) - count), count) + np.arange(total)
        last = first + n - 1
        # boundaries of this word: before its start and after its end
        lo, hi = np.repeat(start[held], count), np.repeat(end[held], count)
        h = np.where(first < lo, np.uint32(SPACE), sign[first + 1])
        for k in range(1, n - 1):
            h = h * MULTIPLIER + sign[first + 1 + k]
        h = h * MULTIPLIER + np.where(last >= hi, np.uint32(SPACE), sign[last + 1])
        yield rows[lo], bucket(h, n + 10)


@dataclass
class Model:
    """Vectors of features, weights and biases of the two outputs."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, bits: int = BITS, width: int = WIDTH, seed: int = SEED) -> Model:
        r = np.random.Generator(np.random.PCG64(seed))
        return cls((r.random((1 << bits, width), np.float32) - 0.5) / width, (r.random((width, 2), np.float32) - 0.5), np.zeros(2, np.float32))

    def pack(self) -> bytes:
        return b"".join(np.ascontiguousarray(x, np.float32).tobytes() for x in (self.vectors, self.output, self.bias))

    @classmethod
    def unpack(cls, data: bytes, width: int = WIDTH) -> Model:
        x = np.frombuffer(data, np.float32).copy()
        return cls(x[: -2 * width - 2].reshape(-1, width), x[-2 * width - 2 : -2].reshape(width, 2), x[-2:])

    def probabilities(self, ids: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean vector of a text and its class probabilities."""
        mean = share @ self.vectors[ids]
        z = mean @ self.output + self.bias
        e = np.exp(z - z.max())
        return mean, e / e.sum()

    def descend(self, rows: Iterable[tuple[int, np.ndarray, np.ndarray]], rate: float, past: np.ndarray) -> None:
        """One pass of stochastic gradient descent; ``past`` holds the summed squared gradients of every feature."""
        past_out, past_bias = np.full_like(self.output, 1e-6), np.full_like(self.bias, 1e-6)
        for label, ids, counts in rows:
            share = counts / max(counts.sum(), 1)
            mean, p = self.probabilities(ids, share)
            wrong = p.copy()
            wrong[label] -= 1
            back = self.output @ wrong
            step_out = np.outer(mean, wrong)
            past_out += step_out**2
            past_bias += wrong**2
            self.output -= rate * step_out / np.sqrt(past_out)
            self.bias -= rate * wrong / np.sqrt(past_bias)
            if len(ids):
                past[ids] += (share * share) * float(back @ back)
                self.vectors[ids] -= (rate * share / np.sqrt(past[ids]))[:, None] * back

    def contributions(self) -> np.ndarray:
        """What each feature adds to the difference of the two outputs."""
        return self.vectors.astype(np.float64) @ (self.output[:, 1].astype(np.float64) - self.output[:, 0])


def pack(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted features and their counts in about two bytes a feature."""
    both = np.concatenate([np.diff(ids, prepend=0), counts]).astype(np.int32)
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view(np.int32).ravel()
    return np.cumsum(both[: len(both) // 2], dtype=np.int32), both[len(both) // 2 :].astype(np.float32)


def sampled(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(shard, place, label, features) of at most ``sample`` labelled documents; ``learn`` says which rows may teach."""
    taught = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    rows = docs.filter(learn & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # both sides know whether an id may teach, so the sample is drawn from those alone
    may = rows.select("_id").join(taught, "_id", "left_semi").distinct().join(taught, "_id").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    found = rows.join(F.broadcast(stored(may, "taught")), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("text"))
    found = found.select(F.xxhash64("_id", F.lit("order")).alias("place"), F.col("_label").cast("int").alias("label"), "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in pieces(b, "text"):
                rows, buckets = (np.concatenate(x) for x in zip(*features(*code_points(piece.column("text")))))
                both, n = np.unique(rows.astype(np.int64) << BITS | buckets, return_counts=True)
                row, ids = both >> BITS, (both & ((1 << BITS) - 1)).astype(np.int32)
                cuts = np.searchsorted(row, np.arange(1, piece.num_rows))
                out = [pack(i, c) for i, c in zip(np.split(ids, cuts), np.split(n, cuts))]
                yield pa.RecordBatch.from_arrays([piece.column("place"), piece.column("label"), pa.array(out, pa.binary())], ["place", "label", "features"])

    made = found.mapInArrow(read, "place bigint, label int, features binary")
    return stored(made.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(SHARDS))), "taught_features")


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = SAMPLE, rounds: int = ROUNDS, rate: float = RATE,
) -> Model:
    """The model of labels 0 and 1, by rounds of parallel descent and averaging."""
    shards = sampled(docs, labels, learn, id_col, text_col, label_col, sample)
    model = Model.start()
    for k in range(rounds):
        packed, pace = model.pack(), rate * (1 - k / rounds)

        def train(key, table):
            own = Model.unpack(packed)
            at = np.argsort(np.asarray(table.column("place")), kind="stable")
            labels, texts = table.column("label").to_pylist(), table.column("features")
            past = np.full(len(own.vectors), 1e-12, np.float32)
            for p in range(PASSES):
                order = np.random.Generator(np.random.PCG64([SEED, k, p])).permutation(len(at))
                own.descend(((1 if labels[i] else 0, *unpack(texts[i].as_buffer())) for i in map(int, at[order])), pace, past)
            return pa.table({"model": pa.array([own.pack()], pa.binary()), "n": pa.array([len(at)], pa.int64())})

        made = shards.groupBy("shard").applyInArrow(train, "model binary, n bigint").collect()
        if not made:
            return Model(np.zeros_like(model.vectors), model.output, model.bias)
        made, total = sorted(made, key=lambda r: bytes(r["model"])), sum(r["n"] for r in made)
        models = [(Model.unpack(bytes(r["model"])), r["n"] / total) for r in made]
        model = Model(*(sum(getattr(m, x) * np.float32(w) for m, w in models) for x in ("vectors", "output", "bias")))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features, score): the probability of label 1 of every row."""
    adds, bias = model.contributions(), float(model.bias[1]) - float(model.bias[0])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in pieces(b, "text"):
                total, n = np.zeros(piece.num_rows), np.zeros(piece.num_rows, np.int64)
                for row, ids in features(*code_points(piece.column("text"))):
                    total += np.bincount(row, adds[ids], piece.num_rows)
                    n += np.bincount(row, minlength=piece.num_rows)
                z = total / np.maximum(n, 1) + bias
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(n), pa.array(1 / (1 + np.exp(-z)))], ["id", "features", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(judge, extend(rows.select("id"), "features bigint, score double"))
