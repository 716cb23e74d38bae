"""Language-model scores from a subword lattice.

The probability of a word sums over all its segmentations into the pieces of an existing vocabulary, by a forward recursion
in log space.  The vocabulary's scores start the piece probabilities; one pass of expectation over every different word
of the training rows (forward and backward) fits them to the corpus.  A word that was seen is also a unit of its own: its
probability mixes its share of the training tokens with the lattice by the share of tokens that were new types
(Witten-Bell), so the lattice carries exactly the mass of unseen words.

Words are counted by hash before anything is shuffled.  The most frequent words (at most ``FREQUENT``) are sent to
all tasks; the others meet their counts in a join in which no word can weigh more than the least frequent of those.

Results: null text has only the end token; rows with a null id are training rows; with no training rows all counts are
zero; repeated rows are scored alike and counted each; only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from windowlab.llm.arrays import BYTE_CODE, LOWER, Words, mix, pieces, powers, text_bytes
from windowlab.llm.store import extend, stored

FREQUENT = 200_000
#: Mark of a word's beginning in the vocabulary.
BEGIN = "▁".encode()
FLOOR = 1e-9
LATTICE_BYTES = 1 << 17


def vocabulary(path: str) -> dict[bytes, float]:
    """Pieces of a vocabulary file and what their scores say: the weight falls with the rank that a score states."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            # text is lower-cased: pieces that become equal add up
            piece = bytes(LOWER[np.frombuffer(model.id_to_piece(i).encode(), np.uint8)])
            out[piece] = out.get(piece, 0.0) + 1.0 / (2.0 - model.get_score(i))
    return out


def hash_of(raw: np.ndarray, sums: np.ndarray, down: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    return mix((sums[start + size] - sums[start]) * down[start])


class Lattice:
    """Pieces with log probabilities; every byte is a piece, so every word has a segmentation."""

    def __init__(self, weights: dict[bytes, float], end: float | None = None):
        for b in range(256):
            weights.setdefault(bytes([b]), 0.0)
        self.names = sorted(weights)
        w = np.array([max(weights[p], 0.0) for p in self.names])
        end = 0.2 * w.sum() if end is None else end
        total = w.sum() + end
        w = (1 - FLOOR * len(w)) * w / total + FLOOR
        self.log, self.log_end = np.log(w), math.log(max(end / total, FLOOR))
        raw, offsets = text_bytes(pa.array(self.names, pa.binary()))
        up, down = powers(len(raw) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODE[raw] * up[: len(raw)], dtype=np.uint64)])
        size = np.diff(offsets)
        self.tables = []
        for n in sorted(set(size.tolist())):
            own = np.flatnonzero(size == n)
            h = hash_of(raw, sums, down, offsets[own], n)
            order = np.argsort(h)
            self.tables.append((n, h[order], own[order]))

    def arcs(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(length, piece that begins at each place or -1) for every length of piece."""
        up, down = powers(len(raw) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODE[raw] * up[: len(raw)], dtype=np.uint64)])
        end = np.repeat(offsets[1:], np.diff(offsets))
        out = []
        for n, h, own in self.tables:
            piece = np.full(len(raw), -1, np.int64)
            at = np.flatnonzero(np.arange(len(raw)) + n <= end)
            if len(at):
                code = hash_of(raw, sums, down, at, n)
                k = np.minimum(np.searchsorted(h, code), len(h) - 1)
                piece[at] = np.where(h[k] == code, own[k], -1)
            out.append((n, piece))
        return out

    def forward(self, size: np.ndarray, offsets: np.ndarray, arcs) -> np.ndarray:
        """alpha[place + word]: log probability of all segmentations of what stands before a place of its word.

        Words stand in order of falling size, so the words that are long enough are always the first ones.
        """
        alpha = np.full(int(offsets[-1]) + len(size), -np.inf)
        base = offsets[:-1] + np.arange(len(size))
        alpha[base] = 0.0
        for j in range(1, int(size.max(initial=0)) + 1):
            active = int(np.searchsorted(-size, -j, side="right"))
            to, here = base[:active] + j, np.full(active, -np.inf)
            for n, piece in arcs:
                if n > j:
                    break
                p = piece[offsets[:active] + j - n]
                on = np.flatnonzero(p >= 0)
                if len(on):
                    here[on] = np.logaddexp(here[on], alpha[to[on] - n] + self.log[p[on]])
            alpha[to] = here
        return alpha

    def backward(self, size: np.ndarray, offsets: np.ndarray, arcs) -> np.ndarray:
        beta = np.full(int(offsets[-1]) + len(size), -np.inf)
        base = offsets[:-1] + np.arange(len(size))
        beta[base + size] = 0.0
        for j in range(int(size.max(initial=0)) - 1, -1, -1):
            active = int(np.searchsorted(-size, -(j + 1), side="right"))
            at, here = base[:active] + j, np.full(active, -np.inf)
            for n, piece in arcs:
                p = piece[offsets[:active] + j]
                on = np.flatnonzero(p >= 0)
                if len(on):
                    here[on] = np.logaddexp(here[on], beta[at[on] + n] + self.log[p[on]])
            beta[at] = here
        return beta

    def batches(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, bytes, offsets) of slices of the words in order of falling size."""
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        at = 0
        while at < len(order):
            to, total = at, 0
            while to < len(order) and (to == at or total + len(words[order[to]]) <= LATTICE_BYTES):
                total += len(words[order[to]])
                to += 1
            rows = np.array(order[at:to])
            raw, offsets = text_bytes(pa.array([words[k] for k in rows], pa.binary()))
            yield rows, raw, offsets
            at = to

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the marginal probability of every word, its end included."""
        out = np.zeros(len(words))
        for rows, raw, offsets in self.batches([BEGIN + w for w in words]):
            size = np.diff(offsets)
            alpha = self.forward(size, offsets, self.arcs(raw, offsets))
            out[rows] = alpha[offsets[:-1] + np.arange(len(size)) + size] + self.log_end
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected number of uses of every piece over all segmentations of the words, each word once."""
        out = np.zeros(len(self.names))
        for _, raw, offsets in self.batches([BEGIN + w for w in words]):
            size, arcs = np.diff(offsets), self.arcs(raw, offsets)
            alpha, beta = self.forward(size, offsets, arcs), self.backward(size, offsets, arcs)
            word = np.repeat(np.arange(len(size)), size)
            z = beta[offsets[:-1] + np.arange(len(size))][word]
            place = np.arange(len(raw)) + word
            for n, piece in arcs:
                on = np.flatnonzero(piece >= 0)
                if len(on):
                    out += np.bincount(piece[on], np.exp(alpha[place[on]] + self.log[piece[on]] + beta[place[on] + n] - z[on]), len(out))
        return out


def part(id_col: str, divisor: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor, F.lit(-1))


def counted(rows: DataFrame) -> DataFrame:
    """(code, word, trained, seen): counts of every word; words of a batch are counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for piece in pieces(batch, "text"):
                words = Words(*text_bytes(piece.column("text")))
                codes = words.hashes()
                train = np.asarray(piece.column("train").cast(pa.int8())).astype(np.int64)[words.row]
                order = np.argsort(codes, kind="stable")
                if not len(order):
                    continue
                edge = np.flatnonzero(np.concatenate([[True], codes[order][1:] != codes[order][:-1]]))
                once = order[edge]
                raw = LOWER[words.raw].tobytes()
                held.append((codes[once], np.add.reduceat(train[order], edge), np.diff(np.append(edge, len(order))), [raw[a:b] for a, b in zip(words.start[once].tolist(), words.end[once].tolist())]))
            if not held:
                continue
            codes, train, seen = (np.concatenate([h[i] for h in held]) for i in range(3))
            names = [w for h in held for w in h[3]]
            order = np.argsort(codes, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], codes[order][1:] != codes[order][:-1]]))
            train, seen = np.add.reduceat(train[order], edge), np.add.reduceat(seen[order], edge)
            for i in range(0, len(edge), 20000):
                s = slice(i, i + 20000)
                once = order[edge[s]]
                yield pa.RecordBatch.from_arrays([pa.array(codes[once].view(np.int64)), pa.array([names[k] for k in once.tolist()], pa.binary()), pa.array(train[s]), pa.array(seen[s])], ["code", "word", "trained", "seen"])

    parts = rows.select("train", "text").mapInArrow(run, "code bigint, word binary, trained bigint, seen bigint")
    return parts.groupBy("code").agg(F.max("word").alias("word"), F.sum("trained").alias("trained"), F.sum("seen").alias("seen"))


def fit_pieces(words: DataFrame, weights: dict[bytes, float]) -> tuple[dict[bytes, float], float]:
    """Expected uses of the pieces over all training words, and the number of words: what the lattice is made of."""
    held = words.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(held.value), None
        n = 0
        for batch in batches:
            got = lattice.expected(batch.column("word").to_pylist())
            total, n = got if total is None else total + got, n + batch.num_rows
        if total is not None:
            on = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([*(lattice.names[k] for k in on), None], pa.binary()), pa.array([*total[on], float(n)])], ["piece", "uses"])

    sums = words.select("word").mapInArrow(run, "piece binary, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
    fitted = {bytes(r["piece"]): r["uses"] for r in sums if r["piece"] is not None}
    return fitted, next((r["uses"] for r in sums if r["piece"] is None), 0.0)


def score(docs: DataFrame, path: str, train: Column, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(id, train, tokens, known, train_tokens, base, score) per row; logs to base 10.

    ``base`` is the unigram score with one added to every count; ``score`` the marginal of the mixture.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(True)).alias("train"), F.coalesce(text_col, F.lit("")).alias("text"))
    ends = rows.filter("train").count()
    words = stored(counted(rows), "words")
    sums = words.filter("trained > 0").agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count("*")).first()
    tokens, types = sums[0] + ends, sums[1] + (ends > 0)
    fitted, n = fit_pieces(words.filter("trained > 0"), vocabulary(path))
    # unseen pieces keep a little of what the vocabulary says of them
    start = vocabulary(path)
    share = 1.0 / max(sum(start.values()), 1e-300)
    weights = {p: fitted.get(p, 0.0) + v * share for p, v in start.items()} | {p: v for p, v in fitted.items() if p not in start}
    model = spark.sparkContext.broadcast((weights, n + 0.2))
    new = types / (tokens + types) if tokens else 0.5  # without training rows a token is an end or a new word alike
    denominator = math.log10(tokens + types + 1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(dict(model.value[0]), model.value[1])
        for batch in batches:
            c = np.asarray(batch.column("trained")).astype(float)
            # log10 of (1 - new) c / N + new * lattice
            unseen = lattice.log_probability(batch.column("word").to_pylist()) / math.log(10) + math.log10(new)
            with np.errstate(divide="ignore"):
                seen = np.log10((1 - new) * c / max(tokens, 1))
            both = np.logaddexp(seen * math.log(10), unseen * math.log(10)) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("code"), batch.column("trained"), batch.column("seen"), pa.array(np.log10(c + 1)), pa.array(both)], ["code", "trained", "seen", "base", "score"])

    judged = stored(words.mapInArrow(judge, "code bigint, trained bigint, seen bigint, base double, score double"), "judged")
    # the largest power of two of counts that at most ``frequent`` words reach: no task sends more than its share of them
    steps = judged.groupBy(F.floor(F.log2("seen")).alias("step")).count().collect()
    least, held = 62, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        held += r["count"]
        if held > frequent:
            break
        least = r["step"]
    top = judged.filter(F.col("seen") >= 2**least).select("code", (F.col("trained") > 0).alias("known"), "base", "score").toPandas().sort_values("code")
    head = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("code", "known", "base", "score")))
    end_base = math.log10(ends + 1)
    end_score = math.log10((1 - new) * ends / tokens) if ends else math.log10(0.5)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, known, base, value = head.value
        tables = [np.append(x, 0).astype(float) for x in (known, base, value)]
        for batch in batches:
            for piece in pieces(batch, "text"):
                w = Words(*text_bytes(piece.column("text")))
                h = w.hashes().view(np.int64)
                k = np.minimum(np.searchsorted(codes, h), max(len(codes) - 1, 0))
                hit = codes[k] == h if len(codes) else np.zeros(len(h), bool)
                k = np.where(hit, k, len(codes))
                got = [np.bincount(w.row, t[k], w.rows).astype(float) for t in tables]
                rest, row = h[~hit], w.row[~hit]
                ends_at = np.searchsorted(row, np.arange(w.rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), piece.column("train"), pa.array(w.count.astype(np.int64) + 1), pa.array(got[0].astype(np.int64)), pa.array(got[1]), pa.array(got[2]), pa.ListArray.from_arrays(pa.array(ends_at), pa.array(rest))],
                    ["id", "train", "tokens", "known", "base", "score", "rest"],
                )

    made = rows.mapInArrow(add, extend(rows.select("id", "train"), "tokens bigint, known bigint, base double, score double, rest array<bigint>"))
    made = stored(made.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = made.select("row", F.explode("rest").alias("code")).join(judged.select("code", "trained", "base", "score"), "code")
    rest = rest.groupBy("row").agg(F.sum((F.col("trained") > 0).cast("bigint")).alias("k"), F.sum("base").alias("b"), F.sum("score").alias("s"))
    out = made.drop("rest").join(rest, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "id", "train", "tokens", (F.col("known") + zero("k") + int(ends > 0)).alias("known"), F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("b") + end_base - F.col("tokens") * denominator).alias("base"), (F.col("score") + zero("s") + end_score).alias("score"),
    )
