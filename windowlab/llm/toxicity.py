"""Toxicity by nearest labelled examples: exact TF-IDF cosine of whole texts.

Terms are words and their beginnings of four to six bytes (stems), so that inflected forms of a known word meet it.
At most ``SAMPLE`` labelled rows (the first in order of a hash of their id) are the examples, and every term that one of them
holds is in the index.  Document frequencies are counted over all rows.

Neighbours are the ``NEIGHBOURS`` examples of largest cosine, found in a block-max inverted index.  Examples lie in blocks of
``BLOCK``, ordered by the norm of their part over frequent terms.  Postings of the other terms are added up first: every sum is
a lower bound of a cosine, and a block's largest sum plus what its frequent terms can add at most (the text's weights times
the block's maximum of each term, or the product of norms, whichever is less) is an upper bound for all its examples.  A block
whose upper bound is below the least of k cosines that are already certain is skipped; the others are completed, for up to
``ROWS`` texts at a time.  What is found is what a search through all examples finds.

Label statistics weight votes: terms that toxic examples hold at least ``LIFT`` times as often as others (and significantly
so) are marks, and examples vote by their cosine plus their cosine over the marks alone.  The ``NEIGHBOURS`` largest of the latter
vote besides the nearest.  The votes, mixed with the prior, are the score; all who voted are the evidence.

Results: a text without any term of an example (null and empty texts too) has no neighbours and the prior as its score; without
labelled rows the prior is 0; ties go to the smaller example; repeated rows are scored alike; labels, languages and sources are
never read for a score.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from windowlab.llm.arrays import BYTE_CODE, LOWER, Words, mix, pieces, powers, text_bytes
from windowlab.llm.store import extend

SAMPLE, LIFT, LEAST_ROWS = 20_000, 3.0, 4
#: Likelihood ratio (twice its logarithm) that a mark must reach: chance alone reaches it once in ten thousand terms.
SIGNIFICANT = 15.0
NEIGHBOURS = 15
#: Terms of more than this share of the examples, at most ``COLUMNS``, are bounded by block; any numbers give the same result.
FREQUENT, COLUMNS = 0.06, 2000
#: Examples of a block, and texts that visit it at once.
BLOCK, ROWS = 128, 256
#: Cosines closer than this are equal.
EQUAL = 1e-6
#: Examples that pass through the driver at once.
PART = 1000
#: Weight of the prior, in units of a neighbour with cosine 1.
PRIOR_WEIGHT = 1.0
STEMS = (4, 5, 6)
TRIMMED = np.zeros(256, bool)
TRIMMED[[ord(c) for c in ".,;:!?\"'()[]{}*#%&$|<>-_"]] = True


def terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all terms of a batch, repeated as often as they occur."""
    start, end, raw = words.start.copy(), words.end.copy(), words.raw
    for _ in range(3):  # up to three signs on either side
        end -= (end - start > 1) & TRIMMED[raw[np.maximum(end - 1, 0)]]
        start += (end - start > 1) & TRIMMED[raw[np.minimum(start, max(len(raw) - 1, 0))]]
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_CODE[LOWER[raw]] * up[: len(raw)], out=sums[1:])
    rows, out = [words.row], [mix((sums[end] - sums[start]) * down[start])]
    for n in STEMS:
        on = end - start > n
        rows.append(words.row[on])
        out.append(mix(((sums[start[on] + n] - sums[start[on]]) * down[start[on]]) ^ np.uint64(n << 40)))
    return np.concatenate(rows), np.concatenate(out)


def counts(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) and how often each occurs."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[edge], value[edge], np.diff(np.append(edge, len(row)))


class Vocabulary:
    """Sorted hashes of terms; the leading bits of a hash say where to look for it."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.shift = np.uint64(64 - max(len(codes).bit_length(), 1))
        self.first = np.searchsorted(codes >> self.shift, np.arange((1 << int(64 - self.shift)) + 1, dtype=np.uint64)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.codes)

    def look_up(self, row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, term number) of those hashes that are terms."""
        slot = (code >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        on = np.flatnonzero(at < end)
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(on):
            k = at[on]
            hit = self.codes[k] == code[on]
            rows.append(row[on[hit]])
            found.append(k[hit])
            on = on[~hit]
            at[on] += 1
            on = on[at[on] < end[on]]
        return np.concatenate(rows).astype(np.int64), np.concatenate(found).astype(np.int64)


def term_counts(piece: pa.RecordBatch, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) of a batch."""
    row, term = vocabulary.look_up(*terms(Words(*text_bytes(piece.column("text")))))
    both, tf = np.unique(row * max(len(vocabulary), 1) + term, return_counts=True)
    return *np.divmod(both, max(len(vocabulary), 1)), tf


def unit(row: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Weights of the unit vectors of ``n`` rows."""
    weight = (1 + np.log(tf)) * idf[term]
    return weight / np.sqrt(np.bincount(row, weight**2, n))[row]


def vectors(piece: pa.RecordBatch, vocabulary: Vocabulary, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the unit vectors of a batch."""
    row, term, tf = term_counts(piece, vocabulary)
    return row, term, unit(row, term, tf, idf, piece.num_rows)


def pack(term: np.ndarray, tf: np.ndarray) -> bytes:
    """Sorted terms and their counts in about two bytes a term."""
    both = np.concatenate([np.diff(term, prepend=0), tf]).astype(np.int32)
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view(np.int32).ravel()
    return np.cumsum(both[: len(both) // 2], dtype=np.int32), both[len(both) // 2 :]


class BlockMax:
    """The examples' unit vectors: postings, and for frequent terms blocks of weights with their maxima."""

    def __init__(self, n_terms: int, parts: Callable[[], Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]], toxic: np.ndarray, mark: np.ndarray | None = None):
        """``parts()`` gives (lengths, terms, weights) of the vectors of some examples after others; it is called three times,
        so that what is not part of the index is held for one part only."""
        n = len(toxic)
        self.toxic, self.mark = toxic, np.zeros(n_terms, bool) if mark is None else mark
        held = np.zeros(n_terms, np.int64)
        for _, term, _ in parts():
            held += np.bincount(term, minlength=n_terms)
        often = np.argsort(np.where(self.mark, 0, -held), kind="stable")[:COLUMNS]
        often = often[(held[often] > FREQUENT * n) & ~self.mark[often]]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[often] = np.arange(len(often))
        norm, self.mark_norm = [np.zeros(0)], [np.zeros(0)]
        for length, term, weight in parts():
            row, square = np.repeat(np.arange(len(length)), length), np.square(weight, dtype=np.float64)
            norm.append(np.sqrt(np.bincount(row, square * (self.column[term] >= 0), len(length))))
            self.mark_norm.append(np.sqrt(np.bincount(row, square * self.mark[term], len(length))))
        norm, self.mark_norm = np.concatenate(norm), np.concatenate(self.mark_norm)
        self.order = np.argsort(-norm, kind="stable")
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n)
        self.norm = norm[self.order][::BLOCK].astype(np.float32)
        self.blocks = -(-n // BLOCK)
        self.matrix = np.zeros((self.blocks * BLOCK, len(often)), np.float32)
        held[often] = 0
        self.post_first = np.concatenate([[0], np.cumsum(held)])
        #: Place and weight of a posting side by side, so that one read fetches both.
        self.post = np.empty((self.post_first[-1], 2), np.int32)
        at, full = 0, self.post_first[:-1].copy()
        for length, term, weight in parts():
            to, column = np.repeat(place[at : at + len(length)], length), self.column[term]
            at += len(length)
            on = column >= 0
            self.matrix[to[on], column[on]] = weight[on]
            off = np.flatnonzero(~on)
            off = off[np.argsort(term[off], kind="stable")]
            found, first, size = np.unique(term[off], return_index=True, return_counts=True)
            slot = np.repeat(full[found] - first, size) + np.arange(len(off))
            self.post[slot, 0], self.post[slot, 1] = to[off], weight[off].astype(np.float32).view(np.int32)
            full[found] += size
        self.peak = np.zeros((self.blocks, len(often)), np.float32)
        for b in range(self.blocks):
            self.peak[b] = self.matrix[b * BLOCK : (b + 1) * BLOCK].max(0)
        self.peak = np.ascontiguousarray(self.peak.T)
        #: Pairs of a text and a block that were completed, and all there were.
        self.visited = self.all = 0
        self.room: tuple[np.ndarray, ...] = (np.empty((0, 2), np.int32),)

    def sums(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The products with all places over the given terms, which have postings."""
        a, b = self.post_first[term], self.post_first[term + 1]
        n = int((b - a).sum())
        if not n:
            return np.zeros(self.blocks * BLOCK)
        if n > len(self.room[0]):  # kept between calls: new memory costs as much as the sums
            self.room = np.empty((2 * n, 2), np.int32), np.empty(2 * n, np.int64), np.empty(2 * n)
        both, places, products = (r[:n] for r in self.room)
        np.concatenate([self.post[i:j] for i, j in zip(a.tolist(), b.tolist())], out=both)
        np.copyto(places, both[:, 0])
        np.multiply(both.view(np.float32)[:, 1], np.repeat(weight, b - a), out=products)
        return np.bincount(places, products, self.blocks * BLOCK)

    def search(self, edge: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(examples, cosines, weights of their votes) of each text: the k nearest, then the k nearest over the marks alone.

        The terms of text ``i`` lie from ``edge[i]`` to ``edge[i + 1]``.
        """
        n = len(edge) - 1
        row, column = np.repeat(np.arange(n), np.diff(edge)), self.column[term]
        texts = np.zeros((n, self.matrix.shape[1]), np.float32)
        texts[row[column >= 0], column[column >= 0]] = weight[column >= 0]
        found = np.zeros((n, self.blocks * BLOCK), np.float32)
        for i in range(n):
            on = slice(edge[i], edge[i + 1])
            rare = column[on] < 0
            found[i] = self.sums(term[on][rare], weight[on][rare])
        cells = found.reshape(n, self.blocks, BLOCK)
        top = cells.max(2)
        most = top + np.minimum(texts @ self.peak, np.linalg.norm(texts, axis=1)[:, None] * self.norm)
        least = self.certain(texts, cells, top, most, k)
        need = most >= least[:, None] - EQUAL
        some, made = np.empty_like(texts), np.empty((n, BLOCK), np.float32)
        for b in range(self.blocks):
            who = np.flatnonzero(need[:, b])
            if len(who):
                asked = texts if len(who) == n else np.take(texts, who, axis=0, out=some[: len(who)], mode="clip")
                cells[who, b] += np.matmul(asked, self.matrix[b * BLOCK : (b + 1) * BLOCK].T, out=made[: len(who)])
        self.visited, self.all = self.visited + int(need.sum()), self.all + need.size
        for i in range(n):
            on = slice(edge[i], edge[i + 1])
            yield self.vote(found[i], need[i], least[i], texts[i], term[on], weight[on], k)

    def certain(self, texts: np.ndarray, cells: np.ndarray, top: np.ndarray, most: np.ndarray, k: int) -> np.ndarray:
        """For each text a number that k cosines reach: those of the foremost example of the k most promising blocks."""
        if self.blocks < k:
            return np.full(len(texts), EQUAL)
        first = np.argpartition(-most, k - 1, axis=1)[:, :k]
        at = np.take_along_axis(cells, first[:, :, None], 1).argmax(2) + first * BLOCK
        exact = np.take_along_axis(cells.reshape(len(texts), -1), at, 1)
        for j in range(k):
            exact[:, j] += np.einsum("ij,ij->i", texts, self.matrix[at[:, j]])
        return np.maximum(np.maximum(exact.min(1), np.partition(top, self.blocks - k, axis=1)[:, self.blocks - k]), EQUAL)

    def vote(self, found: np.ndarray, need: np.ndarray, least: float, text: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero((found >= least - EQUAL) & (found > 0))
        at = at[need[at // BLOCK]]
        rows = at[largest(found[at], self.order[at], k)]
        on = self.mark[term]
        if not on.any():
            return self.order[rows], found[rows], found[rows]
        marked = self.sums(term[on], weight[on])[: len(self.order)]
        held = np.flatnonzero(marked)
        marked[held] /= self.mark_norm[self.order[held]] * np.sqrt(np.sum(weight[on] ** 2))
        more = np.setdiff1d(held[largest(marked[held], self.order[held], k)], rows)
        cosine = np.where(need[more // BLOCK], found[more], found[more] + self.matrix[more] @ text)
        rows, cosine = np.concatenate([rows, more]), np.concatenate([found[rows], cosine])
        return self.order[rows], cosine, cosine + marked[rows]

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a positive cosine."""
        rows, cosine, _ = next(self.search(np.array([0, len(term)]), term, weight, k))
        return rows[:k], cosine[:k]


def largest(values: np.ndarray, number: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, largest first; equal ones go by their number."""
    if len(values) > k:
        near = np.flatnonzero(values >= np.partition(values, len(values) - k)[len(values) - k] - EQUAL)
    else:
        near = np.arange(len(values))
    return near[np.lexsort((number[near], -np.round(values[near].astype(np.float64), 6)))[:k]]


#: The index of the last model that this worker has read: it is built once and not in every task.
_kept: dict[str, tuple[list, BlockMax]] = {}


def examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: Column, sample: int) -> DataFrame:
    """(id, toxic, text) of the labelled rows to learn from, at most ``sample``."""
    taught = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).filter(learn).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    taught = taught.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(taught), "_id").select(F.col("_id").alias("id"), "toxic", "text")


def columns(df: DataFrame) -> list[np.ndarray]:
    """Bigint columns of a bounded table; they come to the driver as bytes, a batch in a row."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(c).astype(np.int64).tobytes()], pa.binary()) for c in batch.columns], names)

    got = df.mapInArrow(run, ", ".join(f"{c} binary" for c in names)).collect()
    return [np.frombuffer(b"".join(r[c] for r in got), np.int64) for c in names]


def example_terms(taught: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all terms of the examples, and which of them mark toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                row, code, _ = counts(*terms(Words(*text_bytes(piece.column("text")))))
                toxic = np.asarray(piece.column("toxic")).astype(np.int64)[row]
                order = np.argsort(code, kind="stable")
                if len(order):
                    edge = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))
                    yield pa.RecordBatch.from_arrays([pa.array(code[order][edge].view(np.int64)), pa.array(np.add.reduceat(toxic[order], edge)), pa.array(np.diff(np.append(edge, len(order))))], ["code", "p", "m"])

    all_ = taught.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    p0, n0 = float(all_[0]), float(all_[1] - all_[0])
    held = taught.select("toxic", "text").mapInArrow(run, "code bigint, p bigint, m bigint").groupBy("code").agg(F.sum("p").alias("p"), F.sum("m").alias("m"))
    p, n = (F.col("p") + 0.5) / (p0 + 1), (F.col("m") - F.col("p") + 0.5) / (n0 + 1)
    ratio = F.col("p") * F.log(p / ((F.col("m") + 1) / (p0 + n0 + 2))) + (F.col("m") - F.col("p")) * F.log(n / ((F.col("m") + 1) / (p0 + n0 + 2)))
    mark = (F.col("m") >= LEAST_ROWS) & (p / n >= LIFT) & (2 * ratio >= SIGNIFICANT) & F.lit(p0 > 0 and n0 > 0)
    code, mark = columns(held.select("code", mark.cast("bigint").alias("mark")))
    order = np.argsort(code.view(np.uint64))
    return code.view(np.uint64)[order], mark.astype(bool)[order]


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Rows of the whole table that hold each term."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value), np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                row, term = held.value.look_up(*terms(Words(*text_bytes(piece.column("text")))))
                both = np.unique(row * max(len(total), 1) + term)
                total += np.bincount(both % max(len(total), 1), minlength=len(total))
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], ["term", "rows"])

    out = np.zeros(len(vocabulary), np.int64)
    term, rows = columns(docs.select("text").mapInArrow(run, "term bigint, rows bigint").groupBy("term").agg(F.sum("rows").alias("rows")))
    out[term] = rows
    return out


def score(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = SAMPLE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(id, score, neighbours) of every row; ``learn`` says which rows of ``labels`` may be learned from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    taught = examples(docs, labels, id_col, text_col, label_col, learn, sample)
    from windowlab.llm.store import stored

    taught = stored(taught, "taught")
    codes, mark = example_terms(taught)
    vocabulary = Vocabulary(codes)
    all_rows = rows.count()
    idf = np.log((1 + all_rows) / (1 + document_frequencies(rows, vocabulary))) + 1 if len(vocabulary) else np.zeros(0)
    words = spark.sparkContext.broadcast((vocabulary, idf))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                row, term, tf = term_counts(piece, words.value[0])
                edge = np.searchsorted(row, np.arange(piece.num_rows + 1)).tolist()
                packed = pa.array([pack(term[a:b], tf[a:b]) for a, b in zip(edge, edge[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("toxic"), packed], ["id", "toxic", "vector"])

    held = stored(taught.mapInArrow(index, extend(taught.select("id", "toxic"), "vector binary")), "index")
    who = held.select("id", "toxic").orderBy("id", "toxic").toPandas()
    prior = float(who["toxic"].mean()) if len(who) else 0.0
    # the vectors pass through the driver in parts, in order of their ids
    edges, parts = who["id"].drop_duplicates().tolist()[::PART], []
    for lo, hi in zip(edges, [*edges[1:], None]):
        part = held.filter((F.col("id") >= F.lit(lo)) & (F.lit(True) if hi is None else F.col("id") < F.lit(hi))).toPandas().sort_values(["id", "toxic"])
        parts.append(spark.sparkContext.broadcast((part["id"].tolist(), part["vector"].tolist(), part["toxic"].to_numpy(dtype=np.float64))))
    name, model = uuid.uuid4().hex, spark.sparkContext.broadcast((mark, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, prior = model.value
        if name not in _kept:
            _kept.clear()
            ids = [i for p in parts for i in p.value[0]]
            idf = words.value[1].astype(np.float32)

            def vectors_of(p) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                found = [unpack(v) for v in p.value[1]]
                length = np.array([len(t) for t, _ in found])
                term, tf = (np.concatenate([np.zeros(0, np.int32), *(x[k] for x in found)]) for k in (0, 1))
                return length, term, unit(np.repeat(np.arange(len(found)), length), term, tf.astype(np.float32), idf, len(found)).astype(np.float32)

            toxic = np.concatenate([np.zeros(0), *(p.value[2] for p in parts)])
            _kept[name] = ids, BlockMax(len(mark), lambda: map(vectors_of, parts), toxic, mark)
        ids, near = _kept[name]
        toxic = near.toxic
        for batch in batches:
            for piece in pieces(batch, "text"):
                row, t, w = vectors(piece, *words.value)
                edge = np.searchsorted(row, np.arange(piece.num_rows + 1))
                scores, evidence = np.full(piece.num_rows, prior), [[] for _ in range(piece.num_rows)]
                for at in range(0, piece.num_rows if len(ids) else 0, ROWS):
                    some = edge[at : at + ROWS + 1]
                    on = slice(some[0], some[-1])
                    for r, (found, cosine, vote) in enumerate(near.search(some - some[0], t[on], w[on], neighbours), at):
                        if len(found):
                            scores[r] = (vote @ toxic[found] + PRIOR_WEIGHT * prior) / (vote.sum() + PRIOR_WEIGHT)
                            evidence[r] = [{"example": ids[k], "cosine": float(c)} for k, c in zip(found.tolist(), cosine)]
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(scores), pa.array(evidence, pa.list_(pa.struct([("example", piece.column("id").type), ("cosine", pa.float64())])))], ["id", "score", "neighbours"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, StructType([rows.schema["id"], *StructType.fromDDL(f"score double, neighbours array<struct<example:{kind},cosine:double>>").fields]))
