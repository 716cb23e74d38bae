"""Ranked lexical search by dense blocked products: item vocabulary tiles times document impact tiles.

A document's impact for a term is ``10^9 tf div (1000 tf + 20 m)`` with ``m = 50 + 50 n N div L``; a term weighs
``floor(1000 ln((2N + 2) / (2df + 1)))``.  Items are dealt into blocks of about ``BLOCK_TERMS`` (item, term) pairs, so what a
task gets of them is bounded.  For a block one pass over the whole texts keeps (n, terms, frequencies) of the block's
vocabulary, and counts over that table give N, L and document frequencies.  Scoring takes tiles of ``DOC_ROWS`` documents,
``ITEM_COLUMNS`` items and of their compact vocabulary as many terms as keep every partial sum below 2^53: the product in
float64 is then exact, and partial products are added as 64-bit integers.  Of every tile only what reaches an item's k-th best
score so far stays, ties included, until the smaller id decides.

Results: an item is an item id, null being one too; its terms are those of all its rows, once each.  Every row of documents
counts by itself, so a repeated row may fill two ranks; null texts have no terms; null ids come last among equal scores.
Items without a term in any document, and empty tables, give no rows.  Other columns are not read.  Ids are integers.
Terms are told apart by 64-bit hashes.  A very long text is one row of its own in memory, about 60 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from windowlab.llm.arrays import Words, pieces, text_bytes
from windowlab.llm.store import partitions, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of texts: A-Z as a-z, what separates terms as a space.
FOLD = np.full(256, 0x20, np.uint8)
for _first, _last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    FOLD[_first : _last + 1] = np.arange(_first, _last + 1)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)

DEPTH = 50
#: (item, term) pairs of a block, apart from those of its last item.
BLOCK_TERMS = 100_000
DOC_ROWS, ITEM_COLUMNS, TERM_TILE = 1024, 256, 2048
#: An impact is below this number whatever the frequency.
IMPACT_BOUND = 1_000_000
#: Groups in which an item's candidates of all tasks are cut to k before they meet.
SALTS = 64


def integer_id(df: DataFrame, name: str) -> Column:
    """The id column as a 64-bit integer."""
    if not isinstance(df.schema[name].dataType, IntegralType):
        raise ValueError(f"{name} must be an integer column")
    return F.col(name).cast("bigint")


def item_terms(items: DataFrame, id_col: str, text_col: str, block_terms: int) -> DataFrame:
    """(block, item, terms): distinct terms of every item, items in order of id dealt into blocks of bounded size.

    The number of pairs before an item decides its block, so the number of blocks does not depend on how rows are dealt to tasks.
    """
    text = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pairs = items.select(integer_id(items, id_col).alias("item"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))).alias("term"))
    whole = stored(pairs.distinct().groupBy("item").agg(F.collect_list("term").alias("terms")), "item_terms")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            ends = before + np.cumsum(np.asarray(pc.list_value_length(b.column("terms")), np.int64))
            starts = np.concatenate([[before], ends])[:-1]
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part)), pa.array(starts), b.column("item"), b.column("terms")], ["part", "before", "item", "terms"])

    ordered = whole.repartitionByRange(partitions(items.sparkSession), "item").sortWithinPartitions("item")
    placed = stored(ordered.mapInArrow(place, "part bigint, before bigint, item bigint, terms array<string>"), "items")
    begin, total = [], 0
    for part, size in sorted((r[0], r[1]) for r in placed.groupBy("part").agg(F.sum(F.size("terms"))).collect()):
        begin.append((part, total))
        total += size
    begins = items.sparkSession.createDataFrame(begin, "part bigint, begin bigint")
    return placed.join(F.broadcast(begins), "part").select(F.expr(f"(begin + before) div {block_terms}").alias("block"), "item", "terms")


def term_codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Terms of a batch of texts and a 64-bit hash of each."""
    words = Words(FOLD[raw], offsets)
    return words, words.hashes(lower=False)


class Block:
    """Vocabulary of a block of items: sorted hashes, and (item column, term number) of all pairs."""

    def __init__(self, rows: list):
        self.items = [r["item"] for r in rows]
        said = [t.encode() for r in rows for t in r["terms"]]
        raw = np.frombuffer(b" ".join(said), np.uint8)
        _, codes = term_codes(raw, np.array([0, len(raw)], np.int64))
        self.codes, self.term = np.unique(codes, return_inverse=True)
        self.column = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.codes >> np.uint64(48)).astype(np.int64)] = True

    def frequencies(self, piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all terms of each row), then row, term number and frequency of the terms that the block holds."""
        words, codes = term_codes(*text_bytes(piece.column("text")))
        some = np.flatnonzero(self.gate[(codes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.codes, codes[some]), max(len(self.codes) - 1, 0))
        hit = self.codes[at] == codes[some] if len(some) else np.zeros(0, bool)
        both, tf = np.unique(words.row[some[hit]] * np.int64(len(self.codes)) + at[hit], return_counts=True)
        row, term = np.divmod(both, len(self.codes))
        return words.count, row, term, tf


def binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose rows are the stretches of a flat array of 4-byte numbers that end at ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values, np.int32))])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 4-byte numbers of a binary column, and how many each row has."""
    raw, offsets = text_bytes(column)
    return np.frombuffer(raw.tobytes(), np.int32), np.diff(offsets) // 4


def compact(docs: DataFrame, block: Block, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tf): of every document all its terms counted, and the block's terms with their frequencies."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in pieces(b, "text"):
                n, row, term, tf = block.frequencies(piece)
                ends = np.cumsum(np.bincount(row, minlength=piece.num_rows))
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(n.astype(np.int64)), binary(term, ends), binary(tf, ends)], ["id", "n", "terms", "tf"])

    return docs.select(integer_id(docs, id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(read, "id bigint, n bigint, terms binary, tf binary")


def counted(found: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of every term of the block."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, np.int64)
        for b in batches:
            n = np.asarray(b.column("n"))
            total[:size] += np.bincount(flat(b.column("terms"))[0], minlength=size)
            total[size:] += (np.count_nonzero(n), n.sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["at", "n"])

    sums = found.select("n", "terms").mapInArrow(tally, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size + 2, np.int64)
    out[sums["at"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return int(out[size]), int(out[size + 1]), out[:size]


def length_factor(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents with ``n`` terms."""
    if 50 * int(n.max(initial=0)) * documents < 1 << 63:
        return 50 + (50 * n * documents) // terms
    return np.array([50 + 50 * x * documents // terms for x in n.tolist()], np.int64)


class Best:
    """The k best of every item column so far: larger score, then smaller id, a null id last."""

    def __init__(self, columns: int, k: int):
        self.k, self.columns = k, columns
        self.floor = np.ones(columns, np.int64)
        self.kept = [np.zeros(0, np.int64) for _ in range(4)]  # column, score, null, id
        self.waiting: list[list[np.ndarray]] = []
        self.count = 0

    def offer(self, first: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Scores of a tile (documents x columns from ``first`` on)."""
        row, column = np.nonzero(scores >= self.floor[first : first + scores.shape[1]])
        self.waiting.append([column + first, scores[row, column], null[row], ids[row]])
        self.count += len(row)
        if self.count > 4 * self.k * self.columns:
            self.settle()

    def settle(self) -> None:
        column, score, null, ids = (np.concatenate(x) for x in zip(self.kept, *self.waiting))
        order = np.lexsort((ids, null, -score, column))
        place = np.arange(len(order)) - np.searchsorted(column[order], column[order])
        order = order[place < self.k]
        self.kept = [x[order] for x in (column, score, null, ids)]
        last = place[place < self.k] == self.k - 1
        self.floor[self.kept[0][last]] = self.kept[1][last]
        self.waiting, self.count = [], 0


def tiles(block: Block, weight: np.ndarray) -> list[tuple[int, int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """(first item column, columns, term tiles); a term tile is its term numbers and the (place, column) pairs of its items.

    A term tile is so short that its largest possible sum stays below 2^53.
    """
    width = max(1, min(TERM_TILE, ((1 << 53) - 1) // (IMPACT_BOUND * int(weight.max(initial=1) or 1))))
    out = []
    for first in range(0, len(block.items), ITEM_COLUMNS):
        mine = (block.column >= first) & (block.column < first + ITEM_COLUMNS)
        own, place = np.unique(block.term[mine], return_inverse=True)
        column = block.column[mine] - first
        cuts = []
        for at in range(0, len(own), width):
            on = (place >= at) & (place < at + width)
            cuts.append((own[at : at + width], place[on] - at, column[on]))
        out.append((first, min(ITEM_COLUMNS, len(block.items) - first), cuts))
    return out


def best_documents(found: DataFrame, block: Block, k: int) -> DataFrame:
    """(item, rank, id, score) of a block's items."""
    documents, terms, df = counted(found, len(block.codes))
    weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    plan = tiles(block, weight)
    size = len(block.codes)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.items), k)
        place = np.full(size, -1, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, DOC_ROWS):
                b = whole.slice(at, DOC_ROWS)
                term, held = flat(b.column("terms"))
                tf = flat(b.column("tf"))[0].astype(np.int64)
                row = np.repeat(np.arange(b.num_rows), held)
                m = length_factor(np.asarray(b.column("n")), documents, max(terms, 1))
                impact = ((10**9 * tf) // (1000 * tf + 20 * m[row])).astype(np.float64)
                null = np.asarray(b.column("id").is_null()).astype(np.int64)
                ids = np.asarray(b.column("id").fill_null(0))
                for first, columns, cuts in plan:
                    scores = np.zeros((b.num_rows, columns), np.int64)
                    for own, at_term, at_column in cuts:
                        place[own] = np.arange(len(own))
                        to = place[term]
                        on = to >= 0
                        tile = np.zeros((b.num_rows, len(own)))
                        tile[row[on], to[on]] = impact[on]
                        weights = np.zeros((len(own), columns))
                        weights[at_term, at_column] = weight[own[at_term]]
                        scores += (tile @ weights).astype(np.int64)
                        place[own] = -1
                    best.offer(first, scores, ids, null)
        best.settle()
        column, score, null, ids = best.kept
        yield pa.RecordBatch.from_arrays([pa.array(column), pa.array(ids, mask=null.astype(bool)), pa.array(score)], ["column", "id", "score"])

    rows = found.select("id", "n", "terms", "tf").filter("octet_length(terms) > 0").mapInArrow(multiply, "column bigint, id bigint, score bigint")
    order = [F.desc("score"), F.asc_nulls_last("id")]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for keys in (["column", "salt"], ["column"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    names = found.sparkSession.createDataFrame([(c, i) for c, i in enumerate(block.items)], "column bigint, item bigint")
    return rows.join(F.broadcast(names), "column").select("item", "rank", "id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item, rank, id, score): the ``k`` documents of highest score above 0 for every item, over all rows of ``docs``."""
    spark = docs.sparkSession
    dealt = item_terms(items, item_col, item_text_col, block_terms)
    out = spark.createDataFrame([], "item bigint, rank int, id bigint, score bigint")
    for b in sorted(r["block"] for r in dealt.select("block").distinct().collect()):
        block = Block(dealt.filter(F.col("block") == b).orderBy("item").collect())
        found = stored(compact(docs, block, id_col, text_col), "impacts")
        out = out.unionByName(stored(best_documents(found, block, k), "ranked"))
    return out
