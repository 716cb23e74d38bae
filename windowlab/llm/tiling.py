"""Benchmark decontamination by greedy string tiling.

Seeds: runs of ``least`` words that a document shares with a test item.  For every pair that shares one, the longest
common runs of words that do not overlap are marked, again and again, found by rolling Karp-Rabin hashes whose window
shrinks; what the marked tiles cover of the item decides, so a passage counts whichever order its parts stand in.

Results: null or empty texts and items have no pairs; items with fewer than ``least`` words are matched as a whole
(one seed of all their words); repeated rows give repeated pairs; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from windowlab.llm.arrays import BASE, Words, mix, pieces, text_bytes
from windowlab.llm.store import extend

LEAST = 5
COVERED = 0.6
#: Items of one pass over the documents; their words are sent to every task, so this bounds what is sent.
BLOCK_ITEMS = 2000
BLOCK_CHARS = 4_000_000


def grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that begin at every place."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * BASE + codes[k : k + n]
    return mix(out)


def rolling(codes: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(place, hash) of every window of ``size`` unmarked words: the Karp-Rabin hash moves on by one word at a time."""
    mask, base = (1 << 61) - 1, 1_000_003
    top, value, run = pow(base, size - 1, mask), 0, 0
    for i, c in enumerate(codes):
        if not free[i]:
            value = run = 0
            continue
        if run == size:
            value = (value - codes[i - size] * top) % mask
            run -= 1
        value, run = (value * base + c) % mask, run + 1
        if run == size:
            yield i - size + 1, value


def tile(text: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in text, place in item, words): longest first, none overlapping, none shorter than ``least``."""
    free_t, free_i, tiles = [True] * len(text), [True] * len(item), []
    size = max(least, min(20, len(item)))
    while True:
        table: dict[int, list[int]] = {}
        for j, h in rolling(item, free_i, size):
            table.setdefault(h, []).append(j)
        found, longest = [], 0
        if table:
            for i, h in rolling(text, free_t, size):
                for j in table.get(h, ()):
                    if i and j and free_t[i - 1] and free_i[j - 1] and text[i - 1] == item[j - 1]:
                        continue  # part of a match that began earlier
                    k = 0
                    while i + k < len(text) and j + k < len(item) and free_t[i + k] and free_i[j + k] and text[i + k] == item[j + k]:
                        k += 1
                    if k >= size:
                        found.append((k, i, j))
                        longest = max(longest, k)
        if longest > 2 * size:
            size = longest
            continue
        cut = False
        for k, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if all(free_t[i : i + k]) and all(free_i[j : j + k]):
                free_t[i : i + k] = free_i[j : j + k] = [False] * k
                tiles.append((i, j, k))
            else:
                cut = True  # what is left of it is sought again
        if cut and tiles:
            continue
        if size <= least:
            return tiles
        size = max(least, size // 2)


class Items:
    """Test items as word codes, and their seeds in order of hash."""

    def __init__(self, ids: list, texts: list[str | None], least: int):
        raw, offsets = text_bytes(pa.array(texts, pa.string()))
        words = Words(raw, offsets)
        codes = words.hashes()
        self.ids, self.least = ids, least
        self.codes = [codes[words.first[k] : words.first[k + 1]] for k in range(len(ids))]
        self.sizes = sorted({min(least, len(c)) for c in self.codes if len(c)})
        self.seeds = {}
        for size in self.sizes:
            own = [k for k, c in enumerate(self.codes) if len(c) and min(least, len(c)) == size]
            hashes = np.concatenate([grams(self.codes[k], size) for k in own])
            item = np.concatenate([np.full(len(self.codes[k]) - size + 1, k) for k in own])
            order = np.argsort(hashes, kind="stable")
            near = np.zeros(1 << 20, bool)
            near[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.seeds[size] = (hashes[order], item[order], near)


def match_batch(piece: pa.RecordBatch, items: Items, covered: float) -> list[tuple[int, int, int, int, int]]:
    """(row, item, words of the item, words covered, tiles) of the pairs that reach ``covered``."""
    words = Words(*text_bytes(piece.column("text")))
    codes, out = words.hashes(), []
    for size in items.sizes:
        hashes, item, near = items.seeds[size]
        g = grams(codes, size)
        if not len(g):
            continue
        at = np.flatnonzero(near[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = at[words.row[at] == words.row[at + size - 1]]
        lo, hi = np.searchsorted(hashes, g[at], side="left"), np.searchsorted(hashes, g[at], side="right")
        hit = hi > lo
        at, lo, n = at[hit], lo[hit], (hi - lo)[hit]
        if not len(at):
            continue
        place = np.repeat(at, n)
        which = item[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        order = np.lexsort((place, which, words.row[place]))
        place, which = place[order], which[order]
        row = words.row[place]
        edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (which[1:] != which[:-1]), [True]]))
        for a, b in zip(edge[:-1], edge[1:]):
            own = items.codes[which[a]]
            # only words inside a seed can be in a tile; a gap becomes a word that no item has
            seeds, kept, last = np.unique(place[a:b]), [], -1
            for s in seeds.tolist():
                if last >= 0 and s > last:
                    kept.append(-1)
                kept.extend(range(max(s, last), s + size))
                last = s + size
            text = [int(codes[k] >> np.uint64(4)) if k >= 0 else -1 for k in kept]
            tiles = tile(text, [int(c) >> 4 for c in own], size)
            total = sum(t[2] for t in tiles)
            if total >= covered * len(own):
                out.append((int(row[a]), int(which[a]), len(own), total, len(tiles)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                 least: int = LEAST, covered: float = COVERED) -> DataFrame:
    """Pairs (id, item, item_words, covered_words, tiles) whose tiles cover at least ``covered`` of the item.

    The items are the stated query set: they are taken in blocks of bounded size, each held against all documents.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tests = benchmark.select(F.col(item_col).alias("item"), F.coalesce(item_text, F.lit("")).alias("text"))
    schema = StructType([rows.schema["id"], tests.schema["item"], *extend(rows.select(), "item_words bigint, covered_words bigint, tiles bigint").fields])
    sizes = tests.agg(F.count("*"), F.sum(F.length("text")), F.max(F.length("text"))).first()
    blocks = max(1, -(-sizes[0] // BLOCK_ITEMS), -(-(sizes[1] or 0) // BLOCK_CHARS))
    out = None
    for k in range(blocks):
        own = tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toPandas()
        held = docs.sparkSession.sparkContext.broadcast((own["item"].tolist(), own["text"].tolist()))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = Items(*held.value, least)
            for batch in batches:
                for piece in pieces(batch, "text"):
                    got = match_batch(piece, items, covered)
                    if got:
                        row, item, size, total, tiles = map(list, zip(*got))
                        yield pa.RecordBatch.from_arrays(
                            [piece.column("id").take(pa.array(row)), pa.array([items.ids[i] for i in item]), *(pa.array(x, pa.int64()) for x in (size, total, tiles))],
                            ["id", "item", "item_words", "covered_words", "tiles"],
                        )

        pairs = rows.mapInArrow(run, schema)
        out = pairs if out is None else out.unionByName(pairs)
    return out
