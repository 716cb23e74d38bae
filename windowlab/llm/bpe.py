"""Byte-level BPE over whole texts by overlapping chunks, and its inverse.

A long text is cut into chunks that overlap.  Each chunk is pre-tokenised on its own; a chunk that begins inside a
pre-token soon falls into step with the true boundaries.  Where a boundary of one chunk is also a boundary of the next,
both agree from there on, because the pattern looks only ahead.  The text is cut at the first such place of every
overlap, and the pieces are encoded in parallel.  A text in which some overlap has no common boundary (one run of
letters longer than the overlap) is encoded as one piece.

Results: null text is empty and has no tokens; repeated rows give repeated results; only the id and text columns are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from windowlab.llm.arrays import pieces
from windowlab.llm.store import extend

CHUNK = 16384
OVERLAP = 512
#: Longer texts (about a second of work) have their chunks spread over tasks; others are cut and stitched where they lie.
SPREAD = 1 << 22

_encoders: dict[tuple[str, str], object] = {}


def encoder(path: str, pattern: str):
    """The merge ranks of a file, loaded once per worker."""
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def boundaries(text: str, pattern: str) -> np.ndarray:
    """Ends of the pre-tokens of a text, in code points."""
    import regex

    return np.array([m.end() for m in regex.compile(pattern).finditer(text)], np.int64)


def cut(text: str, pattern: str, chunk: int, overlap: int) -> list[str]:
    """Pieces of a text that begin and end at pre-token boundaries: its chunks are scanned one by one and stitched."""
    places, tail = [0], None
    for at in range(0, max(len(text), 1), chunk):
        b = boundaries(text[at : at + chunk + overlap], pattern) + at
        if at:
            both = np.intersect1d(tail, b[b < at + overlap], assume_unique=True)
            if not len(both):
                return [text]
            places.append(int(both[0]))
        tail = b[:-1][b[:-1] >= at + chunk]  # the last pre-token may go on beyond the chunk
    return [text[a:b] for a, b in zip(places, [*places[1:], len(text)])]


def encode_rows(df: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Replace ``text`` by ``ids``: little-endian unsigned 32-bit integers."""

    def one(enc, text: str) -> bytes:
        parts = cut(text, pattern, chunk, overlap) if len(text) > chunk + overlap else [text]
        return b"".join(np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in parts if t)

    names = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids = [one(enc, t) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(ids, pa.binary())], [*names, "ids"])

    return df.select(*names, "text").mapInArrow(run, extend(df.select(*names), "ids binary"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add ``bytes``: the raw bytes of the ids, concatenated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for piece in pieces(batch, "ids"):
                raw = [enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in piece.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(raw, pa.binary())], [*piece.schema.names, "bytes"])

    return encoded.mapInArrow(run, extend(encoded, "bytes binary"))


def cut_long(rows: DataFrame, pattern: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Long texts (id, copy, text) as pieces (id, copy, part, text) that begin and end at pre-token boundaries, and (id, copy, copies).

    Chunks are scanned where their text lies; only boundaries inside overlaps are shuffled.  Then every chunk meets its cuts.
    """
    chunks = rows.select("id", "copy", F.length("text").alias("size"), "text").select(
        "id", "copy", "size", F.expr(f"explode(transform(sequence(0, cast((size - 1) div {chunk} as int)), i -> struct(i as part, substring(text, i * {chunk} + 1, {chunk + overlap}) as text)))").alias("c")
    ).select("id", "copy", "size", "c.part", "c.text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            head, tail = [], []
            for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist()):
                b = boundaries(text, pattern)
                head.append((b[b < overlap] + part * chunk).tolist())
                b = b[:-1]  # the last pre-token may go on beyond the chunk
                tail.append((b[b >= chunk] + part * chunk).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "copy", "size", "part")] + [pa.array(head, longs), pa.array(tail, longs)], ["id", "copy", "size", "part", "head", "tail"])

    seen = chunks.mapInArrow(scan, extend(chunks.select("id", "copy", "size", "part"), "head array<bigint>, tail array<bigint>"))
    # repeated rows of one id and text have the same boundaries
    seen = seen.groupBy("id", "copy", "part").agg(F.first("size").alias("size"), F.first("head").alias("head"), F.first("tail").alias("tail"), F.count("*").alias("copies"))
    order = Window.partitionBy("id", "copy").orderBy("part")
    met = seen.withColumn("begin", F.when(F.col("part") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(order), "head"))))
    step = met.withColumn("end", F.coalesce(F.lead("begin").over(order), "size")).withColumn("in_step", F.min(F.col("begin").isNotNull()).over(Window.partitionBy("id", "copy")))
    cuts = step.select(F.col("id").alias("_id"), F.col("copy").alias("_copy"), F.col("part").alias("_part"), "begin", "end", "in_step", "copies")
    met = chunks.join(cuts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")) & (F.col("part") == F.col("_part")))
    piece = met.filter("in_step").select("id", "copy", "part", F.expr(f"substring(text, cast(begin - part * {chunk} + 1 as int), cast(end - begin as int))").alias("text"))
    first = cuts.filter("_part = 0")
    lost = rows.join(first.filter("not in_step"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), "left_semi")
    return piece.unionByName(lost.select("id", "copy", F.lit(0).alias("part"), "text")), first.select(F.col("_id").alias("id"), F.col("_copy").alias("copy"), "copies")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """(id, ids) for every row: texts up to ``spread`` code points are chunked and stitched where they lie, longer ones over many tasks."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    short = encode_rows(rows.filter(F.length("text") <= spread), path, pattern, chunk, overlap)
    long = rows.filter(F.length("text") > spread).select("id", F.md5("text").alias("copy"), "text")
    parts, copies = cut_long(long, pattern, chunk, overlap)
    done = encode_rows(parts, path, pattern, chunk, overlap).groupBy("id", "copy").agg(F.collect_set(F.struct("part", "ids")).alias("all"))
    whole = F.unhex(F.expr("array_join(transform(array_sort(all), x -> hex(x.ids)), '')")).alias("ids")
    copies = copies.select(F.col("id").alias("_id"), F.col("copy").alias("_copy"), "copies")
    many = done.join(copies, F.col("id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy"))).select("id", whole, F.expr("explode(sequence(1L, copies))").alias("nth"))
    return short.select("id", "ids").unionByName(many.select("id", "ids"))
