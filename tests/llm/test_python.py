"""BPE and tiling against plain versions."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from tests.llm.helpers import AWKWARD, frame, words
from windowlab.llm import bpe, tiling
from windowlab.llm.arrays import Words, shingles, text_bytes

PATH = P.path("byte_bpe_50k.tiktoken")


def test_words_and_shingles():
    texts = [t for _, t in AWKWARD] + ["A b C d e f", " x", "y "]
    w = Words(*text_bytes(pa.array(texts, pa.string())))
    raw = w.raw.tobytes()
    assert [[raw[a:b].decode() for a, b, r in zip(w.start, w.end, w.row) if r == k] for k in range(len(texts))] == [words(t, False) for t in texts]
    codes = w.hashes()
    by_word = {}
    for a, b, c in zip(w.start, w.end, codes):
        assert by_word.setdefault(raw[a:b].decode().lower(), c) == c
    assert len(set(by_word.values())) == len(by_word)
    row, h = shingles(w, codes)
    for k, t in enumerate(texts):
        v = words(t)
        want = {tuple(v[i : i + 5]) for i in range(len(v) - 4)} if len(v) >= 5 else ({tuple(v)} if v else set())
        assert len(set(h[row == k])) == len(want)


LONG = ["word   \n  naïve 漢字 it's 12345 !!! " * 200, "a" * 3000, ("ab " * 300) + "z" * 900 + (" it's" * 400), " " * 2500, "\n \n" * 900, "é" * 999 + " " * 999 + "'ll" * 300]


@pytest.mark.parametrize("chunk,overlap,spread", [(64, 16, 64), (300, 40, 500), (1000, 100, 2500), (100, 30, 1 << 22)])
def test_bpe_round_trip(spark, chunk, overlap, spread):
    rows = AWKWARD[:9] + [(100 + i, t) for i, t in enumerate(LONG)] + [(100, LONG[0]), (None, LONG[2]), (104, LONG[0])]
    got = bpe.decode(bpe.encode(frame(spark, rows), PATH, P.PATTERN, chunk=chunk, overlap=overlap, spread=spread), PATH, P.PATTERN).collect()
    enc = bpe.encoder(PATH, P.PATTERN)
    want = sorted(str((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode())) for i, t in rows)
    assert sorted(str((r.id, bytes(r.ids), bytes(r.bytes))) for r in got) == want
    assert bpe.encode(frame(spark, []), PATH, P.PATTERN).count() == 0


def plain_tiles(a, b, least):
    """Greedy string tiling by definition: the longest common unmarked run, earliest first, again and again."""
    fa, fb, total = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and fa[i + k] and fb[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return total
        k, i, j = best
        fa[i : i + k] = fb[j : j + k] = [False] * k
        total += k


def test_tiles_by_definition():
    rng = np.random.default_rng(3)
    for _ in range(150):
        item = rng.integers(0, 6, rng.integers(5, 40)).tolist()
        text = rng.integers(0, 6, 30).tolist() + item[len(item) // 2 :] + [99] + item[: len(item) // 2] + rng.integers(0, 6, 20).tolist()
        got = tiling.tile(text, item, 5)
        assert sum(t[2] for t in got) == plain_tiles(text, item, 5)
        assert all(text[i : i + k] == item[j : j + k] for i, j, k in got)


def test_contaminated(spark):
    item = " ".join(f"w{i}" for i in range(30))
    w = item.split()
    docs = frame(spark, AWKWARD + [(50, "x y z " + item.upper() + " end"), (51, " ".join(w[15:] + ["gap"] + w[:15])), (52, " ".join(w[:12])), (53, "a b c " * 50), (50, item), (54, "short one")])
    tests = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "", 2), (10, "short one", 3)], "item_id long, text string, doc_id long")
    got = sorted((r.id, r.item, r.covered_words, r.tiles) for r in tiling.contaminated(docs, tests).collect())
    assert got == [(50, 7, 30, 1), (50, 7, 30, 1), (51, 7, 30, 2), (54, 10, 2, 1)]
    assert tiling.contaminated(docs, tests.limit(0)).count() == 0 and tiling.contaminated(frame(spark, []), tests).count() == 0
