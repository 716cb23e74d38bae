"""Repeat removal against a dictionary of all strings."""

import hashlib
import random

import pytest

from tests.llm.helpers import AWKWARD, frame
from windowlab.llm import queries, repeats


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            k = hash(t[i : i + length])
            count[k] = count.get(k, 0) + 1
    out = []
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        last = 0
        for i in range(len(t) - length + 1):
            if count[hash(t[i : i + length])] > 1:
                a = max(i, last)
                gone[a : i + length] = b"\1" * (i + length - a)
                last = i + length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


def planted(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [text(rng.randrange(150, 700)) for _ in range(6)]
    rows = [(i, t) for i, t in AWKWARD if i != 9] + [(9, "word " * 400)]
    for n in range(160):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            s = rng.choice(shared)
            a = rng.randrange(0, 120)
            parts += [text(rng.randrange(0, 160)), s[a : len(s) - rng.randrange(0, 120)] if rng.random() < 0.7 else ""]
        rows.append((100 + n, "".join(parts)))
        if rng.random() < 0.3:
            t = list(rows[-1][1])
            if t:
                t[rng.randrange(len(t))] = "Z"
            rows.append((1000 + n, "".join(t)))
    rows += [(5000, rows[-1][1]), (5001, text(90) * 8)]
    return rows


@pytest.mark.parametrize("seed,crowded", [(1, 4000), (2, 4000), (3, 5)])
def test_removal_equals_brute_force(spark, monkeypatch, seed, crowded):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    rows = planted(seed)
    got = sorted((r.id, r.n, r.removed, r.spans, r.sha) for r in repeats.without_repeats(frame(spark, rows)).collect())
    assert got == plain(rows, 200)


def test_maximal_repeat_groups(spark):
    """Every repeated string is one group with all its occurrences."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    s = text(260)
    rows = [(i, text(50) + s + text(50)) for i in range(5)]
    runs = repeats.find_repeats(frame(spark, rows).select(*[__import__("pyspark").sql.functions.col(a).alias(b) for a, b in (("doc_id", "id"), ("text", "text"))]))[1].collect()
    groups = {}
    for r in runs:
        groups.setdefault(r.repeat, set()).add(r.key)
    assert max(map(len, groups.values())) == 5
    assert repeats.without_repeats(frame(spark, [])).count() == 0


def test_op9_over_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op9_repeat_removal"](spark, sf).collect())
    assert got == plain(rows, 200)
