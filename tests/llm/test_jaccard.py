"""The metric join against all pairs."""

import random

import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, frame, words
from windowlab.llm import graph, jaccard, queries


def plain_classes(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(i, j) for v in by.values() for i in v for j in v if i < j}
    for i, j in pairs:
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def planted(seed, hot):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(4000)}"
    line = [f"hot{i}" for i in range(hot)]
    rows, n = list(AWKWARD), 1000
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(8, 90))]
        base = base[: len(base) // 2] + (line if rng.random() < 0.7 else []) + base[len(base) // 2 :]
        for _ in range(rng.randrange(1, 7)):
            rows.append((n, " ".join(base)))
            n += 1
            if rng.random() < 0.8:
                base[rng.randrange(len(base))] = word()
            if rng.random() < 0.3:
                base = base + [word() for _ in range(rng.randrange(6))]
    return rows


@pytest.mark.parametrize("seed,hot,cell", [(1, 6, 64), (2, 25, 4), (3, 60, 3)])
def test_classes_equal_all_pairs(spark, monkeypatch, seed, hot, cell):
    """Also with tiny limits for cells, so that crowded cells go through the recursive split."""
    monkeypatch.setattr(jaccard, "CELL_REGIONS", cell)
    rows = planted(seed, hot)
    got = sorted((r.id, r.n, r["class"]) for r in jaccard.classes(frame(spark, rows)).collect())
    assert got == plain_classes(rows)


def test_repeated_rows_in_crowded_cells(spark, monkeypatch):
    """Rows repeated with id and text are one set: they do not push its partners out of its windows."""
    monkeypatch.setattr(jaccard, "CELL_REGIONS", 3)
    rows = planted(3, 60)
    rows = rows + [r for i, r in enumerate(rows) if i % 2 and r[0] >= 1000 for _ in range(6)]
    docs = frame(spark, rows)
    found = jaccard.full_sets(docs.selectExpr("doc_id as id", "text"), jaccard.read_sets(docs.selectExpr("doc_id as id", "text"), 5).filter("n > 0").groupBy("key").agg({"id": "min"}).withColumnRenamed("min(id)", "id"), 5)
    assert found.count() == found.select("key").distinct().count()
    assert sorted((r.id, r.n, r["class"]) for r in jaccard.classes(docs).collect()) == plain_classes(rows)


def test_empty_and_chain(spark):
    assert jaccard.classes(frame(spark, [])).count() == 0
    chain = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 99), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in graph.components(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}


def test_op8_over_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.QUERIES["op8_jaccard_classes"](spark, sf).collect())
    assert got == plain_classes(rows)


def test_common_lines_crowd_no_cells(spark, monkeypatch):
    """A line that every text holds stands last in the windows: cells stay small and nothing is drawn again."""
    entered = []
    for name in ("merge_dense", "split_hot"):
        monkeypatch.setattr(jaccard, name, lambda *a, name=name, old=getattr(jaccard, name): entered.append(name) or old(*a))
    rng = random.Random(5)
    line = " ".join(f"hot{i}" for i in range(50))
    rows = [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(60)) + " " + line) for i in range(150)]
    rows.append((999, rows[7][1] + " more"))
    assert sorted((r.id, r.n, r["class"]) for r in jaccard.classes(frame(spark, rows)).collect()) == plain_classes(rows)
    assert not entered


def test_members_are_read_by_frequency():
    h = np.array([3, 5, 9, 2, 5, 7], np.uint64)
    late = jaccard.read_late(h, np.array([3, 0, 3]), np.array([3, 5], np.uint64), np.array([9, 4], np.uint8))
    assert late.tolist() == [9, 5, 3, 2, 7, 5]
    assert jaccard.read_late(h, np.array([6]), np.zeros(0, np.uint64), np.zeros(0, np.uint8)).tolist() == h.tolist()
