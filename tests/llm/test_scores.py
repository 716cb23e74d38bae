"""Lattice scores and toxic neighbours against plain versions and held-out rows."""

import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, frame, words
from windowlab.llm import lattice, queries, toxicity

PATH = P.path("piece_bpe_32k.model")


def all_segmentations(model, word):
    """Sum over segmentations, by recursion."""
    log = dict(zip(model.names, model.log))
    total = 0.0

    def walk(at, value):
        nonlocal total
        if at == len(word):
            total += math.exp(value)
            return
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in log:
                walk(end, value + log[word[at:end]])

    walk(0, 0.0)
    return math.log(total) + model.log_end


def test_forward_and_expectation():
    model = lattice.Lattice({b"ab": 3.0, b"a": 2.0, b"b": 1.0, b"abc": 1.0, lattice.BEGIN: 2.0, lattice.BEGIN + b"a": 1.0})
    ws = [b"abcab", b"a", b"", b"bbbb", "é".encode(), b"abab"]
    got = model.log_probability(ws)
    for w, g in zip(ws, got):
        assert abs(g - all_segmentations(model, lattice.BEGIN + w)) < 1e-9
    # every byte of every word is covered once by the expected pieces
    uses = model.expected(ws)
    assert abs(sum(u * len(p) for u, p in zip(uses, model.names)) - sum(len(lattice.BEGIN + w) for w in ws)) < 1e-6
    assert abs(np.exp(model.log).sum() + math.exp(model.log_end) - 1) < 1e-6


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_base_scores(spark, frequent):
    rows = AWKWARD + [(50 + i, "the cat sat on the mat " + "rare" * (i % 3)) for i in range(12)] + [(None, "the end")]
    held = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    made = lattice.score(frame(spark, rows), PATH, lattice.part("doc_id", 7) != 2, frequent=frequent).collect()
    count, n = {}, 0
    for i, t in rows:
        if i not in held:
            for w in words(t) + [None]:
                count[w], n = count.get(w, 0) + 1, n + 1
    text = {}
    for i, t in rows:
        text.setdefault(i, t)
    assert len(made) == len(rows)
    for r in made:
        w = words(text[r.id]) + [None]
        assert r.train == (r.id not in held) and r.tokens == len(w) and r.known == sum(x in count for x in w) and r.train_tokens == n
        assert abs(r.base - sum(math.log10((count.get(x, 0) + 1) / (n + len(count) + 1)) for x in w)) < 1e-6
        assert -1e9 < r.score < 0
    assert lattice.score(frame(spark, []), PATH, F.lit(True)).count() == 0
    assert lattice.score(frame(spark, AWKWARD[:5]), PATH, F.lit(False)).filter("score < 0 and known = 0").count() == 5


def test_scores_prefer_real_words(spark, sf):
    """Held-out texts score higher than the same texts with their letters reversed."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    wrong = docs.filter(lattice.part("doc_id", 7) == 2).select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.reverse("text").alias("text"))
    got = lattice.score(docs.unionByName(wrong), PATH, (F.col("doc_id") < 1_000_000) & (lattice.part("doc_id", 7) != 2)).filter("not train")
    by = {r.id: r.score / r.tokens for r in got.collect() if r.tokens > 20}
    pairs = [(v, by[i + 1_000_000]) for i, v in by.items() if i + 1_000_000 in by]
    assert pairs and sum(a > b for a, b in pairs) > 0.95 * len(pairs)


def in_parts(terms, weights, size=150):
    """The vectors as the index takes them."""
    cuts = range(0, len(terms), size)
    return lambda: ((np.array([len(t) for t in terms[i : i + size]]), np.concatenate(terms[i : i + size]), np.concatenate(weights[i : i + size])) for i in cuts)


def test_block_max_is_exact():
    rng = np.random.default_rng(1)
    term, weight = [], []
    for _ in range(500):
        t = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        w = rng.random(len(t))
        term.append(t)
        weight.append(w / np.linalg.norm(w))
    index = toxicity.BlockMax(60, in_parts(term, weight), rng.integers(0, 2, 500).astype(float))
    for _ in range(60):
        t = np.sort(rng.choice(60, 5, replace=False))
        w = rng.random(5)
        q = np.zeros(60)
        q[t] = w
        cos = np.array([v @ q[u] for u, v in zip(term, weight)])
        want = [i for i in np.lexsort((np.arange(500), -np.round(cos, 12)))[:15] if cos[i] > 0]
        ids, values = index.nearest(t, w, 15)
        assert ids.tolist() == want and np.allclose(values, cos[want])


def test_pruned_search_finds_what_a_full_search_finds(monkeypatch):
    """Topics with copies: blocks are skipped, and neighbours, cosines and votes stay those of all products."""
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rng, size = np.random.default_rng(5), 400
    texts = []
    for i in range(600):
        topic = i % 12
        own = rng.choice(np.arange(40 + 30 * topic, 70 + 30 * topic), 12, replace=False)
        texts.append(np.unique(np.concatenate([rng.choice(40, 2 + i % 25, replace=False), own])))
    texts += [texts[7]] * 40
    weights = [rng.random(len(t)) + 0.2 for t in texts[:600]]
    weights = [w / np.linalg.norm(w) for w in weights] + [weights[7] / np.linalg.norm(weights[7])] * 40
    mark = np.zeros(size, bool)
    mark[[45, 46, 80, 200]] = True
    index = toxicity.BlockMax(size, in_parts(texts, weights), np.zeros(640), mark)
    dense = np.zeros((640, size))
    for i, (t, w) in enumerate(zip(texts, weights)):
        dense[i, t] = w
    asked = list(range(0, 640, 5)) + [7]
    edge = np.concatenate([[0], np.cumsum([len(texts[i]) for i in asked])])
    got = list(index.search(edge, np.concatenate([texts[i] for i in asked]), np.concatenate([weights[i] for i in asked]), 15))
    for i, (found, cosine, vote) in zip(asked, got):
        full = dense @ dense[i]
        norms = np.linalg.norm(dense[:, mark], axis=1) * np.linalg.norm(dense[i, mark])
        marked = np.divide(dense[:, mark] @ dense[i, mark], norms, out=np.zeros(640), where=norms > 0)
        best = [j for j in np.lexsort((np.arange(640), -np.round(full, 6)))[:15] if full[j] > 0]
        assert found[: len(best)].tolist() == best and np.allclose(cosine, full[found], atol=1e-5)
        more = [j for j in np.lexsort((np.arange(640), -np.round(marked, 6)))[:15] if marked[j] > 0 and j not in best]
        assert sorted(found[len(best) :].tolist()) == sorted(more)
        if mark[texts[i]].any():
            assert np.allclose(vote, full[found] + marked[found], atol=1e-5)
    assert 0 < index.visited < 0.9 * index.all


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(2)
    names = [f"w{i}" for i in range(300)]
    bad = ["stupid", "scum", "lowei"]
    rows = [(i, " ".join(rng.choice(names, 40)) + (f" {bad[i % 3]}{'ab' if i % 3 == 2 else ''}{i % 7 if i % 3 == 2 else ''}." if i % 4 == 0 else "")) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(9999, None)], "doc_id long, toxic int")
    docs = frame(spark, rows + [(5000, None), (5001, ""), (None, "stupid scum"), (5002, "stupid " * 30000)])
    got = toxicity.score(docs, labels, lattice.part("doc_id", 5) != 0).collect()
    score = {r.id: r.score for r in got}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all((score[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert score[5000] == score[5001] < 0.5 <= min(score[None], score[5002])
    assert all(not {n.example for n in r.neighbours} & set(held) for r in got)
    none = toxicity.score(docs, labels.limit(0), F.lit(True)).collect()
    assert {r.score for r in none} == {0.0} and toxicity.score(frame(spark, []), labels, F.lit(True)).count() == 0


def test_toxicity_indexes_all_terms(spark, monkeypatch):
    """Neighbours are those of the TF-IDF cosine of whole texts, also of texts without a term that marks toxic ones."""
    monkeypatch.setattr(toxicity, "PART", 40)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 30) % 400) + (" scum" if i % 4 == 0 else "")) for i in range(200)]
    rows += [(900, rows[1][1] + " once"), (901, "onlyhere w1"), (902, "onlyhere w2")]
    learn = (F.col("doc_id") < 150) | (F.col("doc_id") == 901)
    labels = spark.createDataFrame([(i, int(i % 4 == 0 or i == 901)) for i, _ in rows], "doc_id long, toxic int")
    got = {r.id: r.neighbours for r in toxicity.score(frame(spark, rows), labels, learn).collect()}
    bag = {}
    for i, t in rows:
        bag[i] = {}
        for w in words(t):
            for x in [(0, w)] + [(n, w[:n]) for n in toxicity.STEMS if len(w) > n]:
                bag[i][x] = bag[i].get(x, 0) + 1
    known = [i for i in bag if i < 150 or i == 901]
    vocabulary = {x for i in known for x in bag[i]}
    df = {x: sum(x in b for b in bag.values()) for x in vocabulary}
    unit = {}
    for i, b in bag.items():
        v = {x: (1 + math.log(c)) * (math.log((1 + len(rows)) / (1 + df[x])) + 1) for x, c in b.items() if x in vocabulary}
        norm = math.sqrt(sum(y * y for y in v.values()))
        unit[i] = {x: y / norm for x, y in v.items()}
    for i in bag:
        cosine = {e: sum(y * unit[e].get(x, 0.0) for x, y in unit[i].items()) for e in known}
        assert all(abs(cosine[n.example] - n.cosine) < 1e-6 for n in got[i])
        want = sorted((c for c in cosine.values() if c > 0), reverse=True)[:15]
        assert np.allclose([n.cosine for n in got[i]][: len(want)], want, atol=1e-6)
    assert got[900][0].example == 1 and got[902][0].example == 901


def test_op6_over_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op6_toxic_neighbours"](spark, sf).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    clean = [a for a, b in held if b == 0]
    assert sum(clean) <= 0.03 * len(clean)
