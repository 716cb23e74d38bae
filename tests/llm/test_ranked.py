"""Ranked search, importance resampling and subword embeddings against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tests.llm.helpers import AWKWARD, DOCS, frame
from windowlab.llm import lattice, queries, resampling, search, subwords
from windowlab.llm.store import table

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("id", T.StringType())])


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fold(text))


def plain_search(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, ws in wanted.items():
        found = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in ws if w in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


DOCUMENTS = AWKWARD + [(20 + i, f"shared word{i % 3} Tie {'rare' if i == 4 else ''} " * (1 + i % 2)) for i in range(9)] + [(None, "shared word1"), (3, "tie, tie; tie"), (3, "tie, tie; tie"), (77, "ÉA é_a x-y")]
TESTS = [(1, "Shared word1 word1 rare"), (2, None), (3, ""), (4, "nowhere"), (5, "TIE one"), (5, "two"), (None, "line é x"), (7, "word"), (8, "tie one two shared word0")]


@pytest.mark.parametrize("k,block_terms,tile", [(50, 100_000, 2048), (3, 2, 1), (1, 4, 2048)])
def test_search(spark, monkeypatch, k, block_terms, tile):
    monkeypatch.setattr(search, "TERM_TILE", tile)
    monkeypatch.setattr(search, "ITEM_COLUMNS", 2 if tile == 1 else 256)
    monkeypatch.setattr(search, "DOC_ROWS", 4)
    items = spark.createDataFrame([(i, t, "x", "y") for i, t in TESTS], ITEMS)
    got = search.search(frame(spark, DOCUMENTS).repartition(3), items, k=k, block_terms=block_terms)
    assert Counter((r.item, r["rank"], r.id, r.score) for r in got.collect()) == plain_search(DOCUMENTS, TESTS, k)


def test_search_empty(spark):
    items = spark.createDataFrame([(i, t, "x", "y") for i, t in TESTS], ITEMS)
    assert search.search(frame(spark, []), items).count() == 0
    assert search.search(frame(spark, DOCUMENTS), items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        search.search(frame(spark, DOCUMENTS), items, item_col="id")


def test_tiles_stay_exact():
    block = search.Block([{"item": k, "terms": [f"t{j}" for j in range(k, k + 40)]} for k in range(300)])
    weight = np.full(len(block.codes), 1 << 30, np.int64)
    seen = set()
    for first, columns, cuts in search.tiles(block, weight):
        for own, place, column in cuts:
            assert len(own) * search.IMPACT_BOUND * int(weight.max()) < 1 << 53
            pairs = set(zip((column + first).tolist(), own[place].tolist()))
            assert not pairs & seen
            seen |= pairs
    assert seen == set(zip(block.column.tolist(), block.term.tolist()))
    # all hashes of a text are those of its words, wherever they stand
    assert len({int(c) for c in search.term_codes(np.frombuffer(b"Ab,ab ab.AB", np.uint8), np.array([0, 11]))[1]}) == 1


def plain_resample(docs, target, share, grams, least=20):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
        return w, [" ".join(w[i : i + g]) for g in range(1, grams + 1) for i in range(len(w) - g + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % 10000

    made = [(i, *features(t)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in made for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for i, w, fs in made:
        weight = sum(math.floor(1000 * math.log((t[bucket(f)] + 1) * (n_s + 10000) / ((s[bucket(f)] + 1) * (n_t + 10000)))) for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    chosen = able[: share * len(able) // 100]
    ranks = Counter()
    for k, r in enumerate(chosen, 1):
        ranks[(*r, k)] += 1
    rest = Counter(tuple(r) for r in out) - Counter(tuple(r) for r in chosen)
    return ranks + Counter({(*r, None): n for r, n in rest.items()})


SAID = [(100 + i, f"alpha beta {'gamma delta ' * (i % 4)}" + "filler " * (18 + i % 5)) for i in range(40)] + [(500, "Same row " * 12)] * 7 + [(None, "no id here " * 9)] * 3 + [(600 + i, "x " * 30) for i in range(5)]


@pytest.mark.parametrize("share,grams", [(10, 1), (50, 1), (87, 2), (100, 3), (0, 1)])
def test_resample(spark, share, grams):
    docs = AWKWARD + SAID
    target = ["Gamma delta", None, "", "alpha-beta gamma1"]
    items = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(target)], ITEMS)
    got = resampling.resample(frame(spark, docs).repartition(5), items, share=share, grams=grams).collect()
    want = plain_resample(docs, target, share, grams)
    # rows of one id and score are told apart by their row number alone
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], r[5] is None, r[5] or 0)
    assert sorted(((r.id, r.words, r.features, r.weight, r.score, r["rank"]) for r in got), key=key) == sorted(want.elements(), key=key)


def test_resample_empty(spark):
    assert resampling.resample(frame(spark, []), frame(spark, SAID)).count() == 0
    alone = resampling.resample(frame(spark, SAID), frame(spark, []))
    assert alone.count() == len(SAID) and alone.filter("rank is not null").count() == len(SAID) // 10


def test_cutoff_settles_any_integers(spark):
    values = [-(1 << 63), (1 << 63) - 1, 0, 0, 0, 5, -7, 1 << 40]
    rows = spark.createDataFrame([(v,) for v in values], "key bigint")
    down = sorted(values, reverse=True)
    for wanted in range(1, len(values) + 1):
        assert resampling.cutoff(rows, "key", wanted) == (down[wanted - 1], sum(v > down[wanted - 1] for v in values))


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 7)
    text = ("Ab c1d " + "x" * 700 + " é,,z ") * 5
    want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
    for grams in (1, 2, 3):
        got = Counter(f.decode() for part in resampling.runs(text.encode(), grams) for f in part)
        assert got == Counter(" ".join(want[i : i + g]) for g in range(1, grams + 1) for i in range(len(want) - g + 1))


def plain_features(text):
    """Features of one text as strings."""
    text = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "")
    words = [w for w in text.split(" ") if w]
    out = [("w", w) for w in words] + [("p", a, b) if a != b else ("p", "same") for a, b in zip(words, words[1:])]
    for n in subwords.GRAMS:
        for w in words:
            padded = f" {w} "
            out += [(n, padded[i : i + n]) for i in range(len(padded) - n + 1)]
    return out


def test_features_are_those_of_each_text():
    import pyarrow as pa

    texts = [t for _, t in AWKWARD] + ["aa aa", "Aa bb", "", "漢字 𝔘x 漢字", "a", " ab ", "ab cd ab"]
    at = {}
    rows, ids = (np.concatenate(x) for x in zip(*subwords.features(*subwords.code_points(pa.array(texts)))))
    for k, t in enumerate(texts):
        want = Counter(plain_features(t))
        got = Counter(ids[rows == k].tolist())
        assert sum(got.values()) == sum(want.values())
        # equal features share a bucket in all texts, whatever stands around them
        alone = [a.tolist() for a in (np.concatenate([i for _, i in subwords.features(*subwords.code_points(pa.array([t])))]),)][0]
        assert Counter(alone) == got
        at[t] = got
    assert len(at["aa aa"]) < sum(at["aa aa"].values())


def test_training_learns_a_planted_mark(spark):
    docs = [(i, ("plain words and more of them " if i % 3 else "plain words*** and*** more of them ") * (1 + i % 4)) for i in range(300)] + AWKWARD[:3] + [(None, "x")]
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(300)] + [(None, 0), (5, None)], "doc_id bigint, quality int")
    learn = F.col("doc_id") % 2 == 0
    model = subwords.fit(frame(spark, docs), labels, learn, rounds=3)
    made = subwords.score(frame(spark, docs), model).collect()
    assert len(made) == len(docs) and all(0 <= r.score <= 1 for r in made)
    said = [r for r in made if r.id is not None and r.id > 12]
    assert np.mean([(r.score >= 0.5) == bool(r.id % 3) for r in said]) > 0.97
    same = {r.score for r in made if r.features == 0}
    assert len(same) == 1
    # softmax over the mean vector and summed contributions are the same number
    import pyarrow as pa

    ids = np.concatenate([i for _, i in subwords.features(*subwords.code_points(pa.array([docs[7][1]])))])
    _, p = model.probabilities(*(lambda u, n: (u, (n / n.sum()).astype(np.float32)))(*np.unique(ids, return_counts=True)))
    assert abs(p[1] - next(r.score for r in made if r.id == 7)) < 1e-4
    again = subwords.fit(frame(spark, docs).repartition(7), labels, learn, rounds=3)
    assert np.array_equal(again.vectors, model.vectors)
    assert {r.score for r in subwords.score(frame(spark, docs), subwords.fit(frame(spark, docs), labels.limit(0), learn)).collect()} == {0.5}
    assert subwords.score(frame(spark, []), model).count() == 0


def test_one_id_with_many_rows_is_one_example(spark):
    rows = [(1, "good text")] * 50 + [(2, "bad### text###"), (3, None)]
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1)], "doc_id bigint, quality int")
    stored = subwords.sampled(frame(spark, rows), labels, F.lit(True), "doc_id", "text", "quality", 10)
    assert stored.count() == 3
    assert subwords.sampled(frame(spark, rows), labels, F.lit(True), "doc_id", "text", "quality", 2).count() == 2


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    made = queries.QUERIES["op13_quality_embeddings"](spark, sf)
    both = made.filter("held_out").join(table(spark, sf, "labels"), "doc_id").select("score", "predicted", "quality").toPandas()
    y, s = both["quality"].to_numpy(), both["score"].to_numpy()
    assert np.mean(s[y == 1]) - np.mean(s[y == 0]) > 0.3
    assert np.mean(both["predicted"].to_numpy() == y) > np.mean(y)
