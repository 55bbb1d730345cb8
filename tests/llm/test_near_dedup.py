import random

import numpy as np
import pytest

from aislemetrics.llm import near_dedup as M
from aislemetrics.llm.common import LOWER, UPPER, by_key, components


def shingle_set(text, size):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER))) if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent):
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), k), k)
    return sorted((k, len(sets[i]), low[find(i)]) for i, (k, _) in enumerate(rows))


def corpus(n=25, seed=3):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows, key = [], 0
    for _ in range(n):
        base = rng.choices(vocabulary, k=rng.choice([2, 3, 40, 120, 400]))
        for _ in range(rng.choice([1, 2, 8])):
            words = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            rows.append((key := key + rng.randint(1, 9), rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(key + 1, None), (key + 2, ""), (key + 3, " \t"), (key + 4, "one"), (key + 5, "ONE"), (key + 6, " "), (key + 7, "a b")]
    rows += [(key + 10 + i, "many copies of one text that is all the same") for i in range(150)]
    base = rng.choices(vocabulary, k=300)
    for i in range(150):
        words = list(base)
        words[i % 300] = "z%d" % i
        rows.append((key + 1000 + i, " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,percent,block,block_bytes", [(3, 85, M.BLOCK, M.BLOCK_BYTES), (5, 80, 40, M.BLOCK_BYTES), (5, 80, M.BLOCK, 100_000)])
def test_against_brute_force(spark, monkeypatch, size, percent, block, block_bytes):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "BLOCK_BYTES", block_bytes)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as family", "2 as n", "'x' as sig")
    got = M.near_groups(docs.repartition(3), size=size, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = M.one_of_each(docs, size=size, percent=percent)
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in got if r.kept) and left.columns == docs.columns


def test_nulls_and_repeated_ids(spark):
    long = " ".join("t%d" % i for i in range(60))
    rows = [(None, long), (1, long), (1, long), (2, long + " x"), (None, None), (3, "other words here and there")]
    got = M.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got) == [
        ("1", 1, True), ("1", 1, True), ("2", 1, False), ("3", 3, True), ("None", None, True), ("None", None, True)]


def test_empty(spark):
    assert M.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    y = np.concatenate([x[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    share = (M.signature(x) == M.signature(y)).mean()
    assert abs(share - 800 / 1200) < 0.09


def test_pruning_bound():
    least = M.least_matches(0.85, 1e-6, 10, 32)
    assert least == sorted(least) and least[0] > 0
    rng = np.random.default_rng(2)
    hits = np.cumsum((rng.random((20000, 320)) < 0.85).reshape(20000, 10, 32).sum(axis=2), axis=1)
    assert ((hits < least).any(axis=1)).mean() < 1e-3


def test_groups_that_span_batches():
    import pandas as pd

    rows = pd.DataFrame({"a": [1, 1, 1, 1, 1, 2, 3, 3, 3], "b": [0, 0, 0, 0, 1, 1, 1, 1, 1], "c": range(9)})
    for size in (1, 2, 3, 9):
        batches = [rows.iloc[:0], *[rows.iloc[i : i + size] for i in range(0, 9, size)]]
        got = [g["c"].tolist() for g in by_key(iter(batches), ["a", "b"])]
        assert got == [[0, 1, 2, 3], [4], [5], [6, 7, 8]]


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (11, 12), (7, 7), (20, 22), (21, 22), (1, 30)]
    chain = [(100 + i, 101 + i) for i in range(40)]
    got = components(spark.createDataFrame([*edges, *chain, (None, 3)], "a long, b long"))
    want = {i: 1 for i in (1, 2, 3, 4, 5, 30)} | {i: 10 for i in (10, 11, 12)} | {i: 20 for i in (20, 21, 22)} | {100 + i: 100 for i in range(41)}
    assert {r.id: r.root for r in got.collect()} == want


@pytest.mark.parametrize("percent", [1, 30, 50, 80, 82, 85, 95])
def test_bands_follow_the_threshold(percent):
    bands, rows = M.layout(percent, M.MISS)
    assert (1 - (percent / 100) ** rows) ** bands <= M.MISS
    assert M.width(bands, rows) >= bands * rows and M.width(bands, rows) % M.BATCH == 0
    rng = np.random.default_rng(percent)
    sig = rng.integers(0, 1 << 32, (2, M.width(bands, rows)), np.uint32)
    assert len(M.band_keys(sig[0], bands, rows)) == bands and not (M.band_keys(sig[0], bands, rows) == M.band_keys(sig[1], bands, rows)).any()
