import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislemetrics.llm import lm as L
from aislemetrics.llm.common import LOWER, UPPER, table
from aislemetrics.llm.queries import QUERIES


def tokens(text):
    low = (text or "").translate(str.maketrans(UPPER, LOWER))
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None]


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10 == 0


def brute(rows):
    counts = Counter(t for k, x in rows if not held(k) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    out = []
    for k, x in rows:
        t = tokens(x)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        out.append((k, held(k), len(t), sum(counts[w] > 0 for w in t), n, base))
    return out


def compare(got, rows):
    want = sorted(brute(rows), key=str)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("frequent", [10, 200_000])
def test_base_against_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(L, "FREQUENT", frequent)
    rng = random.Random(1)
    words = ["W%d" % int(rng.paretovariate(0.6)) for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(120)]
    rows += [(None, "w1 w2"), (5, "W1\tw1\nw2"), (5, "W1\tw1\nw2"), (700, None), (701, ""), (702, " \x0b "), (703, "É é \x1c \xa0 x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as word")
    got = L.scored(docs.repartition(3)).collect()
    compare(got, rows)
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    got = QUERIES["op6_log_bloom_lm"](spark, folder).collect()
    compare(got, rows)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # neighbours help on held-out text


def test_no_training_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = L.scored(docs, held_out=F.lit(True)).collect()
    assert [(r.train_tokens, r.n_known) for r in got] == [(0, 0)] * 2 and all(abs(r.base_score) < 1e-9 for r in got)
    assert L.scored(docs.limit(0)).count() == 0


def test_filter_holds_quantised_counts():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 40, 60_000))
    counts = np.ceil(rng.pareto(1.0, len(keys)) + 1e-9).astype(np.int64)
    levels = L.level_of(counts)
    bits = int(levels.sum()) * L.BITS_EACH // L.SEGMENTS // 8 * 8
    data = np.zeros((L.SEGMENTS, bits // 8), np.uint8)
    place = L.segment_of(keys)
    for i in range(L.SEGMENTS):
        data[i] = np.frombuffer(L.segment_bits(keys[place == i], levels[place == i], bits), np.uint8)
    read = L.LogFilter(data)
    got = read.levels(keys)
    assert (got >= levels).all() and (got > levels).mean() < 0.02
    other = rng.integers(1 << 41, 1 << 42, 50_000)
    assert (read.levels(other) > 0).mean() < 0.02


def test_levels():
    assert L.level_of([1, 2, 3, 4, 7, 8]).tolist() == [1, 2, 2, 3, 3, 4]
    assert L.count_at([0, 1, 2, 3]).tolist() == [0.0, 1.0, 3.0, 6.0]


def test_filter_stays_within_its_bound(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_BITS", 1 << 20)
    pairs = spark.range(60_000).selectExpr("id as key", "1 + id % 5 as n")
    built = L._filter_of(pairs)
    assert built.data.size * 8 <= (1 << 20) + L.SEGMENTS * 1024
    keys = np.arange(60_000)
    assert (built.levels(keys[keys % 5 == 4]) >= 3).all()


@pytest.mark.parametrize("frequent,bits", [(200_000, 1 << 10), (40, 1 << 10), (40, 1 << 27), (200_000, 1 << 15)])
def test_score_reads_every_pair(spark, monkeypatch, frequent, bits):
    monkeypatch.setattr(L, "FREQUENT", frequent)
    monkeypatch.setattr(L, "MOST_BITS", bits)
    rng = random.Random(5)
    words = ["w%d" % int(rng.paretovariate(0.8)) for _ in range(600)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 80)))) for i in range(150)] + [(700, None), (7, "never met w1 w1 w1")]
    ones, twos = Counter(), Counter()
    for k, x in rows:
        if not held(k):
            t = tokens(x)
            ones.update(t)
            twos.update(zip([None, *t], t))
    norm = sum(ones.values()) + 0.1 * (len(ones) + 1)

    read = {pair: float(L.count_at(L.level_of(n))) for pair, n in twos.items()}
    follow = Counter()
    for (v, _), n in read.items():
        follow[v] += n

    def p(v, w):
        single = (ones[w] + 0.1) / norm
        return L.WEIGHT * read.get((v, w), 0) / follow[v] + (1 - L.WEIGHT) * single if follow[v] else single

    def log(v, w):
        return math.log10(p(v, w))

    # the probabilities after any word, met or not, sum to 1 over the words and the class of others
    for v in [*list(ones)[:50], "not met"]:
        assert abs(sum(p(v, w) for w in [*ones, "not met"]) - 1) < 1e-9

    want = sorted((k, sum(log(v, w) for v, w in zip([None, *tokens(x)], tokens(x)))) for k, x in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.score) for r in L.scored(docs.repartition(3)).collect())
    far = np.array([g[1] - w[1] for g, w in zip(got, want)])
    assert [g[0] for g in got] == [w[0] for w in want] and (far > -1e-8).all()  # the filter never reads too little
    assert np.abs(far).max() < 1e-8 if bits == 1 << 10 else far.mean() < 0.5
