import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aislemetrics.llm import suffixes as S


def brute(rows, length):
    """Spans of removed bytes of every row, from all strings of ``length`` bytes."""
    data = [(t or "").encode() for _, t in rows]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (key, _), d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((key, len(d), [tuple(x) for x in edges.reshape(-1, 2).tolist()], bytes(np.frombuffer(d, np.uint8)[~gone])))
    return sorted(out, key=str)


def result(df):
    return sorted([(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in df.collect()], key=str)


def corpus(length, seed):
    rng = random.Random(seed)

    def fresh(n, letters="abcdefghé"):
        return "".join(rng.choice(letters) for _ in range(n))

    passages = [fresh(rng.randint(length // 2, 3 * length)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(fresh(rng.randint(0, 2 * length)))
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
                parts.append(p if rng.random() < 0.5 else p[a:b])
        rows.append((i, "".join(parts)))
    rows += [(1000 + i, rows[7][1]) for i in range(5)] + [(2000, rows[8][1] + "z"), (2001, "z" + rows[8][1])]
    rows += [(3000, "a" * (4 * length)), (3001, "ab" * (2 * length)), (3002, "x" * length), (3003, None), (3004, ""), (None, rows[9][1]), (5, rows[5][1])]
    for i in range(90):  # one passage amid words of each document's own
        rows.append((4000 + i, fresh(length) + passages[0][: 2 * length] + fresh(length)))
    return rows


@pytest.mark.parametrize("length,hot,seed", [(24, 2000, 1), (24, 3, 2), (16, 30, 3), (400, 2000, 4)])
def test_against_brute_force(spark, length, hot, seed):
    rows = corpus(length, seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as a", "2 as h", "'x' as found")
    assert result(S.without_repeats(docs.repartition(3), length=length, hot=hot)) == brute(rows, length)


def test_blocks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 64)
    rng = np.random.default_rng(3)
    for seed in range(3):
        rows = [(i, "".join(rng.choice(list("abc"), 400))) for i in range(3)]
        rows.append((9, rows[0][1][100:300] + "".join(rng.choice(list("abc"), 200)) + rows[1][1][50:90]))
        found = [S.anchors_of(np.frombuffer(t.encode(), np.uint8), S.Plan(24)) for _, t in rows]
        assert all((a - f >= 0).all() and (f <= e).all() for a, f, e, _, _ in found)
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert result(S.without_repeats(docs, length=24)) == brute(rows, 24)


def test_empty_table(spark):
    assert S.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


STRINGS = st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=12)


@settings(deadline=None, max_examples=200)
@given(st.lists(STRINGS, max_size=7))
def test_loser_tree_merges_runs(runs):
    ordered = [sorted(r) for r in runs]
    tag = (1, 2, 3, 4, 5, True)
    coded = [S.decode_run(list(S.encode_run([(s, s[::-1], tag) for s in r]))) for r in ordered]
    got = list(S.merge_runs(coded))
    assert [g[1] for g in got] == sorted(s for r in runs for s in r)
    before = None
    for lcp, suffix, left, t in got:
        assert left == suffix[::-1] and t == tag
        assert before is None or lcp == S.common(before, suffix)
        before = suffix


@settings(deadline=None, max_examples=200)
@given(st.binary(max_size=200), st.binary(max_size=200), st.binary(max_size=150))
def test_common_prefix(a, b, head):
    x, y = head + a, head + b
    want = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert S.common(x, y) == S.common(x, y, min(want, len(head))) == want


def test_known_prefixes_are_not_compared_again(monkeypatch):
    seen, real = [], S.common

    def spy(a, b, start=0):
        out = real(a, b, start)
        seen.append(out - start)
        return out

    runs = [sorted(b"p" * 500 + bytes([97 + (i * 7 + k) % 26, 97 + k]) for i in range(20)) for k in range(8)]
    coded = [list(S.decode_run(list(S.encode_run([(s, b"", (1, 2, 3, 4, 5, True)) for s in r])))) for r in runs]
    monkeypatch.setattr(S, "common", spy)
    assert len(list(S.merge_runs([iter(c) for c in coded]))) == 160
    assert sum(seen) < 500 * 8 + 160 * 8  # the shared 500 bytes once for each run, not for each entry


def test_query_on_whole_table(spark):
    import hashlib

    from aislemetrics.llm.common import table
    from aislemetrics.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    got = QUERIES["op1_suffix_dedup"](spark, folder).collect()
    want = [(k, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for k, n, spans, kept in brute(rows, 400)]
    assert sorted(tuple(r) for r in got) == sorted(want) and any(w[2] for w in want)


def test_hot_cores_take_few_ranges(spark, monkeypatch):
    """Rows made for a passage in texts that differ around it: a few for each text, not one for each window."""
    rng, length = random.Random(8), 120
    passage = "".join(rng.choice("abcdefgh") for _ in range(90))

    def around(n):
        return "".join(rng.choice("ijklmnop") for _ in range(n))

    rows = [(i, around(200) + passage + around(200)) for i in range(300)]
    ends = ["same words before it " * 2, "same words behind it " * 2]
    rows += [(300 + i, around(80) + ends[0] + passage + around(80)) for i in range(3)]
    rows += [(310 + i, around(80) + passage + ends[1] + around(80)) for i in range(3)]
    rows += [(320 + i, around(80) + ends[0] + passage + ends[1] + around(i)) for i in range(2)]
    made, real = [], S.materialize

    def spy(df):
        out = real(df)
        if "outer_one" in out.columns and "first" not in out.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(S, "materialize", spy)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = S.Plan(length)
    assert result(S.without_repeats(docs, length=length, hot=2)) == brute(rows, length)
    assert made and sum(made) < 2 * len(rows) * (length - plan.core) / 10
