import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aislemetrics.llm import divergence as D
from aislemetrics.llm.common import LOWER, UPPER, table
from aislemetrics.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def terms(text):
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(str.maketrans(UPPER, LOWER)))


def brute(rows, least_docs, top):
    """(lang, source, text) rows; no block, no tree."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = terms(text)
        docs[lang].update(set(found))
        count[lang, source].update(found)
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        v, mine = len(kept), {s: c for (g, s), c in count.items() if g == lang}

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept}

        p = {s: shares(c) for s, c in mine.items()}
        q = shares(sum(mine.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in mine:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in mine if o != s))
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if mine[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pair), ("term", term)):
                out += [(lang, s, part, i.decode(), -x, k + 1) for k, (x, i) in enumerate(found)]
    return sorted(out)


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 20), st.integers(1, 20), st.integers(0, 70), st.sampled_from([0.03, 0.3, 1.0]), st.sampled_from([1, 64, 1 << 17]), st.integers(0, 9))
def test_joint_traversal_is_the_full_sum(na, nb, width, share, frontier, seed):
    rng, before = np.random.default_rng(seed), D.FRONTIER
    sides, full = [], []
    for n in (na, nb):
        zero = rng.integers(1, 60, n)
        p = np.repeat(zero[:, None], width, 1)
        some = rng.random((n, width)) < share
        p[some] = rng.integers(1, 10**9 + 2, some.sum())
        row, column = np.nonzero(some)
        sides.append(D.Side(row, column, p[row, column], zero))
        full.append(p)
    a, b = full[0][:, None], full[1][None]
    try:
        D.FRONTIER = frontier
        assert (D.joint_values(*sides, width) == ((a - b) ** 2 // (a + b)).sum(-1)).all()
    finally:
        D.FRONTIER = before


ROWS = [
    ("en", "a", "One two THREE three"), ("en", "a", "one two"), ("en", "b", "One; two\tfouré É"), ("en", "c", ""), ("en", None, None),
    ("en", "b", "one's x1y2z"), ("en", "b", "one's x1y2z"), (None, "a", "one one"), (None, "b", "two"), ("de", "only", "über über"), ("fr", "a", "rare"),
    ("fr", "b", ""), ("en", "d", "w" * 100_000 + " two " + "one " * 50_000), ("en", "Zé", "one two \U0001f600"), ("en", "\U0001f600", "two"),
]


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("rows_of_a_block, cell", [(128, 1 << 18), (2, 3)])
def test_against_brute_force(spark, monkeypatch, rows_of_a_block, cell):
    monkeypatch.setattr(D, "ROWS", rows_of_a_block)
    monkeypatch.setattr(D, "CELL", cell)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "doc_id long, lang string, source string, text string")
    docs = docs.selectExpr("*", "1 as term", "'x' as item", "2 as n", "3 as p0", "4 as group_id").repartition(3)
    assert got(D.audit(docs, least_docs=2, top_terms=2)) == brute(ROWS, 2, 2)


def test_partial_counts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(D, "FLUSH", 0)
    docs = spark.createDataFrame(ROWS, "lang string, source string, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert got(D.audit(docs, 2, 2)) == brute(ROWS, 2, 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query_against_sql_and_brute_force(spark):
    from workload.compare import connect

    rows = [tuple(r) for r in table(spark, FOLDER, "documents").select("lang", "source", "text").collect()]
    mine = got(QUERIES["op11_source_divergence"](spark, FOLDER))
    assert mine == brute(rows, 10, 10)
    sql = connect(FOLDER).execute(f"select lang, source, part, item, value, rank from ({ORACLE_SQL['op11_source_divergence']})").fetchall()
    assert sorted(sql) == mine


def test_texts_without_terms_and_empty_table(spark):
    docs = spark.createDataFrame([("en", "a", None), ("en", "b", ""), ("en", "c", "1 2 3")], "lang string, source string, text string")
    assert got(D.audit(docs)) == brute([tuple(r) for r in docs.collect()], 10, 10)
    assert {r[4] for r in got(D.audit(docs))} == {0}
    assert D.audit(docs.limit(0)).count() == 0


def test_slices_that_order_the_groups_differently(spark, monkeypatch):
    # each source is busiest in other columns, so the slices of a block put its groups in different orders
    monkeypatch.setattr(D, "CELL", 40)
    words = [chr(97 + i) * 3 for i in range(26)]
    rows = [("en", f"s{k}", " ".join(words[(5 * k + j) % 26] for j in range(4 + 3 * k))) for k in range(6) for _ in range(2)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert got(D.audit(docs, 2, 2)) == brute(rows, 2, 2)
