import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from aislemetrics.llm import exact_dedup as X
from aislemetrics.llm.common import LOWER, UPPER


@settings(deadline=None, max_examples=50)
@given(st.binary(max_size=300), st.integers(0, 300))
def test_hashes_compose(data, at):
    a, b = data[:at], data[at:]
    assert X.combine(X.fingerprint(a), X.fingerprint(b), len(b)) == X.fingerprint(data)


def test_long_text_composes():
    data = bytes(range(256)) * 1000
    x, (p, _) = X.BASES[0], X.PRIMES
    h = 0
    for c in data:
        h = (h * x + c) % p
    assert X.fingerprint(data)[0] == h


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(str.maketrans(UPPER, LOWER))].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


ROWS = [
    (1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200_000), (8, "X" * 200_000),
    (9, "x" * 199_999 + "y"), (10, "solo"), (None, "abc"), (10, "solo"), *[(100 + i, "Copy of one text") for i in range(300)],
]


def check(df):
    rows = df.collect()
    got = sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows], key=str)
    assert got == brute(ROWS)
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({r.text_sha256 for r in rows}) and all(r.doc_id == r.keep_id for r in kept)


def test_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    docs = docs.selectExpr("*", "1 as row", "'a' as data", "2 as fp", "3 as size")
    check(X.exact_groups(docs.repartition(3)))


def test_colliding_fingerprints_are_told_apart(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    check(X.exact_groups(docs, primes=(3, 2)))


def test_equal_rows_make_no_pairs(spark):
    """Equal texts under one id, or under none, meet one representative each."""
    docs = spark.createDataFrame([(7, "same")] * 300 + [(None, "none")] * 300, "doc_id long, text string")
    marked = docs.withColumn("fp", X._marks(X.PRIMES)("text"))
    groups = marked.groupBy("fp.h1", "fp.h2", "fp.n").agg(X.F.count("*").alias("size"), X.F.max("doc_id").alias("rep_id"))
    pairs = X._compared(marked, groups, ["h1", "h2", "n"])
    assert [r.same for r in pairs.collect()] == [True, True]
    got = X.exact_groups(docs).groupBy("group_size", "kept").count().collect()
    assert sorted(tuple(r) for r in got) == [(300, False, 598), (300, True, 2)]


def test_rows_that_stay(spark):
    docs = spark.createDataFrame([*ROWS, (None, "q"), (None, "r")], "doc_id long, text string").selectExpr("*", "'a' as lang")
    left = X.without_copies(docs)
    assert left.columns == docs.columns
    low = [(r.text or "").translate(str.maketrans(UPPER, LOWER)) for r in left.collect()]
    assert len(low) == len(set(low)) == len({(t or "").translate(str.maketrans(UPPER, LOWER)) for _, t in ROWS}) + 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert X.exact_groups(docs).count() == 0
