import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from aislemetrics.llm import trie as T
from aislemetrics.llm.common import table
from aislemetrics.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def seal(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    """(conv_id, turn, role, text) rows; every rebuilt conversation as a list of texts, nodes as prefixes."""
    told = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            told[c].append((turn is not None, turn or 0, seal(role or "", text or ""), role or "", text or ""))
    told = {c: [x[3:] for x in sorted(v)] for c, v in told.items()}
    whole = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(told.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        own = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = own + sum(saved[b] for b in below)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), up, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some_rows():
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["a b", "c", "a b c d"])) for c in range(130) for t in range(r.randint(1, 6))]
    rows += [(c, t, "user", f"same opening of many {t}") for c in range(200, 260) for t in range(5)]
    rows += [(c, t, "user" if t % 2 else "assistant", f"turn {t}") for c in (300, 301, 320) for t in range(300)]
    rows += [(-c, t, "user", f"below {t}") for c in range(1, 45) for t in range(r.randint(1, 4))]
    rows += [(400, None, "user", "null first"), (400, 0, None, "x"), (400, 0, "user", None), (400, 0, "user", None), (400, 1, "", "")]
    rows += [(401, 3, "user", "one"), (401, 3, "assistant", "one"), (401, 3, "ass", "istantone"), (None, 0, "user", "nobody"), (None, None, None, None)]
    rows += [(500 + c, 0, "user", "w " * 50_000) for c in range(3)] + [(521, 0, "user", "alone"), (522, 0, "user", "alone"), (2**40 + 7, 0, "user", "far")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return some_rows()


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 as depth", "'x' as conv", "2 as f0", "3 as part")


def got(df):
    return sorted([tuple(r) for r in df.select(*NAMES).collect()], key=str)


def test_against_brute_force(spark, rows):
    out = T.trie(frame(spark, rows).repartition(3))
    assert got(out) == brute(rows)
    assert {t for _, t in out.select(*NAMES[:-1]).dtypes} == {"bigint"}


def test_a_long_conversation_over_many_ranges(spark, rows):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        long = [(700, t, "user", f"part {t % 3}") for t in range(900)] + rows[:60]
        assert got(T.trie(frame(spark, long))) == brute(long)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_met_fingerprints_are_found_and_made_anew(spark, rows):
    tiny = ((5, 3, 2), (2, 2, 1))
    assert got(T.trie(frame(spark, rows), rings=(tiny, T.RINGS[1]))) == brute(rows)
    with pytest.raises(RuntimeError):
        T.trie(frame(spark, rows), rings=(tiny,))


def test_products_compose():
    p, x = 2147483647, 1318699777
    at = [0, 1, 4095, 4096, 5000, 123_456_789]
    assert T._powers(x, p, T.np.array(at)).tolist() == [pow(x, a, p) for a in at]


def test_query_against_sql_and_brute_force(spark):
    from workload.compare import connect

    rows = [tuple(r) for r in table(spark, FOLDER, "conversations").select("conv_id", "turn", "role", "text").collect()]
    mine = got(QUERIES["op12_conversation_trie"](spark, FOLDER))
    assert mine == brute(rows)
    sql = connect(FOLDER).execute(f"select {', '.join(NAMES)} from ({ORACLE_SQL['op12_conversation_trie']})").fetchall()
    assert sorted(sql, key=str) == mine


def test_only_null_texts_and_empty_table(spark):
    rows = [(c, t, None, None) for c in range(1, 30) for t in range(3)]
    assert got(T.trie(frame(spark, rows))) == brute(rows)
    turnless = [(c, 0, "user", "x") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    assert got(T.trie(frame(spark, turnless))) == brute(turnless)
    assert T.trie(frame(spark, rows).limit(0)).count() == 0
