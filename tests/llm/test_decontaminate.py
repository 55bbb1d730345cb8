import random

import pytest

from aislemetrics.llm import decontaminate as D
from aislemetrics.llm.common import table
from aislemetrics.llm.queries import QUERIES


def template(text):
    """Plain restatement: list of (template word, kind, value)."""
    out, fresh = [], True
    for word in (text or "").split():
        _, kind, value, capital, ends = D.template_word(word)
        if capital and not fresh:
            kind = "name"
        out.append((kind or value, kind, value))
        fresh = ends
    return out


def brute(docs, items, size=D.WINDOW, cover=D.COVER):
    found = set()
    for item, text in items:
        q = template(text)
        width = min(size, len(q))
        if not q or item is None:
            continue
        for doc, body in docs:
            d, hit = template(body), set()
            for diagonal in range(-len(q), len(d)):
                at = [
                    p for p in range(len(q) - width + 1)
                    if 0 <= p + diagonal <= len(d) - width and all(q[p + k][0] == d[p + diagonal + k][0] for k in range(width))
                ]
                words = {p + k for p in at for k in range(width)}
                pairs = {(*q[w][1:], d[w + diagonal][2]) for w in words if q[w][1]}
                if len(pairs) == len({p[:2] for p in pairs}):
                    hit |= words
            if doc is not None and len(hit) >= cover * len(q):
                found.add((doc, item))
    return found


WORDS = "apple river stone carry green window paper yellow bridge simple music garden silver copper yesterday many people walk".split()


def question(rng, numbers, name):
    body = rng.choices(WORDS, k=12)
    return body[:4] + [name, "buys", numbers[0], "kg"] + body[4:8] + ["and", numbers[1], "then", numbers[0], "again"] + body[8:]


def corpus():
    rng = random.Random(9)
    items = [(i, " ".join(question(random.Random(i), ["5", "17"], "Anna"))) for i in range(6)]
    items += [(50, "short item here"), (51, None), (52, ""), (None, "nothing to see in this one at all, really not"), (53, items[0][1])]
    docs = []

    def put(words):
        docs.append((len(docs), " ".join(rng.choices(WORDS, k=20) + words + rng.choices(WORDS, k=15))))

    for i in range(6):
        put(question(random.Random(i), ["5", "17"], "Anna"))
        put(question(random.Random(i), ["812", "3.5"], "Bernard"))  # other parameters
        bad = question(random.Random(i), ["812", "3.5"], "Bernard")
        bad[-6] = "999"  # the repeated number no longer agrees
        put(bad)
        put(question(random.Random(i), ["5", "17"], "Anna")[:9])
        put([])
    put("Short, ITEM here!".split())
    docs += [(900, None), (901, ""), (None, items[0][1]), (902, items[1][1].upper()), (902, "repeated id"), (903, items[1][1] + "\n" + items[2][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    assert {(1, 0), (0, 0), (0, 53), (903, 1), (903, 2)} <= want and (2, 0) not in want and len(want) > 12
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as pos", "2 as item", "'x' as hash")
    b = spark.createDataFrame(items, "item_id int, text string")
    for bytes_ in (D.BROADCAST_BYTES, 0):
        got = D.found_items(d, b, broadcast_bytes=bytes_).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)
    rows = D.marked(d, b).collect()
    assert len(rows) == len(docs)
    assert {(r.doc_id, i) for r in rows for i in r.item_ids} == want
    assert all(r.contaminated == bool(r.item_ids) and r.n_items == len(r.item_ids) for r in rows)
    left = D.clean(d, b)
    assert left.columns == d.columns
    leaked = {x for x, _ in want}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in docs if i not in leaked)


@pytest.mark.parametrize("docs,items", [([], []), ([], [(1, "a b c")]), ([(1, "a b c")], [])])
def test_empty_tables(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert [r.contaminated for r in D.marked(d, b).collect()] == [False] * len(docs)


def test_query_finds_all_passages(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, folder, "benchmark").collect()]
    rows = QUERIES["op10_template_decontamination"](spark, folder).collect()
    got = {(r.doc_id, i) for r in rows for i in r.item_ids}
    plain = {(d, i) for d, t in docs for i, q in items if q in t}
    assert len(rows) == len(docs) and plain and plain <= got
    few = sorted({d for d, _ in got} | {d for d, _ in docs[:40]})
    assert {x for x in got if x[0] in few} == brute([x for x in docs if x[0] in few], items)


def test_an_edited_place_costs_only_its_windows(spark):
    rng = random.Random(4)
    text = [w for _ in range(12) for w in (*rng.choices(WORDS, k=4), "5")]
    edited = list(text)
    edited[14] = "77"  # "5" elsewhere
    moved = ["812" if w == "5" else w for w in text]
    moved[34] = "999"  # one place against the mapping 5 -> 812
    torn = [str(100 + i) if w == "5" else w for i, w in enumerate(text)]  # no mapping at all
    docs = [(i, " ".join(rng.choices(WORDS, k=9) + w + rng.choices(WORDS, k=9))) for i, w in enumerate([text, edited, moved, torn])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(text))], "item_id int, text string")
    for bytes_ in (D.BROADCAST_BYTES, 0):
        got = {r.doc_id for r in D.found_items(d, b, broadcast_bytes=bytes_, cover=0.6).collect()}
        assert got == {0, 1, 2}
