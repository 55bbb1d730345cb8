import re

from aislemetrics.llm import chat as C
from aislemetrics.llm.common import LOWER, UPPER, table
from aislemetrics.llm.queries import QUERIES


def norm(t):
    return re.sub(r"\s+", " ", t.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def keys(t):
    out = {(0, norm(t))} | {(1, norm(x)) for x in re.split(r"\n[ \t]*\n", t)} | {(2, norm(x)) for x in t.split("\n") if len(norm(x)) >= C.LINE}
    return {k for k in out if k[1]}


def split(text):
    text = re.sub("\r\n?", "\n", text or "")
    if not re.search(r"(?m)^[ \t]*>", text):
        return text.strip(), []
    lines, own, passages, last = text.split("\n"), [], [], 0
    level = [re.match(r"[ \t>]*", x).group().count(">") for x in lines] + [0]
    for i, x in enumerate(lines):
        if level[i]:
            bare = re.sub(r"^[ \t>]*", "", x).strip(" ")
            if level[i] == last:
                passages[-1][1].append(bare)
            else:
                passages.append((level[i], [bare]))
        elif not (level[i + 1] and re.search(C.INTRODUCES, x)):
            own.append(x)
        last = level[i]
    return "\n".join(own).strip(), [(k, "\n".join(p)) for k, p in passages]


def brute(rows):
    parts = [(c, t, r, *split(x)) for c, t, r, x in rows]
    reply = {}
    for c, t, _, _, passages in parts:
        if c is None or t is None:
            continue
        best = []
        for level, p in passages:
            for rank, h in keys(p):
                source = min((u for d, u, _, b, _ in parts if d == c and u is not None and b and h in {k[1] for k in keys(b)}), default=None)
                if source is not None and source < t:
                    best.append((level, rank, -source))
        if best:
            reply[c, t] = -min(best)[2]
    out = []
    for c, t, _, body, passages in parts:
        root, depth = t, 0
        while (c, root) in reply:
            root, depth = reply[c, root], depth + 1
        out.append((c, t, body, len(passages), reply.get((c, t)), root, depth))
    return sorted(out, key=str)


ROWS = [
    (1, 0, "user", "Hello there, how is the garden?\n\nAnd the weather in the north?"),
    (1, 1, "assistant", "> Hello there, how is the garden?\nThe garden is green."),
    (1, 2, "user", "On Monday someone wrote:\n> the GARDEN   is green.\n>> Hello there, how is the garden?\nGood to know."),
    (1, 3, "assistant", ">> The garden is green.\n> Good to know.\n  \nYes."),
    (1, 4, "user", "> unknown words\nNothing found."),
    (1, 5, "user", "> And the weather in the north?\r\nCold."),
    (1, 6, "user", "> Nothing found.\n> Cold.\nboth"),
    (1, 7, "user", "> both\nonly short line"),
    (2, 0, None, "> The garden is green.\nOther conversation."),
    (2, 0, "user", "repeated turn"),
    (2, 1, "user", "> repeated turn\nx"),
    (2, 2, "user", "> > nested with blanks\n> > here\ntext > not a quote"),
    (3, 0, "user", None), (3, 1, "user", ""), (3, 2, "user", ">"), (3, 3, "user", "> quotes itself, later words\nquotes itself, later words"),
    (None, 1, "user", "> repeated turn\nno conversation"), (4, None, "user", "> x\nno turn"),
    (6, 0, "user", ">" * 30_000 + " deep\nend"), (6, 1, "user", "long\n" * 20_000),
    *[(5, i, "user", (f"> message number {i - 1} of a chain\n" if i else "") + f"message number {i} of a chain") for i in range(40)],
]


def test_against_brute_force(spark):
    got = C.threads(spark.createDataFrame(ROWS, "conv_id int, turn int, role string, text string").selectExpr("*", "1 as body", "2 as root_turn")).collect()
    assert sorted([(r.conv_id, r.turn, r.body, r.n_quotes, r.reply_to, r.root_turn, r.depth) for r in got], key=str) == brute(ROWS)
    assert {(r.turn, r.reply_to) for r in got if r.conv_id == 1} == {(0, None), (1, 0), (2, 1), (3, 2), (4, None), (5, 0), (6, 4), (7, 6)}
    assert max(r.depth for r in got if r.conv_id == 5) == 39


def test_reply_order(spark):
    got = C.threads(spark.createDataFrame(ROWS, "conv_id int, turn int, role string, text string")).collect()
    order = [(r.root_turn, r.turn) for r in got if r.conv_id == 1]
    assert order == sorted(order)
    place = {r.turn: i for i, r in enumerate(r for r in got if r.conv_id == 1)}
    assert all(place[r.reply_to] < place[r.turn] for r in got if r.conv_id == 1 and r.reply_to is not None)


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op5_quotation_linking"](spark, folder)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted([(r.conv_id, r.turn, r.body, r.n_quotes, r.reply_to, r.root_turn, r.depth) for r in got.collect()], key=str) == brute(rows)


def test_empty_table(spark):
    assert C.threads(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).count() == 0
