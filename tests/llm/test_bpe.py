import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from aislemetrics.llm import bpe as B
from aislemetrics.llm.common import table
from aislemetrics.llm.queries import QUERIES

NAME = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def ranks():
    return B.read_ranks(P.path(NAME))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def machine(ranks):
    return B.Transducer(ranks, P.PATTERN)


PIECES = st.lists(st.sampled_from(["the", "tion", "ing", " ", "é", "ß", "\n", "1", "99", "!!", "日本", "🙂", "'s", "a", "aa", "er", " ", "\x1c", " "]), max_size=30)


@settings(deadline=None, max_examples=400)
@given(st.one_of(st.text(max_size=60), PIECES.map("".join), st.text(alphabet="aeinorst", max_size=200)))
def test_same_ids_as_the_library(machine, reference, text):
    assert machine.encode(text) == reference.encode_ordinary(text)


def test_long_pieces(machine, reference):
    rng = np.random.default_rng(5)
    for letters in ("a", "ab", "aeinorst", "éèß日本ñ", "thonig"):
        text = "".join(rng.choice(list(letters), 3000))
        assert machine.encode(text) == reference.encode_ordinary(text)
    for text in (" " * 1000 + "x", "=" * 999, "\n" * 777, "ha" * 500):
        assert machine.encode(text) == reference.encode_ordinary(text)


def test_lookahead_is_bounded(machine, ranks):
    machine.encode("aeinorst" * 500)
    longest = max(map(len, ranks))
    assert max(len(held) for held, _, _ in machine.states) <= 2 * longest


def test_spines_agree_with_merging(machine, ranks):
    rng = np.random.default_rng(8)
    names = sorted(ranks)
    picks = [names[i] for i in rng.integers(0, len(names), 6000)] + [t for t in names if len(t) <= 2][::7]
    rng.shuffle(picks)
    for a, b in zip(picks, picks[1:]):
        if machine._spines(a) is not None and machine._spines(b) is not None:
            assert machine._stays(a, b) == (machine._merges(a + b)[0] == [a, b])


def test_bounded_memories(ranks, reference, monkeypatch):
    monkeypatch.setattr(B, "STATES", 50)
    monkeypatch.setattr(B, "PIECES", 20)
    small = B.Transducer(ranks, P.PATTERN)
    for text in ("Thereafter the antidisestablishmentarian said nothing", "Überschwemmungsgebiete, naïveté", "zqxjkvw" * 30):
        assert small.encode(text) == reference.encode_ordinary(text)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 50255), max_size=80), st.lists(st.integers(1, 7), min_size=1, max_size=5))
def test_stream_decoder(ranks, ids, steps):
    tokens = [b""] * len(ranks)
    for t, k in ranks.items():
        tokens[k] = t
    machine = test_stream_decoder.__dict__.setdefault("machine", B.StreamDecoder(tokens))
    out, at, k = [], 0, 0
    while at < len(ids):
        n = steps[k % len(steps)]
        out.append(machine.feed(np.array(ids[at : at + n], np.int64)))
        at, k = at + n, k + 1
    out.append(machine.finish())
    whole = b"".join(tokens[i] for i in ids)
    assert b"".join(out) == whole
    assert "".join(x.decode("utf-8", "replace") for x in out) == whole.decode("utf-8", "replace")


def test_decoder_waits_for_whole_characters():
    machine = B.StreamDecoder([b"\xe6", b"\x97", b"\xa5", b"a", b"a\xf0", b"\x9f\x99", b"\x82!"])
    assert [machine.feed(np.array([i])) for i in (0, 1, 2, 3, 4, 5, 6)] == [b"", b"", "日".encode(), b"a", b"a", b"", "🙂!".encode()]


def digests(reference, text):
    ids = reference.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_on_whole_table(spark, reference):
    rows = QUERIES["op2_bpe_round_trip"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {k: digests(reference, t) for k, t in texts.items()}


def test_odd_rows(spark, reference):
    rows = [(1, None), (1, ""), (None, "x y"), (2, "long " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids_", "2 as n")
    got = B.round_trip(docs, P.path(NAME), P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t in rows)
    assert sorted(len(r.ids) for r in got) == sorted(len(reference.encode_ordinary(t or "")) for _, t in rows)
    assert B.round_trip(docs.limit(0), P.path(NAME), P.PATTERN).count() == 0
