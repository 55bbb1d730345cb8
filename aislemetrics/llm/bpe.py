"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Encoding. A sequence of tokens is what the merges produce exactly if every two neighbours stay apart
when their bytes are merged alone, and every prefix of a piece has one such sequence. The transducer
reads bytes. Its state is the bytes read since the last emitted token and the last token of each
prefix of them; where these bytes themselves are a token, it depends on the emitted one which of two
transitions is taken. A token is emitted once the sequences of all prefixes from which a longer token could
still start go through it, so the lookahead is bounded by the longest token. States and transitions
are made when first met and then looked up; pieces met before are looked up whole. Both memories have
fixed bounds and can be dropped at any time.

Decoding. Token bytes go through an incremental UTF-8 automaton that releases bytes at character
boundaries only; tokens that hold whole characters are passed over in one step.

Cases: null and empty texts have no ids and decode to no bytes. Null ids of a null array count as
none. Bytes that are no UTF-8 pass through unchanged. Other columns pass through, rows are never
joined, so repeated rows and ids need no rule. The vocabulary (fixed size) is broadcast.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATES = 250_000  # states kept before the transducer starts anew
PAIRS = 250_000  # pairs of tokens known to stay apart or not
PIECES = 120_000  # pieces whose ids are kept, and as many older ones
PORTION = 200  # texts handled at once
BLOCK = 4096  # ids given to the decoder at once


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file: base64 and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces_of = regex.compile(pattern).findall
        self.heads = {t[:i] for t in ranks for i in range(1, len(t))}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.grown: dict[bytes, object] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self._restart()

    def _restart(self) -> None:
        self.names: dict[tuple[bytes, tuple[int, ...]], int] = {}
        self.states: list[tuple[bytes, tuple[int, ...], tuple[int, ...]]] = []
        self.next: dict[int, int] = {}  # by (state * 256 + byte) * 4 + case; -1: two cases
        self.out: dict[int, tuple[tuple[int, ...], bytes]] = {}  # ids of transitions that emit, and the last token
        self.rest: dict[int, tuple[int, ...]] = {}
        self._state(b"", (), (0,))

    def _merges(self, data: bytes) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
        """The merges on a short string, one at a time: what is left, and the merged pairs in order."""
        parts, ranks, done = [data[i : i + 1] for i in range(len(data))], self.ranks, []
        while len(parts) > 1:
            low, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if low == 1 << 60:
                break
            done.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, done

    def _spines(self, token: bytes):
        """How a token grew at its ends: (part, rank of the token it went into), latest first.

        None if its own merges do not give the token; False if their ranks do not ascend, so that
        ranks do not tell the order of merges.
        """
        known = self.grown.get(token, 0)
        if known == 0:
            parts, done = self._merges(token)
            known = None
            if parts == [token]:
                ranks = [self.ranks[a + b] for a, b in done]
                known = False
                if ranks == sorted(ranks):
                    left, right, l, r = [(token, 1 << 60)], [(token, 1 << 60)], token, token
                    for a, b in reversed(done):
                        if l == a + b and token.startswith(l):
                            l = a
                            left.append((a, self.ranks[a + b]))
                        if r == a + b and token.endswith(r):
                            r = b
                            right.append((b, self.ranks[a + b]))
                    if len(l) == len(r) == 1:
                        known = (left, right)
            self.grown[token] = known
        return known

    def _stays(self, left: bytes, token: bytes) -> bool:
        """Can ``token`` follow ``left`` (or begin a piece, where ``left`` is empty)?

        Looks back in time from the whole tokens: at each moment the parts that meet at the boundary
        would have merged if their merge came before those that they took part in.
        """
        after = self._spines(token)
        if after is None or not left:
            return after is not None
        key = (left, token)
        ok = self.apart.get(key)
        if ok is None:
            if len(self.apart) > PAIRS:
                self.apart.clear()
            before, ranks = self._spines(left), self.ranks
            if not before or not after:
                ok = self._merges(left + token)[0] == [left, token]
            else:
                xs, ys, i, j, ok = before[1], after[0], 0, 0, True
                while True:
                    (x, until_x), (y, until_y) = xs[i], ys[j]
                    rank = ranks.get(x + y)
                    if rank is not None and rank < until_x and rank <= until_y:
                        ok = False
                        break
                    if i + 1 < len(xs) and (j + 1 == len(ys) or xs[i + 1][1] > ys[j + 1][1]):
                        i += 1
                    elif j + 1 < len(ys):
                        j += 1
                    else:
                        break
            self.apart[key] = ok
        return ok

    def _state(self, held: bytes, steps: tuple[int, ...], live: tuple[int, ...]) -> int:
        """``held``: bytes read since the last token; ``steps``: for each prefix of them the length of
        its last token; ``live``: the places from which a longer token could still start."""
        at = self.names.setdefault((held, steps), len(self.states))
        if at == len(self.states):
            self.states.append((held, steps, live))
        return at

    @staticmethod
    def _tokens(held: bytes, steps: tuple[int, ...], end: int) -> list[bytes]:
        out = []
        while end:
            start = end - steps[end - 1]
            out.append(held[start:end])
            end = start
        return out[::-1]

    def _first(self, key: int) -> int:
        """A transition met for the first time. It has two cases if all that is held is a token, as
        then the token before decides."""
        held, _, live = self.states[key >> 10]
        whole = held + bytes((key >> 2 & 255,))
        if not live[0] and whole in self.ranks and self._spines(whole) is not None:
            self.next[key] = -1
            return -1
        return self._step(key)

    def _step(self, key: int) -> int:
        held, steps, live = self.states[key >> 10]
        held += bytes((key >> 2 & 255,))
        end, ranks, start = len(held), self.ranks, 0
        if key & 3 != 3:
            for start in live:
                if start:
                    token = held[start:]
                    if token in ranks and self._stays(held[start - steps[start - 1] : start], token):
                        break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        steps += (end - start,)
        heads = self.heads
        live = (*[i for i in live if held[i:] in heads], end)
        if live[0]:  # what all live places have behind them is settled
            behind, place = set(), live[0]
            while place:
                behind.add(place)
                place -= steps[place - 1]
            cut = live[0]
            for place in live[1:]:
                while place > cut or (place and place not in behind):
                    place -= steps[place - 1]
                cut = place
            if cut:
                tokens = self._tokens(held, steps, cut)
                self.out[key] = tuple(ranks[t] for t in tokens), tokens[-1]
                held, steps, live = held[cut:], steps[cut:], tuple(i - cut for i in live)
        to = self.next[key] = self._state(held, steps, live)
        return to

    def piece(self, data: bytes) -> tuple[int, ...]:
        """Ids of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        if len(self.states) > STATES:
            self._restart()
        at, ids, last, move, emits = 0, [], b"", self.next.get, self.out
        for byte in data:
            key = (at << 8 | byte) << 2
            to = move(key)
            if to is None:
                to = self._first(key)
            if to < 0:
                token = self.states[at][0] + bytes((byte,))
                key += 3 if self._stays(last, token) else 2
                to = move(key)
                if to is None:
                    to = self._step(key)
            if key in emits:
                more, last = emits[key]
                ids += more
            at = to
        rest = self.rest.get(at)
        if rest is None:
            held, steps, _ = self.states[at]
            rest = self.rest[at] = tuple(self.ranks[t] for t in self._tokens(held, steps, len(held)))
        return (*ids, *rest)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        get, older = self.pieces.get, self.older
        for p in self.pieces_of(text):
            ids = get(p)
            if ids is None:
                ids = older.get(p)
                if ids is None:
                    ids = self.piece(p.encode("utf-8", "surrogatepass"))
                if len(p) <= 64:
                    if len(self.pieces) >= PIECES:  # the older half goes, what is still in use comes back
                        self.older = older = self.pieces
                        self.pieces = {}
                        get = self.pieces.get
                    self.pieces[p] = ids
            out += ids
        return out


def _automaton() -> list[list[int]]:
    """UTF-8 by states: 0 whole; 1-3 that many plain bytes to come; 4-7 a restricted second byte; -1 error."""
    table = [[-1] * 256 for _ in range(8)]
    for b in range(256):
        table[0][b] = 0 if b < 0x80 else -1
        plain = 0x80 <= b <= 0xBF
        for k in (1, 2, 3):
            table[k][b] = k - 1 if plain else -1
        table[4][b] = 1 if 0xA0 <= b <= 0xBF else -1  # after E0
        table[5][b] = 1 if 0x80 <= b <= 0x9F else -1  # after ED
        table[6][b] = 2 if 0x90 <= b <= 0xBF else -1  # after F0
        table[7][b] = 2 if 0x80 <= b <= 0x8F else -1  # after F4
    for b in range(0xC2, 0xF5):
        table[0][b] = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
    for b, k in ((0xE0, 4), (0xED, 5), (0xF0, 6), (0xF4, 7)):
        table[0][b] = k
    return table


AUTOMATON = _automaton()


class StreamDecoder:
    """Bytes of ids given in any portions, released at character boundaries."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.state, self.held = tokens, 0, b""
        self.moves: dict[tuple[int, int], tuple[int, int]] = {}
        self.whole = np.array([self._move(0, t) == (0, len(t)) for t in tokens], bool)

    @staticmethod
    def _move(state: int, data: bytes) -> tuple[int, int]:
        """The state after ``data`` and the place of its last character boundary (-1: none)."""
        edge = -1
        for i, b in enumerate(data):
            to = AUTOMATON[state][b]
            if to < 0:  # what was held is no character: it ends here, and the byte starts anew
                edge, to = i, max(0, AUTOMATON[0][b])
            state = to
            if not state:
                edge = i + 1
        return state, edge

    def feed(self, ids: np.ndarray) -> bytes:
        tokens, moves = self.tokens, self.moves
        parts = [self.held, *map(tokens.__getitem__, ids.tolist())]
        data, odd = b"".join(parts), np.flatnonzero(~self.whole[ids])
        if not self.state and not len(odd):
            return data
        starts = np.cumsum([len(x) for x in parts])  # where each token begins, and the end
        at = 0 if self.state else int(odd[0])
        edge = 0 if self.state else int(starts[at])
        while at < len(ids):
            key = (self.state, int(ids[at]))
            move = moves.get(key)
            if move is None:
                move = moves[key] = self._move(self.state, tokens[key[1]])
            self.state = move[0]
            if move[1] >= 0:
                edge = int(starts[at]) + move[1]
            at += 1
            if not self.state:
                k = np.searchsorted(odd, at)
                at = int(odd[k]) if k < len(odd) else len(ids)
                edge = int(starts[at])
        self.held = data[edge:]
        return data[:edge]

    def finish(self) -> bytes:
        rest, self.held, self.state = self.held, b"", 0
        return rest

    def chunks(self, ids: Iterable[int]) -> Iterator[bytes]:
        """Parts that each hold whole characters, where the ids make such."""
        ids = np.asarray(ids, np.int64)
        for i in range(0, len(ids), BLOCK):
            yield self.feed(ids[i : i + BLOCK])
        yield self.finish()


def encoder(spark: SparkSession, path: str, pattern: str):
    """A function from a text column to its ids. The driver reads ``path``; workers get a broadcast."""
    shared = spark.sparkContext.broadcast(read_ranks(path))

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = Transducer(shared.value, pattern)
        for batch in batches:
            yield pd.Series([np.array(machine.encode(t) if t else (), np.int32) for t in batch], dtype=object)

    return encode


def _by_id(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for t, k in ranks.items():
        tokens[k] = t
    return tokens


def decoder(spark: SparkSession, path: str):
    """A function from an id column to its bytes (valid UTF-8 where the ids came from a text)."""
    shared = spark.sparkContext.broadcast(_by_id(read_ranks(path)))

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = StreamDecoder(shared.value)
        for batch in batches:
            yield pd.Series([b"".join(machine.chunks(x)) if x is not None and len(x) else b"" for x in batch], dtype=object)

    return decode


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``ids`` and the ``decoded`` bytes of these ids.

    Both directions in one pass, a few hundred texts at a time. Columns of these names are replaced.
    """
    ranks = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kept = [f for f in docs.schema if f.name not in (text_col, "ids", "decoded")]
    shape = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    names = [f.name for f in shape]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(100_000, 20, 1000)  # the machines hold many small objects and no cycles
        # made anew for each task, so that idle workers hold no memory
        there, back = Transducer(shared.value, pattern), StreamDecoder(_by_id(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, PORTION):
                part = batch.slice(at, PORTION)
                ids = [np.array(there.encode(t) if t else (), np.int32) for t in part.column(len(kept)).to_pylist()]
                texts = [b"".join(back.chunks(x)) if len(x) else b"" for x in ids]
                own = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.binary())], names)

    return docs.select(*[f"`{f.name}`" for f in kept], F.col(text_col)).mapInArrow(run, shape)
