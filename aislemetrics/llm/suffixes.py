"""Substring de-duplication by a distributed merge sort of anchored suffixes.

A byte is removed if a string of ``length`` bytes over it also starts anywhere else, in any document
or the same one. Sorting every suffix would move each byte ``length`` times, so only anchored
suffixes are sorted.

1. Anchors. Each window of ``length`` bytes picks one position by its content alone: the smallest
   gram hash at some distance from its ends. Equal windows pick the same place, neighbouring windows
   mostly share theirs. An anchor stands for its windows and has a core, the bytes that all of them
   contain. Anchors whose core occurs once are dropped by counting hashes.
2. Copies. Anchors whose whole surroundings are equal (two independent 64-bit hashes of them) form a
   class. A class of several members is repeated throughout; only one member goes on.
3. Merge sort. The suffixes from the cores of the classes that are left, with their left contexts,
   are sorted within each task, front-coded as runs and sent to the bucket of their core. A bucket
   merges its runs with a loser tree that remembers common prefix lengths and never compares a byte
   of a known common prefix again. Classes with one core come out side by side, with the lengths of
   their common prefixes; with the common parts of their left contexts these give each anchor's
   repeated stretch.
4. A core with more than ``HOT`` different surroundings would be an ever larger group. Ranges of its
   windows are counted by hash instead, with partial aggregation, and only ranges that may hold a
   repeated window are taken apart.

Cases: null and empty texts, and texts shorter than ``length``, lose nothing. Rows with the same id
and text are different documents that repeat each other. Null ids are kept. Other columns are
ignored. An empty table gives none. Texts are read in blocks, whatever their length.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetrics.llm.common import BROADCAST_BYTES, by_key, written
from aislemetrics.session import materialize

LENGTH = 400
HOT = 2000
PAIRWISE = 40  # groups up to this size are compared pair by pair
BLOCK = 1 << 19
RUN_BYTES = 1 << 16
WAYS = 4  # parts of a range of windows of a hot core
_U = np.uint64
_POS = _U((1 << 21) - 1)
_rng = np.random.default_rng(400)
_TABLES = _rng.integers(0, 1 << 64, (2, 256), _U)
_BASES = [int(x) | 1 for x in _rng.integers(1 << 40, 1 << 62, 2)]


@dataclass(frozen=True)
class Plan:
    """How windows of ``length`` bytes choose anchors."""

    length: int

    @property
    def margin(self) -> int:
        return self.length // 8

    @property
    def gram(self) -> int:
        return max(1, min(16, self.length // 8))

    @property
    def core(self) -> int:
        return 2 * self.margin + self.gram


_powers: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def _power_tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """x^i and x^-i modulo 2^64 up to n, for both bases."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        out = []
        for base in _BASES:
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size + 1, b, _U)
                steps[0] = 1
                pair.append(np.cumprod(steps, dtype=_U))
            out.append(tuple(pair))
        _powers[size] = out
    return _powers[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hashes:
    """Hashes of any stretches of a block of bytes."""

    def __init__(self, data: np.ndarray):
        self.prefix, self.inverse = [], []
        for (power, inverse), table in zip(_power_tables(len(data)), _TABLES):
            sums = np.zeros(len(data) + 1, _U)
            np.cumsum(table[data] * power[: len(data)], out=sums[1:])
            self.prefix.append(sums)
            self.inverse.append(inverse)

    def of(self, start, end, which: int) -> np.ndarray:
        p = self.prefix[which]
        return _mix((p[end] - p[start]) * self.inverse[which][start])


def anchors_of(data: np.ndarray, plan: Plan):
    """(anchor, first window, last window, core hash, class hash) of the windows of a block."""
    n, length, w = len(data), plan.length, plan.length - plan.core + 1
    h = Hashes(data)
    at = np.arange(n - plan.gram + 1)
    keys = (h.of(at, at + plan.gram, 0) & ~_POS) | at.astype(_U)
    keys = keys[plan.margin : n - plan.margin - plan.gram + 1]
    rows = -(-len(keys) // w)
    padded = np.full(rows * w, ~_U(0), _U)
    padded[: len(keys)] = keys
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    pick = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & _POS).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
    last = np.concatenate([first[1:], [windows]]) - 1
    anchor = pick[first]
    low = anchor - plan.margin
    core = h.of(low, low + plan.core, 1)
    whole = h.of(first, last + length, 0)
    whole = _mix(whole * _U(0x9E3779B97F4A7C15) + ((anchor - first).astype(_U) << _U(32)) + (last - first).astype(_U))
    return anchor, first, last, core.view(np.int64), whole.view(np.int64)


def _anchor_rows(plan: Plan):
    """Per document: anchors (one of each class, with its number), and stretches repeated inside it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["a", "h", "q", "s", "e", "core", "class", "weight"]
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for a, h, text in zip(batch["a"], batch["h"], batch["text"]):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                parts = []
                for start in range(0, max(0, len(data) - plan.length + 1), BLOCK):
                    q, first, last, core, kind = anchors_of(data[start : start + BLOCK + plan.length - 1], plan)
                    parts.append((q + start, first + start, last + start + plan.length, core, kind))
                if not parts:
                    continue
                q, s, e, core, kind = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((q, kind, core))
                new = np.ones(len(q), bool)
                new[1:] = (core[order][1:] != core[order][:-1]) | (kind[order][1:] != kind[order][:-1])
                weight = np.diff(np.append(np.flatnonzero(new), len(q)))
                one = order[new]
                if len(one) < len(q):
                    twice = np.repeat(weight > 1, weight)
                    for lo, hi in merged(s[order][twice], e[order][twice]):
                        out.append((np.array([a]), np.array([h]), *(np.array([x]) for x in (-1, lo, hi, 0, 0, 0))))
                out.append((np.full(len(one), a), np.full(len(one), h), q[one], s[one], e[one], core[one], kind[one], weight))
                size += len(one)
                if size > 50_000:
                    yield pd.DataFrame(dict(zip(names, (np.concatenate(x) for x in zip(*out)))))
                    out, size = [], 0
            if out:
                yield pd.DataFrame(dict(zip(names, (np.concatenate(x) for x in zip(*out)))))

    return run


def merged(starts, ends) -> list[tuple[int, int]]:
    """The union of stretches as maximal ones in order; touching ones are joined."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s, e = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    cut = np.flatnonzero(s[1:] > e[:-1])
    return list(zip(s[np.concatenate([[0], cut + 1])].tolist(), e[np.concatenate([cut, [len(e) - 1]])].tolist()))


_HEAD = "<HIIqqqqq?"  # lengths: common, rest of the suffix, left context; then the tag
_HEAD_SIZE = struct.calcsize(_HEAD)


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of two strings that agree up to ``start``."""
    n = min(len(a), len(b))
    while start < n:
        x, y = a[start : start + 64], b[start : start + 64]
        if x == y:
            start += 64
            continue
        k = min(len(x), len(y))
        diff = int.from_bytes(x[:k], "big") ^ int.from_bytes(y[:k], "big")
        return start + (k - (diff.bit_length() + 7) // 8 if diff else k)
    return min(start, n)


def encode_run(entries: list[tuple]) -> Iterator[bytes]:
    """Front-coded blocks of sorted (suffix, left, tag); each block can be read on its own."""
    out, size, before = [], 0, b""
    for suffix, left, tag in entries:
        same = min(common(before, suffix), 0xFFFF) if out else 0
        out.append(struct.pack(_HEAD, same, len(suffix) - same, len(left), *tag) + suffix[same:] + left)
        size += len(out[-1])
        before = suffix
        if size > RUN_BYTES:
            yield b"".join(out)
            out, size = [], 0
    if out:
        yield b"".join(out)


def decode_run(blocks: list[bytes]) -> Iterator[tuple[int, bytes, bytes, tuple]]:
    """(prefix in common with the entry before, suffix, left, tag) of a run's blocks in order."""
    before = b""
    for data in blocks:
        at, first = 0, True
        while at < len(data):
            same, tail, left, *tag = struct.unpack_from(_HEAD, data, at)
            at += _HEAD_SIZE
            suffix = before[:same] + data[at : at + tail]
            at += tail
            yield (common(before, suffix) if first else same), suffix, data[at : at + left], tuple(tag)
            at += left
            before, first = suffix, False


def merge_runs(runs: list[Iterator[tuple]]) -> Iterator[tuple[int, bytes, bytes, tuple]]:
    """One sorted sequence of sorted runs, each entry with its common prefix with the one before.

    A loser tree: every inner node keeps the entry that lost there and the length of its common
    prefix with the entry that won. That is also its common prefix with the last output, so of two
    entries the one with the longer common prefix is smaller, and only on a tie are bytes behind it
    compared.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (k - len(runs))
    lcp = [0] * k  # with the last output
    losers = [0] * k

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix is brought up to date."""
        x, y = heads[i], heads[j]
        if y is None:
            return i, j
        if x is None:
            return j, i
        if lcp[i] != lcp[j]:
            return (i, j) if lcp[i] > lcp[j] else (j, i)
        h = common(x[1], y[1], lcp[i])
        a, b = x[1][h : h + 1], y[1][h : h + 1]
        if a < b or (a == b and i < j):
            lcp[j] = h
            return i, j
        lcp[i] = h
        return j, i

    def build(node: int) -> int:
        if node >= k:
            return node - k
        won, losers[node] = play(build(2 * node), build(2 * node + 1))
        return won

    top = build(1) if k > 1 else 0
    while heads[top] is not None:
        _, suffix, left, tag = heads[top]
        yield lcp[top], suffix, left, tag
        heads[top] = nxt = next(runs[top], None)
        lcp[top] = nxt[0] if nxt else 0
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def stretches(group: list[tuple], length: int) -> list[tuple[int, int]]:
    """For each (prefix with the one before, suffix, left): bytes to the left and right of the core's
    start that are repeated with another member; (0, 0) if no window is."""
    n = len(group)
    best = [(0, 0)] * n
    if n <= PAIRWISE:
        for i in range(n):
            _, suffix, left = group[i]
            right = len(suffix)
            for j in range(i + 1, n):
                right = min(right, group[j][0])
                if right + len(left) < length:
                    break
                both = common(left, group[j][2])
                if both + right >= length:
                    for x in (i, j):
                        best[x] = (max(best[x][0], both), max(best[x][1], right))
        return best
    most = max(len(g[2]) for g in group)
    for back in range(most + 1):
        keys = [(g[2][:back], g[1][: length - back]) if len(g[2]) >= back and len(g[1]) >= length - back else None for g in group]
        times = Counter(keys)
        for i, key in enumerate(keys):
            if key is not None and times[key] > 1:
                best[i] = (max(best[i][0], back), max(best[i][1], length - back))
    return best


def _runs(plan: Plan, buckets: int):
    """Sorted front-coded runs of the suffixes of a task's documents, by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = number = 0

        def out() -> Iterator[pd.DataFrame]:
            held.sort(key=lambda x: x[:3])
            at = 0
            while at < len(held):
                end = at
                while end < len(held) and held[end][0] == held[at][0]:
                    end += 1
                blocks = list(encode_run([x[1:] for x in held[at:end]]))
                tag = int(held[at][3][0] ^ held[at][3][1]) & 0x7FFFFFFFFFFF
                yield pd.DataFrame({"bucket": held[at][0], "run": tag * 1024 + number % 1024, "seq": range(len(blocks)), "data": blocks})
                at = end

        for batch in batches:
            for a, h, text, seeds in zip(batch["a"], batch["h"], batch["text"], batch["seeds"]):
                data = text.encode("utf-8", "surrogatepass")
                for seed in seeds:
                    low = seed["q"] - plan.margin
                    tag = (a, h, low, seed["s"], seed["e"], bool(seed["solo"]))
                    held.append((seed["core"] % buckets, data[low : seed["e"]], data[seed["s"] : low][::-1], tag))
                    size += seed["e"] - seed["s"] + 200
                if size > 48_000_000:
                    yield from out()
                    held, size, number = [], 0, number + 1
        yield from out()

    return run


def _merged_groups(plan: Plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for bucket in by_key(batches, ["bucket"]):
            runs = [decode_run(part["data"].tolist()) for _, part in bucket.groupby("run", sort=False)]
            out: list[tuple] = []
            group: list[tuple] = []

            def close() -> None:
                if len(group) > 1:
                    for (_, _, _, tag), (back, ahead) in zip(group, stretches([g[:3] for g in group], plan.length)):
                        if ahead and tag[5]:
                            out.append((tag[0], tag[1], tag[2] - back, tag[2] + ahead))

            for entry in merge_runs(runs):
                if group and entry[0] < plan.core:
                    close()
                    group = []
                group.append(entry)
            close()
            yield pd.DataFrame(out, columns=["a", "h", "s", "e"]).astype("int64")

    return run


def _surroundings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The anchors of hot cores with the bytes that their windows cover."""
    for batch in batches:
        out: list[tuple] = []
        for a, h, text, seeds in zip(batch["a"], batch["h"], batch["text"], batch["seeds"]):
            data = text.encode("utf-8", "surrogatepass")
            out += [(a, h, seed["q"], seed["s"], seed["e"], seed["solo"], data[seed["s"] : seed["e"]]) for seed in seeds]
        yield pd.DataFrame(out, columns=["a", "h", "q", "s", "e", "solo", "data"])


def parts_of(lo: int, hi: int) -> list[tuple[int, int]]:
    """A range of whole numbers in at most ``WAYS`` equal parts."""
    step = -(-(hi - lo + 1) // WAYS)
    return [(k, min(hi, k + step - 1)) for k in range(lo, hi + 1, step)]


_ANCHOR = ["a", "h", "q", "s", "e"]


def _part_hashes(plan: Plan):
    """Each range of bytes left of the core, in parts: hashes of what all windows of a part contain, and of what they cover."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for a, h, q, s, e, data, ranges in batch[[*_ANCHOR, "data", "ranges"]].itertuples(index=False):
                hashes = Hashes(np.frombuffer(data, np.uint8))
                at = q - plan.margin - s  # the core in ``data``, and the most bytes to its left
                least = max(0, at - (e - s - plan.length))
                parts = [(lo, hi, r["solo"]) for r in ranges for lo, hi in parts_of(r["lo"], r["hi"]) if lo <= at and hi >= least]
                if not parts:
                    continue
                lo, hi = (np.array(x, np.int64) for x in list(zip(*parts))[:2])
                full = (lo >= least) & (hi <= at)
                inner = [hashes.of(at - lo, at - hi + plan.length, k).view(np.int64).tolist() for k in (0, 1)]
                left, right = np.where(full, at - hi, 0), np.where(full, at - lo + plan.length, 0)
                outer = [hashes.of(left, right, k).view(np.int64).tolist() for k in (0, 1)]
                out += [(a, h, q, s, e, *x) for x in zip(*zip(*parts), *inner, full.tolist(), *outer)]
            yield pd.DataFrame(out, columns=[*_ANCHOR, "lo", "hi", "solo", "one", "two", "full", "outer_one", "outer_two"])

    return run


def _joined(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """``keys``: distinct and written, much fewer than ``rows``; broadcast below a measured size."""
    return rows.join(F.broadcast(keys) if keys.count() * 64 <= BROADCAST_BYTES else keys, on, how)


def hot_stretches(anchors: DataFrame, plan: Plan) -> list[DataFrame]:
    """(a, h, s, e): windows of anchors (a, h, q, s, e, solo, data) of hot cores that another anchor has too.

    A window is told by the number of bytes left of the core, from 0 to ``length - core``. A range of these
    numbers goes on in parts while what all its windows contain occurs again. If what they cover
    does, the whole range is repeated; then one anchor goes on for all that share it, since others may
    still meet it in a smaller range. Anchors that are not ``solo`` (copies of whole surroundings, or such
    a one) count twice and are removed already.
    """
    weight = F.when(F.col("solo"), 1).otherwise(2)
    held = written(anchors.dropDuplicates(_ANCHOR))  # equal rows of one id and text have the same anchors
    state = held.select(*_ANCHOR, "data", F.array(F.struct(F.lit(0).alias("lo"), F.lit(plan.length - plan.core).alias("hi"), "solo")).alias("ranges"))
    shape = "a long, h long, q long, s long, e long, lo int, hi int, solo boolean, one long, two long, full boolean, outer_one long, outer_two long"
    out = []
    while True:
        parts = materialize(state.mapInPandas(_part_hashes(plan), shape))
        inner, outer = ["lo", "hi", "one", "two"], ["lo", "hi", "outer_one", "outer_two"]
        met = materialize(parts.groupBy(*inner).agg(F.sum(weight).alias("n"), F.max("solo").alias("any")).filter("n > 1 and any").select(*inner))
        alive = materialize(_joined(parts, met, inner, "left_semi"))
        shared = alive.filter("full").groupBy(*outer).agg(F.sum(weight).alias("n"), F.min(F.struct(*_ANCHOR)).alias("first")).filter("n > 1")
        shared = materialize(shared.select(*outer, "first", F.lit(True).alias("full")))
        alive = materialize(_joined(alive, shared, [*outer, "full"], "left"))
        low = F.col("q") - plan.margin
        out.append(alive.filter("first is not null and solo").select("a", "h", (low - F.col("hi")).alias("s"), (low - F.col("lo") + plan.length).alias("e")))
        own = F.struct(*_ANCHOR)
        left = alive.filter("lo < hi").filter(F.col("first").isNull() | (F.col("first") == own))
        left = left.withColumn("solo", F.col("solo") & F.col("first").isNull())
        if left.isEmpty():
            return out
        ranges = left.groupBy(*_ANCHOR).agg(F.collect_list(F.struct("lo", "hi", "solo")).alias("ranges"))  # at most the windows of an anchor
        state = held.join(ranges, _ANCHOR).select(*_ANCHOR, "data", "ranges")


def repeated(source: DataFrame, plan: Plan, hot: int = HOT) -> DataFrame:
    """(a, h, s, e): stretches of the documents (a, h, text) that also occur elsewhere."""
    shape = "a long, h long, q long, s long, e long, core long, class long, weight long"
    marks = written(source.mapInPandas(_anchor_rows(plan), shape))
    inside = marks.filter("q < 0").select("a", "h", "s", "e")
    anchors = marks.filter("q >= 0")
    classes = materialize(
        anchors.groupBy("core", "class").agg(F.sum("weight").alias("n"), F.count("*").alias("rows"), F.min(F.struct("a", "h", "q", "s", "e")).alias("one"))
    )
    many = materialize(classes.filter("n > 1").select("core", "class"))
    copies = anchors.join(many, ["core", "class"]).select("a", "h", "s", "e")
    cores = materialize(classes.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    seeds = classes.join(cores, "core").select("one.*", "core", (F.col("n") == 1).alias("solo"), "kinds")
    seeds = materialize(seeds)
    packed = F.collect_list(F.struct("q", "s", "e", "core", "solo")).alias("seeds")  # at most the anchors of one document

    def with_texts(rows: DataFrame, small: bool = False) -> DataFrame:
        rows = rows.groupBy("a", "h").agg(packed)
        return source.join(F.broadcast(rows) if small else rows, ["a", "h"]).select("a", "h", "text", "seeds")

    buckets = 4 * int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = with_texts(seeds.filter(F.col("kinds") <= hot)).mapInPandas(_runs(plan, buckets), "bucket long, run long, seq int, data binary")
    runs = runs.repartition("bucket").sortWithinPartitions("bucket", "run", "seq")
    out = inside.unionByName(copies).unionByName(runs.mapInPandas(_merged_groups(plan), "a long, h long, s long, e long"))
    busy = seeds.filter(F.col("kinds") > hot)
    if n := busy.count():
        # the documents meet few such anchors: below a measured size they are broadcast, else joined like the others
        few = with_texts(busy, n * 64 <= BROADCAST_BYTES)
        near = few.mapInPandas(_surroundings, "a long, h long, q long, s long, e long, solo boolean, data binary")
        for more in hot_stretches(near, plan):
            out = out.unionByName(more)
    return out


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for a, text, found in zip(batch["a"], batch["text"], batch["found"]):
            data = text.encode("utf-8", "surrogatepass")
            spans, kept = [], data
            if found is not None and len(found):
                spans = merged([x["s"] for x in found], [x["e"] for x in found])
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            rows.append((a, len(data), [{"start": s, "end": e} for s, e in spans], kept))
        yield pd.DataFrame(rows, columns=["a", "n_bytes", "spans", "kept"])


_NO_ID = -(1 << 63)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """One row per row: doc_id, n_bytes, spans (removed start and end, in bytes) and kept (bytes).

    The texts are shuffled once, by id: the exchange serves the suffixes and the final cut.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("a"), F.xxhash64(text).alias("h"), text.alias("text")
    )
    found = repeated(source, Plan(length), hot)
    found = found.groupBy("a", "h").agg(F.collect_list(F.struct("s", "e")).alias("found"))  # at most the anchors of one document
    whole = source.join(found, ["a", "h"], "left").select("a", "text", "found")
    cut = whole.mapInPandas(_cut, "a long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return cut.select(F.when(F.col("a") != _NO_ID, F.col("a")).alias("doc_id"), "n_bytes", "spans", "kept")
