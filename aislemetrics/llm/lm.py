"""Language-model scoring with a log-frequency Bloom filter.

Counting. Words are keyed by 64-bit hashes. Counts of all training words are exact and stay a
distributed table. The ``FREQUENT`` most frequent words at most, a fixed bound, go to every worker
with their counts; all other words of a document are joined to the table.

Model. Counts of all neighbouring words are exact and stay a distributed table too. They are quantised
to powers of two, and a pair of frequent words of level j is entered into a Bloom filter j times, as
(pair, 1) .. (pair, j). A count is read by probing levels until one is missing. The filter grows with
the number of pairs up to ``MOST_BITS`` (16 MB, what is broadcast); beyond that it holds the highest
levels only. It is built by segments, each in one task. Every pair of a document that the filter does
not hold, or that has a word beyond the frequent ones, is joined to the table, so no level is lost.

P(w | v) is a mixture of the quantised count of (v, w) over the sum of the quantised counts of all pairs
of v, and of the smoothed frequency of w; it is that frequency alone if v was not met in training. Both
parts sum to 1 over the training words and one class of others, and so does P(. | v). A false positive
of the filter (about 1 in 200 where it holds all levels) raises one count by a level, at most to the sum
for v; to that extent the probabilities after v sum to more than 1.

Cases: null and empty texts hold only the end token. Without training rows every base probability
is 1. A null id counts as the text '' for the split. Rows that repeat an id are rows of their own.
Other columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislemetrics.llm.common import by_key, crc_mod, written
from aislemetrics.session import materialize

FREQUENT = 200_000
MOST_BITS = 1 << 27
BITS_EACH = 12
PROBES = 4
SEGMENTS = 256
WEIGHT = 0.7  # of the pair counts in the mixture
PORTION = 100_000  # tokens handled at once
CACHE = 100_000  # words whose hash a worker keeps
_U = np.uint64
_END_WORD = b" end"  # holds a blank, so no word is equal
_known: dict[bytes, int] = {}


def word_hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


END = word_hash(_END_WORD)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between \\x20 and \\x09-\\x0D, the only bytes at which ``split`` cuts."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes_of(words: list[bytes]) -> list[int]:
    if len(_known) > CACHE:
        _known.clear()
    out, get = [], _known.get
    for w in words:
        h = get(w)
        if h is None:
            h = _known[w] = word_hash(w)
        out.append(h)
    return out


def _portions(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows and their token hashes (with the end token), some hundred thousand tokens at a time."""
    rows, tokens, n = [], [], 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            rows.append(row)
            tokens.append(np.array([*hashes_of(words_of(row.text)), END], _U))
            n += len(tokens[-1])
            if n >= PORTION:
                yield rows, tokens
                rows, tokens, n = [], [], 0
    if rows:
        yield rows, tokens


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[bytes] = Counter()

    def out() -> pd.DataFrame:
        return pd.DataFrame({"word": np.array([word_hash(w) for w in counts], _U).view(np.int64), "n": np.array(list(counts.values()), np.int64)})

    for batch in batches:
        for text in batch["text"]:
            counts.update(words_of(text))
            if len(counts) > CACHE:
                yield out()
                counts.clear()
        counts[_END_WORD] += len(batch)
    yield out()


def level_of(count):
    """Quantised count: 1 for 1, 2 for 2-3, 3 for 4-7 and so on."""
    return np.frexp(np.asarray(count, np.float64))[1]


def count_at(level):
    """The count a level stands for; level 0 is none."""
    level = np.asarray(level)
    return np.where(level == 0, 0.0, np.where(level == 1, 1.0, 0.75 * np.exp2(level)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def segment_of(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.astype(_U) + _U(77)) % _U(SEGMENTS)).astype(np.int64)


def _places(keys: np.ndarray, level: int, bits: int) -> list[np.ndarray]:
    """Bit places of (key, level) inside the key's segment of ``bits`` bits."""
    h = _mix(keys.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(level))
    a, b = h & _U(0xFFFFFFFF), (h >> _U(32)) | _U(1)
    return [(a + _U(i) * b) % _U(bits) for i in range(PROBES)]


def segment_bits(keys: np.ndarray, levels: np.ndarray, bits: int) -> bytes:
    """The filter segment that holds ``keys`` at all levels up to ``levels``."""
    out = np.zeros(bits, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for place in _places(keys[levels >= level], level, bits):
            out[place] = 1
    return np.packbits(out).tobytes()


@dataclass(frozen=True)
class LogFilter:
    data: np.ndarray  # (SEGMENTS, bits / 8)
    least: int = 1  # lowest level that it holds

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts by repeated membership probes."""
        out, alive = np.zeros(len(keys), np.int64), np.arange(len(keys))
        segments, bits = segment_of(keys), self.data.shape[1] * 8
        for level in range(1, 64):
            if not len(alive):
                break
            hit = np.ones(len(alive), bool)
            for place in _places(keys[alive], level, bits):
                byte = self.data[segments[alive], (place >> _U(3)).astype(np.int64)]
                hit &= (byte >> (_U(7) - (place & _U(7))).astype(np.uint8)) & 1 == 1
            alive = alive[hit]
            out[alive] = level
        return out


@dataclass(frozen=True)
class Shared:
    """What every worker holds; all sizes have fixed bounds."""

    words: np.ndarray  # sorted hashes of frequent words
    counts: np.ndarray
    total: int
    kinds: int
    filter: LogFilter | None = None
    follow: np.ndarray | None = None  # sum of the quantised counts of the pairs of each frequent word

    @property
    def norm(self) -> float:
        return self.total + 0.1 * (self.kinds + 1)

    def codes(self, tokens: np.ndarray) -> np.ndarray:
        """The place among the frequent words, or the hash of another word."""
        other = tokens.view(np.int64)
        if not len(self.words):
            return other
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return np.where(self.words[at] == tokens, at, other)

    def frequent(self, codes: np.ndarray) -> np.ndarray:
        return (codes >= 0) & (codes < len(self.words))

    def counts_of(self, codes: np.ndarray) -> np.ndarray:
        """Counts of codes, -1 if not among the frequent words."""
        out, met = np.full(len(codes), -1, np.int64), self.frequent(codes)
        out[met] = self.counts[codes[met]]
        return out


def _before(codes: np.ndarray, lengths: list[int], end: int) -> np.ndarray:
    """The code before each; every text begins after an end token."""
    out = np.empty_like(codes)
    out[1:] = codes[:-1]
    out[np.cumsum([0, *lengths[:-1]])] = end
    return out


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of equally long columns in order, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(first)
    return [c[at] for c in columns], np.diff(at, append=len(order))


def _pair_counts(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        end, many = s.codes(np.array([END], _U))[0], max(1, len(s.words))
        for _, tokens in _portions(batches):
            w = s.codes(np.concatenate(tokens))
            v = _before(w, [len(t) for t in tokens], end)
            both = s.frequent(v) & s.frequent(w)
            key, n = np.unique(v[both] * many + w[both], return_counts=True)
            (rv, rw), rn = _distinct(v[~both], w[~both])
            yield pd.DataFrame({"v": np.concatenate([key // many, rv]), "w": np.concatenate([key % many, rw]), "n": np.concatenate([n, rn]).astype(np.int64)})

    return run


def quantised(n: Column) -> Column:
    """The count that the level of ``n`` stands for; a multiple of 1/2, so that sums are exact."""
    level = F.floor(F.log2(n.cast("double")) + 1e-9) + 1
    return F.when(level == 1, 1.0).otherwise(0.75 * F.pow(F.lit(2.0), level))


def _with_follow(shared):
    """Attach the sum of quantised counts of a frequent word ``v``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for batch in batches:
            yield batch.assign(follow=s.follow[batch["v"].to_numpy()])

    return run


def _with_counts(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for batch in batches:
            yield batch.assign(cv=s.counts_of(batch["v"].to_numpy()), cw=s.counts_of(batch["w"].to_numpy()))

    return run


def _segments(bits: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in by_key(batches, ["segment"]):
            levels = level_of(part["n"].to_numpy())
            keep = levels >= least
            data = segment_bits(part["key"].to_numpy()[keep], levels[keep], bits)
            yield pd.DataFrame({"segment": [int(part["segment"].iloc[0])], "data": [data]})

    return run


def _filter_of(pairs: DataFrame) -> LogFilter:
    """Size by the entries per level, then one task per segment; only the finished bits reach the driver."""
    level = F.floor(F.log2(F.col("n").cast("double")) + 1e-9).cast("int") + 1
    found = {r.level: r.n for r in pairs.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}  # 63 rows at most
    least = 1
    while (entries := sum(k * n for k, n in found.items() if k >= least)) * BITS_EACH > MOST_BITS:
        least += 1
    bits = max(1024, -(-entries * BITS_EACH // SEGMENTS) // 8 * 8 + 8)

    @F.pandas_udf("long")
    def segment(keys: pd.Series) -> pd.Series:
        return pd.Series(segment_of(keys.to_numpy()))

    placed = pairs.withColumn("segment", segment("key")).repartition("segment").sortWithinPartitions("segment")
    data = np.zeros((SEGMENTS, bits // 8), np.uint8)
    for row in placed.mapInPandas(_segments(bits, least), "segment long, data binary").toLocalIterator():
        data[row.segment] = np.frombuffer(bytes(row.data), np.uint8)
    return LogFilter(data, least)


def fit(texts: DataFrame) -> tuple[Shared, DataFrame, DataFrame]:
    """What workers share, and the tables of all training counts: (word, n), and of pairs (v, w, n, cv, cw).

    ``texts``: a column ``text``. Words of pairs are codes; cv and cw are the counts of frequent words, else -1.
    """
    counts = texts.select("text").mapInPandas(_word_counts, "word long, n long")
    counts = materialize(counts.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("kinds")).first()
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    steps = sorted(((r.step, r.n) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)  # about 1000 rows at most
    taken, bar = 0, None
    for k, n in steps:
        if taken + n > FREQUENT:
            break
        taken, bar = taken + n, k
    top = counts.filter(step >= (bar if bar is not None else 1 << 30)).toPandas()
    words, n = top["word"].to_numpy(np.int64).view(_U), top["n"].to_numpy(np.int64)
    by_hash = np.argsort(words)
    shared = Shared(words[by_hash], n[by_hash], total.total, total.kinds)
    sent = texts.sparkSession.sparkContext.broadcast(shared)
    pairs = texts.select("text").mapInPandas(_pair_counts(sent), "v long, w long, n long")
    pairs = pairs.groupBy("v", "w").agg(F.sum("n").alias("n"))
    pairs = written(pairs.mapInPandas(_with_counts(sent), "v long, w long, n long, cv long, cw long"))
    near = pairs.filter("cv > 0 and cw > 0").select((F.col("v") * len(words) + F.col("w")).alias("key"), "n")
    follow = np.ones(len(words))
    sums = pairs.filter("cv > 0").groupBy("v").agg(F.sum(quantised(F.col("n"))).alias("follow")).toPandas()  # one row per frequent word
    follow[sums["v"].to_numpy(np.int64)] = sums["follow"].to_numpy()
    return Shared(**{**shared.__dict__, "filter": _filter_of(near), "follow": follow}), counts, pairs


def gain_of(s: Shared, levels: np.ndarray, before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """log10 of P(w | v) over the share of the smoothed frequency in it; ``before``: sums of v, ``now``: counts of w."""
    share = np.minimum(count_at(levels) / before, 1.0)
    return np.log10(1 + WEIGHT * share * s.norm / ((1 - WEIGHT) * (now + 0.1)))


def _gains(s: Shared, shared, counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(v, w, gain) of every pair that the filter does not hold."""
    level = F.floor(F.log2(F.col("n").cast("double")) + 1e-9) + 1
    frequent = pairs.filter(F.col("cv") > 0).filter((F.col("cw") < 0) | (level < s.filter.least))
    frequent = frequent.mapInPandas(_with_follow(shared), "v long, w long, n long, cv long, cw long, follow double")
    rare = pairs.filter("cv < 0")
    rare = rare.join(rare.groupBy("v").agg(F.sum(quantised(F.col("n"))).alias("follow")), "v").select(*frequent.columns)
    both = frequent.unionByName(rare)
    known = counts.select(F.col("word").alias("w"), F.col("n").alias("found"))
    met = both.filter("cw < 0").join(known, "w").withColumn("cw", F.col("found")).select(*both.columns)
    both = both.filter("cw > 0").unionByName(met)
    share = quantised(F.col("n")) / F.col("follow")
    return both.select("v", "w", F.log10(1 + WEIGHT * share * s.norm / ((1 - WEIGHT) * (F.col("cw") + 0.1))).alias("gain"))


def _scored(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        end, many = s.codes(np.array([END], _U))[0], max(1, len(s.words))
        for rows, tokens in _portions(batches):
            lengths = [len(t) for t in tokens]
            flat = np.concatenate(tokens)
            w = s.codes(flat)
            v = _before(w, lengths, end)
            count = s.counts_of(w)
            known = count > 0
            base = np.where(known, np.log10(np.maximum(count, 0) + 0.1) - math.log10(s.norm), 0.0)
            both = np.flatnonzero(s.frequent(v) & known)
            pairs, back = np.unique(v[both] * many + w[both], return_inverse=True)
            levels = s.filter.levels(pairs)
            held = levels >= s.filter.least
            own = np.zeros(len(pairs))
            own[held] = gain_of(s, levels[held], s.follow[pairs[held] // many], s.counts_of(pairs[held] % many))
            gain, ask = np.zeros(len(flat)), np.ones(len(flat), bool)
            gain[both] = own[back]
            ask[both] = ~held[back] & (s.filter.least > 1)  # a filter of all levels knows that a pair was not met
            ends = np.cumsum(lengths)
            place = np.repeat(np.arange(len(rows)), lengths)
            (pr, pv, pw), pm = _distinct(place[ask], v[ask], w[ask])
            cut = np.searchsorted(pr, np.arange(len(rows) + 1))
            out = []
            for i, (row, a, b) in enumerate(zip(rows, ends - lengths, ends)):
                rest, times = np.unique(flat[a:b][~known[a:b]], return_counts=True)
                x = slice(cut[i], cut[i + 1])
                out.append((
                    row.doc_id, row.held_out, b - a, int(known[a:b].sum()), math.fsum(base[a:b]), math.fsum(gain[a:b]),
                    rest.view(np.int64), times.astype(np.int64), pv[x], pw[x], pm[x].astype(np.int32),
                ))
            frame = pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "known", "base", "gain", "words", "times", "v", "w", "met"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return run


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out``: a condition on ``doc_id``; such rows are scored, but not learnt from.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = crc_mod(F.col("doc_id"), 10) == 0 if held_out is None else held_out
    rows = rows.withColumn("held_out", held)
    s, counts, pairs = fit(rows.filter(~F.col("held_out")))
    shared = docs.sparkSession.sparkContext.broadcast(s)
    shape = "doc_id long, held_out boolean, n_tokens long, known long, base double, gain double, words array<long>, times array<long>, v array<long>, w array<long>, met array<int>"
    parts = written(rows.mapInPandas(_scored(shared), shape).withColumn("row", F.monotonically_increasing_id()))
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(counts, "word", "left")
    single = F.log10(F.coalesce("n", F.lit(0)) + 0.1)
    rest = met.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (single - math.log10(s.norm))).alias("more_base"),
    )
    asked = parts.select("row", F.explode(F.arrays_zip("v", "w", "met")).alias("x")).select("row", "x.v", "x.w", "x.met")
    gained = asked.join(_gains(s, shared, counts, pairs), ["v", "w"]).groupBy("row").agg(F.sum(F.col("met") * F.col("gain")).alias("more_gain"))
    zero = F.lit(0.0)
    known = F.col("known") + F.coalesce("more_known", F.lit(0))
    base = F.col("base") + F.coalesce("more_base", zero)
    # every word is once the one before: a known one leaves 1 - WEIGHT to the frequency of the next
    score = base + known * math.log10(1 - WEIGHT) + F.col("gain") + F.coalesce("more_gain", zero)
    ends = parts.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "gain")
    return ends.join(rest, "row", "left").join(gained, "row", "left").select(
        "doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(s.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), score.alias("score"),
    )
