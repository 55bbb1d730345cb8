"""Quality classifier: random-indexing word vectors, pooled per document, and a small numpy network.

Every word has a sparse random index vector that follows from its hash. The vector of a word is its
index vector plus the direction of the sum of the index vectors around it (random indexing); words
not met in fitting have their index vector alone. Shapes of words (runs of upper-case, lower-case,
digits and signs) and a word said twice in a row are treated likewise, in dimensions of their own. A
longer word than ``LONGEST`` counts as its consecutive pieces. A document is the mean over all
its words. Two dense layers give a logit; a temperature fitted on rows left out of training turns it
into a calibrated probability.

Fitting reads at most ``FIT_ROWS`` labelled rows (the first by hash of the id) and keeps the
``VOCABULARY`` most frequent words of them, so what is broadcast has a fixed bound (about 6 MB).
Scoring reads every document whole and needs no shuffle.

Cases: null and empty texts have a zero vector and get the network's score for it. Without labels,
or with one class only, every score is the share of label 1 (0.5 without labels). Labels that are
null are left out; a repeated labelled row counts as often as it occurs. Other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislemetrics.session import materialize

FIT_ROWS = 6000
VOCABULARY = 20_000
DIM = 64  # of the word part and of the shape part
NONZERO = 6
WINDOW = 2
PARTS = 8  # of the fitting sample
HIDDEN = 32
EPOCHS = 60
CACHE = 200_000  # tokens a worker keeps
LONGEST = 64  # characters of a token

_RUNS = re.compile(r"(.)\1+")
_SHIFTS = np.arange(NONZERO, dtype=np.uint64)[:, None] * np.uint64(7)


def name_hash(name: str) -> int:
    return int.from_bytes(blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def index_sum(hashes: np.ndarray) -> np.ndarray:
    """Sum of the sparse ternary vectors of words: each hash holds ``NONZERO`` places and signs."""
    bits = hashes[None, :] >> _SHIFTS
    places = (bits & np.uint64(DIM - 1)).astype(np.int64).ravel()
    signs = 1.0 - 2.0 * ((bits >> np.uint64(6)) & np.uint64(1)).astype(np.float64).ravel()
    return np.bincount(places, weights=signs, minlength=DIM)


def index_vector(name: str) -> np.ndarray:
    return index_sum(np.array([name_hash(name)], np.uint64)).astype(np.float32)


class _Kinds(dict):
    """Character to its kind, for ``str.translate``; filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        return kind


def tokens_of(text: str | None) -> list[str]:
    """Words between blanks; the pieces of longer ones than ``LONGEST``."""
    tokens = (text or "").split()
    if not tokens or max(map(len, tokens)) <= LONGEST:
        return tokens
    return [t[i : i + LONGEST] for t in tokens for i in range(0, len(t), LONGEST)]


def shape_of(token: str, kinds: dict | None = None) -> str:
    """Runs of character kinds: ``SALE!!`` is ``X!``, ``Word,`` is ``Xx,``."""
    return _RUNS.sub(r"\1", token.translate(_Kinds() if kinds is None else kinds))


class Pool:
    """Mean vectors of documents; keeps what it knows of recent tokens."""

    def __init__(self, context: dict[str, np.ndarray]):
        self.place = {w: i + 1 for i, w in enumerate(context)}
        self.vectors = np.stack([np.zeros(DIM, np.float32), *context.values()])
        self.kinds, self.rows, self.shapes = _Kinds(), {}, {}
        self.words, self.forms = np.zeros(CACHE, np.uint64), np.zeros(CACHE, np.uint64)
        self.near = np.zeros(CACHE, np.int32)
        self.again = index_vector("\0again").astype(np.float64)

    def _row(self, token: str) -> int:
        at = self.rows[token] = len(self.rows)
        low, shape = token.lower(), shape_of(token, self.kinds)
        form = self.shapes.get(shape)
        if form is None:
            if len(self.shapes) > CACHE:
                self.shapes.clear()
            form = self.shapes[shape] = name_hash("\0" + shape)
        self.words[at], self.forms[at], self.near[at] = name_hash(low), form, self.place.get(low, 0)
        return at

    def __call__(self, text: str | None) -> np.ndarray:
        tokens, total, rows = tokens_of(text), np.zeros(2 * DIM), self.rows
        for i in range(0, len(tokens), 20_000):
            part = tokens[i : i + 20_000]
            if len(rows) + len(part) > CACHE:
                rows.clear()
            get, make = rows.get, self._row
            ids = np.array([at if (at := get(t)) is not None else make(t) for t in part])
            near = self.near[ids]
            total[:DIM] += index_sum(self.words[ids]) + self.vectors[near[near > 0]].sum(axis=0, dtype=np.float64)
            total[DIM:] += index_sum(self.forms[ids]) + self.again * np.count_nonzero(ids[1:] == ids[:-1])
        return total / max(1, len(tokens))


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def _nll(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Two layers by Adam on four fifths of the rows, the temperature on the rest."""
    width = x.shape[1] if x.ndim == 2 else 2 * DIM
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.log(share / (1 - share)), 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, rest = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[rest].mean(axis=0), x[rest].std(axis=0) + 1e-3
    s = (x - mean) / scale
    p = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        rng.shuffle(rest)
        for i in range(0, len(rest), 128):
            a, t = s[rest[i : i + 128]], y[rest[i : i + 128]]
            h = np.tanh(a @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - t) / len(t)
            back = np.outer(err, p[2]) * (1 - h * h)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ err + 1e-4 * p[2], np.array([err.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if len(held):
        z, n1 = net.logit(x[held]), y[held].sum()
        # smoothed targets, so that a perfect split does not ask for certainty
        target = np.where(y[held] > 0.5, (n1 + 1) / (n1 + 2), 1 / (len(held) - n1 + 2))
        best = min(np.geomspace(0.25, 8, 61), key=lambda t: _nll(z / t, target))
        net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), float(best))
    return net


def _words_of(text: str | None) -> list[str]:
    return [t.lower() for t in tokens_of(text)]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts = Counter(w for text in batch["text"] for w in _words_of(text))
        # named object, as an empty list would make a column of floats
        yield pd.DataFrame({"word": pd.Series(list(counts), dtype=object), "n": np.array(list(counts.values()), np.int64)})


def _contexts(chosen):
    """Per chosen word of a partition: the sum of the index vectors around it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {w: i for i, w in enumerate(chosen.value)}
        sums, vectors = np.zeros((len(place), DIM)), {}
        for batch in batches:
            for text in batch["text"]:
                words = _words_of(text)
                at = np.array([place.get(w, -1) for w in words], np.int64)
                for w in words:
                    if w not in vectors:
                        vectors[w] = index_vector(w)
                if (at >= 0).any():
                    own = np.stack([vectors[w] for w in words])
                    near = np.zeros_like(own)
                    for k in range(1, WINDOW + 1):
                        near[k:] += own[:-k]
                        near[:-k] += own[k:]
                    np.add.at(sums, at[at >= 0], near[at >= 0])
        met = np.flatnonzero(np.abs(sums).sum(axis=1))
        frame = pd.DataFrame(sums[met], columns=[f"v{k}" for k in range(DIM)])
        frame.insert(0, "word", met)
        yield frame

    return run


@dataclass(frozen=True)
class Model:
    context: dict[str, np.ndarray]
    network: Network


def _sample(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str) -> DataFrame:
    chosen = labels.filter("quality is not null").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y"))
    chosen = chosen.filter(usable).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """``labels``: doc_id, quality. ``usable``: condition on ``id`` that a row may be learnt from."""
    # at most FIT_ROWS texts, kept so that the documents are read once
    rows = materialize(_sample(docs, labels, usable, id_col, text_col).repartition(PARTS))
    words = rows.select("text").mapInPandas(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    chosen = [r.word for r in words.filter("n > 1").orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]
    names = [f"v{k}" for k in range(DIM)]
    sent = docs.sparkSession.sparkContext.broadcast(chosen)
    near = rows.select("text").mapInPandas(_contexts(sent), "word long, " + ", ".join(f"{c} double" for c in names))
    near = near.groupBy("word").agg(*[F.sum(c).alias(c) for c in names])
    got = near.select("word", F.array(*[F.col(c).cast("float") for c in names]).alias("v")).toPandas()
    context = {chosen[i]: np.asarray(v, np.float32) / max(1e-6, float(np.linalg.norm(v))) for i, v in zip(got["word"], got["v"])}
    shared = docs.sparkSession.sparkContext.broadcast(context)

    def pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = Pool(shared.value)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"].astype("int64"), "y": batch["y"], "x": [pool(t).astype(np.float32) for t in batch["text"]]})

    got = rows.mapInPandas(pooled, "id long, y double, x array<float>").toPandas().sort_values(["id", "y"])
    sent.destroy()
    shared.destroy()
    x = np.stack(got["x"].tolist()).astype(np.float64) if len(got) else np.zeros((0, 2 * DIM))
    return Model(context, train(x, (got["y"].to_numpy(np.float64) >= 0.5).astype(np.float64)))


def quality_score(spark: SparkSession, model: Model):
    """A function from a text column to the probability of label 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pool, net = Pool(shared.value.context), shared.value.network
        for batch in batches:
            x = np.stack([pool(t) for t in batch]) if len(batch) else np.zeros((0, 2 * DIM))
            yield pd.Series(net.score(x))

    return score
