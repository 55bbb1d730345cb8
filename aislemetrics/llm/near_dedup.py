"""MinHash near-de-duplication with sequential Bayesian verification.

1. A text becomes the set of 64-bit hashes of its word shingles. Texts with the same set form one
   class; only one representative of a class goes on, so copies cost nothing later.
2. A representative's MinHash values are cut into bands. Representatives that share a band key may
   be similar; those keys join them into candidate families.
3. Families are cut into blocks and every pair of blocks is one cell of work. Inside a cell a
   candidate pair (a shared band key) is compared signature batch by signature batch. After each
   batch the posterior of "similarity at least the threshold", given the matches so far and a flat
   prior, decides: below ``miss`` the pair is dropped. Survivors are verified on the full sets.
   Pairs whose documents are already connected in the cell are skipped, so a family of n copies
   costs about n comparisons and a cell returns a spanning forest, not all pairs.
4. Links are closed to components.

Bands and rows follow from the threshold t: the longest bands with (1 - t^rows)^bands <= ``miss``. The
chance to lose a true link is that of no shared band (2.8e-8 at t = 0.85, 1.0e-7 at t = 0.80) plus
``miss`` for each batch.

Cases: a text without words (null, empty) has no shingles and is linked with nothing; fewer words
than a shingle make one shingle of all. A null id is never linked: its component is null and the row
is kept. Rows that repeat an id get one component. Other columns are ignored. Empty tables give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetrics.llm.common import ascii_lower, by_key, components
from aislemetrics.session import materialize

VALUES = 320  # of a signature, if the threshold does not ask for more
BATCH = 32  # signature values compared before the posterior is looked at
MISS = 1e-6  # chance to drop a pair at the threshold, for each batch
BLOCK = 2048  # members of a block
BLOCK_BYTES = 16 << 20  # sets and signatures of a block
_U = np.uint64
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a lower-cased text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at \x20 \x09-\x0D only
    if len(_words) > 400_000:
        _words.clear()
    ids = []
    for w in words:
        h = _words.get(w)
        if h is None:
            h = _words[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
        ids.append(h)
    if not ids:
        return np.empty(0, _U)
    a = np.array(ids, _U)
    n = max(1, len(a) - size + 1)
    out = np.full(n, len(a) if len(a) < size else size, _U)
    for i in range(min(size, len(a))):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + a[i : i + n])
    return np.unique(out)


@lru_cache(4)
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


@lru_cache(8)
def layout(percent: int, miss: float) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands all miss a pair at the threshold with chance ``miss`` at most."""
    t = percent / 100
    for rows in range(VALUES, 0, -1):
        bands = VALUES // rows
        if (1 - t**rows) ** bands <= miss:
            return bands, rows
    return math.ceil(math.log(miss) / math.log1p(-t)), 1


def width(bands: int, rows: int) -> int:
    """Signature values: whole batches that hold all bands, ``VALUES`` at least."""
    return max(VALUES, -(-bands * rows // BATCH) * BATCH)


def signature(hashes: np.ndarray, n: int = VALUES) -> np.ndarray:
    """MinHash values (32 bits) of a non-empty set."""
    a, b = _family(n)
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    x = (hashes >> _U(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    for i in range(0, len(x), 512):
        part = x[i : i + 512, None]
        y = part * a + b
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        np.minimum(low, y.min(axis=0), out=low)
    return low


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    values = sig[: bands * rows].reshape(bands, rows).astype(_U)
    out = np.arange(bands, dtype=_U)
    for i in range(rows):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + values[:, i] + _U(1))
    return out.view(np.int64)


@lru_cache(8)
def least_matches(threshold: float, miss: float, steps: int, batch: int) -> list[int]:
    """For each number of compared values, the matches below which a pair is dropped.

    P(similarity >= t | m of n match) under a flat prior is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for k in range(1, steps + 1):
        n, total, m = k * batch + 1, 0.0, 0
        while m < n:
            log = math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1)
            total += math.exp(log + m * math.log(threshold) + (n - m) * math.log1p(-threshold))
            if total >= miss:
                break
            m += 1
        out.append(m)
    return out


def _described(size: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text in zip(batch["doc_id"], batch["text"]):
                s = shingles(text, size)
                if len(s):
                    d = blake2b(s.tobytes(), digest_size=16).digest()
                    keys = band_keys(signature(s, width(bands, rows)), bands, rows)
                    out.append((i, len(s), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), keys))
                else:
                    out.append((i, 0, 0, 0, None))
            frame = pd.DataFrame(out, columns=["doc_id", "n", "k1", "k2", "bands"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return run


def _sets(size: int, values: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "family": batch["family"], "blocks": batch["blocks"],
                "hashes": [s.tobytes() for s in sets], "sig": [signature(s, values).tobytes() for s in sets],
            })

    return run


def forest(ids: list[int], sets: list[np.ndarray], sigs: np.ndarray, percent: int, miss: float) -> list[tuple[int, int]]:
    """A spanning forest of the true links among the documents of a cell."""
    n = len(ids)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    bands, rows = layout(percent, miss)
    keys = np.stack([band_keys(s, bands, rows) for s in sigs]) if n else np.empty((0, bands), np.int64)
    least = least_matches(percent / 100, miss, width(bands, rows) // BATCH, BATCH)
    sizes = np.array([len(s) for s in sets])
    buckets: list[dict[int, list[int]]] = [{} for _ in range(bands)]
    links = []
    for i in range(n):
        near: set[int] = set()
        for bucket, key in zip(buckets, keys[i].tolist()):
            near.update(bucket.get(key, ()))
        groups: dict[int, list[int]] = {}
        for j in near:
            groups.setdefault(find(j), []).append(j)
        for js in groups.values():  # one verified link with a connected group is enough
            js = np.array(sorted(js))
            js = js[100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i])]
            matches = np.zeros(len(js), np.int64)
            for k, bar in enumerate(least):
                if not len(js):
                    break
                cut = slice(k * BATCH, (k + 1) * BATCH)
                matches += (sigs[js, cut] == sigs[i, cut]).sum(axis=1)
                js, matches = js[matches >= bar], matches[matches >= bar]
            for j in js[np.argsort(-matches, kind="stable")].tolist():
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    links.append((ids[i], ids[j]))
                    root[find(i)] = find(j)
                    break
        for bucket, key in zip(buckets, keys[i].tolist()):
            bucket.setdefault(key, []).append(i)
    return links


def _cells(percent: int, miss: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in by_key(batches, ["family", "bi", "bj"]):
            sets = [np.frombuffer(x, _U) for x in cell["hashes"]]
            sigs = np.stack([np.frombuffer(x, np.uint32) for x in cell["sig"]])
            links = forest(cell["doc_id"].tolist(), sets, sigs, percent, miss)
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return run


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, miss: float = MISS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest linked id), kept.

    ``size`` words make a shingle; texts are linked at ``percent`` % similarity or more.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), ascii_lower(F.col(text_col)).alias("text"))
    shape = "doc_id long, n long, k1 long, k2 long, bands array<long>"
    bands, per_band = layout(percent, miss)
    marks = materialize(source.mapInPandas(_described(size, bands, per_band), shape))
    linkable = marks.filter("n > 0 and doc_id is not null")
    first = [F.min_by("bands", "doc_id").alias("bands"), F.min("n").alias("n")]
    classes = materialize(linkable.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), *first))
    rows = classes.select("id", F.explode("bands").alias("band"))
    shared = materialize(rows.groupBy("band").agg(F.min("id").alias("low"), F.count("*").alias("n")).filter("n > 1"))
    pairs = rows.join(shared.select("band", "low"), "band").filter("id <> low")
    families = materialize(components(pairs.select(F.col("id").alias("a"), F.col("low").alias("b"))))
    size_of = F.lit(8) * F.col("n") + 4 * width(bands, per_band)
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(size_of) / BLOCK_BYTES)).cast("int")
    counts = families.join(classes.select("id", "n"), "id").groupBy("root").agg(blocks.alias("blocks"))
    members = materialize(families.join(counts, "root").select("id", F.col("root").alias("family"), "blocks"))
    texts = source.join(members.withColumnRenamed("id", "doc_id"), "doc_id")
    # rows that repeat an id and differ in text: the text of the class representative is among them
    ready = texts.mapInPandas(_sets(size, width(bands, per_band)), "doc_id long, family long, blocks int, hashes binary, sig binary")
    placed = ready.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("doc_id", "family", "hashes", "sig", "own", other)
    placed = placed.select(
        "doc_id", "family", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "hashes", "sig"
    )
    placed = placed.repartition("family", "bi", "bj").sortWithinPartitions("family", "bi", "bj", "doc_id")
    links = placed.mapInPandas(_cells(percent, miss), "a long, b long")
    closed = materialize(components(links).select("id", F.col("root").alias("component")))
    spread = classes.select("k1", "k2", "id").join(closed, "id", "left")
    spread = materialize(spread.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.coalesce("component", "id").alias("component")))
    on = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = marks.join(spread, on, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest id of each component, with all columns."""
    gone = near_groups(docs, id_col, text_col, **settings).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(materialize(gone), F.col(id_col) == F.col("_gone_id"), "left_anti")
