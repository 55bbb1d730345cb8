"""Exact de-duplication by composable polynomial fingerprints.

A text (A-Z lower-cased, UTF-8) is cut into chunks. Every chunk gets polynomial hashes modulo two
primes; the hashes of a text follow by length-shifted arithmetic, H(AB) = H(A) * x^|B| + H(B), so
chunks can be hashed in any order and a huge text never needs one long pass. Texts with equal
fingerprints are only candidates: each is compared with one representative, chunk by chunk.

Cases: a null text counts as empty, empty texts are copies of each other. A null id sorts below
every id and never stays if another copy has one. Rows that repeat an id are separate rows; of
several rows with the largest id, all carry that ``keep_id`` and ``kept`` is true for one of them.
Columns beyond id and text are ignored, so clashing names do no harm. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetrics.llm.common import BROADCAST_BYTES, ascii_lower
from aislemetrics.session import materialize

CHUNK = 1 << 16  # bytes of a chunk; products of a byte, a power and this stay below 2^63
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
CELL = 64  # members of a group that are compared in one partition key


def _powers(base: int, prime: int) -> np.ndarray:
    out = [1]
    for _ in range(CHUNK - 1):
        out.append(out[-1] * base % prime)
    return np.array(out[::-1], np.uint64)


_TABLES: dict[tuple[int, ...], list[np.ndarray]] = {}


def chunk_hash(chunk: np.ndarray, primes=PRIMES) -> list[int]:
    """Polynomial hashes of up to ``CHUNK`` bytes, one for each prime."""
    if primes not in _TABLES:
        _TABLES[primes] = [_powers(b % p, p) for b, p in zip(BASES, primes)]
    wide = chunk.astype(np.uint64)
    return [int(np.dot(wide, t[CHUNK - len(chunk) :])) % p for t, p in zip(_TABLES[primes], primes)]


def combine(left: list[int], right: list[int], right_len: int, primes=PRIMES) -> list[int]:
    """Hashes of a concatenation from those of its parts."""
    return [(a * pow(b % p, right_len, p) + c) % p for a, c, b, p in zip(left, right, BASES, primes)]


def fingerprint(data: bytes, primes=PRIMES) -> list[int]:
    whole = np.frombuffer(data, np.uint8)
    out = [0, 0]
    for i in range(0, len(whole), CHUNK):
        part = whole[i : i + CHUNK]
        out = combine(out, chunk_hash(part, primes), len(part), primes)
    return out


def _marks(primes):
    """Fingerprint, length and SHA-256 of lower-cased texts; ``bytes.lower`` touches A-Z only."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in batch]
            rows = [(*fingerprint(x, primes), len(x), sha256(x).hexdigest()) for x in data]
            yield pd.DataFrame(rows, columns=["h1", "h2", "n", "sha"]).astype({"h1": "int64", "h2": "int64", "n": "int64", "sha": "object"})

    # so marked, the optimizer does not compute it once more for a filter below
    return F.pandas_udf(run, "h1 long, h2 long, n long, sha string").asNondeterministic()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes=PRIMES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Shuffles ids and fingerprints of all rows, and texts only of rows whose fingerprint occurs twice.
    A large group is compared in cells of ``CELL`` members, each with its own copy of the
    representative's chunks. A group in which a member differs from it falls back to SHA-256 as a whole.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = source.withColumn("fp", _marks(primes)("text"))
    marks = materialize(marked.select("doc_id", F.monotonically_increasing_id().alias("row"), "fp.h1", "fp.h2", "fp.n", "fp.sha"))
    fp = ["h1", "h2", "n"]
    groups = marks.groupBy(*fp).agg(F.count("*").alias("size"), F.max("doc_id").alias("rep_id"))
    twice = materialize(groups.filter("size > 1"))
    differs = materialize(_compared(marked, twice, fp).filter("not same").select(*[F.col(c).alias("d_" + c) for c in fp]))
    if differs.isEmpty():
        verdict = marks.withColumn("other", F.lit(None).cast("string"))
    else:
        match = F.lit(True)
        for c in fp:
            match &= F.col(c) == F.col("d_" + c)
        verdict = marks.join(differs, match, "left").withColumn("other", F.when(F.col("d_n").isNotNull(), F.col("sha")))
    final = materialize(
        verdict.groupBy(*fp, "other").agg(
            F.count("*").alias("group_size"), F.max(F.struct(F.col("doc_id").alias("id"), "row")).alias("top")
        )
    )
    right = final.select(
        *[F.col(c).alias("g_" + c) for c in (*fp, "other")], "group_size",
        F.col("top.id").alias("keep_id"), F.col("top.row").alias("top_row"),
    )
    match = (F.col("h1") == F.col("g_h1")) & (F.col("h2") == F.col("g_h2")) & (F.col("n") == F.col("g_n"))
    match &= F.coalesce("other", F.lit("")) == F.coalesce("g_other", F.lit(""))
    return verdict.join(right, match).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("top_row")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def _compared(marked: DataFrame, twice: DataFrame, fp: list[str]) -> DataFrame:
    """(h1, h2, n, same) of every group: do all its texts equal that of the representative, a row with the largest id?"""
    small = twice.count() * 48 <= BROADCAST_BYTES
    rows = marked.select("text", "doc_id", "fp.h1", "fp.h2", "fp.n")
    members = rows.join(F.broadcast(twice) if small else twice, fp)
    cells = F.ceil(F.col("size") / CELL).cast("int")
    # written once, as both sides of the comparison read it, and rows keep their numbers
    members = materialize(members.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").eqNullSafe(F.col("rep_id")).alias("top"),
        cells.alias("cells"), *fp, F.encode(ascii_lower(F.col("text")), "utf-8").alias("data"),
    ))
    step = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / CHUNK).cast("int")), lambda i: i * CHUNK)
    pieces = F.transform(step, lambda at: F.substring(F.col("data"), at + 1, F.lit(CHUNK)))
    first = members.filter("top").groupBy(*fp).agg(F.min("row").alias("row"))
    left = members.select(*fp, F.pmod(F.xxhash64("row"), F.col("cells")).cast("int").alias("cell"), F.posexplode(pieces).alias("seq", "piece"))
    right = members.join(first, [*fp, "row"], "left_semi").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    right = right.select(*fp, "cell", F.posexplode(pieces).alias("seq", "rep_piece"))
    pairs = left.join(right, [*fp, "cell", "seq"])
    return pairs.groupBy(*fp).agg(F.every(F.col("piece") == F.col("rep_piece")).alias("same"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one."""
    verdicts = materialize(exact_groups(docs, id_col, text_col))
    key, sha = "_kept_id", "_kept_sha"
    stay = verdicts.filter("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha))
    same_row = F.col(id_col).eqNullSafe(F.col(key)) & (F.sha2(F.encode(ascii_lower(F.col(text_col)), "utf-8"), 256) == F.col(sha))
    kept = docs.join(stay, same_row, "left_semi")
    twin = verdicts.filter(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    twin = twin.select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)).distinct()
    if twin.isEmpty():
        return kept
    once = kept.join(twin, same_row, "left_semi").withColumn(sha, F.sha2(F.encode(ascii_lower(F.col(text_col)), "utf-8"), 256))
    once = once.dropDuplicates([id_col, sha]).drop(sha)
    return kept.join(twin, same_row, "left_anti").unionByName(once)
