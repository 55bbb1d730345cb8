"""Dropping fact rows without a partner before they are shuffled."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scalar_row

BROADCAST_BYTES = 32 << 20
BITS_PER_KEY = 10  # false positives near 2 %
HASHES = 5
MOST_BITS = 1 << 27  # 16 MB


def with_known_keys(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in the one column of ``keys``; never loses one that is.

    The distinct keys are counted first. Few enough to broadcast, they are joined as they are; more of
    them go into a Bloom filter of at most ``MOST_BITS`` bits, which is one value in the plan, and there once:
    each mention is a copy in the tasks' code, which the driver holds. All bits of a key lie in one word. Either
    way ``df`` is filtered in the tasks that read it.
    """
    named = materialize(keys.select(F.col(keys.columns[0]).cast("string").alias("_key")).where(F.col("_key").isNotNull()).distinct())
    n, size = named.agg(F.count("*"), F.coalesce(F.sum(F.length("_key") + 48), F.lit(0))).first()
    if size <= BROADCAST_BYTES:
        return df.withColumn("_key", key.cast("string")).join(F.broadcast(named), "_key", "left_semi").drop("_key")
    words = bloom_words(n)
    bits = scalar_row(bloom(named, "_key", words))["bits"]
    text = key.cast("string")
    return df.where(text.isNotNull() & (F.get(bits, _word(text, words)).bitwiseAND(_mask(text)) == _mask(text)))


def bloom_words(n: int) -> int:
    """64-bit words of a filter of ``n`` keys: a power of two."""
    return min(MOST_BITS, 1 << max(10, math.ceil(math.log2(max(1, n * BITS_PER_KEY))))) >> 6


def _word(key: Column, words: int) -> Column:
    return F.xxhash64(key, F.lit(0)).bitwiseAND(F.lit(words - 1)).cast("int")


def _mask(key: Column) -> Column:
    """The bits of a key: six bits of a second hash for each."""
    places = [F.shiftright(F.xxhash64(key, F.lit(1)), 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(HASHES)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places])


def bloom(keys: DataFrame, key: str, words: int) -> DataFrame:
    """One row with ``bits``, the filter's words: set bits are combined per word before they are put in order."""
    word = keys.groupBy(_word(F.col(key), words).alias("word")).agg(F.bit_or(_mask(F.col(key))).alias("bits"))
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("word"))
    filled = every.join(word, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    row = F.sort_array(F.collect_list(F.struct("word", "bits")))
    return filled.agg(F.transform(row, lambda x: x["bits"]).alias("bits"))
