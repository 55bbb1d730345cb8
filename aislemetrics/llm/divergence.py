"""Source divergence audit: how far the word use of each source of a language lies from the others.

The counts of a language form a matrix, groups (language, source) by kept terms. It is cut into
cells, a pair of row blocks by a slice of the columns, and each cell is a task. In a task the
columns that hold anything are cut into square panels; the panels of both row blocks become K-squared
quadtrees (k = 2) that are traversed jointly. A quadrant that is zero in both trees is one price, the
same for every column of it; only leaves that are nonzero in one of the trees are priced cell by
cell. Columns that are zero in a whole cell are never sent; they are priced at the end by their number.

All figures are whole numbers: p = 1 + floor(10^9 (count + 2) / (N + 2 V)) and
f = floor((p - q)^2 / (p + q)), with p at most 10^9 + 1, so squares stay below 2^63.

Cases: null texts, languages and sources count as empty. A group without a kept term is all zero; a
language without kept terms gives its pairs the value 0 and no terms. A language with one source has
no pairs. Repeated rows are separate documents. A text of any length is read whole; one without
separators is one term. Columns beyond the three are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislemetrics.llm.common import BROADCAST_BYTES, written

LEAST_DOCS = 10  # documents of a language that hold a kept term
TOP_TERMS = 10
FLUSH = 200_000  # different (group, term) entries that a counting task holds before it hands them on
ROWS = 128  # groups of a row block, on average
CELL = 1 << 18  # nonzeros of a row block within one slice, on average
LEAF = 4  # rows and columns of a leaf
FRONTIER = 1 << 17  # leaf pairs of the panels that are traversed together
SCALE = 1_000_000_000

# bytes of terms as they are, A-Z in lower case, all others blank; bytes above 127 are parts of letters beyond ASCII
_TERM_BYTES = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII, A-Z lower-cased, of a UTF-8 text."""
    return text.translate(_TERM_BYTES).split()


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per (lang, source, term); a null term stands for the group itself."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            terms = [None, *[t.decode("utf-8", "surrogatepass") for t in n]]
            columns = [[lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [0, *[docs[t] for t in n]]]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _COUNTS)], schema=_COUNTS)
        seen.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            n, docs = seen[lang, source]
            found = terms_of(text.as_py())
            n.update(found)
            docs.update(set(found))
        if sum(len(n) for n, _ in seen.values()) > FLUSH:
            yield from out()
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), each once; a row with a null term for every group."""
    empty = F.lit("")
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")])
    partial = read.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, width: str):
    """1 + floor(10^9 (count + 2) / (total + 2 width)); decimal, as the product may pass 2^63."""
    over = f"cast({SCALE} as decimal(10)) * cast({count} + 2 as decimal(20))"
    return F.expr(f"case when {width} > 0 then 1 + ({over}) div cast({total} + 2 * {width} as decimal(20)) else 1 end").cast("long")


def _gap(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})").cast("long")


def _levels(leaves: np.ndarray) -> list[np.ndarray]:
    """Bitmaps of a quadtree from the root down to ``leaves`` (panels, rows, columns)."""
    out = [leaves]
    while out[0].shape[1] > 1:
        panels, side, _ = out[0].shape
        out.insert(0, out[0].reshape(panels, side // 2, 2, side // 2, 2).any(axis=(2, 4)))
    return out


class Side:
    """Nonzeros (row, column, p) of a row block, sorted by column, and each row's p of a zero count."""

    def __init__(self, row: np.ndarray, column: np.ndarray, p: np.ndarray, zero: np.ndarray):
        order = np.argsort(column, kind="stable")
        self.row, self.column, self.p, self.zero = row[order], column[order], p[order], zero

    def panels(self, first: int, n: int, count: int, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """p of ``count`` panels in leaf blocks, and their trees; columns from ``width`` on get 1."""
        start, end = np.searchsorted(self.column, [first, first + n * count])
        panel, column = np.divmod(self.column[start:end] - first, n)
        row = self.row[start:end]
        dense = np.ones((count, n, n), np.int64)
        dense[:, : len(self.zero)] = self.zero[None, :, None]
        dense[panel, row, column] = self.p[start:end]
        used = np.clip(width - first - n * np.arange(count), 0, n)
        dense.transpose(0, 2, 1)[np.arange(n) >= used[:, None]] = 1
        bits = np.zeros((count, n // LEAF, n // LEAF), bool)
        bits[panel, row // LEAF, column // LEAF] = True
        side = n // LEAF
        return dense.reshape(count, side, LEAF, side, LEAF).transpose(0, 1, 3, 2, 4), _levels(bits)


def joint_values(left: Side, right: Side, width: int) -> np.ndarray:
    """Sum of f over ``width`` columns for every row of ``left`` with every row of ``right``."""
    n = LEAF
    while n < max(len(left.zero), len(right.zero)):
        n *= 2
    side = n // LEAF
    together = max(1, FRONTIER // side**3)
    priced = np.zeros((n, n), np.int64)  # columns of quadrants that are zero in both trees
    summed = np.zeros((side, side, LEAF, LEAF), np.int64)
    for first in range(0, width, n * together):
        count = min(together, -(-(width - first) // n))
        (blocks_a, tree_a), (blocks_b, tree_b) = (s.panels(first, n, count, width) for s in (left, right))
        at = np.zeros((count, 4), np.int64)  # panel, row node of the left, row node of the right, column node
        at[:, 0] = np.arange(count)
        for level, (bits_a, bits_b) in enumerate(zip(tree_a, tree_b)):
            panel, i, j, c = at.T
            some = bits_a[panel, i, c] | bits_b[panel, j, c]
            size = n >> level
            zero = at[~some]
            columns = np.clip(width - first - zero[:, 0] * n - zero[:, 3] * size, 0, size)
            price = np.zeros((1 << level, 1 << level), np.int64)
            np.add.at(price, (zero[:, 1], zero[:, 2]), columns)
            priced += np.repeat(np.repeat(price, size, 0), size, 1)
            at = at[some]
            if size > LEAF:
                half = np.array([[0, a, b, d] for a in (0, 1) for b in (0, 1) for d in (0, 1)])
                at = (at * [1, 2, 2, 2])[:, None, :] + half
                at = at.reshape(-1, 4)
        for k in range(0, len(at), 1 << 14):
            panel, i, j, c = at[k : k + (1 << 14)].T
            p, q = blocks_a[panel, i, c][:, :, None, :], blocks_b[panel, j, c][:, None, :, :]
            np.add.at(summed, (i, j), ((p - q) ** 2 // (p + q)).sum(-1))
    out = summed.transpose(0, 2, 1, 3).reshape(n, n)[: len(left.zero), : len(right.zero)]
    p, q = left.zero[:, None], right.zero[None, :]
    return out + priced[: len(left.zero), : len(right.zero)] * ((p - q) ** 2 // (p + q))


_CELL_OUT = "group_a long, group_b long, value long, covered long"


def _cell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """All pairs of a group of block ``a`` with a group of block ``b`` over the columns of the cell."""
    a, b = int(key[1]), int(key[2])
    filled = rows[rows["term_id"] >= 0]
    # frequent columns and full rows first, so that zeros lie together
    column = pd.Index(filled["term_id"].value_counts().index)
    busy = filled["group_id"].value_counts()

    def side(block: int) -> tuple[np.ndarray, Side]:
        marks = rows[(rows["term_id"] < 0) & (rows["block"] == block)]
        ids = marks["group_id"].to_numpy()
        order = np.lexsort((ids, -busy.reindex(ids).fillna(0).to_numpy()))
        ids, zero = ids[order], marks["p"].to_numpy(np.int64)[order]
        mine = filled[filled["block"] == block]
        at = pd.Index(ids).get_indexer(mine["group_id"])
        return ids, Side(at, column.get_indexer(mine["term_id"]), mine["p"].to_numpy(np.int64), zero)

    ids_a, left = side(a)
    ids_b, right = (ids_a, left) if a == b else side(b)
    value = joint_values(left, right, len(column))
    i, j = np.triu_indices(len(ids_a), 1) if a == b else (x.ravel() for x in np.indices(value.shape))
    # each slice orders the groups by its own nonzeros, so a pair is named by its smaller group first
    of_a, of_b = np.minimum(ids_a[i], ids_b[j]), np.maximum(ids_a[i], ids_b[j])
    return pd.DataFrame({"group_a": of_a, "group_b": of_b, "value": value[i, j], "covered": np.int64(len(column))})


def _pairs(nonzeros: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every unordered pair of sources of a language."""
    load = nonzeros.groupBy("lang", "block").count().groupBy("lang").agg(F.ceil(F.max("count") / CELL).cast("int").alias("slices"))
    shape = groups.groupBy("lang").agg(F.max("blocks").alias("blocks")).join(load, "lang", "left")
    shape = written(shape.select("lang", "blocks", F.coalesce("slices", F.lit(1)).alias("slices")))
    # joined by language, a few hot keys; with so many languages that this is large, none of them is hot
    if shape.count() * 64 <= BROADCAST_BYTES:
        shape = F.broadcast(shape)
    cells = nonzeros.join(shape, "lang").select(
        "lang", "blocks", "block", F.expr("pmod(xxhash64(term_id), slices)").cast("int").alias("slice"), "group_id", "term_id", "p"
    )
    marks = groups.drop("blocks").join(shape, "lang").select(
        "lang", "blocks", "block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
        "group_id", F.lit(-1).cast("long").alias("term_id"), F.col("p0").alias("p"),
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = cells.unionByName(marks).withColumn("other", other).select(
        "lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "slice", "block", "group_id", "term_id", "p"
    )
    each = sent.groupBy("lang", "a", "b", "slice").applyInPandas(_cell, _CELL_OUT)
    summed = each.groupBy("group_a", "group_b").agg(F.sum("value").alias("visited"), F.sum("covered").alias("covered"))
    of_a = groups.select(F.col("group_id").alias("group_a"), "lang", F.col("source").alias("a"), F.col("p0").alias("zero_a"), "width")
    of_b = groups.select(F.col("group_id").alias("group_b"), F.col("source").alias("b"), F.col("p0").alias("zero_b"))
    value = F.col("visited") + (F.col("width") - F.col("covered")) * _gap("zero_a", "zero_b")
    return summed.join(of_a, "group_a").join(of_b, "group_b").select("lang", "a", "b", value.alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (lang, source, text); see the module text.

    Part ``pair``: every other source of the language. Part ``term``: the ``top_terms`` terms that the
    source uses most beyond its language. The texts are read once and reduced to counts in the
    reading tasks; what is shuffled after that are counts.
    """
    counts = written(term_counts(docs))
    held = counts.filter("term is not null")
    vocabulary = held.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    vocabulary = written(vocabulary.select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("term_id")))
    widths = vocabulary.groupBy("lang").agg(F.count("*").alias("width"), F.sum("lang_n").alias("lang_total"))
    kept = written(held.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "term_id", "n", "lang_n"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(widths, "lang", "left")
    groups = groups.na.fill(0, ["total", "width", "lang_total"]).withColumn("group_id", F.monotonically_increasing_id())
    blocks = counts.filter("term is null").groupBy("lang").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks"))
    groups = groups.join(blocks, "lang").withColumns({"p0": _share("0", "total", "width"), "block": F.expr("pmod(xxhash64(source), blocks)").cast("int")})
    groups = written(groups)

    shares = kept.join(groups.select("lang", "source", "total", "width", "lang_total", "group_id", "block"), ["lang", "source"])
    shares = shares.withColumn("p", _share("n", "total", "width")).withColumn("q", _share("lang_n", "lang_total", "width"))
    pairs = written(_pairs(shares.select("lang", "block", "group_id", "term_id", "p"), groups))
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_pair = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    above = shares.filter("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap("p", "q").alias("value"))
    by_term = above.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_terms)
    return by_pair.unionByName(by_term)
