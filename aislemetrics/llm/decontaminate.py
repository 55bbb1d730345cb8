"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become sequences of template words: A-Z lower-cased, punctuation at the
ends taken off, and numbers, units and names replaced by typed placeholders, whose own values are kept
as slots. Windows of template words are hash-joined. Matching windows on one diagonal (document
position minus item position) are one alignment. A window counts if its slots are equal to the item's,
or if each stands by the alignment's mapping: an item value stands for the document value of the same
type that it meets at the most places, and for none if two are met at equally many. So a
re-parameterised question matches, an edited place costs only the windows over it, and an unrelated
text of the same pattern does not match. An item is found in a document if such windows cover at least
``cover`` of its words.

The windows of the benchmark are the small side: their measured size decides whether a set of their
hashes is broadcast, so that each task keeps only windows that occur in the benchmark, or all windows
are shuffled to the join. Both ways give the same rows.

Cases: null and empty texts contain nothing, null or empty items are found nowhere; items shorter
than a window are one window. A document with a null id is
reported with no item, an item with a null id is skipped. Rows that repeat an id give the union of their items, one
row for each input row. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetrics.llm.common import BROADCAST_BYTES
from aislemetrics.session import materialize

WINDOW = 8
COVER = 0.5
CACHE = 300_000  # words a worker keeps
SHAPE = "id long, pos int, hash long, width int, slots array<struct<at:int,kind:string,value:string>>"

# Words that are units after a number or alone.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day "
    "days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches "
    "foot feet gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres dollar dollars euro euros cent cents "
    "percent % $ € £ kmh mph hz khz mhz ghz b kb mb gb tb w kw v a j kj cal kcal °c °f".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d,.:/]*(?:st|nd|rd|th|%|e[+-]?\d+)?$", re.I)
_EDGES = "\"'`.,;:!?()[]{}<>«»“”‘’…|*_#&~-"
_ENDS = tuple(".!?:;")
_U = np.uint64


def _hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


_NAME = _hash(b"\0name")
_KINDS = (None, "number", "unit", "name")


def template_word(word: str) -> tuple[int, str | None, str, bool, bool]:
    """Hash of the template word, slot kind (or None), value, written like a name?, ends a sentence?"""
    bare = word.strip(_EDGES) or word
    low = bare.encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
    value = low.decode("utf-8", "surrogatepass")
    ends = word.rstrip("\"'”’)]»")[-1:] in _ENDS
    if not bare.isalpha() and _NUMBER.match(bare):
        return _hash(b"\0number"), "number", value, False, ends
    if value in UNITS:
        return _hash(b"\0unit"), "unit", value, False, ends
    return _hash(low), None, value, bare[:1].isupper() and bare[1:].islower(), ends


class Templates:
    """Texts as template words; keeps what it knows of recent words."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.hashes, self.kinds = np.zeros(CACHE, _U), np.zeros(CACHE, np.int8)
        self.capital, self.ends = np.zeros(CACHE, bool), np.zeros(CACHE, bool)

    def _row(self, word: str) -> int:
        at = self.rows[word] = len(self.rows)
        self.hashes[at], kind, _, self.capital[at], self.ends[at] = template_word(word)
        self.kinds[at] = _KINDS.index(kind)
        return at

    def __call__(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words, hashes of their template words, and slot kinds.

        A name is a capitalised word inside a sentence; the first word of a sentence or text is none.
        """
        words, parts, rows = (text or "").split(), [], self.rows
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            if len(rows) + len(part) > CACHE:
                rows.clear()
            get, make = rows.get, self._row
            ids = np.array([at if (at := get(w)) is not None else make(w) for w in part])
            parts.append((self.hashes[ids], self.kinds[ids], self.capital[ids], self.ends[ids]))
        if not parts:
            return words, np.empty(0, _U), np.empty(0, np.int8)
        hashes, kinds, capital, ends = (np.concatenate(x) for x in zip(*parts))
        names = capital.copy()
        names[0] = False
        names[1:] &= ~ends[:-1]
        return words, np.where(names, _U(_NAME), hashes), np.where(names, np.int8(3), kinds)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for every window of ``size`` words; none if there are fewer words."""
    out = np.full(max(0, len(hashes) - size + 1), size, _U)
    for i in range(size):
        x = out * _U(0x9E3779B97F4A7C15) + hashes[i : i + len(out)]
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        out = x ^ (x >> _U(29))
    return out


def _rows(key, text: str | None, templates: Templates, widths: list[int] | int, wanted: np.ndarray | None) -> list[tuple]:
    """(id, position, hash, width, slots) of the windows that are wanted; an integer width is cut to the text."""
    words, hashes, kinds = templates(text)
    if isinstance(widths, int):
        widths = [min(widths, len(words))] if words else []
    out = []
    for width in widths:
        found = windows(hashes, width)
        if wanted is None:
            places = np.arange(len(found))
        elif len(wanted):
            near = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
            places = np.flatnonzero(wanted[near] == found)
        else:
            places = np.empty(0, int)
        for p in places.tolist():
            inside = np.flatnonzero(kinds[p : p + width]).tolist()
            slots = [{"at": i, "kind": _KINDS[kinds[p + i]], "value": template_word(words[p + i])[2]} for i in inside]
            out.append((key, p, int(found[p].view(np.int64)), width, slots))
    return out


_COLUMNS = ["id", "pos", "hash", "width", "slots"]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_COLUMNS)
    return frame.astype({"id": "Int64", "pos": "int32", "hash": "int64", "width": "int32"})


def _item_windows(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates()
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                rows += _rows(key, text, templates, size, None)
            yield _frame(rows)

    return run


def _doc_windows(widths: list[int], wanted):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, templates = None if wanted is None else wanted.value, Templates()
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                rows += _rows(key, text, templates, widths, known)
                if len(rows) > 20_000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return run


def agreeing(windows: list[dict]) -> list[dict]:
    """Of the windows of one alignment, those with the item's own values or by its most frequent mapping."""
    met = {(w["item_pos"] + p["at"], p["kind"], p["item"], p["doc"]) for w in windows for p in w["pairs"]}
    times = Counter((kind, item, doc) for _, kind, item, doc in met)
    best: dict[tuple[str, str], tuple[int, str | None]] = {}
    for (kind, item, doc), n in times.items():
        most, _ = best.get((kind, item), (0, None))
        if n >= most:
            best[kind, item] = (n, doc if n > most else None)
    out = []
    for w in windows:
        same = all(p["item"] == p["doc"] for p in w["pairs"])
        if same or all(best[p["kind"], p["item"]][1] == p["doc"] for p in w["pairs"]):
            out.append({"item_pos": w["item_pos"], "width": w["width"]})
    return out


def _agreeing(lines: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else agreeing(x) for x in lines], dtype=object)


def found_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    size: int = WINDOW, cover: float = COVER, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(doc_id, item_id) of every item found in a document, each pair once."""
    spark = docs.sparkSession
    bench = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).filter("id is not null")
    bench = materialize(bench.mapInPandas(_item_windows(size), SHAPE))
    lengths = bench.groupBy("id").agg(F.max(F.col("pos") + F.col("width")).alias("words"))
    widths = sorted(r.width for r in bench.select("width").distinct().collect())  # at most ``size`` values
    n = bench.count()
    small = n * 160 <= broadcast_bytes
    wanted = None
    if small:
        hashes = bench.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64)
        wanted = spark.sparkContext.broadcast(np.sort(hashes.view(_U)))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    met = source.mapInPandas(_doc_windows(widths, wanted), SHAPE)
    right = bench.select(F.col("id").alias("item"), F.col("pos").alias("item_pos"), "hash", "width", F.col("slots").alias("item_slots"))
    pairs = met.join(F.broadcast(right) if small else right, ["hash", "width"])
    values = F.zip_with("slots", "item_slots", lambda d, i: F.struct(i["at"].alias("at"), i["kind"].alias("kind"), i["value"].alias("item"), d["value"].alias("doc")))
    pairs = pairs.select("id", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "item_pos", "width", values.alias("pairs"))
    lines = pairs.groupBy("id", "item", "diagonal").agg(F.collect_set(F.struct("item_pos", "width", "pairs")).alias("windows"))
    mapped = F.array_distinct(F.flatten(F.transform("windows", lambda w: F.transform(w["pairs"], lambda p: F.struct(p["kind"], p["item"], p["doc"])))))
    keys = F.array_distinct(F.flatten(F.transform("windows", lambda w: F.transform(w["pairs"], lambda p: F.struct(p["kind"], p["item"])))))
    # only alignments in which a value meets two go through Python
    lines = lines.withColumn("mixed", F.when(F.size(mapped) > F.size(keys), F.col("windows")))
    picked = F.pandas_udf(_agreeing, "array<struct<item_pos:int,width:int>>")
    own = F.transform("windows", lambda w: F.struct(w["item_pos"].alias("item_pos"), w["width"].alias("width")))
    lines = lines.select("id", "item", F.when(F.col("mixed").isNull(), own).otherwise(picked("mixed")).alias("spans"))
    words = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["item_pos"], s["item_pos"] + s["width"] - 1))))
    covered = lines.select("id", "item", F.explode(words).alias("word")).groupBy("id", "item").agg(F.count_distinct("word").alias("hit"))
    length = lengths.select(F.col("id").alias("item"), "words")
    hits = covered.join(F.broadcast(length) if small else length, "item").filter(F.col("hit") >= cover * F.col("words"))
    return hits.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))


def marked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items and item_ids in order."""
    hits = found_items(docs, items, id_col, text_col, **settings).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    hits = materialize(hits.withColumnRenamed("doc_id", "hit_id"))
    rows = docs.select(F.col(id_col).alias("doc_id")).join(hits, F.col("doc_id") == F.col("hit_id"), "left")
    none = F.expr("cast(array() as array<bigint>)")
    return rows.select(
        "doc_id", F.col("ids").isNotNull().alias("contaminated"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("ids", none).alias("item_ids"),
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all columns; rows with a null id stay."""
    gone = materialize(found_items(docs, items, id_col, text_col, **settings).select(F.col("doc_id").alias("_leak_id")).distinct())
    return docs.join(gone, F.col(id_col) == F.col("_leak_id"), "left_anti")
