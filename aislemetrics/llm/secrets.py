"""Secret scan with built-in functions only: patterns, and sliding-window entropy of candidate strings.

Patterns give the base spans. Every match is extracted together with the text before it, so that
running sums of the lengths give the positions.

The method adds spans. A candidate is a run of key characters. A window slides over it; the counts of
its characters are kept by adding the entering and taking off the leaving one, and the entropy follows
from sum(c * log2 c), updated for just these two counts. Candidates made of hexadecimal digits and of
the full alphabet have thresholds of their own. Windows of high entropy that touch or overlap make one part, which is a span unless it is the value of a base span. Candidates that are
words, paths or numbers are passed over, and so are parts that are, or that hold a placeholder.

Cases: null and empty texts have no spans. Offsets are code points, ends exclusive. Equal spans of
different kinds are all kept, ordered by start, then kind. Rows are independent: repeated rows, null
or repeated ids need no rule. Of the input only id and text are used, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")

# The three base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN_VALUE = r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

CANDIDATE = r"[A-Za-z0-9+/_=-]+"
WINDOW = 20
SHORTEST = WINDOW  # characters of a candidate; with shorter ones most texts would have candidates
HEX_BITS, TEXT_BITS = 3.0, 3.7  # for a whole window
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Strings of these forms are no secrets: one kind of letters only, numbers, words and paths, UUIDs.
PLAIN = (
    r"^[A-Z]?[a-z/_=-]+$",
    r"^[A-Z/_=-]+$",
    r"^[0-9/_=+-]+$",
    r"^([A-Z]?[a-z]+[/_=-])*[A-Z]?[a-z]+[0-9]{0,4}$",
    r"^([A-Z][a-z]+)+[0-9]{0,4}$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
#: Nor are parts that hold one of these: placeholders, long repeats.
FILLED = (
    r"(?i)example|sample|placeholder|changeme|your_|dummy|xxxx|0000000|1234567|abcdefg",
    r"(.)\1{5,}",
)


SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, kind: int, value: str, least: int, lead: str = "") -> Column:
    """(start, kind, end, value) of the leftmost non-overlapping matches whose value has ``least`` characters.

    Each match is taken with the text before it; ``\\G`` keeps the pass linear after the last one.
    """
    pattern = F.lit(rf"(?s)\G.*?({lead}({value}))")
    whole, match, inner = (F.regexp_extract_all(text, pattern, F.lit(k)) for k in (0, 1, 2))
    parts = F.arrays_zip(whole.alias("w"), match.alias("m"), inner.alias("v"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPANS})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.char_length(x["w"])
        span = F.struct((end - F.char_length(x["m"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["v"].alias("value"))
        grown = F.when(F.char_length(x["v"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), grown.alias("out"))

    # most texts have no match: a plain search tells before anything is extracted
    bare = value.removeprefix("AKIA")
    met = text.rlike(lead + value.removesuffix(bare) + bare[:-1] + "{%d,}" % (least - len(value) + len(bare)))
    return F.when(met, F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(F.expr(f"cast(array() as {SPANS})"))


def _c_log_c(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def high_runs(codes: Column, window: Column, bar: Column) -> Column:
    """Runs (start, end) of an array of codes 1..len(ALPHABET) that windows of at least ``bar`` bits a character cover.

    ``codes``, ``window`` and ``bar`` should be columns or lambda variables, since each step looks into them.
    """
    runs = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), runs.alias("runs"))

    def step(acc: Column, i: Column) -> Column:
        enter = F.get(codes, i)
        leave = F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(0))
        more, less = F.get(acc["counts"], enter - 1), F.get(acc["counts"], leave - 1)
        gain = _c_log_c(more + 1) - _c_log_c(more) + F.when(leave > 0, _c_log_c(less - 1) - _c_log_c(less)).otherwise(F.lit(0.0))
        total = acc["total"] + F.when(enter == leave, F.lit(0.0)).otherwise(gain)
        counts = F.transform(
            acc["counts"], lambda c, k: c + F.when(k == enter - 1, 1).otherwise(0) - F.when(k == leave - 1, 1).otherwise(0)
        )
        # the slack keeps rounding of the running sum from deciding
        high = (i >= window - 1) & (F.log2(window.cast("double")) - total / window >= bar - 1e-9)
        last = F.get(acc["runs"], F.size(acc["runs"]) - 1)
        goes_on = last.isNotNull() & (last["end"] >= i - window + 1)
        new = F.array(F.struct(F.when(goes_on, last["start"]).otherwise(i - window + 1).alias("start"), (i + 1).alias("end")))
        kept = F.when(goes_on, F.slice(acc["runs"], F.lit(1), F.size(acc["runs"]) - 1)).otherwise(acc["runs"])
        return F.struct(counts.alias("counts"), total.alias("total"), F.when(high, F.concat(kept, new)).otherwise(acc["runs"]).alias("runs"))

    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: acc["runs"])


def _is_none_of(value: Column, forms: tuple[str, ...]) -> Column:
    free = F.lit(True)
    for form in forms:
        free &= ~value.rlike(form)
    return free


def _suspicious(candidates: Column, base: Column) -> Column:
    """The parts of high entropy of the candidates that are no plain strings, placeholders or values of base spans."""

    def coded(c: Column) -> Column:
        codes = F.transform(F.split(c["value"], ""), lambda x: F.instr(F.lit(ALPHABET), x))
        window = F.least(F.lit(WINDOW), F.char_length(c["value"]))
        bits = F.when(c["value"].rlike("^[0-9a-fA-F]+$"), F.lit(HEX_BITS)).otherwise(F.lit(TEXT_BITS))
        return F.struct(c.alias("span"), codes.alias("codes"), window.alias("window"), (bits * F.log2(window.cast("double")) / F.log2(F.lit(float(WINDOW)))).alias("bar"))

    def parts(x: Column) -> Column:
        def part(run: Column) -> Column:
            value = F.substring(x["span"]["value"], run["start"] + 1, run["end"] - run["start"])
            at = x["span"]["start"]
            return F.struct((at + run["start"]).alias("start"), x["span"]["kind"].alias("kind"), (at + run["end"]).alias("end"), value.alias("value"))

        return F.transform(high_runs(x["codes"], x["window"], x["bar"]), part)

    def own(p: Column) -> Column:
        known = F.exists(base, lambda b: (b["end"] == p["end"]) & (b["end"] - F.char_length(b["value"]) == p["start"]))
        return ~known & _is_none_of(p["value"], PLAIN + FILLED)

    unknown = F.filter(candidates, lambda c: _is_none_of(c["value"], PLAIN))
    return F.filter(F.flatten(F.transform(F.transform(unknown, coded), parts)), own)


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans, arrays of (start, kind, end, value) in order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    base = F.concat(
        _spans(text, 0, ASSIGN_VALUE, 6, ASSIGN), _spans(text, 1, ACCESS, 20), _spans(text, 2, HEX, 24)
    )
    rows = rows.select("doc_id", F.array_sort(base).alias("base"), _spans(text, 3, CANDIDATE, SHORTEST).alias("candidates"))
    spans = F.array_sort(F.concat("base", _suspicious(F.col("candidates"), F.col("base"))))
    return rows.select("doc_id", "base", spans.alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of spans in their order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
