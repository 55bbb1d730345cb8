"""URL filter: rules, and for all other URLs a character language-model ratio.

Two variable-order Markov models over characters are fitted, one on accepted and one on rejected
URLs. A character's probability interpolates all orders from 0 to ``ORDER`` by Witten-Bell smoothing,
so an order unknown in a context hands over to the next shorter one. A URL's figure is the difference
of its log-likelihoods per character. Two numbers fitted on labelled URLs left out of the models turn
it into a probability of acceptance; at one half or more the URL is accepted.

Labels are what the rules say. Every different labelled URL counts: four fifths by hash are counted, all
others calibrate. Tasks count characters after contexts, aggregations add these counts and fold them into
tables of a fixed number of hashed places, which bounds what is broadcast (33 MB) whatever the URLs. Contexts
that share a place share its counts. Every URL is judged in place, without a shuffle.

Cases: a null URL and one without ``://`` have an empty host and path, no rule and a figure of 0
before calibration. Repeated URLs and ids are judged alike. Columns named like a result are replaced. With one kind of labels only, all other
URLs get that verdict; without labels they are allowed. Other columns pass through.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislemetrics.llm.common import LOWER, UPPER
from aislemetrics.session import materialize

ORDER = 5
CONTEXTS = 1 << 20  # places for contexts, and for characters after them
PAIRS = 1 << 21
PORTION = 1 << 18  # characters handled at once
DIGITS = 4  # of a figure, when figures are counted for the calibration
_U = np.uint64


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule: str) -> Column:
    """A rule is a domain, a slash and the start of a path: ``example.org/en/1``."""
    domain, _, rest = rule.partition("/")
    return ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)


def best_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits; of equally long ones the first in alphabetical order."""
    order = sorted(rules, key=lambda r: (-len(r), r))
    return F.coalesce(F.lit(None).cast("string"), *[F.when(fits(host, path, r), F.lit(r)) for r in order])


@dataclass
class CharModel:
    """Counts of characters after contexts of every order up to ``order``."""

    order: int = ORDER
    counts: dict[str, dict[str, int]] = field(default_factory=dict)
    totals: dict[str, int] = field(default_factory=dict)
    alphabet: int = 256

    def fit(self, texts: list[str]) -> CharModel:
        table: dict[str, Counter[str]] = defaultdict(Counter)
        for t in texts:
            padded = "\x02" * self.order + t + "\x03"
            for i in range(self.order, len(padded)):
                for k in range(self.order + 1):
                    table[padded[i - k : i]][padded[i]] += 1
        self.counts = {c: dict(n) for c, n in table.items()}
        self.totals = {c: sum(n.values()) for c, n in self.counts.items()}
        return self

    def probability(self, context: str, char: str) -> float:
        p = 1 / self.alphabet
        for k in range(len(context) + 1):
            after = self.counts.get(context[len(context) - k :])
            if after is None:
                break
            n, kinds = self.totals[context[len(context) - k :]], len(after)
            p = (after.get(char, 0) + kinds * p) / (n + kinds)
        return p

    def log_likelihood(self, text: str) -> float:
        padded = "\x02" * self.order + text + "\x03"
        return sum(math.log(self.probability(padded[i - self.order : i], padded[i])) for i in range(self.order, len(padded)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def portions(urls: list[str]) -> Iterator[list[str]]:
    """The URLs in order, in lists of about ``PORTION`` characters."""
    out, size = [], 0
    for u in urls:
        out.append(u)
        size += len(u)
        if size >= PORTION:
            yield out
            out, size = [], 0
    if out:
        yield out


def grams(urls: list[str], order: int = ORDER) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashes of the context, and of it with the character, for each order and character; where each URL begins."""
    text = "".join("\x02" * order + u + "\x03" for u in urls)
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U) + _U(1)
    ends = np.cumsum([len(u) + order + 1 for u in urls])
    inside = np.ones(len(x), bool)
    for i in range(order):
        inside[np.concatenate([[0], ends[:-1]]) + i] = False
    at = np.flatnonzero(inside)
    contexts, pairs, held = [], [], np.zeros(len(at), _U)
    for k in range(order + 1):
        if k:
            held = held + x[at - k] * _U(pow(0x9E3779B97F4A7C15, k, 1 << 64))
        contexts.append(_mix(held + _U((k + 1) * 0xD1B54A32D192ED03 % (1 << 64))))
        pairs.append(_mix(contexts[-1] * _U(0xF1357AEA2E62A9C5) + x[at]))
    return contexts, pairs, np.concatenate([[0], np.cumsum([len(u) + 1 for u in urls])[:-1]])


def counted(urls: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, pair, times) of the URLs, by their hashes."""
    contexts, pairs, _ = grams(urls, order)
    pair, first, n = np.unique(np.concatenate(pairs), return_index=True, return_counts=True)
    return np.concatenate(contexts)[first].view(np.int64), pair.view(np.int64), n


class HashedModel:
    """:class:`CharModel` with counts in hashed places: 0 to ``CONTEXTS`` for contexts, the others for pairs."""

    def __init__(self, order: int = ORDER, alphabet: int = 256):
        self.order, self.alphabet = order, alphabet
        self.n, self.kinds = np.zeros(CONTEXTS + PAIRS, np.float32), np.zeros(CONTEXTS, np.float32)

    def put(self, place: np.ndarray, n: np.ndarray, kinds: np.ndarray) -> HashedModel:
        self.n[place] = n
        first = place < CONTEXTS
        self.kinds[place[first]] = kinds[first]
        return self

    def fit(self, urls: list[str]) -> HashedModel:
        rows = [np.concatenate(x) for x in zip(*(counted(p, self.order) for p in portions(urls)))]
        if rows:
            pair, first, inverse = np.unique(rows[1], return_index=True, return_inverse=True)
            n, context = np.bincount(inverse, rows[2]), rows[0][first]
            self.n += np.bincount(context & (CONTEXTS - 1), n, CONTEXTS + PAIRS) + np.bincount(CONTEXTS + (pair & (PAIRS - 1)), n, CONTEXTS + PAIRS)
            self.kinds += np.bincount(context & (CONTEXTS - 1), minlength=CONTEXTS)
        return self

    def log_likelihoods(self, contexts: list[np.ndarray], pairs: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
        p, known = np.full(len(contexts[0]), 1 / self.alphabet), np.ones(len(contexts[0]), bool)
        for context, pair in zip(contexts, pairs):
            place = (context & _U(CONTEXTS - 1)).astype(np.int64)
            n, kinds = self.n[place].astype(float), self.kinds[place].astype(float)
            known &= n > 0
            times = np.minimum(self.n[CONTEXTS + (pair & _U(PAIRS - 1)).astype(np.int64)], n)
            p = np.where(known, (times + kinds * p) / np.maximum(n + kinds, 1), p)
        return np.add.reduceat(np.log(p), starts)


def _platt(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, with a small ridge."""
    w = np.zeros(2)
    a = np.column_stack([x, np.ones_like(x)])
    times = np.ones_like(x) if times is None else times
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (times * (p - y)) + 1e-2 * w
        hess = (a * (times * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


@dataclass
class Ratio:
    accepted: HashedModel
    rejected: HashedModel
    slope: float = 1.0
    offset: float = 0.0

    def figures(self, urls: list[str | None]) -> np.ndarray:
        """Log-likelihood difference per character; 0 for null and empty."""
        out, full = np.zeros(len(urls)), [i for i, u in enumerate(urls) if u]
        done = 0
        for part in portions([urls[i] for i in full]):
            found = grams(part, self.accepted.order)
            more = self.accepted.log_likelihoods(*found) - self.rejected.log_likelihoods(*found)
            out[full[done : done + len(part)]] = more / (np.array([len(u) for u in part]) + 1)
            done += len(part)
        return out

    def figure(self, url: str | None) -> float:
        return float(self.figures([url])[0])

    def probability(self, figure):
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(figure) + self.offset, -30, 30)))


def _one_kind(labels: bool) -> Ratio:
    """With one kind of labels only that verdict; without labels all are allowed."""
    return Ratio(HashedModel(), HashedModel(), 0.0, 30.0 if labels else -30.0)


def train(accepted: list[str], rejected: list[str]) -> Ratio:
    """Models on four fifths of the URLs, the calibration on the rest."""
    if not accepted or not rejected:
        return _one_kind(bool(accepted) or not rejected)
    held = [accepted[::5], rejected[::5]]
    fit = [[u for i, u in enumerate(x) if i % 5] or x for x in (accepted, rejected)]
    ratio = Ratio(HashedModel().fit(fit[0]), HashedModel().fit(fit[1]))
    x = np.concatenate([ratio.figures(part) for part in held])
    y = np.array([1.0] * len(held[0]) + [0.0] * len(held[1]))
    ratio.slope, ratio.offset = _platt(x, y)
    return ratio


def _figures(ratio: Ratio, spark: SparkSession):
    """A function from a URL column to its figures."""
    shared = spark.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def figure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            code, urls = pd.factorize(batch.fillna(""))
            yield pd.Series(shared.value.figures(list(urls))[code], dtype="float64")

    return figure


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(v, context, pair, n) of the URLs of a task, portion by portion."""
    for batch in batches:
        for v, part in batch.groupby("v")["u"]:
            for urls in portions(part.tolist()):
                context, pair, n = counted(urls)
                yield pd.DataFrame({"v": v, "context": context, "pair": pair, "n": n})


def train_on(labelled: DataFrame) -> Ratio:
    """:func:`train` on all rows (u, v) of a table: different URLs and ``allow`` or ``block``.

    The driver gets the places of the tables and how often a figure of ``DIGITS`` digits occurs, both bounded.
    """
    spark = labelled.sparkSession
    held = F.pmod(F.xxhash64("u"), F.lit(5)) == 0
    labelled = materialize(labelled.select("u", "v", held.alias("held")))
    sizes = {r.v: (r.held, r.n - r.held) for r in labelled.groupBy("v").agg(F.count_if("held").alias("held"), F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return _one_kind("block" not in sizes)
    # a kind too small for both parts serves in both
    fits = F.lit(False)
    tests = F.lit(False)
    for v, (n_held, n_fit) in sizes.items():
        fits |= (F.col("v") == v) & (F.lit(not n_fit) | ~F.col("held"))
        tests |= (F.col("v") == v) & (F.lit(not n_held) | F.col("held"))
    pairs = labelled.filter(fits).select("u", "v").mapInPandas(_counts, "v string, context long, pair long, n long")
    pairs = pairs.groupBy("v", "context", "pair").agg(F.sum("n").alias("n"))
    context, pair = F.col("context").bitwiseAND(F.lit(CONTEXTS - 1)), F.col("pair").bitwiseAND(F.lit(PAIRS - 1)) + CONTEXTS
    both = F.array(
        F.struct(context.cast("int").alias("place"), "n", F.lit(1).alias("kinds")), F.struct(pair.cast("int").alias("place"), "n", F.lit(0).alias("kinds"))
    )
    places = pairs.select("v", F.inline(both)).groupBy("v", "place").agg(F.sum("n").cast("float").alias("n"), F.sum("kinds").cast("float").alias("kinds"))
    models = {}
    for v in ("allow", "block"):
        found = places.filter(F.col("v") == v).select("place", "n", "kinds").toArrow()
        models[v] = HashedModel().put(*(found.column(c).to_numpy() for c in ("place", "n", "kinds")))
    ratio = Ratio(models["allow"], models["block"])
    figure = F.round(_figures(ratio, spark)("u"), DIGITS).alias("figure")
    found = labelled.filter(tests).select("v", figure).groupBy("v", "figure").agg(F.count("*").alias("n")).toArrow().to_pandas()
    found = found.sort_values(["v", "figure"])
    ratio.slope, ratio.offset = _platt(found["figure"].to_numpy(), (found["v"] == "allow").to_numpy(float), found["n"].to_numpy(float))
    return ratio


def judged(pages: DataFrame, allow: list[str], block: list[str], url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, figure, p_allow and verdict."""
    rules = {r: "allow" for r in allow} | {r: "block" for r in block}
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule = best_rule(host, path, rules)
    says = F.coalesce(F.lit(None).cast("string"), *[F.when(rule == r, F.lit(v)) for r, v in rules.items()])

    labelled = pages.select(F.col(url_col).alias("u"), says.alias("v")).filter("v is not null and u is not null").distinct()
    ratio = train_on(labelled)
    figure = _figures(ratio, pages.sparkSession)
    chance = 1 / (1 + F.exp(-(F.lit(ratio.slope) * F.col("figure") + F.lit(ratio.offset))))
    out = pages.withColumns({"host": host, "path": path, "rule": rule, "figure": figure(F.col(url_col))})
    out = out.withColumn("p_allow", chance)
    by_rule = F.coalesce(F.lit(None).cast("string"), *[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()])
    return out.withColumn("verdict", F.coalesce(by_rule, F.when(F.col("p_allow") >= 0.5, "allow").otherwise("block")))
