"""Prefix trie of rebuilt conversations, by composable monoid fingerprints.

The fingerprint of a sequence of turns is, for three primes, the sum of e(i) x^i over its turns, where
e(i) comes from the SHA-256 of role and text. Such products form a monoid with (value, length):
segments of a conversation that lie in different tasks combine, and the fingerprint of any prefix of
a rebuilt conversation follows from three stored prefixes, that of the base's head, of the own turns
before the cut and of the own turns up to the place: head + (own - cut) x^shift. No rebuilt text is
ever made. Turns are sorted by ranges, so one huge conversation is spread over tasks, and at most one
conversation crosses each range border; these few segments are combined on the driver.

A row of ``members`` is a place in a rebuilt conversation and refers to the stored turn there. Rows of
one depth and fingerprint are a node. Each node is verified: all its rows must refer to turns of one
SHA-256 and have one parent; by induction over the depth their sequences are equal. If a node fails,
all is made anew with the next primes.

Figures of whole subtrees need no walk. A node belongs to its smallest member, and the nodes of a
conversation form the lower end of its path; a subtree is the rest of its owner's path and the whole
paths of all other members. So its sums are one aggregation over members.

Cases: null role and text count as empty, a null turn comes first, turns that repeat a number follow
the order of the SHA-256 of role and text (repeated rows count as often as they occur). Rows without
a conv_id belong to no conversation. A turnless rebuilt conversation is a member of the root only. A
conversation whose base is absent starts with its own turns after the cut. Long texts are hashed and
counted in the scan and never shuffled. Other columns are ignored. An empty table has no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetrics.functions.running import running_totals
from aislemetrics.llm.common import crc_mod, written

FAMILY = 20  # conversations that share the head of the first of them
HEADS = 4  # a head has fewer turns than this
WORD = r"[^\x20\x09-\x0D]+"
#: (primes, bases) of the fingerprints, tried in this order
RINGS = (
    ((2147483647, 2147483629, 2147483587), (1318699777, 911382323, 972663749)),
    ((2147483587, 2147483647, 2147483629), (1664525013, 1103515245, 1220703125)),
    ((2147483629, 2147483587, 2147483647), (742938285, 950706376, 1226874159)),
)
K = range(3)
NODE = ["depth", *[f"f{k}" for k in K]]
SHA = ["s0", "s1", "s2", "s3"]


def _powers(x: int, p: int, at: np.ndarray) -> np.ndarray:
    """x^at mod p of each place."""
    low = np.ones(4096, np.int64)
    for i in range(1, 4096):
        low[i] = low[i - 1] * x % p
    high, which = np.unique(at >> 12, return_inverse=True)
    steps = np.array([pow(x, int(h) << 12, p) for h in high], np.int64)
    return low[at & 4095] * steps[which] % p


_TURNS = pa.schema(
    [("conv", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("words", pa.int64())] + [(c, pa.int64()) for c in SHA]
    + [(f"{c}{k}", pa.int64()) for c in "fg" for k in K]
)


def _prefixes(ring):
    """Place of every turn in its range's part of the conversation, and the products up to it.

    ``f``: with the turn, ``g``: without it. Turns arrive in order; a conversation's place and
    products are carried from batch to batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, held, carry = None, 0, [0, 0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_numpy()
            sha = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(-1, 4)
            first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            length = np.diff(np.r_[first, len(conv)])
            goes_on = conv[0] == last
            at = np.arange(len(conv)) - np.repeat(first, length)
            if goes_on:
                at[: length[0]] += held
            f, g = [], []
            for k, (p, x) in enumerate(zip(*ring)):
                term = (sha[:, k] >> np.uint64(33)).astype(np.int64) % p * _powers(x, p, at) % p
                total = np.cumsum(term)  # below 2^63, as a batch has fewer than 2^32 rows
                before = np.repeat((total - term)[first], length)
                own = total - before
                if goes_on:
                    own[: length[0]] += carry[k]
                f.append(own % p)
                g.append((own - term) % p)
                carry[k] = int(f[-1][-1])
            last, held = conv[-1], int(at[-1]) + 1
            columns = [conv, np.full(len(conv), part), at, batch.column("words"), *sha.astype(np.int64).T, *f, *g]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], schema=_TURNS)

    return run


def _turns(conversations: DataFrame, ring) -> DataFrame:
    """conv, pos, words, SHA-256 and products of every turn, in the order of its conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sealed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    read = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.unhex(F.sha2(F.encode(sealed, "utf-8"), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = ["conv", "turn", "digest"]
    ranged = read.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} long" for f in _TURNS)
    local = written(ranged.select("conv", "digest", "words").mapInArrow(_prefixes(ring), schema))
    parts = local.groupBy("conv", "part").agg(F.count("*").alias("n"), *[F.max_by(f"f{k}", "at").alias(f"f{k}") for k in K])
    crossing = parts.groupBy("conv").agg(F.count("*").alias("parts")).filter("parts > 1")
    # a range border is crossed by one conversation at most: no more rows than twice the ranges
    segments = parts.join(crossing, "conv").orderBy("conv", "part").collect()
    starts, before = [], None
    for s in segments:
        if before is None or before[0] != s.conv:
            before = [s.conv, 0, 0, 0, 0]
        powers = [pow(x, before[1], p) for p, x in zip(*ring)]
        if before[1]:
            starts.append((s.conv, s.part, *before[1:], *powers))
        joined = [(before[2 + k] + powers[k] * s[f"f{k}"]) % ring[0][k] for k in K]
        before = [s.conv, before[1] + s.n, *joined]
    names = ["conv", "part", "skip", *[f"b{k}" for k in K], *[f"x{k}" for k in K]]
    starts = conversations.sparkSession.createDataFrame(starts, ", ".join(f"{n} long" for n in names))
    placed = local.join(F.broadcast(starts), ["conv", "part"], "left")

    def moved(c: str, k: int):
        return F.when(F.col("skip").isNull(), F.col(f"{c}{k}")).otherwise((F.col(f"b{k}") + F.col(f"x{k}") * F.col(f"{c}{k}")) % ring[0][k]).alias(f"{c}{k}")

    return placed.select("conv", (F.col("at") + F.coalesce("skip", F.lit(0))).alias("pos"), "words", *SHA, *[moved(c, k) for c in "fg" for k in K])


def _plans(turns: DataFrame, ring) -> DataFrame:
    """One row per conversation: how it is rebuilt, with the products that its prefixes need."""
    mark = F.struct("pos", "words", *SHA, *[f"{c}{k}" for c in "fg" for k in K])
    own = turns.groupBy("conv").agg(
        F.count("*").alias("turns"), F.sort_array(F.collect_list(F.when(F.col("pos") < HEADS - 1, mark))).alias("heads")
    )
    base = own.select(F.col("conv").alias("base"), F.col("heads").alias("base_heads"))
    cut = crc_mod(F.col("conv"), HEADS).cast("int")
    plans = own.withColumns({"base": F.col("conv") - F.col("conv") % FAMILY, "cut": cut}).join(base, "base", "left")
    taken = F.slice(F.coalesce("base_heads", F.array().cast(own.schema["heads"].dataType)), F.lit(1), F.col("cut"))
    plans = plans.withColumn("taken", taken).withColumn("n_taken", F.size("taken"))
    head, before = F.get("taken", F.col("n_taken") - 1), F.get("heads", F.col("cut") - 1)
    back = F.col("cut") - F.col("n_taken")
    for k, (p, x) in enumerate(zip(*ring)):
        shift = F.element_at(F.array(*[F.lit(pow(x, -i, p)) for i in range(HEADS)]), back + 1)
        plans = plans.withColumn(f"x{k}", shift)
        start, gone = F.coalesce(head[f"f{k}"], F.lit(0)), F.coalesce(before[f"f{k}"], F.lit(0))
        plans = plans.withColumn(f"b{k}", F.pmod(start - gone * F.col(f"x{k}") % p, F.lit(p)))
    length = F.col("n_taken") + F.greatest(F.col("turns") - F.col("cut"), F.lit(0))
    return plans.select("conv", "cut", "taken", "n_taken", length.alias("length"), *[f"{c}{k}" for c in "xb" for k in K])


def _members(turns: DataFrame, plans: DataFrame, ring) -> DataFrame:
    """Every place of every rebuilt conversation: conv, node, parent's products, words and SHA-256 of its turn."""
    rest = [*[f"{c}{k}" for c in "fg" for k in K], "words", *SHA]
    own = turns.join(plans.drop("taken"), "conv").filter("pos >= cut")
    depth = F.col("pos") - F.col("cut") + F.col("n_taken") + 1
    for k, p in enumerate(ring[0]):
        own = own.withColumns({f"{c}{k}": (F.col(f"{c}{k}") * F.col(f"x{k}") + F.col(f"b{k}")) % p for c in "fg"})
    own = own.select("conv", depth.alias("depth"), (depth == F.col("length")).alias("ends"), *rest)
    heads = plans.select("conv", "length", F.explode("taken").alias("t"))
    depth = F.col("t.pos") + 1
    heads = heads.select("conv", depth.alias("depth"), (depth == F.col("length")).alias("ends"), *[f"t.{c}" for c in rest])
    return own.unionByName(heads)


def _nodes(members: DataFrame) -> DataFrame:
    """One row per node, and whether all its members agree on the turn and on the parent."""
    proof = [f"g{k}" for k in K] + SHA
    same = F.lit(True)
    for c in proof:
        same &= F.col(f"lo_{c}") == F.col(f"hi_{c}")
    found = members.groupBy(*NODE).agg(
        F.min("conv").alias("owner"), F.count("*").alias("n"), F.sum(F.col("ends").cast("int")).alias("n_ends"), F.min("words").alias("words"),
        *[f(c).alias(f"{side}_{c}") for c in proof for side, f in (("lo", F.min), ("hi", F.max))],
    )
    return found.select(*NODE, "owner", "n", "n_ends", "words", *[F.col(f"lo_g{k}").alias(f"g{k}") for k in K], same.alias("same"))


_ENDS = pa.schema([(c, pa.int64()) for c in NODE] + [("ends_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, joined by commas; ids arrive in order and are never held."""
    node, state, out = None, None, []

    def table() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, _ENDS)], schema=_ENDS)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in NODE], 1)
        convs = batch.column("conv").to_pylist()
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]).tolist()
        for start, end in zip(first, [*first[1:], len(convs)]):
            ids, key = ",".join(map(str, convs[start:end])).encode(), keys[start].tolist()
            if key == node:
                state.update(b"," + ids)
                continue
            if node is not None:
                out.append((*node, state.hexdigest()))
            node, state = key, sha256(ids)
        yield table()
        out = []
    if node is not None:
        out.append((*node, state.hexdigest()))
    yield table()


def _ends(ending: DataFrame) -> DataFrame:
    sorted_ids = ending.repartition(*NODE).sortWithinPartitions(*NODE, "conv")
    return sorted_ids.mapInArrow(_digests, ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string")


def trie(conversations: DataFrame, rings: Sequence = RINGS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    for ring in rings:
        turns = written(_turns(conversations, ring))
        plans = written(_plans(turns, ring))
        members = written(_members(turns, plans, ring))
        nodes = written(_nodes(members))
        if nodes.filter("not same").isEmpty():
            return _figures(plans, members, nodes)
    raise RuntimeError("fingerprints of different prefixes met under all rings")


def _figures(plans: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    saved = (F.col("n") - 1) * F.col("words")
    # running sums along each owner's path, which may be as long as the longest conversation
    paths = running_totals(nodes, ["depth"], {"saved": saved, "place": F.lit(1), "leaf": (F.col("n") == F.col("n_ends")).cast("int")}, by=["owner"])
    paths = written(paths)
    owners = paths.filter("place_running = 1").select(F.col("owner").alias("conv"), "saved_total", "leaf_total")
    below = members.select("conv", *NODE).join(owners, "conv").groupBy(*NODE)
    below = below.agg(F.sum("saved_total").alias("saved"), F.sum("leaf_total").alias("leaves"))
    # what lies above the node on its owner's path
    above = paths.select(*NODE, "owner", "n", (saved - F.col("saved_running")).alias("saved"))
    parents = F.struct((F.col("depth") - 1).alias("depth"), *[F.col(f"g{k}").alias(f"f{k}") for k in K]).alias("p")
    children = paths.filter("depth > 1").select(parents).select("p.*").groupBy(*NODE).agg(F.count("*").alias("children"))
    # below its top a path's parents are its own
    tops = paths.filter("place_running = 1 and depth > 1").select(F.col("depth").alias("d"), *[F.col(c).alias(f"of_{c}") for c in NODE[1:]], parents)
    up = nodes.select(F.struct(*NODE).alias("p"), F.col("owner").alias("parent")).join(tops, "p")
    up = up.select(F.col("d").alias("depth"), *[F.col(f"of_{c}").alias(c) for c in NODE[1:]], "parent")
    ends = _ends(members.filter("ends").select(*NODE, "conv"))
    parts = above
    for more in (below, children, up, ends):
        parts = parts.unionByName(more, allowMissingColumns=True)
    nothing = F.lit(sha256(b"").hexdigest())
    every = parts.groupBy(*NODE).agg(
        F.max("owner").alias("conv_id"), F.max("parent").alias("parent"), F.max("n").alias("n_convs"), F.sum("children").alias("children"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.coalesce(F.max("ends_sha256"), nothing).alias("ends_sha256"),
    )
    first = plans.agg(F.min("conv").alias("first"))
    top = first.select("first").scalar()
    parent = F.when(F.col("depth") == 1, top).otherwise(F.coalesce("parent", "conv_id"))
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner = every.withColumns({"parent_conv_id": parent, "n_children": F.coalesce("children", F.lit(0))})
    inner = inner.select("conv_id", F.col("depth").cast("long"), "parent_conv_id", *[F.col(c).cast("long") for c in figures], "ends_sha256")

    whole = plans.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    sums = owners.agg(F.sum("saved_total").alias("saved_tokens"), F.sum("leaf_total").alias("n_leaves"))
    kids = nodes.filter("depth = 1").agg(F.count("*").alias("n_children"))
    no_turns = _ends(plans.filter("length = 0").select(F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in NODE[1:]], "conv"))
    value = {c: F.coalesce(f.select(c).scalar(), F.lit(other)) for f, c, other in ((sums, "saved_tokens", 0), (sums, "n_leaves", 1), (kids, "n_children", 0))}
    root = whole.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        *[value[c].cast("long").alias(c) for c in figures[1:]], F.coalesce(no_turns.select("ends_sha256").scalar(), nothing).alias("ends_sha256"),
    )
    return root.unionByName(inner)
