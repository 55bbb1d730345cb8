"""Chat formatting by quotation linking, with built-in functions only.

A line's quote level is the number of ``>`` among the blanks and ``>`` it starts with. Neighbouring
lines of one level above 0 make a quoted passage. A passage, its paragraphs and its longer lines are
normalised (A-Z lower-cased, white space to one blank) and hashed, and so are the own words of every
message. Within a conversation a quoted hash is joined to the first message that wrote it; a message
answers the one found at the lowest level, by the largest part, of several the latest. Chains of
answers are followed by doubling. What is left of a message is its own words: quoted lines and a line
that introduces them are taken out.

The joins run on (conversation, hash), so that neither a long conversation nor a common message is
one key, and the result is ordered over ranges of (conversation, thread, turn).

Cases: null and empty texts have an empty body and quote nothing. A message that quotes only itself,
later or unknown words starts a thread of its own. Rows that repeat (conversation, turn) are one
message for linking and stay separate rows. With a null conversation or turn nothing is linked. Other
columns are ignored. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislemetrics.llm.common import ascii_lower
from aislemetrics.session import materialize

LINE = 12  # least normalised characters of a single line that may link

# Ends of a line that introduces a quotation.
INTRODUCES = r"(?i)(wrote|writes|said|écrit|schrieb|escribió)\s*:\s*$"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(text), r"[\s]+", " "))


def _keys(text: Column) -> Column:
    """Distinct (rank, hash) of a text: 0 the whole, 1 its paragraphs, 2 its lines."""

    def hashed(parts: Column, rank: int, least: int) -> Column:
        useful = F.filter(F.transform(parts, normal), lambda t: F.char_length(t) >= least)
        return F.transform(useful, lambda t: F.struct(F.lit(rank).alias("rank"), F.md5(t).alias("hash")))

    return F.array_distinct(F.concat(
        hashed(F.array(text), 0, 1), hashed(F.split(text, r"\n[ \t]*\n"), 1, 1), hashed(F.split(text, "\n"), 2, LINE)
    ))


def parsed(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, role, body and passages: array of (level, text)."""
    rows = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"),
        F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n").alias("text"),
    )
    quoting = F.col("text").rlike(r"(?m)^[ \t]*>")
    lines = F.when(quoting, F.split("text", "\n", -1))
    lead = F.transform(lines, lambda t: F.regexp_extract(t, r"^[ \t>]*", 0))
    rows = rows.withColumn("lines", lines).withColumn("levels", F.transform(lead, lambda t: F.char_length(F.regexp_replace(t, "[^>]", ""))))
    rows = rows.withColumn("bare", F.transform("lines", lambda t: F.trim(F.regexp_replace(t, r"^[ \t>]*", ""))))
    at = F.sequence(F.lit(0), F.size("lines") - 1)

    def level(i: Column) -> Column:
        return F.coalesce(F.get("levels", i), F.lit(0))

    starts = F.filter(at, lambda i: (level(i) > 0) & (level(i) != level(i - 1)))
    ends = F.filter(at, lambda i: (level(i) > 0) & (level(i) != level(i + 1)))
    own = F.filter(at, lambda i: (level(i) == 0) & ~((level(i + 1) > 0) & F.get("lines", i).rlike(INTRODUCES)))
    rows = rows.withColumns({"starts": starts, "ends": ends, "own": own})
    passages = F.zip_with("starts", "ends", lambda s, e: F.struct(
        F.get("levels", s).alias("level"), F.array_join(F.slice("bare", s + 1, e - s + 1), "\n").alias("text")))
    body = F.when(quoting, F.array_join(F.transform("own", lambda i: F.get("lines", i)), "\n")).otherwise(F.col("text"))
    none = F.expr("cast(array() as array<struct<level:int,text:string>>)")
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    return rows.select("conv_id", "turn", "role", body.alias("body"), F.coalesce(passages, none).alias("passages"))


def _links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) of messages with a quotation whose source is known."""
    quotes = rows.filter(F.size("passages") > 0).select("conv_id", "turn", F.explode("passages").alias("p"))
    quotes = quotes.select("conv_id", "turn", F.col("p.level").alias("level"), F.explode(_keys(F.col("p.text"))).alias("k"))
    quotes = quotes.select("conv_id", "turn", "level", F.col("k.rank").alias("rank"), F.col("k.hash").alias("hash"))
    origins = rows.filter("body <> ''").select("conv_id", "turn", F.explode(_keys(F.col("body"))).alias("k"))
    origins = origins.groupBy("conv_id", F.col("k.hash").alias("hash")).agg(F.min("turn").alias("source"))
    met = quotes.join(origins, ["conv_id", "hash"]).filter("source < turn")
    best = F.min(F.struct("level", "rank", (-F.col("source")).alias("late")))
    links = met.groupBy("conv_id", "turn").agg(best.alias("best"), F.count_distinct("level", "hash").alias("n_linked"))
    return links.select("conv_id", "turn", (-F.col("best.late")).alias("reply_to"), "n_linked")


def _threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth): chains of answers are halved in every round."""
    up = materialize(links.select("conv_id", "turn", F.col("reply_to").alias("root_turn"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("moved")))
    while not up.filter("moved").isEmpty():
        above = up.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        joined = up.join(above, ["conv_id", "root_turn"], "left")
        up = materialize(joined.select(
            "conv_id", "turn", F.coalesce("next", "root_turn").alias("root_turn"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"),
        ))
    return up.select("conv_id", "turn", "root_turn", "depth")


def threads(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message, in reply order (conversation, thread, turn).

    conv_id, turn, role, body (own words), n_quotes, n_linked, reply_to (turn, null: none), root_turn,
    depth (0: starts a thread) and formatted (role tag and body).
    """
    rows = parsed(messages, conv, turn, role, text)
    links = materialize(_links(rows))
    on = ["conv_id", "turn"]
    out = rows.join(links, on, "left").join(_threads(links), on, "left")
    tag = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body"))
    return out.select(
        "conv_id", "turn", "role", "body", F.size("passages").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "reply_to", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), tag.alias("formatted"),
    ).orderBy("conv_id", "root_turn", "turn")
