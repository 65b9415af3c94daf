r"""Chat formatting: conversations to one text with a loss mask, and back.  DataFrame functions only.

The template: adjacent turns of one role are a block, ``<turn>role<text>first<part>second</turn>`` and a
line end.  Every mark begins with ``<``, which no escaped text or role has: a backslash becomes ``\b``,
a ``<`` becomes ``\l``.  So reading back is exact, turn by turn, whatever the texts say.

The loss mask is the UTF-8 byte ranges of the assistant's escaped texts in the formatted text, in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, PART, END = "<turn>", "<text>", "<part>", "</turn>\n"
#: Prefix sums are taken in blocks of so many elements, as an array that grows is copied at every step.
SUM_BLOCK = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not at every place that names it."""
    return F.transform(F.array(value), body)[0]


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _zero() -> Column:
    return F.lit(0).cast("long")


def _sums(xs: Column) -> Column:
    """For each element the sum of those before it."""
    start = F.struct(_zero().alias("sum"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
    return F.aggregate(xs, start, step, lambda acc: acc["out"])


def sums_before(xs: Column) -> Column:
    """As ``_sums``, of long arrays block by block."""
    total = lambda b: F.aggregate(b, _zero(), lambda acc, x: acc + x)
    starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(SUM_BLOCK))
    blocks = F.transform(starts, lambda s: F.slice(xs, s, SUM_BLOCK))
    return _let(
        blocks,
        lambda bs: _let(
            _sums(F.transform(bs, total)),
            lambda before: F.flatten(F.transform(bs, lambda b, k: F.transform(_sums(b), lambda x: x + F.get(before, k)))),
        ),
    )


def merge_turns(turns: Column) -> Column:
    """Blocks of adjacent turns with one role: array<struct<role, texts>>."""
    n = F.size(turns)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    heads = F.filter(places, lambda k: (k == 0) | ~F.get(turns, k)["role"].eqNullSafe(F.get(turns, k - 1)["role"]))
    block = lambda h, k, hs: F.struct(
        F.get(turns, h)["role"].alias("role"),
        F.transform(F.slice(turns, h + 1, F.coalesce(F.get(hs, k + 1), n) - h), lambda t: t["text"]).alias("texts"),
    )
    return _let(heads, lambda hs: F.transform(hs, lambda h, k: block(h, k, hs)))


def format_conversations(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: ``formatted`` and ``loss``, the byte ranges (start, length) that a model learns.

    Turns stand in the order of their number, null numbers first; equal numbers by escaped role and text, so that
    repeated rows give the same text on every run, and each of them stays a turn.  Null roles and texts
    count as empty.  Rows without a conversation id are one conversation without id.  A conversation is
    one text, so it has to fit a row; texts are escaped and measured before they are gathered.  Other
    columns are ignored.  An empty table gives no rows.
    """
    text = lambda c: escape(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    turns = rows.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    blocks = gathered.select("conv_id", merge_turns(F.col("turns")).alias("blocks"))
    # a piece is a mark and the text behind it; pieces with a loss are the assistant's texts
    piece = lambda mark, body, loss: F.struct(mark.alias("mark"), body.alias("body"), loss.alias("loss"))
    parts = lambda b: F.transform(
        b["texts"],
        lambda t, k: piece(F.when(k == 0, F.concat(F.lit(TURN), b["role"], F.lit(TEXT))).otherwise(F.lit(PART)), t, b["role"] == escape(F.lit(loss_role))),
    )
    close = piece(F.lit(END), F.lit(""), F.lit(False))
    pieces = blocks.select("conv_id", F.flatten(F.transform("blocks", lambda b: F.concat(parts(b), F.array(close)))).alias("pieces"))
    size = lambda c: F.octet_length(c).cast("long")
    before = sums_before(F.transform("pieces", lambda p: size(p["mark"]) + size(p["body"])))
    span = lambda p, at: F.struct((at + size(p["mark"])).alias("start"), size(p["body"]).alias("length"), p["loss"].alias("loss"))
    spans = F.filter(F.zip_with("pieces", before, span), lambda s: s["loss"])
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["body"])), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, in order: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, TURN), lambda b: b != "")
    head = lambda b: unescape(F.substring_index(b, TEXT, 1))
    body = lambda b: F.replace(F.substring_index(b, TEXT, -1), F.lit(END), F.lit(""))
    turns = lambda b: _let(head(b), lambda role: F.transform(F.split(body(b), PART), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))))
    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between its ranges."""
    cut = lambda all_: F.transform(loss, lambda s: unescape(F.decode(F.substring(all_, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8")))
    return F.array_join(_let(F.encode(formatted, "UTF-8"), cut), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations finds: turns, text under the mask, lengths."""
    turns = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(spelled, "UTF-8"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.encode("learned", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
