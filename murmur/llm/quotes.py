"""Quotation linking: messages to what they quote, and conversations without quotes.

Lines that begin with ``>`` marks are quotes; the marks count the level. Lines of
one level in a row are a passage. Passages and their single lines are normalised
(case, white space, marks) and hashed; a quoted hash is joined to the earliest
message of the conversation whose own words have it, if that came before. A
message replies to the original that holds most of its first-level quoted
characters (ties: the latest). Deeper levels count as links, not for the reply.

Replies form trees; every message gets its tree's first message and its depth by
pointer doubling, a logarithmic number of joins however long a chain is. Rows
come in conversation, tree, and turn order; a reply's turn is always after the
turn it replies to, so that is a reply order.

Originals are minima by (conversation, hash) and combine before they are shuffled;
each quote meets at most one of them, so common lines make no pairs. Rows that
share a conversation and turn are one message as a target, and each keeps its own
row. Null text is empty; null conversation or turn is kept, and never linked. The
text without quotes is null where the text is null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import small_batches
from murmur.session import materialise

_MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
#: The line that mail programs put before a quote.
_INTRODUCES = re.compile(r"^.{0,200}(?:wrote|schrieb|a écrit|escribió)\s*:\s*$")
#: Rounds of pointer doubling: chains of up to 2**ROUNDS messages.
ROUNDS = 40

PARSED = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("message", pa.string()), ("depth_of_quotes", pa.int32()),
     ("passages", pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.string()), ("chars", pa.int64())])))]
)
PARSED_DDL = (
    "conv_id long, turn long, role string, message string, depth_of_quotes int, "
    "passages array<struct<level:int,hash:string,chars:long>>"
)


def level_of(line: str) -> tuple[int, str]:
    """Number of quote marks, and the line without them."""
    found = _MARKS.match(line)
    return (found[1].count(">"), line[found.end() :]) if found else (0, line)


def digest(text: str) -> tuple[str, int] | None:
    """Hash and length of a normalised passage; None if it has no word."""
    normal = " ".join(text.casefold().split())
    return (hashlib.md5(normal.encode()).hexdigest(), len(normal)) if normal else None


def parse(text: str | None) -> tuple[str | None, int, list[dict]]:
    """Own words, deepest level, and hashed passages and lines of every level."""
    if text is None:
        return None, 0, []
    lines = [level_of(line) for line in text.split("\n")]
    for i, (level, line) in enumerate(lines[:-1]):
        if level == 0 and lines[i + 1][0] > 0 and _INTRODUCES.match(line):
            lines[i] = (lines[i + 1][0], "")
    runs: list[tuple[int, list[str]]] = []
    for level, line in lines:
        if runs and runs[-1][0] == level:
            runs[-1][1].append(line)
        else:
            runs.append((level, [line]))
    passages = {}
    for level, run in runs:
        for part in ["\n".join(run), *run]:
            found = digest(part)
            if found:
                passages[level, found[0]] = found[1]
    own = "\n".join(line for level, line in lines if level == 0).strip()
    return own, max(level for level, _ in lines), [
        {"level": k[0], "hash": k[1], "chars": v} for k, v in passages.items()
    ]


def parsed(messages: DataFrame) -> DataFrame:
    small_batches(messages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [parse(t) for t in rows.column("text").to_pylist()]
            columns = [rows.column("conv_id"), rows.column("turn"), rows.column("role")]
            for i, field in enumerate(list(PARSED)[3:]):
                columns.append(pa.array([f[i] for f in found], type=field.type))
            yield pa.RecordBatch.from_arrays(columns, schema=PARSED)

    return messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, PARSED_DDL)


def links(read: DataFrame) -> DataFrame:
    """(conv_id, turn, level, original, chars): quoted characters by original message."""
    passages = read.where("conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.explode("passages").alias("p")
    ).select("conv_id", "turn", "p.level", "p.hash", "p.chars")
    originals = passages.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    return (
        passages.where("level > 0")
        .join(originals, ["conv_id", "hash"])
        .where("original < turn")
        .groupBy("conv_id", "turn", "level", "original")
        .agg(F.sum("chars").alias("chars"))
    )


def trees(replies: DataFrame, name: str = "quotes") -> DataFrame:
    """(conv_id, turn, root, depth) from (conv_id, turn, reply_to), by pointer doubling.

    ``replies`` is read in several places; pass one that is stored.
    """
    state = replies.select(
        "conv_id", "turn", F.coalesce("reply_to", "turn").alias("root"),
        F.col("reply_to").isNotNull().cast("long").alias("depth"),
        F.col("reply_to").isNull().alias("done"),
    )
    for _ in range(ROUNDS):
        if state.where("not done").limit(1).count() == 0:
            return state.drop("done")
        above = state.select(
            "conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ended")
        )
        # messages that know their tree's first one need no join
        state = materialise(
            state.where("not done").join(above, ["conv_id", "root"]).select(
                "conv_id", "turn", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ended").alias("done")
            ).union(state.where("done")),
            f"{name}-tree",
        )
    raise RuntimeError("reply chains did not settle")


def conversations(messages: DataFrame) -> DataFrame:
    """Every message without quotes: ``reply_to``, ``thread``, ``depth`` and links, in reply order.

    Columns: conv_id, turn, role, reply_to, thread, depth, quoted_messages,
    quoted_chars, unmatched_levels (quote levels without a link), text.
    """
    read = materialise(parsed(messages), "quotes-parsed")
    # a set is no larger than the message: one link at most for each of its passages
    by_message = links(read).groupBy("conv_id", "turn").agg(
        F.max_by("original", F.when(F.col("level") == 1, F.struct("chars", "original"))).alias("reply_to"),
        F.size(F.collect_set("original")).alias("quoted_messages"),
        F.sum("chars").alias("quoted_chars"),
        F.size(F.collect_set("level")).alias("levels"),
    )
    known = read.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    linked = materialise(known.join(by_message, ["conv_id", "turn"], "left"), "quotes-linked")
    placed = trees(linked).join(linked, ["conv_id", "turn"])
    return (
        read.join(placed, ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", "role", "reply_to",
            F.coalesce("root", "turn").alias("thread"),
            F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
            F.coalesce("quoted_messages", F.lit(0)).cast("long").alias("quoted_messages"),
            F.coalesce("quoted_chars", F.lit(0)).cast("long").alias("quoted_chars"),
            (F.size(F.array_distinct(F.transform(F.filter("passages", lambda p: p["level"] > 0), lambda p: p["level"]))) - F.coalesce("levels", F.lit(0))).cast("long").alias("unmatched_levels"),
            F.col("message").alias("text"),
        )
        .orderBy("conv_id", "thread", "turn", "role", "text")
    )


def as_mails(turns: DataFrame) -> DataFrame:
    """Turns as mails that quote the turn before, which quotes the one before it.

    The tables at hand hold chats without quotes; this writes them as a mail
    program would. Turns that share a number count as one (the smallest text).
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    marked = lambda c, mark: F.concat(F.lit(mark), F.regexp_replace(c, "\n", "\n" + mark))
    # a turn is shown to the two after it, and both quotes of a turn come from one aggregate
    shown = lambda by, **texts: F.struct(
        (F.col("turn") + by).alias("turn"), *[texts.get(q, F.lit(None).cast("string")).alias(q) for q in ("q1", "q2")]
    )
    quoted = (
        rows.select("conv_id", F.inline(F.array(shown(1, q1=F.col("text")), shown(2, q2=F.col("text")))))
        .groupBy("conv_id", "turn")
        .agg(F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    )
    return rows.join(quoted, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role",
        F.when(
            F.col("text").isNotNull(),
            F.concat_ws("\n", marked(F.col("q2"), ">> "), marked(F.col("q1"), "> "), "text"),
        ).alias("text"),
    )
