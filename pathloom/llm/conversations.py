"""Reply-ordered conversations by linking quotations to the messages they quote.

Lines that begin with ``>`` are quoted, as deep as there are marks; a line that announces a
quotation goes with it. The other lines are the message's own, level 0. Lines, normalised, are
hashed, and a line quoted at level k is joined to the messages of its conversation that have it at
level k - 1: to the first one and to the last one before it. A message replies to the earlier
message that most of its quoted lines are linked to (of several, the latest). A message without
such a link continues from the turn before it, if there is one. Roots and depths follow from the
links by pointer jumping.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, span_hashes, utf8

#: Turns of a conversation that one task looks back over.
STEP = 4096

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_ANNOUNCES = re.compile(r"\s*(?:on\b.*|.*)\b(?:wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$", re.IGNORECASE)
_BLANK = re.compile(r"\n[ \t]*\n(?:[ \t]*\n)+")


@dataclass(frozen=True)
class Parsed:
    """A message's own text, and its quoted lines with their levels, normalised."""

    own: str
    quoted: list[tuple[int, str]]


def normalise(line: str) -> str:
    """Lower-cased words and marks, single-spaced; empty if there is no letter or digit."""
    joined = " ".join(line.lower().split())
    return joined if any(c.isalnum() for c in joined) else ""


def parse(text: str | None) -> Parsed:
    if not text or ">" not in text:
        return Parsed(text or "", [])
    own: list[str] = []
    quoted: list[tuple[int, str]] = []
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        if marks:
            level, rest = marks[1].count(">"), line[marks.end() :]
            if line.count(">") and own and _ANNOUNCES.match(own[-1]):
                own.pop()
            if (plain := normalise(rest)) and not _ANNOUNCES.match(rest):
                quoted.append((level, plain))
        else:
            own.append(line)
    return Parsed(_BLANK.sub("\n\n", "\n".join(own)).strip(), quoted)


def _hashes(lines: list[str]) -> pa.Array:
    data, at = utf8(pa.array(lines, pa.string()))
    return pa.array(span_hashes(data, at[:-1], at[1:]).view("int64"))


_LINE = "conv_id long, turn long, level int, line long"


def lines(messages: DataFrame) -> DataFrame:
    """All lines' hashes: level 0 for own lines, else the quotation's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, level, text = [], [], []
            for k, raw in enumerate(batch.column("text").to_pylist()):
                parsed = parse(raw)
                found = parsed.quoted + [(0, p) for line in parsed.own.split("\n") if (p := normalise(line))]
                at += [k] * len(found)
                level += [x for x, _ in found]
                text += [x for _, x in found]
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").take(taken), batch.column("turn").take(taken), pa.array(level, pa.int32()), _hashes(text)],
                names=["conv_id", "turn", "level", "line"],
            )

    return messages.mapInArrow(run, _LINE)


def last_before(rows: DataFrame, keys: list[str], wanted: Column) -> DataFrame:
    """``rows`` with ``said``, the greatest earlier ``turn`` of a row with these keys that is ``wanted``.

    Turns are taken in steps of STEP, so a long group is read by several tasks: rows look back
    within their step, and to the last wanted turn of the steps before.
    """
    stepped = rows.withColumn("_step", F.floor(F.col("turn") / STEP)).withColumn("_wanted", F.when(wanted, F.col("turn")))
    within = Window.partitionBy(*keys, "_step").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    stepped = stepped.withColumn("_near", F.max("_wanted").over(within))
    ends = stepped.where("_wanted is not null").groupBy(*keys, "_step").agg(F.max("_wanted").alias("_end"))
    steps = stepped.select(*keys, "_step").distinct().join(ends, [*keys, "_step"], "left")
    earlier = Window.partitionBy(*keys).orderBy("_step").rangeBetween(Window.unboundedPreceding, -1)
    steps = steps.select(*keys, "_step", F.max("_end").over(earlier).alias("_far"))
    return stepped.join(steps, [*keys, "_step"]).withColumn("said", F.coalesce("_near", "_far")).drop("_step", "_wanted", "_near", "_far")


def quotation_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, n_linked: the message that each message quotes most."""
    found = cut(lines(messages).where("conv_id is not null and turn is not null").distinct())
    keys = ["conv_id", "line", "level"]
    quotes = found.where("level > 0")
    lines_quoted = quotes.select(*keys).distinct()
    holders = found.withColumn("level", F.col("level") + 1).join(lines_quoted, keys, "left_semi")
    holders = cut(holders)
    first = holders.groupBy(*keys).agg(F.min("turn").alias("said"))
    # a line that is quoted and held by one message is looked up for its turn once
    both = quotes.withColumn("_quote", F.lit(True)).unionByName(holders.withColumn("_quote", F.lit(False)))
    met = last_before(both, keys, ~F.col("_quote")).where("_quote and said is not null").select("conv_id", "turn", "line", "level", "said")
    origin = quotes.join(first, keys).where("said < turn").select("conv_id", "turn", "line", "level", "said")
    votes = met.union(origin).distinct().groupBy("conv_id", "turn", "said").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("n", "said")).alias("best"))
    return best.select("conv_id", "turn", F.col("best.said").alias("reply_to"), F.col("best.n").alias("n_linked"))


def _roots(parents: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn, depth from conv_id, turn, parent (null at roots), all turns different.

    Each round doubles how far a message points; those that point at a root are done and leave.
    """
    going = cut(parents.select("conv_id", "turn", F.coalesce("parent", "turn").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")))
    done = going.where("up = turn")
    going = going.where("up != turn")
    while not going.isEmpty():
        above = done.withColumn("_root", F.lit(True)).unionByName(going.withColumn("_root", F.lit(False)))
        above = above.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), "_root")
        moved = going.join(above, ["conv_id", "up"]).select(
            "conv_id", "turn", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), "_root"
        )
        moved = cut(moved)
        done = cut(done.unionByName(moved.where("_root").drop("_root")))
        going = moved.where("not _root").drop("_root")
    return done.withColumnRenamed("up", "root_turn")


def own_texts(messages: DataFrame) -> DataFrame:
    """Messages with ``text`` cleared of quotations and ``n_quoted``, the quoted lines' count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse(t) for t in pc.fill_null(batch.column("text"), "").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array([p.own for p in parsed], pa.string()), pa.array([len(p.quoted) for p in parsed], pa.int64())],
                names=["conv_id", "turn", "role", "text", "n_quoted"],
            )

    return messages.select("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, turn long, role string, text string, n_quoted long")


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """One row per message, without quotations, with its place in the replies.

    conv_id, turn, role, text, formatted (with its role's mark), n_quoted, n_linked (lines of the
    quoted message), reply_to (null at a root), root_turn, depth. Within a conversation, sorting
    by root_turn, turn puts every message after the one it replies to.

    Rows that share a conversation and a turn share their links and are all returned. Rows with a
    null conversation or turn have no links (root_turn is their turn, depth 0). Turns may have gaps.
    Null texts are empty, very long ones are parsed whole; other columns, whatever their names, are
    ignored; an empty table gives an empty result. No conversation is gathered in one task: joins
    are by conversation and turn or line, and looking back goes in steps of STEP turns.
    """
    messages = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    links = cut(quotation_links(messages))
    turns = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    before = last_before(turns, ["conv_id"], F.lit(True)).withColumnRenamed("said", "previous")
    parents = before.join(links, ["conv_id", "turn"], "left")
    parents = cut(parents.select("conv_id", "turn", F.coalesce("reply_to", "previous").alias("parent"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")))
    placed = parents.join(_roots(parents), ["conv_id", "turn"])
    placed = cut(placed.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("parent").alias("reply_to"), "n_linked", "root_turn", "depth"))
    rows = own_texts(messages)
    joined = rows.join(placed, (rows["conv_id"] == placed["_c"]) & (rows["turn"] == placed["_t"]), "left")
    return joined.select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("text"), F.lit("\n")).alias("formatted"),
        "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to",
        F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )
