"""Replies linked to the messages they quote, and conversations without quotations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, materialize

MARKS = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
#: Lines that announce a quotation.
ANNOUNCED = re.compile(r"^\s*(?:On\b.*\bwrote|Am\b.*\bschrieb\b.*|Le\b.*\ba écrit|El\b.*\bescribió)\s*:\s*$")
SCHEMA = (
    "conv_id long, turn long, role string, own string, n_quoted long,"
    " said array<long>, quoted array<struct<level:int,size:int,h:long>>"
)


def _normal(text: str) -> str:
    return " ".join(text.lower().split())


def _units(lines: list[str]) -> dict[int, int]:
    """Hash to length of the whole passage, its paragraphs and its lines, normalised."""
    paragraphs, now = [], []
    for line in [*lines, ""]:
        if line.strip():
            now.append(line)
        elif now:
            paragraphs.append(" ".join(now))
            now = []
    out = {}
    for unit in (" ".join(lines), *paragraphs, *lines):
        if text := _normal(unit):
            out[xxhash.xxh3_64_intdigest(text) - (1 << 63)] = len(text)
    return out


def parse_message(text: str | None) -> tuple[str, list[int], list[tuple[int, int, int]], int]:
    """Own text without quotations, hashes of what it says, (level, length, hash) of
    what it quotes, and the number of quoted passages. A passage is a run of lines of
    one quotation level; lines that announce a quotation belong to it."""
    lines = []
    for line in (text or "").split("\n"):
        mark = MARKS.match(line)
        lines.append((mark[1].count(">"), line[mark.end() :]) if mark else (0, line))
    own, quoted, passages, i = [], {}, 0, 0
    while i < len(lines):
        level, start = lines[i][0], i
        while i < len(lines) and lines[i][0] == level:
            i += 1
        part = [line for _, line in lines[start:i]]
        if not level:
            if i < len(lines):
                while part and (not part[-1].strip() or ANNOUNCED.match(part[-1])):
                    part.pop()
            own += part
        else:
            units = _units(part)
            passages += bool(units)
            for h, size in units.items():
                if h not in quoted or quoted[h][0] > level:
                    quoted[h] = (level, size)
    if passages:
        while own and not own[0].strip():
            own.pop(0)
        while own and not own[-1].strip():
            own.pop()
    rest = "\n".join(own) if passages else (text or "")
    return rest, list(_units(rest.split("\n"))), [(level, size, h) for h, (level, size) in quoted.items()], passages


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("level", pa.int32()), ("size", pa.int32()), ("h", pa.int64())]))
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            piece = batch.slice(start, 1000)
            found = [parse_message(t.as_py()) for t in piece.column(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    piece.column(1),
                    piece.column(2),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[3] for x in found], pa.int64()),
                    pa.array([x[1] for x in found], pa.list_(pa.int64())),
                    pa.array([[dict(zip(("level", "size", "h"), q, strict=True)) for q in x[2]] for x in found], kind),
                ],
                ["conv_id", "turn", "role", "own", "n_quoted", "said", "quoted"],
            )


def _threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth) of each message with a parent, by pointer
    doubling: each round halves what is left of every chain."""
    current = materialize(links.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).alias("depth")), "threads")
    while True:
        above = current.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        joined = current.join(above, ["conv_id", "up"], "left")
        after = materialize(
            joined.select(
                "conv_id",
                "turn",
                F.coalesce("up2", "up").alias("up"),
                (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
                F.col("up2").isNotNull().alias("moved"),
            ),
            "threads",
        )
        drop_scratch(current)
        current = after.drop("moved")
        current.scratch = after.scratch
        if after.where("moved").isEmpty():
            return current.select("conv_id", "turn", F.col("up").alias("thread_turn"), "depth")


def link_quotations(
    messages: DataFrame,
    *,
    conversation_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    part_turns: int = 1024,
) -> DataFrame:
    """Messages without their quotations, each with the message it answers.

    Quotation levels are parsed per line (``>``, also nested). Each quoted passage, its
    paragraphs and its lines are normalised (lower case, single blanks) and hashed;
    the same is done with what messages say themselves. A hash is looked up among the
    earlier turns of its conversation, the latest one wins: a running last value over
    the sorted hashes, not pairs, so a line repeated in a large conversation stays
    linear. A group of it holds ``part_turns`` turns; the last value before them comes
    from the maxima of the earlier ranges. The parent comes from the lowest level, then the longest passage, then the
    latest turn. Threads and depths follow by pointer doubling.

    Returns (conv_id, turn, role, text, n_quoted, parent_turn, thread_turn, depth), one
    row per row. Sorting by (thread_turn, depth, turn) puts each reply after what it
    answers. A message without a link starts a thread: no parent, depth 0. Null texts
    are empty; rows without conv_id or turn start no link and get none. Rows of the
    same turn don't link with each other. A text without quotations stays as it is.
    An empty table gives an empty result; other columns are ignored.
    """
    slim = messages.select(
        F.col(conversation_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
    )
    parsed = materialize(slim.mapInArrow(_parse, SCHEMA), "messages")
    known = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quotes = materialize(
        known.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", "q.size", "q.h"), "quotes"
    )
    said = (
        known.select("conv_id", "turn", F.explode("said").alias("h"))
        .join(quotes.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi")
        .distinct()
    )
    # at one turn, quotations come before what is said there
    both = materialize(
        quotes.withColumn("said_turn", F.lit(None).cast("long"))
        .unionByName(
            said.select("conv_id", "turn", F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("size"), "h", F.col("turn").alias("said_turn"))
        )
        .withColumn("part", F.floor(F.col("turn") / part_turns)),
        "said",
    )
    ranges = Window.partitionBy("conv_id", "h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        both.groupBy("conv_id", "h", "part")
        .agg(F.max("said_turn").alias("last"))
        .select("conv_id", "h", "part", F.max("last").over(ranges).alias("carried"))
        .where("carried IS NOT NULL")
    )
    seen = (
        Window.partitionBy("conv_id", "h", "part").orderBy("turn", F.col("said_turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    links = materialize(
        both.withColumn("near", F.last("said_turn", ignorenulls=True).over(seen))
        .join(carried, ["conv_id", "h", "part"], "left")
        .withColumn("parent", F.coalesce("near", "carried"))
        .where("level IS NOT NULL AND parent IS NOT NULL")
        .groupBy("conv_id", "turn")
        .agg(F.min_by("parent", F.struct("level", -F.col("size"), -F.col("parent"))).alias("parent_turn")),
        "links",
    )
    threads = _threads(links)
    return (
        parsed.join(links, ["conv_id", "turn"], "left")
        .join(threads, ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            "role",
            F.col("own").alias("text"),
            "n_quoted",
            "parent_turn",
            F.coalesce("thread_turn", "turn").alias("thread_turn"),
            F.coalesce("depth", F.lit(0)).alias("depth"),
        )
    )


def reply_order(linked: DataFrame, part_turns: int = 1024) -> DataFrame:
    """Conversations of :func:`link_quotations` in reply order: adds ``position``, from
    0 in each (conv_id, thread_turn). A message comes after the one it answers, since
    that has a smaller turn; rows of one turn are ordered by role and text. Ranges of
    turns are numbered apart and start where the earlier ones end. Rows without
    conv_id or turn have no position."""
    group = ["conv_id", "thread_turn"]
    known = linked.where("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("part", F.floor(F.col("turn") / part_turns))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        known.groupBy(*group, "part")
        .agg(F.count("*").alias("n"))
        .select(*group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    inside = Window.partitionBy(*group, "part").orderBy("turn", "role", F.xxhash64("text"), "depth")
    ordered = known.withColumn("number", F.row_number().over(inside) - 1).join(firsts, [*group, "part"])
    loose = linked.where("conv_id IS NULL OR turn IS NULL").withColumn("position", F.lit(None).cast("long"))
    return ordered.withColumn("position", F.col("first") + F.col("number")).drop("part", "number", "first").unionByName(loose)


def conversations(linked: DataFrame, part_turns: int = 1024) -> DataFrame:
    """Threads of :func:`link_quotations` as lists of messages in reply order: (conv_id,
    thread_turn, part, messages). A part holds the positions of one range of
    ``part_turns``, so a list stays bounded in a very long conversation. Rows without
    conv_id or turn are in no list."""
    message = F.struct("position", "turn", "role", "depth", "text")
    placed = reply_order(linked, part_turns).where("position IS NOT NULL")
    return placed.groupBy("conv_id", "thread_turn", F.floor(F.col("position") / part_turns).alias("part")).agg(
        F.sort_array(F.collect_list(message)).alias("messages")
    )


def as_mails(messages: DataFrame, thread: int = 4) -> DataFrame:
    """Plain turns as replies by mail, whose links are known: a turn that ``thread``
    doesn't divide quotes the turn before it, and a level deeper what that one quotes.

    Takes and returns (conv_id, turn, role, text); null texts and turns whose
    predecessor is missing or without text quote nothing. One row per row; where
    several rows share a turn, the least text is quoted.
    """
    marked = lambda c: F.concat(F.lit("> "), F.regexp_replace(c, "\n", "\n> "))
    quotable = messages.where(r"text RLIKE '\\S'").groupBy("conv_id", "turn").agg(F.min("text").alias("said"), F.min("role").alias("by"))
    earlier = lambda k: quotable.select(
        "conv_id", (F.col("turn") + k).alias("turn"), F.col("said").alias(f"said{k}"), F.col("by").alias(f"by{k}")
    )
    answers = F.pmod("turn", F.lit(thread)) > 0
    deeper = F.when((F.pmod("turn", F.lit(thread)) > 1) & F.col("said2").isNotNull(), F.concat(F.lit("\n"), marked(marked(F.col("said2")))))
    quote = F.concat(
        F.lit("On turn "), (F.col("turn") - 1).cast("string"), F.lit(" "), F.coalesce("by1", F.lit("someone")), F.lit(" wrote:\n"), marked(F.col("said1")), F.coalesce(deeper, F.lit(""))
    )
    whole = F.when(answers & F.col("said1").isNotNull(), F.concat(quote, F.lit("\n\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    return (
        messages.select("conv_id", "turn", "role", "text")
        .join(earlier(1), ["conv_id", "turn"], "left")
        .join(earlier(2), ["conv_id", "turn"], "left")
        .select("conv_id", "turn", "role", whole.alias("text"))
    )
