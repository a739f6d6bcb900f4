"""Column expressions over texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, sums_before

#: What ends a line, as in Python's splitlines.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
#: Control characters that a text doesn't hold.
CONTROLS = "[\\x00-\\x08\\x0b\\x0e-\\x1f]"
#: Protected parts of a text, left to right, the first rule wins.
TOKEN = r"(?s)\\.|\[\[|\{\{|\[[^\]]*\]|\{[^}]*\}"
#: White space, as in Python's strip.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Characters of a piece of a text that spans are compared with.
PIECE = 256
LANGUAGE = r"^[A-Za-z][A-Za-z0-9_-]*\z"


def lines(text: Column) -> Column:
    """Lines without their ends; a last end opens no further line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    return F.size(lines(text))


def plausible(text: Column) -> Column:
    """Less than 1 % control characters; an empty text is one."""
    controls = F.length(text) - F.length(F.regexp_replace(text, CONTROLS, ""))
    return (F.length(text) == 0) | (controls * 100 < F.length(text))


def tokens(text: Column) -> Column:
    """Protected tokens: array of (index, kind, value, start, end) in code points.

    ``\\x`` and doubled opening brackets are escapes, ``[...]`` interpolations, ``{...}``
    text tags; an opening bracket without its end is text. The gaps between the
    matches give the offsets, as sums of the lengths before, so the work is linear in the text.
    """
    kind = lambda v: (
        F.when(v.startswith("\\") | v.isin("[[", "{{"), "escape").when(v.startswith("["), "interpolation").otherwise("text_tag")
    )
    empty = F.array().cast("array<struct<index:int,kind:string,value:string,start:int,end:int>>")

    def placed(parts: Column, before: Column) -> Column:
        def token(part: Column, i: Column) -> Column:
            start = F.get(before, i) + F.length(part["gap"])
            return F.struct(i.alias("index"), kind(part["value"]).alias("kind"), part["value"].alias("value"), start.alias("start"), (start + F.length(part["value"])).alias("end"))

        return F.transform(parts, token)

    def measured(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.length(p["gap"]) + F.length(p["value"]))
        return let(sizes, lambda n: let(sums_before(n), lambda before: placed(parts, before)))

    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    # the last gap has no match after it
    parts = F.filter(F.zip_with(found, F.split(text, TOKEN, -1), lambda v, g: F.struct(v.alias("value"), g.alias("gap"))), lambda p: p["value"].isNotNull())
    return let(parts, lambda p: F.when(F.size(p) > 0, measured(p)).otherwise(empty))


def token_references(spans: Column) -> Column:
    """Tokens without their offsets."""
    return F.transform(spans, lambda t: F.struct(t["index"].alias("index"), t["kind"].alias("kind"), t["value"].alias("value")))


def spans_fit(text: Column, spans: Column) -> Column:
    """Offsets are increasing, don't overlap, lie inside the text and hold the value;
    indexes count from 0."""

    def held(pieces: Column, t: Column) -> Column:
        first, last = (F.floor(x / PIECE).cast("int") for x in (t["start"], t["end"] - 1))
        near = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return F.substring(near, t["start"] - first * PIECE + 1, t["end"] - t["start"]) == t["value"]

    def fits(pieces: Column, given: Column, size: Column) -> Column:
        ordered = F.transform(
            given,
            lambda t, i: (t["index"] == i) & (t["start"] >= F.coalesce(F.get(given, i - 1)["end"], F.lit(0))) & (t["end"] > t["start"]) & (t["end"] <= size),
        )
        every = lambda flags: F.aggregate(flags, F.lit(True), lambda ok, x: ok & x)
        return F.when(every(ordered), every(F.transform(given, lambda t: held(pieces, t)))).otherwise(every(ordered))

    # the text is cut once, a value is compared with the pieces around it
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    bound = F.struct(cut.alias("pieces"), spans.alias("given"), F.length(text).alias("size"))
    return let(bound, lambda b: fits(b["pieces"], b["given"], b["size"]))


def indent(line: Column, tab: int = 4) -> Column:
    """Width of the leading blanks and tabs, tabs to the next stop. Other white space
    ends the indentation."""
    blanks = F.regexp_extract(line, r"^[ \t]*", 0)
    chars = F.filter(F.split(blanks, "", -1), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda n, c: F.when(c == "\t", n + tab - n % tab).otherwise(n + 1))


def valid_language(tag: Column) -> Column:
    return tag.rlike(LANGUAGE)


def checked_string(value: Column, most: int, strip: bool = True) -> Column:
    """1 to ``most`` characters, no controls, with ``strip`` no white space around."""
    ok = value.isNotNull() & (F.length(value) >= 1) & (F.length(value) <= most) & ~value.rlike(r"[\x00-\x1f]")
    if strip:
        ok &= ~value.rlike(rf"^{SPACE}|{SPACE}\z")
    return F.coalesce(ok, F.lit(False))


def redacted(text: Column, secret: Column) -> Column:
    return F.when(F.length(secret) > 0, F.replace(text, secret, F.lit("[REDACTED]"))).otherwise(text)


def failure_message(kind: Column, message: Column, most: int = 1000) -> Column:
    return F.left(F.concat(kind, F.lit(": "), message), F.lit(most))
