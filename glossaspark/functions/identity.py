"""Content-addressed identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control characters whose escapes differ in the case of their hex digits.
UPPER_ESCAPES = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def canonical_json(value: Column) -> Column:
    """JSON of a struct whose fields are in alphabetical order: no blanks, non-ASCII
    kept, nulls written, escapes in lower case."""
    out = escaped = F.to_json(value, {"ignoreNullFields": "false"})
    for code in UPPER_ESCAPES:
        escaped = F.regexp_replace(escaped, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    # nearly no text holds such an escape, and a pattern costs more than the JSON itself
    return F.when(out.contains("\\u00"), escaped).otherwise(out)


def digest(prefix: str, text: Column) -> Column:
    """``prefix_`` and the first 24 hex digits of the SHA-256."""
    return F.concat(F.lit(prefix + "_"), F.left(F.sha2(text, 256), F.lit(24)))


def packed(text: Column) -> Column:
    """A text as bytes for shuffles: one of lower-case hex digits in half its length. The
    first byte names the form, so different texts have different bytes."""
    pairs = text.rlike(r"^(?:[0-9a-f]{2})+\z")
    return F.when(pairs, F.concat(F.lit(b"\x01"), F.unhex(text))).otherwise(F.concat(F.lit(b"\x00"), F.encode(text, "UTF-8")))


def unpacked(value: Column) -> Column:
    """The text of :func:`packed`."""
    rest = F.substring(value, 2, 1 << 30)
    return F.when(F.substring(value, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def segment_id(source: Column, scene: Column, kind: Column, speaker: Column, text: Column, occurrence: Column) -> Column:
    """Identity of a segment: not its line, but its place among equal ones."""
    parts = (source, scene, kind, F.coalesce(speaker, F.lit("")), text, occurrence)
    return digest("seg", F.concat_ws("\u0000", *[p.cast("string") for p in parts]))


def ordered_digest(df: DataFrame, keys: list[str], order: str, value: str, prefix: str, alias: str) -> DataFrame:
    """Digest of a group's values in order. A group is one task's list, so it is
    gathered whole; use :func:`tree_digest` for lists without a bound."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda r: r[value])
    return df.groupBy(*keys).agg(digest(prefix, F.to_json(rows)).alias(alias))


def tree_digest(df: DataFrame, keys: list[str], order: str, value: str, prefix: str, alias: str, leaf: int = 1024) -> DataFrame:
    """Digest over the digests of ranges of ``leaf`` ordinals: no group holds more than
    one range, and the top level a hash per range. Differs from the flat digest."""
    part = df.withColumn("__leaf", F.floor(F.col(order) / leaf))
    leaves = ordered_digest(part, [*keys, "__leaf"], order, value, "leaf", "__digest")
    return ordered_digest(leaves, keys, "__leaf", "__digest", prefix, alias)
