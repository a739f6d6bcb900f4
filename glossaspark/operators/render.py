"""Translated script fragments and the files they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def fits_literal(target: Column, quote: Column) -> Column:
    """The text can stand between the quotes: no line ends or NUL, no bare quote, no
    single backslash at the end."""
    rest = F.regexp_replace(target, r"(?s)\\.", "")
    return ~target.rlike(r"[\x00\r\n]") & ~rest.contains("\\") & ~rest.contains(quote)


def literal_stands(literals: Column, start: Column, end: Column, body: Column) -> Column:
    """The code still holds one string literal, the recorded one at the recorded place."""
    first = F.get(literals, F.lit(0))
    return F.coalesce((F.size(literals) == 1) & (first["start"] == start) & (first["end"] == end) & (first["body"] == body), F.lit(False))


def tokens_kept(source: Column, target: Column) -> Column:
    values = lambda c: F.transform(text.tokens(c), lambda t: t["value"])
    return values(source) == values(target)


def fragment(
    kind: Column, source_file: Column, line: Column, code: Column, start: Column, end: Column, target: Column, language: Column, identifier: Column
) -> Column:
    """Script text of one translation: a block for what is said, an old/new pair for a
    choice. The literal at [start, end) of the code is exchanged, its quotes stay."""
    quote = F.substring(code, start + 1, F.lit(1))
    literal = F.concat(quote, target, quote)
    new = F.concat(F.substring(code, F.lit(1), start), literal, F.substring(code, end + 1, F.length(code)))
    at = F.concat(F.lit("# "), source_file, F.lit(":"), line.cast("string"), F.lit("\n"))
    block = F.concat(at, F.lit("translate "), language, F.lit(" "), identifier, F.lit(":\n\n    # "), code, F.lit("\n    "), new, F.lit("\n\n"))
    pair = F.concat(F.lit("    "), at, F.lit("    old "), code, F.lit("\n    new "), literal, F.lit("\n\n"))
    return F.when(kind == "menu_choice", pair).otherwise(block)


def fragment_consistent(kind: Column, header: Column, identifier: Column, content: Column) -> Column:
    """A choice stands below the strings header and has no id, the others the reverse."""
    choice = kind == "menu_choice"
    return F.coalesce((F.length(content) > 0) & (choice == header) & (choice == identifier.isNull()), F.lit(False))


def repeated(fragments: DataFrame) -> DataFrame:
    """Segment ids and translation ids that several fragments have: (what, id, n)."""
    ids = lambda what, c: fragments.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(what).alias("what"), "id", "n")
    return ids("segment", "segment_id").unionByName(ids("translation", "translation_identifier"))


def refused_if_repeated(fragments: DataFrame) -> DataFrame:
    """The fragments; one whose segment or translation id another has stops the query."""
    again = repeated(fragments)
    out = fragments
    for what, c in (("segment", "segment_id"), ("translation", "translation_identifier")):
        marks = again.where(F.col("what") == what).select(F.col("id").alias(c), F.lit(True).alias("__again"))
        stop = F.raise_error(F.concat(F.lit(f"several fragments have the {what} id "), F.col(c)))
        out = out.join(marks, c, "left").withColumn("content", F.when(F.col("__again"), stop).otherwise(F.col("content"))).drop("__again")
    return out


def files(fragments: DataFrame, language: str, order: str = "ordinal") -> DataFrame:
    """One row per template file: what is said first, then choices below one header, in
    order, with the segment ids. A group is one file."""
    row = F.struct(F.col("requires_strings_header").alias("late"), F.col(order).alias("at"), "segment_id", "content")
    rows = F.array_sort(F.collect_list(row))
    part = lambda late: F.array_join(F.transform(F.filter("rows", lambda r: r["late"] == late), lambda r: r["content"]), "")
    header = F.when(F.exists("rows", lambda r: r["late"]), F.lit(f"translate {language} strings:\n\n")).otherwise("")
    return fragments.groupBy("template_file").agg(rows.alias("rows")).select(
        F.concat(F.lit(f"game/tl/{language}/"), "template_file").alias("relative_path"),
        "template_file",
        F.transform("rows", lambda r: r["segment_id"]).alias("segment_ids"),
        F.concat(part(False), header, part(True)).alias("content"),
    )
