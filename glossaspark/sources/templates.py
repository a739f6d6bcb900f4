"""Entries of official translation templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from .projects import files
from .scripts import string_literals

# Lines of the template format.
REFERENCE = "# (.+):([0-9]+)"
BLOCK = rf"^translate{text.SPACE}+(\S+){text.SPACE}+(\S+):{text.SPACE}*\z"
ORIGINAL = rf"^{text.SPACE}+# (.+)"


def _part(pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract("line", pattern, group), F.lit(""))


def _reference(before: str) -> Column:
    """(n, file, line) of a line that names its source, else null."""
    pattern = f"^{before}{REFERENCE}"
    place = F.struct("n", F.replace(_part(pattern, 1), F.lit("\\"), F.lit("/")).alias("file"), F.expr("try_cast(line_no AS int)").alias("line"))
    return F.when(F.col("line").rlike(pattern), place)


def _labelled(found: DataFrame, language: str) -> DataFrame:
    """Lines of the files, each with the block of the language it lies in (``block``,
    the number of its head; null outside), the block's name and what the line holds."""
    script = F.regexp_replace(F.decode("content", "UTF-8"), "^\\x{FEFF}", "")
    lines = found.select(F.col("path").alias("template_file"), F.posexplode(text.lines(script)).alias("n", "line"))
    file = Window.partitionBy("template_file").orderBy("n")
    so_far, earlier = file.rowsBetween(Window.unboundedPreceding, Window.currentRow), file.rowsBetween(Window.unboundedPreceding, -1)
    top = (F.col("line") != "") & ~F.col("line").rlike(f"^{text.SPACE}")
    head = F.when(top, F.struct("n", (_part(BLOCK, 1) == language).alias("own"), _part(BLOCK, 2).alias("name")))
    labelled = (
        lines.withColumn("line_no", _part(f"^{text.SPACE}*{REFERENCE}", 2))
        .withColumn("top_reference", _reference(""))
        .withColumn("inner_reference", _reference(f"{text.SPACE}+"))
        .withColumn("head", F.last(head, ignorenulls=True).over(so_far))
        .withColumn("inside", F.coalesce(F.col("head.own"), F.lit(False)))
        .withColumn("code", F.regexp_replace("line", rf"^{text.SPACE}+|{text.SPACE}+\z", ""))
    )
    is_head = F.col("inside") & (F.col("head.n") == F.col("n"))
    is_old = F.col("inside") & (F.col("head.name") == "strings") & ~is_head & F.col("code").startswith("old ")
    return labelled.select(
        "template_file",
        "n",
        "line",
        "inside",
        F.col("head.n").alias("block"),
        F.col("head.name").alias("name"),
        is_head.alias("is_head"),
        is_old.alias("is_old"),
        F.when(is_old, F.substring("code", 5, 1 << 30)).alias("old_code"),
        F.last("top_reference", ignorenulls=True).over(so_far).alias("above"),
        F.max(F.when(is_head, F.col("n"))).over(earlier).alias("block_before"),
        F.last("inner_reference", ignorenulls=True).over(so_far).alias("nearest"),
        F.max(F.when(is_old, F.col("n"))).over(earlier).alias("old_before"),
    )


def _since(reference: Column, *bounds: Column) -> Column:
    """A reference that comes after all the given lines: each serves one entry."""
    return F.when(reduce(lambda a, b: a & b, [reference["n"] > F.coalesce(b, F.lit(-1)) for b in bounds]), reference)


def entries(spark: SparkSession, root: str, language: str) -> tuple[DataFrame, DataFrame]:
    """Entries and warnings of the templates below a language's folder. The engine's own
    ``common.rpy`` at the top is none of them."""
    return read_entries(files(spark, root, "*.rpy").where("path <> 'common.rpy'"), language)


def read_entries(found: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """Entries and warnings of template files (path, content); content that isn't UTF-8
    stops the query.

    Lines are labelled first: a line that isn't indented closes the block before it. A
    block of said text makes one entry from its only quoted statement; in a block of
    strings each ``old`` line makes one from the reference above it. Window functions
    run over one file's lines.
    """
    lines = _labelled(found, language).where("inside")
    said = (
        lines.where("name <> 'strings'")
        .groupBy("template_file", "block", "name")
        .agg(
            F.max(F.when(F.col("is_head"), _since(F.col("above"), F.col("block_before")))).alias("at"),
            F.collect_list(F.when(~F.col("is_head"), _part(ORIGINAL, 1))).alias("codes"),
        )
        .select("template_file", F.col("block").alias("n"), "name", "at", F.size("codes").alias("n_codes"), F.get("codes", F.lit(0)).alias("code"))
    )
    choices = lines.where("is_old").select(
        "template_file",
        "n",
        F.lit(None).cast("string").alias("name"),
        _since(F.col("nearest"), F.col("block"), F.col("old_before")).alias("at"),
        F.lit(1).alias("n_codes"),
        F.col("old_code").alias("code"),
    )
    rows = said.unionByName(choices).withColumn("strings", string_literals(F.col("code")))
    choice, first = F.col("name").isNull(), F.get("strings", F.lit(0))
    whole = (F.size("strings") == 1) & (first["start"] == 0) & (first["end"] == F.length("code"))
    warning = (
        F.when(F.col("at").isNull(), F.when(choice, "string without a reference").otherwise("block without a reference"))
        .when(F.col("n_codes") != 1, F.format_string("block of %d statements", "n_codes"))
        .when(choice & ~whole, "string of another form")
        .when(F.size("strings") != 1, F.format_string("statement of %d strings", F.size("strings")))
    )
    bare = F.regexp_replace(F.substring("code", F.lit(1), first["start"]), text.SPACE, "") == ""
    kind = F.when(choice, "menu_choice").when(bare, "narration").otherwise("dialogue")
    place = Window.partitionBy("template_file").orderBy("n")
    judged = rows.withColumn("warning", warning).withColumn("ordinal", F.row_number().over(place) - 1)
    good = judged.where("warning IS NULL").select(
        "template_file",
        "ordinal",
        F.col("at.file").alias("source_file"),
        F.col("at.line").alias("line_number"),
        kind.alias("kind"),
        first["body"].alias("source_text"),
        F.col("name").alias("translation_identifier"),
        F.col("code").alias("source_code"),
        first["start"].alias("literal_start"),
        first["end"].alias("literal_end"),
    )
    return good, judged.where("warning IS NOT NULL").select("template_file", (F.col("n") + 1).alias("line_number"), F.col("warning").alias("message"))
