"""Quality rules: repetition counts of a document and line frequencies across documents.
Only DataFrame functions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, drop_scratch, materialize, words

HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), GAP, " "))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(_normal(line))


def _measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Counts of each document, and the hash and words of each of its lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        host.alias("host"),
        text.alias("text"),
        F.xxhash64(F.col(id_col), host, text).alias("row_key"),
        F.xxhash64(text).alias("text_key"),
    )
    split = base.select(
        "doc_id",
        "host",
        "row_key",
        "text_key",
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        words(F.col("text")).alias("w"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(HAS_WORD)).alias("l"),
    )
    grams = split.select(
        "*",
        F.when(
            F.size("w") >= 3,
            F.transform(F.slice("w", 1, F.size("w") - 2), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))),
        ).alias("g"),
        F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
        (F.size("l") - F.size(F.array_distinct(F.transform("l", lambda x: F.xxhash64(x))))).cast("long").alias("n_dup_lines"),
        F.transform("l", lambda x: F.struct(_line_hash(x).alias("h"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))).alias("lines"),
    )
    ordered = grams.select(
        "*",
        F.when(
            F.size(F.array_distinct("g")) < F.size("g"),
            F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("s"),
    )
    twice = F.filter(
        "s", lambda p, j: (F.get("s", j - 1)["h"] == p["h"]) | (F.get("s", j + 1)["h"] == p["h"])
    )
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2))))
    return ordered.select(
        "doc_id",
        "host",
        "row_key",
        "text_key",
        F.monotonically_increasing_id().alias("row_id"),
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.when(F.col("s").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
        "lines",
    )


def _judged(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    host_col: str,
    min_words: int,
    max_repeat_percent: int,
    max_host_percent: int,
    min_host_docs: int,
    min_left_percent: int,
    max_host_docs: int | None,
    texts_once: bool = False,
) -> tuple[DataFrame, DataFrame]:
    over = F.col("n_docs") * 100 > F.col("host_docs") * max_host_percent
    if max_host_docs is not None:
        over |= F.col("n_docs") > max_host_docs
    rows = materialize(_measured(docs, id_col, text_col, host_col), "measured")
    held, per_host = _documents_of_lines(rows, texts_once)
    counted = held.groupBy("host", "h").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") > min_host_docs)
    # written first: Spark then knows its size and broadcasts it only when small
    frequent = materialize(
        counted.join(per_host, "host").where(over).select("host", "h"),
        "frequent",
    )
    hits = (
        rows.select("row_id", "host", F.explode("lines").alias("line"))
        .select("row_id", "host", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
        .join(frequent, ["host", "h"])
    )
    lost = hits.groupBy("row_id").agg(
        F.sum("n").cast("long").alias("lost"), F.count("*").alias("lines_lost"), F.collect_set("h").alias("lost_lines")
    )
    left = F.col("n_words") - F.col("n_lost_words")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    judged = (
        rows.drop("lines")
        .join(lost, "row_id", "left")
        .withColumn("n_lost_words", F.coalesce("lost", F.lit(0)).cast("long"))
        .withColumn("n_lost_lines", F.coalesce("lines_lost", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (100 * left >= min_left_percent * F.col("n_words")))
    )
    return judged, frequent


def _documents_of_lines(rows: DataFrame, texts_once: bool) -> tuple[DataFrame, DataFrame]:
    """(host, h, n): documents by host and line, to be summed; and (host, host_docs).

    A document is a doc_id, and a row where that is null; with ``texts_once`` it is a text."""
    lines = F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")
    if texts_once:
        firsts = rows.groupBy("host", "text_key").agg(F.min("row_id").alias("row_id"))
        once = rows.select("row_id", "host", "lines").join(firsts.select("row_id"), "row_id", "left_semi")
        return once.select("host", lines).groupBy("host", "h").agg(F.count("*").alias("n")), firsts.groupBy("host").agg(F.count("*").alias("host_docs"))
    repeated = materialize(rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    single, several = rows, None
    if not repeated.isEmpty():
        # rows of one id are one document: their lines are made distinct by id
        single = rows.join(repeated, "doc_id", "left_anti")
        several = rows.join(repeated, "doc_id", "left_semi")
    held, hosts = single.select("host", lines).groupBy("host", "h").agg(F.count("*").alias("n")), single.groupBy("host").agg(F.count("*").alias("n"))
    if several is not None:
        held = held.unionByName(several.select("host", "doc_id", lines).distinct().groupBy("host", "h").agg(F.count("*").alias("n")))
        hosts = hosts.unionByName(several.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("n")))
    return held, hosts.groupBy("host").agg(F.sum("n").alias("host_docs"))


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_host_percent: int = 10,
    min_host_docs: int = 10,
    min_left_percent: int = 50,
    max_host_docs: int | None = None,
) -> DataFrame:
    """Judge each document.

    Base: fewer than ``min_words`` words, or more than ``max_repeat_percent`` % of
    the words in three-word windows that the text holds twice or more. Method: the
    lines of all documents, in lower case and with single blanks, are hashed and the
    distinct documents of each line counted per host. A line in more than
    ``min_host_docs`` documents and ``max_host_percent`` % of a host's documents goes,
    and so does one in more than ``max_host_docs`` documents of a host of any size
    (None: no such limit);
    a document with less than ``min_left_percent`` % of its words left is rejected.

    Counts are pre-aggregated before the shuffle, and the join of lines with the
    frequent ones can be split, so a line in a third of all documents makes no large
    task. Returns, for each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lost_words, n_lost_lines (words and lines over the limits),
    base_failed, kept. Null and empty texts have no words and fail. Rows without a
    host are one host. Rows of one doc_id are one document of the counts, rows without
    doc_id one each. An empty table gives an empty result; other columns are ignored.
    """
    judged, _ = _judged(docs, id_col, text_col, host_col, min_words, max_repeat_percent, max_host_percent, min_host_docs, min_left_percent, max_host_docs)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "n_lost_lines", "base_failed", "kept"
    )


def clean_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", texts_once: bool = False, **limits: int | None
) -> DataFrame:
    """The documents that :func:`quality_rules` keeps, with all their columns and
    without the lines over the limits. ``texts_once``: rows of a host with the same text
    are one document of the counts, for input whose copies a later stage removes; a group of
    copies then isn't rejected as a whole for the lines that it shares with itself."""
    settings = {"min_words": 50, "max_repeat_percent": 50, "max_host_percent": 10, "min_host_docs": 10, "min_left_percent": 50, "max_host_docs": None} | limits
    judged, _ = _judged(docs, id_col, text_col, host_col, **settings, texts_once=texts_once)
    verdict = materialize(
        judged.where("kept").select(F.col("row_key").alias("__key"), F.col("lost_lines").alias("__lost")).dropDuplicates(["__key"]),
        "verdict",
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))
    rest = F.array_join(
        F.filter(F.split(text, "\n", -1), lambda x: ~(x.rlike(HAS_WORD) & F.array_contains("__lost", _line_hash(x)))), "\n"
    )
    return (
        docs.withColumn("__key", F.xxhash64(F.col(id_col), host, text))
        .join(verdict, "__key")
        .withColumn(text_col, F.when(F.col("__lost").isNull(), F.col(text_col)).otherwise(rest))
        .drop("__key", "__lost")
    )
