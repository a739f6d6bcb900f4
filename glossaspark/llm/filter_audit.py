"""Interaction audit of filters: what each one removes in each order of application."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping

import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import scratch_path
from .common import materialize, salted_join

CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"

#: Failure conditions over the columns of :func:`measured`.
CONDITIONS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_capitals > 10 * n_points",
    "D": "n_symbols > 0",
    "E": "repeated",
}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each text, and its 128-bit digest."""
    for batch in batches:
        found = []
        for text in batch.column(2):
            t = text.as_py()
            w = t.split()
            found.append((len(w), len(set(w)), len(t) - len(t.translate(None, CAPITALS)), len(t) - len(t.translate(None, SYMBOLS)), xxhash.xxh3_128_digest(t)))
        columns = zip(*found, strict=True) if found else ((),) * 5
        arrays = [pa.array(x, pa.int64() if i < 4 else pa.binary()) for i, x in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *arrays], ["id", "part", "n_points", "n_words", "n_distinct", "n_capitals", "n_symbols", "digest"])


def measured(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", bad_col: str = "toxic") -> DataFrame:
    """One narrow row per document, written to the shared folder: part, n_words,
    n_distinct (distinct words), n_points (code points), n_capitals (A-Z), n_symbols,
    repeated (a smaller id of the whole table has the same text, by a digest of 128
    bits), good, toxic.

    Null texts count as empty, a null part as ''. A row without id repeats nothing,
    nothing repeats it, and it has no label; of several labels of an id any that says so counts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.cast("binary").alias("text"), F.length(text).cast("long").alias("n_points"))
    counted = materialize(slim.mapInArrow(_counts, "id long, part string, n_points long, n_words long, n_distinct long, n_capitals long, n_symbols long, digest binary").withColumn("row", F.monotonically_increasing_id()), "counted")
    # only texts that several ids hold are joined; rows of one are dealt over several tasks
    copies = materialize(
        counted.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).where("least < most").drop("most"),
        "copies",
    )
    flagged = salted_join(counted, copies, "digest", "row", how="left").withColumn("repeated", F.coalesce(F.col("id") > F.col("least"), F.lit(False)))
    labelled = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col(good_col) == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col(bad_col) == 1, F.lit(False))).alias("toxic")
    )
    # rows without id match no label; spread, they don't meet in one task
    spread = F.when(F.col("id").isNull(), F.col("row") + 1).otherwise(F.lit(0))
    told = flagged.withColumn("spread", spread).join(labelled.withColumn("spread", F.lit(0).cast("long")), ["id", "spread"], "left")
    return materialize(
        told.select("part", "n_words", "n_distinct", "n_points", "n_capitals", "n_symbols", "repeated", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]),
        "measured",
    )


def _edges(rows: DataFrame, fails: Mapping[str, Column]) -> DataFrame:
    """What each filter removes from the survivors of each set of other filters, by part:
    state (bits of the set), filter, alive (before), removed, good_lost, toxic_lost."""
    letters, path, seen = list(fails), scratch_path(rows.sparkSession, "edges"), set()

    def visit(survivors: DataFrame, state: int) -> None:
        seen.add(state)
        left = [i for i in range(len(letters)) if not state >> i & 1]
        counts = [F.count("*").alias("alive")]
        for i in left:
            gone = fails[letters[i]]
            counts += [F.count_if(gone).alias(f"r{i}"), F.count_if(gone & F.col("good")).alias(f"g{i}"), F.count_if(gone & F.col("toxic")).alias(f"t{i}")]
        each = [F.struct(F.lit(letters[i]).alias("filter"), F.col(f"r{i}").alias("removed"), F.col(f"g{i}").alias("good_lost"), F.col(f"t{i}").alias("toxic_lost")) for i in left]
        survivors.groupBy("part").agg(*counts).select(F.lit(state).alias("state"), "part", "alive", F.inline(F.array(*each))).write.mode("append").parquet(path)
        for i in left:
            after = state | 1 << i
            if after not in seen and after != (1 << len(letters)) - 1:
                rest = survivors.where(~fails[letters[i]]).persist(StorageLevel.MEMORY_AND_DISK)
                visit(rest, after)
                rest.unpersist()

    start = rows.persist(StorageLevel.MEMORY_AND_DISK)
    visit(start, 0)
    start.unpersist()
    return rows.sparkSession.read.schema("state int, part string, alive long, filter string, removed long, good_lost long, toxic_lost long").parquet(path)


def filter_audit(rows: DataFrame, conditions: Mapping[str, str] = CONDITIONS) -> DataFrame:
    """Apply the filters in every order to ``rows`` (part, good, toxic, and what the
    conditions read).

    Method: the orders form a trie of prefixes, walked depth first. A node's survivors
    are a persisted DataFrame, made from its parent's by one more filter and let go when
    the branch is done, so as many are held at once as there are filters. Prefixes of
    the same filters have the same survivors and are visited once (2**n - 1 states in
    place of n! orders). Each visit counts in one aggregation by part what each further
    filter really removes from these survivors; the counts are written, never collected.

    Returns one row, zeros included, per part, filter_order and step (from 1): filter,
    kept, removed, redundant (fail the filter, removed earlier), unique_fails (fail it
    alone), good_lost, toxic_lost, shapley (the filter's removed, summed over all
    orders). A condition that is null doesn't fail. An empty table gives an empty result.
    Meant for few filters: the result has n! * n rows for each part.
    """
    letters, spark = list(conditions), rows.sparkSession
    fails = {f: F.coalesce(F.expr(c), F.lit(False)) for f, c in conditions.items()}
    edges = _edges(rows, fails)
    full = (1 << len(letters)) - 1
    before = lambda order, step: sum(1 << letters.index(f) for f in order[:step])
    steps = spark.createDataFrame(
        [("".join(order), step + 1, order[step], before(order, step)) for order in itertools.permutations(letters) for step in range(len(letters))],
        "filter_order string, step int, filter string, state int",
    )
    position = {f: 1 << i for i, f in enumerate(letters)}
    alone = F.coalesce(*[F.when(F.col("filter") == f, F.lit(full ^ bit)) for f, bit in position.items()])
    # as many orders reach an edge as its state and the filters after it can be ordered
    ways = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(len(letters) - 1 - k)) for k in range(len(letters))]), F.bit_count("state") + 1)
    of_filter = edges.groupBy("part", "filter").agg(
        F.max(F.when(F.col("state") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.col("state") == alone, F.col("removed"))).alias("alone"),
        F.sum(F.col("removed") * ways).alias("shapley"),
    )
    none = F.lit(0).cast("long")
    # a part whose rows are all gone before a state has no edges there
    return (
        of_filter.join(F.broadcast(steps), "filter")
        .join(edges, ["part", "filter", "state"], "left")
        .select(
            "part",
            "filter_order",
            "step",
            "filter",
            F.coalesce(F.col("alive") - F.col("removed"), none).alias("kept"),
            F.coalesce("removed", none).alias("removed"),
            (F.coalesce("fails", none) - F.coalesce("removed", none)).alias("redundant"),
            F.coalesce("alone", none).alias("unique_fails"),
            F.coalesce("good_lost", none).alias("good_lost"),
            F.coalesce("toxic_lost", none).alias("toxic_lost"),
            "shapley",
        )
    )


def text_filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """:func:`filter_audit` of the five text filters over whole texts; ``columns`` names
    the columns as in :func:`measured`."""
    return filter_audit(measured(docs, labels, **columns))

