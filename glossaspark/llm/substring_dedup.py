"""Removal of repeated passages over a log-structured fingerprint index."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, delete_path, drop_scratch, gram_hashes, materialize, mix, partitions, release, scratch_path

#: Multipliers of the two halves of window digests; that of the fingerprints differs.
DIGEST = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[: len(x) - (width - have)], x[width - have :])


def window_fingerprints(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window of ``window`` words the least hash of its ``gram``-word runs.
    Equal windows have equal fingerprints, and neighbours mostly share theirs."""
    if len(hashes) < window:
        return np.empty(0, dtype=np.uint64)
    return _sliding_min(gram_hashes(hashes, gram), window - gram + 1)


def _fingerprints(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                ids = piece.column(0).to_pylist()
                found = [
                    np.unique(window_fingerprints(cache.of(_tokens(t.as_py())), window, gram)) for t in piece.column(1)
                ]
                sizes = [len(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.array(ids, dtype=np.int64), sizes))],
                    ["h", "doc_id"],
                )

    return run


class FingerprintIndex:
    """Sorted immutable runs of window hashes, bucketed by hash: (h, lo, hi, n) with the
    smallest and largest document and the number of documents of a hash.

    ``add`` writes a batch as a new run and merge-joins it with the earlier ones; both
    sides are bucketed alike, so history is never shuffled again. A run has one row for
    each hash, summed up before the shuffle, so a hash that very many documents share
    makes no large bucket. ``compact`` merges the runs into one.
    """

    def __init__(self, spark: SparkSession, *, window: int = 13, gram: int = 5, buckets: int | None = None, fanout: int = 3):
        self.spark, self.window, self.gram, self.fanout = spark, window, gram, fanout
        self.buckets = buckets or partitions(spark)
        self.runs: list[tuple[str, str]] = []

    def fingerprints(self, docs: DataFrame) -> DataFrame:
        """(h, doc_id), each pair once for a row of (doc_id, text)."""
        return docs.mapInArrow(_fingerprints(self.window, self.gram), "h long, doc_id long")

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        table, path = f"run_{uuid.uuid4().hex}", scratch_path(self.spark, "run")
        (
            rows.sortWithinPartitions("h")
            .write.bucketBy(self.buckets, "h")
            .sortBy("h")
            .option("compression", "zstd")
            .option("parquet.writer.version", "v2")
            .option("parquet.enable.dictionary", "false")
            .option("path", path)
            .saveAsTable(table)
        )
        return table, path

    def add(self, docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """Append (doc_id, text) rows, whose ids are new. Returns (h, n): the hashes of
        the batch that two documents have by now, and in how many documents they are.
        ``rows``: the :meth:`fingerprints` of ``docs`` where they are written already."""
        rows = self.fingerprints(docs) if rows is None else rows
        run = self._write(rows.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")))
        new = self.spark.table(run[0])
        for i, (table, _) in enumerate(self.runs):
            old = self.spark.table(table).select("h", F.col("lo").alias(f"lo{i}"), F.col("n").alias(f"n{i}"))
            new = new.join(old.hint("merge"), "h", "left")
        counts = [F.coalesce(f"n{i}", F.lit(0)) for i in range(len(self.runs))]
        known = F.coalesce(*[F.col(f"lo{i}") for i in range(len(self.runs))], F.col("hi"))
        shared = new.where((F.col("lo") < F.col("hi")) | (known != F.col("hi"))).select("h", sum(counts, F.col("n")).alias("n"))
        out = materialize(shared, "shared")
        self.runs.append(run)
        if len(self.runs) >= self.fanout:
            self.compact()
        return out

    def compact(self) -> None:
        """Merge all runs into one and delete them."""
        # by path: Spark 4.1 takes a union of bucketed tables for partitioned, which it isn't
        rows = self.spark.read.parquet(*[path for _, path in self.runs])
        merged = self._write(rows.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")))
        self.drop()
        self.runs = [merged]

    def drop(self) -> None:
        for table, path in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            delete_path(self.spark, path)
        self.runs = []


def _digests(hashes: np.ndarray, window: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96-bit digests of the windows that start ``at`` these words, as longs and ints."""

    def of(factor: int) -> np.ndarray:
        if 4 * len(at) > len(hashes):
            return gram_hashes(hashes, window, factor)[at]
        out = hashes[at]
        for i in range(1, window):
            out = out * np.uint64(factor) + hashes[at + i]
        return mix(out)

    return of(DIGEST[0]), (of(DIGEST[1]) >> np.uint64(32)).astype(np.uint32)


def _among(values: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which values are among the sorted marks, of which there is at least one."""
    return marks[np.minimum(np.searchsorted(marks, values), len(marks) - 1)] == values


def _windows(window: int, gram: int):
    """Digests of the windows whose fingerprint is among the given ones, each once for a
    document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                piece = batch.slice(start, 200)
                found, ids = [], piece.column(0).to_pylist()
                for text, shared in zip(piece.column(1), piece.column(2), strict=True):
                    hashes = cache.of(_tokens(text.as_py()))
                    marks = np.sort(shared.values.to_numpy(zero_copy_only=False).view(np.uint64))
                    hit = np.flatnonzero(_among(window_fingerprints(hashes, window, gram), marks))
                    one, two = _digests(hashes, window, hit)
                    one, at = np.unique(one, return_index=True)
                    found.append((one, two[at]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([x for x, _ in found]).view(np.int64)),
                        pa.array(np.concatenate([x for _, x in found]).view(np.int32)),
                        pa.array(np.repeat(np.array(ids, dtype=np.int64), [len(x) for x, _ in found])),
                    ],
                    ["digest", "digest2", "doc_id"],
                )

    return run


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                total, gone, kept_text = [], [], []
                for text, digests in zip(piece.column(1), piece.column(2), strict=True):
                    tokens = _tokens(text.as_py())
                    total.append(len(tokens))
                    if digests.is_valid and len(tokens) >= window:
                        marks = np.sort(digests.values.to_numpy(zero_copy_only=False).view(np.uint64))
                        here = gram_hashes(cache.of(tokens), window, DIGEST[0])
                        hit = _among(here, marks)
                        edges = np.zeros(len(tokens) + 1, dtype=np.int64)
                        edges[: len(hit)] += hit
                        edges[window : window + len(hit)] -= hit
                        covered = np.cumsum(edges[:-1]) > 0
                        tokens = [tokens[i] for i in np.flatnonzero(~covered)]
                    gone.append(total[-1] - len(tokens))
                    kept_text.append(b" ".join(tokens))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept_text, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return run


def _plain(docs: DataFrame, column: str, name: str, kind: str) -> Column:
    """The column as ``name`` and ``kind``. One that is so already stays bare: behind an
    alias, plans that share an exchange of it would look different to Spark."""
    if column == name and dict(docs.dtypes)[column] == kind:
        return F.col(column)
    return F.col(column).cast(kind).alias(name)


def remove_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 13,
    gram: int = 5,
    batches: int = 4,
    fanout: int = 3,
    many: int = 10_000,
) -> DataFrame:
    """Remove each word covered by a ``window``-word passage that also starts in a
    document with a smaller doc_id.

    The documents enter a :class:`FingerprintIndex` in batches by ascending doc_id.
    Its hits are verified on 96-bit digests of the whole windows, made of 64-bit hashes
    of their words: among 10**13 different windows the chance that any two agree is
    below 0.001, unless words differ that have one hash; the windows of one document are
    told apart by the first 64 bits. Documents with a hit give the digests of the
    windows there, and the smallest doc_id of each digest keeps it. Passages of
    ``many`` documents or more go through a join that can be split; the result is the
    same for any value.

    Returns (doc_id, n_words, n_removed, kept_text), one row per row of ``docs``;
    kept words are joined by one space. Null and empty texts have no words. Texts
    shorter than a window stay whole. Equal passages of rows with the same doc_id
    don't count against each other; rows without doc_id stay whole. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(_plain(docs, id_col, "doc_id", "bigint"), _plain(docs, text_col, "text", "string"))
    known = slim.where("doc_id IS NOT NULL")
    cuts = known.agg(
        F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [1.0], 10_000)
    ).first()[0] or []
    edges = [None, *sorted({*cuts} if batches > 1 else {}), None]
    index = FingerprintIndex(spark, window=window, gram=gram, fanout=fanout)
    found, prints = [], []
    for low, high in zip(edges, edges[1:], strict=False):
        part = known
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        prints.append(materialize(index.fingerprints(part), "prints"))
        found.append(index.add(part, prints[-1]))
        release(spark)
    index.drop()

    hashes = reduce(DataFrame.unionByName, found).groupBy("h").agg((F.max("n") >= many).alias("hot"))
    chosen = lambda hot: F.transform(F.filter("found", lambda x: x["hot"] == hot), lambda x: x["h"])
    # one row for each hash on one side, so its hash table is small and sorts are saved
    shared = materialize(
        reduce(DataFrame.unionByName, prints)
        .join(hashes.hint("shuffle_hash"), "h")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("h", "hot")).alias("found"))
        .select("doc_id", chosen(False).alias("few"), chosen(True).alias("many")),
        "marks",
    )
    drop_scratch(*prints, *found)
    n = partitions(spark)
    texts = known.repartition(n, "doc_id")  # one exchange for all joins
    marked = texts.join(shared, "doc_id")

    def windows(column: str) -> DataFrame:
        return marked.where(F.size(column) > 0).select("doc_id", "text", column).mapInArrow(_windows(window, gram), "digest long, digest2 int, doc_id long")

    # digests of fewer than ``many`` documents: one sorted group holds them
    first = Window.partitionBy("digest", "digest2").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cold = windows("few").select("doc_id", "digest", F.first("doc_id").over(first).alias("owner"))
    # others: owners by pre-aggregation, and a join that can be split
    owners = windows("many").groupBy("digest", "digest2").agg(F.min("doc_id").alias("owner"))
    hot = windows("many").join(owners, ["digest", "digest2"]).select("doc_id", "digest", "owner")
    # within one document the first half tells its windows apart
    again = cold.unionByName(hot).where("doc_id > owner").groupBy("doc_id").agg(F.collect_list("digest").alias("digests"))
    nameless = slim.where("doc_id IS NULL").withColumn("digests", F.lit(None).cast("array<long>"))
    return (
        texts.join(again, "doc_id", "left")
        .select("doc_id", "text", "digests")
        .unionByName(nameless)
        .mapInArrow(_removed(window), "doc_id long, n_words long, n_removed long, kept_text string")
    )
