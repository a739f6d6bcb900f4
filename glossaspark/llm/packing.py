"""Length buckets of least padding, and token-budget batches inside them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, partitions


def optimal_widths(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least padding in
    total, by dynamic programming over the histogram."""
    order = np.argsort(lengths)
    size, n = np.array(lengths, dtype=np.float64)[order], np.array(counts, dtype=np.float64)[order]
    m = len(size)
    if not m:
        return []
    docs, words = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    best = np.full(m + 1, np.inf)
    best[0] = 0
    back = []
    for _ in range(min(buckets, m)):
        now, came = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        for j in range(1, m + 1):
            cost = best[:j] + size[j - 1] * (docs[j] - docs[:j]) - (words[j] - words[:j])
            came[j] = cost.argmin()
            now[j] = cost[came[j]]
        now[0] = 0
        back.append(came)
        best = now
    out, j = [], m
    for came in reversed(back):
        if not j:
            break
        out.append(int(size[j - 1]))
        j = came[j]
    return sorted(set(out))


def packed_batches(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 4096,
    budget: int = 32768,
    buckets: int = 16,
    seed: int = 23,
) -> DataFrame:
    """Batches of similar lengths for training.

    A document of more than ``max_tokens`` tokens (here: words) is cut into
    consecutive segments of that length, so the whole text stays and the histogram
    that reaches the driver has at most ``max_tokens + 1`` rows. Bucket widths come
    from :func:`optimal_widths`; a batch of a bucket holds budget // width segments,
    all padded to the width. Segments of a bucket are numbered in a seeded order:
    counts of hash ranges give each range its first number, so no bucket is sorted in
    one task.

    Returns (doc_id, copy, segment, n_tokens, bucket, width, batch, slot), a row for
    each segment; batch counts from 0 in its bucket, copy among rows alike in id and
    text. Rows without id are told apart, and spread, by the hash of their text. Null and empty texts give one segment
    of no tokens. Repeated rows are segments each; null ids are allowed; an empty table
    gives an empty result; other columns are ignored.
    """
    tokens = docs.select(F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("n"), F.xxhash64(text_col).alias("text_hash"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / max_tokens).cast("int") - 1)
    segments = materialize(
        tokens.select("doc_id", "n", "text_hash", F.explode(F.sequence(F.lit(0), last)).alias("segment")).select(
            "doc_id", "text_hash", "segment", F.least(F.lit(max_tokens), F.col("n") - F.col("segment") * max_tokens).cast("int").alias("n_tokens")
        ),
        "segments",
    )
    histogram = segments.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()
    widths = optimal_widths([r["n_tokens"] for r in histogram], [r["n"] for r in histogram], buckets) or [max_tokens]
    spark = docs.sparkSession
    total = sum(r["n"] for r in histogram)
    salts = max(-(-total // 50_000), -(-4 * partitions(spark) // len(widths)))
    bucket = F.size(F.filter(F.array(*[F.lit(w) for w in widths]), lambda w: w < F.col("n_tokens")))
    placed = (
        segments.withColumn("bucket", bucket)
        .withColumn("hash", F.xxhash64(F.lit(seed), "doc_id", "segment", "text_hash"))
        .withColumn("salt", F.pmod("hash", F.lit(salts)))
    )
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("bucket", "salt")
        .agg(F.count("*").alias("n"))
        .select("bucket", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("bucket", "salt").orderBy("hash", "doc_id", "segment")
    alike = Window.partitionBy("bucket", "salt", "hash", "doc_id", "segment").orderBy("text_hash")
    width = F.get(F.array(*[F.lit(w) for w in widths]), F.col("bucket"))
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), width))).cast("long")
    return (
        placed.withColumn("number", F.row_number().over(inside) - 1)
        .withColumn("copy", (F.row_number().over(alike) - 1).cast("int"))
        .join(offsets, ["bucket", "salt"])
        .withColumn("number", F.col("number") + F.col("offset"))
        .select(
            "doc_id",
            "copy",
            "segment",
            "n_tokens",
            "bucket",
            width.alias("width"),
            F.floor(F.col("number") / fits).cast("long").alias("batch"),
            F.pmod("number", fits).cast("int").alias("slot"),
        )
    )
