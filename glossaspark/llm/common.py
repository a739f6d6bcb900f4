"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete_path, scratch_path

#: One word, and the gap between two words (ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends
    there, so a lost executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(spark: SparkSession) -> None:
    """Let shuffle files of finished steps go: Spark deletes them once the driver has
    collected their plans."""
    gc.collect()
    spark._jvm.System.gc()


def drop_scratch(*frames: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more, and the shuffle
    files of finished steps."""
    for df in frames:
        path = getattr(df, "scratch", None)
        if path:
            delete_path(df.sparkSession, path)
    if frames:
        release(frames[0].sparkSession)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(many: DataFrame, one: DataFrame, key: str, row: str, how: str = "inner") -> DataFrame:
    """Inner or left join of ``many`` with ``one``, a written table of one row per key that
    counts the rows of ``many`` in ``n``; ``n`` doesn't come along.

    A key with more than a quarter of a partition's share of all rows is dealt over
    several tasks by a hash of the column ``row``. Such keys are fewer than four times the
    partitions, whatever the input, so their list is broadcast; the rows of ``one`` that
    are repeated for them are fewer than eight times the partitions.
    """
    total, most = one.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    share = max(1, int(total) // (4 * partitions(many.sparkSession)))
    if most <= share:
        return many.join(one.drop("n"), key, how)
    salts = F.ceil(F.col("n") / share).cast("int")
    hot = F.broadcast(one.where(F.col("n") > share).select(key, salts.alias("salts")))
    return (
        many.join(hot, key, "left")
        .withColumn("salt", F.coalesce(F.pmod(F.xxhash64(row), F.col("salts")).cast("int"), F.lit(0)))
        .drop("salts")
        .join(one.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n"), [key, "salt"], how)
        .drop("salt")
    )


def n_words(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    limit = 1 << 19

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words, in order."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    k = np.uint64(factor)
    out = hashes[:count].copy()
    for i in range(1, n):
        out = out * k + hashes[i : i + count]
    return mix(out)
