"""Mixing of sources to target weights by subset sums over document lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import sequences
from .common import materialize, n_words


def source_targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (1, 2, 3), limit: int = 3) -> dict[str | None, float]:
    """Words that each source gives: shares of the total by weight, the weights
    repeating over the sources in code-point order (null last). A target stops at
    ``limit`` times the source; the excess goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, out, open_ = float(sum(sizes.values())), {}, list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > limit * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = float(limit * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def targets_of(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """:func:`source_targets` over a written table (key, order, words) of any number of sources, which
    stay in Spark: (key, source_size, target).

    Sources are numbered by ranges of ``order``. What is left and the weight of those below their limit
    are two sums, and all sources whose share goes over the limit leave in one round of them, as there; a round takes no more
    than one pass over the table, and the driver sees its two numbers.
    """
    weight = F.array(*[F.lit(float(w)) for w in weights])
    placed = sequences.positions(sizes.withColumn("all", F.lit(0)), ["all"], ["order"], "place")
    rows = materialize(placed.select("key", F.col("words").alias("source_size"), F.get(weight, ((F.col("place") - 1) % len(weights)).cast("int")).alias("weight")), "weights")
    stop = F.col("source_size") * limit
    words = rows.agg(F.sum("source_size")).first()[0] or 0
    full = F.lit(False)
    while True:
        held, total, n = rows.agg(F.sum(F.when(full, stop)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if not total:
            break
        left = float(words - (held or 0))
        share = F.lit(left) * F.col("weight") / F.lit(total)
        wider = full | (share > stop)
        if rows.where(wider).count() == n:
            return rows.select("key", "source_size", F.when(full, stop.cast("double")).otherwise(share).alias("target"))
        full = wider
    return rows.select("key", "source_size", stop.cast("double").alias("target"))


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, bound: int = 1 << 15) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to
    ``budget`` from below as possible.

    First the same share of every length; then single documents, until at most
    ``bound`` words are open; for these a bounded knapsack over the remaining counts,
    each count split into powers of two, marks every reachable sum with the piece that
    reached it first.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return counts.copy()
    take = counts * budget // total if total < 1 << 31 else np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left = budget - int((take * lengths).sum())
    order = np.argsort(-lengths, kind="stable")
    while left > bound:
        before = left
        for i in order:
            if 0 < lengths[i] <= left and take[i] < counts[i] and left > bound:
                take[i] += 1
                left -= int(lengths[i])
        if left == before:
            break
    left = min(left, bound)
    reach, by = np.zeros(left + 1, dtype=bool), np.full(left + 1, -1, dtype=np.int64)
    reach[0] = True
    pieces: list[tuple[int, int, int]] = []
    for i in order:
        length, spare, part = int(lengths[i]), int(counts[i] - take[i]), 1
        if not length:
            continue
        while spare > 0 and not reach[left]:
            part = min(part, spare)
            weight = length * part
            if weight > left:
                break
            new = np.flatnonzero(reach[: left + 1 - weight] & ~reach[weight:]) + weight
            by[new] = len(pieces)
            reach[new] = True
            pieces.append((int(i), part, weight))
            spare, part = spare - part, part * 2
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, part, weight = pieces[by[at]]
        take[i] += part
        at -= weight
    return take


def _fit(bound: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        total, target = int((rows["size"] * rows["n"]).sum()), float(rows["target"].iloc[0])
        times = int(target // total) if total else 0
        budget = round(target - times * total)
        take = fit_lengths(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), budget, bound)
        return pd.DataFrame({"key": rows["key"], "size": rows["size"], "times": times, "take": take})

    return run


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    limit: int = 3,
    seed: int = 17,
    bound: int = 1 << 15,
    salts: int = 64,
) -> DataFrame:
    """How often each document enters a mix of the sources.

    A document's size is its number of words (null text: 0). Targets: see
    :func:`source_targets`. A source gives whole passes and then documents chosen so
    that the words of the chosen lengths fill the rest (:func:`fit_lengths` over the
    source's histogram of exact lengths, one row per length). Of each length the
    documents with the smallest seeded hashes are taken, the same ones in each run.
    The choice first settles hash ranges of a length by their counts, so a length that
    a third of all documents have is never sorted in one task.

    The driver sees sums only (:func:`targets_of`). Returns (doc_id, source, size, source_size,
    target, times, taken), one row per row of ``docs``; taken = times * size. Sources
    of no words have target 0. Rows without source form one source, which comes last.
    Repeated rows are documents each; null ids are allowed; other columns are ignored.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    sized = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"))
        .withColumn("key", key)
        .withColumn("hash", F.xxhash64(F.lit(seed), "doc_id", "key", "size", "text_hash"))
        .drop("text_hash")
        .withColumn("salt", F.pmod("hash", F.lit(salts)).cast("int")),
        "sized",
    )
    order = F.when(F.col("key") == "", "1").otherwise(F.concat(F.lit("0"), F.col("key")))
    sizes = materialize(sized.groupBy("key").agg(F.sum("size").alias("words")).withColumn("order", order), "sources")
    targets = materialize(targets_of(sizes, weights, limit), "targets")
    lengths = sized.groupBy("key", "size", "salt").agg(F.count("*").alias("n"))
    lengths = materialize(lengths, "lengths")
    fitted = (
        lengths.groupBy("key", "size")
        .agg(F.sum("n").alias("n"))
        .join(targets, "key")
        .groupBy("key")
        .applyInPandas(_fit(bound), "key string, size long, times int, take long")
    )
    before = Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shares = (
        lengths.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(fitted, ["key", "size"])
        .select("key", "size", "salt", "times", (F.col("take") - F.col("before")).alias("open"))
    )
    rank = Window.partitionBy("key", "size", "salt").orderBy("hash", "doc_id")
    times = (F.col("times") + F.when(F.row_number().over(rank) <= F.col("open"), 1).otherwise(0)).cast("int")
    return (
        sized.join(shares, ["key", "size", "salt"])
        .withColumn("times", times)
        .join(targets, "key")
        .select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))
    )


def mixed_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings
) -> DataFrame:
    """The mix of :func:`mix_sources` as rows: each document as often as the mix takes
    it, with all its columns. Rows alike in id, source and size share their takes."""
    times = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **settings)
    hashed = lambda a, b, c: F.xxhash64(a, F.coalesce(F.concat(F.lit("="), b), F.lit("")), c)
    takes = times.groupBy(hashed(F.col("doc_id"), F.col("source"), F.col("size")).alias("__key")).agg(
        F.sum("times").alias("__times"), F.count("*").alias("__rows")
    )
    size = n_words(F.col(text_col))
    alike = Window.partitionBy("__key").orderBy(F.xxhash64(text_col))
    extra = F.when(F.row_number().over(alike) <= F.col("__times") % F.col("__rows"), 1).otherwise(0)
    return (
        docs.withColumn("__key", hashed(F.col(id_col), F.col(source_col).cast("string"), size))
        .join(takes.where("__times > 0"), "__key")
        .withColumn("__take", (F.floor(F.col("__times") / F.col("__rows")) + extra).cast("int"))
        .where("__take > 0")
        .withColumn("__take", F.explode(F.sequence(F.lit(1), F.col("__take"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
