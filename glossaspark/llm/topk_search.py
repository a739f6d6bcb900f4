"""Exact top-k inner products with norm-sorted blocks and residual bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

#: Above this product of lengths, float sums of integers could round.
EXACT = float(1 << 52)
#: Components above this take no part in the rotation, which is right for any rows.
LARGE = 1e100
BLOCK_SCHEMA = "block long, ids array<long>, flat array<double>, longest double, heads array<float>, rest array<float>, lens array<float>"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as double, which holds it exactly; null where
    the vector is null or holds a null or non-finite component, or one whose product
    isn't finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    large = float(1 << 53)  # doubles from here on are whole
    whole = lambda y: F.when(F.abs(y) < large, F.floor(y).cast("double")).otherwise(y)
    return F.when(ok, F.transform(vector, lambda x: whole(x.cast("double") * scale)))


def _matrix(flat: np.ndarray, rows: int) -> np.ndarray:
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def _dense(vectors: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    lengths = np.diff(vectors.offsets.to_numpy())
    out[np.arange(width)[None, :] < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _gram(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _dense(batch.column(1), width)
            x = x[(np.abs(x) < LARGE).all(axis=1)]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width * width, dtype=np.int64)), pa.array(total.ravel())], ["cell", "value"]
        )

    return run


def _rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of the matrix of all rows, by descending singular value;
    only width * width sums reach the driver."""
    gram = np.zeros(width * width)
    for cell, value in rows.mapInArrow(_gram(width), "cell long, value double").groupBy("cell").agg(F.sum("value")).collect():
        gram[cell] = value
    return np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1]


def _summary(x: np.ndarray, rotation: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first rotated components of each row, the length of the others, and the whole
    length, in single precision; infinite where they are too large."""
    with np.errstate(over="ignore", invalid="ignore"):
        turned = x @ rotation
        rest, whole = np.sqrt((turned[:, head:] ** 2).sum(axis=1)), np.sqrt((x**2).sum(axis=1))
        return tuple(np.nan_to_num(v, nan=np.inf, posinf=np.inf, neginf=-np.inf).astype(np.float32) for v in (turned[:, :head], rest, whole))


def _packed(width: int, size: int, rotation: np.ndarray, head: int):
    """Blocks of at most ``size`` vectors in the order they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, parts, held = [], [], 0

        def block(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            heads, rest, lens = _summary(x, rotation, head)
            with np.errstate(over="ignore"):
                longest = float(np.sqrt((x**2).sum(axis=1).max()))
            floats = [pa.array([v.ravel()], pa.list_(pa.float32())) for v in (heads, rest, lens)]
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([x.ravel()], pa.list_(pa.float64())), pa.array([longest]), *floats],
                ["block", "ids", "flat", "longest", "heads", "rest", "lens"],
            )

        for batch in batches:
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            parts.append(_dense(batch.column(1), width))
            held += batch.num_rows
            while held >= size:
                all_ids, x = np.concatenate(ids), np.concatenate(parts)
                yield block(all_ids[:size], x[:size])
                number += 1
                ids, parts, held = [all_ids[size:]], [x[size:]], held - size
        if held:
            yield block(np.concatenate(ids), np.concatenate(parts))

    return run


def _value(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _bounds(qh: np.ndarray, qr: np.ndarray, ql: np.ndarray, ph: np.ndarray, pr: np.ndarray, pl: np.ndarray, slack: float) -> np.ndarray:
    """At most these are the inner products: the partial sum over the head and
    Cauchy-Schwarz on the rest, with room for rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = qh @ ph.T + np.outer(qr, pr) + slack * np.outer(ql, pl) + 1
    return np.nan_to_num(bound, nan=np.inf, posinf=np.inf, neginf=np.inf)


def _asked(rotation: np.ndarray, head: int):
    """Adds the summaries of a query block to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                x = _matrix(_value(one, "qflat", 0), len(_value(one, "qids", 0)))
                floats = [pa.array([v.ravel()], pa.list_(pa.float32())) for v in _summary(x, rotation, head)]
                yield pa.RecordBatch.from_arrays([*one.columns, *floats], [*one.schema.names, "qheads", "qrest", "qlens"])

    return run


def _survivors(head: int):
    """Places in a block whose bound reaches the threshold of one of the queries."""
    slack = 1e-6 * (head + 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qh, qr, ql, least, ph, pr, pl = (_value(batch, c, i).astype(np.float64) for c in ("qheads", "qrest", "qlens", "least", "heads", "rest", "lens"))
                bound = _bounds(_matrix(qh, len(qr)), qr, ql, _matrix(ph, len(pr)), pr, pl, slack)
                places = np.flatnonzero((bound >= least[:, None]).any(axis=0)).astype(np.int32)
                if len(places):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("block").slice(i, 1), batch.column("qblock").slice(i, 1), pa.array([places], pa.list_(pa.int32()))], ["block", "qblock", "places"]
                    )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors at the surviving places."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, places = _value(batch, "ids", i), _value(batch, "places", i)
            x = _matrix(_value(batch, "flat", i), len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("qblock").slice(i, 1), pa.array([ids[places]], pa.list_(pa.int64())), pa.array([x[places].ravel()], pa.list_(pa.float64()))],
                ["qblock", "ids", "flat"],
            )


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as long, exact; those beyond a long at its limits."""
    with np.errstate(over="ignore"):
        size = np.sqrt((q**2).sum(axis=1).max()) * np.sqrt((p**2).sum(axis=1).max())
    if size < EXACT:
        return np.rint(q @ p.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    limits = np.iinfo(np.int64)
    return np.clip(whole(q) @ whole(p).T, limits.min, limits.max).astype(np.int64)


def _best(k: int, tile: int = 256):
    """The k best candidates for each query of a query block; nothing below the query's
    threshold."""

    def one(qid, q, least, pid, p, ids_out):
        for start in range(0, len(q), tile):
            s = slice(start, start + tile)
            score = _products(q[s], p)
            mask = (score >= least[s][:, None]) & (qid[s][:, None] != pid[None, :])
            if score.shape[1] > k:
                low = np.where(mask, score, np.iinfo(np.int64).min)
                mask &= score >= np.partition(low, -k, axis=1)[:, -k][:, None]
            r, c = np.nonzero(mask)
            value, who = score[r, c], pid[c]
            order = np.lexsort((who, -value.astype(object) if len(value) and value.min() == np.iinfo(np.int64).min else -value, r))
            r, value, who = r[order], value[order], who[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            keep = rank < k
            ids_out.append((qid[s][r[keep]], who[keep], value[keep]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qid, pid = _value(batch, "qids", i), _value(batch, "ids", i)
                found: list = []
                if len(pid):
                    one(qid, _matrix(_value(batch, "qflat", i), len(qid)), _value(batch, "least", i), pid, _matrix(_value(batch, "flat", i), len(pid)), found)
                if found:
                    a, b, c = (np.concatenate([f[j] for f in found]) for j in range(3))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["query_id", "vec_id", "score"])

    return run


def top_k_inner_products(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "v",
    k: int = 5,
    block: int = 4096,
    query_block: int = 1024,
    head_share: float = 0.25,
) -> DataFrame:
    """The ``k`` largest inner products of each query with the other vectors.

    ``vectors`` and ``queries`` hold vectors of whole numbers (array of long or double;
    null vectors and null ids take no part; shorter vectors end in zeros). Vectors with
    the query's own id are not its candidates. Candidates are packed into blocks by
    descending length. The first block gives each query a threshold. Of the rest a query
    block meets only blocks whose longest vector can reach one of its thresholds, and
    first only their summaries: the leading SVD-rotated components and the length of
    the others, whose partial sums and residual bound leave few candidates. The whole
    vectors of these alone go on to the exact products. A task holds one pair of blocks
    at a time. Numbers are exact at any size; a score that no long holds stands at its
    limit.

    Returns (query_id, rank, vec_id, score), ties to the smaller vec_id, ranks from 1;
    fewer rows where there are fewer candidates. Repeated rows are candidates each;
    repeated queries count once. Empty tables give an empty result.
    """
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows, asked = pick(vectors), pick(queries).dropDuplicates()
    spark = vectors.sparkSession
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1, asked.agg(F.max(F.size("v"))).first()[0] or 1)
    rotation = _rotation(rows, width)
    head = max(1, int(width * head_share))

    length = F.aggregate("v", F.lit(0.0), lambda n, x: n + x * x)
    n = partitions(spark)
    blocks = materialize(
        rows.withColumn("length", length)
        .repartitionByRange(n, F.col("length").desc(), F.col("id"))
        .sortWithinPartitions(F.col("length").desc(), F.col("id"))
        .select("id", "v")
        .mapInArrow(_packed(width, block, rotation, head), BLOCK_SCHEMA),
        "blocks",
    )
    top = blocks.agg(F.max_by("block", F.struct("longest", -F.col("block")))).first()[0]
    count = max(1, -(-asked.count() // query_block))
    placed = asked.withColumn("qblock", F.pmod(F.xxhash64("id"), F.lit(count).cast("long")))

    def gathered(df: DataFrame) -> DataFrame:
        """Query blocks of (id, v, least, need) rows."""
        return (
            df.groupBy("qblock")
            .agg(F.collect_list(F.struct("id", "v", "least")).alias("q"), F.min("need").alias("needs"))
            .select(
                "qblock",
                "needs",
                F.transform("q", lambda x: x["id"]).alias("qids"),
                F.flatten(F.transform("q", lambda x: _padded(x["v"], width))).alias("qflat"),
                F.transform("q", lambda x: x["least"]).alias("least"),
            )
        )

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("qblock")
    best, schema, columns = _best(k), "query_id long, vec_id long, score long", ["qids", "qflat", "least", "ids", "flat"]
    lowest = F.lit(-(2**63)).cast("long")
    first_block = blocks.where(F.col("block") == F.lit(top)).select("ids", "flat", every)
    seeds = materialize(
        gathered(placed.withColumn("least", lowest).withColumn("need", F.lit(0.0))).join(first_block, "qblock").select(columns).mapInArrow(best, schema),
        "seeds",
    )
    floors = seeds.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("have"))
    thresholds = (
        placed.join(floors, placed["id"] == floors["query_id"], "left")
        .withColumn("least", F.when(F.col("have") >= k, F.col("low")).otherwise(lowest))
        .withColumn("len", F.sqrt(length))
        .withColumn("need", F.when(F.col("len") > 0, F.col("least") / F.col("len")).otherwise(F.when(F.col("least") <= 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))))
    )
    queries_now = materialize(
        gathered(thresholds).mapInArrow(
            _asked(rotation, head),
            "qblock long, needs double, qids array<long>, qflat array<double>, least array<long>, qheads array<float>, qrest array<float>, qlens array<float>",
        ),
        "queries",
    )
    pairs = (
        blocks.where(F.col("block") != F.lit(top))
        .select("block", "longest", every)
        .join(queries_now.select("qblock", "needs"), "qblock")
        .where(F.col("longest") * (1 + 1e-9) >= F.col("needs"))
        .select("block", "qblock")
    )
    survivors = (
        pairs.join(blocks.select("block", "heads", "rest", "lens"), "block")
        .join(queries_now.select("qblock", "least", "qheads", "qrest", "qlens"), "qblock")
        .mapInArrow(_survivors(head), "block long, qblock long, places array<int>")
    )
    rest = (
        survivors.join(blocks.select("block", "ids", "flat"), "block")
        .mapInArrow(_cut, "qblock long, ids array<long>, flat array<double>")
        .join(queries_now.select("qblock", "qids", "qflat", "least"), "qblock")
        .select(columns)
        .mapInArrow(best, schema)
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        seeds.unionByName(rest)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _padded(v: Column, width: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(v)))
