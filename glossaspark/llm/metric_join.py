"""Exact self-join of documents by the Jaccard distance of their word n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import scratch_path
from .common import WordHashes, drop_scratch, materialize, mix, partitions, release, salted_join
from .components import connected_components
from .near_dedup import shingle_set
from .set_groups import SetGroups

#: Members, and shingles, that are compared in one piece.
MEMBERS = 1024
SHINGLES = 1 << 20
#: Shingles of small regions that share a task's group.
PARCEL = 1 << 17
#: Columns of the incidence matrix that are multiplied at once.
COLUMNS = 4096
#: Bins of anchors for each partition, to find bins that hold a frequent one.
BINS = 64
#: Allowance for rounding where distances are compared.
SLACK = 1e-9


class Anchors:
    """Keys of which two sets with a similarity of ``percent`` % share at least one.

    Sets of sizes s <= m that similar differ in at most (s + m)(100 - p)/(100 + p)
    shingles. If their shingles are dealt over ``spare + 1`` more blocks than that by
    hash, ``spare + 1`` blocks at least are equal in both. The key of a block is a hash of
    its whole content. Empty blocks give no key, but where a set has more than ``spare``
    of them. Sizes are cut into bands, a scheme of blocks for each; a set takes part in
    the scheme of the next band if it is large enough to be similar to a set there.
    """

    def __init__(self, percent: int, spare: int = 1, growth: float = 1.5):
        self.percent, self.spare = percent, spare
        growth = max(growth, 100 / percent)  # no pair reaches beyond the next band
        least = -(-(100 + percent) // (2 * (100 - percent)))
        edges = [least]
        while edges[-1] < 1 << 40:
            edges.append(math.ceil(edges[-1] * growth))
        self.edges = np.array(edges)
        self.blocks = [2 * (int(high) - 1) * (100 - percent) // (100 + percent) + 1 + spare for high in edges[1:]]

    def schemes(self, n: int) -> list[int]:
        band = int(np.searchsorted(self.edges, n, side="right")) - 1
        return [i for i in (band, band + 1) if i >= 0 and (i == band or 100 * n >= self.percent * self.edges[i])]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        out = []
        for scheme in self.schemes(len(shingles)):
            count = self.blocks[scheme]
            block = (shingles >> np.uint64(20)) % np.uint64(count)
            total = np.zeros(count, dtype=np.uint64)
            np.add.at(total, block.astype(np.int64), mix(shingles + np.uint64(0x9E3779B97F4A7C15)))
            used = np.flatnonzero(np.bincount(block.astype(np.int64), minlength=count))
            if count - len(used) > self.spare:
                used = np.arange(count)
            out.append(mix(total[used] ^ mix(used.astype(np.uint64) + np.uint64(scheme << 40) + np.uint64(1))))
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _anchored(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, anchors = WordHashes(), Anchors(percent)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                piece = batch.slice(start, 1000)
                sets = [shingle_set(t.as_py(), size, cache) for t in piece.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([anchors(s).view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_key", "anchors"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                sets = [shingle_set(t.as_py(), size, cache) for t in piece.column(1)]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "set_key", "shingles"]
                )

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right``."""
    every = np.concatenate([*left, *right])
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    common = times[column] > 1
    column, row = column[common], row[common]
    order = np.argsort(column, kind="stable")
    _, column = np.unique(column[order], return_inverse=True)
    row, out = row[order], np.zeros((len(left), len(right)), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, z = np.searchsorted(column, [first, first + COLUMNS])
        held = np.zeros((len(left) + len(right), COLUMNS), dtype=np.float32)
        held[row[a:z], column[a:z] - first] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def _smallest(near: np.ndarray) -> np.ndarray:
    """For each node of a symmetric matrix of links the first node that it reaches."""
    label = np.arange(len(near))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def _compared(percent: int):
    """Links within a block of a region, between two blocks, or within each of several
    small regions: a tree for each group of linked members in place of all its pairs."""
    width = 1 - percent / 100 + SLACK

    def run(key: tuple, members: pa.Table) -> pa.Table:
        lo, hi = key[1].as_py(), key[2].as_py()
        members = members.sort_by("region")
        region, doc, comp, block, far = (members.column(k).to_numpy() for k in ("region", "doc_id", "comp", "block", "far"))
        sets = [x.values.to_numpy(zero_copy_only=False) for x in members.column("shingles")]
        size = np.array([len(s) for s in sets])
        ends = np.flatnonzero(np.append(region[1:] != region[:-1], True)) + 1
        u, v = [], []
        for first, last in zip([0, *ends[:-1]], ends, strict=True):
            mine = np.arange(first, last)
            x, y = mine[block[mine] == lo], mine[block[mine] == hi]
            if not len(x) or not len(y):
                continue
            both = _overlaps([sets[k] for k in x], [sets[k] for k in y])
            linked = (100 + percent) * both.astype(np.int64) >= percent * (size[x][:, None] + size[y][None, :])
            linked &= (comp[x][:, None] != comp[y][None, :]) & (np.abs(far[x][:, None] - far[y][None, :]) <= width)
            near = np.zeros((len(mine), len(mine)), dtype=bool)
            near[np.ix_(x - first, y - first)] = linked
            tree = _smallest(near | near.T)
            joined = np.flatnonzero(tree != np.arange(len(mine)))
            u.append(doc[mine[joined]])
            v.append(doc[mine[tree[joined]]])
        found = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (u, v)]
        return pa.table([pa.array(x, pa.int64()) for x in found], ["u", "v"])

    return run


def _stars(nodes: DataFrame) -> DataFrame:
    """(pivot, doc_id) for each anchor of several members, from the written ``nodes`` (doc_id,
    anchors): its smallest member, and each of the others.

    Nearly all anchors have one member, so what is shuffled is their whole number: they
    are shuffled once, and the smallest comes first in a sorted run. Bins of anchors with more than a
    quarter of a partition's share of the rows may hold a frequent anchor. They are fewer than four
    times the partitions; their rows are aggregated and dealt over several tasks instead.
    """
    count = partitions(nodes.sparkSession)
    held = nodes.select("doc_id", F.explode("anchors").alias("anchor")).withColumn("bin", F.pmod("anchor", F.lit(BINS * count)))
    loads = materialize(held.groupBy("bin").agg(F.count("*").alias("n")), "loads")
    share = max(1, int(loads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // (4 * count))
    full = F.broadcast(loads.where(F.col("n") > share).select("bin"))
    run = Window.partitionBy("anchor").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    first = held.join(full, "bin", "left_anti").select("doc_id", F.first("doc_id").over(run).alias("pivot"))
    out = first.where("doc_id <> pivot").select("pivot", "doc_id")
    if full.isEmpty():
        return out
    dense = materialize(held.join(full, "bin", "left_semi").select("doc_id", "anchor"), "dense")
    cells = materialize(dense.groupBy("anchor").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("z"), F.count("*").alias("n")).where("pivot < z").drop("z"), "cells")
    return out.unionByName(salted_join(dense, cells, "anchor", "doc_id").where("doc_id <> pivot").select("pivot", "doc_id"))


def _by_document(sets: DataFrame) -> DataFrame:
    """The sets as a table bucketed by doc_id: of its joins only the other side, ids and numbers,
    is shuffled. The rows come from a shuffle by doc_id, so a task writes the buckets of its partitions only."""
    spark = sets.sparkSession
    path = scratch_path(spark, "sets")
    name = "sets_" + path.rsplit("-", 1)[1]
    sets.write.bucketBy(partitions(spark), "doc_id").option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out.table_name, out.scratch = name, path
    return out


def _distance(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 1 - both / (F.size(a) + F.size(b) - both)


def _close(far: Column, percent: int) -> Column:
    return far <= 1 - percent / 100 + SLACK


def jaccard_join(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    percent: int = 90,
    pivots: int = 8,
    rounds: int = 3,
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at
    least ``percent`` %, found exactly. A-Z are lower-cased; shingles are compared by
    64-bit hashes.

    Method: a metric-space join. Unrelated texts are all at a distance near 1 of each
    other, where the windows of the triangle inequality take in every region. So the
    space is first opened by exact anchors (:class:`Anchors`): similar sets share one.
    The smallest member of each anchor is a pivot; its region is all that share an anchor
    with it. A document links to the pivots within ``eps = 1 - percent/100``. A region
    whose members are all in one component is done. In the others only members
    stay that the triangle inequality leaves a partner: as |d(x,p) - d(y,p)| <= eps for
    partners, those of the pivot's component stay only if their distance to it is
    within eps of the distances of the rest.

    A region of more than ``MEMBERS`` members then draws ``pivots`` pivots of its own: each member
    goes to the region of its nearest pivot (Voronoi) and is repeated in each region q
    with d(x,q) <= d(x,home) + 2 eps, where partners across the boundary meet. This recurs
    for up to ``rounds`` rounds, as long as the regions get smaller by a quarter. Regions that
    are then small are compared exactly in one task each, larger ones block by block. Members of one
    component are not compared any more, and a task returns a tree of the links that it finds, so
    copies make no square number of rows. No link between different components is lost.

    Returns one row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id
    reachable, itself included), kept (doc_id = component_id). Null and empty texts, and
    texts without words, have no shingles and stand alone, unless another row of their
    doc_id has some; rows of one doc_id are in one component. A null doc_id stands alone:
    component_id is null and kept is true. An empty table gives an empty result; other columns are ignored.
    """
    if not 0 < percent < 100:
        raise ValueError("percent is between 1 and 99")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(slim.mapInArrow(_anchored(shingle, percent), "doc_id long, n_shingles long, set_key binary, anchors array<long>"), "anchored")
    groups = SetGroups.of(signed)

    nodes = materialize(groups.nodes.select("doc_id", "anchors"), "nodes")
    release(docs.sparkSession)
    stars = materialize(_stars(nodes).distinct(), "stars")
    drop_scratch(nodes)
    wanted = stars.select("doc_id").union(stars.select("pivot")).distinct()
    # the list of ids grows with the documents: it is never broadcast
    hashed = slim.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc_id long, set_key binary, shingles array<long>")
    if not groups.full.groupBy("doc_id").count().where("count > 1").isEmpty():
        # of the rows of an id those of its nodes
        nodes = groups.reps.withColumnRenamed("rep", "doc_id")
        hashed = hashed.join(nodes, ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id", "set_key"])
    sets = _by_document(hashed.select("doc_id", "shingles", F.size("shingles").alias("width")))
    release(docs.sparkSession)

    # level 1: the distances of all members of a region to its pivot
    centres = materialize(stars.groupBy("pivot").agg(F.count("*").alias("n")).join(sets.select(F.col("doc_id").alias("pivot"), F.col("shingles").alias("of_pivot")), "pivot"), "pivots")
    far = materialize(
        salted_join(stars.join(sets.drop("width"), "doc_id"), centres, "pivot", "doc_id").select("pivot", "doc_id", _distance(F.col("shingles"), F.col("of_pivot")).alias("far")), "distances"
    )
    links = far.where(_close(F.col("far"), percent)).select(F.col("doc_id").alias("u"), F.col("pivot").alias("v"))
    found = materialize(connected_components(links.unionByName(groups.bridges)), "components")
    centre = centres.select("pivot", F.col("pivot").alias("doc_id"), F.lit(0.0).alias("far"))
    regions = _undecided(far.unionByName(centre).withColumnRenamed("pivot", "region"), found, percent)
    drop_scratch(stars, far, centres)

    leaves = []
    for level in range(rounds):
        large = materialize(regions.groupBy("region").agg(F.count("*").alias("n"), *[F.min_by("doc_id", F.xxhash64(F.lit(level * pivots + i), "region", "doc_id")).alias(f"q{i}") for i in range(pivots)]).where(F.col("n") > MEMBERS), "large")
        if large.isEmpty():
            break
        split, rest = _split(regions, large, sets, pivots, percent)
        leaves.append(rest)
        links = materialize(split.where(_close(F.col("far"), percent)).select(F.col("doc_id").alias("u"), F.col("pivot").alias("v")).where("u <> v").distinct(), "links")
        found = _grown(found, links)
        regions = _undecided(split.where(F.col("far") <= F.col("home") + 2 * (1 - percent / 100) + SLACK).select(F.xxhash64("region", "pivot").alias("region"), "doc_id", "far"), found, percent)
        drop_scratch(links, split, large)
    leaves.append(regions)

    apart = leaves[0]
    for more in leaves[1:]:
        apart = apart.unionByName(more)
    more = materialize(_links_inside(_undecided(apart.select("region", "doc_id", "far"), found, percent), sets, percent).distinct(), "links")
    final = found if more.isEmpty() else _grown(found, more)
    docs.sparkSession.sql(f"DROP TABLE {sets.table_name}")
    drop_scratch(sets, *leaves)
    return groups.components(final)


def _grown(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links; the stars of the earlier ones stand for theirs."""
    return materialize(connected_components(links.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v")))), "components")


def _undecided(members: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The members (region, doc_id, far) that may still have a partner of another component
    in their region, with their component. The component that reaches closest to the pivot is the main
    one; its members have to be within eps of the distances of the others."""
    width = 1 - percent / 100 + SLACK
    labelled = materialize(
        members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("region", "doc_id", "far", F.coalesce("component", "doc_id").alias("comp")), "labelled"
    )
    main = labelled.groupBy("region").agg(F.min_by("comp", F.struct("far", "comp")).alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi").drop("lo", "hi")
    divided = materialize(salted_join(labelled, materialize(main, "main"), "region", "doc_id"), "divided")
    span = materialize(divided.groupBy("region").agg(F.min(F.when(F.col("comp") != F.col("main"), F.col("far"))).alias("least"), F.max(F.when(F.col("comp") != F.col("main"), F.col("far"))).alias("most"), F.count("*").alias("n")), "span")
    kept = salted_join(divided, span, "region", "doc_id").where((F.col("comp") != F.col("main")) | F.col("far").between(F.col("least") - width, F.col("most") + width))
    out = materialize(kept.select("region", "doc_id", "far", "comp"), "regions")
    drop_scratch(labelled, divided, span)
    return out


def _split(regions: DataFrame, large: DataFrame, sets: DataFrame, pivots: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members of the large regions with each pivot of theirs (region, doc_id, pivot, far,
    home: the distance of the nearest), and the regions that stay as they are: small ones, and
    those that a division leaves with a part of three quarters of their members."""
    chosen = large.select("region", "n", F.explode(F.array_distinct(F.array(*[f"q{i}" for i in range(pivots)]))).alias("doc_id"))
    # few sets for each region: there are fewer of them than members by MEMBERS / pivots
    centres = materialize(chosen.join(sets, "doc_id").groupBy("region").agg(F.first("n").alias("n"), F.collect_list(F.struct(F.col("doc_id").alias("q"), "shingles")).alias("centres")), "centres")
    each = F.transform("centres", lambda c: F.struct(c["q"].alias("pivot"), _distance(F.col("shingles"), c["shingles"]).alias("far")))
    dealt = materialize(
        salted_join(regions.join(sets, "doc_id"), centres, "region", "doc_id")
        .select("region", "doc_id", each.alias("each"))
        .select("region", "doc_id", F.array_min(F.transform("each", lambda e: e["far"])).alias("home"), F.inline("each")),
        "dealt",
    )
    near = dealt.where(F.col("far") <= F.col("home") + 2 * (1 - percent / 100) + SLACK)
    parts = near.groupBy("region", "pivot").agg(F.count("*").alias("n")).groupBy("region").agg(F.max("n").alias("part"))
    useful = materialize(parts.join(large.select("region", "n"), "region").where("part < 0.75 * n").select("region"), "useful")
    split = materialize(dealt.join(useful, "region", "left_semi"), "split")
    rest = materialize(regions.join(useful, "region", "left_anti"), "rest")
    drop_scratch(dealt, centres)
    return split, rest


def _links_inside(regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) within the regions. Small regions share a group of about ``PARCEL``
    shingles; the blocks of a large one meet in a group for each two of them."""
    weighed = materialize(regions.join(sets.select("doc_id", "width"), "doc_id"), "weighed")
    blocks = F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("width") / SHINGLES)).cast("int")
    sizes = materialize(weighed.groupBy("region").agg(F.count("*").alias("n"), F.sum("width").alias("weight"), blocks.alias("blocks")), "sizes")
    parcels = int(sizes.where("blocks = 1").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]) // PARCEL + 1
    parcel = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("region"), F.lit(parcels))).otherwise(F.col("region"))
    members = (
        salted_join(weighed, sizes.drop("weight"), "region", "doc_id")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("region", "doc_id", "comp", "block", "far", parcel.alias("parcel"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    )
    return members.join(sets.drop("width"), "doc_id").groupBy("parcel", "x", "y").applyInArrow(_compared(percent), "u long, v long")
