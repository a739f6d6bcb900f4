"""MinHash near-duplicate detection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, drop_scratch, gram_hashes, materialize, mix, salted_join
from .components import connected_components
from .set_groups import SetGroups

#: Members of a bucket that are compared in one piece of work.
BLOCK = 1024
#: Minima of the finer sketches that such members are compared by.
SKETCH = 1024


def shingle_set(text: str | None, size: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a text, A-Z lower-cased.
    A text of fewer words is one shingle; one without words has none."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    return np.unique(gram_hashes(cache.of(tokens), min(size, len(tokens))))


def _universal(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    top = np.iinfo(np.uint64).max
    return rng.integers(0, top, count, dtype=np.uint64) | np.uint64(1), rng.integers(0, top, count, dtype=np.uint64)


class _Signer:
    def __init__(self, count: int, seed: int, width: int = 1024):
        a, b = _universal(count, seed)
        self.a, self.b, self.width = a[:, None], b[:, None], width
        self.buffer = np.empty((count, width), dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """The minimum of each universal hash a*x+b over the set, upper 32 bits."""
        least = None
        for i in range(0, len(shingles), self.width):
            x = shingles[i : i + self.width]
            out = self.buffer[:, : len(x)]
            np.multiply(self.a, x[None, :], out=out)
            np.add(out, self.b, out=out)
            low = out.min(axis=1)
            least = low if least is None else np.minimum(least, low)
        return (least >> np.uint64(32)).astype(np.uint32)


def _signatures(size: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sign = WordHashes(), _Signer(bands * rows, seed)
        salt = np.arange(1, bands + 1, dtype=np.uint64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                piece = batch.slice(start, 1000)
                ids, counts, keys, sigs, hashes = piece.column(0), [], [], [], []
                for text in piece.column(1):
                    s = shingle_set(text.as_py(), size, cache)
                    counts.append(len(s))
                    if not len(s):
                        keys.append(None)
                        sigs.append(None)
                        hashes.append(None)
                        continue
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sig = sign(s)
                    sigs.append(sig.view(np.int32))
                    h = mix(gram_rows(sig, bands, rows) + salt)
                    hashes.append(h.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(counts, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(sigs, pa.list_(pa.int32())),
                        pa.array(hashes, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_key", "sig", "bands"],
                )

    return run


def gram_rows(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit value for each band of a signature."""
    wide = mix(sig.astype(np.uint64).reshape(bands, rows) + np.uint64(0x9E3779B97F4A7C15))
    out = wide[:, 0].copy()
    for i in range(1, rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + wide[:, i])
    return out


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                sets = [shingle_set(t.as_py(), size, cache).view(np.int64) for t in piece.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"]
                )

    return run


def _sketches(seed: int):
    """The lowest byte of ``SKETCH`` further minima of a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = _Signer(SKETCH, seed + 1, width=128)
        for batch in batches:
            out = [sign(x.values.to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.uint8).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "sketch"])

    return run


def _cross_pairs(bands: int, least: int):
    """Pairs of a block, or of two blocks, of a bucket: of different components, not
    yet seen in an earlier band, with at least ``least`` equal bytes of their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            band, lo, hi = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            for i, members in enumerate(batch.column(3)):
                m = members.values
                doc, comp, block = (m.field(k).to_numpy(zero_copy_only=False) for k in ("doc", "comp", "block"))
                keys = m.field("bands").flatten().to_numpy(zero_copy_only=False).reshape(len(doc), bands)
                sketch = np.frombuffer(b"".join(m.field("sketch").to_pylist()), dtype=np.uint8).reshape(len(doc), SKETCH)
                first, second = np.flatnonzero(block == lo[i]), np.flatnonzero(block == hi[i])
                for x in first:
                    ys = second[(comp[second] != comp[x]) & ((doc[second] > doc[x]) | (lo[i] != hi[i]))]
                    ys = ys[(keys[ys] == keys[x]).argmax(axis=1) == band[i]]
                    ys = ys[np.count_nonzero(sketch[ys] == sketch[x], axis=1) >= least]
                    if len(ys):
                        left.append(np.minimum(doc[x], doc[ys]))
                        right.append(np.maximum(doc[x], doc[ys]))
            if left:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"]
                )

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 4,
    rounds: int = 2,
    seed: int = 11,
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at
    least ``percent`` %.

    Method: ``bands * rows`` universal hash minima, banding, signature verification,
    a check of each link on the full sets, connected components by alternating
    large-star and small-star. A pair at exactly 80 % meets in no band with a
    probability of ``(1 - 0.8**4)**32``, about 5e-8.

    A pair is dropped before the check on full sets if fewer of its minima agree than
    4.5 standard deviations below what ``percent`` % lets expect (at 80 %: fewer than 82
    of 128), which loses a link at exactly 80 % with a probability of about 9e-6 for
    each pair of documents.

    Documents with the same set are one node. A bucket first links each member with
    its smallest member only, then, for ``rounds`` rounds, members of other components
    with a drawn member. Members of one bucket that are then still in different
    components are compared block by block by finer sketches; only pairs that may be
    similar by these leave the task. So a group of copies makes no square number of rows, and no link
    between different components is lost.

    Returns one row per row of ``docs``: doc_id, n_shingles, component_id (smallest
    doc_id reachable, itself included), kept. Null and empty texts, and texts without
    words, have no shingles and stand alone, unless another row of their doc_id has
    some. Rows of one doc_id are in one component, whatever their texts. A null
    doc_id stands alone: component_id is null and kept is true. An empty table gives
    an empty result; other columns of ``docs`` are ignored.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(
        slim.mapInArrow(
            _signatures(shingle, bands, rows, seed),
            "doc_id long, n_shingles long, set_key binary, sig array<int>, bands array<long>",
        ),
        "signatures",
    )
    groups = SetGroups.of(signed)
    nodes, bridges = groups.nodes, groups.bridges

    banded = nodes.select("doc_id", F.posexplode("bands").alias("band", "bh"))
    shared = materialize(
        banded.groupBy("bh").agg(F.min("doc_id").alias("c"), F.max("doc_id").alias("z"), F.count("*").alias("n")).where("c < z").drop("z"), "shared"
    )
    members = materialize(salted_join(banded, shared, "bh", "doc_id").select("bh", "band", "doc_id", "c"), "members")
    drop_scratch(shared)
    wanted = members.select("doc_id").distinct()
    sigs = materialize(
        signed.select("doc_id", "set_key", "sig", "bands").where("sig IS NOT NULL").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "set_key"]).drop("set_key"), "sigs"
    )
    sets = materialize(
        slim.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc_id long, shingles array<long>"), "sets"
    )

    least = _least_equal(bands * rows, percent)
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)

    def similar(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
            .where(same >= least)
            .select("a", "b")
        )

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("xa", "xb"))
        return (
            pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xa")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("xb")), "b")
            .select("a", "b", both.alias("both"), (F.size("xa") + F.size("xb")).alias("sizes"))
            .where(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * percent)
            .select(F.col("a").alias("u"), F.col("b").alias("v"))
        )

    def labelled(found: DataFrame) -> DataFrame:
        return members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
            "bh", "band", "doc_id", F.coalesce("component", "doc_id").alias("comp")
        )

    def grown(found: DataFrame, links: DataFrame) -> DataFrame:
        """Components after more links; the stars of the earlier ones stand for theirs."""
        stars = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
        return materialize(connected_components(links.unionByName(stars)), "components")

    stars = members.where("doc_id <> c").select(F.col("c").alias("a"), F.col("doc_id").alias("b")).distinct()
    found = materialize(connected_components(materialize(confirmed(similar(stars)).unionByName(bridges), "links")), "components")
    for salt in range(rounds):
        # other centres: a member drawn anew for each bucket that is still divided
        now = materialize(labelled(found), "labelled")
        drawn = materialize(
            now.groupBy("bh")
            .agg(
                F.min("comp").alias("lo"),
                F.max("comp").alias("hi"),
                F.min_by(F.struct("doc_id", "comp"), F.xxhash64(F.lit(salt), "bh", "doc_id")).alias("centre"),
                F.count("*").alias("n"),
            )
            .where("lo < hi")
            .select("bh", "centre", "n"),
            "drawn",
        )
        pairs = (
            salted_join(now, drawn, "bh", "doc_id")
            .where(F.col("comp") != F.col("centre.comp"))
            .select(F.least("doc_id", "centre.doc_id").alias("a"), F.greatest("doc_id", "centre.doc_id").alias("b"))
            .distinct()
        )
        links = materialize(confirmed(similar(pairs)), "links")
        drop_scratch(now, drawn)
        if links.isEmpty():
            break
        found = grown(found, links)
        drop_scratch(links)

    now = materialize(labelled(found), "labelled")
    mixed = materialize(
        now.groupBy("bh")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
        .where("lo < hi")
        .select("bh", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "n"),
        "mixed",
    )
    apart = salted_join(now, mixed, "bh", "doc_id")
    sketches = sets.join(apart.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(
        _sketches(seed), "doc_id long, sketch binary"
    )
    details = materialize(sketches.join(sigs.select("doc_id", "bands"), "doc_id"), "sketches")
    member = F.struct(F.col("doc_id").alias("doc"), "comp", "block", "bands", "sketch")
    blocked = (
        apart.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .join(details, "doc_id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .groupBy("bh", "band", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
        .agg(F.collect_list(member).alias("members"))
        .select("band", "x", "y", "members")
    )
    pairs = blocked.mapInArrow(_cross_pairs(bands, _least_equal(SKETCH, percent)), "a long, b long").distinct()
    more = materialize(confirmed(materialize(pairs, "pairs")), "links")
    final = found if more.isEmpty() else grown(found, more)
    drop_scratch(sets, sigs, members, now, mixed, details)

    return groups.components(final)


def distinct_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One document of each group of near duplicates, with all its columns: the one with
    the smallest id. Of rows alike in id and text one stays; rows without id all stay."""
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **settings).where("kept AND doc_id IS NOT NULL")
    alike = Window.partitionBy(id_col, "__hash").orderBy("__hash")
    return (
        docs.join(kept.select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
        .withColumn("__hash", F.xxhash64(text_col))
        .withColumn("__n", F.row_number().over(alike))
        .where("__n = 1")
        .select(*[F.col(f"`{c}`") for c in docs.columns])
        .unionByName(docs.where(F.col(id_col).isNull()))
    )


def _least_equal(count: int, percent: int) -> int:
    """Equal minima below which a pair cannot be similar, but for 4.5 standard deviations."""
    j = percent / 100
    return max(1, int(count * j - 4.5 * (count * j * (1 - j)) ** 0.5))
