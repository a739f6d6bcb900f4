"""Token counts of documents in flat token files without an index."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions

#: Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _tokenise(vocabulary: bytes, docs_per_file: int, bytes_per_file: int):
    """Ids of each text, its place in the task and the number of its file there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        n = piece = docs = size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                out, pieces, first = [], [], n
                for text in batch.slice(start, 500).column(0):
                    ids = np.array(encode(text.as_py() or ""), dtype="<u2").tobytes()
                    if docs and (docs >= docs_per_file or size + len(ids) + 2 > bytes_per_file):
                        piece, docs, size = piece + 1, 0, 0
                    docs, size, n = docs + 1, size + len(ids) + 2, n + 1
                    out.append(ids)
                    pieces.append(piece)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pieces, pa.int32()), pa.array(range(first, n), pa.int64()), pa.array(out, pa.binary())], ["piece", "n", "ids"]
                )

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    *,
    vocabulary: str,
    text_col: str = "text",
    separator: int = 50256,
    docs_per_file: int = 20_000,
    bytes_per_file: int = 1 << 28,
) -> None:
    """Tokenise each text and write flat files of little-endian 16-bit ids, the
    separator id after each document, and nothing else.

    Spark's own text writer does it: a row is the bytes of a document's ids, the line
    separator the two bytes of the separator id. A task starts a file, in the next
    folder ``piece=N``, before one has more than ``docs_per_file`` documents or
    ``bytes_per_file`` bytes; only a single document makes a larger file. Null and empty
    texts are documents of no tokens. The separator never comes from a text: special
    tokens are not encoded.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    ids = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(
        _tokenise(ranks, docs_per_file, bytes_per_file), "piece int, n long, ids binary"
    )
    (
        ids.sortWithinPartitions("piece", "n")  # the writer wants the files one after the other
        .select("piece", F.col("ids").cast("string").alias("value"))
        .write.partitionBy("piece")
        .option("encoding", "ISO-8859-1")
        .option("lineSep", separator.to_bytes(2, "little").decode("latin-1"))
        .option("compression", "none")
        .text(path)
    )


FOUND = "file string, block int, n long, places array<long>"


def _positions(separator: int, file: str, block: int, data) -> pa.RecordBatch:
    """Positions of the separator in a block, found in one vectorised comparison."""
    ids = np.frombuffer(data, dtype="<u2")
    places = np.flatnonzero(ids == separator)
    return pa.RecordBatch.from_arrays(
        [pa.array([file]), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([places], pa.list_(pa.int64()))],
        ["file", "block", "n", "places"],
    )


def _search(separator: int):
    """Blocks that hold their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, data in zip(*batch.columns, strict=True):
                yield _positions(separator, file.as_py(), block.as_py(), data.as_buffer())

    return run


def arrow_store(file: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a URI: local and mounted disks, HDFS, and the object stores
    that Arrow reads."""
    # Hadoop writes file:/x where Arrow wants file:///x
    return arrow_fs.FileSystem.from_uri("file:///" + file[5:].lstrip("/") if file.startswith("file:") else file.replace("s3a://", "s3://", 1))


def _readable(folder: str) -> bool:
    """Whether byte ranges below the folder can be read."""
    try:
        store, inside = arrow_store(folder)
        return store.get_file_info(inside).type != arrow_fs.FileType.NotFound
    except (OSError, ValueError):  # a scheme that Arrow lacks, or no client for it here
        return False


def _search_ranges(separator: int):
    """Blocks by place: a task reads their byte ranges one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, inside = arrow_store(file)
                with store.open_input_file(inside) as f:
                    f.seek(offset)
                    data = f.read(size)
                if len(data) != size:
                    raise OSError(f"{file} changed while it was read")
                yield _positions(separator, file, block, data)

    return run


def separator_scan(spark: SparkSession, path: str, *, separator: int = 50256, block_tokens: int = 1 << 20) -> DataFrame:
    """Documents of flat files of little-endian 16-bit token ids, each document ended
    by the separator id; a document doesn't go on in another file.

    Files are cut into blocks of ``block_tokens`` tokens; each block is searched on its
    own, and a prefix scan over a file's blocks gives the number of documents before a
    block and the place where the document that runs into it began. So a document may
    cover any number of blocks.

    Returns (file, doc_no, start, n_tokens, closed): doc_no counts from 0 in its file
    (named by its path below ``path``),
    start in tokens, n_tokens without the separator; closed is false for tokens after
    a file's last separator. An empty file has no documents. A file of an odd number
    of bytes stops the query. An empty folder gives an empty result.
    """
    step = 2 * block_tokens
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    even = F.when(F.col("length") % 2 == 0, F.col("length")).otherwise(
        F.raise_error(F.concat(F.lit("odd number of bytes in "), "path")).cast("long")
    )
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").withColumn("length", even)
    block = F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / step).cast("int"))).alias("block")
    # whole files only where no range can be read, as in a mount table of Hadoop's own
    if _readable(store.makeQualified(root).toString()):
        offset = F.col("block").cast("long") * step
        blocks = files.select("path", "length", block).select(
            "path", "block", offset.alias("offset"), F.least(F.lit(step).cast("long"), F.col("length") - offset).alias("size")
        )
        found = blocks.repartition(partitions(spark)).mapInArrow(_search_ranges(separator), FOUND)
    else:
        blocks = files.select("path", "content", block).select(
            "path", "block", F.substring("content", F.col("block") * step + 1, F.lit(step)).alias("data")
        )
        found = blocks.mapInArrow(_search(separator), FOUND)
    prior = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("file").orderBy("block")
    start = F.col("block").cast("long") * block_tokens
    scanned = found.select(
        "file",
        "block",
        start.alias("at"),
        "n",
        "places",
        F.coalesce(F.sum(F.size("places")).over(prior), F.lit(0)).alias("docs_before"),
        (F.coalesce(F.max(start + F.try_element_at("places", F.lit(-1))).over(prior), F.lit(-1)) + 1).alias("open_at"),
        F.lead("block").over(later).isNull().alias("final"),
    )
    ends = F.transform(
        "places",
        lambda p, i: F.struct(
            (F.col("docs_before") + i).alias("doc_no"),
            F.when(i == 0, F.col("open_at")).otherwise(F.col("at") + F.get("places", i - 1) + 1).alias("start"),
            (F.col("at") + p).alias("end"),
            F.lit(True).alias("closed"),
        ),
    )
    open_at = F.when(F.size("places") > 0, F.col("at") + F.try_element_at("places", F.lit(-1)) + 1).otherwise(F.col("open_at"))
    rest = F.when(
        F.col("final") & (open_at < F.col("at") + F.col("n")),
        F.array(
            F.struct(
                (F.col("docs_before") + F.size("places")).alias("doc_no"),
                open_at.alias("start"),
                (F.col("at") + F.col("n")).alias("end"),
                F.lit(False).alias("closed"),
            )
        ),
    ).otherwise(F.array())
    below = store.makeQualified(root).toString().rstrip("/") + "/"
    name = F.when(F.startswith("file", F.lit(below)), F.substring("file", len(below) + 1, 1 << 30)).otherwise(F.regexp_extract("file", "[^/]*$", 0))
    return scanned.select("file", F.explode(F.concat(ends, rest)).alias("d")).select(
        name.alias("file"), "d.doc_no", "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"), "d.closed"
    )
