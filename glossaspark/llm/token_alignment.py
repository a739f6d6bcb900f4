"""Alignment of the tokens that two tokenizers make of the same texts."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import scratch_path
from .common import drop_scratch, materialize, partitions

#: Bytes of text in a bucket of the token table, about; their tokens are sorted in one task.
BUCKET_BYTES = 1 << 20
#: Characters of text in a block of documents, about; a block and the facts of its words are in one task's memory.
BLOCK_BYTES = 1 << 23
#: Bytes of words in a part, about, each counted once a block; a part is in one task's memory.
PART_BYTES = 1 << 22
#: Pairs of ids whose counts are broadcast: the most frequent, whatever the input.
BROADCAST_PAIRS = 1 << 17


#: A single space between two other characters. Python's white space includes all of the tokenizers'.
CUT = re.compile(r"(?<=\S) (?=\S)")
FACTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def cuts_at_spaces(byte_level: str, pieces: str) -> bool:
    """Whether both sides encode what lies between two places of ``CUT`` on its own, whatever
    stands around it: A splits there before it merges, and B has no piece that reaches across."""
    from sentencepiece import sentencepiece_model_pb2

    with open(byte_level, encoding="utf-8") as f:
        a = json.load(f)
    before = a.get("pre_tokenizer") or {}
    if not (
        a.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        and all(t["special"] for t in a.get("added_tokens", [])) and a["model"]["type"] == "BPE" and not a["model"].get("dropout")
    ):
        return False
    b = sentencepiece_model_pb2.ModelProto()
    with open(pieces, "rb") as f:
        b.ParseFromString(f.read())
    norm, train = b.normalizer_spec, b.trainer_spec
    return (
        train.model_type == train.BPE and train.byte_fallback and not train.treat_whitespace_as_suffix and not norm.precompiled_charsmap
        and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        and not any(x.type == x.USER_DEFINED or "▁" in x.piece.lstrip("▁") for x in b.pieces)
    )


def _splitter(byte_level: str, pieces: str) -> Callable[[str], list[str]]:
    """Words of a text, each without the space before it; the whole text as one where a side can't be cut."""
    return CUT.split if cuts_at_spaces(byte_level, pieces) else lambda text: [text]


class _Numbers(dict):
    """Numbers of words, in the order of their first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _planes(x: np.ndarray) -> bytes:
    """The first byte of each number, then the second of each and so on: high bytes are mostly zeros and compress well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _numbered(byte_level: str, pieces: str, limit: int):
    """Rows of documents as numbers of their words (``at``), and after those of a block a row
    for each of its words: number, word and count. A block ends with ``limit`` characters."""
    names = ["block", "doc_id", "at", "number", "word", "n"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.int64()]

    def rows(block: int, **columns: object) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        columns["block"] = np.full(size, block)
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in zip(names, kinds, strict=True)], names)

    def words(block: int, index: _Numbers, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        each = list(index)
        for i in range(0, len(each), 100_000):
            part = each[i : i + 100_000]
            yield rows(block, number=np.arange(i, i + len(part), dtype=np.int32), word=part, n=counts[i : i + len(part)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, block, seen = _splitter(byte_level, pieces), TaskContext.get().partitionId() << 32, 0
        index, counts = _Numbers(), np.zeros(0, np.int64)
        # few documents at a time: workers keep the memory that a large batch took
        for batch in (b.slice(i, 250) for b in batches for i in range(0, b.num_rows, 250)):
            ids, texts, start = batch.column(0), batch.column(1).to_pylist(), 0
            while start < len(texts):
                at, end = [], start
                while end < len(texts) and seen < limit:
                    text = texts[end] or ""
                    at.append(np.fromiter(map(index.__getitem__, split(text)), np.int32) if text else np.zeros(0, np.int32))
                    seen += len(text)
                    end += 1
                if len(counts) < len(index):
                    counts = np.pad(counts, (0, 2 * len(index) - len(counts)))
                numbers, n = np.unique(np.concatenate(at), return_counts=True)
                counts[numbers] += n
                yield rows(block, doc_id=ids.slice(start, end - start), at=list(map(_planes, at)))
                start = end
                if seen >= limit:
                    yield from words(block, index, counts)
                    index, counts, seen, block = _Numbers(), np.zeros(0, np.int64), 0, block + 1
        yield from words(block, index, counts)

    return run


def _gathered(key: tuple, words: pa.Table) -> pa.Table:
    """A row for each different word of a part: its id, count, and the blocks where it stands with its number there."""
    part = key[0].as_py()
    x = words.select(["word", "n", "block", "number"]).group_by("word", use_threads=False).aggregate([("n", "sum"), ("block", "list"), ("number", "list")])
    ids = pa.array(np.arange(x.num_rows) + (part << 32), pa.int64())
    return pa.table(
        [pa.array(np.full(x.num_rows, part), pa.int32()), ids, x["word"], x["n_sum"], x["block_list"], x["number_list"]],
        ["part", "word_id", "word", "n", "blocks", "numbers"],
    )


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """All elements of a column of lists."""
    return pc.list_flatten(column).to_numpy()


def _positions(wanted: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each wanted key stands among different ``keys``; -1 if nowhere."""
    if not len(keys):
        return np.full(len(wanted), -1)
    order = np.argsort(keys)
    at = np.minimum(np.searchsorted(keys, wanted, sorter=order), len(keys) - 1)
    return np.where(keys[order[at]] == wanted, order[at], -1)


def _pairs_of(table: pa.Table, flat: Callable[[pa.ChunkedArray], np.ndarray]) -> np.ndarray:
    return flat(table["a"]).astype(np.int64) << 32 | flat(table["b"]).astype(np.int64)


def _counted(key: tuple, aligned: pa.Table, times: pa.Table) -> pa.Table:
    """The different id pairs of the links of a part's words, each with its links in the corpus."""
    n = np.append(times["n"].to_numpy(), 0)[_positions(aligned["word_id"].to_numpy(), times["word_id"].to_numpy())]
    pairs, n = _pairs_of(aligned, _flat), np.repeat(n, aligned["n_links"].to_numpy())
    pairs, n = pairs[n > 0], n[n > 0]
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    pairs, n = pairs[first], np.add.reduceat(n, first) if len(first) else n
    part = pa.array(np.full(len(pairs), key[0].as_py()), pa.int32())
    return pa.table([part, pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(n, pa.int64())], ["part", "a", "b", "times"])


def _weighed(key: tuple, aligned: pa.Table, weights: pa.Table) -> pa.Table:
    """The words of a part without their links, with n_best and count_sum of these."""
    at = _positions(_pairs_of(aligned, _flat), _pairs_of(weights, lambda c: c.to_numpy()))
    first = np.append(0, np.cumsum(aligned["n_links"].to_numpy()))[:-1]
    sums = {of: np.add.reduceat(np.append(weights[c].to_numpy(), 0)[at], first) if len(at) else np.zeros(0, np.int64) for of, c in (("n_best", "best"), ("count_sum", "n"))}
    columns = {c: pa.array(sums[c], pa.int64()) if c in sums else aligned[c] for c in ["part", "word_id", *FACTS, "groups"]}
    return pa.table(list(columns.values()), list(columns))


def _dealt(key: tuple, facts: pa.Table, known: pa.Table) -> pa.Table:
    """The facts of a part's words for each block that holds some of them, as one compressed row."""
    at = np.repeat(_positions(known["word_id"].to_numpy(), facts["word_id"].to_numpy()), pc.list_value_length(known["blocks"]).to_numpy())
    blocks, numbers = _flat(known["blocks"]), _flat(known["numbers"])
    order = np.lexsort((numbers, blocks))
    order = order[at[order] >= 0]
    at, blocks, numbers = at[order], blocks[order], numbers[order]
    values, groups = [facts[c].to_numpy() for c in FACTS], facts["groups"].combine_chunks()
    codec, out = pa.Codec("zstd"), []
    for start, end in zip(first := np.flatnonzero(np.diff(blocks, prepend=-1)), [*first[1:], len(blocks)], strict=True):
        rows = at[start:end]
        spelled = "\n".join(groups.take(pa.array(rows)).to_pylist()).encode()
        raw = b"".join([_planes(np.diff(numbers[start:end], prepend=np.int32(0))), *(_planes(x[rows]) for x in values), spelled])
        out.append((int(blocks[start]), int(end - start), len(raw), codec.compress(raw, asbytes=True)))
    kinds = {"block": pa.int64(), "words": pa.int32(), "bytes": pa.int64(), "facts": pa.binary()}
    return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds.values())], list(kinds))


def _facts_of(dealt: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Numbers, facts and groups of words from the rows of :func:`_dealt`."""
    codec = pa.Codec("zstd")
    for row in dealt.to_batches(max_chunksize=1):
        n, size, data = (row.column(c)[0].as_py() for c in ("words", "bytes", "facts"))
        raw = codec.decompress(data, size, asbytes=True)
        numbers, rest = np.cumsum(_from_planes(raw[: 4 * n], np.int32)), raw[4 * n :]
        values = np.stack([_from_planes(rest[8 * n * i : 8 * n * (i + 1)], np.int64) for i in range(len(FACTS))], axis=1)
        yield numbers, values, rest[8 * n * len(FACTS) :].decode().split("\n")


def _others(docs: pa.Table, failed: pa.Table) -> pa.Table:
    """Words, by block and number, of the documents that hold a ``failed`` word, with their count."""
    bad, found = failed["number"].to_numpy(), []
    for at in docs["at"] if len(bad) else ():
        if np.isin(words := _from_planes(at.as_py(), np.int32), bad).any():
            found.append(words)
    numbers, n = np.unique(np.concatenate([np.zeros(0, np.int32), *found]), return_counts=True)
    block = np.full(len(numbers), docs["block"][0].as_py() if docs.num_rows else 0)
    return pa.table([pa.array(block, pa.int64()), pa.array(numbers, pa.int32()), pa.array(n, pa.int64())], ["block", "number", "gone"])


def _summed(docs: pa.Table, dealt: pa.Table) -> pa.Table:
    """The facts of the words of each document of a block, added up; zeros where a word has none."""
    decoded = lambda: (_from_planes(x.as_py(), np.int32) for x in docs["at"])
    count = max((int(x.max()) + 1 for x in decoded() if len(x)), default=0)
    values, groups, known = np.zeros((count, len(FACTS)), np.int64), np.full(count, "", object), np.zeros(count, bool)
    for numbers, facts, spelled in _facts_of(dealt):
        values[numbers], groups[numbers], known[numbers] = facts, spelled, True
    out, digests = np.zeros((docs.num_rows, len(FACTS)), np.int64), []
    for k, words in enumerate(decoded()):
        if not len(words) or not known[words].all():
            digests.append("")
            continue
        out[k] = values[words].sum(axis=0)
        digests.append(hashlib.sha256(";".join(groups[words].tolist()).encode()).hexdigest())
    return pa.table([docs["doc_id"], *[pa.array(out[:, i]) for i in range(len(FACTS))], pa.array(digests, pa.string())], ["doc_id", *FACTS, "groups_sha256"])


class _Sides:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        spelled = _byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(spelled[c] for c in token) if all(c in spelled for c in token) else token.encode()
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both sides; none where their bytes aren't those of a space and the text."""
        left = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        for text, x, b in zip(texts, left, self.b.encode(texts, num_threads=1), strict=True):
            a, whole = x.ids, b" " + text.encode()
            same = text and b"".join([self.a_bytes[i] for i in a]) == whole and b"".join([self.b_bytes[i] for i in b]) == whole
            yield (a, b) if same else ([], [])


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies spell printable bytes as themselves, the others, in order, from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _tokens(byte_level: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _Sides(byte_level, pieces)
        lengths = [np.array([len(t) for t in table], dtype=np.int32) for table in (sides.a_bytes, sides.b_bytes)]
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                piece = batch.slice(start, 1000)
                ids, sizes, n_a = [], [], []
                for a, b in sides.encode([t.as_py() or "" for t in piece.column(3)]):
                    ids.append(a + b)
                    sizes.append(np.concatenate([lengths[0][a], lengths[1][b]]) if a else np.empty(0, np.int32))
                    n_a.append(len(a))
                arrays = [pa.array(n_a, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], *arrays], ["part", "row", "doc_id", "n_a", "ids", "sizes"])

    return run


def tokenized(
    docs: DataFrame, byte_level: str, pieces: str, *, id_col: str = "doc_id", text_col: str = "text", part_col: str | None = None, buckets: int = 0
) -> DataFrame:
    """A table of the ids of both sides (A's, then B's) and their bytes, a row per document,
    bucketed by ``part``: what follows groups by (part, row) and needs no exchange. With ``part_col``
    ``docs`` have their parts, and different ids, already."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([part_col] if part_col else []))
    if part_col:
        keyed = slim.select(F.col(part_col).cast("int").alias("part"), F.col("doc_id").alias("row"), "doc_id", "text")
    else:
        total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        tasks = max(1, slim.rdd.getNumPartitions())
        each = max(1, -(-int(total) // (tasks * BUCKET_BYTES)))
        buckets, row = min(tasks * each, 50_000), F.monotonically_increasing_id()
        keyed = slim.select((F.spark_partition_id() * each + F.pmod(row, F.lit(each))).cast("int").alias("part"), row.alias("row"), "doc_id", "text")
    rows = keyed.mapInArrow(_tokens(byte_level, pieces), "part int, row long, doc_id long, n_a int, ids array<int>, sizes array<int>")
    return _bucketed(rows, "tokens", "part", buckets)


def _bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a table that is grouped by ``key`` without an exchange."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"{name}_{path.rsplit('-', 1)[1]}"
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    out.table_name, out.scratch = table, path
    return out


def _drop(*tables: DataFrame) -> None:
    for table in tables:
        table.sparkSession.sql(f"DROP TABLE {table.table_name}")
    drop_scratch(*tables)


def _aligned(tokens: DataFrame) -> DataFrame:
    """Per row of ``tokens``: n_a, n_b, n_groups, its groups, and its links (a, b)."""
    x = tokens.select("part", "row", "doc_id", "n_a", F.posexplode(F.arrays_zip("ids", "sizes")).alias("pos", "t")).select(
        "part", "row", "doc_id", "n_a", "pos", F.col("t.ids").alias("id"), F.col("t.sizes").alias("size"), (F.col("pos") >= F.col("n_a")).cast("int").alias("side")
    )
    along = Window.partitionBy("part", "row", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("part", "row", "doc_id", "side", "id", (F.sum("size").over(along) - F.col("size")).alias("start"))
    # tokens of both sides in the order of their bytes: the join on (document, offset) is equality of neighbours
    both = Window.partitionBy("part", "row").orderBy("start", "side")
    running = both.rowsBetween(Window.unboundedPreceding, 0)
    met = x.select(
        "part", "row", "doc_id", "side", "start",
        F.last(F.when(F.col("side") == 0, F.col("id")), ignorenulls=True).over(running).alias("a"),
        F.last(F.when(F.col("side") == 1, F.col("id")), ignorenulls=True).over(running).alias("b"),
        ((F.col("side") == 1) & (F.lag("start").over(both) == F.col("start"))).alias("cut"),
        F.lead("start").over(both).alias("next"),
    )
    # a link for each stretch between neighbouring offsets: there one token of each side lies
    links = met.withColumn("group", F.sum(F.col("cut").cast("int")).over(running)).where("next IS NULL OR next <> start")
    held = F.struct("start", "group", "a", "b", (F.when(F.col("cut"), 3).otherwise(F.col("side") + 1)).cast("byte").alias("new"))
    docs = links.groupBy("part", "row").agg(F.first("doc_id").alias("doc_id"), F.max("group").cast("long").alias("n_groups"), F.sort_array(F.collect_list(held)).alias("s"))

    def listed(side: str, bit: int) -> Column:
        """The ids of a side, group by group."""
        starts = F.filter("s", lambda x: x["new"].bitwiseAND(F.lit(bit).cast("byte")) > 0)
        text = F.array_join(F.transform(starts, lambda x: F.concat(F.when(x["new"] == 3, ";").otherwise(","), x[side].cast("string"))), "")
        return F.split(F.substring(text, 2, 1 << 30), ";", -1)

    spelled = F.array_join(F.zip_with(listed("a", 1), listed("b", 2), lambda a, b: F.concat(a, F.lit("|"), b)), ";")
    count = lambda bit: F.size(F.filter("s", lambda x: x["new"].bitwiseAND(F.lit(bit).cast("byte")) > 0)).cast("long")
    return docs.select("part", "row", "doc_id", count(1).alias("n_a"), count(2).alias("n_b"), "n_groups", F.size("s").cast("long").alias("n_links"), spelled.alias("groups"), F.col("s.a").alias("a"), F.col("s.b").alias("b"))


def _weights(pairs: DataFrame) -> DataFrame:
    """(part, a, b) of ``pairs`` with n, its links in the corpus, and whether no pair of b has more. ``pairs``
    (part, a, b, times) has a pair once a part, so none is a hot key."""
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("times").alias("n")), "counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    counts = materialize(counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "counts")
    # the most frequent pairs are a list of bounded length; they stand in most parts
    power = F.floor(F.log2("n")).cast("int")
    left, least = BROADCAST_PAIRS, 64
    for p, n in sorted(((r["p"], r["n"]) for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True):
        left -= n
        if left < 0:
            break
        least = p
    columns = ["part", "a", "b", "n", "best"]
    looked = pairs.drop("times").join(F.broadcast(counts.where(power >= least)), ["a", "b"], "left")
    rare = looked.where("n IS NULL").select("part", "a", "b").join(counts.where(power < least), ["a", "b"])
    return looked.where("n IS NOT NULL").select(columns).unionByName(rare.select(columns))


def align_tokens(docs: DataFrame, byte_level: str, pieces: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align the tokens of a byte-level BPE file (A) with those of a sentencepiece model (B).

    A encodes a space and the text, B the text (it adds the space). Both encode special
    tokens' strings as plain text. The byte offsets where tokens of both sides meet cut a
    text into groups; tokens of A and B whose byte ranges overlap are linked.

    Both sides start a token at each single space between other characters
    (:func:`cuts_at_spaces` checks it of the files; otherwise a text is one word), so such a place is a
    cut, and the groups and links of a text are those of its words. Documents become numbers of the words of
    their block, whose different words are dealt over parts. There each is encoded and aligned
    once; its links count as often as it stands in texts with tokens. The facts of a part's words go to each block as
    one compressed row, where those of a document are added up.

    Method: relational. Tokens are exploded with their places; running sums of their bytes
    give their offsets; both sides of a document are sorted by offset, where a token of A and one
    of B with equal offsets are neighbours (the equi-join, as a merge). The running count of these cuts
    numbers the groups. Between two neighbouring offsets lies one token of each side, and each
    overlap of two tokens is one such stretch, so the last token of each side gives the link, without a join
    of all tokens of a group. Different id pairs of a part are counted there, then in the corpus; the counts go back by a broadcast
    of the ``BROADCAST_PAIRS`` most frequent pairs and by a join of the others. Tables of words are
    bucketed by part and the documents by block, so only pairs, words once a block and their facts are shuffled.

    Returns per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose
    pair has the highest count of its B id in the corpus, ties included), count_sum (over links, their
    pair's count), groups_sha256 (of ``a1,a2|b1;a3|b2``). Texts that are null or empty, or that the tokens of
    a side don't spell, have zeros and ''. Repeated rows count each; an
    empty table gives an empty result; other columns are ignored. A block of texts
    with the facts of its words is the unit of a task.
    """
    spark = docs.sparkSession
    texts = _blocks(docs, byte_level, pieces, id_col, text_col)
    numbers = texts.where("word IS NULL").select("block", "doc_id", "at")
    words = texts.where("word IS NOT NULL").select("word", "n", "block", "number")
    total = words.agg(F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()[0]
    # more parts than partitions: tasks get more even shares
    parts = max(2 * partitions(spark), -(-int(total) // PART_BYTES))
    buckets = max(partitions(spark), min(parts // 2, 50_000))
    keyed = words.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int"))
    gathered = keyed.groupBy("part").applyInArrow(_gathered, "part int, word_id long, word string, n long, blocks array<long>, numbers array<int>")
    known = _bucketed(gathered, "known", "part", buckets)
    tokens = tokenized(known.select("part", "word_id", "word"), byte_level, pieces, id_col="word_id", text_col="word", part_col="part", buckets=buckets)
    aligned = _bucketed(_aligned(tokens.where("n_a > 0")).drop("row").withColumnRenamed("doc_id", "word_id"), "aligned", "part", buckets)
    failed = materialize(tokens.where("n_a = 0").select(F.col("doc_id").alias("word_id")), "failed")
    _drop(tokens)
    times = known.select("part", "word_id", "n")
    if not failed.isEmpty():
        # a text that one of its words fails has no tokens: the others don't count there
        places = known.select("word_id", F.inline(F.arrays_zip(F.col("blocks").alias("block"), F.col("numbers").alias("number"))))
        where = places.join(failed, "word_id", "left_semi").select("block", "number")
        others = numbers.groupBy("block").cogroup(where.groupBy("block")).applyInArrow(_others, "block long, number int, gone long")
        others = materialize(others.join(places, ["block", "number"]).groupBy("word_id").agg(F.sum("gone").alias("gone")), "others")
        times = times.join(others, "word_id", "left").select("part", "word_id", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n"))
    links = aligned.select("part", "word_id", "n_links", "a", "b")
    pairs = materialize(links.groupBy("part").cogroup(times.groupBy("part")).applyInArrow(_counted, "part int, a int, b int, times long"), "pairs")
    drop_scratch(failed)
    columns = ", ".join(f"{c} long" for c in FACTS)
    facts = aligned.groupBy("part").cogroup(_weights(pairs).groupBy("part")).applyInArrow(_weighed, f"part int, word_id long, {columns}, groups string")
    facts = _bucketed(facts, "facts", "part", buckets)
    _drop(aligned)
    drop_scratch(pairs)
    places = known.select("part", "word_id", "blocks", "numbers")
    dealt = facts.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(_dealt, "block long, words int, bytes long, facts binary")
    out = numbers.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(_summed, f"doc_id long, {columns}, groups_sha256 string")
    out = materialize(out, "documents")
    _drop(texts, known, facts)
    return out.select("doc_id", *FACTS, "groups_sha256")


def _blocks(docs: DataFrame, byte_level: str, pieces: str, id_col: str, text_col: str) -> DataFrame:
    """(block, doc_id, at) and (block, number, word, n): a table bucketed by blocks of about ``BLOCK_BYTES`` of text."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, slim.rdd.getNumPartitions(), -(-int(total) // BLOCK_BYTES))
    # as many buckets as partitions at least: else both sides of a cogroup are shuffled
    buckets = max(partitions(spark), min(blocks, 50_000))
    rows = slim.mapInArrow(_numbered(byte_level, pieces, BLOCK_BYTES), "block long, doc_id long, at binary, number int, word string, n long")
    return _bucketed(rows, "texts", "block", buckets)
