"""Event lines of running processes as a stream, read by byte offsets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import events
from ..sources.snapshots import file_system

LINES = "run string, at long, line string, too_long boolean"
JUDGED = "run string, at long, {fields}, error string"
FIELDS = "schema_version int, type string, stage string, message string, completed_batches long, total_batches long"
BLOCK = 1 << 20


@dataclass
class Range(InputPartition):
    """Line ends of a file at the bytes from ``start`` to before ``end``."""

    path: str
    start: int
    end: int


def lines_ending(store: arrow_fs.FileSystem, path: str, start: int, end: int, most: int = events.MOST_BYTES) -> Iterator[tuple[int, str | None, bool]]:
    """(offset after the line, line, too_long) of each line whose newline lies in a range.
    At most ``most`` + 1 bytes before the range are read again for the line that runs into it; of a longer line
    no more than that is held, and its text is null."""
    back = max(0, start - most - 2)
    with store.open_input_file(path) as file:
        file.seek(back)
        head = file.read(start - back)
        cut = head.rfind(b"\n") + 1
        held, long = head[cut:], cut == 0 and back > 0
        at = start
        while at < end:
            block = file.read(min(BLOCK, end - at))
            if not block:
                return
            *whole, rest = block.split(b"\n")
            for part in whole:
                line = held + part
                at += len(part) + 1
                over = long or len(line) + 1 > most
                yield at, None if over else line.rstrip(b"\r").decode("utf-8", "replace"), over
                held, long = b"", False
            at += len(rest)
            long = long or len(held) + len(rest) > most + 1
            held = b"" if long else held + rest


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.split = int(options.get("split_bytes", 64 << 20))
        self.most = int(options.get("bytes_per_trigger", 1 << 30))
        self.known: dict[str, int] | None = None

    def sizes(self) -> dict[str, int]:
        store, base = file_system(self.folder)
        found = store.get_file_info(arrow_fs.FileSelector(base))
        return {f.base_name: f.size for f in found if f.type == arrow_fs.FileType.File and f.extension == "jsonl"}

    def initialOffset(self) -> dict:  # noqa: N802
        self.known = {}
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        sizes, known, left = self.sizes(), self.known, self.most
        if known is not None:
            for name in sorted(sizes):
                grown = min(sizes[name] - known.get(name, 0), left)
                sizes[name], left = known.get(name, 0) + max(0, grown), left - max(0, grown)
            self.known = sizes = {name: size for name, size in sizes.items() if size}
        return sizes

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.known = dict(end)
        cuts = [(name, at, to) for name, to in sorted(end.items()) for at in range(start.get(name, 0), to, self.split)]
        return [Range(name, at, min(at + self.split, to)) for name, at, to in cuts]

    def read(self, partition: Range) -> Iterator[tuple]:
        store, base = file_system(self.folder)
        for at, line, too_long in lines_ending(store, f"{base}/{partition.path}", partition.start, partition.end):
            yield partition.path, at, line, too_long

    def commit(self, end: dict) -> None:
        self.known = dict(end)


class EventLines(DataSource):
    """Streaming format ``event_lines``: lines of the ``.jsonl`` files of a folder (``path``), each
    file the output of one run that is only appended to.

    Rows: (run, at, line, too_long), ``at`` being the offset after the line's newline, which is its identity and its
    order. An unfinished last line waits for its newline. A line of more than 256 KiB has a null text.
    Files are read by ranges of ``split_bytes``; a trigger takes at most ``bytes_per_trigger`` bytes,
    but for the first one after a restart, which takes what has come meanwhile. An offset of the stream is a
    number for each file, so files of ended runs should be moved away in time; they are then forgotten.
    """

    @classmethod
    def name(cls) -> str:
        return "event_lines"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(dict(self.options))


def _ended(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first good terminal event of a run is its end; all that lies behind it is an error."""
    end = state.get[0] if state.exists else None
    held = list(batches)
    for rows in held:
        found = rows.loc[rows["error"].isna() & rows["type"].isin(events.ENDS), "at"]
        if len(found):
            end = int(found.min()) if end is None else min(end, int(found.min()))
    if end is not None:
        state.update((end,))
    for rows in held:
        if end is not None:
            rows = rows.assign(error=rows["error"].where(rows["at"] <= end, "after_end"))
        yield rows


def judged(lines: DataFrame) -> DataFrame:
    """Events (run, at, fields, error) of streamed or stored lines: the errors of
    :func:`glossaspark.sources.events.parsed`, with one terminal event a run kept in state.

    The state is the offset of each run's end. The events of a run in one micro-batch are held in
    memory, which ``bytes_per_trigger`` bounds. A line that is no event ends nothing.
    """
    checked = lines.withColumn("e", F.from_json("line", events.SCHEMA)).select(
        "run", "at", "e.*", F.when(F.col("too_long"), "line_too_long").otherwise(events.line_error(F.col("line"), F.col("e"))).alias("error")
    )
    return checked.groupBy("run").applyInPandasWithState(_ended, JUDGED.format(fields=FIELDS), "end long", "append", GroupStateTimeout.NoTimeout)


def stream(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    """The judged events of a folder of runs."""
    spark.dataSource.register(EventLines)
    reader = spark.readStream.format("event_lines").option("path", folder)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return judged(reader.load())
