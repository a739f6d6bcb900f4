"""Progress of a stream as event lines."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql.streaming.listener import StreamingQueryListener

from ..domains import STAGE_PERCENT
from ..sources.events import VERSION


class ProgressLines(StreamingQueryListener):
    """Gives ``write`` a line for each micro-batch of the streams named ``query`` and one terminal line
    when it ends: lines that :func:`glossaspark.sources.events.parsed` takes.

    ``total`` is the number of batches that are expected; without it, or once more have come, a line has no
    counts. A message has no text of an exception, which may hold data. Add it with ``spark.streams.addListener`` before the
    stream starts; it is called on the driver, in order.
    """

    def __init__(self, query: str, write: Callable[[str], None], stage: str = "translating", total: int | None = None):
        if stage not in STAGE_PERCENT:
            raise ValueError(f"unknown stage: {stage}")
        self.query, self.write, self.stage, self.total = query, write, stage, total
        self.run: str | None = None
        self.done = 0

    def line(self, **event) -> None:
        self.write(json.dumps({"schema_version": VERSION, **event}, ensure_ascii=False))

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.query:
            self.run, self.done = str(event.runId), 0

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if str(event.progress.runId) != self.run:
            return
        self.done += 1
        counts = {"completed_batches": self.done, "total_batches": self.total} if self.total and self.done <= self.total else {}
        self.line(type="progress", stage=self.stage, message=f"{event.progress.numInputRows} rows", **counts)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.runId) == self.run:
            self.run = None
            self.line(**({"type": "failed", "message": "the stream has stopped with an error"} if event.exception else {"type": "succeeded"}))
