"""Translation services: batches out, closed JSON replies back.

A backend is any callable from request payloads to replies; it runs inside tasks, one
call for each batch. The default one is deterministic and needs no network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records

Backend = Callable[[str], tuple[int, str]]
#: HTTP statuses that say for certain that nothing was done.
DEFINITE = (400, 401, 403, 404, 405, 413, 415, 422)
REPLY = "struct<id:string,choices:array<struct<message:struct<content:string>>>>"
CONTENT = "array<struct<segment_id:string,target_text:string>>"


def submitted(batches: DataFrame, backend: Backend, may_send: Callable[[str], bool] | None = None) -> DataFrame:
    """``batches`` (batch_id, payload) with http_status and body of each reply, both null
    for a batch that ``may_send`` withholds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = [backend(p) if may_send is None or may_send(b) else (None, None) for b, p in zip(frame["batch_id"], frame["payload"])]
            status = pd.array([r[0] for r in replies], dtype="Int32")
            yield frame.assign(http_status=status, body=[r[1] for r in replies])

    return batches.select("batch_id", "payload").mapInPandas(run, "batch_id string, payload string, http_status int, body string")


def reply_items(body: Column) -> Column:
    """(segment_id, target_text) items of a reply, null unless it has exactly one choice
    whose content is an object of exactly ``translations``."""
    reply = F.from_json(body, REPLY)
    content = F.when(F.size(reply["choices"]) == 1, F.get(reply["choices"], F.lit(0))["message"]["content"])
    items = F.get_json_object(content, "$.translations")
    good = records.closed(content, ["translations"]) & items.startswith("[")
    return F.when(good, F.from_json(items, CONTENT))


def outcome(http_status: Column, items: Column, wanted: Column) -> Column:
    """succeeded when the items stand for the wanted segments in order; failed for a
    definite refusal; anything else is unknown and never sent again by itself."""
    ids = F.transform(items, lambda i: i["segment_id"])
    whole = (ids == wanted) & F.forall(items, lambda i: F.coalesce(F.length(i["target_text"]) > 0, F.lit(False)))
    return F.when(http_status.isin(*DEFINITE), "failed").when((http_status == 200) & F.coalesce(whole, F.lit(False)), "succeeded").otherwise("unknown")
