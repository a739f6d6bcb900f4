"""Exactly-once appends of keyed rows from a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.versioned import LostRace, VersionedStore


def append_once(path: str, key: str, payload: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: adds keys that aren't stored to a :class:`VersionedStore`, skips
    equal ones and stops at another payload for a stored key. A batch is one version, taken
    whole or not at all, so one that is tried again finds its own keys and adds nothing. It reads the buckets
    of its keys only, and these are merged as they grow: the files that it reads don't grow with the number
    of batches."""

    def write(batch: DataFrame, number: int) -> None:
        held = VersionedStore(batch.sparkSession, path, key, payload, buckets)
        rows = batch.select(key, payload)
        if not held.versions():
            try:
                held.create(rows.where("false"))
            except LostRace:  # another writer has just begun the store
                pass
        refused = held.insert_once(rows).where("outcome = 'conflict'").first()
        if refused:
            raise ValueError(f"another payload is stored for {refused[key]}")

    return write
