"""Encodings of game texts: detected from the bytes, decoded strictly."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte order marks, and what is tried without one, in order.
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
TRIED = ("utf-8", "cp932", "gb18030")
CONTROLS = {i: None for i in range(32) if chr(i) not in "\n\r\t\f"}


def _strict(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding, errors="strict")
    except UnicodeDecodeError:
        return None


def plausible(text: str) -> bool:
    return not text or (len(text) - len(text.translate(CONTROLS))) / len(text) < 0.01


def decoded(data: bytes) -> tuple[str, str, bool] | None:
    """(text, encoding, has a mark), or None for what is no text. A mark decides alone;
    else many zero bytes at odd or even places mean UTF-16, and then :data:`TRIED`."""
    if not data:
        return "", "utf-8", False
    for mark, encoding in MARKS:
        if data.startswith(mark):
            text = _strict(data, encoding)
            return None if text is None else (text.removeprefix("﻿"), encoding, True)
    tried = list(TRIED)
    if len(data) >= 4:
        half = len(data) // 2
        shares = {"utf-16-le": data[1::2].count(0) / half, "utf-16-be": data[::2].count(0) / half}
        tried = [e for e, share in shares.items() if share > 0.3] + tried
    for encoding in tried:
        text = _strict(data, encoding)
        if text is not None and plausible(text):
            return text, encoding, False
    return None


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [decoded(bytes(x)) for x in batch["content"]]
        yield pd.DataFrame(
            {
                "path": batch["path"],
                "text": [x and x[0] for x in found],
                "encoding": [x and x[1] for x in found],
                "has_bom": pd.array([x[2] if x else None for x in found], dtype="boolean"),
                "size_bytes": batch["size_bytes"],
                "sha256": batch["sha256"],
            }
        )


def decoded_files(files: DataFrame) -> DataFrame:
    """``files`` (path, content) as (path, text, encoding, has_bom, size_bytes, sha256);
    text and encoding are null where the bytes are no text. Spark's own decoder knows
    neither the Japanese nor the Chinese encodings of games."""
    rows = files.select("path", "content", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    return rows.mapInPandas(_decode, "path string, text string, encoding string, has_bom boolean, size_bytes long, sha256 string")
