"""Unicode functions that Spark lacks, Arrow-batched."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges of characters that NFC leaves as they are and that compose with none before
#: them: Latin, Greek, Cyrillic, dashes and quotation marks, CJK, kana and Hangul.
STABLE = r"\x{0}-\x{2ff}\x{388}-\x{482}\x{48a}-\x{590}\x{2010}-\x{2027}\x{3001}-\x{3029}\x{3041}-\x{3098}\x{309b}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7a3}\x{ff01}-\x{ffdc}"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.arrow_udf(T.BooleanType())
def _equal_in_nfc(a: pa.Array, b: pa.Array) -> pa.Array:
    # one pair at a time: a batch of whole texts isn't held a second time as Python strings
    pairs = ((x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True))
    return pa.array([None if x is None or y is None else unicodedata.normalize("NFC", x) == unicodedata.normalize("NFC", y) for x, y in pairs], pa.bool_())


def same_nfc(a: Column, b: Column) -> Column:
    """Whether two texts are equal after NFC, null if one is null. Python gets only
    pairs that differ and of which one holds a character outside :data:`STABLE`; Spark
    calls it for each row, so for the others its arguments are null."""
    stable = rf"^[{STABLE}]*\z"
    open_ = (a != b) & ~(a.rlike(stable) & b.rlike(stable))
    found = _equal_in_nfc(F.when(open_, a), F.when(open_, b))
    return F.when(open_, found).otherwise(a == b)


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


@F.pandas_udf(T.StringType())
def path_key(text: pd.Series) -> pd.Series:
    """Paths that one case-insensitive folder cannot hold together have equal keys."""
    return text.map(lambda t: unicodedata.normalize("NFC", t).casefold(), na_action="ignore")
