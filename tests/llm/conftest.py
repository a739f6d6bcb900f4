from __future__ import annotations

import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 4999}" for i in range(60_000))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in each column, empty and very long texts, repeated rows, ties, and columns
    whose names occur inside the operators."""
    base = " ".join(f"word{i}" for i in range(120))
    rows = [
        (1, base, "a"),
        (2, base, "a"),
        (2, base, "a"),
        (3, base + " tail", "b"),
        (4, None, "a"),
        (5, "", "b"),
        (6, "  \n\t ", None),
        (7, LONG, "c"),
        (None, base, "a"),
        (9, "one two", None),
        (10, LONG + " end", "c"),
        (11, "Call +1 (743) 555-3824 or mail anna.smith@mail.example.org\nKey token = \"f33e61083db5dbdf4bd2369d2f80176e57f7fda2\"", "a"),
        (12, "x " * 300, "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = ["row", "h", "size", "hash", "key", "bucket", "set_key", "n", "salt", "host", "n_entities", "digest", "component", "width", "lines"]
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
