"""Training corpus from ``documents``: quality rules, near-duplicate removal, surrogates
for personal data, a mix of the sources, and packed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaspark.llm.common import drop_scratch, materialize
from glossaspark.llm.near_dedup import distinct_documents
from glossaspark.llm.packing import packed_batches
from glossaspark.llm.quality_rules import clean_documents
from glossaspark.llm.source_mix import mixed_documents
from glossaspark.llm.surrogates import with_surrogates

SURROGATE_KEY = b"glossaspark surrogates"

#: Documents of a source that may hold the same line, however large the source is.
LINE_DOCS = 30


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and lines that too many documents of a source hold; copies of
    a text, which the next stage removes, count once."""
    return _recounted(clean_documents(docs, max_host_docs=LINE_DOCS, texts_once=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8."""
    return distinct_documents(docs, shingle=5, percent=80)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets keyed replacements."""
    return _recounted(with_surrogates(docs, key=SURROGATE_KEY, count_col=None))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their source take them."""
    return mixed_documents(docs, weights=(1, 2, 3), limit=3)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of segments of similar length."""
    return packed_batches(docs, max_tokens=4096, budget=32768, buckets=16)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("surrogates", surrogates),
    ("mix", mix),
    ("packing", packing),
]

#: Near duplicates, seeded choices and the packing program are no SQL; tests/llm holds
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        after = materialize(stage(spark, docs, sf_dir), name)
        drop_scratch(docs)  # the table of the stage before
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
