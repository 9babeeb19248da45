"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes all that its predecessor kept, and its decisions take effect: rejected documents
go, copies go, contaminated documents go, personal data is replaced, and what is left is packed.
The table between two stages is written as Parquet to the shared folder, so that an executor that
is lost costs no more than its own tasks.

SQL cannot express a trained classifier, learned patterns or the dynamic programme, so ORACLE_SQL is
None; ``tests/llm/test_pipeline.py`` holds the result against plain Python. Nulls, empty texts,
repeated rows, empty tables and extra columns: as the operators say; all but the last stage return
the columns of documents, and ``n_chars`` follows the text that is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvault.llm import decontaminate, jaccard_join, packing, pii, quality
from fleetvault.llm.queries import table, vocabulary
from fleetvault.storage import run_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 80 % of their five-word shingles, that with the smallest id."""
    return jaccard_join.keep_first(docs, width=5, percent=80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with labels in place of personal data."""
    cleaned = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*[size.alias(c) if c == "n_chars" else c for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary(), length=2048)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_copies),
    ("benchmark decontamination", uncontaminated),
    ("PII", without_personal_data),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = run_dir(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
