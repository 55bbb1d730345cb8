"""From documents to token ids: quality, exact copies, near copies, benchmark passages, tokens.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and gives the documents that
stay, with all columns of ``documents``; the last gives one row of token figures per document. Each
stage sees all that the one before kept. ``run`` writes every result to the shared folder and reads
it back, so that a lost executor costs a stage at most.

Each stage keeps its operator's rules for nulls, empty and very long texts, repeated rows and empty
tables. Beyond these: a document without a score that accepts it goes, null and empty texts being
scored like others; of rows that repeat id and text one stays; a row with a null id goes only as a
rejected text or an exact copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislemetrics.llm import decontaminate, exact_dedup, near_dedup, quality
from aislemetrics.llm.common import crc_mod, table, written
from aislemetrics.llm.queries import ACCEPT, bpe_digest


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a good label is at least ``ACCEPT``."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("id"), 4) != 2)
    return docs.filter(quality.quality_score(spark, model)("text") >= ACCEPT)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest id."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles, the one with the smallest id."""
    return near_dedup.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_digest(docs)


STAGES = [
    ("quality", quality_classifier),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("bpe", tokens),
]
#: A fitted network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
