"""The corpus pipeline: quality rules, near duplicates, benchmark passages, personal data, tokens.

Each stage takes the documents that its predecessor kept and returns a DataFrame; stages are
written as Parquet and read again. All but the last return the columns of ``documents``; the last adds
``n_tokens`` and ``ids``. For nulls, empty texts, ties and empty tables see the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspan.llm import bpe, decontamination, order_minhash, pii, quality_cascade
from civicspan.llm.common import let_workers_import, table, written
from civicspan.llm.queries import SURROGATE_KEY, vocabulary_path


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_cascade.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least id."""
    let_workers_import(spark)
    return order_minhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without benchmark passages, and without documents of which these are more than half."""
    let_workers_import(spark)
    cleaned = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _recounted(cleaned)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With surrogates for personal data and secrets."""
    return _recounted(pii.replace_entities(docs, SURROGATE_KEY).select(docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the ids of the text, as little-endian 32-bit bytes, and their number."""
    let_workers_import(spark)
    return bpe.encode_texts(docs, vocabulary_path()).withColumn("n_tokens", bpe.n_tokens("ids"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("personal data", without_pii),
    ("tokens", tokens),
]

#: SQL expresses neither sketches nor surrogates nor merges; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
