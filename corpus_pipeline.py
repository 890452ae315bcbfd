"""A training corpus from `documents`, in five stages: quality, near-duplicates, benchmark, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, neardup, packing, quality, secrets
from tidemark.llm._common import materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is of the top grade by the ordinal classifier, fitted on the labelled rows among them.

    Null text: as empty. Repeated rows stay or go alike; an empty table stays empty; other columns are carried as they are, whatever their names."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five-word shingles, 0.8): the one of the smallest doc_id.

    Repeated rows count as copies; null and blank texts are all copies of one another; ties of ids are broken by the text's hash."""
    return neardup.distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null texts hold none; repeated rows stay or go alike; an empty benchmark drops nothing."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with credentials masked that look live and that few owners have. Null texts and repeated rows stay, n_chars follows the text."""
    return secrets.masked(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its place in a sequence of at most 4096 tokens. Null text: one piece, of the end id; repeated rows have a place each."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: The classifier, the tokenizer and the latent space can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
