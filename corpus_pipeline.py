"""The corpus pipeline: quality rules, near-duplicate removal, masking of personal data, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared folder and reads again for the next. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, pii, quality_rules, simhash
from tidemark.llm.common import stored, table
from tidemark.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base limits or a learned rule reject."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs.select(row, "doc_id", "text"), rules).filter("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group.

    Links are those of the operator's query (four bits of fingerprints of four
    words), and any distance if the texts' five-word shingles are similar to 0.8
    or more.
    """
    groups = simhash.near_duplicates(docs.select("doc_id", "text"), wide=64)
    # as a table of its own, it is broadcast where the planner's size check allows, so that texts need not move
    gone = stored(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in the text replaced by its kind."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that the ids decode to, one row for each row of docs."""
    out = bpe.encoded(docs, vocabulary())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mask_personal_data", mask_personal_data),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

#: Trie joins, learned rules and merges are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
