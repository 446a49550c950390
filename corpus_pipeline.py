"""From raw documents to token files: quality rules, near-dedup, decontamination, mixing, token output.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the
next stage's documents.  All but the last return the columns of ``documents``.  Empty tables give no rows, NULL ids
are kept, other columns pass through, and each stage states what it does with empty texts and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.llm import decontaminate, mixing, neardup, quality, tokens
from trustframe.llm.common import stored, table

# Fewer than the operator's default: the stages' Python workers share the executors' memory.
REMEMBERED_WORDS = 250_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: NULL, empty and very short texts among them; repeated rows share a verdict."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id; repeats of a row count as one.

    Texts without words are linked with nothing and stay.
    """
    return neardup.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; NULL and empty texts and repeated rows stay."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in target weights: a row per document and epoch, with the words that the mix takes.

    Texts without words are not taken; NULL is a source of its own; repeated rows are documents of their own.
    """
    out = mixing.mix_documents(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Coded token files of the mix, read back: doc_id, start, n_tokens, ids_crc32, a row for each row written."""
    files = tokens.write_tokens(docs, tokens.default_tokenizer(), remembered=REMEMBERED_WORDS)
    return tokens.read_tokens(files, docs.schema["doc_id"].dataType.simpleString())


STAGES = [
    ("quality rules", good_quality),
    ("near dedup", one_of_each),
    ("decontamination", clean_of_benchmark),
    ("mixing", mixed),
    ("token output", token_files),
]

# Tokenization has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "pipeline-stage")
    return docs
