"""A corpus run: quality rules, line dedup, near duplicates, mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet and hands it to
the next. All but the last return the columns of documents, and n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.llm.common import work_dir
from lemmaflow.llm.linededup import dedup_lines
from lemmaflow.llm.mixing import mixed
from lemmaflow.llm.ngramjoin import representatives
from lemmaflow.llm.pieces import digested
from lemmaflow.llm.quality import quality_filter

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, unchanged. Null, empty and blank texts are rejected; repeated rows stay."""
    return quality_filter(docs.select(*COLUMNS))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one of the corpus; documents that lose all words go.

    Earlier means smaller doc_id, null last. Rows equal in doc_id and text are one document. Null texts stay as they are.
    """
    kept = dedup_lines(docs.select(*COLUMNS)).filter("n_dropped = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return kept.select("doc_id", "text", "lang", "source", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id. Texts without words are in no group."""
    return representatives(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the sources' target weights takes it. Null sources are one source; texts without words are not taken."""
    return mixed(docs.select(*COLUMNS))


def ids_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document of the mix, repeats included. Null texts count as empty."""
    return digested(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", lines_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing", mixing_stage),
    ("SentencePiece", ids_stage),
]

#: SentencePiece ids cannot be made in SQL; tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents. Null, empty and blank texts leave in the first stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = work_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
