"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redress.llm import gam, line_spread, packing, secrets, simhash
from redress.llm.common import stored
from redress.llm.queries import tokenizer_path

#: No SQL expresses the classifier, the fingerprints or the packing;
#: ``tests/llm/test_pipeline.py`` checks the stages against plain versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the quality classifier predicts good.  Labels are
    learned from the rows of ``docs`` that are not held out.  Without
    labelled rows nothing is rejected.  Null and empty texts are scored like
    a text without words; repeated rows are judged alike."""
    return gam.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the repeats of lines that stand on five sites
    or more.  ``n_chars`` follows the text; null texts stay null."""
    return line_spread.drop_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that SimHash links (3-word shingles, 3 bits):
    one with the smallest id, or with a null id if no row of the group has
    another.  Rows that repeat an id are judged by their own texts."""
    return simhash.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by ``[secret]``."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every document (or piece of a long one) goes: doc_id, piece,
    n_tokens, bin_id, capacity, start; sizes in subword ids of the public
    32k vocabulary."""
    return packing.pack_rows(packing.count_tokens(docs, tokenizer_path()), F.col("n_tokens"))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table, each stored in the shared
    folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
