"""From raw documents to packed sequences: quality, near-duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.llm import classifier, mixing, packing, secrets, simhash
from relspark.llm.common import dropped, fresh, row_order, small_batches, staged
from relspark.llm.queries import tokenizer_path
from relspark.staging import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is trained on the labelled ones among `docs`. Null texts are judged as empty ones."""
    small_batches(spark)
    return classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays, the one of least id; documents linked to none all stay."""
    small_batches(spark)
    return simhash.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, whose documents stay; n_chars follows."""
    if "n_chars" not in docs.columns:
        return secrets.redacted(docs)
    before = fresh(docs, "before")
    out = secrets.redacted(docs.withColumn(before, F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("text").eqNullSafe(F.col(before)), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which the sources' blocks are scheduled to their target weights."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with the sequence and the offset that each is packed at; sequences follow the mixture's order."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path(), place=row_order(docs))


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("secret scans", secret_scans), ("mixing", mixture), ("packing", packed)]
#: The classifier, the tokenizer and the scheduler are beyond SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's rows staged in the shared folder before the next one reads them.

    What a stage staged for itself goes when it has ended, and its rows when the next stage's are written. Null, empty and very long texts,
    ties, repeated rows and empty tables are as each stage's operator defines them; a documents table without rows gives none.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
            made[:] = [t for t in made if t is not docs]
        if last is not None:
            dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
