"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; its result is written as Parquet to the shared folder and read back as the next
stage's documents. All but the last return the columns of ``documents``, whatever further columns
are called. Texts meet a stage's decisions on their place in the file that is read, in one
exchange at most.

Rows, in every stage: null and empty texts are documents (no words, no secrets, one end token); a null doc_id
is kept; an empty table gives an empty table. Repeated rows and other copies are one group, of which
``near_dedup`` keeps the row with the smallest doc_id, the first such row if there are several.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnlens.llm import common, mixing, packing, quality_fm, secret_scan, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go (operator 8); a score of exactly the threshold stays."""
    return quality_fm.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (operator 7)."""
    return simhash.first_of_each_group(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays (operator 5)."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (operator 4); documents without words are never taken."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences (operator 3)."""
    return packing.digest(packing.pack_documents(docs))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mix", mix), ("pack", pack)]

#: None: the trained classifier, fingerprints and tokenizer have no SQL; tests/llm/test_pipeline.py checks the stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's intermediate tables, and the documents it read, are removed
    when its own rows are written, so the shared folder never holds more than two stages' documents."""
    docs, read = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = common.shared_folder(spark, f"pipeline-{name}")
        with common.removed_after(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if read:
            common.remove(spark, read)
        docs, read = spark.read.schema(out.schema).parquet(path), path
    return docs
