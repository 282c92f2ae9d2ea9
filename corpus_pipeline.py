"""The corpus pipeline: from raw documents to token files, each stage written and read again.

Stages that read texts in Python get them a few at a time (``BATCH_ROWS``, a session setting that each
of them makes and ``run`` takes back), which bounds what an executor holds.

In every stage rows with null columns stay rows like others unless it says otherwise, other columns
may have any names and pass through, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, langid, mixing, neardup, token_ids
from lodestar.llm.shared import drop, read, scratch


BATCH_ROWS = 500
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is of a learned language.

    Null texts and texts without letters go, and texts of which too few n-grams are any learned
    language's (``langid.REJECT``, less the sampling error of short texts). Equal texts share their fate.
    """
    spark.conf.set(_ROWS, BATCH_ROWS)
    filters = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    held, at = spark.sparkContext.broadcast(filters), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(held.value.predict(batch.column(at).to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the least doc_id.

    Null texts are empty, and empty texts copies of each other. Rows without doc_id all stay, as do
    all rows of a doc_id that stays.
    """
    spark.conf.set(_ROWS, BATCH_ROWS)
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quote no benchmark item; null texts quote nothing, equal texts share their fate."""
    spark.conf.set(_ROWS, BATCH_ROWS)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it; a null source is a source, rows of one doc_id are drawn apart if their texts differ."""
    own = f"mix_{uuid.uuid4().hex}"  # a column name that no table has
    mixed = mixing.mix_documents(docs, own)
    return mixed.withColumn(f"{own}_copy", F.explode(F.array_repeat(F.lit(1), F.col(f"{own}.copies").cast("int")))).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places and digests in the token files, in ascending order of doc_id, null first; null texts are empty, copies stand together."""
    spark.conf.set(_ROWS, BATCH_ROWS)
    return token_ids.read_documents(token_ids.write_files(docs))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_files", token_files),
]
#: Fingerprints, alignments and token files have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's rows are read from where they are written; a stage's folder goes when the next one is there."""
    docs, before, rows = read(spark, sf_dir, "documents"), None, spark.conf.get(_ROWS)
    for name, stage in STAGES:
        folder = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            drop(spark, before)
        before = folder
    spark.conf.set(_ROWS, rows)
    return docs
