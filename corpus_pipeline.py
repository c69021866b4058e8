"""The corpus pipeline: toxicity, line dedup, near-duplicate groups, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again for the next one. All
but the last return the columns of ``documents``, with ``n_chars`` of the text as it then is.

Defined results: see the operators in ``loomwell.llm``. A null text is an empty one from line dedup on; a text that
loses all its lines becomes an empty one and stays. ``n_chars`` is set anew only where lines were dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.functions.tables import delete
from loomwell.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from loomwell.llm.common import checkpointed, sent_if_few, shared_folder, step, table


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    return toxicity.drop_toxic(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go from every document."""
    done = line_dedup.dedup_lines(docs)
    changed = F.col("_lines.n_dropped") > 0
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return done.select(*(n_chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with a similarity of 0.8 or more, the one with the smallest id stays."""
    gone = near_dedup.near_groups(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(sent_if_few(checkpointed(gone), near_dedup.SENT), "doc_id", "left_anti").select(docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic_documents),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("packing", packed),
]
#: A fitted classifier and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        with step(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        # What the stage read is not needed once its own result is there.
        if before is not None:
            delete(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
