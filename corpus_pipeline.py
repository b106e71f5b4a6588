"""A corpus made fit for training: five stages over documents, each an operator at work.

Each stage reads what the one before it wrote as Parquet, in the shared folder, and works on all
of it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import table
from tablewright.llm.decontaminate import find_leaks
from tablewright.llm.jaccard_join import keep_one
from tablewright.llm.line_dedup import remove_boilerplate
from tablewright.llm.mixing import mix_sources
from tablewright.llm.queries import held_out
from tablewright.llm.toxicity import fit_classifier, score_toxicity
from tablewright.session import scratch_path

#: Score from which a document is rejected as toxic.
REJECTED = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below ``REJECTED``."""
    model = fit_classifier(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", ~held_out())
    scored = score_toxicity(docs, "text", model, keep=docs.columns, name="__score")
    return scored.filter(F.col("__score") < REJECTED).drop("__score")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that spread over many sources; ``n_chars`` follows the text."""
    cleaned = remove_boilerplate(docs, "doc_id", "text", "source").drop("n_lines", "n_removed")
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return keep_one(docs, "doc_id", "text")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    found = find_leaks(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.filter(F.size("leaks") == 0).drop("leaks").toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the weights of their sources; adds ``rate`` and ``copy``."""
    return mix_sources(docs, "doc_id", "source", "text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("jaccard_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix),
]

#: Learned scores, similarity classes and alignments have no SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
