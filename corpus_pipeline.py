"""From raw documents to packed training sequences, each stage over all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm import near_copies, op2_quality, op3_packing, op4_decontamination, op8_toxicity
from skeinwork.llm.common import Scratch, fresh

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 stay; the scorer learns from the labels of these documents that are not held out."""
    return op8_toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within the distance of their language and source stay."""
    names = fresh(docs.columns, "quality"), fresh(docs.columns, "kept")
    return op2_quality.judge(docs, names=names).where(f"`{names[1]}`").drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by sharing 0.8 or more of the five-word shingles stays: SimHash classes and, for
    what lies farther apart, MinHash bands, both checked by the exact Jaccard similarity."""
    return near_copies.keep_one(docs, words=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (0.8 of its five-word shingles or more) stay."""
    return op4_decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shingle=5, threshold=0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 2048 tokens; a document ends with id 1."""
    return op3_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=1)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents; what a stage returns is written to the shared folder and read from there,
    and removed when the next one's rows are written."""
    rows, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch()
    for name, function in STAGES[:-1]:
        before, rows = rows, scratch.stage(function(spark, rows, sf_dir), name)
        if name != STAGES[0][0]:
            scratch.drop(before)
    return STAGES[-1][1](spark, rows, sf_dir)


# Tokenization, hashes and fitted estimates have no SQL form; tests compare with versions by brute force.
ORACLE_SQL: str | None = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
