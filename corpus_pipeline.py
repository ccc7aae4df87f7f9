"""The corpus pipeline: five operators of ``proofbox.llm`` in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``. All stages but the last return the columns of
``documents``. The first drops what the quality classifier rejects, the second keeps one
document of each near-duplicate class, the third drops documents that hold a benchmark
window, the fourth replaces secrets in the text (and keeps ``n_chars`` in step), the last
packs what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofbox.llm import decontaminate, near_dup, packing, quality, secret_scan
from proofbox.llm.common import crc_mod, stored

THRESHOLD = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least THRESHOLD; learns as op5 does, from rows outside the held-out fifth."""
    model = quality.train(docs.where(crc_mod("doc_id", 5) != 0), _table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, score_col="__quality")  # documents may have a column called score
    return scored.where(f"__quality >= {THRESHOLD}").drop("__quality")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, length_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, keep_pieces=False)  # workers of a long session stay small


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dup_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: Training, banding, zstandard and the tokenizer are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
