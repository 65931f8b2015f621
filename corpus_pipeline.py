"""Corpus preparation from raw documents to packed sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barframe.llm import mixing, near_dedup, packing, personal_data, quality
from barframe.session import recorded_scratch, remove, scratch_path, ship_package

VOCAB = "byte_bpe_50k.json"
_HELD: list[str] = []  # scratch tables of the latest stage


def _stage(operator):
    """A stage around ``operator(docs)``. Its result still reads the operator's stored tables, so these stay until the next
    stage begins, whose documents are the written result."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        while _HELD:
            remove(spark, _HELD.pop())
        with recorded_scratch(_HELD):
            return operator(docs)

    run_stage.__name__, run_stage.__doc__ = operator.__name__, operator.__doc__
    return run_stage


@_stage
def quality_rules(docs: DataFrame) -> DataFrame:
    """Documents that the base rules and the robust outlier test keep."""
    return quality.good_documents(docs)


@_stage
def near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return near_dedup.one_of_each(docs, size=5, percent=80)


@_stage
def personal_data_redacted(docs: DataFrame) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return personal_data.redacted_documents(docs)


@_stage
def source_mix(docs: DataFrame) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, seed=17)


@_stage
def packed_sequences(docs: DataFrame) -> DataFrame:
    """Pieces of the documents, placed in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path(VOCAB), capacity=1024, end_id=2)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data_redacted),
    ("mixing", source_mix),
    ("packing", packed_sequences),
]
# The robust fit, the similarity join and the packing aren't SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
