"""A training corpus from raw documents: five stages, each written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.decontaminate import decontaminate_stage
from tickloom.llm.mixing import mix_stage
from tickloom.llm.quality_rules import quality_stage
from tickloom.llm.simhash import near_dedup_stage
from tickloom.llm.token_codes import token_stage
from tickloom.session import ship_package, stage

STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing to weights", mix_stage),
    ("token ids", token_stage),
]

#: Fingerprints, components, templates and tokens are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written to the shared folder."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
