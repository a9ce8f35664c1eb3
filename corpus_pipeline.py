"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its
result is written as Parquet on shared storage and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hoprank.llm import common
from hoprank.llm.decontaminate import leak_stage
from hoprank.llm.minhash import near_dup_stage
from hoprank.llm.mixing import mix_stage
from hoprank.llm.quality import quality_stage
from hoprank.llm.tokens import token_output

STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_dup_stage),
    ("decontamination", leak_stage),
    ("mixing", mix_stage),
    ("token_output", token_output),
]

#: Tokenizing can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
