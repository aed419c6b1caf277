"""The corpus pipeline: documents to a de-duplicated, decontaminated, mixed and sharded corpus.

Each stage works on everything the one before it kept. Stages are written to the shared folder, so
a lost executor costs no more than tasks of the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.decontaminate import decontaminate_stage
from marlstone.llm.language import language_stage
from marlstone.llm.minhash import dedup_stage
from marlstone.llm.mixing import mix_stage
from marlstone.llm.sharding import shard_stage
from marlstone.llm.shared import table, written

STAGES = [
    ("language", language_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mix_stage),
    ("sharding", shard_stage),
]

#: The first stage is a trained network: no SQL. The stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the columns of documents, shard and slot."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
