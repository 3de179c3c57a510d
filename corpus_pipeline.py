"""From raw documents to a decontaminated, mixed and sharded training corpus.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the docs of
the next one.  All but the last return the columns of documents.

1. quality_rules    rejected documents go
2. near_duplicates  one document of each component stays (5-word shingles, 0.8)
3. decontamination  documents that hold a benchmark item go
4. mixing           every source comes as often as its target asks for
5. sharding         each row gets its shard and slot

Null or empty texts fail the quality rules; with an empty table every stage
returns an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeway.llm import decontamination, jaccard_join, mixing, quality_rules, sharding
from lodeway.llm.keys import shared

N_SHARDS = 16
#: Rounding and hashing decide two of the stages, so SQL can't give the rows of run().
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the standard policy; each row is judged by itself, null and empty texts fail."""
    ledger = quality_rules.quality_ledger(docs, carry=tuple(docs.columns))
    return quality_rules.judge(ledger, quality_rules.POLICIES["standard"]).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document of the least id; of rows alike in id and text one; rows without words stay, one for each id."""
    return jaccard_join.near_dedup(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item; null and empty texts hold none."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows without words are in no copy, a null source is a source."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its size, checksum, shard and slot; null ids come first, a null text has size 1."""
    out = sharding.shard_by_bytes(docs, N_SHARDS, carry=tuple(docs.columns))
    return out.select("row.*", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; what lies between is written to the shared checkpoint folder."""
    shared(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
