"""The corpus pipeline: quality, near-duplicates, benchmark, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catastra.llm.common import read, staged
from catastra.llm.decontaminate import decontaminated
from catastra.llm.mixing import mix_sources
from catastra.llm.quality import keep_quality
from catastra.llm.sharding import shard_by_bytes
from catastra.llm.simhash import keep_one_of_each

SHARDS = 8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the rules reject go, null and empty ones among them. Repeated rows are judged each for itself."""
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of five-word similarity 0.8 or more stays, that of least id. Null and empty texts are one group, repeated rows too."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark item go. Null and empty texts hold none; repeated rows go or stay alike; an empty benchmark takes nothing."""
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as often as its source's weight and its own Poisson count say, in a global random order. Null sources are one source; rows of one id have one count, null ids among them."""
    return mix_sources(docs).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with size, shard and slot, in order of id (nulls first). Null texts have size 1; equal rows may stand either way round."""
    return shard_by_bytes(docs, SHARDS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: Similarity classes and the tiling have no SQL; tests/llm/test_pipeline.py holds each stage against SQL or a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written as Parquet and read again. Of an empty table nothing comes out; columns beyond those of documents stay."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
