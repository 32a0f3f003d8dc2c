"""S-15: what a recogniser has said, kept by key, so that it is asked for new keys alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catastra.sources.store import exists


def recognised(spark: SparkSession, rows: DataFrame, path: str, recogniser: Callable[[list[str]], list[str | None]], at_once: int = 64) -> DataFrame:
    """rows(key, url, ...) with `text`: what the recogniser says of the picture at url, or said of the same key before.

    Keys that are stored under path are not asked again. The recogniser, which runs in tasks, is given the rest, each key once (of
    several addresses the least; only those that begin with http), at_once addresses at a time, and what it says is stored. Where it says null, or
    fails, text is null and nothing is stored, so the next run asks again. A null key is the address itself.
    """
    rows = rows.withColumn("_key", F.coalesce("key", "url"))
    known = spark.read.schema("_key string, text string").parquet(path) if exists(spark, path) else None
    asked = rows.filter(F.startswith("url", F.lit("http"))).groupBy("_key").agg(F.min("url").alias("url"))
    if known is not None:
        asked = asked.join(known.select("_key"), "_key", "left_anti")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lo in range(0, len(pdf), at_once):
                part = pdf.iloc[lo : lo + at_once]
                try:
                    said = list(recogniser(part["url"].tolist()))
                except Exception:  # a picture that cannot be read is no reason to stop
                    said = [None] * len(part)
                yield pd.DataFrame({"_key": part["_key"].to_numpy(), "text": said})

    asked.mapInPandas(ask, "_key string, text string").filter("text is not null").write.mode("append").parquet(path)
    stored = spark.read.schema("_key string, text string").parquet(path).groupBy("_key").agg(F.min("text").alias("text"))
    return rows.join(stored, "_key", "left").drop("_key")
