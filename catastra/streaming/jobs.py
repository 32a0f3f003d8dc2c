"""Streams (R-*): cycles, keep-first deduplication and keyed task states, each run to the end of its input by run_all."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from catastra.operators.research import TASK_EDGES, TASK_RETRYABLE
from catastra.sources.shared import shared_path


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream, with event time as a timestamp (a watermark needs one)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_all(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """R-01, R-02: all that is there now, in micro-batches, into a new Parquet folder; what was written.

    Each batch has a folder of its own name, written in overwrite mode: one that is run again after a fault replaces
    what it had written (R-03, R-05).
    """
    spark = stream.sparkSession
    out = shared_path(spark, "stream")
    shape = stream if each is None else each(stream)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = shape.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", shared_path(spark, "offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = shape.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(out) if q.lastProgress else spark.createDataFrame([], schema)


def keep_first(stream: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """R-07, K-01: the first of each key within the watermark; state older than that goes."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def cycle_totals(stream: DataFrame, time: str, late: str, every: str, by: str) -> DataFrame:
    """R-02, A-15 (extension): counts by cycle of fixed length."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("cycle"), by, "n")


def task_states(stream: DataFrame, key: str, status: str, order: str, graph: dict[str, list[str]] = TASK_EDGES, first: str = "pending", retryable: list[str] = TASK_RETRYABLE) -> DataFrame:
    """R-06: after each batch, of the keys in it: status, retries and steps rejected so far.

    Steps within a batch are taken in order of `order`; the state of a key is two counters and a name.
    """
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, retries, rejected = state.get if state.exists else (first, 0, 0)
        for new in pd.concat(list(frames)).sort_values(order)[status]:
            if new == now:
                continue
            if new not in graph.get(now, []):
                rejected += 1
                continue
            retries += now in retryable and new in ("pending", "running")
            now = new
        state.update((now, retries, rejected))
        yield pd.DataFrame({key: [k[0]], "status": [now], "retries": [retries], "rejected": [rejected]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string, retries long, rejected long", "status string, retries long, rejected long", "update", GroupStateTimeout.NoTimeout)
