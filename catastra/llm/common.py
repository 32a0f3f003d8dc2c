"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words end at these six bytes and at nothing else; bytes.split() cuts at exactly these.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = r"[^\x20\x09-\x0D]+"

#: A table up to so many rows may be broadcast; beyond, callers join by shuffle.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="catastra-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, kind: str = "staged") -> str:
    """A new name in the shared folder, for what goes when the session ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def staged(df: DataFrame, few: bool = False) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: lineage ends there and later reads prune columns. few: of far less data than the tasks that make it have read, so that it goes to files of a fair size first."""
    spark = df.sparkSession
    path = scratch(spark)
    (df.hint("rebalance") if few else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with fewer rows than this is never split.
HOT_ROWS = 500
HOT_SALTS = 64


def hot_keys(counts: DataFrame, count: str = "count") -> DataFrame | None:
    """Of a table of keys with their number of rows, those of very many: BROADCAST_ROWS keys at most, since each has more than its share of all rows."""
    total, most = counts.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()  # two numbers
    least = max(HOT_ROWS, -(-int(total) // BROADCAST_ROWS))
    return staged(counts.filter(F.col(count) > least).drop(count)) if most > least else None


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """left joined with right by key, of which right has one row each. Rows of the keys in hot(key) are dealt over HOT_SALTS parts by `spread`, and right's row is repeated for each part."""
    if hot is None:
        return left.join(right, key, how)
    marks = F.broadcast(hot.select(key).withColumn("_hot", F.lit(True)))  # see hot_keys: a bounded number
    left = left.join(marks, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(HOT_SALTS))).otherwise(0).cast("int")).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = right.join(marks, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def without(df: DataFrame, names) -> DataFrame:
    """df less the columns that a result of these names would clash with (Spark compares names without case)."""
    lower = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


def plain_names(df: DataFrame, *names: str) -> tuple[DataFrame, list[str], list[str]]:
    """df with columns c0, c1, ..., which clash with no name of ours; its own names; and what those given are called now."""
    lower = [c.lower() for c in df.columns]
    return df.toDF(*[f"c{i}" for i in range(len(lower))]), df.columns, [f"c{lower.index(n.lower())}" for n in names]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word, alike in every process."""
    import xxhash

    words = data.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling polynomial hashes of all n-word windows, from the hashes of the words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : len(h) - n + 1 + k]
    return out


#: Names that running_totals uses; columns of its input by these names are dropped.
INTERNAL = ["__pid", "__at", "__nth", "_base", "_first", "_before", "_rank"]


def running_totals(df: DataFrame, order: list[str], value: str) -> tuple[DataFrame, int, int]:
    """df in the order given, with `_before` (sum of `value` over all earlier rows) and `_rank` (number of earlier rows); the grand total and count.

    One range shuffle, a running sum inside each partition, then the totals of the partitions (one row each) are
    summed on the driver and sent back: no task ever sees more than its own range.
    Rows that agree in all of `order` may stand either way round. An empty df gives totals 0.
    """
    spark = df.sparkSession
    n = max(1, partitions(spark))
    keep = without(df, INTERNAL)
    schema = T.StructType([*keep.schema.fields, T.StructField("__pid", T.IntegerType()), T.StructField("__at", T.LongType()), T.StructField("__nth", T.LongType())])
    slot = keep.columns.index(value)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        pid, total, seen = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            size = np.asarray(b.column(slot).fill_null(0), np.int64)
            ends = np.cumsum(size)
            at = ends - size + total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), pid, np.int32)), pa.array(at), pa.array(np.arange(seen, seen + len(size)))], names=[*b.schema.names, "__pid", "__at", "__nth"])
            total, seen = total + int(size.sum()), seen + len(size)

    keys = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order]
    rows = staged(keep.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema))
    totals = sorted(tuple(r) for r in rows.groupBy("__pid").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).cast("long"), F.count(F.lit(1))).collect())  # a row for each partition
    offsets, total, count = [], 0, 0
    for pid, size, many in totals:
        offsets.append((pid, total, count))
        total, count = total + size, count + many
    small = spark.createDataFrame(offsets, "__pid int, _base long, _first long")
    joined = rows.join(F.broadcast(small), "__pid")
    out = joined.select(*keep.columns, (F.col("__at") + F.col("_base")).alias("_before"), (F.col("__nth") + F.col("_first")).alias("_rank"))
    return out, total, count
