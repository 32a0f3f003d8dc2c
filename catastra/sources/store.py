"""Stored tables (K-02, K-08, K-12): upserts by batch number that rewrite only the parts they touch, with audit rows and counters of the same pass (A-13, A-15, A-16)."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from catastra.operators.resolve import latest
from catastra.sources.shared import staged

LOG = logging.getLogger(__name__)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def written(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None, **counters: Column) -> dict:
    """Writes df and gives the counters, aggregates of its rows that are made as they pass."""
    seen = Observation()
    out = df.observe(seen, *[c.alias(n) for n, c in counters.items()]).write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (out.partitionBy(*by) if by else out).parquet(path)
    return {n: v or 0 for n, v in seen.get.items()}


class StoredTable:
    """A table under path, one row for each key, in parts by a hash of the key.

    upsert() with a batch's number merges its rows: of each key the last counts (by `order`), and replaces what is stored.
    Only parts with a key of the batch are read and written; the files of others stay. A batch that is done is not done
    again; one that was cut off leaves the same table when it is run again, since its rows replace themselves and its audit rows
    stay as they were first written. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str], parts: int = 64) -> None:
        self.spark, self.path, self.key, self.order, self.parts = spark, path, key, order, parts

    def read(self) -> DataFrame | None:
        """The rows stored so far; None before the first batch."""
        data = f"{self.path}/data"
        return self.spark.read.parquet(data).drop("_part") if exists(self.spark, data) else None

    def get(self, **key) -> DataFrame:
        """S-03, S-04: the row of a key, if there is one. One part is read, and in it, since parts are sorted, the row groups that may have the key."""
        data = self.spark.read.parquet(f"{self.path}/data")
        value = [F.lit(key[k]).cast(data.schema[k].dataType) for k in self.key]
        same = F.col("_part") == self.part(*value)
        for k, v in zip(self.key, value, strict=True):
            same = same & (F.col(k) == v)
        return data.filter(same).drop("_part")

    def part(self, *key: Column) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.parts)).cast("int")

    def audit(self) -> DataFrame | None:
        """K-12: (entity, key, action, batch, at) of all batches."""
        path = f"{self.path}/audit"
        return self.spark.read.parquet(path) if exists(self.spark, path) else None

    def counters(self, batch: int) -> dict | None:
        """What a batch that is done did; None otherwise."""
        path = f"{self.path}/done/batch={batch}"
        return self.spark.read.parquet(path).first().asDict() if exists(self.spark, f"{path}/_SUCCESS") else None

    def upsert(self, rows: DataFrame, batch: int, entity: str = "row") -> dict:
        """Merges rows and gives the counters inserted, updated and unchanged, of the keys that the batch has. Rows with a null in the key are left out."""
        if (done := self.counters(batch)) is not None:
            return done
        new = latest(rows.na.drop(subset=self.key), self.key, [F.col(c) for c in self.order])
        new = new.select("*", self.part(*[F.col(k) for k in self.key]).alias("_part"))
        old = self.read()
        fields = [c for c in new.columns if c not in self.key and c != "_part"]
        if old is None:
            merged = new.withColumn("_action", F.lit("inserted"))
        else:
            touched = [r[0] for r in new.select("_part").distinct().collect()]  # numbers of parts
            stored = self.spark.read.parquet(f"{self.path}/data").filter(F.col("_part").isin(touched))
            a, b = stored.select(*self.key, "_part", F.struct(*fields).alias("_old")), new.select(*self.key, "_part", F.struct(*fields).alias("_new"))
            action = F.when(F.col("_new").isNull(), None).when(F.col("_old").isNull(), "inserted").when(F.col("_new").eqNullSafe(F.col("_old")), "unchanged").otherwise("updated")
            merged = a.join(b, [*self.key, "_part"], "full").withColumn("_action", action).select(*self.key, "_part", "_action", F.coalesce("_new", "_old").alias("_row")).select(*self.key, "_part", "_action", "_row.*")
        merged = staged(merged.select(*self.key, *fields, "_part", "_action"))  # what is read is written over below
        self.log(merged.filter("_action <> 'unchanged'"), batch, entity)
        did = written(merged.drop("_action").repartition("_part").sortWithinPartitions("_part", *self.key), f"{self.path}/data", "overwrite", ["_part"], rows=F.count(F.lit(1)))
        counts = merged.agg(*[F.count_if(F.col("_action") == a).alias(a) for a in ("inserted", "updated", "unchanged")]).withColumn("written", F.lit(did["rows"]))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/batch={batch}")
        return self.counters(batch)

    def log(self, changed: DataFrame, batch: int, entity: str) -> None:
        """K-12: an audit row for each change. What goes wrong here is told and stops nothing; what was written once stays."""
        path = f"{self.path}/audit/batch={batch}"
        try:
            if not exists(self.spark, f"{path}/_SUCCESS"):
                key = F.concat_ws("|", *[F.col(k).cast("string") for k in self.key])
                changed.select(F.lit(entity).alias("entity"), key.alias("key"), F.col("_action").alias("action"), F.current_timestamp().alias("at")).write.mode("overwrite").parquet(path)
        except (PySparkException, Py4JJavaError) as e:
            LOG.error("audit of batch %s: %s", batch, e)
