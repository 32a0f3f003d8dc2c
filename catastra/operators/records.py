"""Registry state (A-08), operations summary (A-03 to A-05, F-14, J-10, U-01) and dossiers (J-02 to J-05, A-10, A-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catastra.functions.text import hours_between


def registry_state(charges: DataFrame, owner: str, active: Column, inactive: Column, amount: Column, currency: Column, date: Column, currencies: list[str]) -> DataFrame:
    """A-08: counts, active debt in each currency, the last date, and the label."""
    sums = [F.round(F.coalesce(F.sum(F.when(active & (currency == c), amount)), F.lit(0.0)), 2).alias(f"debt_{c.lower()}") for c in currencies]
    out = charges.groupBy(owner).agg(F.count(F.lit(1)).alias("charges"), F.count_if(active).alias("active"), F.count_if(inactive).alias("inactive"), *sums, F.max(date).alias("last_date"))
    return out.withColumn("state", F.when(F.col("active") > 0, "cargado").when(F.col("charges") > 0, "sano").otherwise("desconocido"))


def status_counts(rows: DataFrame, status: str, states: list[str]) -> DataFrame:
    """A-03."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == s).alias(f"n_{s}") for s in states])


def mean_hours(rows: DataFrame, start: str, end: str) -> DataFrame:
    """A-04: null if no row has both times."""
    both = F.col(start).isNotNull() & F.col(end).isNotNull()
    return rows.agg(F.avg(F.when(both, hours_between(F.col(start), F.col(end)))).alias("mean_hours"))


def stale(rows: DataFrame, since: str, as_of: str, hours: float) -> DataFrame:
    """F-14: rows older than so many hours, with age_hours."""
    return rows.withColumn("age_hours", hours_between(F.col(since), F.lit(as_of).cast("timestamp_ntz"))).filter(F.col("age_hours") > hours)


def orphans(tasks: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """J-10: tasks without an action."""
    return tasks.join(actions, key, "left_anti")


def stuck(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """U-01, O-05: (kind, key, age_hours) of all parts."""
    out = None
    for kind, rows in parts.items():
        rows = rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "age_hours")
        out = rows if out is None else out.unionByName(rows)
    return out


def children(rows: DataFrame, parent: str, fields: list[str], to: str) -> DataFrame:
    """J-02, J-03: the rows of each parent as one array of structs in order of the fields."""
    return rows.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(to))


def findings(rows: DataFrame, key: str, tests: list[tuple[str, Column, Column]]) -> DataFrame:
    """A-10: (key, finding, kind): each (name, test, kind) that holds, in long form; one pass."""
    every = F.array(*[F.when(test, F.struct(F.lit(name).alias("finding"), kind.alias("kind"))) for name, test, kind in tests])
    return rows.select(key, F.explode(F.array_compact(every)).alias("f")).select(key, "f.*")


def stale_passes(passes: DataFrame, key: str, order: str, new_rows: Column) -> DataFrame:
    """W-04: how many passes in a row brought nothing new, up to each pass; a pass that does resets it."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(order)
    island = passes.withColumn("_i", F.sum(F.when(new_rows > 0, 1).otherwise(0)).over(w))
    count = F.sum(F.when(new_rows > 0, 0).otherwise(1)).over(Window.partitionBy(key, "_i").orderBy(order))
    return island.withColumn("stale_passes", count).drop("_i")


def queue_depth(jobs: DataFrame, queues: DataFrame, queue: str, state: str, states: list[str]) -> DataFrame:
    """A-17: jobs of each queue by state; null throughout for a queue that reports none."""
    return queues.select(queue).join(jobs.groupBy(queue).agg(*[F.count_if(F.col(state) == s).alias(s) for s in states]), queue, "left")


def connected(depths: DataFrame, states: list[str]) -> DataFrame:
    """A-17: whether any queue reports; false for none."""
    return depths.agg(F.coalesce(F.bool_or(F.coalesce(*states).isNotNull()), F.lit(False)).alias("connected"))
