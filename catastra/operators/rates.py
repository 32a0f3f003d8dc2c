"""Prices at the rate of their time (X-05): an as-of join in order of time within equal stretches of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, at: str, value: str, by: list[str], grain_s: int = 3_600) -> DataFrame:
    """left with `value` and `value`_at of the last row of right(by, at, value) that is not later, of the same `by`; null before the first.

    Each time that left asks for is answered once, however many rows ask. Time is cut into stretches of grain_s seconds; in each, its
    own times of both sides stand in order and every question takes the last row before it, in one pass, or else the last
    row of the stretches before, which comes from a row for each stretch. So the work is that of a sort, whatever
    a stretch holds. Of several right rows at one time the greatest value counts; rows of right with a null are left out, rows of left
    with one find nothing.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    stretch = F.floor(micros(at) / (grain_s * 1_000_000)).cast("long").alias("_stretch")
    ticks = right.select(*by, F.col(at).alias("_at"), F.col(value).alias("_value"), stretch).na.drop().groupBy(*by, "_stretch", "_at").agg(F.max("_value").alias("_value"))
    ticks = ticks.select(*by, "_stretch", "_at", F.struct(F.col("_at").alias("at"), F.col("_value").alias("value")).alias("_tick"))
    asked = left.select(*by, stretch, F.col(at).alias("_at")).na.drop().distinct()
    lasts = ticks.groupBy(*by, "_stretch").agg(F.max("_tick").alias("_final")).unionByName(asked.select(*by, "_stretch").distinct(), allowMissingColumns=True).groupBy(*by, "_stretch").agg(F.max("_final").alias("_final"))
    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*by, "_stretch", F.last("_final", ignorenulls=True).over(before).alias("_before"))
    # at one time the row of right comes first
    inside = Window.partitionBy(*by, "_stretch").orderBy("_at", F.col("_tick").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = ticks.withColumn("_ask", F.lit(False)).unionByName(asked.withColumn("_ask", F.lit(True)), allowMissingColumns=True).withColumn("_mine", F.last("_tick", ignorenulls=True).over(inside)).filter("_ask")
    answers = met.join(carried, [*by, "_stretch"]).select(*by, F.col("_at").alias(at), F.coalesce("_mine", "_before").alias("_last"))
    return left.join(answers, [*by, at], "left").select(*left.columns, F.col("_last.value").alias(value), F.col("_last.at").alias(f"{value}_at"))


def in_both(amount: Column, currency: Column, soles: Column) -> list[Column]:
    """X-05: the amount in dollars and in soles, at so many soles for a dollar; null in a currency that is neither."""
    usd = F.when(currency == "USD", amount).when(currency == "PEN", amount / soles)
    pen = F.when(currency == "PEN", amount).when(currency == "USD", amount * soles)
    return [F.round(usd, 2).alias("price_usd"), F.round(pen, 2).alias("price_pen")]
