"""Run-to-run differences: J-05, J-11, A-09, W-02, C-39."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_diff(results: DataFrame, owner: str, run: str, key: list[str], value: str) -> DataFrame:
    """(owner, run, key, change): each run against the one numbered one less; added, edited, unchanged or removed.

    The key's rows of run n - 1 are moved to run n and joined with its own in one full join on (owner, run, key).
    """
    on = [owner, run, *key]
    now = results.select(*on, F.col(value).alias("_now"), F.lit(True).alias("_in_now"))
    runs = results.select(owner, run).distinct()
    past = results.select(owner, (F.col(run) + 1).alias(run), *key, F.col(value).alias("_past"), F.lit(True).alias("_in_past")).join(runs, [owner, run], "left_semi")
    both = now.join(past, on, "full")
    change = F.when(F.col("_in_past").isNull(), "added").when(F.col("_in_now").isNull(), "removed").when(F.col("_now").eqNullSafe(F.col("_past")), "unchanged").otherwise("edited")
    return both.select(*on, change.alias("change"))


def changed_fields(past, now):
    """A-09, U-02: first-level keys of two maps of strings whose values differ; a missing value, null and 'null' are alike."""
    p, n = F.coalesce(past, F.create_map().cast("map<string,string>")), F.coalesce(now, F.create_map().cast("map<string,string>"))
    keys = F.array_sort(F.array_union(F.map_keys(p), F.map_keys(n)))
    at = lambda m, k: F.coalesce(F.element_at(m, k), F.lit("null"))
    return F.filter(keys, lambda k: at(p, k) != at(n, k))
