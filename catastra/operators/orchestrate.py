"""A pass over research cases as one set operation (T-06, T-10), and alerts on properties (X-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catastra.functions.captures import geocoding_query
from catastra.functions.text import blank_to_null
from catastra.operators import research

# What is said of a task that went wrong.
VERIFIED = "Ya geolocalizada (coordenadas verificadas)"
NO_PLACE = "Sin dirección ni distrito para geolocalizar"
NO_ANSWER = 'Sin resultados en OpenStreetMap para "'
NO_LOCALITY = "Sin distrito ni dirección: no se puede ubicar el remate en REM@JU"
NO_AUCTIONS = "Sin remates públicos en REM@JU para el distrito consultado"
STUB = "Módulo de análisis o conector no implementado (stub)"


def run_tasks(cases: DataFrame, tasks: DataFrame, properties: DataFrame, places: DataFrame, sources: DataFrame, auctions: DataFrame, skip_geolocation: bool = False) -> DataFrame:
    """T-06, T-07, T-09 to T-11: tasks with their new status, `error` and `moved`, after a pass over all cases.

    cases(case, property, status), tasks(task, case, task_type, status), properties(property, district, address, verified),
    places(query), what a geocoder knows, sources(source, status) and auctions(property, entries, certain). Tasks of cases that
    are done, settled tasks and, if so asked, those that geocoding's own queue does stay as they are. What a task lacks makes a
    status and an error of its row; no task stops another.
    """
    live_case = cases.filter(~F.col("status").isin(*research.CASE_TERMINAL)).select("case", "property")
    known = properties.select("property", "district", "address", "verified", F.lit(True).alias("_known"))
    out = tasks.withColumn("_source", research.task_source(F.col("task_type"))).join(live_case.withColumn("_live", F.lit(True)), "case", "left").join(known, "property", "left")
    out = out.withColumn("_query", geocoding_query(F.col("district"), F.col("address")))
    out = out.join(places.select(F.col("query").alias("_query"), F.lit(True).alias("_hit")).distinct(), "_query", "left")
    out = out.join(sources.select(F.col("source").alias("_source"), F.col("status").alias("_answer")), "_source", "left").join(auctions, "property", "left")

    kind, there = F.col("task_type"), F.coalesce("_known", F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    locality = F.coalesce(blank_to_null(F.col("district")), blank_to_null(F.col("address")))
    place = research.geolocation_outcome(yes("verified"), F.col("_query"), yes("_hit"))
    auction = research.auction_outcome(locality, F.col("entries"), F.col("certain"))
    answer = research.connector_outcome(F.coalesce("_answer", F.lit("error")))
    needs = kind.isin("identity", "geolocation", "judicial")
    status = F.when(needs & ~there, "failed").when(kind == "identity", "completed").when(kind == "geolocation", place).when(kind == "judicial", auction).when(kind.isin("registry", "bgr", "urbanism"), answer).otherwise("unavailable")
    missing = F.concat(F.lit("Property "), F.col("property").cast("string"), F.lit(" not found for "), kind, F.lit(" task"))
    of_place = F.when(status == "skipped", VERIFIED).when(status == "requires_manual_action", NO_PLACE).when(status == "failed", F.concat(F.lit(NO_ANSWER), "_query", F.lit('"')))
    of_auction = F.when(locality.isNull(), NO_LOCALITY).when(F.coalesce("entries", F.lit(0)) == 0, NO_AUCTIONS)
    stub = ~kind.isin("identity", "geolocation", "judicial", "registry", "bgr", "urbanism")
    error = F.when(needs & ~there, missing).when(kind == "geolocation", of_place).when(kind == "judicial", of_auction).when(stub, STUB)
    runs = yes("_live") & ~F.col("status").isin(*research.TASK_SETTLED)
    runs = runs & (kind != "geolocation") if skip_geolocation else runs
    return out.select(*[F.col(c) for c in tasks.columns if c != "status"], F.when(runs, status).otherwise(F.col("status")).alias("status"), F.when(runs, error).alias("error"), runs.alias("moved"))


def settle_cases(cases: DataFrame, tasks: DataFrame) -> DataFrame:
    """T-06, A-06: cases(case, property, status) with status, counters and summary after their tasks' pass; cases that were done stay, without counters; those without tasks run on."""
    done = F.col("status").isin(*research.CASE_TERMINAL)
    p = research.progress(tasks, "case", "status")
    out = cases.join(p, "case", "left")
    over = F.coalesce(F.col("settled") >= F.col("total"), F.lit(False))
    status = F.when(done, F.col("status")).when(over, F.col("case_status")).otherwise("running")
    summary = F.when(~done & over, F.when(F.col("failed") > 0, F.concat(F.lit("Caso con ejecución parcial: "), F.col("failed").cast("string"), F.lit(" tarea(s) con error"))).otherwise("Caso completado correctamente"))
    counter = lambda c: F.when(~done, F.col(c)).alias(c)
    return out.select("case", "property", status.alias("status"), *[counter(c) for c in ("settled", "total", "failed", "warnings")], summary.alias("summary"))


def orchestrate(cases: DataFrame, tasks: DataFrame, properties: DataFrame, places: DataFrame, sources: DataFrame, auctions: DataFrame, skip_geolocation: bool = False) -> tuple[DataFrame, DataFrame]:
    """T-06: the tasks and the cases after a pass; a second pass over what it gives changes nothing but tasks that were left out."""
    moved = run_tasks(cases, tasks, properties, places, sources, auctions, skip_geolocation)
    return moved, settle_cases(cases, moved.select("case", "status"))


def alerts(listings: DataFrame, registry: DataFrame, below: float = 0.65, apart: float = 0.1) -> DataFrame:
    """X-03: (property, kind, severity, value) of listings(property, district, area, price) against registry(property, area): an area that differs from the registered one by more than `apart` of it, and a price for a square metre under `below` of its district's mean.

    Rows without what an alert compares give none.
    """
    rate = F.when(F.col("area") > 0, F.col("price") / F.col("area"))
    priced = listings.select("property", "district", rate.alias("rate")).filter("rate is not null")
    mean = priced.groupBy("district").agg(F.avg("rate").alias("mean"))
    cheap = priced.join(mean, "district").filter(F.col("rate") < below * F.col("mean")).select("property", F.lit("precio").alias("kind"), F.lit("low").alias("severity"), (F.col("rate") / F.col("mean")).alias("value"))
    both = listings.select("property", F.col("area").alias("said")).join(registry.select("property", F.col("area").alias("known")).filter("known > 0"), "property")
    wrong = both.filter(F.abs(F.col("said") - F.col("known")) > apart * F.col("known")).select("property", F.lit("area").alias("kind"), F.lit("high").alias("severity"), (F.col("said") / F.col("known")).alias("value"))
    return wrong.unionByName(cheap)


def capped(rows: DataFrame, by: list[str], order: list[Column], most: int = 60) -> DataFrame:
    """O-07: of each search the first `most` rows in order, with `total`, how many it found in all."""
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth").join(total, by)
