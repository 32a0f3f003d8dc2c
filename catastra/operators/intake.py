"""T-13: captures that people have made, taken in as one set operation: registry rows and their parts, places, attachments and results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catastra.functions import captures
from catastra.sources import readers
from catastra.sources.shared import staged

# Where a capture may come from, besides a person.
REGISTRY_SOURCES = ["sunarp", "sunarp_bgr", "sunarp_sprl"]


@dataclass(frozen=True)
class Taken:
    """What a set of captures adds: rows of each table, the actions' new status with their results, and what went wrong."""

    registry: DataFrame
    owners: DataFrame
    charges: DataFrame
    titles: DataFrame
    places: DataFrame
    links: DataFrame
    actions: DataFrame
    failures: DataFrame


def take_in(actions: DataFrame, payloads: DataFrame, answers: DataFrame) -> Taken:
    """T-13, T-14, C-36, K-10, K-16: payloads(action, the fields of intake_plan, pdf_name, pdf) of actions(action, property, status, source, url).

    Only requested actions are completed, each by its first payload (by `ordinal`). One with an attachment that is empty or too large is a
    failure, and so is one for an action that is not there or not requested; a failure adds nothing elsewhere. A place
    that the payload lacks is asked of answers(query, lat, lon), a geocoder's, with low confidence. The same captures give the
    same rows and keys again.
    """
    first = F.row_number().over(Window.partitionBy("action").orderBy("ordinal"))
    known = actions.select("action", "property", F.col("status").alias("_status"), F.col("source").alias("_source"), F.col("url").alias("_url"))
    rows = payloads.withColumn("_first", first == 1).join(known, "action", "left")
    pdf = readers.attachment(F.col("pdf"))
    why = F.when(F.col("_status").isNull(), F.concat(F.lit("Manual action "), F.col("action").cast("string"), F.lit(" not found"))).when((F.col("_status") != "requested") | ~F.col("_first"), F.concat(F.lit("Manual action "), F.col("action").cast("string"), F.lit(" already "), F.when(F.col("_status") == "requested", "completed").otherwise(F.col("_status"))))
    why = F.coalesce(why, F.when(F.col("pdf").isNotNull() & ~pdf["ok"], F.when(pdf["bytes"] > 0, "PDF excede el límite de 8 MB").otherwise("PDF vacío o base64 inválido")))
    rows = staged(rows.withColumn("failure", why))
    failures = rows.filter("failure is not null").select("action", "ordinal", "failure")

    good = rows.filter("failure is null")
    plan = captures.intake_plan(good)
    plan = plan.join(answers.groupBy(F.col("query").alias("geocode_query")).agg(F.min(F.struct("lat", "lon")).alias("_answer")), "geocode_query", "left")
    given = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    found = ~given & F.col("needs_geocoding") & F.col("_answer").isNotNull()
    origin = F.when(F.col("_source").isin(*REGISTRY_SOURCES), F.col("_source")).otherwise("manual")
    has = F.col("has_registry_row")
    plan = staged(plan.withColumns({
        "registry_id": F.when(has, F.concat(F.lit("registry-"), F.col("action").cast("string"))), "origin_source": origin,
        "place_lat": F.when(given, F.col("lat")).when(found, F.col("_answer.lat")), "place_lon": F.when(given, F.col("lon")).when(found, F.col("_answer.lon")),
        "place_source": F.when(given, "manual").when(found, "manual-geocoded"), "place_confidence": F.when(given, F.col("confidence")).when(found, "low"),
        "pdf_key": F.when(F.col("pdf").isNotNull(), readers.attachment_key(F.col("property"), F.col("action"), F.col("pdf_name"))),
    }).drop("_answer"))
    source = F.when(F.col("origin_source") == "manual", "remaju").otherwise(F.col("origin_source"))
    kept = plan.filter("registry_id is not null")
    registry = kept.select("registry_id", "property", "number", "address", "district", source.alias("source"), F.lit("medium").alias("confidence"), F.lit("reported").alias("verification"))
    part = lambda c: kept.select("registry_id", F.posexplode(c).alias("position", "p")).select("registry_id", "position", "p.*", F.lit("sunarp").alias("source"))
    places = plan.filter("place_source is not null").groupBy("property").agg(F.max(F.struct("ordinal", "place_lat", "place_lon", "place_source", "place_confidence")).alias("p")).select("property", F.col("p.place_lat").alias("lat"), F.col("p.place_lon").alias("lon"), F.col("p.place_source").alias("source"), F.col("p.place_confidence").alias("confidence"), F.lit("reported").alias("verification"))
    links = plan.filter("pdf_key is not null").select("property", F.col("pdf_key").alias("url"), F.col("pdf_name").alias("title"), F.lit("remate_pdf").alias("link_type"), F.lit("remaju").alias("source"))
    many = lambda c: F.when(F.col("registry_id").isNotNull(), F.coalesce(F.size(c), F.lit(0))).otherwise(0)
    result = F.struct("registry_id", "number", "address", "district", F.col("amount").alias("debt"), F.col("origin_source").alias("source"), many("owners").alias("owners"), many("charges").alias("charges"), many("titles").alias("titles"), "pdf_key", F.col("place_source").isNotNull().alias("placed"), "warnings")
    done = plan.select("action", result.alias("result"))
    out = actions.join(done, "action", "left").withColumn("status", F.when(F.col("result").isNotNull(), "completed").otherwise(F.col("status")))
    return Taken(registry, part("owners"), part("charges"), part("titles"), places, links, out.select(*actions.columns, "result"), failures)
