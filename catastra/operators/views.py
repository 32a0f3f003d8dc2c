"""Rows as a caller gets them: P-02 to P-05, P-11, T-08, C-28, F-13, F-19, and the report of a property (A-10, A-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catastra.functions import text

# The fields of each view in order, with the value that stands for a missing one (None: it stays missing).
SUMMARY = {
    "id": None, "public_id": None, "title": None, "property_type": "otro", "status": "active", "price": None, "currency": "unknown", "area_m2": None,
    "district": None, "province": None, "department": None, "latitude": None, "longitude": None, "listing_count": 0, "created_at": None, "updated_at": None,
}
DETAIL = SUMMARY | {
    "description": None, "address": None, "price_source": None, "price_confidence": "unknown", "price_verification": "reported", "area_source": None, "area_confidence": "unknown",
    "area_verification": "reported", "location_source": None, "location_confidence": "unknown", "location_verification": "reported", "metadata": None,
}
CASE = {
    "id": None, "property_id": None, "run_number": 0, "status": "pending", "summary": None, "error_count": 0, "warning_count": 0, "completed_task_count": 0,
    "total_task_count": 0, "started_at": None, "completed_at": None, "created_by": None, "created_at": None, "updated_at": None,
}
TASK = {
    "id": None, "case_id": None, "task_type": "", "status": "pending", "priority": "medium", "started_at": None, "completed_at": None, "error": None, "requires_manual_action": False,
    "manual_action_description": None, "retry_count": 0, "max_retries": 3, "created_at": None, "updated_at": None,
}
RESULT = {
    "id": None, "task_id": None, "property_id": None, "source": None, "source_url": None, "retrieved_at": None, "data_type": None, "data": None, "raw_data": None,
    "confidence": "unknown", "verification": "reported", "parser_version": None, "metadata": None, "created_at": None,
}
ACTION = {
    "id": None, "task_id": None, "property_id": None, "action_kind": None, "status": None, "instructions": None, "url": None, "source": None, "requested_at": None,
    "completed_at": None, "completed_by": None, "result": None, "created_at": None, "updated_at": None,
}

SURE = {"confidence": "unknown", "verification": "reported"}


def fields(names: str, **defaults) -> dict:
    return {n: defaults.get(n) for n in names.split()}


# The parts of a property's dossier, likewise.
DOSSIER = {
    "run": fields("run_number case_id status summary error_count warning_count completed_task_count total_task_count started_at completed_at created_by created_at updated_at", run_number=0, status="pending", error_count=0, warning_count=0, completed_task_count=0, total_task_count=0),
    "registry": fields("id registry_number registry_office registry_zone registered_area registered_address registered_district source confidence verification retrieved_at", **SURE),
    "owner": fields("id owner_name owner_type document_type document_number ownership_percentage registered_date"),
    "charge": fields("id charge_type description amount currency creditor registered_date is_active", is_active="unknown"),
    "title": fields("id title_number title_date title_type notary description"),
    "zone": fields("id zone_name zone_code zone_type land_use description source confidence verification", **SURE),
    "parameters": fields("id max_height max_floors max_buildable_area min_free_area setback_front setback_side setback_rear density compatible_uses observations source confidence verification", **SURE),
    "location": fields("id address district province department postal_code latitude longitude source confidence verification verified_at", **SURE),
    "geometry": fields("id geom_type source confidence verification", **SURE),
    "judicial": fields("id case_number court case_type subject status filing_date parties source source_url retrieved_at"),
    "event": fields("id event_date event_type description resolution"),
    "comparable": fields("id comparable_title comparable_url comparable_price comparable_currency comparable_area_m2 comparable_district distance_meters price_per_m2 similarity source retrieved_at", comparable_currency="unknown"),
    "price": fields("id estimated_price currency price_per_m2 estimation_type confidence source retrieved_at", currency="unknown", confidence="unknown"),
    "document": fields("id document_type file_name mime_type size_bytes storage_url checksum source description created_at", document_type="other"),
    "link": fields("id url title link_type source is_accessible last_checked_at", is_accessible="unknown"),
}


def iso(rows: DataFrame, name: str) -> Column:
    """P-04: a time in UTC with milliseconds; one without a zone is in UTC already."""
    c = F.to_utc_timestamp(F.col(name), F.current_timezone()) if dict(rows.dtypes)[name] == "timestamp" else F.col(name)
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def view(rows: DataFrame, fields: dict) -> DataFrame:
    """P-02 to P-04: the fields of a view in its order, gaps filled, times as text; a field that rows lack is missing throughout."""
    kinds = dict(rows.dtypes)

    def column(name, default):
        if name not in kinds:
            return F.lit(default).cast("string") if default is None else F.lit(default)
        if kinds[name].startswith("timestamp"):
            return iso(rows, name)
        return F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default))

    return rows.select(*[column(n, d).alias(n) for n, d in fields.items()])


def dossier_part(rows: DataFrame, part: str, owner: str, **children: tuple[DataFrame, str, str]) -> DataFrame:
    """P-05, J-02, J-03: the rows of a part of the dossier with their owner, and of each row an array of its children in order of their ids.

    children: name=(rows, their part, the column that holds the parent's id). A row without children has an empty array.
    """
    out = view(rows, {owner: None} | DOSSIER[part])
    for name, (child, kind, parent) in children.items():
        seen = view(child, {parent: None} | DOSSIER[kind])
        held = seen.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(*DOSSIER[kind]))).alias(name)).withColumnRenamed(parent, "id")
        empty = F.array().cast(held.schema[name].dataType)
        out = out.join(held, "id", "left").withColumn(name, F.coalesce(name, empty))
    return out


def identity(properties: DataFrame) -> DataFrame:
    """T-08: the result that the identity task of each property records; coordinates count where both are there and not blank."""
    there = lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    return properties.select(
        F.col("id").alias("property_id"), F.lit("system").alias("source"), F.lit("identity").alias("data_type"), "public_id", "title", F.coalesce("property_type", F.lit("otro")).alias("property_type"), "district",
        (there("latitude") & there("longitude")).alias("verified_coordinates"), "status", "price", "currency", F.col("price_source").alias("reported_source"), F.lit("high").alias("confidence"), F.lit("inferred").alias("verification"), F.lit("identity-v1").alias("parser_version"),
    )


def auction_entry(items: DataFrame) -> DataFrame:
    """P-11: (external_id, source_url, title, district, raw_data as JSON) as what matching takes; the normalised values first."""
    at = lambda k: F.get_json_object("raw_data", f"$.{k}")
    return items.select(
        "external_id", "source_url", "title", F.coalesce(at("normalized.partida"), at("partida")).alias("number"), F.coalesce(at("normalized.ubicacion"), F.col("district")).alias("place"), at("normalized.ubicacionKey").alias("place_key"),
        at("normalized.fechaISO").alias("date"), at("normalized.tipo").alias("kind"), at("normalized.remateId").try_cast("long").alias("auction_id"), at("normalized.convocatoriaId").try_cast("long").alias("call_id"),
    )


def auction_slides(slides: DataFrame) -> DataFrame:
    """C-28: strings (auction, call, code, label, place, date_iso, date, last_day, info, amount) of a slide as typed values."""
    t = lambda c: text.blank_to_null(text.trimmed(F.col(c)))
    whole = lambda c: F.when(t(c).rlike("^[0-9]+$"), t(c).try_cast("long"))
    where = text.place(F.col("place"))
    return slides.select(
        whole("auction").alias("auction_id"), whole("call").alias("call_id"), text.auction_type(F.col("code"), F.col("label")).alias("kind"), F.coalesce(t("label"), t("code")).alias("kind_raw"), where["display"].alias("place"), where["key"].alias("place_key"),
        F.coalesce(F.col("date_iso"), text.date_iso(F.col("date"))).alias("date"), "last_day", t("info").alias("info"), F.when(F.col("amount") != "", "PEN").alias("currency"), text.amount_pen(F.col("amount")).alias("amount"),
    )


def slides_of(slides: DataFrame, wanted: str | None) -> DataFrame:
    """F-13: normalised slides whose place holds the wanted one, without accents and case; a blank one keeps all."""
    w = (wanted or "").strip()
    return slides.filter(F.contains(F.coalesce("place_key", F.lit("")), text.strip_accents(F.upper(F.lit(w))))) if w else slides


def without_placeholders(groups: DataFrame, url: str = "url") -> DataFrame:
    """F-19: groups whose link nobody has filled in go."""
    return groups.filter(~F.coalesce(F.contains(F.col(url), F.lit("REEMPLAZAR")), F.lit(False)))


def active_charges(registry: Column) -> Column:
    """A-11: charges in force over all entries of an array of struct(charges: array of struct(active))."""
    one = lambda e: F.coalesce(F.array_size(F.filter(e["charges"], lambda c: c["active"] == "si")), F.lit(0))
    return F.coalesce(F.aggregate(registry, F.lit(0), lambda n, e: n + one(e)), F.lit(0))


def report(dossiers: DataFrame, key: str) -> DataFrame:
    """A-10: (key, position, label, value, kind, source): four to nine findings of each property, in order.

    dossiers: key, runs, last_run, last_status, latitude, longitude, registry (A-11), alerts (array of struct(severity,
    kind, status)), comparables, prices, results, zones, judicial. A missing count or array is an empty one.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    say = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    entries, live = F.coalesce(F.array_size("registry"), F.lit(0)), active_charges(F.col("registry"))
    rows = dossiers.withColumns({"_entries": entries, "_live": live, "_alerts": F.filter("alerts", lambda a: a["status"] == "active")})
    alerts = F.coalesce(F.array_size("_alerts"), F.lit(0))
    names = F.array_join(F.transform("_alerts", lambda a: F.concat_ws(" ", a["severity"], a["kind"])), ", ")
    grave = F.exists("_alerts", lambda a: a["severity"].isin("critical", "high"))
    entries, live = F.col("_entries"), F.col("_live")
    place = F.coalesce((F.col("latitude").cast("string") != "") & (F.col("longitude").cast("string") != ""), F.lit(False))
    always, fact, check, gap = F.lit(True), F.lit("fact"), F.lit("requiere_verificacion"), F.lit("unavailable")
    # Labels and sources as they are shown.
    found = [
        (always, "Investigaciones", F.when(n("runs") == 0, "Sin ejecuciones aún").otherwise(say(n("runs"), " ejecución(es) · última ", n("last_run"), " (", F.coalesce("last_status", F.lit("")), ")")), fact, "research_cases"),
        (place, "Coordenadas", say(F.col("latitude"), ", ", F.col("longitude")), fact, "properties"),
        (always, "Registro (SUNARP)", F.when(entries == 0, "Sin datos registrales capturados").otherwise(say(entries, " partida(s) capturada(s)", F.when(live > 0, say(" · ", live, " carga(s) activa(s)")).otherwise(""))), F.when(entries == 0, gap).when(live > 0, check).otherwise(fact), "registry_properties"),
        (alerts > 0, "Alertas", say(alerts, " alerta(s) activa(s): ", names), F.when(grave, check).otherwise("signal"), "property_alerts"),
        (always, "Evidencias", say(n("results"), " resultado(s) de investigación capturado(s)"), fact, "research_results"),
        ((n("comparables") > 0) | (n("prices") > 0), "Mercado", say(n("comparables"), " comparable(s) · ", n("prices"), " precio(s) estimado(s)"), fact, "market_comparables/market_prices"),
        (n("zones") == 0, "Urbanismo", F.lit("Sin zonificación/parámetros aún"), gap, "urban_zones"),
        (n("judicial") == 0, "Judicial", F.lit("Sin expedientes coincidentes aún"), gap, "judicial_cases"),
        (always, "Infraestructura", F.lit("Sección PLANNED (sin fuentes conectadas)"), gap, "infrastructure (planned)"),
    ]
    every = F.array(*[F.when(test, F.struct(F.lit(label).alias("label"), value.alias("value"), kind.alias("kind"), F.lit(source).alias("source"))) for test, label, value, kind, source in found])
    return rows.select(key, F.posexplode(F.array_compact(every)).alias("position", "f")).select(key, "position", "f.*")
