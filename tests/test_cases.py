"""Views, dispatch, writes on tasks and CSV sinks on small rows, with values written out by hand."""

import glob
import json

from pyspark.sql import functions as F

from catastra.functions import text
from catastra.operators import records, research, resolve, views
from catastra.sources import readers, sinks


def test_view_fills_gaps_and_writes_utc(spark):
    rows = spark.sql("select 1 as id, cast(null as string) as status, timestamp_ntz'2026-01-02 03:04:05.678' as created_at, timestamp'2026-01-02 03:04:05Z' as updated_at, 9 as extra")
    out = views.view(rows, views.CASE)
    r = out.first()
    assert out.columns == list(views.CASE)
    assert (r.id, r.status, r.run_number, r.summary, r.started_at) == (1, "pending", 0, None, None)
    assert (r.created_at, r.updated_at) == ("2026-01-02T03:04:05.678Z", "2026-01-02T03:04:05.000Z")
    assert set(views.SUMMARY) < set(views.DETAIL)


def test_auction_entry_prefers_normalised_values(spark):
    raw = [json.dumps({"partida": "p", "normalized": {"partida": "n", "remateId": 7, "ubicacionKey": "CAYMA"}}), json.dumps({"partida": "p"}), None]
    items = spark.createDataFrame([(str(i), "u", "t", "d", x) for i, x in enumerate(raw)], "external_id string, source_url string, title string, district string, raw_data string")
    got = [(r.number, r.place, r.place_key, r.auction_id) for r in views.auction_entry(items).orderBy("external_id").collect()]
    assert got == [("n", "d", "CAYMA", 7), ("p", "d", None, None), (None, "d", None, None)]


def test_slides_are_typed_and_found_by_district(spark):
    rows = [("12", "x3", "2", " Segunda  convocatoria ", "ALTO  selva alegre", None, "05/02/2026", True, " ", "S/ 1,234.56"), (None, "4", "1", "", "Áncash", "2026-03-01", "01/01/2026", False, "i", None), (None,) * 10]
    slides = spark.createDataFrame(rows, "auction string, call string, code string, label string, place string, date_iso string, date string, last_day boolean, info string, amount string")
    out = views.auction_slides(slides)
    a, b, c = out.collect()
    assert (a.auction_id, a.call_id, a.kind, a.place, a.place_key, a.date, a.info, a.currency) == (12, None, "segunda_convocatoria", "Alto Selva Alegre", "ALTO SELVA ALEGRE", "2026-02-05", None, "PEN")
    assert (b.auction_id, b.call_id, b.kind, b.kind_raw, b.place_key, b.date, b.info, b.currency, b.amount) == (None, 4, "remate_simple", "1", "ANCASH", "2026-03-01", "i", None, None)
    assert (c.kind, c.place, c.date, c.amount) == ("desconocido", None, None, None)
    assert [r.call_id for r in views.slides_of(out, " áncash ").collect()] == [4]
    assert views.slides_of(out, " ").count() == views.slides_of(out, None).count() == 3


def test_placeholder_groups_go(spark):
    g = spark.createDataFrame([("https://x/groups/REEMPLAZAR",), ("https://x/groups/1",), (None,)], "url string")
    assert [r.url for r in views.without_placeholders(g).collect()] == ["https://x/groups/1", None]


def test_report_has_four_findings_at_least(spark):
    schema = "id string, runs long, last_run long, last_status string, latitude string, longitude string, registry array<struct<charges:array<struct<active:string>>>>, alerts array<struct<severity:string,kind:string,status:string>>, comparables long, prices long, results long, zones long, judicial long"
    full = ("f", 2, 2, "completed", "-16.4", "-71.5", [([("si",), ("no",)],), (None,), ([("si",)],)], [("high", "precio", "active"), ("low", "area", "closed"), ("low", "area", "active")], 3, 0, 5, 1, 1)
    out = views.report(spark.createDataFrame([full, ("e",) + (None,) * 12, ("z", 0, None, None, "", "1", [], [("low", "area", "active")], 0, 0, 0, 2, 1)], schema), "id")
    got = {k: [(r.label, r.value, r.kind) for r in sorted(out.filter(F.col("id") == k).collect(), key=lambda r: r.position)] for k in "fez"}
    assert got["f"] == [
        ("Investigaciones", "2 ejecución(es) · última 2 (completed)", "fact"), ("Coordenadas", "-16.4, -71.5", "fact"), ("Registro (SUNARP)", "3 partida(s) capturada(s) · 2 carga(s) activa(s)", "requiere_verificacion"),
        ("Alertas", "2 alerta(s) activa(s): high precio, low area", "requiere_verificacion"), ("Evidencias", "5 resultado(s) de investigación capturado(s)", "fact"), ("Mercado", "3 comparable(s) · 0 precio(s) estimado(s)", "fact"), ("Infraestructura", "Sección PLANNED (sin fuentes conectadas)", "unavailable"),
    ]
    assert [x[0] for x in got["e"]] == ["Investigaciones", "Registro (SUNARP)", "Evidencias", "Urbanismo", "Judicial", "Infraestructura"]
    assert [(x[0], x[2]) for x in got["z"]] == [("Investigaciones", "fact"), ("Registro (SUNARP)", "unavailable"), ("Alertas", "signal"), ("Evidencias", "fact"), ("Infraestructura", "unavailable")]


def test_compare_and_set(spark):
    tasks = spark.createDataFrame([("a", "pending"), ("b", "pending"), ("c", "completed"), ("d", "failed"), ("e", None)], "id string, status string")
    changes = spark.createDataFrame([("a", 2, "pending", "failed"), ("a", 1, "pending", "running"), ("b", 1, "running", "completed"), ("c", 1, "completed", "running"), ("e", 1, "pending", "running"), ("none", 1, "pending", "running")], "id string, ordinal int, expected string, target string")
    got = {r.id: (r.status, r.applied) for r in research.compare_and_set(tasks, changes, "id", "status", research.TASK_EDGES).collect()}
    assert got == {"a": ("running", True), "b": ("pending", False), "c": ("completed", False), "d": ("failed", None), "e": (None, False)}


def test_requests_reuse_the_live_action(spark):
    actions = spark.createDataFrame([("a", "login", "requested", 1), ("b", "login", "cancelled", 2)], "task string, action_kind string, status string, id int")
    requests = spark.createDataFrame([("a", "login", 3), ("b", None, 5), ("b", "login", 4), ("c", None, 6)], "task string, action_kind string, id int")
    got = sorted((r.task, r.id, r.action_kind, r.status, r.created) for r in research.request_actions(actions, requests, "task", "id").collect())
    assert got == [("a", 1, "login", "requested", False), ("b", 2, "login", "cancelled", False), ("b", 4, "login", "requested", True), ("c", 6, "user_action", "requested", True)]
    none = research.request_actions(actions.limit(0), requests.limit(0), "task", "id")
    assert none.count() == 0


def test_geolocation_marks_move_only_live_tasks(spark):
    tasks = spark.createDataFrame([("p", 1, "geolocation", "pending"), ("p", 2, "geolocation", "completed"), ("p", 3, "market", "pending"), ("q", 4, "geolocation", "running"), ("r", 5, "geolocation", "pending")], "owner string, id int, task_type string, status string")
    marks = spark.createDataFrame([("p", 2, "failed", "late"), ("p", 1, "completed", "x"), ("q", 1, "requires_manual_action", "no place")], "owner string, ordinal int, mark string, error string")
    got = {r.id: (r.status, r.moved, r.error, r.needs_action) for r in research.mark_geolocation(tasks, marks, "owner").collect()}
    assert got == {1: ("completed", True, None, False), 2: ("completed", False, None, False), 3: ("pending", False, None, False), 4: ("requires_manual_action", True, "no place", True), 5: ("pending", False, None, False)}


def test_queues_without_a_report(spark):
    queues = spark.createDataFrame([("a",), ("b",)], "queue string")
    jobs = spark.createDataFrame([("a", "waiting"), ("a", "failed"), ("a", "waiting")], "queue string, state string")
    depth = records.queue_depth(jobs, queues, "queue", "state", ["waiting", "failed"])
    assert sorted((r.queue, r.waiting, r.failed) for r in depth.collect()) == [("a", 2, 1), ("b", None, None)]
    assert records.connected(depth, ["waiting", "failed"]).first()[0] is True
    assert records.connected(depth.filter("queue = 'b'"), ["waiting", "failed"]).first()[0] is False


def test_external_ids_resolve_on_the_way(spark):
    keys = "source string, external string"
    captured = spark.createDataFrame([("s", "1", "h", 1), ("s", "2", "h", 2), ("s", "3", "g", 3), ("s", "4", "k", 4)], keys + ", digest string, ordinal int")
    existing = spark.createDataFrame([("s", "3", "g", "P3"), ("s", "9", "k", "P9")], keys + ", digest string, property string")
    wanted = spark.createDataFrame([("s", "2"), ("s", "2"), ("s", "3"), ("s", "4"), ("s", "none")], keys)
    got = {r.external: r.property for r in resolve.resolve_external(wanted, captured, existing, "source", "external", "digest", "ordinal").collect()}
    assert got == {"2": "s:2", "3": "P3", "4": "P9"}


def test_first_of_each_new_key_is_inserted(spark):
    table = spark.createDataFrame([("a", 1)], "id string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "id string, v int")
    assert sorted((r.id, r.v, r.inserted) for r in resolve.insert_or_ignore(table, new, ["id"], [F.col("v")]).collect()) == [("a", 1, False), ("b", 2, True)]


def test_lookups_and_prefixes(spark):
    rows = spark.createDataFrame([("av-1",), ("av",), ("avx",), ("b-1",)], "id string")
    assert sorted(r.id for r in readers.by_prefix(rows, "av").collect()) == ["av-1", "avx"]
    assert readers.by_id(rows, "id", "b-1").count() == 1 and readers.by_id(rows, "id", "c").isEmpty()


def test_links_and_provenance(spark):
    r = spark.range(1).select(text.csv_field(F.lit("a\r\nb\n\nc\td")).alias("blank"), text.csv_field(F.lit('x,"y"')).alias("quoted"), text.csv_field(F.lit(None)).alias("none")).first()
    assert (r.blank, r.quoted, r.none) == ("a b  c d", '"x,""y"""', "")


def parts(path: str) -> str:
    return "".join(open(p, encoding="utf-8", newline="").read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_export_is_one_file_when_its_parts_are_put_together(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a,b", 5.0), ("2", None, None), ("3", "x\ny", 7.5)], "id_publicacion string, titulo string, precio double").coalesce(1)
    sinks.write_csv(rows, str(tmp_path / "csv"))
    lines = parts(str(tmp_path / "csv")).split("\r\n")
    assert lines[0] == "\ufeff" + ",".join(sinks.LISTING_COLUMNS) and len(sinks.LISTING_COLUMNS) == 20
    assert lines[1:] == ['1,,,,,,,"a,b",,,,,5.0,,,,,,,', "2" + "," * 19, "3,,,,,,,x y,,,,,7.5,,,,,,,", ""]


def test_log_gets_its_header_once(spark, tmp_path):
    cycle = lambda n: spark.createDataFrame([("s", "e", 26, n, "ok, all")], "inicio string, fin string, busquedas int, nuevos int, estado string")
    sinks.append_log(cycle(1), str(tmp_path / "log"), first=True)
    sinks.append_log(cycle(2), str(tmp_path / "log"), first=False)
    lines = sorted(parts(str(tmp_path / "log")).split("\r\n"))
    assert lines == sorted(["", "\ufeffinicio,fin,busquedas,nuevos,estado", 's,e,26,1,"ok, all"', 's,e,26,2,"ok, all"'])
