"""A pass over cases: what is done stays, what goes wrong is a row, a second pass changes nothing."""

from pyspark.sql import functions as F

from catastra.operators import orchestrate, research


def frames(spark):
    cases = spark.createDataFrame([("c1", "p1", "created"), ("c2", "gone", "queued"), ("c3", "p1", "completed"), ("c4", "p2", "running"), ("c5", "p1", "pending")], "case string, property string, status string")
    kinds = ["identity", "geolocation", "registry", "judicial", "market"]
    rows = [(f"{c}-{k}", c, k, "pending") for c in ("c1", "c2", "c3", "c4") for k in kinds] + [("c4-x", "c4", "identity", "failed"), ("c4-y", "c4", "odd kind", "running")]
    tasks = spark.createDataFrame(rows, "task string, case string, task_type string, status string")
    properties = spark.createDataFrame([("p1", "Cayma", None, False), ("p2", None, "", False)], "property string, district string, address string, verified boolean")
    places = spark.createDataFrame([("Cayma, Arequipa, Perú",), ("Cayma, Arequipa, Perú",)], "query string")
    sources = spark.createDataFrame([("sunarp", "available")], "source string, status string")
    auctions = spark.createDataFrame([("p1", 3, False)], "property string, entries int, certain boolean")
    return cases, tasks, properties, places, sources, auctions


def test_pass(spark):
    tasks, cases = orchestrate.orchestrate(*frames(spark))
    got = {r.task: (r.status, r.error, r.moved) for r in tasks.collect()}
    assert got["c1-identity"] == ("completed", None, True) and got["c1-geolocation"] == ("completed", None, True)
    assert got["c1-judicial"] == ("requires_manual_action", None, True) and got["c1-market"] == ("unavailable", orchestrate.STUB, True)
    assert got["c2-identity"] == ("failed", "Property gone not found for identity task", True) and got["c2-registry"][0] == "completed"
    assert all(got[f"c3-{k}"] == ("pending", None, False) for k in ("identity", "market"))
    assert got["c4-geolocation"] == ("requires_manual_action", orchestrate.NO_PLACE, True) and got["c4-judicial"] == ("requires_manual_action", orchestrate.NO_LOCALITY, True)
    assert got["c4-x"] == ("failed", None, False) and got["c4-y"] == ("unavailable", orchestrate.STUB, True)
    by = {r["case"]: r for r in cases.collect()}
    assert (by["c1"].status, by["c1"].total, by["c1"].warnings, by["c1"].summary) == ("completed", 5, 2, "Caso completado correctamente")
    assert (by["c2"].status, by["c2"].failed, by["c2"].summary) == ("partial", 3, "Caso con ejecución parcial: 3 tarea(s) con error")
    assert (by["c3"].status, by["c3"].total, by["c5"].status, by["c5"].total) == ("completed", None, "running", None)


def test_second_pass_and_own_queue(spark):
    cases, tasks, *rest = frames(spark)
    moved, settled = orchestrate.orchestrate(cases, tasks, *rest, skip_geolocation=True)
    left = {r.task for r in moved.filter("status = 'pending'").collect()}
    assert {"c1-geolocation", "c2-geolocation", "c4-geolocation"} <= left and all("geolocation" in t or t.startswith("c3") for t in left)
    assert {r["case"]: r.status for r in settled.collect()}["c1"] == "running"
    again, _ = orchestrate.orchestrate(settled.select("case", "property", "status"), moved.select(*tasks.columns), *rest, skip_geolocation=True)
    assert again.filter("moved").count() == 0 and again.select("task", "status").exceptAll(moved.select("task", "status")).count() == 0


def test_auctions_without_a_match_wait_for_a_person(spark):
    rows = [("Cayma", 0, False, "completed"), ("Cayma", None, None, "completed"), ("Cayma", 4, True, "completed"), ("Cayma", 4, False, "requires_manual_action"), ("", 4, True, "requires_manual_action"), (None, 0, False, "requires_manual_action")]
    df = spark.createDataFrame(rows, "place string, entries int, certain boolean, want string")
    assert df.filter(research.auction_outcome(F.col("place"), F.col("entries"), F.col("certain")) != F.col("want")).count() == 0


def test_alerts_and_caps(spark):
    listings = spark.createDataFrame([(1, "a", 500.0, 100.0), (2, "a", 100.0, 100.0), (3, "a", None, 1.0), (4, None, 10.0, 1.0), (5, "b", 0.0, 9.0)], "property int, district string, area double, price double")
    registry = spark.createDataFrame([(1, 380.0), (2, 105.0), (4, None), (5, 10.0)], "property int, area double")
    got = {(r.property, r.kind): round(r.value, 3) for r in orchestrate.alerts(listings, registry).collect()}
    assert got == {(1, "area"): 1.316, (1, "precio"): 0.333, (5, "area"): 0.0}
    rows = spark.createDataFrame([("s", i) for i in range(70)] + [("t", 1)], "search string, n int")
    out = orchestrate.capped(rows, ["search"], [F.asc("n")])
    assert out.count() == 61 and {(r.search, r.total) for r in out.collect()} == {("s", 70), ("t", 1)} and out.agg(F.max("n")).first()[0] == 59


def test_intakes(spark):
    import base64
    import json

    from catastra.operators import intake

    actions = spark.createDataFrame([("m1", "p1", "requested", "remaju", None), ("m2", "p2", "requested", "sunarp", "u"), ("m3", "p1", "completed", "x", None), ("m4", "p3", "requested", None, None)], "action string, property string, status string, source string, url string")
    owner = json.dumps([{"titular": "Ana"}, {"x": "y"}])
    names = ["partida", "distrito", "urb", "calle", "avenida", "numero", "lote", "referencia", "latitude", "longitude", "origen", "debt", "url", "propietarios", "cargas", "titulos"]
    pay = lambda action, n, pdf=None, **f: (action, n, *[f.get(c) for c in names], "a/b c.pdf", pdf)
    rows = [
        pay("m1", 1, base64.b64encode(b"pdf").decode(), partida="P1", distrito="Cayma", propietarios=owner, debt="1,000"), pay("m1", 2, partida="again"), pay("m2", 1, latitude="-16.4", longitude="-71.5", origen="partida", distrito="Yura", cargas=json.dumps({"tipo": "hipoteca"})),
        pay("m3", 1, partida="P3"), pay("m4", 1, "", partida="P4"), pay("m9", 1),
    ]
    payloads = spark.createDataFrame(rows, "action string, ordinal int, " + ", ".join(f"{n} string" for n in names) + ", pdf_name string, pdf string")
    t = intake.take_in(actions, payloads, spark.createDataFrame([("Cayma", 1.0, 2.0)], "query string, lat double, lon double"))
    assert {(r.action, r.ordinal): r.failure for r in t.failures.collect()} == {("m1", 2): "Manual action m1 already completed", ("m3", 1): "Manual action m3 already completed", ("m4", 1): "PDF vacío o base64 inválido", ("m9", 1): "Manual action m9 not found"}
    assert {r.registry_id: (r.property, r.number, r.source) for r in t.registry.collect()} == {"registry-m1": ("p1", "P-00000001", "remaju"), "registry-m2": ("p2", None, "sunarp")}
    assert [(r.registry_id, r.name) for r in t.owners.collect()] == [("registry-m1", "Ana")] and [r.type for r in t.charges.collect()] == ["hipoteca"] and t.titles.count() == 0
    assert {r.property: (r.lat, r.lon, r.source, r.confidence) for r in t.places.collect()} == {"p1": (1.0, 2.0, "manual-geocoded", "low"), "p2": (-16.4, -71.5, "manual", "high")}
    assert [(r.property, r.url) for r in t.links.collect()] == [("p1", "remates/p1/m1-b c.pdf")]
    done = {r.action: (r.status, r.result and (r.result.owners, r.result.debt, r.result.placed)) for r in t.actions.collect()}
    assert done == {"m1": ("completed", (1, 1000.0, True)), "m2": ("completed", (0, None, True)), "m3": ("completed", None), "m4": ("requested", None)}
