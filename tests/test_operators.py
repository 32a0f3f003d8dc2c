"""Operators whose order or state SQL does not show, against sequential models; readers and sinks on small rows."""

import json

from pyspark.sql import functions as F

from catastra.functions import text
from catastra.operators import html, linkage, records, research, resolve
from catastra.operators import search as listing
from catastra.sources import readers


def test_tolerant_scan_takes_the_last_of_each_id(spark):
    rows = [("1", json.dumps({"id_publicacion": "a", "titulo": "x"}), "1"), ("2", json.dumps({"id_publicacion": "a", "titulo": "y"}), "2"), ("3", "no json", "3"), ("4", json.dumps({"titulo": "z"}), "4")]
    bronze = spark.createDataFrame(rows, "id string, data string, seen_at string")
    assert [(r.id_publicacion, r.titulo) for r in readers.tolerant(bronze).collect()] == [("a", "y")]
    assert readers.by_link(spark.createDataFrame([("b", '{"url":"u"}', "1"), ("a", '{"url_publicacion":"u"}', "1")], "id string, data string, seen_at string"), "u").first().id == "a"


def test_registry_isolates_a_source_that_fails(spark):
    r = readers.default_registry()
    r.register(readers.Source("bad", "available", lambda s, p: 1 / 0))
    r.register(readers.Source("good", "available", lambda s, p: s.createDataFrame([("good", "1", "t", None)], readers.SOURCE_ITEM)))
    assert [x.id for x in r.search(spark, {}).collect()] == ["1"]
    assert r.statuses(spark).filter("status = 'requires_auth'").count() == 2


def test_default_only_where_there_is_nothing(spark):
    d, none = spark.createDataFrame([("d",)], "x string"), spark.createDataFrame([], "x string")
    assert [r.x for r in readers.with_default(none, d).collect()] == ["d"]
    assert [r.x for r in readers.with_default(spark.createDataFrame([("r",)], "x string"), d).collect()] == ["r"]


def test_keys_and_attachments(spark):
    keys = spark.createDataFrame([("a/b",), ("/a",), ("a/../b",), ("..",), ("",)], "k string")
    assert [r.ok for r in keys.select(readers.key_is_safe(F.col("k")).alias("ok")).collect()] == [True, False, False, False, False]
    a = spark.createDataFrame([("aGk=",), ("",), ("***",)], "k string").select(readers.attachment(F.col("k")).alias("a")).collect()
    assert [x.a.ok for x in a] == [True, False, False]


def test_search_keeps_rows_without_a_date_in_a_window_but_not_in_last_days(spark):
    rows = spark.createDataFrame([("1", "cayma", "2026-01-10", None, "lote"), ("2", "Yura", None, None, "casa"), ("3", "CAYMA", "2025-01-01", None, "casa")], "id string, distrito string, fecha_busqueda string, fecha_publicacion string, tipo string")
    ids = lambda q: sorted(r.id for r in listing.search(rows, q).collect())
    assert ids(listing.Search("2026-01-11", days=7)) == ["1", "2"]
    assert ids(listing.Search("2026-01-11", last_days=7)) == ["1"]
    assert ids(listing.Search("2026-01-11", districts=["Cayma"])) == ["1", "3"]
    assert ids(listing.Search("2026-01-11", words="CASA")) == ["2", "3"]
    assert ids(listing.Search("2026-01-11", day="2025-01-01")) == ["3"]


def model_merge(rows):
    at, unique, out = {}, [], []
    for r in rows:
        keys = [f"r{r[1]}"] * (r[1] is not None) + [f"c{r[2]}"] * (r[2] is not None) or [f"h{r[3]}"]
        i = next((at[k] for k in keys if k in at), None)
        if i is None:
            i = r[0]
            unique.append(i)
        for k in keys:
            at[k] = i
        out.append((r[0], i))
    return out


def test_aliases_bridged_later_stay_apart(spark):
    rows = [(0, 1, None, "x", ""), (1, None, 2, "y", "b"), (2, 1, 2, "z", "c"), (3, None, 2, "w", "d"), (4, None, None, "h", "e"), (5, None, None, "h", "")]
    df = spark.createDataFrame(rows, "ordinal long, remate_id long, convocatoria_id long, content string, info string").withColumn("component", F.when(F.col("ordinal") < 4, 1).otherwise(2))
    got = {(r.ordinal, r.entry): r.info for r in resolve.merge_aliases(df, "component").collect()}
    assert sorted(got) == model_merge(rows)
    assert got[(0, 0)] == "c"


def test_components_of_aliases(spark):
    chain = [(i, i // 2, 100 + (i + 1) // 2, f"c{i}", "") for i in range(12)]
    rows = [*chain, (20, None, None, "same", "a"), (21, None, None, "same", "b"), (22, None, None, "other", ""), (23, 50, None, "c1", ""), (24, None, 50, "c2", "")]
    df = spark.createDataFrame(rows, "ordinal long, remate_id long, convocatoria_id long, content string, info string")
    found = resolve.alias_components(df)
    assert {r.ordinal: r.component for r in found.collect()} == {**dict.fromkeys(range(12), 0), 20: 20, 21: 20, 22: 22, 23: 23, 24: 24}
    assert sorted((r.ordinal, r.entry) for r in resolve.merge_aliases(found, "component").collect()) == model_merge(rows)


def test_backfill(spark):
    base = "https://f.com/groups/9"
    stored = [("9_a", f"{base}", "Terreno amplio en Yura", ""), ("9_b", None, "Casa grande", "vendo casa grande cerca del parque"), ("9_c", f"{base}/posts/5", "Lote", ""), ("8_d", None, "Terreno amplio en Yura", ""), ("9_e", f"{base}/posts/6", "x", "")]
    cards = [(1, "9_a", f"{base}/posts/1", "otra cosa"), (2, "k2", f"{base}/posts/2", "casa grande cerca del parque"), (3, "k3", f"{base}/posts/5", "nada igual"), (4, "k4", "#", "Casa grande"), (5, "9_e", f"{base}/posts/7", "x"), (6, "k6", f"{base}/posts/8", "casa grande cerca del parque")]
    out = linkage.backfill(spark.createDataFrame(cards, "ordinal int, key string, href string, text string"), spark.createDataFrame(stored, "id string, url string, title string, description string"), "9")
    assert sorted((r.ordinal, r.action, r.id) for r in out.collect()) == [(1, "linked_key", "9_a"), (2, "linked_text", "9_b"), (3, "deleted", "9_c")]


def test_details_of_sources_without_rows(spark):
    r = readers.default_registry()
    wanted = spark.createDataFrame([("sunarp", "1")], "source string, id string")
    assert len(r.sources) == 14 and r.has("cej") and r.get("x") is None
    assert [x.found for x in readers.details(r.search(spark, {}), wanted).collect()] == [False]


def test_greedy_uses_each_match_once(spark):
    pairs = spark.createDataFrame([(1, 1, 7, 0.9), (1, 2, 7, 0.95), (1, 2, 8, 0.3), (1, 3, 8, 0.1)], "g int, l int, r int, ratio double")
    assert sorted((x.l, x.r) for x in linkage.greedy(pairs, "g", "l", "r", "ratio").collect()) == [(1, 7), (2, 8)]


def test_stale_links_and_promotion(spark):
    t = spark.createDataFrame([("a", "https://f.com/groups/1"), ("b", "https://f.com/groups/1/posts/9")], "k string, url string")
    n = spark.createDataFrame([("a", "https://f.com/groups/1/posts/5"), ("b", "https://f.com/groups/1/posts/6")], "k string, url string")
    assert sorted((r.k, r.url, r.promoted) for r in resolve.promote_links(t, n, "k", "url", text.is_permalink).collect()) == [("a", "https://f.com/groups/1/posts/5", True), ("b", "https://f.com/groups/1/posts/9", False)]


def test_panels(spark):
    page = """<ul><li class="ui-galleria-panel x"><span class="text-bold"> Remate Simple </span><i class="fa fa-map-marker"></i> CAYMA
<div class="fecha"><i class="c"></i> 27/09/2026</div><div class="info">Último  día de inscripción</div><a onclick="f({pa:[{name:&quot;convocatoria&quot;,value:&quot;12&quot;},{name:&quot;remate&quot;,value:&quot;34&quot;}]})"></a></li>
<li class="ui-galleria-panel"><span class="text-bold">Otro</span></li></ul>"""
    slides = html.auction_panels(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html")
    a, b = slides.orderBy("panel").collect()
    assert (a.convocatoria, a.remate, a.tipoLabel, a.ubicacion, a.fechaISO, a.esUltimoDiaInscripcion) == ("12", "34", "Remate Simple", "CAYMA", "2026-09-27", True)
    assert (b.remate, b.tipoLabel, b.fecha, b.esUltimoDiaInscripcion) == (None, "Otro", None, False)
    assert [(r.id, r.title) for r in html.slide_items(slides).collect()] == [("34", "Remate Simple · CAYMA · 27/09/2026")]


def test_nearby_text_of_first_place(spark):
    rows = spark.createDataFrame([(1, 'xx "id":"1234567890" hello "id":"1234567890" bye')], "k int, t string")
    r = html.nearby(rows, "k", "t", '"id":"(\\d{10,})"', 20).first()
    assert r.id == "1234567890" and r.position == 10 and "hello" in r.near


def test_nearby_text_is_that_of_the_match(spark):
    t = "see 1234567890 first " + "x" * 100 + ' "id":"1234567890" here'
    r = html.nearby(spark.createDataFrame([(1, t)], "k int, t string"), "k", "t", '"id":"(\\d{10,})"', 30).first()
    assert r.position == t.index('"id"') + 7 and "here" in r.near and "see" not in r.near


def test_places_near_the_poles_and_the_date_line(spark):
    at = [(1, 70.0, 10.0), (2, 70.0, 10.045), (3, 89.999, 0.0), (4, 89.999, 180.0), (5, 10.0, 179.995), (6, 10.0, -179.995), (7, -70.0, 10.0)]
    df = spark.createDataFrame(at, "k int, lat double, lon double")
    assert {(r.id, r.other) for r in linkage.nearest(df, df, "k", 2000.0, 5).collect()} == {(1, 2), (2, 1), (3, 4), (4, 3), (5, 6), (6, 5)}


def test_registry_labels(spark):
    rows = spark.createDataFrame([("a", "si", 10.0, "PEN", "2020-01-01"), ("a", "no", 5.0, "PEN", None), ("b", "no", 1.0, "USD", None)], "o string, act string, m double, c string, d string")
    out = {r.o: (r.state, r.debt_pen, r.last_date) for r in records.registry_state(rows, "o", F.col("act") == "si", F.col("act") == "no", F.col("m"), F.col("c"), F.col("d"), ["PEN", "USD"]).collect()}
    assert out == {"a": ("cargado", 10.0, "2020-01-01"), "b": ("sano", 0.0, None)}
