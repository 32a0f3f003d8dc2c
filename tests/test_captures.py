"""Golden values for captured cards, links, posters and registry documents."""

import json

import pytest
from pyspark.sql import functions as F

from catastra.functions import captures
from catastra.plans import readings
from tests.test_text import one


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (captures.card_parts, "Terreno en Cayma, S/ 35, Arequipa, AR, publicación 99", ("Terreno en Cayma, S/ 35", "Arequipa", "AR")),
        (captures.card_parts, "Lote, S/ 900", ("Lote", "S/ 900", "")),
        (captures.card_parts, "Lote, Arequipa", ("Lote", "", "Arequipa")),
        (captures.card_parts, "solo titulo", ("solo titulo", "", "")),
        (lambda c: captures.post_link(c, F.lit("7")), "/groups/1/posts/22?x=1", ("22", "https://www.facebook.com/groups/1/posts/22")),
        (lambda c: captures.post_link(c, F.lit("7")), "https://f.com/x?story_fbid=33", ("33", "https://www.facebook.com/groups/7/posts/33")),
        (lambda c: captures.post_link(c, F.lit("7")), "https://f.com/photo?fbid=1&set=gm.44", ("44", "https://www.facebook.com/groups/7/posts/44")),
        (lambda c: captures.post_link(c, F.lit("7")), "https://f.com/share/v/Ab1", ("Ab1", "https://www.facebook.com/share/p/Ab1")),
        (lambda c: captures.post_link(c, F.lit("7")), "#", None),
        (captures.post_from_attribute, '{"story_fbid":"5","top_level_post_id":9}', "9"),
        (captures.post_from_attribute, '{"story_fbid":"5"}', "5"),
        (captures.post_from_markup, '<a data="{"stableID":"1234567890"}">', "1234567890"),
        (captures.search_words, "Vendo terreno grande en Cayma, precio 100 soles, zona plana", "terreno grande Cayma zona"),
        (captures.known_district, "Urb. X, Cerro Colorado", "Cerro Colorado"),
        (captures.known_district, " La joya ", "la Joya"),
        (captures.known_district, "Lima", "Lima"),
        (captures.in_region, "Yura alta", True),
        (captures.in_region, "mayura", False),
    ],
)
def test_shapes(spark, f, given, wanted):
    got = one(spark, f, given)
    assert (tuple(got) if isinstance(wanted, tuple) else got) == wanted


def test_poster(spark):
    p = one(spark, captures.poster, "VENDO 450 m2 S/. 35,000.00 o $ 95,000 llamar 987 654 321 / S/ 35")
    assert p.phones == ["987654321"] and p.m2 == 450
    assert [(x.price, x.currency) for x in p.prices] == [(35000.0, "PEN"), (95000.0, "USD")]


def test_poster_fills_and_corrects_a_card(spark):
    cards = spark.createDataFrame([("9_1", "https://f.com/groups/9/posts/1", "lote bonito en Yura hace 2 horas", "", "img", "Lote en Cayma", "S/ 35", "", "S/ 40,000 300 m2 999888777"), ("5", "https://f.com/x", "sin datos", None, None, "Facebook", None, None, None)], "key string, href string, text string, label string, image_url string, raw_title string, raw_price string, raw_location string, ocr string")
    a, b = captures.listings(cards, "2026-01-02 03:04:05").orderBy("id_publicacion").collect()[::-1]
    assert (a.distrito, a.distrito_origen, a.precio, a.moneda, a.m2, a.telefono, a.tipo, a.fuente, a.link_status) == ("Cayma", "title", 40000.0, "PEN", 300, "999888777", "lote", "grupo", "permalink")
    assert (a.fecha_publicacion, a.fecha_busqueda, a.hora_busqueda) == ("hace 2 horas", "2026-01-02", "03:04:05")
    assert (b.titulo, b.fecha_publicacion, b.fuente, b.precio) == ("sin datos", "hoy", "marketplace", None)


def test_repairs(spark):
    rows = spark.createDataFrame([("1_987654321", "Lote en Majes", "sin telefono", "Cayma", "987654321"), ("2_1", "Lote", "llamar 912345678", "Yura", "912345678")], "id_publicacion string, titulo string, descripcion string, distrito string, telefono string")
    got = {r.id_publicacion: (r.telefono, r.distrito, r.phone_fixed, r.district_fixed) for r in captures.repaired(rows).collect()}
    assert got == {"1_987654321": ("", "Majes", True, True), "2_1": ("912345678", "Yura", False, False)}


def test_group_links(spark):
    rows = spark.createDataFrame([("8_1", "Terreno plano grande", "", "", "", "grupo", ""), ("8_2", "x", "", "https://f.com/groups/8/posts/2", "", "grupo", ""), ("3", "x", "", "https://f.com/y", "", "marketplace", "old")], "id_publicacion string, titulo string, descripcion string, url_publicacion string, url string, fuente string, link_status string")
    got = {r.id_publicacion: (r.url, r.link_status, r.fixed) for r in captures.group_links(rows).collect()}
    assert got == {"8_1": ("https://www.facebook.com/groups/8/search/?q=Terreno%20plano%20grande", "search", True), "8_2": ("https://f.com/groups/8/posts/2", "permalink", False), "3": ("https://f.com/y", "old", False)}


def test_intake(spark):
    owner = {"titular": "JOSE  LUIS s.a.c.", "tipoDocumento": "DNI", "numeroDocumento": "1", "porcentaje": "0.5"}
    rows = [
        ("P1", "Cayma", "Urb. A", "Calle B", None, "12", "3", None, "-16.4", "-71.5", "partida", "1,234.5", None, json.dumps(owner), json.dumps([{"tipo": "hipoteca", "monto": "S/ 1.000,50", "vigente": "SI"}, {"nada": "x"}]), "[]"),
        (None, None, None, None, None, None, None, None, "99", "1", None, None, None, None, None, None),
    ]
    names = ["partida", "distrito", "urb", "calle", "avenida", "numero", "lote", "referencia", "latitude", "longitude", "origen", "debt", "url", "propietarios", "cargas", "titulos"]
    plan = captures.intake_plan(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)))
    a, b = plan.orderBy(F.col("partida").isNull()).collect()
    assert (a.number, a.address, a.amount, a.confidence, a.needs_geocoding, a.warnings) == ("P-00000001", "Urb. A, Calle B, 12, Lote 3, Cayma", 1234.5, "high", False, ["no_titles"])
    assert [(o.name, o.document_type, o.percentage) for o in a.owners] == [("Jose Luis S.A.C.", "DNI", 50.0)]
    assert [(c.type, c.amount, c.active) for c in a.charges] == [("hipoteca", 1000.5, "si")]
    assert b.warnings == ["no_registry_number", "no_district", "half_a_place"] and not b.has_registry_row and not b.needs_geocoding
    assert captures.exploded(plan, "number", "owners").count() == 1


def test_small_ones(spark):
    d = spark.createDataFrame([("Cayma", None), (None, "Calle 1"), (None, None)], "d string, a string")
    assert [r.q for r in d.select(captures.geocoding_query(F.col("d"), F.col("a")).alias("q")).collect()] == ["Cayma, Arequipa, Perú", "Calle 1, Arequipa, Perú", ""]
    p = spark.createDataFrame([({"town": "Yura", "county": "X"},), ({"city": "", "village": "V"},)], "m map<string,string>")
    assert [r.q for r in p.select(captures.place_district(F.col("m")).alias("q")).collect()] == ["Yura", "V"]
    actions = spark.createDataFrame([("requested",), ("completed",)], "status string")
    assert [captures.action_filter(actions, s).count() for s in ("requested", "all", "nope", None)] == [1, 2, 2, 2]


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ("see https://www.facebook.com/groups/8/posts/11 and /groups/7/permalink/22/", "https://www.facebook.com/groups/7/posts/22"),
        ("/groups/8/posts/11?story_fbid=33", "https://www.facebook.com/groups/7/posts/33"),
        ("/photo?fbid=1&set=gm.44", "https://www.facebook.com/groups/7/posts/44"),
        ("/groups/8/posts/11", "https://www.facebook.com/groups/7/posts/11"),
        ("text https://www.facebook.com/share/v/AbC1/ more", "https://www.facebook.com/share/v/AbC1"),
        ("nothing", None),
        (None, None),
    ],
)
def test_post_urls(spark, raw, wanted):
    df = spark.createDataFrame([(raw, "7")], "raw string, gid string")
    assert df.select(captures.post_url(F.col("raw"), F.col("gid")).alias("u")).first().u == wanted


def test_provenance_fills_blanks(spark):
    df = spark.sql("select cast(null as string) as source, 'u' as url, timestamp'2024-01-01' as at")
    p = df.select(captures.provenance(F.col("source"), F.col("url"), F.col("at"), verification="verified").alias("p")).first().p
    assert (p.source, p.source_url, p.confidence, p.verification, p.parser_version) == ("manual", "u", "medium", "verified", "v1") and p.retrieved_at is not None


def test_tables_without_a_filter(spark, tmp_path):
    from catastra.sources import readers

    for n in ("a", "b"):
        spark.range(3).write.parquet(str(tmp_path / f"{n}.parquet"))
    assert [df.count() for df in readers.whole(spark, str(tmp_path), "a", "b")] == [3, 3]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_of_a_link_are_sought_once(spark):
    """a link's struct is used twice, its patterns are not."""
    p = captures.post_link(F.col("raw"), F.lit("7"))
    shown = plan(spark.range(1).select(F.col("id").cast("string").alias("raw")).withColumn("p", p).select("p.post", "p.url"))
    assert [shown.count(x) for x in ("[?&]story_fbid", "multi_permalinks=", "set=gm", "/share/[pvg]/")] == [1, 1, 1, 1]


def test_links_without_a_group(spark):
    df = spark.createDataFrame([("/x?story_fbid=3&y=/share/p/a", None), ("/share/p/a_b", None), (None, "7"), ("#", "7")], "raw string, gid string")
    got = df.select(captures.post_link(F.col("raw"), F.col("gid")).alias("p"), captures.post_url(F.col("raw"), F.col("gid")).alias("u")).collect()
    assert [(r.p and r.p.post, r.u) for r in got] == [(None, None), ("a_b", None), (None, None), (None, None)]


def test_fields_of_an_owner_are_sought_once(spark):
    """a field that says several things about an owner is looked up once."""
    items = F.array(F.create_map(F.lit("titular"), F.col("id").cast("string")))
    shown = plan(spark.range(1).select(items.alias("items")).select(captures.owners(F.col("items")).alias("o")))
    assert [shown.count(x) for x in ("porcentaje", "fechaInscripcion", "tipoDocumento")] == [1, 1, 1]


def test_slides_are_read_once(spark):
    """the three uses of the slides share what was read of the pages."""
    assert not [f for f in readings.carousel_slides(spark, "/root/testdata/sf0.001").inputFiles() if "orders" in f]
    day = captures.text.date_iso(F.col("d"))
    df = spark.createDataFrame([(" 05/11/2024\n",), ("2024-13-40",), ("32/01/2024",), ("01/13/2024",), ("1/1/2024",), (None,)], "d string")
    assert [r.x for r in df.select(day.alias("x")).collect()] == ["2024-11-05", "2024-13-40", None, None, None, None]
    assert plan(spark.range(1).select(F.col("id").cast("string").alias("d")).select(day.alias("x"))).count("regexp_extract") == 1


def test_a_key_reads_the_start_of_a_text(spark):
    """only 400 characters are taken apart; letters whose small form hangs on the next one, and marks among blanks, give the same key as before."""
    whole = lambda b: F.lower(captures.folded(b))
    rows = [("ΟΔΟΣ " * 90,), ("a" * 399 + "Σ b",), ("a" * 399 + "Σ\ufeffb",), ("a" * 398 + "\u00a0 \ufeffΣb",), ("\u2003" * 500 + "x y" * 300,), ("İ" * 300,)]
    df = spark.createDataFrame(rows, "b string")
    same = captures.synthetic_key(F.col("b"), F.lit("")) == F.concat(F.lit("p_"), F.lower(F.conv(F.abs(captures.hash32(F.concat(F.slice(captures.utf16(whole(F.col("b"))), 1, 400), captures.utf16(F.concat(F.lit("|"), (F.octet_length(F.encode("b", "UTF-16BE")) / 2).cast("long").cast("string"), F.lit("|")))))).cast("string"), 10, 36)))
    assert [r.s for r in df.select(same.alias("s")).collect()] == [True] * len(rows)
    assert "hex(encode(lower" not in plan(spark.range(1).select(captures.synthetic_key(F.col("id").cast("string"), F.lit("")).alias("k")))
