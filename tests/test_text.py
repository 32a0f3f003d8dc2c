"""Golden values of the scalar functions; each of its own making."""

import pytest
from pyspark.sql import functions as F

from catastra.functions import rules, text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (text.clean_number, "1,234.5", 1234.5),
        (text.clean_number, "1,5", 15.0),
        (text.clean_number, "1.234", 1234.0),
        (text.clean_number, "12.5", 12.5),
        (text.clean_number, " 85 000 ", 85000.0),
        (text.clean_number, "", None),
        (text.area_m2, "terreno de 200 m2", 200),
        (text.area_m2, "area 1,500 metros cuadrados", 1500),
        (text.area_m2, "sin area", None),
        (text.date_iso, "31/02/2026", "2026-02-31"),
        (text.date_iso, "32/01/2026", None),
        (text.date_iso, "1/2/2026", None),
        (text.date_iso, " 2026-03-04 ", "2026-03-04"),
        (text.amount_pen, "S/ 1,234.56", 1234.56),
        (text.amount_pen, "S/. 900", 900.0),
        (text.amount_pen, "US$ 100", None),
        (text.area_last_separator, "380 m2", 380.0),
        (text.area_last_separator, "1,234", 1.234),
        (text.number_commas_thousands, "1,234", 1234.0),
        (text.title_case, "jose LUIS torres", "Jose Luis Torres"),
        (text.title_case_acronyms, "inmobiliaria s.a.c.", "Inmobiliaria S.A.C."),
        (text.strip_accents, "Camaná Ñuñoa", "Camana Nunoa"),
        (text.strip_accents, "ā ő e\u0301 ẫ ø", "a o e a ø"),
        (text.link_number, "p-12 345.6", "P123456"),
        (text.document_type, "Carnet de extranjería", "CE"),
        (text.owner_type, "persona jurídica", "persona_juridica"),
        (text.charge_type, "Anotación de demanda", "anotacion_demanda"),
        (text.is_active, "vigente", "si"),
        (text.is_active, "levantado", "no"),
        (text.ownership_percentage, "0.5", 50.0),
        (text.ownership_percentage, "50%", 50.0),
        (text.ownership_percentage, "0.5%", 0.5),
        (text.ownership_percentage, "101", None),
        (text.relative_date, "publicado hace  3   horas", "hace 3 horas"),
        (text.relative_date, "5 min", "5 min"),
        (text.first_line, "corta\n  una linea larga \notra linea", "una linea larga"),
        (text.link_status, "https://f.com/groups/1/posts/22", "permalink"),
        (text.link_status, "https://f.com/groups/1/search/?q=x", "search"),
        (text.link_status, "https://f.com/groups/1", "group_root"),
        (text.link_status, "#", ""),
        (text.link_status, "https://f.com/x", "direct"),
        (text.csv_field, 'a "b"', '"a ""b"""'),
        (text.csv_field, "a\nb", "a b"),
        (text.escape_html, "<a&b>", "&lt;a&amp;b&gt;"),
        (text.canonical_json, '{"b":1,"a":"1","c":null}', '{"a":"1","b":"1"}'),
        (text.is_uuid, "00000000-0000-4000-8000-00000000000A", True),
        (text.is_uuid, "x", False),
    ],
)
def test_scalar(spark, f, given, wanted):
    assert one(spark, f, given) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("llamar 987 654 321", ["987654321"]), ("987-654-321 / 912.345.678 987654321", ["987654321", "912345678"]), ("+51 987654321", ["987654321"]), ("https://x.pe/987654321", []), ("publicación 987654321", []), ("wa.me/51987654321", ["987654321"]), ("1987654321", [])],
)
def test_phones(spark, given, wanted):
    assert one(spark, text.phones, given) == wanted


@pytest.mark.parametrize(("given", "price", "currency"), [("S/ 120,000", 120000.0, "PEN"), ("precio US$ 35000", 35000.0, "USD"), ("vendo 45000", 45000.0, "(no indicado)"), ("vendo 450", None, "")])
def test_price(spark, given, price, currency):
    assert tuple(one(spark, text.parse_price, given)) == (price, currency)


@pytest.mark.parametrize(
    ("given", "ok", "number", "area"),
    [("P-12345678", True, "P-12345678", None), ("p 1234 5678", True, "P-12345678", None), ("11012345678", True, "P-12345678", "110"), ("P1", True, "P-00000001", None), ("", False, None, None), ("abc", False, None, None), ("123456789", False, None, None)],
)
def test_registry_number(spark, given, ok, number, area):
    r = one(spark, text.registry_number, given)
    assert (r.ok, r.number, r.area) == (ok, number, area)


def test_district_takes_title_before_poster_before_description(spark):
    rows = spark.createDataFrame([("lote en Cayma", "Yura", "en Majes", ""), ("lote", "Yura", "en Majes", ""), ("lote", "", "cerca a Yura, ubicado en Majes", ""), ("", "", "", "Sabandía"), ("", "", "", "Lima")], "t string, o string, d string, l string")
    got = [tuple(r.x) for r in rows.select(rules.district(F.col("t"), F.col("o"), F.col("d"), F.col("l")).alias("x")).collect()]
    assert got == [("Cayma", "title"), ("Yura", "ocr"), ("Majes", "description"), ("Sabandía", "location"), ("", "none")]


def test_edges_of_words_are_ascii(spark):
    assert one(spark, lambda c: rules.matches(c, r"caman[aá]\b"), "camaná") is False
    assert one(spark, lambda c: rules.matches(c, r"caman[aá]\b"), "Camana") is True


def test_relevance_rejects_first(spark):
    assert [one(spark, rules.is_relevant, t) for t in ("vendo terreno", "vendo terreno y celular", "hola")] == [True, False, False]


def test_types_in_order(spark):
    assert [one(spark, lambda c: rules.first_rule(c, rules.TYPES, "otro"), t) for t in ("lindo DÚPLEX en casa", "casa con terreno", "terreno", "moto")] == ["duplex", "casa", "terreno", "otro"]
