"""From captured cards, links, posters and registry documents to columns (C-13 to C-22, C-34 to C-36, C-40, C-44, C-45, P-06, P-10, P-12, P-13, F-15, F-18, F-20, F-21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catastra.functions import rules, text
from catastra.functions.text import BLANK_RANGES, blank_to_null, folded, strip_accents, trimmed

BASE = "https://www.facebook.com"
# Words that a search for a listing leaves out.
NOISE = r"(?iu)(?<![\p{L}\p{N}_])(publicaci[oó]n|facebook|precio|venta|vendo|remato|ocasi[oó]n|gratis|d[oó]lares|soles|informes|whatsapp|inmobiliaria)(?![\p{L}\p{N}_])"
# Districts of the region, as its portals write them.
REGION = ["alto selva alegre", "cayma", "cerro colorado", "characato", "chiguata", "jacobo hunter", "jose luis bustamante", "la joya", "mariano melgar", "miraflores", "mollebaya", "paucarpata", "pocsi", "polobaya", "quequeña", "sabandía", "sachaca", "san juan de siguas", "san juan de tarucani", "santa isabel de siguas", "santa rita de siguas", "socabaya", "tiabaya", "uchumayo", "vitor", "yanahuara", "yarabamba", "yura"]
# Districts that the geocoder knows; the first that the text holds counts.
GEOCODER = ["alto selva alegre", "cayma", "cerro colorado", "characato", "chiguata", "jacobo hunter", "josé luis bustamante y rivero", "jose luis bustamante y rivero", "bustamante y rivero", "la joya", "mariano melgar", "miraflores", "mollebaya", "paucarpata", "sabandía", "sachaca", "socabaya", "tiabaya", "uchumayo", "yanahuara", "yura", "camana", "camaná"]


def or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def without_brand(c: Column) -> Column:
    return folded(F.regexp_replace(or_blank(c), r"(?i)\b(?:Facebook\s*)+", " "))


# The patterns of labels, links, posts and posters in the functions from here to poster.
def without_suffixes(c: Column) -> Column:
    """The label less its publication number, price and place."""
    for p in (r"(?iu),\s*publicaci[oó]n\s*\d+", r"(?i),\s*(?:S/|\$|Gratis)[^,]+", r"(?i),\s*[^,]+,\s*AR$"):
        c = F.regexp_replace(c, p, "")
    return trimmed(c)


def clean_title(raw: Column, label: Column, body: Column) -> Column:
    """C-13: the title if it says something, else the label, else the body's first line that does."""
    title, named = without_brand(raw), without_suffixes(without_brand(label))
    line = text.first_line(F.regexp_replace(or_blank(body), r"(?i)\b(?:Facebook[ \t]*)+", " "))
    return F.when(F.length(title) > 5, title).when(F.length(named) > 5, named).otherwise(F.coalesce(blank_to_null(line), F.lit("Publicación en grupo")))


def card_parts(label: Column) -> Column:
    """C-45: struct(title, price, location) of a label whose parts stand between commas."""
    clean = trimmed(F.regexp_replace(or_blank(label), r"(?iu),\s*publicaci[oó]n\s*\d+", ""))
    parts = F.filter(F.transform(F.split(clean, ","), trimmed), lambda p: p != "")
    n = F.size(parts)
    at = lambda k: or_blank(F.try_element_at(parts, F.lit(k)))
    place = lambda c: c.rlike("(?i)AR$|Arequipa")
    full = (n >= 3) & (place(at(-1)) | at(-2).rlike(r"(?i)S/|\$|Gratis"))
    title = F.when(full, F.array_join(F.slice(parts, 1, F.greatest(n - 2, F.lit(0))), ", ")).when(n >= 2, at(1)).otherwise(clean)
    price = F.when(full, at(-2)).when((n == 2) & ~place(at(2)), at(2)).otherwise("")
    location = F.when(full, at(-1)).when((n == 2) & place(at(2)), at(2)).otherwise("")
    return F.struct(title.alias("title"), price.alias("price"), location.alias("location"))


def post_link(raw: Column, group: Column) -> Column:
    """C-15: struct(post, url) of a link in one of seven shapes, or null."""
    # what is blank or a mark has none of these; each pattern is looked for once
    got = lambda p, k=1: blank_to_null(F.regexp_extract(raw, p, k))
    of_group = r"/groups/([^/?#]+)/(?:posts|permalink|multi_permalink)/([\w.-]+)"
    asked = F.coalesce(got(r"[?&]story_fbid=(\d+)(?:&|#|$)"), got(r"[?&]multi_permalinks=(\d+)(?:&|#|$)"), got(r"/photo(?:\.php)?\?(?:[^#]*&)?set=gm\.(\d+)"))
    shared = F.concat(F.lit(f"{BASE}/share/p/"), got(r"/share/[pvg]/([A-Za-z0-9_-]+)"))
    mine = text.let(asked, lambda a: F.when(a.isNotNull(), F.concat(F.lit(f"{BASE}/groups/"), group, F.lit("/posts/"), a)).otherwise(shared))
    url = F.coalesce(F.concat(F.lit(f"{BASE}/groups/"), got(of_group, 1), F.lit("/posts/"), got(of_group, 2)), mine)
    # none of the posts has a slash
    return text.let(url, lambda u: F.when(u.isNotNull(), F.struct(F.substring_index(u, "/", -1).alias("post"), u.alias("url"))))


def post_url(raw: Column, group: Column) -> Column:
    """C-16: the best usable address in what was captured."""
    got = lambda p: blank_to_null(F.regexp_extract(or_blank(raw), p, 1))
    post = F.coalesce(got(r"[?&](?:story_fbid|multi_permalinks)=(\d+)"), got(r"[?&]set=gm\.(\d+)"), got(r"(?:posts|permalink|multi_permalink)/(\d+)"))
    mine = F.concat(F.lit(r"/groups/\Q"), group, F.lit(r"\E/(?:posts|permalink|multi_permalink)/(\d+)"))
    own = blank_to_null(F.call_function("regexp_extract", or_blank(raw), mine, F.lit(1)))
    post = F.coalesce(own, post)
    shared = got(r"(https?://www\.facebook\.com/share/[a-z]/[A-Za-z0-9]+)")
    return text.let(post, lambda p: F.when(p.isNotNull(), F.concat(F.lit(f"{BASE}/groups/"), group, F.lit("/posts/"), p)).otherwise(shared))


def post_from_attribute(data: Column) -> Column:
    """C-17: the post in a JSON attribute; the top level one first."""
    number = lambda k: F.when(F.get_json_object(data, f"$.{k}").rlike(r"^\d+$"), F.get_json_object(data, f"$.{k}"))
    return F.coalesce(*[number(k) for k in ("top_level_post_id", "mf_story_key", "story_fbid", "post_id")])


def post_from_markup(html: Column, most: int = 100_000) -> Column:
    """C-17: the post in a page's own data; pages over `most` characters are not read."""
    shapes = (r"""(?:story_fbid|top_level_post_id|stableID)["'\s]*[:=]["'\s]*"?(\d{10,})""", r"fb:/{0,3}post/(\d{10,})", r"/groups/\d+/(?:posts|permalink)/(\d{10,})", r"""(?:content_id|feedback_id|object_fbid)["']\s*:\s*["'](\d{10,})""", r"""mf_story_key["']\s*:\s*["']?(\d{10,})""")
    return F.when(F.length(html) <= most, F.coalesce(*[blank_to_null(F.regexp_extract(html, p, 1)) for p in shapes]))


def utf16(c: Column) -> Column:
    """The UTF-16 units of a text, as numbers. Without characters of two units these are the characters' own numbers."""
    coded = F.encode(c, "UTF-16BE")
    wide = F.transform(F.regexp_extract_all(F.hex(coded), F.lit("[0-9A-F]{4}"), F.lit(0)), lambda u: F.conv(u, 16, 10).cast("long"))
    plain = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.when(F.octet_length(coded) == F.length(c) * 2, plain).otherwise(wide)


def hash32(units: Column) -> Column:
    """31 h + unit over all units, wrapping at 32 bits, signed."""
    h = F.aggregate(units, F.lit(0).cast("long"), lambda h, u: (h * 31 + u).bitwiseAND(F.lit(0xFFFFFFFF)))
    return text.let(h, lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h))


def synthetic_key(body: Column, image: Column) -> Column:
    """C-18: a stable key for a card without one: the 32-bit hash, in base 36, of 400 units of its text in lower case with blanks folded, its length and its image."""
    length = F.octet_length(F.encode(or_blank(body), "UTF-16BE")) / 2
    # the first 400 units stand in the first 400 characters, and those in a stretch with one mark more; the whole is put in lower case, since a letter's may hang on the next
    low = F.lower(F.replace(or_blank(body), F.lit("\ufeff"), F.lit(" ")))
    head = F.regexp_extract(low, f"^[{BLANK_RANGES}]*+(?:[^{BLANK_RANGES}][{BLANK_RANGES}]*+){{0,401}}+", 0)
    start = text.let(F.substring(folded(head), 1, 400), utf16)
    units = F.concat(F.slice(start, 1, 400), text.let(F.concat(F.lit("|"), length.cast("long").cast("string"), F.lit("|"), or_blank(image)), utf16))
    return F.concat(F.lit("p_"), F.lower(F.conv(F.abs(hash32(units)).cast("string"), 10, 36)))


def search_words(body: Column, most: int = 4, over: int = 3, prefix: int | None = None) -> Column:
    """C-19: the first words of more than `over` letters that are no noise."""
    c = or_blank(body) if prefix is None else F.substring(or_blank(body), 1, prefix)
    c = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_\s áéíóúÁÉÍÓÚñÑ]", " "), NOISE, " ")
    return F.array_join(F.slice(F.filter(F.split(folded(c), " "), lambda w: F.length(w) > over), 1, most), " ")


def poster_number(raw: Column) -> Column:
    """C-22: separators before three digits go, and so do two last decimals."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\s+", ""), r"[,.](\d{3})", "$1"), r"[,.]\d{2}$", "").try_cast("double")


def poster(ocr: Column) -> Column:
    """C-22: struct(phones, prices, m2) of the text on a picture: prices from 500, soles first; areas from 20 to 100000."""
    found = F.transform(F.regexp_extract_all(ocr, F.lit(r"(?<!\d)(?:(?:\+?51)?\s*)?9[\s.-]?\d{2}[\s.-]?\d{3}[\s.-]?\d{3}(?!\d)"), 0), text.only_digits)
    phones = F.array_distinct(F.filter(F.transform(found, lambda d: F.right(d, F.lit(9))), lambda d: d.startswith("9")))

    def priced(p: str, currency: str) -> Column:
        n = F.transform(F.regexp_extract_all(ocr, F.lit(p + r"\s*([1-9]\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?)"), 1), poster_number)
        return F.transform(F.filter(n, lambda x: x >= 500), lambda x: F.struct(x.alias("price"), F.lit(currency).alias("currency")))

    area = poster_number(blank_to_null(F.regexp_extract(ocr, r"(?i)(?<!\d)([1-9]\d{1,4}(?:[.,]\d{3})?)\s*(?:m\s*2|m[²2]|mts?\s*2|metros\s+cuadrados|m\b)", 1)))
    return F.struct(phones.alias("phones"), F.concat(priced(r"(?i)(?:S\s*/\s*\.?|soles)", "PEN"), priced(r"(?i)(?:US\s*\$|\$|USD|U\$)", "USD")).alias("prices"), F.when(area.between(20, 100_000), F.floor(area + 0.5).cast("long")).alias("m2"))


def listings(cards: DataFrame, as_of: str) -> DataFrame:
    """P-06: cards(key, href, text, label, image_url, raw_title, raw_price, raw_location, ocr) as listings.

    What the poster says fills a missing phone or area; its price counts where the listed one is under 500.
    """
    c = cards.withColumn("_full", F.concat_ws(" ", blank_to_null(F.col("label")), or_blank(F.col("text")))).withColumn("_title", clean_title(F.col("raw_title"), F.col("label"), F.col("text")))
    c = c.withColumn("_price", text.parse_price(F.coalesce(blank_to_null(F.col("raw_price")), F.col("_full")))).withColumn("_ocr", poster(or_blank(F.col("ocr")))).withColumn("_phone", F.get(text.phones(F.col("_full"), F.col("key")), F.lit(0)))
    top = F.get(F.col("_ocr.prices"), F.lit(0))
    bait = (F.coalesce(F.col("_price.price"), F.lit(0.0)) < 500) & (top["price"] >= 500)
    district = rules.district(F.col("_title"), or_blank(F.col("ocr")), or_blank(F.col("text")), or_blank(F.col("raw_location")))
    href = or_blank(F.col("href"))
    return c.withColumn("_d", district).select(
        F.col("key").alias("id_publicacion"), F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd").alias("fecha_busqueda"), F.date_format(F.lit(as_of).cast("timestamp"), "HH:mm:ss").alias("hora_busqueda"),
        F.coalesce(blank_to_null(text.relative_date(F.col("_full"))), F.lit("hoy")).alias("fecha_publicacion"), rules.first_rule(F.concat_ws(" ", "_title", or_blank(F.col("ocr")), "text"), rules.TYPES, "otro").alias("tipo"), F.col("_title").alias("titulo"),
        F.substring(or_blank(F.col("text")), 1, 2000).alias("descripcion"), F.col("_d.district").alias("distrito"), F.col("_d.source").alias("distrito_origen"), F.coalesce(text.area_m2(F.col("_full")), F.col("_ocr.m2")).alias("m2"),
        F.when(bait, top["price"]).otherwise(F.col("_price.price")).alias("precio"), F.when(bait, top["currency"]).otherwise(F.col("_price.currency")).alias("moneda"), top["price"].alias("precio_real_afiche"), F.coalesce("_phone", F.get(F.col("_ocr.phones"), F.lit(0))).alias("telefono"),
        or_blank(F.col("image_url")).alias("imagen_url"), href.alias("url"), F.when(href.contains("/groups/") | F.col("key").contains("_"), "grupo").otherwise("marketplace").alias("fuente"), text.link_status(href).alias("link_status"),
    )


def in_region(c: Column, region: str = "arequipa", districts: list[str] = REGION) -> Column:
    """F-15: names the region, or a district at the start of a word."""
    padded = F.concat(F.lit(" "), F.lower(or_blank(c)), F.lit(" "))
    return padded.contains(region) | F.exists(F.array(*[F.lit(f" {d}") for d in districts]), lambda d: F.contains(padded, d))


def repaired(rows: DataFrame) -> DataFrame:
    """C-44, A-16: titles without suffixes; a phone that is part of the id is replaced by the one that the text has, or none."""
    phone = F.coalesce(F.get(text.phones(F.concat_ws(" ", "descripcion", "titulo"), F.col("id_publicacion")), F.lit(0)), F.lit(""))
    false = (or_blank(F.col("telefono")) != "") & (F.col("telefono") != phone) & F.contains("id_publicacion", F.col("telefono"))
    d = rules.district(without_suffixes(or_blank(F.col("titulo"))), F.lit(""), or_blank(F.col("descripcion")), or_blank(F.col("distrito")))
    moved = (d["district"] != "") & (d["district"] != or_blank(F.col("distrito")))
    return rows.withColumns({"phone_fixed": false, "district_fixed": moved, "telefono": F.when(false, phone).otherwise(F.col("telefono")), "distrito": F.when(moved, d["district"]).otherwise(F.col("distrito"))})


def group_links(rows: DataFrame) -> DataFrame:
    """D-06: a group's listing without a permalink gets a search of its group; all get their link's status."""
    url = F.coalesce(blank_to_null(F.col("url_publicacion")), F.col("url"), F.lit(""))
    group = F.coalesce(blank_to_null(F.regexp_extract(url, r"/groups/([^/?#]+)", 1)), blank_to_null(F.regexp_extract("id_publicacion", "^([^_]+)_", 1)))
    words = search_words(F.concat_ws(" ", or_blank(F.col("titulo")), or_blank(F.col("descripcion"))))
    kept = text.is_permalink(url) | (url.contains("/search/?q=") & url.contains("%")) | group.isNull() | (or_blank(F.col("fuente")) != "grupo")
    target = F.concat(F.lit(f"{BASE}/groups/"), group, F.when(words != "", F.concat(F.lit("/search/?q="), F.replace(F.url_encode(words), F.lit("+"), F.lit("%20")))).otherwise(""))
    new = F.when(kept, url).otherwise(target)
    return rows.withColumns({"fixed": ~kept, "url": new, "url_publicacion": new, "link_status": F.when(or_blank(F.col("fuente")) == "grupo", text.link_status(new)).otherwise(F.col("link_status"))})


def place_district(places: Column) -> Column:
    """P-10: of a map of a geocoder's names, the first that is there."""
    return F.coalesce(*[blank_to_null(F.element_at(places, F.lit(k))) for k in ("city_district", "district", "city", "town", "village", "county")])


def geocoding_query(district: Column, address: Column, region: str = "Arequipa, Perú") -> Column:
    """C-40."""
    d, a = blank_to_null(district), blank_to_null(address)
    return F.when(d.isNotNull(), F.concat_ws(", ", d, F.lit(region))).when(a.isNotNull(), F.concat_ws(", ", a, F.lit(region))).otherwise("")


def known_district(c: Column, known: list[str] = GEOCODER) -> Column:
    """C-40, C-24 (third form): the first known name that the text holds, words of three letters or more with a capital; else the text."""
    t = F.regexp_replace(F.lower(trimmed(or_blank(c))), r"[^\p{L}\p{N}\s-]", "")
    out = None
    for k in known:
        name = " ".join(w[:1].upper() + w[1:] if len(w) > 2 else w for w in k.split())
        out = F.when(t.contains(k), name) if out is None else out.when(t.contains(k), name)
    return out.otherwise(trimmed(or_blank(c)))


def map_link(latitude: Column, longitude: Column) -> Column:
    """P-13: latitude first, as map services read it."""
    return F.when(latitude.isNotNull() & longitude.isNotNull(), F.concat(F.lit("https://www.google.com/maps?q="), latitude.cast("string"), F.lit(","), longitude.cast("string")))


def provenance(source: Column, url: Column, at: Column, confidence: str = "medium", verification: str = "reported", parser: str = "v1") -> Column:
    """P-12, K-11: what a derived value comes from; blanks take the defaults."""
    return F.struct(F.coalesce(source, F.lit("manual")).alias("source"), url.alias("source_url"), at.alias("retrieved_at"), F.lit(confidence).alias("confidence"), F.lit(verification).alias("verification"), F.lit(parser).alias("parser_version"))


def name(c: Column) -> Column:
    """Of a text that is null or not blank."""
    return F.when(c.isNotNull(), text.title_case_acronyms(folded(c)))


def read_fields(items: Column, **names: list[str]) -> Column:
    """C-34: of an array of maps of strings, the first of each list of fields that is not blank, as structs. Each value is trimmed and sought once, so that what follows may use it several times."""
    said = F.transform(items, lambda m: F.map_filter(F.transform_values(m, lambda k, v: trimmed(v)), lambda k, v: v != ""))
    return F.transform(said, lambda m: F.struct(*[F.coalesce(*[F.element_at(m, F.lit(x)) for x in n]).alias(k) for k, n in names.items()]))


def owners(items: Column) -> Column:
    """C-34, F-18: an array of maps as owners that say something (a name, a document or its kind)."""
    raw = read_fields(items, name=["ownerName", "nombre", "name", "titular"], type=["ownerType", "tipo", "type"], document_type=["documentType", "tipoDocumento"], document=["documentNumber", "numeroDocumento", "documento"], percentage=["ownershipPercentage", "porcentaje", "percentage"], registered=["registeredDate", "fechaInscripcion", "fecha"])
    out = F.transform(raw, lambda r: F.struct(name(r["name"]).alias("name"), text.owner_type(r["type"]).alias("type"), text.document_type(r["document_type"]).alias("document_type"), folded(r["document"]).alias("document"), text.ownership_percentage(r["percentage"]).alias("percentage"), text.date_iso(r["registered"]).alias("registered")))
    return F.filter(out, lambda o: o["name"].isNotNull() | o["document"].isNotNull() | (o["document_type"] != "other"))


def charges(items: Column) -> Column:
    """C-34, F-18."""
    raw = read_fields(items, type=["chargeType", "tipo", "type"], description=["description", "descripcion"], amount=["amount", "monto"], currency=["currency", "moneda"], creditor=["creditor", "acreedor", "beneficiario"], registered=["registeredDate", "fechaInscripcion", "fecha"], active=["isActive", "vigente", "estado"])
    out = F.transform(raw, lambda r: F.struct(text.charge_type(r["type"]).alias("type"), folded(r["description"]).alias("description"), text.last_separator_number(r["amount"]).alias("amount"), text.registry_currency(r["currency"]).alias("currency"), name(r["creditor"]).alias("creditor"), text.date_iso(r["registered"]).alias("registered"), text.is_active(r["active"]).alias("active")))
    return F.filter(out, lambda c: (c["type"] != "other") | c["description"].isNotNull() | c["amount"].isNotNull() | c["creditor"].isNotNull())


def titles(items: Column) -> Column:
    """C-34, F-18."""
    raw = read_fields(items, number=["titleNumber", "numeroTitulo", "titulo"], date=["titleDate", "fechaTitulo", "fecha"], type=["titleType", "tipoTitulo", "tipo"], notary=["notary", "notario"], description=["description", "descripcion"])
    out = F.transform(raw, lambda r: F.struct(folded(r["number"]).alias("number"), text.date_iso(r["date"]).alias("date"), folded(r["type"]).alias("type"), name(r["notary"]).alias("notary"), folded(r["description"]).alias("description")))
    return F.filter(out, lambda t: F.coalesce(t["number"], t["date"], t["type"], t["notary"], t["description"]).isNotNull())


def lifted(json: Column) -> Column:
    """A JSON array of objects, or one object, as an array of maps of strings."""
    many = F.from_json(json, "array<map<string,string>>")
    one = F.from_json(json, "map<string,string>")
    return F.when(trimmed(json).startswith("["), many).when(trimmed(json).startswith("{"), F.array(one))


def intake_plan(rows: DataFrame) -> DataFrame:
    """C-36, C-35, F-17, T-13, T-14: the normalised payload, what to look up, and warnings.

    rows: partida, distrito, urb, calle, avenida, numero, lote, referencia, latitude, longitude, origen, debt, url and
    the JSON texts propietarios, cargas, titulos; all strings.
    """
    number = text.registry_number(F.col("partida"))["number"]
    district = blank_to_null(trimmed(F.col("distrito")))
    lot = blank_to_null(trimmed(F.col("lote")))
    address = text.address(F.col("urb"), F.coalesce(blank_to_null(trimmed(F.col("avenida"))), F.col("calle")), F.col("numero"), F.when(lot.isNotNull(), F.concat(F.lit("Lote "), lot)), F.col("referencia"), F.col("distrito"))
    lat, lon = text.bounded(text.number_commas_thousands(F.col("latitude")), 90), text.bounded(text.number_commas_thousands(F.col("longitude")), 180)
    out = rows.withColumns({"number": number, "district": district, "address": address, "lat": lat, "lon": lon, "amount": text.number_commas_thousands(F.col("debt")), "origin": F.when(F.col("origen").isin("partida", "maps"), F.col("origen")).otherwise("direccion")})
    out = out.withColumns({"owners": owners(lifted(F.col("propietarios"))), "charges": charges(lifted(F.col("cargas"))), "titles": titles(lifted(F.col("titulos")))})
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    none = lambda json, a: F.col(json).isNotNull() & (F.coalesce(F.size(a), F.lit(0)) <= 0)
    warnings = F.array_compact(F.array(
        F.when(F.col("number").isNull(), "no_registry_number"), F.when(F.col("district").isNull(), "no_district"), F.when(none("propietarios", "owners"), "no_owners"), F.when(none("cargas", "charges"), "no_charges"),
        F.when(none("titulos", "titles"), "no_titles"), F.when(~both & (F.col("lat").isNotNull() | F.col("lon").isNotNull()), "half_a_place"),
    ))
    query = F.when(~both, F.coalesce("address", "district"))
    return out.withColumns({"confidence": F.when(both, F.when(F.col("origin") == "partida", "high").otherwise("medium")), "geocode_query": query, "needs_geocoding": query.isNotNull(), "has_registry_row": F.coalesce("number", "address", "district").isNotNull(), "warnings": warnings})


def exploded(plan: DataFrame, key: str, column: str) -> DataFrame:
    """K-10: a row for each owner, charge or title of each plan."""
    return plan.select(key, F.explode(column).alias("x")).select(key, "x.*")


def action_filter(rows: DataFrame, status: str | None, states: tuple[str, ...] = ("requested", "completed", "cancelled")) -> DataFrame:
    """F-21: `all` and unknown states filter nothing."""
    return rows.filter(F.col("status") == status) if status in states else rows
