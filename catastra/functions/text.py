"""Scalar column functions (C-*, F-*): Column in, Column out, no Python on the executors."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that combine with a letter; a letter that stands for another one and such marks; and those others (C-23).
MARKS = "".join(map(chr, range(0x300, 0x370)))
DECOMPOSED = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x2000)}
MARKED = "".join(c for c, d in DECOMPOSED.items() if len(d) > 1 and len(d.strip(MARKS)) == 1 and d[0] not in MARKS)
PLAIN = "".join(DECOMPOSED[c][0] for c in MARKED)
#: JavaScript's white space, for trimming and folding (trap 3).
BLANKS = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same as ranges of a pattern's class.
BLANK_RANGES = r" \t-\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Words of an address that do not tell two apart.
ADDRESS_STOP = ["de", "del", "la", "las", "el", "los", "y", "en", "av", "avenida", "calle", "jr", "jiron", "jirón", "urb", "urbanizacion", "urbanización", "mz", "manzana", "lote", "lt", "n", "nro", "numero", "número", "s/n", "sn", "piso", "dpto", "departamento", "asentamiento", "humano", "pueblo", "joven", "asoc", "asociacion", "asociación", "coop", "cooperativa"]


def blank_to_null(c: Column) -> Column:
    """c is computed once; nullif computes it twice in branches and lambdas, and nested calls double that each time."""
    return F.get(F.array_remove(F.array(c), F.lit("")), F.lit(0))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) for an f that uses c several times: c is computed once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def folded(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(c, BLANKS, " " * len(BLANKS)), "  +", " "))


def strip_accents(c: Column) -> Column:
    """C-23: letters up to U+1FFF lose their marks, whether these are part of them or follow."""
    return F.translate(c, MARKED + MARKS, PLAIN)


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def content_hash(title: Column, price: Column, description: Column) -> Column:
    """C-01: inner blanks of the title stay, of the description fold; of the price only digits count."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat_ws("|", trimmed(F.lower(e(title))), only_digits(e(price)), folded(F.lower(e(description)))), 256)


def source_type(source: Column, key: Column) -> Column:
    """C-02."""
    s, k = F.lower(F.coalesce(source, F.lit(""))), F.coalesce(key, F.lit(""))
    return F.when(s.contains("adondevivir") | k.startswith("av-"), "adondevivir").when(s.contains("urbania") | k.startswith("urb-"), "urbania").when(s.contains("grupo") | k.contains("_"), "facebook_group").otherwise("facebook_marketplace")


def whitelisted(value: Column, allowed: list[str], default: str) -> Column:
    """C-03."""
    return F.when(value.isin(*allowed), value).otherwise(default)


def scraped_at(date: Column, time: Column, as_of: Column) -> Column:
    """C-04: as_of where date and time make no timestamp."""
    return F.coalesce(F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit("yyyy-MM-dd HH:mm:ss")), as_of)


# The patterns in the functions from here to date_iso, which say what is a number, a price, an area, a phone, a date.
def clean_number(raw: Column) -> Column:
    """C-06: commas are thousands; dots too, if three digits follow the last and there is no comma."""
    s = F.regexp_replace(raw, r"\s+", "")
    lead = lambda c: F.regexp_extract(c, r"^[+-]?\d*\.?\d+|^[+-]?\d+", 0).try_cast("double")
    no_commas = F.regexp_replace(s, ",", "")
    frac = F.length(F.substring_index(s, ".", -1))
    return F.when(s == "", None).when(s.contains(","), lead(no_commas)).when(s.contains(".") & (frac == 3), lead(F.regexp_replace(s, r"\.", ""))).otherwise(lead(s))


def parse_price(text: Column) -> Column:
    """C-07: struct(price, currency): soles, else dollars, else a bare number of at least 1000."""
    found = lambda p: blank_to_null(F.regexp_extract(text, p, 1))
    pen, usd = found(r"(?i)(?:S\s*/\s*\.?|soles)\s*(\d[\d.,\s]*)"), found(r"(?i)(?:US\s*\$|\$|USD|U\$)\s*(\d[\d.,\s]*)")
    bare = found(r"(?<![\w$,.])(\d{3,8}(?:[.,]\d{1,3})?)")
    currency = F.when(pen.isNotNull(), "PEN").when(usd.isNotNull(), "USD").when(bare.isNotNull(), "(no indicado)").otherwise("")
    # one number is read, so that the expression stays small
    some = F.filter(F.array(F.struct(clean_number(F.coalesce(pen, usd, bare)).alias("price"), currency.alias("currency"))), lambda x: (x["currency"] != "(no indicado)") | (x["price"] >= 1000))
    return F.coalesce(F.get(some, F.lit(0)), F.struct(F.lit(None).cast("double").alias("price"), F.lit("").alias("currency")))


def area_m2(text: Column) -> Column:
    """C-08."""
    raw = F.regexp_extract(text, r"(?i)(\d{1,5}(?:[.,]\d+)?)\s*(?:m\s*2|m[²2]|mts?\s*2|mtrs2|metros\s+cuadrados|metros\s+c)", 1)
    return F.floor(clean_number(blank_to_null(raw)) + 0.5).cast("long")


def phones(text: Column, exclude: Column | None = None) -> Column:
    """C-05: distinct nine-digit mobile numbers in order; links, item paths, publication ids and `exclude` do not count."""
    clean = text
    for p in (r"(?i)https?://\S+", r"(?i)/marketplace/item/\d+", r"(?i)publicaci[oó]n\s*\d+"):
        clean = F.regexp_replace(clean, p, " ")
    if exclude is not None:
        clean = F.when(F.coalesce(exclude, F.lit("")) != "", F.replace(clean, exclude, F.lit(" "))).otherwise(clean)
    found = F.transform(F.regexp_extract_all(clean, F.lit(r"(?i)(?<!\d)(?:(?:\+?51|cel\.?|tel\.?|wssp?|whatsapp)?\s*)?9(?:[\s./#_-]*\d){8}(?!\d)"), 0), only_digits)
    nine = F.filter(F.transform(found, lambda d: F.when(d.startswith("51") & (F.length(d) == 11), F.substring(d, 3, 9)).otherwise(d)), lambda d: (F.length(d) == 9) & d.startswith("9"))
    links = F.filter(F.regexp_extract_all(text, F.lit(r"(?i)wa\.me/(?:[^/]+/)?(?:\+?51)?\s*(\d{9,12})"), 1), lambda d: d.startswith("9"))
    return F.array_distinct(F.concat(nine, F.transform(links, lambda d: F.right(d, F.lit(9)))))


def relative_date(text: Column) -> Column:
    """C-09."""
    long_ = F.regexp_extract(text, r"(?i)\bhace\s+\d+\s+(?:minutos?|minuto|min|horas|hora|hrs|hr|h|d[ií]as|dias|d|semana|semanas)", 0)
    short = F.regexp_extract(text, r"(?i)(?:^|\s)(\d+\s*(?:horas|hora|hrs?|h|minutos?|min|d[ií]as|dias|d)\b)", 1)
    return F.when(long_ != "", folded(long_)).otherwise(trimmed(short))


def first_line(text: Column, least: int = 8) -> Column:
    """C-09."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(text, r"\r?\n"), trimmed), lambda x: F.length(x) >= least), F.lit(0)), F.lit(""))


def date_iso(raw: Column) -> Column:
    """C-10: dd/MM/yyyy to ISO; only the ranges of day and month are tested. What is ISO stays as it is."""
    part = lambda d, at, n: F.substring(d, at, n)
    day = lambda d: F.when(part(d, 1, 2).cast("int").between(1, 31) & part(d, 4, 2).cast("int").between(1, 12), F.concat_ws("-", part(d, 7, 4), part(d, 4, 2), part(d, 1, 2)))
    found = blank_to_null(F.regexp_extract(raw, r"^\s*(\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2})\s*$", 1))
    return F.when(raw.isNotNull(), let(found, lambda d: F.when(part(d, 3, 1) == "/", day(d)).otherwise(d)))


def last_separator_number(raw: Column) -> Column:
    """C-27, C-33: of several dots or commas the last is the decimal point."""
    s = F.regexp_replace(F.regexp_replace(raw, r"[^\d.,]", ""), ",", ".")
    return F.regexp_replace(s, r"\.(?=.*\.)", "").try_cast("double")


def amount_pen(raw: Column) -> Column:
    """C-27: null for foreign money, unless the text begins with an S."""
    t = folded(raw)
    foreign = F.upper(t).rlike(r"US\$|USD|EUR|€|\$") & ~t.rlike("^S")
    return F.when(~foreign, last_separator_number(F.regexp_replace(t, r"(?i)S/?\.?", "")))


def area_last_separator(raw: Column) -> Column:
    """C-33."""
    n = last_separator_number(F.regexp_replace(F.upper(trimmed(raw)), r"(?i)\s*(M2|MT2|MTS2|M²|METROS?2|METROS?\s+CUADRADOS?|CUADRADOS?)\s*$", ""))
    return F.when(n > 0, n)


def number_commas_thousands(raw: Column) -> Column:
    """C-35: here commas are thousands."""
    return blank_to_null(F.regexp_replace(trimmed(raw), r"[^\d.-]", "")).try_cast("double")


def title_case(c: Column) -> Column:
    """C-24, plain."""
    return F.initcap(F.lower(c))


def title_case_acronyms(c: Column) -> Column:
    """C-24: a letter after a dot is capital too."""
    parts = F.transform(F.split(F.initcap(F.lower(c)), r"\."), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))))
    return F.array_join(parts, ".")


# The words and patterns in the functions from here to registry_currency, of auctions, registry numbers, documents, owners and charges.
def auction_type(code: Column, label: Column) -> Column:
    """C-25: words of the label before the code."""
    k = trimmed(F.coalesce(code, F.lit("")))
    by_code = let(k, lambda k: F.when(k == "1", "remate_simple").when(k == "2", "segunda_convocatoria").when(k == "3", "tercera_convocatoria").when(k == "4", "subasta").otherwise("desconocido"))
    said = lambda t: F.when(t.contains("SEGUNDA"), "segunda_convocatoria").when(t.contains("TERCERA"), "tercera_convocatoria").when(t.contains("SUBASTA"), "subasta").when(t.contains("REMATE SIMPLE"), "remate_simple")
    return F.coalesce(let(strip_accents(F.upper(folded(F.coalesce(label, F.lit(""))))), said), by_code)


def place(raw: Column) -> Column:
    """C-26: struct(display, key)."""
    return let(blank_to_null(folded(raw)), lambda t: F.when(t.isNotNull(), F.struct(title_case(t).alias("display"), strip_accents(F.upper(t)).alias("key"))))


def registry_number(raw: Column, office: str = "110") -> Column:
    """C-29: struct(ok, number, digits, area): P and separators go; an office prefix of ten digits or more goes; eight digits, padded."""
    t = F.regexp_replace(F.regexp_replace(F.upper(trimmed(F.coalesce(raw, F.lit("")))), r"\s+", ""), r"^P[.\-_]?", "")
    prefixed = lambda d: (F.length(d) >= 10) & d.startswith(office)
    core = lambda d: F.when(prefixed(d), F.substring(d, 4, 1_000)).otherwise(d)
    ok = lambda d: (d != "") & (F.length(core(d)) <= 8)
    padded = lambda d: F.lpad(core(d), 8, "0")
    return let(only_digits(t), lambda d: F.struct(ok(d).alias("ok"), F.when(ok(d), F.concat(F.lit("P-"), padded(d))).alias("number"), F.when(ok(d), padded(d)).alias("digits"), F.when(prefixed(d), office).alias("area")))


def link_number(raw: Column) -> Column:
    """C-30."""
    return blank_to_null(F.regexp_replace(F.upper(strip_accents(raw)), r"[\s\-_.]", ""))


def document_type(raw: Column) -> Column:
    """C-31."""
    t = strip_accents(F.upper(trimmed(F.coalesce(raw, F.lit("")))))
    return F.when(raw.isNull(), "other").when(t == "DNI", "DNI").when(t == "RUC", "RUC").when((t == "CE") | t.rlike("CARN.E|CARNET"), "CE").when(t.rlike("PASAPORTE|PASS"), "PASAPORTE").otherwise("other")


def owner_type(raw: Column) -> Column:
    """C-31."""
    t = strip_accents(F.upper(trimmed(F.coalesce(raw, F.lit("")))))
    return F.when(raw.isNull(), "desconocido").when(t.rlike("NATURAL|FISICA"), "persona_natural").when(t.rlike(r"JURIDICA|SOC\.|S.A\.?C|S\.?R\.?L|S\.?A\.?$|EMPRESA|SOCIEDAD|ESTADO|MUNICIPALIDAD|BANCO"), "persona_juridica").otherwise("desconocido")


def charge_type(raw: Column) -> Column:
    """C-31."""
    t = strip_accents(F.upper(trimmed(F.coalesce(raw, F.lit("")))))
    words = [("HIPOTEC", "hipoteca"), ("EMBARG", "embargo"), ("CAUTELAR", "medida_cautelar"), ("ANOTACION", "anotacion_demanda"), ("PROHIBICION", "prohibicion"), ("SERVIDUMBRE", "servidumbre"), ("USUFRUCTO", "usufructo")]
    out = F.when(t == "", "other")
    for w, name in words:
        out = out.when(t.contains(w), name)
    return out.otherwise("other")


def is_active(raw: Column) -> Column:
    """C-31: si, no or unknown."""
    t = strip_accents(F.upper(trimmed(F.coalesce(raw, F.lit("")))))
    return F.when(t == "", "unknown").when((t == "SI") | t.rlike("VIGENTE|ACTIVO"), "si").when((t == "NO") | t.rlike("CANCELAD|CADUCAD|EXTINGUID|LEVANTAD"), "no").otherwise("unknown")


def registry_currency(raw: Column) -> Column:
    """C-31: PEN unless it says dollars."""
    return F.when(F.upper(trimmed(F.coalesce(raw, F.lit("")))).isin("USD", "US$", "DOLARES", "DÓLARES"), "USD").otherwise("PEN")


def ownership_percentage(raw: Column) -> Column:
    """C-32: a share of at most one without a percent sign is a fraction."""
    p = r"(?i)^([\d.,]+)\s*(%|por ciento)?$"
    share = lambda x: F.when(x["unit"] != "", x["n"]).when((x["n"] > 0) & (x["n"] <= 1), x["n"] * 100).otherwise(x["n"])
    read = lambda t: F.struct(F.replace(F.regexp_extract(t, p, 1), F.lit(","), F.lit(".")).try_cast("double").alias("n"), F.regexp_extract(t, p, 2).alias("unit"))
    return F.when(raw.isNotNull(), let(let(let(trimmed(raw), read), share), lambda v: F.when(v.between(0, 100), F.round(v, 2))))


def address(*parts: Column) -> Column:
    """C-35: the parts that are not blank, by commas."""
    return blank_to_null(F.concat_ws(", ", *[blank_to_null(trimmed(p)) for p in parts]))


def address_tokens(raw: Column) -> Column:
    """C-37: distinct words without accents that are no stop words."""
    t = F.regexp_replace(F.lower(strip_accents(F.coalesce(raw, F.lit("")))), r"[^\p{L}\p{N}]+", " ")
    return F.array_except(F.array_distinct(F.filter(F.split(F.trim(t), " "), lambda x: x != "")), F.array(*[F.lit(w) for w in ADDRESS_STOP]))


def title_tokens(raw: Column, over: int = 3) -> Column:
    """C-20: distinct lower-case words of more than `over` characters."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(raw, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > over))


def overlap(a: Column, b: Column) -> Column:
    """U-03: shared tokens over the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def district_matches(a: Column, b: Column) -> Column:
    """C-38."""
    x, y = (trimmed(F.upper(strip_accents(F.coalesce(c, F.lit(""))))) for c in (a, b))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


# The shapes of links in is_permalink and link_status.
def is_permalink(url: Column) -> Column:
    """F-16."""
    return F.coalesce(url.rlike(r"/groups/[^/?#]+/(?:posts|permalink|multi_permalink)/\d+|[?&]multi_permalinks=\d+|[?&]set=gm\.\d+|facebook\.com/share/[a-z]/[A-Za-z0-9]+"), F.lit(False))


def link_status(url: Column) -> Column:
    """C-14."""
    return F.when(F.coalesce(url, F.lit("")).isin("", "#"), "").when(is_permalink(url), "permalink").when(url.contains("/search/?q="), "search").when(url.contains("/groups/"), "group_root").otherwise("direct")


def canonical_json(data: Column) -> Column:
    """C-39: a JSON object with its first-level keys in order; nulls and 'null' go."""
    entries = F.map_entries(F.from_json(data, "map<string,string>"))
    kept = F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "null"))
    return F.to_json(F.map_from_entries(F.array_sort(kept)))


def hours_between(start: Column, end: Column) -> Column:
    """C-41: never negative."""
    return F.greatest(F.lit(0.0), (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 3.6e9)


def csv_field(c: Column) -> Column:
    """C-43, K-06: each line end and each tab becomes a blank; quotes only where needed."""
    t = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\r?\n|\t", " ")
    return F.when(t.rlike('[",]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def escape_html(c: Column) -> Column:
    """C-43."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def safe_file_name(c: Column) -> Column:
    """C-43."""
    return F.substring(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), 1, 120)


def bounded(c: Column, most: float) -> Column:
    """F-17: null beyond +-most."""
    return F.when(F.abs(c) <= most, c)


def is_uuid(c: Column) -> Column:
    """F-12."""
    return F.coalesce(c.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))
