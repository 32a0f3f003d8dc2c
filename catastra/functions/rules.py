"""Ordered rule tables (J-14, C-11, C-12, F-11) and the expressions made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# District names, and patterns that name them; the first rule that holds decides.
DISTRICTS = [
    ("La Joya", r"\bla\s+joya\b|san\s+isidro\s+(?:la\s+joya|\b)|la\s+planicie|canoas|san\s+camilo|el\s+triunfo", r"\bla\s+joya\b|san\s+isidro|la\s+planicie|canoas|san\s+camilo"),
    ("Cayma", r"\bcayma\b|la\s+tomilla|acequia\s+alta|tronchadero|dean\s+valdivia", r"\bcayma\b|la\s+tomilla|acequia\s+alta"),
    ("Cerro Colorado", r"cerro\s+colorado|cono\s+norte|pachacutec|ciudad\s+municipal|zamacola|v[ií]a\s+54|mariscal\s+castilla", r"cerro\s+colorado|cono\s+norte|pachacutec|ciudad\s+municipal|zamacola"),
    ("Paucarpata", r"paucarpata|ciudad\s+blanca|miguel\s+grau|israel\b|bad[eé]n", r"paucarpata|ciudad\s+blanca|miguel\s+grau"),
    ("Yanahuara", r"yanahuara|umacollo|chullo", r"yanahuara|umacollo"),
    ("Alto Selva Alegre", r"alto\s+selva\s+alegre|selva\s+alegre|gr[aá]ficos|independencia\b", r"alto\s+selva\s+alegre|selva\s+alegre"),
    ("Sachaca", r"sachaca|t[ií]o\s+chico|t[ií]o\s+grande|huaranguillo|arancota", r"sachaca|huaranguillo|arancota"),
    ("Socabaya", r"socabaya|lara\b|san\s+mart[ií]n\s+de\s+socabaya|bellapampa", r"socabaya|lara\b|bellapampa"),
    ("Jacobo Hunter", r"jacobo\s+hunter|j\.?\s*hunter|\bhunter\b|bellavista\b", r"jacobo\s+hunter|j\.?\s*hunter|\bhunter\b"),
    ("José Luis Bustamante y Rivero", r"bustamante(?:\s+y\s+rivero)?|jlb\s*y\s*r|jlbyr|ciudad\s+mi\s+trabajo|dolores\b|avelino", r"bustamante|jlbyr|ciudad\s+mi\s+trabajo"),
    ("Miraflores", r"\bmiraflores\b|alameda\s+salaverry|alto\s+misti", r"\bmiraflores\b|alameda\s+salaverry"),
    ("Mariano Melgar", r"mariano\s+melgar|jerusal[eé]n\b", r"mariano\s+melgar"),
    ("Tiabaya", r"tiabaya|los\s+tunales|alata\b", r"tiabaya"),
    ("Yura", r"\byura\b|la\s+calera|quiscos|la\s+estaci[oó]n\b", r"\byura\b|quiscos|la\s+calera"),
    ("Characato", r"characato|ojo\s+de\s+agua", r"characato"),
    ("Sabandía", r"saband[ií]a", r"saband[ií]a"),
    ("Mollebaya", r"mollebaya", r"mollebaya"),
    ("Quequeña", r"queque[ñn]a", r"queque[ñn]a"),
    ("Chiguata", r"chiguata", r"chiguata"),
    ("Uchumayo", r"uchumayo|congata|cerro\s+verde", r"uchumayo|congata"),
    ("Yarabamba", r"yarabamba", r"yarabamba"),
    ("Polobaya", r"polobaya", r"polobaya"),
    ("Vítor", r"v[ií]tor\b", r"v[ií]tor\b"),
    ("Santa Rita de Siguas", r"santa\s+rita(?:\s+de\s+siguas)?", r"santa\s+rita"),
    ("Majes", r"\bmajes\b|pedregal|el\s+pedregal|majes\s+siguas", r"\bmajes\b|pedregal|el\s+pedregal"),
    ("Camaná", r"caman[aá]\b", r"caman[aá]\b"),
    ("Mollendo", r"mollendo|islay", r"mollendo"),
    ("Mejía", r"\bmej[ií]a\b", r"\bmej[ií]a\b"),
    ("Arequipa (Cercado)", r"\bcercado\b|vallecito", r"\bcercado\b"),
]
# Property types by pattern, in order.
TYPES = [
    ("duplex", r"duplex|d[uú]plex"),
    ("departamento", r"\bdepartamento\b|\bdepart\b|\bdpto\b|\bdepas?\b|\bdepa\b|d[eé]part"),
    ("casa", r"\bcasas?\b|vivienda|chalet|chal[eé]|adosado|bungalow"),
    ("comercial", r"local|tienda|oficina|galer[ií]a|comercial"),
    ("agricola", r"agr[ií]cola|cultivo|chacra|fundo|tierra[s]?\s+d[eé]\s+cultivo|huerta|granja"),
    ("lote", r"\blote\b|\blotes\b|lotiz|urba|loteo"),
    ("terreno", r"\bterrenos?\b|predio|parcela|solar"),
]
# Words that mark other goods, and words that mark property.
REJECT = [r"botella", r"lote\s+de\s+(?:ropa|polo|polos|zapatillas|camisas?|prendas?)", r"\bropa\b", r"zapatillas?\b", r"zapatos?\b", r"polos?\b", r"camisas?\b", r"celular", r"iphone", r"samsung", r"televisor", r"\btv\b", r"laptop", r"mochila", r"cartera", r"juguete", r"refrigerador", r"lavadora", r"veh[ií]culo", r"camioneta", r"llantas?\b", r"maquillaje", r"perfume", r"comida\b", r"torta\b", r"pasteles\b", r"reparaci[oó]n", r"soporte\s+t[eé]cnico", r"herramientas?\b", r"taladro", r"bicicleta", r"colch[oó]n", r"vestido", r"peluche"]
ACCEPT = [r"\bterrenos?\b", r"\blotes?\b", r"\bcasas?\b", r"casa[\s-]campo", r"\bchacras?\b", r"\bparcelas?\b", r"\bpredios?\b", r"\bsolares?\b", r"\binmuebles?\b", r"\bpropieda(?:d|des)\b", r"\bdepartamentos?\b", r"\bdepas?\b", r"\bdpto\b", r"\bduplex\b", r"\blocales?\b", r"urbanizac", r"lotizac", r"posesi[oó]n", r"\bm2\b", r"hect[aá]reas?", r"\bha\b", r"agricola|agrícola", r"residencial"]
# Fixed value: words before a district that make it the place of the property.
CONTEXT = r"(?:en|ubicad[oa]\s+en|zona\s+de|sector|distrito\s+de)\s+"

#: Java's \b knows all letters; this one knows ASCII alone, as the rules were written for.
ASCII_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def pattern(p: str) -> str:
    return "(?iu)" + p.replace(r"\b", ASCII_EDGE)


def matches(text: Column, p: str) -> Column:
    return F.coalesce(text.rlike(pattern(p)), F.lit(False))


def first_rule(text: Column, rules, default: str | None = None, value=F.lit) -> Column:
    """J-14, C-12: the name of the first rule (name, pattern) that text matches, or what `value` makes of it."""
    out = F
    for name, p in rules:
        out = out.when(matches(text, p), value(name))
    return out.otherwise(F.lit(default))


def is_relevant(text: Column, reject=REJECT, accept=ACCEPT) -> Column:
    """F-11: no reject pattern holds, and an accept pattern does."""
    return ~matches(text, "|".join(f"(?:{p})" for p in reject)) & matches(text, "|".join(f"(?:{p})" for p in accept))


def district(title: Column, ocr: Column, description: Column, location: Column, rules=DISTRICTS) -> Column:
    """C-11: struct(district, source); title before poster before description (in context before anywhere) before location."""
    direct = [(n, p) for n, p, _ in rules]
    near = [(n, f"{CONTEXT}(?:{k})") for n, _, k in rules]
    levels = [(title, direct, "title"), (ocr, direct, "ocr"), (description, near, "description"), (description, direct, "description"), (location, direct, "location")]
    pair = lambda name, source: F.struct(F.lit(name).alias("district"), F.lit(source).alias("source"))
    # each pattern stands once: a level gives name and source together
    return F.coalesce(*[first_rule(c, r, value=lambda n, s=s: pair(n, s)) for c, r, s in levels], pair("", "none"))
