"""Captured pages to rows (S-09, S-14, P-08, P-09) by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catastra.functions.text import blank_to_null, date_iso, folded, strip_accents, trimmed

PANEL = r'(?s)<li class="ui-galleria-panel[^"]*"[^>]*>(.*?)</li>'
PAIR = r'\{name:(?:&quot;|")%s(?:&quot;|"),value:(?:&quot;|")([^&"}\s]+)(?:&quot;|")\}'


def auction_panels(pages: DataFrame, key: str, html: str) -> DataFrame:
    """P-08: a row for each carousel panel, in order: ids, label, place, date and notice; what is missing is null."""
    block = F.col("_block")
    get = lambda p: blank_to_null(trimmed(F.regexp_extract(block, p, 1)))
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(PANEL), 1)).alias("panel", "_block"))
    info = folded(get(r'(?s)<div class="info">(.*?)</div>'))
    date = get(r'(?s)<div class="fecha">.*?<i[^>]*></i>\s*(\d{2}/\d{2}/\d{4})')
    ids = {n: get(PAIR % n) for n in ("convocatoria", "tipoConvocatoria", "remate")}
    last_day = F.coalesce(F.upper(strip_accents(info)).contains("ULTIMO DIA DE INSCRIPCION"), F.lit(False))
    return rows.select(key, "panel", *[c.alias(n) for n, c in ids.items()], get(r'<span class="text-bold">\s*([^<]+?)\s*</span>').alias("tipoLabel"), get(r'<i class="fa fa-map-marker"[^>]*></i>\s*([^<\n]+)').alias("ubicacion"), date.alias("fecha"), date_iso(date).alias("fechaISO"), info.alias("info"), last_day.alias("esUltimoDiaInscripcion"))


def slide_items(slides: DataFrame) -> DataFrame:
    """P-09: slides with an id; the title joins what there is."""
    key = F.coalesce("remate", "convocatoria")
    return slides.filter(key.isNotNull()).select(key.alias("id"), F.concat_ws(" · ", "tipoLabel", "ubicacion", "fecha").alias("title"))


def page_parts(html: Column) -> Column:
    """Title, first heading, and counts of links and paragraphs."""
    tag = lambda t: blank_to_null(trimmed(F.regexp_extract(html, rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1)))
    return F.struct(tag("title").alias("title"), tag("h1").alias("h1"), F.regexp_count(html, F.lit(r"(?i)<a\s")).alias("links"), F.regexp_count(html, F.lit(r"(?i)<p[\s>]")).alias("paragraphs"))


def nearby(body: DataFrame, key: str, text: str, pattern: str, window: int) -> DataFrame:
    """S-14, C-21: (key, id, position, near): where the pattern first finds each id, and the text around that match."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), 1).alias("id"))
    lengths = F.transform("_parts", lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))
    found = body.withColumn("_parts", parts).select(key, text, F.posexplode("_parts").alias("_k", "_p"), lengths.alias("_lengths")).filter("_p.hit is not null")
    start = F.aggregate(F.slice("_lengths", F.lit(1), F.col("_k")), F.lit(0), lambda a, x: a + x) + F.length("_p.gap")
    found = found.select(key, text, F.col("_p.id").alias("id"), (start + F.expr("locate(_p.id, _p.hit)")).alias("position"))
    first = found.groupBy(key, "id").agg(F.min(F.struct("position", text)).alias("m")).select(key, "id", "m.*")
    return first.select(key, "id", "position", F.col(text).substr(F.greatest(F.lit(1), F.col("position") - window), F.lit(2 * window)).alias("near"))
