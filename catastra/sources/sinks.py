"""CSV sinks: the export of listings (K-06) and the run log (K-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catastra.functions import text

# Columns of the export and of the run log, in order.
LISTING_COLUMNS = [
    "id_publicacion", "favorito", "visto", "fecha_busqueda", "hora_busqueda", "fecha_publicacion", "tipo", "titulo", "descripcion", "m2",
    "distrito", "distrito_origen", "precio", "moneda", "precio_real_afiche", "telefono", "notas", "imagen_url", "url", "link_status",
]
LOG_COLUMNS = ["inicio", "fin", "busquedas", "nuevos", "estado"]
MARK = "\ufeff"


def csv_lines(rows: DataFrame, columns: list[str] = LISTING_COLUMNS) -> DataFrame:
    """K-06: (line): the columns in order, joined by commas; a column that rows lack is blank."""
    fields = [text.csv_field(F.col(c)) if c in rows.columns else F.lit("") for c in columns]
    return rows.select(F.concat_ws(",", *fields).alias("line"))


def write_csv(rows: DataFrame, path: str, columns: list[str] = LISTING_COLUMNS) -> None:
    """K-06: part files that make the export when they are put together by name: byte-order mark and header, then the rows, CRLF after each.

    The header is the first partition of a union, so rows are neither gathered nor shuffled for it.
    """
    header = rows.sparkSession.createDataFrame([(MARK + ",".join(columns),)], "line string").coalesce(1)
    header.unionAll(csv_lines(rows, columns)).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def append_log(cycles: DataFrame, path: str, first: bool) -> None:
    """K-07: adds a line for each cycle; with `first` the log begins, and its header comes before them."""
    lines = csv_lines(cycles, LOG_COLUMNS)
    if first:
        lines = cycles.sparkSession.createDataFrame([(MARK + ",".join(LOG_COLUMNS),)], "line string").coalesce(1).unionAll(lines)
    lines.write.mode("append").option("lineSep", "\r\n").text(path)
