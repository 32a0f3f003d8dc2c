"""Structs of the data model and the values of its enums."""

from __future__ import annotations

from pyspark.sql import types as T

STRING = T.StringType()
# The fields of a captured listing, in the order of its export.
LISTING_FIELDS = ["id_publicacion", "fecha_busqueda", "hora_busqueda", "fecha_publicacion", "tipo", "titulo", "descripcion", "distrito", "distrito_origen", "m2", "precio", "moneda", "precio_real_afiche", "telefono", "imagen_url", "url_publicacion", "url", "fuente", "favorito", "notas", "link_status"]
LISTING = T.StructType([T.StructField(f, STRING) for f in LISTING_FIELDS])
BRONZE = T.StructType([T.StructField("id", STRING), T.StructField("data", STRING), T.StructField("seen_at", STRING)])
PROVENANCE = T.StructType([T.StructField("source", STRING), T.StructField("source_url", STRING), T.StructField("retrieved_at", T.TimestampType()), T.StructField("confidence", STRING), T.StructField("verification", STRING), T.StructField("parser_version", STRING)])
OWNER = T.StructType([T.StructField(f, STRING) for f in ("titular", "tipo", "tipoDocumento", "numeroDocumento", "porcentaje", "fechaInscripcion")])
CHARGE = T.StructType([T.StructField(f, STRING) for f in ("tipo", "descripcion", "monto", "moneda", "acreedor", "fechaInscripcion", "estado")])
TITLE = T.StructType([T.StructField(f, STRING) for f in ("numeroTitulo", "fechaTitulo", "tipoTitulo", "notario", "descripcion")])
REGISTRY_CAPTURE = T.StructType([*[T.StructField(f, STRING) for f in ("partida", "area", "direccion", "distrito", "oficina", "zona")], T.StructField("propietarios", T.ArrayType(OWNER)), T.StructField("cargas", T.ArrayType(CHARGE)), T.StructField("titulos", T.ArrayType(TITLE))])
SOURCE_ITEM = T.StructType([T.StructField("source", STRING), T.StructField("id", STRING), T.StructField("title", STRING), T.StructField("raw", STRING)])
# Enums.
CONFIDENCE = ["high", "medium", "low", "unknown"]
CURRENCIES = ["PEN", "USD"]
PROPERTY_TYPES = ["terreno", "lote", "casa", "departamento", "duplex", "comercial", "agricola", "otro"]
