"""Scans of captured rows (S-01 to S-07, S-16), and a registry of sources (S-17 to S-20)."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catastra.sources.schemas import LISTING, SOURCE_ITEM
from catastra.sources.shared import staged

LOG = logging.getLogger(__name__)


def strict(bronze: DataFrame) -> DataFrame:
    """S-01: (id, seen_at, fields...); a row of bad JSON ends the job."""
    return bronze.select("id", "seen_at", F.from_json("data", LISTING, {"mode": "FAILFAST"}).alias("d")).select("id", "seen_at", "d.*")


def tolerant(bronze: DataFrame, order: str = "seen_at") -> DataFrame:
    """S-02: rows of bad JSON or without a publication id go; of each id the last stays."""
    from catastra.operators.resolve import latest

    rows = bronze.select("id", "seen_at", F.from_json("data", LISTING).alias("d")).select("id", "seen_at", "d.*").filter("id_publicacion is not null and id_publicacion != ''")
    return latest(rows, ["id_publicacion"], [F.col(order), F.col("id")])


def by_id(rows: DataFrame, key: str, value) -> DataFrame:
    """S-03, S-04: the row of a key, if there is one; the filter reaches the scan."""
    return rows.filter(F.col(key) == F.lit(value)).limit(1)


def by_link(bronze: DataFrame, link: str, prefix: str | None = None) -> DataFrame:
    """S-05: the row of least id whose JSON has the link under either name."""
    hit = (F.get_json_object("data", "$.url_publicacion") == link) | (F.get_json_object("data", "$.url") == link)
    if prefix:
        hit = hit & F.col("id").like(f"{prefix}_%")
    return bronze.filter(hit).orderBy("id").limit(1)


def by_prefix(rows: DataFrame, prefix: str, key: str = "id") -> DataFrame:
    """S-06: keys of a prefix and at least one more character; the underscore stands for any one."""
    return rows.filter(F.col(key).like(f"{prefix}_%"))


def whole(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    """S-08: tables without a filter; what reads them prunes their columns."""
    return [spark.read.parquet(f"{folder}/{n}.parquet") for n in names]


def with_default(rows: DataFrame, default: DataFrame) -> DataFrame:
    """S-16: rows, or the default where there are none."""
    return default if rows.isEmpty() else rows


@dataclass(frozen=True)
class Source:
    """S-17: a named source of rows; `search` gives a DataFrame of SOURCE_ITEM."""

    name: str
    status: str
    search: Callable[[SparkSession, dict], DataFrame]


def nothing(spark: SparkSession, params: dict) -> DataFrame:
    """S-19, S-20: no rows, with the schema of all sources."""
    return spark.createDataFrame([], SOURCE_ITEM)


def details(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """S-17, S-19: wanted(source, id) with `found`, and the item's title and raw text where it is."""
    return wanted.join(items.withColumn("found", F.lit(True)), ["source", "id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


class Registry:
    """S-18: sources by name; a later one of the same name replaces the former."""

    def __init__(self):
        self.sources: dict[str, Source] = {}

    def register(self, source: Source) -> None:
        self.sources[source.name] = source

    def get(self, name: str) -> Source | None:
        return self.sources.get(name)

    def has(self, name: str) -> bool:
        return name in self.sources

    def statuses(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted((s.name, s.status) for s in self.sources.values()), "source string, status string")

    def search(self, spark: SparkSession, params: dict) -> DataFrame:
        """All sources' rows. Each source is read by itself, into a table of the shared folder, so one that fails, when it is planned or in a task, adds none and takes no other with it."""
        out = nothing(spark, params)
        for s in self.sources.values():
            try:
                out = out.unionByName(staged(s.search(spark, params)))
            except Exception as e:  # one source's fault is no other's
                LOG.warning("source %s left out: %s", s.name, e)
        return out


def default_registry() -> Registry:
    r = Registry()
    # Sources that are planned; they have no rows.
    for name in ("sunarp", "sunarp_bgr", "sunarp_sprl", "remaju", "google_maps", "openstreetmap", "impla", "pdm", "municipality", "cadastre", "cej", "sbn", "cofopri", "seace"):
        r.register(Source(name, "unavailable", nothing))
    # Sources that ask for a login.
    for name in ("sunarp", "sunarp_sprl"):
        r.register(Source(name, "requires_auth", nothing))
    return r


def key_is_safe(key: Column) -> Column:
    """K-15: no absolute path and no step upwards."""
    return F.coalesce((key != "") & ~key.startswith("/") & ~key.rlike(r"(^|/)\.\.(/|$)") & ~key.contains("\\"), F.lit(False))


def attachment(encoded: Column, most: int = 8 << 20) -> Column:
    """K-16: struct(ok, bytes) of a base64 attachment that is neither empty nor too large."""
    data = F.try_to_binary(encoded, F.lit("base64"))
    size = F.octet_length(data)
    return F.struct(F.coalesce((size > 0) & (size <= most), F.lit(False)).alias("ok"), size.alias("bytes"))


def attachment_key(owner: Column, action: Column, name: Column) -> Column:
    """K-16: where the attachment of an owner's action is kept: the last part of its name, odd characters as underscores, 120 characters at most."""
    base = F.substring(F.regexp_replace(F.element_at(F.split(name, r"[\\/]"), -1), r"[^A-Za-z0-9_.\- ]+", "_"), 1, 120)
    return F.concat(F.lit("remates/"), owner.cast("string"), F.lit("/"), action.cast("string"), F.lit("-"), F.when(base == "", "aviso.pdf").otherwise(base))


def attachment_links(uploads: DataFrame) -> DataFrame:
    """K-16: uploads(property_id, action_id, name, base64) as links to what is kept; empty and too large ones go."""
    data = attachment(F.col("base64"))
    return uploads.filter(data["ok"]).select("property_id", attachment_key(F.col("property_id"), F.col("action_id"), F.col("name")).alias("url"), F.col("name").alias("title"), F.lit("remate_pdf").alias("link_type"), F.lit("remaju").alias("source"), F.lit("unknown").alias("is_accessible"), data["bytes"].alias("size"))
