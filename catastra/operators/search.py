"""Listing search (F-01 to F-07, O-01, O-02), facets (A-02) and paging (O-03, A-18)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Search:
    """Every filter is off where it is empty. as_of stands for now."""

    as_of: str
    districts: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    favourite: bool = False
    source: str = ""
    days: float | None = None
    day: str = ""
    last_days: int | None = None
    words: str = ""


def in_list(c: Column, values: list[str]) -> Column:
    """F-01, F-02: in the list, without case; a missing value is an empty one."""
    return F.lower(F.coalesce(c, F.lit(""))).isin(*[v.strip().lower() for v in values if v.strip()])


def within_days(date: Column, as_of: str, days: float) -> Column:
    """F-05: not older than so many days; rows without a date stay."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(date.cast("timestamp"))) / 86_400e6
    return F.coalesce(age <= days, F.lit(True))


def on_day(date: Column, day: str) -> Column:
    return F.coalesce(date == day, F.lit(False))


def since_day(date: Column, as_of: str, last: int) -> Column:
    """F-06: dates are compared as text; rows without one go."""
    return F.coalesce(date >= F.date_format(F.date_sub(F.lit(as_of).cast("date"), last - 1), "yyyy-MM-dd"), F.lit(False))


def any_value_contains(columns: list[Column], words: str) -> Column:
    """F-07: literally, in the lower-cased values joined by blanks."""
    return F.lower(F.concat_ws(" ", *[c.cast("string") for c in columns])).contains(words.strip().lower())


def search(rows: DataFrame, q: Search, district="distrito", kind="tipo", favourite="favorito", source=None, date="fecha_busqueda", published="fecha_publicacion") -> DataFrame:
    """The filters in one conjunction, so that Catalyst pushes to the scan what it can."""
    tests = []
    if q.districts:
        tests.append(in_list(F.col(district), q.districts))
    if q.types:
        tests.append(in_list(F.col(kind), q.types))
    if q.favourite:
        tests.append(F.col(favourite).isin("true", "1"))
    if q.source:
        tests.append(F.contains(F.lower(source), F.lit(q.source.lower())))
    if q.days is not None:
        tests.append(within_days(F.coalesce(F.try_to_timestamp(F.col(date).cast("string")), F.try_to_timestamp(F.col(published).cast("string"))), q.as_of, q.days))
    if q.day:
        tests.append(on_day(F.col(date), q.day))
    if q.last_days is not None:
        tests.append(since_day(F.col(date), q.as_of, q.last_days))
    if q.words:
        tests.append(any_value_contains([F.col(c) for c in rows.columns], q.words))
    for t in tests:
        rows = rows.filter(t)
    return rows


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """O-02, O-03: page from 1, size from 1 to 100; `order` must end in a key, so that pages do not overlap."""
    size = min(max(size, 1), 100)
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def total_pages(rows: DataFrame, size: int = 20) -> DataFrame:
    """A-01, A-18."""
    return rows.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size).cast("long"))


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A-02: (facet, value): distinct values that are not blank, over all rows; one pass for all columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("p")).select("p.*").filter("value is not null and value != ''").distinct()


def listing_source(stored: Column, link: Column, key: Column) -> Column:
    """F-04: the source of a listing: the stored one in lower case; without one, as its link, or else its key, tells."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    url, id, kept = low(link), low(key), low(stored)
    told = F.when(url.contains("adondevivir") | id.startswith("av-"), "adondevivir").when(url.contains("urbania") | id.startswith("urb-"), "urbania").when(url.contains("/groups/") | id.contains("_"), "grupo").otherwise("marketplace")
    return F.when(kept == "", told).otherwise(kept)


def of_source(stored: Column, link: Column, key: Column, part: str) -> Column:
    """F-04: whether the source's name has that part; every one has an empty part."""
    return listing_source(stored, link, key).contains(part.lower())
