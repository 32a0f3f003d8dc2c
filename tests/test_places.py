"""Nearest places, names, zones, rates and keys at their edges."""

import math
import random
import time

from pyspark.sql import functions as F

from catastra.functions import captures
from catastra.operators import geo, rates


def apart(a, b):
    (p, q), (r, s) = ((math.radians(x), math.radians(y)) for x, y in (a, b))
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2)))


def test_nearest_place_anywhere(spark):
    r = random.Random(1)
    at = lambda: (math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180))
    places = [at() for _ in range(40)] + [(90.0, 0.0), (-90.0, 12.0), (0.0, 180.0), (0.0, -179.999), (10.0, 10.0), (10.0, 10.0), (10.0, 10.00001)] + [(5 + r.random() / 100, 5 + r.random() / 100) for _ in range(60)]
    points = [at() for _ in range(60)] + [(89.9, 170.0), (-89.9, -170.0), (0.0, 179.9999), (0.0, -180.0), (10.0, 10.0), (-45.0, -175.0), (5.005, 5.005), (6.0, 6.0)]
    df = lambda xs, k: spark.createDataFrame([(i, *x) for i, x in enumerate(xs)] + [(1000, None, 1.0)], f"{k} int, lat double, lon double")
    got = {x.point: (x.place, x.metres) for x in geo.nearest_place(df(points, "point").union(df(points[:3], "point")), df(places, "place")).collect()}
    assert set(got) == set(range(len(points)))
    for i, p in enumerate(points):
        want = min((round(apart(p, q), 3), k) for k, q in enumerate(places))
        assert abs(got[i][1] - want[0]) < 0.002 and abs(apart(p, places[got[i][0]]) - want[0]) < 0.002
    assert got[points.index((10.0, 10.0))][0] == places.index((10.0, 10.0))
    assert geo.nearest_place(df(points, "point"), df([], "place")).collect() == []


def test_places_by_name(spark):
    places = spark.createDataFrame([(1, "Alto Selva Alegre"), (2, "Selva"), (3, "José Luis Bustamante y Rivero"), (4, "Alto"), (5, None), (6, "selva alta")], "place int, name string")
    queries = spark.createDataFrame([("a", "SELVA"), ("b", "al sel"), ("c", "jose b"), ("d", "x"), ("e", " "), ("f", None), ("g", "selvas")], "query string, text string")
    got = {}
    for r in geo.search_places(queries, places).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r.place, r.exact))
    assert got == {"a": [(2, 1), (6, 1), (1, 1)], "b": [(6, 0), (1, 0)], "c": [(3, 1)]}


def test_zones_with_holes_and_shared_edges(spark):
    ring = lambda *at: [{"x": float(x), "y": float(y)} for x, y in at]
    square = lambda x, y, s: ring((x, y), (x + s, y), (x + s, y + s), (x, y + s))
    zones = spark.createDataFrame([("left", [square(0, 0, 4), square(1, 1, 2)]), ("right", [square(4, 0, 4)]), ("vast", [square(-1e6, -1e6, 2e6)]), ("two", [square(0, 10, 1), square(5, 10, 1)]), ("none", [])], "zone string, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 4.0, 2.0), (4, 5.5, 10.5), (5, 3.0, 10.5), (6, None, 1.0), (7, 9e5, -9e5), (8, 2e6, 0.0)], "point int, x double, y double")
    got = {}
    for r in geo.zones_of(points, zones).collect():
        got.setdefault(r.point, set()).add(r.zone)
    assert got == {1: {"left", "vast"}, 2: {"vast"}, 3: {"right", "vast"}, 4: {"two", "vast"}, 5: {"vast"}, 7: {"vast"}}
    assert geo.zones_of(points, zones.filter("false")).collect() == []


def test_last_rate_that_is_not_later(spark):
    r = random.Random(2)
    t = lambda s: F.timestamp_seconds(F.col(s))
    ticks = [(r.choice("ab"), r.randrange(10**6), round(r.random(), 3)) for _ in range(300)] + [("a", 500_000, 0.1), ("a", 500_000, 0.2), (None, 1, 1.0)]
    asked = [(i, r.choice("abc"), r.randrange(-1000, 10**6)) for i in range(400)] + [(1000, "a", 500_000), (1001, None, 5), (1002, "a", None)]
    right = spark.createDataFrame(ticks, "k string, s long, rate double").select("k", t("s").alias("at"), "rate")
    left = spark.createDataFrame(asked, "id int, k string, s long").withColumn("at", t("s"))
    got = {x.id: (x.rate, x.s2) for x in rates.as_of(left, right, "at", "rate", ["k"], 3_600).withColumn("s2", F.unix_seconds("rate_at")).collect()}
    for i, k, s in asked:
        mine = [(at, x) for q, at, x in ticks if s is not None and q == k is not None and at <= s]
        assert got[i] == ((max(mine)[1], max(mine)[0]) if mine else (None, None))


def test_known_keys(spark):
    def key(body, image):
        units = lambda s: [int.from_bytes(s.encode("utf-16-be")[i : i + 2], "big") for i in range(0, 2 * len(s.encode("utf-16-be")) // 2, 2)]
        folded = units(" ".join((body or "").split()).lower())[:400]
        h = 0
        for u in folded + units(f"|{len(units(body or ''))}|{image or ''}"):
            h = (h * 31 + u + 2**31) % 2**32 - 2**31
        n, out = abs(h), ""
        while n or not out:
            out, n = "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36] + out, n // 36
        return "p_" + out

    rows = [("Vendo  TERRENO\nen Cayma", "https://i/1.jpg"), ("", None), (None, None), ("😀" * 250 + " é", "x"), ("a" * 399 + "😀 tail", ""), ("ñ" * 1_000, "https://i/2.jpg")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, body string, image string")
    got = {r.i: r.k for r in df.select("i", captures.synthetic_key(F.col("body"), F.col("image")).alias("k")).collect()}
    assert got == {i: key(*x) for i, x in enumerate(rows)}


def test_many_rates_of_one_hour(spark):
    """Questions and rates of one stretch of time meet in order, not each with all."""
    n = 40_000
    right = spark.range(n).select(F.lit("a").alias("k"), F.timestamp_millis(F.col("id") * 90).alias("at"), F.col("id").cast("double").alias("rate"))
    left = spark.range(n).select("id", F.lit("a").alias("k"), F.timestamp_millis(F.col("id") * 90 + 89).alias("at"))
    out = rates.as_of(left, right, "at", "rate", ["k"])
    assert "collect_set" not in out._jdf.queryExecution().toString()
    assert out.filter("rate = id").count() == n


def test_copies_of_names_and_of_queries(spark):
    """20,000 places and 20,000 queries of the same words make no pairs of rows."""
    n, began = 20_000, time.monotonic()
    places = spark.range(n).select((n - 1 - F.col("id")).alias("place"), F.lit("Selva Alegre").alias("name"))
    queries = spark.range(n).select(F.col("id").alias("query"), F.when(F.col("id") % 2 == 0, "al sel").otherwise("sel ALE").alias("text"))
    out = geo.search_places(queries, places).groupBy("place", "exact", "rank").count().orderBy("rank").collect()
    assert [tuple(r) for r in out] == [(i, 0, i + 1, n) for i in range(5)]
    assert time.monotonic() - began < 40
