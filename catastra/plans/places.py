"""Queries on places, zones, rates, keys and links, bound like those of bindings.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from catastra.functions import captures
from catastra.operators import geo, linkage, rates
from catastra.operators import search as listing
from catastra.plans.bindings import AUCTIONS, auctions_and_properties, bound, table

CUSTOMER_AT = "(c_custkey * 37 % 1000) / 1000.0 * 170 - 85 as lat, (c_custkey * 91 % 997) / 997.0 * 360 - 180 as lon"
SUPPLIER_AT = "(s_suppkey * 53 % 991) / 991.0 * 176 - 88 as lat, (s_suppkey * 29 % 983) / 983.0 * 360 - 180 as lon"


@bound(f"""
with c as (select c_custkey, {CUSTOMER_AT} from customer), s as (select s_suppkey, {SUPPLIER_AT} from supplier),
p as (select c_custkey as point, s_suppkey as place, round(2 * 6371008.8 * asin(least(1.0, sqrt(power(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * power(sin(radians(s.lon - c.lon) / 2), 2)))), 3) as metres from c, s)
select point, place, metres from p qualify row_number() over (partition by point order by metres, place) = 1""")
def nearest_places(spark, d):
    """S-10: of each customer the nearest supplier on the globe, however far."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, d, "customer").select(c.alias("point"), ((c * 37 % 1000) / 1000.0 * 170 - 85).alias("lat"), ((c * 91 % 997) / 997.0 * 360 - 180).alias("lon"))
    places = table(spark, d, "supplier").select(s.alias("place"), ((s * 53 % 991) / 991.0 * 176 - 88).alias("lat"), ((s * 29 % 983) / 983.0 * 360 - 180).alias("lon"))
    return geo.nearest_place(points, places)


@bound(r"""
with words as (select p_partkey as place, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[\p{L}\p{N}]+')) as w from part),
asked as (select c_custkey as query, regexp_extract_all(lower(substr(c_mktsegment, 1, 2) || ' ' || p_name), '[\p{L}\p{N}]+') as a from customer join part on p_partkey = c_custkey),
q as (select query, list_distinct([a[1], substr(a[2], 1, 4), a[3]]) as a from (select query, list_filter(a, lambda x: x is not null) as a from asked)),
q2 as (select query, list_filter(a, lambda x: x is not null and x <> '') as a from q),
found as (select query, place, len(list_intersect(a, w))::int as exact, len(w) as n from q2, words where len(list_filter(a, lambda x: len(list_filter(w, lambda y: starts_with(y, x))) > 0)) = len(a))
select query, place, exact, rank::int as rank from (select *, row_number() over (partition by query order by exact desc, n, place) as rank from found) where rank <= 5""")
def place_search(spark, d):
    """S-10: parts by the beginnings of their words; each customer asks with words of a part's name and of its own segment."""
    c, p = table(spark, d, "customer").select("c_custkey", "c_mktsegment"), table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", F.substring("c_mktsegment", 1, 2), "p_name")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    asked = c.join(p, F.col("p_partkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("query"), words.alias("a"))
    asked = asked.select("query", F.concat_ws(" ", F.get("a", F.lit(0)), F.substring(F.get("a", F.lit(1)), 1, 4), F.get("a", F.lit(2))).alias("text"))
    return geo.search_places(asked, p.select(F.col("p_partkey").alias("place"), F.concat_ws(" ", "p_name", "p_type").alias("name")))


ZONES = """
with n as (select n_nationkey as k, (n_nationkey * 7 % 25) / 25.0 * 80 as x, (n_nationkey * 11 % 25) / 25.0 * 40 as y, case when n_nationkey % 5 = 0 then 30.0 else 1.5 + n_nationkey % 4 end as r from nation),
zones as (select k as zone, x, y, r from n)"""


@bound(f"""{ZONES},
c as (select c_custkey as point, (c_custkey * 37 % 1009) / 1009.0 * 100 - 10 as px, (c_custkey * 91 % 1013) / 1013.0 * 60 - 10 as py from customer),
edges as (select zone, unnest([{{'ax': x - r, 'ay': y - r, 'bx': x + r, 'by': y - r}}, {{'ax': x + r, 'ay': y - r, 'bx': x, 'by': y + r}}, {{'ax': x, 'ay': y + r, 'bx': x - r, 'by': y - r}},
 {{'ax': x - r / 4, 'ay': y - r / 2, 'bx': x + r / 4, 'by': y - r / 2}}, {{'ax': x + r / 4, 'ay': y - r / 2, 'bx': x + r / 4, 'by': y - r / 4}}, {{'ax': x + r / 4, 'ay': y - r / 4, 'bx': x - r / 4, 'by': y - r / 4}}, {{'ax': x - r / 4, 'ay': y - r / 4, 'bx': x - r / 4, 'by': y - r / 2}}]) as e from zones)
select point, zone from c, edges group by point, zone, px, py having count(*) filter (where (e.ay > py) <> (e.by > py) and px < (e.bx - e.ax) * (py - e.ay) / (e.by - e.ay) + e.ax) % 2 = 1""")
def zoned_points(spark, d):
    """X-02: customers in zones made of the nations: triangles of several sizes with a rectangle cut out."""
    k, c = F.col("n_nationkey"), F.col("c_custkey")
    n = table(spark, d, "nation").select(k.alias("zone"), ((k * 7 % 25) / 25.0 * 80).alias("x"), ((k * 11 % 25) / 25.0 * 40).alias("y"), F.when(k % 5 == 0, 30.0).otherwise(1.5 + k % 4).alias("r"))
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    ring = lambda *at: F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in at])
    rings = F.array(ring((x - r, y - r), (x + r, y - r), (x, y + r)), ring((x - r / 4, y - r / 2), (x + r / 4, y - r / 2), (x + r / 4, y - r / 4), (x - r / 4, y - r / 4)))
    points = table(spark, d, "customer").select(c.alias("point"), ((c * 37 % 1009) / 1009.0 * 100 - 10).alias("x"), ((c * 91 % 1013) / 1013.0 * 60 - 10).alias("y"))
    return geo.zones_of(points, n.select("zone", rings.alias("rings")))


@bound("""
with r as (select case when event_id % 3 = 0 then 'b' else 'a' end as bank, ts::timestamp as at, max(3 + value / 1000) as rate from events group by 1, 2),
o as (select o_orderkey, case when o_orderkey % 2 = 0 then 'a' else 'b' end as bank, timestamp '2023-12-31 12:00:00' + to_minutes((o_orderkey % 44640)::bigint) as at, o_totalprice as amount, ['USD', 'PEN', 'EUR'][o_orderkey % 3 + 1] as currency from orders)
select o_orderkey, currency, epoch_us(r.at) as rated_us, round(rate, 6) as rate, round(case currency when 'USD' then amount when 'PEN' then amount / rate end, 2) as price_usd, round(case currency when 'PEN' then amount when 'USD' then amount * rate end, 2) as price_pen
from o asof left join r on o.bank = r.bank and o.at >= r.at""")
def rated_prices(spark, d):
    """X-05: orders in dollars and soles at the last rate of their bank, made of the events."""
    k = F.col("o_orderkey")
    r = table(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, "b").otherwise("a").alias("bank"), F.col("ts").cast("timestamp_ntz").cast("timestamp").alias("at"), (3 + F.col("value") / 1000).alias("rate"))
    at = F.timestamp_seconds(F.lit(1704024000) + (k % 44640) * 60)
    o = table(spark, d, "orders").select("o_orderkey", F.when(k % 2 == 0, "a").otherwise("b").alias("bank"), at.alias("at"), "o_totalprice", F.element_at(F.array(F.lit("USD"), F.lit("PEN"), F.lit("EUR")), (k % 3 + 1).cast("int")).alias("currency"))
    out = rates.as_of(o, r, "at", "rate", ["bank"])
    return out.select("o_orderkey", "currency", F.unix_micros("rate_at").alias("rated_us"), F.round("rate", 6).alias("rate"), *rates.in_both(F.col("o_totalprice").cast("double"), F.col("currency"), F.col("rate")))


UNITS = "flatten(list_transform({c}, lambda x: case when unicode(x) < 65536 then [unicode(x)::bigint] else [55296 + (unicode(x) - 65536) // 1024, 56320 + (unicode(x) - 65536) % 1024] end))"


@bound(f"""
with t as (select doc_id, coalesce(text, '') || case when doc_id % 3 = 0 then ' 😀𝒳' else '' end as t, case when doc_id % 2 = 0 then source else '' end as image from documents),
c as (select doc_id, regexp_extract_all(lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))), '(?s).') as body, regexp_extract_all(t, '(?s).') as raw, image from t),
u as (select doc_id, {UNITS.format(c="body")}[1:400] as body, len({UNITS.format(c="raw")}) as n, image from c),
s as (select doc_id, list_concat(body, {UNITS.format(c="regexp_extract_all('|' || n || '|' || image, '(?s).')")}) as units from u),
h as (select doc_id, list_reduce(list_prepend(0::bigint, units), lambda h, x: (h * 31 + x) % 4294967296) as h from s),
a as (select doc_id, case when h >= 2147483648 then 4294967296 - h else h end as h from h)
select doc_id, 'p_' || list_aggregate(list_transform(list_filter(range(6, -1, -1), lambda i: i = 0 or h >= (36 ** i)::bigint), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', ((h // (36 ** i)::bigint) % 36)::int + 1, 1)), 'string_agg', '') as key from a""")
def synthetic_keys(spark, d):
    """C-18: keys of all documents; every third ends in characters beyond the basic plane."""
    docs = table(spark, d, "documents")
    body = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, " 😀𝒳").otherwise(""))
    return docs.select("doc_id", captures.synthetic_key(body, F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("key"))


@bound("""
with p as (select page_id, case when page_id % 5 = 0 then upper(split_part(url, '/', 3)) else '' end as fuente, case page_id % 4 when 0 then url || '?from=UrbaniA' when 1 then replace(url, '/', '/groups/') else url end as url, case page_id % 7 when 0 then 'av-' || page_id when 1 then page_id || '_1' when 2 then 'urb-' || page_id else page_id::varchar end as id from pages),
s as (select page_id, case when fuente <> '' then lower(fuente) when contains(lower(url), 'adondevivir') or starts_with(id, 'av-') then 'adondevivir' when contains(lower(url), 'urbania') or starts_with(id, 'urb-') then 'urbania' when contains(lower(url), '/groups/') or contains(id, '_') then 'grupo' else 'marketplace' end as src from p)
select page_id, src as source, contains(src, 'a') and contains(src, 'r') as chosen from s""")
def listing_sources(spark, d):
    """F-04: the source that is stored, or that link and key tell, and a search for parts of its name."""
    k, n = F.col("page_id"), F.col("page_id").cast("string")
    stored = F.when(k % 5 == 0, F.upper(F.split_part("url", F.lit("/"), F.lit(3))))
    link = F.when(k % 4 == 0, F.concat("url", F.lit("?from=UrbaniA"))).when(k % 4 == 1, F.replace("url", F.lit("/"), F.lit("/groups/"))).otherwise(F.col("url"))
    key = F.when(k % 7 == 0, F.concat(F.lit("av-"), n)).when(k % 7 == 1, F.concat(n, F.lit("_1"))).when(k % 7 == 2, F.concat(F.lit("urb-"), n)).otherwise(n)
    return table(spark, d, "pages").select("page_id", listing.listing_source(stored, link, key).alias("source"), (listing.of_source(stored, link, key, "A") & listing.of_source(stored, link, key, "r")).alias("chosen"))


@bound(f"""
with {AUCTIONS},
pn as (select property, number from p union all select property, 'EXTRA' || (property % 9) from p where property % 3 = 0),
an as (select auction, number, w, district from a union all select -auction, 'EXTRA' || auction, w, district from a where auction < 9),
links as (select auction, property, 1.0 as score, 'partida' as match_type, 'high' as confidence from an join pn using (number)
union all select auction, property, round(ratio * case when place then 0.8 else 0.5 end, 2), 'address', case when ratio >= 0.6 and place then 'medium' else 'low' end from (select auction, property, contains(an.district, p.district) or contains(p.district, an.district) as place, len(list_intersect(list_filter(an.w, lambda x: x <> 'urb'), p.w)) / least(2, len(p.w)) as ratio from an, p) where ratio > 0
union all select auction, property, 0.3, 'district', 'low' from an, p where contains(an.district, p.district) or contains(p.district, an.district))
select auction, property, match_type, score::double as score, confidence from links qualify row_number() over (partition by auction order by score desc, property, match_type, confidence) = 1""")
def best_auction_links(spark, d):
    """J-13: of each auction the best link; a third of the properties have two registry numbers."""
    a, p = auctions_and_properties(spark, d)
    numbers = p.select("property", "number").unionByName(p.filter("property % 3 = 0").select("property", F.concat(F.lit("extra"), (F.col("property") % 9).cast("string")).alias("number")))
    more = a.filter("auction < 9").select((-F.col("auction")).alias("auction"), F.concat(F.lit("EXTRA-"), F.col("auction").cast("string")).alias("number"), "address", "district")
    return linkage.best_links(a.unionByName(more), p, numbers)
