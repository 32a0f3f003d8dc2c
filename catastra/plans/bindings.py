"""Query names bound to the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catastra.functions import rules, text
from catastra.operators import history, html, linkage, records, research, resolve
from catastra.operators import search as listing
from catastra.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: DuckDB's form of text.BLANKS and of the folded text.
SP = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
AS_OF = "2024-02-01 00:00:00"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def fold_sql(x: str) -> str:
    return trim_sql(f"regexp_replace({x}, '{SP}+', ' ', 'g')")


def bound(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- search, paging, facets ------------------------------------------------------------------------------------------


@bound("""
select o_orderkey, o_orderpriority, o_orderstatus, o_orderdate, o_totalprice from orders
where lower(o_orderpriority) in ('1-urgent', '2-high') and o_orderstatus = 'O'
  and epoch_us(timestamp '1998-08-02' - o_orderdate) / 86400e6 <= 400
order by o_orderdate desc, o_orderkey limit 20""")
def listing_search_page(spark, d):
    """S-01, S-07, F-01, F-03, F-05, O-01, O-02, P-01: the first page of filtered orders, newest first."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate", "o_totalprice")
    rows = o.filter(listing.in_list(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]) & (F.col("o_orderstatus") == "O") & listing.within_days(F.col("o_orderdate"), "1998-08-02", 400))
    return listing.page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 1, 20)


@bound("""
select c_custkey, c_name, c_mktsegment from customer
where contains(lower(concat_ws(' ', c_custkey::varchar, c_name, c_nationkey::varchar, c_mktsegment)), 'build') and c_nationkey in (1, 3, 5)
order by c_custkey limit 25 offset 25""")
def full_row_search(spark, d):
    """F-07, F-08, F-09, O-02: the second page of a search through all values of a row."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    rows = c.filter(listing.any_value_contains([F.col(x) for x in c.columns], "Build") & F.col("c_nationkey").isin(1, 3, 5))
    return listing.page(rows, [F.asc("c_custkey")], 2, 25).drop("c_nationkey")


@bound("select distinct 'o_orderstatus' as facet, o_orderstatus as value from orders where o_orderstatus <> '' union select distinct 'o_orderpriority', o_orderpriority from orders where o_orderpriority <> ''")
def listing_facets(spark, d):
    """A-02."""
    return listing.facets(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@bound("select count(*) as total, ceil(count(*) / 20.0)::bigint as total_pages from orders")
def page_count(spark, d):
    """A-01, A-18, O-07."""
    return listing.total_pages(table(spark, d, "orders"), 20)


@bound("select event_id, strftime(ts, '%Y-%m-%d') as day from events where strftime(ts, '%Y-%m-%d') >= '2024-01-26' and strftime(ts, '%Y-%m-%d') <= '2024-01-28'")
def since_day(spark, d):
    """F-06, C-42: the last days by text comparison."""
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return e.filter(listing.since_day(F.col("day"), "2024-01-28", 3) & (F.col("day") <= "2024-01-28")).select("event_id", "day")


@bound("select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def top_listings(spark, d):
    """O-03, O-05: top k; Spark keeps k rows a task."""
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@bound("select part.p_partkey, list_position(['SMALL', 'MEDIUM', 'LARGE', 'ECONOMY', 'STANDARD', 'PROMO'], split_part(p_type, ' ', 1))::int as ordinal from part order by ordinal, p_partkey limit 50")
def enum_order(spark, d):
    """O-04: by an enum's own order, not its alphabet."""
    order = F.array(*[F.lit(x) for x in ("SMALL", "MEDIUM", "LARGE", "ECONOMY", "STANDARD", "PROMO")])
    kind = F.array_position(order, F.substring_index("p_type", " ", 1)).cast("int")
    return table(spark, d, "part").select("p_partkey", F.when(kind > 0, kind).alias("ordinal")).orderBy(F.asc_nulls_last("ordinal"), "p_partkey").limit(50)


# ---- scalar functions ------------------------------------------------------------------------------------------------


@bound("""
with n as (select o_orderkey, o_totalprice, (o_totalprice * 100)::bigint as cents from orders),
t as (select o_orderkey, case o_orderkey % 5 when 0 then (cents // 100)::varchar || '.' || lpad((cents % 100)::varchar, 2, '0') when 1 then (cents // 100000)::varchar || ',' || lpad((cents // 100 % 1000)::varchar, 3, '0') when 2 then (cents // 100000)::varchar || '.' || lpad((cents // 100 % 1000)::varchar, 3, '0') when 3 then (cents // 100000)::varchar || ',' || lpad((cents // 100 % 1000)::varchar, 3, '0') || '.5' else (cents // 100)::varchar end as raw from n)
select o_orderkey, raw, case when contains(raw, ',') then replace(raw, ',', '')::double when contains(raw, '.') and length(split_part(raw, '.', -1)) = 3 then replace(raw, '.', '')::double else raw::double end as value from t""")
def clean_number(spark, d):
    """C-06 on amounts written in five ways."""
    return amounts(spark, d).withColumn("value", text.clean_number(F.col("raw"))).drop("kind")


def amounts(spark, d) -> DataFrame:
    cents = (F.col("o_totalprice") * 100).cast("decimal(20,6)")
    cents = F.round(cents, 0).cast("long")
    whole, part = F.floor(cents / 100).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    thousands, rest = F.floor(cents / 100000).cast("string"), F.lpad((F.floor(cents / 100) % 1000).cast("string"), 3, "0")
    raw = F.when(F.col("kind") == 0, F.concat_ws(".", whole, part)).when(F.col("kind") == 1, F.concat_ws(",", thousands, rest)).when(F.col("kind") == 2, F.concat_ws(".", thousands, rest)).when(F.col("kind") == 3, F.concat(thousands, F.lit(","), rest, F.lit(".5"))).otherwise(whole)
    return table(spark, d, "orders").withColumn("kind", F.col("o_orderkey") % 5).select("o_orderkey", "kind", raw.alias("raw"))


@bound("""
with t as (select o_orderkey, case o_orderkey % 4 when 0 then 'Terreno S/ ' when 1 then 'Casa US$ ' when 2 then 'Lote ' else 'Depa a ' end || (1000 + o_orderkey % 90000)::varchar || case o_orderkey % 4 when 3 then ' soles' else ' fijo' end as t from orders)
select o_orderkey, (1000 + o_orderkey % 90000)::double as price, case o_orderkey % 4 when 0 then 'PEN' when 1 then 'USD' else '(no indicado)' end as currency from t""")
def price_parse(spark, d):
    """C-07 on made-up offers."""
    k = F.col("o_orderkey")
    offer = F.concat(F.when(k % 4 == 0, "Terreno S/ ").when(k % 4 == 1, "Casa US$ ").when(k % 4 == 2, "Lote ").otherwise("Depa a "), (k % 90000 + 1000).cast("string"), F.when(k % 4 == 3, " soles").otherwise(" fijo"))
    return table(spark, d, "orders").select("o_orderkey", text.parse_price(offer).alias("p")).select("o_orderkey", "p.price", "p.currency")


@bound("""
with t as (select o_orderkey, case o_orderkey % 4 when 0 then 'P-' || o_orderkey when 1 then 'p ' || o_orderkey when 2 then '110' || lpad(o_orderkey::varchar, 8, '0') else 'P' || (o_orderkey * 1000000007)::varchar end as raw from orders),
c as (select *, regexp_replace(regexp_replace(upper(raw), '\\s+', '', 'g'), '^P[.\\-_]?', '') as s from t),
g as (select *, regexp_replace(s, '[^0-9]', '', 'g') as dg from c),
k as (select *, case when length(dg) >= 10 and starts_with(dg, '110') then substr(dg, 4) else dg end as core, case when length(dg) >= 10 and starts_with(dg, '110') then '110' end as area from g)
select o_orderkey, dg <> '' and length(core) <= 8 as ok, case when dg <> '' and length(core) <= 8 then 'P-' || lpad(core, 8, '0') end as number, case when dg <> '' and length(core) <= 8 then lpad(core, 8, '0') end as digits, area from k""".replace("\\\\", "\\"))
def registry_number(spark, d):
    """C-29."""
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("P-"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("p "), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("110"), F.lpad(k.cast("string"), 8, "0"))).otherwise(F.concat(F.lit("P"), (k * 1000000007).cast("string")))
    return table(spark, d, "orders").select("o_orderkey", text.registry_number(raw).alias("r")).select("o_orderkey", "r.*")


@bound("""
select page_id, case when contains(lower(url), 'example') then 'adondevivir' when contains(lower(url), 'org') then 'urbania' when contains(url, '_') then 'facebook_group' else 'facebook_marketplace' end as source_type,
case when coalesce(url, '') in ('', '#') then '' when regexp_matches(url, '/groups/[^/?#]+/(?:posts|permalink|multi_permalink)/\\d+|[?&]multi_permalinks=\\d+|[?&]set=gm\\.\\d+|facebook\\.com/share/[a-z]/[A-Za-z0-9]+') then 'permalink' when contains(url, '/search/?q=') then 'search' when contains(url, '/groups/') then 'group_root' else 'direct' end as link_status
from pages""".replace("\\\\", "\\"))
def source_and_link(spark, d):
    """F-16 on the addresses of pages, with a rule of its own for their kind."""
    p = table(spark, d, "pages")
    s = F.lower("url")
    kind = F.when(s.contains("example"), "adondevivir").when(s.contains("org"), "urbania").when(F.col("url").contains("_"), "facebook_group").otherwise("facebook_marketplace")
    return p.select("page_id", kind.alias("source_type"), text.link_status(F.col("url")).alias("link_status"))


@bound(f"""
select doc_id, sha256(concat_ws('|', {trim_sql("lower(split_part(text, chr(10), 1))")}, regexp_replace(n_chars::varchar, '[^0-9]', '', 'g'), {fold_sql("lower(text)")})) as content_hash from documents""")
def content_hash(spark, d):
    """C-01."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.substring_index(t, "\n", 1), F.col("n_chars").cast("string"), t).alias("content_hash"))


@bound("select doc_id, list_distinct(regexp_extract_all(text, '[a-zA-Z0-9._-]+@[a-z0-9-]+\\.[a-z]+')).len()::int as n, coalesce(regexp_extract(text, '[a-zA-Z0-9._-]+@[a-z0-9-]+\\.[a-z]+'), '') as first from documents".replace("\\\\", "\\"))
def text_extract_distinct(spark, d):
    """C-05's shape with another pattern: distinct matches in order."""
    p = r"[a-zA-Z0-9._-]+@[a-z0-9-]+\.[a-z]+"
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(p), 0))
    return table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.size(found).alias("n"), F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("first"))


@bound("select c_custkey, lower(strip_accents(replace(c_name, 'o', 'ó'))) as plain, list_sort(list_filter(list_distinct(string_split_regex(trim(regexp_replace(lower(strip_accents(c_name || ' de la calle ' || c_mktsegment)), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')), lambda x: x not in ('de', 'la', 'calle', ''))).array_to_string(' ') as tokens from customer".replace("\\\\", "\\"))
def address_tokens(spark, d):
    """C-23, C-37."""
    raw = F.concat(F.col("c_name"), F.lit(" de la calle "), F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.lower(text.strip_accents(F.replace("c_name", F.lit("o"), F.lit("ó")))).alias("plain"), F.array_join(F.array_sort(text.address_tokens(raw)), " ").alias("tokens"))


@bound("""
with t as (select o_orderkey, lpad((o_orderkey % 35)::varchar, 2, '0') || '/' || lpad((o_orderkey % 14)::varchar, 2, '0') || '/' || strftime(o_orderdate, '%Y') as dmy, case when o_orderkey % 3 = 0 then strftime(o_orderdate, ' %Y-%m-%d') else dmy end as raw from orders)
select o_orderkey, raw, case when o_orderkey % 3 = 0 then trim(raw) when substr(raw, 1, 2)::int between 1 and 31 and substr(raw, 4, 2)::int between 1 and 12 then substr(raw, 7) || '-' || substr(raw, 4, 2) || '-' || substr(raw, 1, 2) end as iso from t""")
def date_iso(spark, d):
    """C-10: ranges alone are tested, so 31/02 stays; ISO dates stay."""
    k = F.col("o_orderkey")
    raw = F.concat_ws("/", F.lpad((k % 35).cast("string"), 2, "0"), F.lpad((k % 14).cast("string"), 2, "0"), F.date_format("o_orderdate", "yyyy"))
    raw = F.when(k % 3 == 0, F.date_format("o_orderdate", " yyyy-MM-dd")).otherwise(raw)
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw")).withColumn("iso", text.date_iso(F.col("raw")))


@bound("""
with t as (select s_suppkey, case s_suppkey % 4 when 0 then '50%' when 1 then '0.25' when 2 then '120' else '33,335' end as share, case s_suppkey % 3 when 0 then 'Embargo judicial' when 1 then 'HIPOTECA legal' else 'otra' end as charge, case s_suppkey % 3 when 0 then 'Vigente' when 1 then 'cancelada' else '' end as state, case s_suppkey % 2 when 0 then 'US$' else 'soles' end as money from supplier)
select s_suppkey, case s_suppkey % 4 when 0 then 50.0 when 1 then 25.0 when 3 then 33.34 end::double as percentage, case s_suppkey % 3 when 0 then 'embargo' when 1 then 'hipoteca' else 'other' end as charge_type, case s_suppkey % 3 when 0 then 'si' when 1 then 'no' else 'unknown' end as active, case s_suppkey % 2 when 0 then 'USD' else 'PEN' end as currency from t""")
def registry_fields(spark, d):
    """C-31, C-32."""
    k = F.col("s_suppkey")
    share = F.when(k % 4 == 0, "50%").when(k % 4 == 1, "0.25").when(k % 4 == 2, "120").otherwise("33,335")
    charge = F.when(k % 3 == 0, "Embargo judicial").when(k % 3 == 1, "HIPOTECA legal").otherwise("otra")
    state = F.when(k % 3 == 0, "Vigente").when(k % 3 == 1, "cancelada").otherwise("")
    return table(spark, d, "supplier").select("s_suppkey", text.ownership_percentage(share).alias("percentage"), text.charge_type(charge).alias("charge_type"), text.is_active(state).alias("active"), text.registry_currency(F.when(k % 2 == 0, "US$").otherwise("soles")).alias("currency"))


@bound("select o_orderkey, greatest(0.0, epoch_us(timestamp '1998-01-01' - o_orderdate) / 3600e6) as hours from orders")
def hours_since(spark, d):
    """C-41."""
    return table(spark, d, "orders").select("o_orderkey", text.hours_between(F.col("o_orderdate"), F.lit("1998-01-01").cast("timestamp_ntz")).alias("hours"))


@bound("""
select c_custkey, c_custkey::varchar || ',' || '"' || replace(c_name, 'Customer', 'Cust "o" mer') .replace('"', '""') || '"' || ',' || c_mktsegment as line from customer""")
def csv_line(spark, d):
    """K-06, C-43: one line of the export."""
    name = F.replace("c_name", F.lit("Customer"), F.lit('Cust "o" mer'))
    return table(spark, d, "customer").select("c_custkey", F.concat_ws(",", text.csv_field(F.col("c_custkey")), text.csv_field(name), text.csv_field(F.col("c_mktsegment"))).alias("line"))


# ---- rules -----------------------------------------------------------------------------------------------------------


@bound("select case when contains(lower(text), 'license') then false when contains(lower(text), 'the ') or contains(lower(text), ' der ') then true else false end as relevant, count(*) as n from documents where text is not null group by 1")
def purge_irrelevant(spark, d):
    """F-11, K-05: the classifier with other words; how many stay and go."""
    relevant = rules.is_relevant(F.col("text"), ["license"], ["the ", " der "])
    return table(spark, d, "documents").filter(F.col("text").isNotNull()).groupBy(relevant.alias("relevant")).agg(F.count(F.lit(1)).alias("n"))


@bound(r"""
select doc_id, case when regexp_matches(text, '(?i)tion') then 'latin' when regexp_matches(text, '(?i)sch') then 'german' when regexp_matches(text, '(?i)ñ') then 'spanish' else 'other' end as category from documents where text is not null""")
def first_match_category(spark, d):
    """J-14, C-12: the first rule of a table that holds."""
    table_ = [("latin", "tion"), ("german", "sch"), ("spanish", "ñ")]
    return table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", rules.first_rule(F.col("text"), table_, "other").alias("category"))


# ---- sets, writes, resolution ----------------------------------------------------------------------------------------


@bound("""
with first as (select user_id, event_type, arg_min(event_id, (ts, event_id)) as event_id from events group by 1, 2)
select * from first""")
def keep_first_insert(spark, d):
    """K-01, K-09, R-07, U-04."""
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return resolve.earliest(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@bound("""
with new as (select user_id, event_type, arg_max(value, (ts, event_id)) as value from events where event_id % 3 = 0 group by 1, 2),
old as (select user_id, event_type, arg_min(value, (ts, event_id)) as value from events where event_id % 3 <> 0 group by 1, 2)
select * from new union all select old.* from old anti join new using (user_id, event_type)""")
def upsert_last(spark, d):
    """K-02, S-02: an upsert of a third of the events into the rest."""
    e = table(spark, d, "events").select("user_id", "event_type", "value", "ts", "event_id")
    key = ["user_id", "event_type"]
    order = [F.col("ts"), F.col("event_id")]
    old = resolve.earliest(e.filter("event_id % 3 <> 0"), key, order)
    return resolve.upsert(old, e.filter("event_id % 3 = 0"), key, order).select("user_id", "event_type", "value")


@bound("select c_custkey, case when c_custkey % 10 = 0 then 'patched' else c_name end as c_name, case when c_custkey % 20 = 0 then -1.0 else c_acctbal end as c_acctbal from customer")
def patch_rows(spark, d):
    """K-03: only fields that a patch names change."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    changes = c.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("patched").alias("c_name"), F.when(F.col("c_custkey") % 20 == 0, -1.0).alias("c_acctbal"))
    return resolve.patch(c, changes, "c_custkey")


@bound("select count(*) filter (where not p_name like 'a_%') as kept, count(*) filter (where p_name like 'a_%') as purged from part")
def delete_like(spark, d):
    """S-06, K-04: _ stands for any one character."""
    return resolve.purge(table(spark, d, "part"), ~F.col("p_name").like("a_%"))[1]


RESOLVED = f"""
with h as (select doc_id, coalesce(source, '') as source, sha256(concat_ws('|', '', '', {fold_sql("lower(coalesce(text, ''))")})) as digest from documents),
old as (select * from h where doc_id % 4 = 0), new as (select * from h where doc_id % 4 <> 0 or doc_id % 8 = 0),
p as (select digest, min(doc_id) as first, count(*) as n from old group by 1),
known as (select o.source, o.doc_id, lpad(p.first::varchar, 12, '0') as property from old o join p using (digest)),
j as (select n.*, k.property as p1, lpad(p.first::varchar, 12, '0') as p2, coalesce(p.n, 0) as old_n from new n left join known k on k.source = n.source and k.doc_id = n.doc_id left join p on p.digest = n.digest),
f as (select digest, min(doc_id) as first, count(*) as n from j where p1 is null group by 1)
select j.doc_id, case when p1 is not null then 'updated' when p2 is null and j.doc_id = f.first then 'created' else 'linked' end as action,
coalesce(p1, p2, (select concat(h2.source, ':', h2.doc_id) from h h2 where h2.doc_id = f.first)) as property, old_n + coalesce(f.n, 0) as listing_count
from j left join f using (digest)"""


def resolved(spark, d):
    h = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), text.content_hash(F.lit(""), F.lit(""), F.col("text")).alias("digest"))
    old, new = h.filter("doc_id % 4 = 0"), h.filter("doc_id % 4 <> 0 or doc_id % 8 = 0")
    first = old.groupBy("digest").agg(F.min("doc_id").alias("first"))
    existing = old.join(first, "digest").withColumn("property", F.lpad(F.col("first").cast("string"), 12, "0"))
    out = resolve.resolve_properties(new.withColumn("external", F.col("doc_id").cast("string")), existing.withColumn("external", F.col("doc_id").cast("string")), "source", "external", "digest", "doc_id")
    return out.select("doc_id", "action", "property", "listing_count")


@bound(RESOLVED)
def content_hash_resolution(spark, d):
    """D-01, K-08, J-12, C-01, A-14: listings to properties, a quarter of the documents being known."""
    return resolved(spark, d)


@bound(f"select action, count(*) as n from ({RESOLVED}) group by 1")
def ingest_summary(spark, d):
    """A-13."""
    return resolved(spark, d).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@bound("""
with t as (select *, case when page_id % 3 = 0 then 'g_' || page_id else 'syn-' || page_id end as key, 'u' || (page_id // 3) as href from pages)
select page_id, key from t where not starts_with(key, 'syn-') or href not in (select href from t where not starts_with(key, 'syn-'))""")
def consolidate_keys(spark, d):
    """D-04."""
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("g_"), "page_id")).otherwise(F.concat(F.lit("syn-"), "page_id")).alias("key"), F.concat(F.lit("u"), F.floor(F.col("page_id") / 3).cast("string")).alias("href"))
    return resolve.consolidate(p, "key", "href", F.col("key").startswith("syn-")).select("page_id", "key")


# ---- joins and aggregates --------------------------------------------------------------------------------------------


@bound("select o_orderkey, l_linenumber, l_quantity from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'O' and l_returnflag = 'N' and l_quantity > 45")
def case_task_join(spark, d):
    """J-01, F-10."""
    o = table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_orderkey")
    task = table(spark, d, "lineitem").filter("l_returnflag = 'N' and l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return o.join(task, "o_orderkey")


@bound("select o_orderkey, o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')")
def results_of_case(spark, d):
    """F-10: a semi-join; no ids are collected."""
    r = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(r, "o_orderkey", "left_semi")


STATUS = "case l_returnflag when 'R' then 'failed' when 'A' then 'completed' else case l_linestatus when 'O' then 'requires_manual_action' else 'running' end end"


@bound(f"""
with t as (select l_orderkey, {STATUS} as s from lineitem),
g as (select l_orderkey, count(*) as total, count(*) filter (where s in ('completed', 'failed', 'skipped', 'unavailable', 'blocked', 'requires_manual_action')) as settled, count(*) filter (where s = 'failed') as failed, count(*) filter (where s in ('requires_manual_action', 'blocked', 'unavailable')) as warnings from t group by 1)
select *, case when settled < total then 'running' when failed > 0 then 'partial' else 'completed' end as case_status from g""")
def case_progress(spark, d):
    """A-06."""
    return research.progress(table(spark, d, "lineitem").select("l_orderkey", F.expr(STATUS).alias("status")), "l_orderkey", "status")


@bound("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::int as run_number from orders")
def run_number(spark, d):
    """W-01."""
    return research.number_runs(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "run_number")


@bound("select o_custkey, max(o_orderkey) + 1 as next_run, arg_max(o_orderstatus, o_orderkey) as latest from orders group by 1")
def next_run(spark, d):
    """A-07, W-03."""
    o = table(spark, d, "orders")
    return research.next_run(o, "o_custkey", "o_orderkey").join(o.groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("latest")), "o_custkey")


DIFF = """
with r as (select user_id, date_diff('day', date '2024-01-01', ts::date)::int as run, event_type, count(*) as n from events group by 1, 2, 3),
runs as (select distinct user_id, run from r),
past as (select p.user_id, p.run + 1 as run, p.event_type, p.n from r p semi join runs on runs.user_id = p.user_id and runs.run = p.run + 1)
select coalesce(r.user_id, past.user_id) as user_id, coalesce(r.run, past.run) as run, coalesce(r.event_type, past.event_type) as event_type,
case when past.n is null then 'added' when r.n is null then 'removed' when r.n = past.n then 'unchanged' else 'edited' end as change
from r full join past on r.user_id = past.user_id and r.run = past.run and r.event_type = past.event_type"""


@bound(DIFF)
def run_diff(spark, d):
    """W-02, J-11, A-09, J-05: a user's days as runs."""
    e = table(spark, d, "events")
    r = e.groupBy("user_id", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("run"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return history.run_diff(r, "user_id", "run", ["event_type"], "n")


@bound("""
with p as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as previous from events)
select event_id, previous, event_type, previous is null or previous = event_type or (previous = 'signup' and event_type in ('view', 'click')) or (previous = 'view' and event_type in ('click', 'error')) or (previous = 'click' and event_type in ('purchase', 'view', 'error')) as valid from p""")
def transition_validity(spark, d):
    """W-05, T-01, T-03: another graph on events."""
    graph = {"signup": ["view", "click"], "view": ["click", "error"], "click": ["purchase", "view", "error"], "purchase": [], "error": []}
    return research.transitions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", graph).select("event_id", "previous", "event_type", "valid")


@bound("select count(*) as total, count(*) filter (where event_type = 'view') as n_view, count(*) filter (where event_type = 'click') as n_click, count(*) filter (where event_type = 'cancelled') as n_cancelled from events")
def status_counts(spark, d):
    """A-03: a state that never occurs counts 0."""
    return records.status_counts(table(spark, d, "events"), "event_type", ["view", "click", "cancelled"])


@bound("""
with s as (select user_id, min(ts) filter (where event_type = 'signup') as a, min(ts) filter (where event_type = 'purchase') as b from events group by 1)
select round(avg(case when a is not null and b is not null then greatest(0.0, epoch_us(b - a) / 3600e6) end), 6) as mean_hours from s""")
def manual_cycle(spark, d):
    """A-04, C-41."""
    s = table(spark, d, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("a"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("b"))
    return records.mean_hours(s, "a", "b").select(F.round("mean_hours", 6).alias("mean_hours"))


@bound("select event_type, count(*) as n, count(distinct user_id) as users, round(sum(value), 4) as total from events group by 1")
def results_by_source(spark, d):
    """A-05, A-15."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


STALE = f"greatest(0.0, epoch_us(timestamp '{AS_OF}' - ts) / 3600e6)"


@bound(f"""
select 'pending' as kind, event_id as id, {STALE} as age_hours from events where event_type = 'error' and {STALE} > 600
union all select 'orphan', event_id, {STALE} from events e where event_type = 'signup' and {STALE} > 600 and not exists (select 1 from events p where p.event_type = 'purchase' and p.user_id = e.user_id)""")
def stuck_work(spark, d):
    """F-14, J-10, U-01, O-05."""
    e = table(spark, d, "events")
    bought = e.filter("event_type = 'purchase'").select("user_id")
    old = lambda rows: records.stale(rows, "ts", AS_OF, 600)
    return records.stuck({"pending": old(e.filter("event_type = 'error'")), "orphan": old(records.orphans(e.filter("event_type = 'signup'"), bought, "user_id"))}, "event_id")


@bound("""
select l_orderkey, count(*) as charges, count(*) filter (where l_linestatus = 'O') as active, count(*) filter (where l_linestatus = 'F') as inactive,
round(coalesce(sum(case when l_linestatus = 'O' and l_returnflag = 'N' then l_extendedprice end), 0.0), 2) as debt_n, round(coalesce(sum(case when l_linestatus = 'O' and l_returnflag = 'R' then l_extendedprice end), 0.0), 2) as debt_r,
max(l_shipdate) as last_date, case when count(*) filter (where l_linestatus = 'O') > 0 then 'cargado' else 'sano' end as state from lineitem group by 1""")
def registry_state(spark, d):
    """A-08."""
    open_ = F.col("l_linestatus")
    return records.registry_state(table(spark, d, "lineitem"), "l_orderkey", open_ == "O", open_ == "F", F.col("l_extendedprice"), F.col("l_returnflag"), F.col("l_shipdate"), ["N", "R"])


@bound("""
with o as (select o_custkey, count(*) as orders, sum(case when o_orderstatus = 'O' then 1 else 0 end)::bigint as open, max(o_totalprice) as dearest from orders group by 1),
l as (select o_custkey, count(*) as lines, sum(l_returnflag = 'R')::bigint as returned from orders join lineitem on l_orderkey = o_orderkey group by 1),
c as (select c_custkey, coalesce(orders, 0) as orders, coalesce(open, 0) as open, dearest, coalesce(lines, 0) as lines, coalesce(returned, 0) as returned, c_acctbal from customer left join o on o.o_custkey = c_custkey left join l on l.o_custkey = c_custkey)
select c_custkey, 'runs' as finding, case when orders > 0 then 'fact' else 'gap' end as kind from c union all
select c_custkey, 'charges', case when returned > 0 then 'risk' else 'fact' end from c where lines > 0 union all
select c_custkey, 'open', 'risk' from c where open > 5 union all
select c_custkey, 'balance', 'alert' from c where c_acctbal < 0""")
def dossier_findings(spark, d):
    """A-10, J-02 to J-05: the report of each customer in long form."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    by = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    line = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    deep = o.join(line, o.o_orderkey == line.l_orderkey).groupBy("o_custkey").agg(F.sum("lines").alias("lines"), F.sum("returned").alias("returned"))
    c = table(spark, d, "customer").join(by.join(deep, "o_custkey", "left").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left").na.fill(0, ["orders", "open", "lines", "returned"])
    fact = F.lit("fact")
    return records.findings(c, "c_custkey", [("runs", F.lit(True), F.when(F.col("orders") > 0, fact).otherwise("gap")), ("charges", F.col("lines") > 0, F.when(F.col("returned") > 0, "risk").otherwise(fact)), ("open", F.col("open") > 5, F.lit("risk")), ("balance", F.col("c_acctbal") < 0, F.lit("alert"))])


@bound("""
select n_nationkey, n_name, coalesce(to_json(list({'s_suppkey': s_suppkey, 's_name': s_name} order by s_suppkey) filter (where s_suppkey is not null))::varchar, '[]') as suppliers from nation left join supplier on s_nationkey = n_nationkey group by 1, 2""")
def dossier_children(spark, d):
    """J-02, J-03, P-05: a parent with its children as one ordered array (JSON here)."""
    s = records.children(table(spark, d, "supplier"), "s_nationkey", ["s_suppkey", "s_name"], "suppliers")
    n = table(spark, d, "nation")
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").select("n_nationkey", "n_name", F.coalesce(F.to_json("suppliers"), F.lit("[]")).alias("suppliers"))


@bound("""
with p as (select user_id, event_id, ts, case when event_type = 'purchase' then 1 else 0 end as new from events),
i as (select *, sum(new) over (partition by user_id order by ts, event_id) as island from p)
select event_id, sum(1 - new) over (partition by user_id, island order by ts, event_id)::bigint as stale_passes from i""")
def stale_passes(spark, d):
    """W-04, R-08."""
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return records.stale_passes(e, "user_id", "at", F.when(F.col("event_type") == "purchase", 1).otherwise(0)).select("event_id", "stale_passes")


# ---- linkage ---------------------------------------------------------------------------------------------------------

TOKENS = r"list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: length(x) > 6))"


@bound(f"""
with dd as materialized (select doc_id, {TOKENS} as w from documents), bb as materialized (select item_id, {TOKENS} as w from benchmark),
d as (select doc_id, unnest(w) as t, len(w) as n from dd), b as (select item_id, unnest(w) as t, len(w) as n from bb),
s as (select doc_id, item_id, count(*) / min(least(d.n, b.n)) as ratio from d join b using (t) group by 1, 2)
select doc_id, arg_max(item_id, (ratio, -item_id)) as item_id, round(max(ratio), 6) as ratio from s where ratio >= 0.5 group by 1""")
def token_overlap_link(spark, d):
    """J-09, U-03, C-20: the benchmark item that shares most long words with each document."""
    left = table(spark, d, "documents").select("doc_id", text.title_tokens(F.col("text"), 6).alias("tokens"))
    right = table(spark, d, "benchmark").select("item_id", text.title_tokens(F.col("text"), 6).alias("tokens"))
    best = linkage.best_match(linkage.overlaps(left, right, "doc_id", "item_id", "tokens", 0.5), "doc_id", "item_id", 0.5)
    return best.withColumn("ratio", F.round("ratio", 6))


AUCTIONS = """
a as (select c_custkey as auction, case when c_custkey % 7 = 0 then (c_custkey % 100)::varchar end as number, ['urb', lower(c_mktsegment), 'k' || (c_custkey % 50)] as w, case when c_custkey % 3 = 0 then n_name || ' - PERU' else n_name end as district from customer join nation on n_nationkey = c_nationkey),
p as (select s_suppkey as property, case when s_suppkey % 3 = 0 then (s_suppkey % 100)::varchar end as number, list_distinct(['k' || (s_suppkey % 50), 'k' || (s_suppkey % 31)]) as w, case when s_suppkey % 4 = 0 then 'DISTRITO ' || n_name else n_name end as district from supplier join nation on n_nationkey = s_nationkey)"""


@bound(f"""
with {AUCTIONS},
j as (select auction, property, a.number = p.number as sure, contains(a.district, p.district) or contains(p.district, a.district) as place, len(list_intersect(list_filter(a.w, lambda x: x <> 'urb'), p.w)) / least(2, len(p.w)) as ratio from a, p)
select auction, property, case when sure then 'partida' when ratio > 0 then 'address' else 'district' end as match_type, case when sure then 1.0 when ratio > 0 then round(ratio * case when place then 0.8 else 0.5 end, 2) else 0.3 end::double as score,
case when sure then 'high' when ratio >= 0.6 and place then 'medium' else 'low' end as confidence from j where sure or ratio > 0 or place""")
def auction_link(spark, d):
    """J-06, C-30, C-37, C-38: three equi-joins; the first way of a pair counts."""
    return linkage.link_auctions(*auctions_and_properties(spark, d))


@bound(f"""
with {AUCTIONS},
j as (select property, auction, coalesce(a.number = p.number, false) as sure, contains(a.district, p.district) or contains(p.district, a.district) as place from a, p),
m as (select property, count(*) filter (where sure or place) as matches, bool_or(sure) as hard from j group by 1)
select property, matches, hard as hard_match, case when hard then 'high' when matches > 0 then 'low' else 'unknown' end as confidence, case when hard then 'partida' when matches > 0 then 'district' end as best_match_type from m""")
def auction_plan(spark, d):
    """J-13: what each property's matching comes to."""
    return linkage.matching_plan(*auctions_and_properties(spark, d))


def auctions_and_properties(spark, d) -> tuple[DataFrame, DataFrame]:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("district"))
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    word = lambda x, m: F.concat(F.lit("k"), (F.col(x) % m).cast("string"))
    number = lambda x, m: F.when(F.col(x) % m == 0, F.concat(F.lit(" "), (F.col(x) % 100).cast("string"), F.lit("- "))).alias("number")
    place = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lower("district"), F.lit(" - Perú"))).otherwise(F.col("district")).alias("district")
    of = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("Distrito "), F.col("district"))).otherwise(F.col("district")).alias("district")
    a = c.join(n, c.c_nationkey == n.k).select(F.col("c_custkey").alias("auction"), number("c_custkey", 7), F.concat_ws(" ", F.lit("Urb."), "c_mktsegment", word("c_custkey", 50)).alias("address"), place)
    p = s.join(n, s.s_nationkey == n.k).select(F.col("s_suppkey").alias("property"), number("s_suppkey", 3), F.concat_ws(", ", word("s_suppkey", 50), word("s_suppkey", 31)).alias("address"), of)
    return a, p


# ---- pages -----------------------------------------------------------------------------------------------------------


@bound(r"""
select page_id, nullif(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g'), '') as title, nullif(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '^\s+|\s+$', '', 'g'), '') as h1,
len(regexp_extract_all(html, '(?i)<a\s'))::int as links, len(regexp_extract_all(html, '(?i)<p[\s>]'))::int as paragraphs from pages""")
def html_page_parts(spark, d):
    """P-08, S-09: parts of a page by expressions."""
    return table(spark, d, "pages").select("page_id", html.page_parts(F.col("html")).alias("p")).select("page_id", "p.*")


@bound(r"""
with l as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as url, unnest(range(len(regexp_extract_all(html, 'href="([^"]+)"', 1))))::int as pos from pages),
s as (select *, case when contains(url, 'http') then 4 else 0 end + case when contains(url, '/posts/') then 2 else 0 end - case when contains(url, '#') then 3 else 0 end as score from l)
select page_id, arg_max(url, (score, -pos)) as url, max(score)::int as score, arg_max(pos, (score, -pos))::int as pos from s group by 1""")
def link_argmax(spark, d):
    """A-12, S-12: the best scored link of each page."""
    links = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), 1)).alias("pos", "url"))
    u = F.col("url")
    return linkage.best_link(links, "page_id", u, "pos", [(u.contains("http"), 4), (u.contains("/posts/"), 2), (u.contains("#"), -3)])


# ---- tasks -----------------------------------------------------------------------------------------------------------


@bound("""
select o_orderkey, t.t as task_type, 'pending' as status, case when t.t = 'identity' then 'high' else 'medium' end as priority from orders, unnest(['identity', 'geolocation', 'registry', 'bgr', 'urbanism', 'judicial', 'market', 'risk']) t(t) where o_orderstatus = 'P'""")
def new_case_tasks(spark, d):
    """T-05."""
    return research.new_case_tasks(table(spark, d, "orders").filter("o_orderstatus = 'P'"), "o_orderkey")


@bound("""
select event_id, case event_type when 'error' then 'failed' when 'signup' then 'requires_manual_action' when 'view' then 'unavailable' when 'click' then 'unavailable' else 'completed' end as outcome from events""")
def connector_outcome(spark, d):
    """T-11: sources in maintenance and unavailable ones come to the same."""
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "requires_auth").when(F.col("event_type") == "view", "maintenance").when(F.col("event_type") == "click", "unavailable").otherwise("available")
    return table(spark, d, "events").select("event_id", research.connector_outcome(status).alias("outcome"))


@bound("""
select c_custkey, case when c_acctbal > 9000 then 'skipped' when c_custkey % 5 = 0 then 'requires_manual_action' when n_nationkey is null then 'failed' else 'completed' end as outcome from customer left join nation on n_nationkey = c_nationkey and n_regionkey < 3""")
def geolocation_outcome(spark, d):
    """T-09, F-20: against a gazetteer."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation").filter("n_regionkey < 3")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    return j.select("c_custkey", research.geolocation_outcome(F.col("c_acctbal") > 9000, F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")), F.col("n_nationkey").isNotNull()).alias("outcome"))


@bound("""
with t as (select l_orderkey, max(case when l_linestatus = 'O' then 1 else 0 end) as waits from lineitem group by 1)
select l_orderkey, case when waits = 1 then case o_orderstatus when 'O' then 'completed' else 'requires_manual_action' end else 'completed' end as status from t join orders on o_orderkey = l_orderkey""")
def settle_manual(spark, d):
    """T-12: a cancelled action leaves its task waiting."""
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("w")).select("l_orderkey", F.when(F.col("w") == 1, "requires_manual_action").otherwise("completed").alias("status"))
    o = table(spark, d, "orders")
    actions = o.select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "O", "completed").when(F.col("o_orderstatus") == "P", "cancelled").alias("outcome"))
    return research.settle_manual(actions, t, "l_orderkey", "outcome")


@bound("""
select p_partkey, nullif(split_part(p_name, ' ', 3), '') as district, coalesce(nullif(p_brand, 'Brand#11'), 'unknown') as currency, case when p_type in ('PROMO', 'ECONOMY') then p_type else 'otro' end as kind, 'low' as confidence, 'reported' as verification from part""")
def property_insert(spark, d):
    """K-11, K-17, P-02, P-07, C-03: defaults and blanks."""
    p = table(spark, d, "part")
    third = F.coalesce(F.get(F.split("p_name", " "), F.lit(2)), F.lit(""))
    return p.select("p_partkey", text.blank_to_null(third).alias("district"), F.coalesce(F.nullif("p_brand", F.lit("Brand#11")), F.lit("unknown")).alias("currency"), text.whitelisted(F.col("p_type"), ["PROMO", "ECONOMY"], "otro").alias("kind"), F.lit("low").alias("confidence"), F.lit("reported").alias("verification"))


@bound("""
with k as (select event_id, user_id, try_cast(regexp_extract(props, '"k": *(\\d+)', 1) as bigint) as k from events)
select event_id, k, case when k is null then '{}' else '{"k":"' || k || '"}' end as canonical from k""".replace("\\\\", "\\"))
def json_fields(spark, d):
    """S-05, C-17, C-39: a JSON path, and the object in canonical form."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), text.canonical_json(F.col("props")).alias("canonical"))


# ---- streams ---------------------------------------------------------------------------------------------------------


@bound("select user_id, event_type, count(*) as n from events group by 1, 2")
def stream_totals(spark, d):
    """R-01, R-02, R-03: micro-batches aggregated by themselves, then added up: a batch that is run again replaces its own part."""
    parts = jobs.run_all(jobs.event_stream(spark, d), each=lambda s: s.select("user_id", "event_type"))
    return parts.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@bound("select distinct user_id, event_type from events")
def stream_keep_first(spark, d):
    """R-05, R-07: one row of each key over the whole stream."""
    first = jobs.keep_first(jobs.event_stream(spark, d), ["user_id", "event_type"], "ts", "60 days")
    return jobs.run_all(first).select("user_id", "event_type")


@bound()
def stream_task_states(spark, d):
    """R-06: keyed state; tests/test_streaming.py holds it against a fold."""
    graph = {"signup": ["view", "click"], "view": ["click", "error", "signup"], "click": ["purchase", "view", "error"], "purchase": ["view"], "error": ["view"]}
    states = jobs.task_states(jobs.event_stream(spark, d).select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id", graph, "signup", ["error"])
    return jobs.run_all(states, "update").groupBy("user_id").agg(F.max_by(F.struct("status", "retries", "rejected"), "batch").alias("s")).select("user_id", "s.*")


# ---- planned features of the reference (optional) --------------------------------------------------------------------


@bound("""
with m as (select o_orderpriority, avg(o_totalprice) as mean from orders group by 1)
select o_orderkey, round(o_totalprice / mean, 6) as share from orders join m using (o_orderpriority) where o_totalprice < 0.65 * mean""")
def price_alert(spark, d):
    """X-03: a price over 35 % under the mean of its group."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    m = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"))
    return o.join(m, "o_orderpriority").filter(F.col("o_totalprice") < 0.65 * F.col("mean")).select("o_orderkey", F.round(F.col("o_totalprice") / F.col("mean"), 6).alias("share"))


@bound("""
with g as (select c_custkey, (c_custkey * 37 % 1000) / 1000.0 + case when c_custkey % 2 = 0 then 70 else 0 end as lat, (c_custkey * 91 % 1000) / 1000.0 + 179.5 as l, case when l > 180 then l - 360 else l end as lon from customer),
n as (select a.c_custkey as id, b.c_custkey as other, 2 * 6371008.8 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))) as metres from g a join g b on a.c_custkey <> b.c_custkey and abs(a.lat - b.lat) < 0.03),
r as (select *, row_number() over (partition by id order by round(metres, 3), other) as rank from n where metres <= 2000)
select id, other, round(metres, 3) as metres, rank::int as rank from r where rank <= 10""")
def radius_comparables(spark, d):
    """X-01: the ten nearest within two kilometres; each place meets only those of its own and the next cells of a grid."""
    k = F.col("c_custkey")
    lon = (k * 91 % 1000) / 1000.0 + 179.5
    c = table(spark, d, "customer").select("c_custkey", ((k * 37 % 1000) / 1000.0 + F.when(k % 2 == 0, 70).otherwise(0)).alias("lat"), F.when(lon > 180, lon - 360).otherwise(lon).alias("lon"))
    return linkage.nearest(c, c, "c_custkey", 2000.0, 10).select("id", "other", F.round("metres", 3).alias("metres"), "rank")
