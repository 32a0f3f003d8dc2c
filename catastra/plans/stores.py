"""Queries on stored tables, memos, connectors and retries, bound like those of bindings.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from catastra.plans.bindings import RESOLVED, bound, resolved, table
from catastra.sources.connectors import Connector, Connectors, parquet_connector
from catastra.sources.memo import recognised
from catastra.sources.shared import shared_path
from catastra.sources.store import StoredTable, written
from catastra.streaming import jobs, retries


@bound("""
with o as (select o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderkey % 3 = 0 as late from orders),
a as (select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as k, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as p from o where not late group by 1),
b as (select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as k, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as p from o where late group by 1)
select o_custkey, coalesce(b.k, a.k) as o_orderkey, coalesce(b.p, a.p) as o_totalprice, case when a.k is null then 'inserted' when b.k is null then 'inserted' else 'inserted,updated' end as actions from a full join b using (o_custkey)""")
def stored_upserts(spark, d):
    """K-02, K-08, K-12: the last order of each customer, in two batches of which the second is delivered twice, with its audit."""
    store = StoredTable(spark, shared_path(spark, "store"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 16)
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    store.upsert(o.filter("o_orderkey % 3 <> 0"), 0, "customer")
    for _ in range(2):
        store.upsert(o.filter("o_orderkey % 3 = 0"), 1, "customer")
    actions = store.audit().groupBy(F.col("key").cast("long").alias("o_custkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", "action"))), lambda x: x["action"]), ",").alias("actions"))
    return store.read().select("o_custkey", "o_orderkey", "o_totalprice").join(actions, "o_custkey", "left")


@bound(f"select count(*) as scanned, count(*) filter (where action = 'updated') as updated, count(*) filter (where action = 'created') as created, count(*) filter (where action = 'linked') as linked from ({RESOLVED})")
def observed_ingest(spark, d):
    """A-13, A-15: the counters of an ingest, made as its rows are written."""
    action = F.col("action")
    did = written(resolved(spark, d), shared_path(spark, "ingest"), scanned=F.count(F.lit(1)), **{a: F.count_if(action == a) for a in ("updated", "created", "linked")})
    return spark.createDataFrame([tuple(did.values())], ", ".join(f"{n} long" for n in did))


@bound("""
with p as (select page_id, split_part(url, '/', 3) as host, url from pages),
k as (select host, coalesce(min(url) filter (where page_id % 2 = 0), min(url)) as url, min(url) filter (where page_id % 2 = 0) is null as late from p where starts_with(url, 'http') group by 1)
select page_id, case when not contains(k.url, '//m.') then upper(k.url) end as text from p left join k using (host)""")
def picture_texts(spark, d):
    """S-15: pages in two runs, a text for each host; the second run asks for new hosts alone. Hosts that begin with m. cannot be read."""
    path, p = shared_path(spark, "memo"), table(spark, d, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("key"), "url")
    say = lambda urls: [None if "//m." in u else u.upper() for u in urls]
    recognised(spark, p.filter("page_id % 2 = 0"), path, say)
    return recognised(spark, p, path, say).select("page_id", "text")


@bound("""
select 'orders' as source, 'available' as status, count(*) as items, sum(o_orderkey)::bigint as ids, 0::bigint as failed from orders
union all select 'suppliers', 'available', count(*), sum(s_suppkey)::bigint, 0 from supplier
union all select 'broken', 'error', 0, 0, 2""")
def connected_sources(spark, d):
    """S-17, S-18: three sources in one scan, of which one fails in a part at its first row and in another after some."""

    def broken(part):
        if part == "late":
            yield ("1", "given before", None)
        raise RuntimeError("out of order")

    def check():
        raise RuntimeError("no answer")

    all_ = Connectors(parquet_connector("orders", f"{d}/orders.parquet", "o_orderkey", "o_orderstatus", "o_orderpriority"), parquet_connector("suppliers", f"{d}/supplier.parquet", "s_suppkey", "s_name", "s_nationkey"), Connector("broken", broken, ["early", "late"], check))
    items, failed = all_.search(spark)
    n = items.groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("id").cast("long")).alias("ids"))
    out = all_.statuses(spark).join(n, "source", "left").join(failed.groupBy("source").agg(F.count(F.lit(1)).alias("failed")), "source", "left")
    return out.select("source", "status", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("items", "ids", "failed")])


@bound("""
with e as (select event_id, user_id, epoch_us(ts) // 1000 as t0, event_id % 5 as misses from events)
select user_id, event_id::varchar as job, least(misses + 1, 3)::int as attempts, misses < 3 as ok, t0 + [0, 60000, 180000][least(misses + 1, 3)] as at_ms from e""")
def stream_retries(spark, d):
    """R-03: every event as a job that misses some times, tried up to three times, after one minute and two more."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    path = shared_path(spark, "jobs")
    e.write.mode("append").parquet(path)
    # a last job, long after, so that the watermark passes all waits
    spark.sql("select -1L as event_id, -1L as user_id, timestamp'2100-01-01' as ts").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(e.schema).parquet(path)
    out = retries.tried(stream, "user_id", "event_id", "ts", lambda job, attempt: attempt > int(job) % 5, retries.Policy(attempts=3, wait_ms=60_000))
    return jobs.run_all(out).filter("last and user_id >= 0").select("user_id", "job", F.col("attempt").alias("attempts"), "ok", "at_ms")
