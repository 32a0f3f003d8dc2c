"""Queries on passes over cases, alerts and caps, bound like those of bindings.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from catastra.operators import intake, orchestrate
from catastra.plans.bindings import bound, table
from catastra.plans.captured import CASE_STATES, TASK_STATES, pick, pick_sql

KINDS = ["identity", "geolocation", "registry", "bgr", "urbanism", "judicial", "market", "risk"]
PASS = f"""
with c as (select o_orderkey as "case", o_custkey as property, {pick_sql("o_orderkey", CASE_STATES, 2)} as status from orders),
t as (select l_orderkey as "case", l_linenumber as task, {pick_sql("(l_orderkey + l_linenumber)", KINDS)} as kind, {pick_sql("(l_orderkey * 3 + l_linenumber)", TASK_STATES, 2)} as status from lineitem),
p as (select c_custkey as property, case when c_custkey % 4 > 0 then n_name end as district, case when c_custkey % 3 > 0 then c_name end as address, c_custkey % 7 = 0 as verified from customer join nation on n_nationkey = c_nationkey where c_custkey % 10 <> 0),
q as (select *, case when district is not null then district || ', Arequipa, Perú' when address is not null then address || ', Arequipa, Perú' else '' end as query from p),
places as (select n_name || ', Arequipa, Perú' as query from nation where n_regionkey < 4),
auctions as (select s_suppkey as property, s_suppkey % 3 as entries, s_suppkey % 2 = 0 as certain from supplier),
answers(kind, answer) as (values ('registry', 'requires_auth'), ('bgr', 'maintenance'), ('urbanism', 'available')),
j as (select t.*, c.property, c.status as case_status, q.property is not null as known, q.district, q.address, q.verified, q.query, places.query is not null as hit, answer, coalesce(entries, 0) as entries, coalesce(certain, false) as certain,
 c.status not in ('completed', 'partial', 'failed', 'cancelled') and t.status in ('pending', 'running') as moved
 from t join c using ("case") left join q using (property) left join places using (query) left join answers on answers.kind = t.kind left join auctions on auctions.property = c.property),
o as (select *, case when kind in ('identity', 'geolocation', 'judicial') and not known then 'failed' when kind = 'identity' then 'completed'
 when kind = 'geolocation' then case when verified then 'skipped' when query = '' then 'requires_manual_action' when hit then 'completed' else 'failed' end
 when kind = 'judicial' then case when district is null and address is null then 'requires_manual_action' when entries = 0 or certain then 'completed' else 'requires_manual_action' end
 when kind = 'registry' then 'requires_manual_action' when kind = 'bgr' then 'unavailable' when kind = 'urbanism' then 'completed' else 'unavailable' end as new from j),
e as (select *, case when not moved then null when kind in ('identity', 'geolocation', 'judicial') and not known then 'Property ' || property || ' not found for ' || kind || ' task'
 when kind = 'geolocation' then case new when 'skipped' then 'Ya geolocalizada (coordenadas verificadas)' when 'requires_manual_action' then 'Sin dirección ni distrito para geolocalizar' when 'failed' then 'Sin resultados en OpenStreetMap para "' || query || '"' end
 when kind = 'judicial' then case when district is null and address is null then 'Sin distrito ni dirección: no se puede ubicar el remate en REM@JU' when entries = 0 then 'Sin remates públicos en REM@JU para el distrito consultado' end
 when kind in ('market', 'risk') then 'Módulo de análisis o conector no implementado (stub)' end as error from o)"""


def one_pass(spark, d):
    k = F.col("o_orderkey")
    cases = table(spark, d, "orders").select(k.alias("case"), F.col("o_custkey").alias("property"), pick(k, CASE_STATES, 2).alias("status"))
    lk, ln = F.col("l_orderkey"), F.col("l_linenumber")
    tasks = table(spark, d, "lineitem").select(lk.alias("case"), ln.alias("task"), pick(lk + ln, KINDS).alias("task_type"), pick(lk * 3 + ln, TASK_STATES, 2).alias("status"))
    n, c = table(spark, d, "nation"), F.col("c_custkey")
    properties = table(spark, d, "customer").filter(c % 10 != 0).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(c.alias("property"), F.when(c % 4 > 0, F.col("n_name")).alias("district"), F.when(c % 3 > 0, F.col("c_name")).alias("address"), (c % 7 == 0).alias("verified"))
    places = n.filter("n_regionkey < 4").select(F.concat("n_name", F.lit(", Arequipa, Perú")).alias("query"))
    sources = spark.createDataFrame([("sunarp", "requires_auth"), ("sunarp_bgr", "maintenance"), ("impla", "available"), ("remaju", "available")], "source string, status string")
    s = F.col("s_suppkey")
    auctions = table(spark, d, "supplier").select(s.alias("property"), (s % 3).alias("entries"), (s % 2 == 0).alias("certain"))
    return orchestrate.orchestrate(cases, tasks, properties, places, sources, auctions)


@bound(f"""{PASS}
select "case", task, kind as task_type, case when moved then new else status end as status, error, moved from e""")
def case_pass_tasks(spark, d):
    """T-06, T-07, T-09 to T-11: every line of every order as a task of its case, after one pass."""
    return one_pass(spark, d)[0].select("case", "task", "task_type", "status", "error", "moved")


@bound(f"""{PASS},
n as (select "case", case when moved then new else status end as s from e),
g as (select "case", count(*) filter (where s in ('completed', 'failed', 'skipped', 'unavailable', 'blocked', 'requires_manual_action')) as settled, count(*) as total, count(*) filter (where s = 'failed') as failed, count(*) filter (where s in ('requires_manual_action', 'blocked', 'unavailable')) as warnings from n group by 1),
x as (select c."case", c.property, c.status, g.* exclude ("case"), c.status in ('completed', 'partial', 'failed', 'cancelled') as done from c left join g using ("case"))
select "case", property, case when done then status when settled >= total then case when failed > 0 then 'partial' else 'completed' end else 'running' end as status, case when not done then settled end as settled, case when not done then total end as total, case when not done then failed end as failed, case when not done then warnings end as warnings,
case when not done and settled >= total then case when failed > 0 then 'Caso con ejecución parcial: ' || failed || ' tarea(s) con error' else 'Caso completado correctamente' end end as summary from x""")
def case_pass(spark, d):
    """T-06, A-06: every order as a case, after one pass over its tasks."""
    return one_pass(spark, d)[1]


@bound("""
with l as (select p_partkey as property, p_brand as district, (p_size * 10)::double as area, p_retailprice::double as price from part), r as (select ps.property, ps.area from (select p_partkey as property, (p_size * (8 + p_partkey % 5))::double as area from part where p_partkey % 3 = 0) ps),
m as (select district, avg(price / area) as mean from l where area > 0 group by 1)
select l.property, 'area' as kind, 'high' as severity, round(l.area / r.area, 6) as value from l join r using (property) where r.area > 0 and abs(l.area - r.area) > 0.1 * r.area
union all select property, 'precio', 'low', round(price / area / mean, 6) from l join m using (district) where area > 0 and price / area < 0.65 * mean""")
def property_alerts(spark, d):
    """X-03: parts as listings, a third of them with a registered area."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    listings = p.select(k.alias("property"), F.col("p_brand").alias("district"), (F.col("p_size") * 10).cast("double").alias("area"), F.col("p_retailprice").cast("double").alias("price"))
    registry = p.filter(k % 3 == 0).select(k.alias("property"), (F.col("p_size") * (k % 5 + 8)).cast("double").alias("area"))
    return orchestrate.alerts(listings, registry).withColumn("value", F.round("value", 6))


@bound("""
with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as nth, count(*) over (partition by o_custkey) as total from orders)
select o_custkey, o_orderkey, total from r where nth <= 5""")
def capped_searches(spark, d):
    """O-07: of each customer's orders the five dearest, and how many there are."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return orchestrate.capped(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5).drop("o_totalprice")


@bound("""
with o as (select o_orderkey as k, o_custkey, case when o_orderkey % 4 = 0 then 'cancelled' else 'requested' end as status from orders),
l as (select l_orderkey as k, count(*) as n, count(*) filter (where l_linenumber % 3 > 0) as owners from lineitem group by 1),
g as (select o.*, coalesce(n, 0) as n, coalesce(owners, 0) as owners, n_name from o left join l using (k) join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey),
d as (select *, k % 5 > 0 and k % 8 <> 1 as has, k % 8 <> 1 as named from g)
select k as action, case when status = 'requested' and k % 7 <> 3 then 'completed' else status end as status, case when status = 'cancelled' then 'Manual action ' || k || ' already cancelled' when k % 7 = 3 then 'PDF vacío o base64 inválido' end as failure,
case when status = 'requested' and k % 7 <> 3 and named then 'registry-' || k end as registry_id, case when status = 'requested' and k % 7 <> 3 and has then 'P-' || lpad((k % 90000)::varchar, 8, '0') end as number,
case when status = 'requested' and k % 7 <> 3 then case when named then owners else 0 end end::int as owners,
case when status = 'requested' and k % 7 <> 3 and k % 7 = 2 then 'remates/' || o_custkey || '/' || k || '-aviso.pdf' end as pdf_key,
case when status = 'requested' and k % 7 <> 3 then k % 3 = 0 or named and n_name < 'M' end as placed from d""")
def completed_intakes(spark, d):
    """T-13: orders as manual captures with their lines as owners; a quarter is cancelled, a seventh has an empty attachment."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    owner = F.create_map(F.lit("titular"), F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("owner "), F.col("l_linenumber").cast("string"))).otherwise(""))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(owner)).alias("propietarios"))
    place = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    rows = o.join(lines, k == F.col("l_orderkey"), "left").join(place, F.col("o_custkey") == F.col("c_custkey"))
    actions = o.select(k.alias("action"), F.col("o_custkey").alias("property"), F.when(k % 4 == 0, "cancelled").otherwise("requested").alias("status"), F.lit("remaju").alias("source"), F.lit(None).cast("string").alias("url"))
    none = F.lit(None).cast("string")
    named = k % 8 != 1
    given = k % 3 == 0
    payloads = rows.select(
        k.alias("action"), k.alias("ordinal"), F.when((k % 5 > 0) & named, F.concat(F.lit("p "), (k % 90000).cast("string"))).alias("partida"), F.when(named, F.col("n_name")).alias("distrito"), *[none.alias(c) for c in ("urb", "calle", "avenida", "numero", "lote", "referencia", "origen", "debt", "cargas", "titulos")],
        F.when(given, "-16.4").alias("latitude"), F.when(given, "-71.5").alias("longitude"), none.alias("url"), "propietarios", F.lit("aviso.pdf").alias("pdf_name"), F.when(k % 7 == 2, "aGVsbG8=").when(k % 7 == 3, "").alias("pdf"),
    )
    answers = table(spark, d, "nation").filter("n_name < 'M'").select(F.col("n_name").alias("query"), F.lit(-16.0).alias("lat"), F.lit(-71.0).alias("lon"))
    t = intake.take_in(actions, payloads, answers)
    out = t.actions.join(t.failures.select("action", "failure"), "action", "left")
    return out.select("action", "status", "failure", "result.registry_id", "result.number", "result.owners", "result.pdf_key", "result.placed")
