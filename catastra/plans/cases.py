"""Queries on views, dispatch and writes of cases and tasks, bound like those of bindings.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from catastra.operators import records, research, resolve, views
from catastra.plans.bindings import bound, table

WHEN = "'%Y-%m-%dT%H:%M:%S.%gZ'"


@bound(f"""
select o_orderkey as id, o_custkey as property_id, case when o_orderkey % 2 = 0 then 0 else o_orderkey % 7 end::bigint as run_number, coalesce(nullif(o_orderstatus, 'P'), 'pending') as status, o_orderpriority as summary,
0 as error_count, 0 as warning_count, 0 as completed_task_count, 0 as total_task_count, strftime(o_orderdate::timestamp, {WHEN}) as started_at, case when o_orderstatus <> 'O' then strftime(o_orderdate::timestamp + interval 90 minute, {WHEN}) end as completed_at,
null::varchar as created_by, strftime(o_orderdate::timestamp, {WHEN}) as created_at, strftime(o_orderdate::timestamp, {WHEN}) as updated_at from orders""")
def case_view(spark, d):
    """P-04: orders as cases, gaps filled and times as text."""
    at = F.col("o_orderdate").cast("timestamp_ntz")
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("property_id"), F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderkey") % 7).alias("run_number"), F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.col("o_orderpriority").alias("summary"),
        at.alias("started_at"), F.when(F.col("o_orderstatus") != "O", at + F.expr("interval 90 minutes")).alias("completed_at"), at.alias("created_at"), at.alias("updated_at"),
    )
    return views.view(o, views.CASE)


@bound("""
select p_partkey as id, 'LI-' || p_partkey as public_id, p_name as title, case when p_partkey % 3 = 0 then 'otro' else p_type end as property_type, 'active' as status, p_retailprice as price, coalesce(nullif(p_brand, 'Brand#11'), 'unknown') as currency, 0 as listing_count,
'unknown' as price_confidence, 'reported' as price_verification, 'unknown' as area_confidence, 'reported' as area_verification, 'unknown' as location_confidence, 'reported' as location_verification from part""")
def property_detail(spark, d):
    """P-02, P-03: parts as properties; of the fields that no part has, those with a default."""
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("LI-"), F.col("p_partkey").cast("string")).alias("public_id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("property_type"), F.col("p_retailprice").alias("price"), F.nullif("p_brand", F.lit("Brand#11")).alias("currency"))
    given = [n for n, default in views.DETAIL.items() if default is not None or n in rows.columns]
    return views.view(rows, views.DETAIL).select(*given)


@bound("""
select c_custkey as property_id, 'system' as source, 'identity' as data_type, 'LI-' || c_custkey as public_id, c_name as title, case when c_custkey % 2 = 0 then c_mktsegment else 'otro' end as property_type, n_name as district, c_custkey % 3 = 0 and c_custkey % 5 = 0 as verified_coordinates,
'active' as status, c_acctbal as price, 'PEN' as currency, null::varchar as reported_source, 'high' as confidence, 'inferred' as verification, 'identity-v1' as parser_version from customer left join nation on n_nationkey = c_nationkey""")
def identity_results(spark, d):
    """T-08: customers as properties."""
    c, n, k = table(spark, d, "customer"), table(spark, d, "nation"), F.col("c_custkey")
    rows = c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        k.alias("id"), F.concat(F.lit("LI-"), k.cast("string")).alias("public_id"), F.col("c_name").alias("title"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("property_type"), F.col("n_name").alias("district"), F.when(k % 3 == 0, k.cast("string")).alias("latitude"),
        F.when(k % 5 == 0, k.cast("string")).otherwise("").alias("longitude"), F.lit("active").alias("status"), F.col("c_acctbal").alias("price"), F.lit("PEN").alias("currency"), F.lit(None).cast("string").alias("price_source"),
    )
    return views.identity(rows)


KINDS = ["identity", "geolocation", "registry", "bgr", "urbanism", "judicial", "market"]


@bound(f"""
with t as (select event_id, {KINDS}[event_id % 7 + 1] as task_type from events)
select event_id, task_type, case when task_type in ('identity', 'geolocation') then task_type when task_type in ('registry', 'bgr', 'urbanism') then 'connector' when task_type = 'judicial' then 'auction' else 'unavailable' end as way,
case task_type when 'registry' then 'sunarp' when 'bgr' then 'sunarp_bgr' when 'urbanism' then 'impla' when 'judicial' then 'remaju' end as source from t""")
def dispatch_tasks(spark, d):
    """T-07, J-15."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("event_id") % 7 + 1).cast("int"))
    t = table(spark, d, "events").select("event_id", kind.alias("task_type"))
    return t.select("event_id", "task_type", research.dispatch(F.col("task_type")).alias("way"), research.task_source(F.col("task_type")).alias("source"))


@bound("""
with a as (select user_id as task_id, event_type = 'signup' as live from events where event_type in ('signup', 'error')),
r as (select user_id as task_id, min(event_id) as event_id from events where event_type = 'purchase' and user_id not in (select task_id from a where live) group by 1)
select user_id as task_id, 'login' as action_kind, case when event_type = 'signup' then 'requested' else 'cancelled' end as status, event_id as id, false as created from events where event_type in ('signup', 'error')
union all select task_id, case when event_id % 2 = 0 then 'login' else 'user_action' end, 'requested', event_id, true from r""")
def request_actions(spark, d):
    """D-07: a task with an action under way gets no second one."""
    e = table(spark, d, "events")
    old = e.filter(F.col("event_type").isin("signup", "error")).select(F.col("user_id").alias("task_id"), F.lit("login").alias("action_kind"), F.when(F.col("event_type") == "signup", "requested").otherwise("cancelled").alias("status"), F.col("event_id").alias("id"))
    new = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("task_id"), F.when(F.col("event_id") % 2 == 0, "login").alias("action_kind"), F.col("event_id").alias("id"))
    return research.request_actions(old, new, "task_id", "id")


@bound("""
with t as (select o_orderkey, case o_orderstatus when 'O' then 'pending' when 'F' then 'completed' else 'running' end as status from orders)
select o_orderkey, case when status = 'running' and o_orderkey % 3 = 0 then 'failed' when status = 'pending' and o_orderkey % 3 = 1 then 'running' else status end as status,
case o_orderkey % 3 when 0 then status = 'running' when 1 then status = 'pending' when 2 then false end as applied from t""")
def claim_tasks(spark, d):
    """K-13: a change applies only where the state is still the expected one and may become the target."""
    o = table(spark, d, "orders")
    t = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"))
    m = F.col("o_orderkey") % 3
    changes = o.select("o_orderkey", F.lit(1).alias("ordinal"), F.when(m == 0, "running").when(m == 1, "pending").otherwise("completed").alias("expected"), F.when(m == 0, "failed").otherwise("running").alias("target"))
    return research.compare_and_set(t, changes, "o_orderkey", "status", research.TASK_EDGES)


@bound("""
with t as (select o_orderkey, o_custkey, case when o_orderkey % 2 = 0 then 'geolocation' else 'market' end as task_type, case o_orderstatus when 'O' then 'pending' when 'F' then 'completed' else 'running' end as status from orders),
j as (select *, c_custkey is not null and task_type = 'geolocation' and status in ('pending', 'running') as moved, case when c_acctbal < 0 then 'requires_manual_action' else 'completed' end as mark from t left join customer on c_custkey = o_custkey and c_nationkey < 10)
select o_custkey, o_orderkey, task_type, case when moved then mark else status end as status, moved, case when moved and mark <> 'completed' then 'no place' end as error, moved and mark <> 'completed' as needs_action from j""")
def mark_geolocation(spark, d):
    """T-15: only tasks under way move."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    t = o.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "geolocation").otherwise("market").alias("task_type"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"))
    marks = c.filter("c_nationkey < 10").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("ordinal"), F.when(F.col("c_acctbal") < 0, "requires_manual_action").otherwise("completed").alias("mark"), F.lit("no place").alias("error"))
    return research.mark_geolocation(t, marks, "o_custkey")


@bound("""
with l as (select l_orderkey, count(*) filter (where l_linestatus = 'O') as live from lineitem group by 1),
o as (select o_custkey, count(*) as runs, max(o_orderkey) as last_run, arg_max(o_orderstatus, o_orderkey) as last_status, count(live) as entries, coalesce(sum(live), 0)::bigint as live from orders left join l on l_orderkey = o_orderkey group by 1),
c as (select c_custkey, coalesce(runs, 0) as runs, last_run, last_status, coalesce(entries, 0) as entries, coalesce(live, 0) as live, c_acctbal < 0 as debt, c_acctbal > 9000 as rich, c_nationkey from customer left join o on o_custkey = c_custkey),
f as (select c_custkey, unnest([
case when true then {'label': 'Investigaciones', 'value': case when runs = 0 then 'Sin ejecuciones aún' else runs || ' ejecución(es) · última ' || last_run || ' (' || last_status || ')' end, 'kind': 'fact', 'source': 'research_cases'} end,
case when true then {'label': 'Registro (SUNARP)', 'value': case when entries = 0 then 'Sin datos registrales capturados' else entries || ' partida(s) capturada(s)' || case when live > 0 then ' · ' || live || ' carga(s) activa(s)' else '' end end, 'kind': case when entries = 0 then 'unavailable' when live > 0 then 'requiere_verificacion' else 'fact' end, 'source': 'registry_properties'} end,
case when debt or rich then {'label': 'Alertas', 'value': '1 alerta(s) activa(s): ' || case when debt then 'critical deuda' else 'low saldo' end, 'kind': case when debt then 'requiere_verificacion' else 'signal' end, 'source': 'property_alerts'} end,
case when true then {'label': 'Evidencias', 'value': runs || ' resultado(s) de investigación capturado(s)', 'kind': 'fact', 'source': 'research_results'} end,
case when c_nationkey > 0 then {'label': 'Mercado', 'value': c_nationkey || ' comparable(s) · 0 precio(s) estimado(s)', 'kind': 'fact', 'source': 'market_comparables/market_prices'} end,
case when c_nationkey % 2 = 0 then {'label': 'Urbanismo', 'value': 'Sin zonificación/parámetros aún', 'kind': 'unavailable', 'source': 'urban_zones'} end,
case when true then {'label': 'Judicial', 'value': 'Sin expedientes coincidentes aún', 'kind': 'unavailable', 'source': 'judicial_cases'} end,
case when true then {'label': 'Infraestructura', 'value': 'Sección PLANNED (sin fuentes conectadas)', 'kind': 'unavailable', 'source': 'infrastructure (planned)'} end]) as f from c)
select c_custkey, f.label as label, f.value as value, f.kind as kind, f.source as source from f where f is not null""")
def property_report(spark, d):
    """A-10, A-11: the findings of each customer's file."""
    line = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.when(F.col("l_linestatus") == "O", "si").otherwise("no").alias("active"))).alias("charges"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    by = o.join(line, o.o_orderkey == line.l_orderkey, "left").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("runs"), F.max("o_orderkey").alias("last_run"), F.max_by("o_orderstatus", "o_orderkey").alias("last_status"), F.collect_list(F.when(F.col("charges").isNotNull(), F.struct("charges"))).alias("registry"))
    alert = lambda severity, kind: F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), F.lit("active").alias("status"))
    nothing = F.lit(None).cast("string")
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey").join(by, "o_custkey", "left").withColumnRenamed("o_custkey", "c_custkey")
    alerts = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, alert("critical", "deuda")), F.when(F.col("c_acctbal") > 9000, alert("low", "saldo"))))
    rows = c.withColumns({"latitude": nothing, "longitude": nothing, "alerts": alerts, "comparables": F.col("c_nationkey"), "prices": F.lit(0), "results": F.coalesce("runs", F.lit(0)), "zones": F.col("c_nationkey") % 2, "judicial": F.lit(0)})
    return views.report(rows, "c_custkey").drop("position")


@bound("""
select n_name as queue, waiting, active, failed from nation left join (select c_nationkey, count(*) filter (where c_acctbal < 0) as waiting, count(*) filter (where c_acctbal between 0 and 5000) as active, count(*) filter (where c_acctbal > 5000) as failed from customer where c_nationkey % 4 > 0 group by 1) on c_nationkey = n_nationkey""")
def queue_depth(spark, d):
    """A-17: a queue that reports nothing has no counts."""
    n, b = table(spark, d, "nation"), F.col("c_acctbal")
    jobs = table(spark, d, "customer").filter("c_nationkey % 4 > 0").join(n.select("n_nationkey", F.col("n_name").alias("queue")), F.col("c_nationkey") == F.col("n_nationkey")).select("queue", F.when(b < 0, "waiting").when(b <= 5000, "active").otherwise("failed").alias("state"))
    return records.queue_depth(jobs, n.select(F.col("n_name").alias("queue")), "queue", "state", ["waiting", "active", "failed"])


@bound("""
with a as (select distinct user_id % 5 as s, event_id % 1000 as x from events where event_type = 'purchase'),
c as (select event_id % 5 as s0, user_id % 5 as s, event_id % 1000 as x, props as h, min(event_id) as ordinal from events where event_type in ('purchase', 'click') group by all),
k as (select s, x, min(ordinal) as ordinal, arg_min(h, ordinal) as h from c group by 1, 2),
f as (select h, arg_min(s || ':' || x, k.ordinal) as name from k semi join a using (s, x) group by 1)
select s as source, x as external, name as property from a join k using (s, x) join f using (h)""")
def resolve_external(spark, d):
    """D-02: purchases ask for what purchases and clicks have captured; the first of each content names the property."""
    e = table(spark, d, "events").withColumns({"source": F.col("user_id") % 5, "external": F.col("event_id") % 1000})
    captured = e.filter(F.col("event_type").isin("purchase", "click")).select("source", "external", F.col("props").alias("digest"), F.col("event_id").alias("ordinal"))
    first = resolve.earliest(captured, ["source", "external"], [F.col("ordinal")])
    return resolve.resolve_external(e.filter("event_type = 'purchase'"), first, None, "source", "external", "digest", "ordinal")
