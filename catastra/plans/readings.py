"""Queries on what is read from links, labels, posters, pages and captures, bound like those of bindings.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from catastra.functions import captures, text
from catastra.operators import html, linkage, resolve, views
from catastra.operators import search as listing
from catastra.plans.bindings import bound, table
from catastra.sources import readers, sinks
from catastra.sources.shared import shared_path, staged
from catastra.sources.store import written

FB = "https://www.facebook.com"


@bound(f"""
with l as (select l_orderkey as k, l_linenumber as n, (1000000000 + l_orderkey * 8 + l_linenumber)::varchar as id, l_linenumber % 8 as s from lineitem)
select k, n, case s when 5 then 'Ab' || id when 6 then null when 7 then null else id end as post,
case s when 0 then '{FB}/groups/77/posts/' || id when 1 then '{FB}/groups/88/posts/' || id when 2 then '{FB}/groups/77/posts/' || id when 3 then '{FB}/groups/77/posts/' || id when 4 then '{FB}/groups/77/posts/' || id when 5 then '{FB}/share/p/Ab' || id end as url,
case s when 5 then '{FB}/share/v/Ab' || id when 6 then null when 7 then null else '{FB}/groups/77/posts/' || id end as best,
case s when 0 then 'permalink' when 1 then 'permalink' when 2 then 'direct' when 3 then 'permalink' when 4 then 'permalink' when 5 then 'permalink' when 6 then 'group_root' else '' end as status from l""")
def link_readings(spark, d):
    """C-14 to C-16: links of eight shapes: their post, its clean link, the best address, what it leads to."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    id = (F.lit(1000000000).cast("long") + k * 8 + n).cast("string")
    shapes = [F.concat(F.lit("/groups/77/posts/"), id), F.concat(F.lit("https://m.facebook.com/groups/88/permalink/"), id, F.lit("/?ref=1")), F.concat(F.lit("/story.php?story_fbid="), id, F.lit("&id=3")), F.concat(F.lit("/x?a=1&multi_permalinks="), id), F.concat(F.lit("/photo?fbid=3&set=gm."), id), F.concat(F.lit(f"{FB}/share/v/Ab"), id), F.lit("/groups/77/"), F.lit("#")]
    raw = F.element_at(F.array(*shapes), (n % 8 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select(k.alias("k"), n.alias("n"), raw.alias("raw"))
    rows, p = rows.withColumn("p", captures.post_link(F.col("raw"), F.lit("77"))), F.col("p")
    return rows.select("k", "n", p["post"].alias("post"), p["url"].alias("url"), captures.post_url(F.col("raw"), F.lit("77")).alias("best"), text.link_status(F.col("raw")).alias("status"))


@bound("""
with o as (select o_orderkey as k, 'Lote ' || o_orderkey || ' ' || replace(o_orderpriority, '-', ' ') as t, o_orderkey % 5 as s from orders)
select k, case s when 4 then 'sin nada' else t end as part, case s when 0 then 'S/ ' || k when 1 then k::varchar else '' end as price, case s when 0 then 'Arequipa' when 2 then 'Arequipa' else '' end as location,
case s when 0 then t || ', Arequipa' when 1 then t || ', ' || k when 2 then t || ', Arequipa' when 3 then t || ', x, y' else ': casa de prueba' end as title,
case s when 4 then '' else 'Lote' || case when length(k::varchar) > 3 then ' ' || k else '' end || case when s = 0 and length(k::varchar) > 3 then '' else '' end end as words from o""".replace("|| case when s = 0 and length(k::varchar) > 3 then '' else '' end ", ""))
def label_readings(spark, d):
    """C-13, C-45, C-19: labels in five forms: their parts, the title that is kept, the words that a search would use."""
    k = F.col("o_orderkey")
    n, name = k.cast("string"), F.concat(F.lit("Lote "), k.cast("string"), F.lit(" "), F.replace("o_orderpriority", F.lit("-"), F.lit(" ")))
    forms = [F.concat(name, F.lit(", S/ "), n, F.lit(", Arequipa, publicación 12")), F.concat(name, F.lit(", "), n), F.concat(name, F.lit(", Arequipa")), F.concat(name, F.lit(", x, y")), F.lit("sin nada")]
    label = F.element_at(F.array(*forms), (k % 5 + 1).cast("int"))
    title = F.when(k % 5 == 4, "Facebook: casa de prueba")
    words = F.when(k % 5 != 4, F.concat(F.lit("Vendo Lote "), n))
    rows = table(spark, d, "orders").select(k.alias("k"), label.alias("label"), title.alias("t"), words.alias("w"))
    p = captures.card_parts(F.col("label"))
    return rows.select("k", p["title"].alias("part"), p["price"].alias("price"), p["location"].alias("location"), captures.clean_title(F.col("t"), F.col("label"), F.lit("")).alias("title"), captures.search_words(F.col("w")).alias("words"))


@bound("""
with o as (select o_orderkey as k, 500 + o_orderkey % 9000 as price, 20 + o_orderkey % 900 as m2, '9' || lpad((o_orderkey % 100000000)::varchar, 8, '0') as phone from orders)
select k, case when k % 3 < 2 then phone else '' end as phones, case k % 4 when 0 then 'PEN:' || price when 1 then 'USD:' || price when 2 then 'PEN:' || price || ',USD:' || substr((price * 2)::varchar, 1, 4) else '' end as prices, case when k % 5 > 0 then m2 end as m2 from o""")
def poster_readings(spark, d):
    """C-22: texts of pictures with phones, prices and areas in several forms."""
    k = F.col("o_orderkey")
    price, m2 = (k % 9000 + 500).cast("string"), (k % 900 + 20).cast("string")
    phone = F.concat(F.lit("9"), F.lpad((k % 100000000).cast("string"), 8, "0"))
    spaced = F.concat_ws(" ", F.substring(phone, 1, 3), F.substring(phone, 4, 3), F.substring(phone, 7, 3))
    call = F.when(k % 3 == 0, F.concat(F.lit(" llamar +51 "), spaced)).when(k % 3 == 1, F.concat(F.lit(" cel: "), phone)).otherwise(" llamar ya")
    offer = F.when(k % 4 == 0, F.concat(F.lit(" S/. "), price)).when(k % 4 == 1, F.concat(F.lit(" US$ "), price)).when(k % 4 == 2, F.concat(F.lit(" soles "), price, F.lit(" o $"), ((k % 9000 + 500) * 2).cast("string"))).otherwise(" S/ 35")
    area = F.when(k % 5 > 0, F.concat(F.lit(" de "), m2, F.lit(" m2"))).otherwise(" amplio")
    p = captures.poster(F.concat(F.lit("VENDO terreno"), area, offer, F.lit(" ;"), call))
    rows = table(spark, d, "orders").select(k.alias("k"), p.alias("p"))
    prices = F.array_join(F.transform("p.prices", lambda x: F.concat(x["currency"], F.lit(":"), x["price"].cast("long").cast("string"))), ",")
    return rows.select("k", F.array_join("p.phones", ",").alias("phones"), prices.alias("prices"), "p.m2")


@bound("""
with g as (select lpad(o_orderkey::varchar, 10, '0') as id, o_custkey from orders)
select 'link' as scan, min(lpad(o_orderkey::varchar, 10, '0')) as first, 1::bigint as n from orders where o_custkey = 7 and o_orderkey % 2 = 0
union all select 'prefix', min(case when o_orderkey % 3 = 0 then 'g_' || o_orderkey else 'gx' || o_orderkey end), count(*) from orders where o_orderkey % 3 < 2
union all select 'favourite', min(lpad(o_orderkey::varchar, 10, '0')), count(*) from orders where o_orderkey % 4 < 2""")
def listing_scans(spark, d):
    """S-05, S-06, F-03: the row of a link in the JSON, rows of a prefix (its underscore stands for any character), favourites."""
    k, o = F.col("o_orderkey"), table(spark, d, "orders")
    id = F.lpad(k.cast("string"), 10, "0")
    link = F.concat(F.lit("https://x/"), F.col("o_custkey").cast("string"))
    data = F.when(k % 2 == 0, F.to_json(F.struct(F.when(k % 4 == 0, link).alias("url_publicacion"), F.when(k % 4 == 2, link).alias("url")))).otherwise('{"url":"other"}')
    first = readers.by_link(o.select(id.alias("id"), data.alias("data")), "https://x/7").select(F.lit("link").alias("scan"), F.col("id").alias("first"), F.lit(1).cast("long").alias("n"))
    keys = F.when(k % 3 == 0, F.concat(F.lit("g_"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("gx"), k.cast("string"))).otherwise(F.concat(F.lit("h_"), k.cast("string")))
    count = lambda rows, c, name: rows.agg(F.lit(name).alias("scan"), F.min(c).alias("first"), F.count(F.lit(1)).alias("n"))
    some = count(readers.by_prefix(o.select(keys.alias("id")), "g"), "id", "prefix")
    liked = o.select(id.alias("id"), F.when(k % 4 == 0, "true").when(k % 4 == 1, "1").when(k % 4 == 2, "no").alias("favorito"))
    return first.unionByName(some).unionByName(count(listing.search(liked, listing.Search(as_of="2024-01-01", favourite=True)), "id", "favourite"))


@bound("""
with o as (select o_orderkey as k, o_custkey, n_name, strftime(o_orderdate, '%d/%m/%Y') as day, strftime(o_orderdate, '%Y-%m-%d') as iso from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey)
select k as page, 0 as panel, k as auction_id, k + 1 as call_id, case when k % 2 = 0 then 'segunda_convocatoria' else 'remate_simple' end as kind, upper(n_name) as place_key, iso as date, k % 3 = 0 as last_day, concat_ws(' · ', case when k % 2 = 0 then 'Segunda Convocatoria' else 'Remate Simple' end, n_name, day) as title from o where contains(n_name, 'A')
union all select k, 1, k + 1000000000, null, 'subasta', n_name || ' X', null, false, 'Subasta · ' || n_name || ' X' from o where k % 5 = 0 and contains(n_name || ' X', 'A')""")
def carousel_slides(spark, d):
    """S-09, P-08, P-09, C-28, F-13: panels of carousel pages made of the orders, typed, with their titles, of places that hold an á."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    pair = lambda n, v: F.concat(F.lit("{name:&quot;" + n + "&quot;,value:&quot;"), v.cast("string"), F.lit("&quot;}"))
    part = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    info = F.when(k % 3 == 0, '<div class="info">Último  día de inscripción</div>').otherwise("")
    first = part('<li class="ui-galleria-panel x"><span class="text-bold"> ', F.when(k % 2 == 0, "Segunda Convocatoria").otherwise("Remate Simple"), ' </span><i class="fa fa-map-marker"></i> ', F.col("n_name"), '\n<div class="fecha"><i class="c"></i> ', F.date_format("o_orderdate", "dd/MM/yyyy"), "</div>", info, '<a onclick="f({pa:[', pair("convocatoria", k + 1), ",", pair("remate", k), ']})"></a></li>')
    second = F.when(k % 5 == 0, part('<li class="ui-galleria-panel"><span class="text-bold">Subasta</span><i class="fa fa-map-marker"></i>', F.col("n_name"), " X\n", pair("remate", k + 1000000000), "</li>")).otherwise("")
    slides = html.auction_panels(rows.select(k.alias("page"), F.concat(F.lit("<ul>"), first, second, F.lit("</ul>")).alias("html")), "page", "html")
    slides = staged(slides)
    items = html.slide_items(slides.select("remate", "convocatoria", "tipoLabel", "ubicacion", "fecha"))
    typed = views.auction_slides(slides.select(F.col("remate").alias("auction"), F.col("convocatoria").alias("call"), F.lit("").alias("code"), F.col("tipoLabel").alias("label"), F.col("ubicacion").alias("place"), F.col("fechaISO").alias("date_iso"), F.col("fecha").alias("date"), F.col("esUltimoDiaInscripcion").alias("last_day"), "info", F.lit(None).cast("string").alias("amount"), "page", "panel"))
    titles = slides.select("page", "panel", F.concat_ws(" · ", "tipoLabel", "ubicacion", "fecha").alias("title"), F.coalesce("remate", "convocatoria").cast("long").alias("auction_id")).join(items.select(F.col("id").cast("long").alias("auction_id"), "title").distinct().hint("merge"), ["auction_id", "title"])
    return views.slides_of(typed, " á ").join(titles.hint("merge"), "auction_id").select("page", F.col("panel").cast("int").alias("panel"), "auction_id", "call_id", "kind", "place_key", "date", "last_day", "title")


@bound("""
with d as (select doc_id, coalesce(text, '') as t, (4000000000 + doc_id)::varchar as id from documents where length(coalesce(text, '')) >= 100),
b as (select doc_id, id, t || ' "post_id": "' || id || '" ' || t || ' "story_fbid":"' || id || '"' as body, length(t) + 14 as p from d)
select doc_id, id, p::bigint as position, substr(body, greatest(1, p - 40), 80) as near from b""")
def nearby_messages(spark, d):
    """S-14, C-21: ids in the texts of documents, and what stands around the first place of each."""
    t, id = F.coalesce("text", F.lit("")), (F.lit(4000000000) + F.col("doc_id")).cast("string")
    body = F.concat(t, F.lit(' "post_id": "'), id, F.lit('" '), t, F.lit(' "story_fbid":"'), id, F.lit('"'))
    rows = table(spark, d, "documents").filter(F.length(t) >= 100).select("doc_id", body.alias("body"))
    return html.nearby(rows, "doc_id", "body", r'"(?:post_id|story_fbid)"\\s*:\\s*"(\\d{10,})"'.replace("\\\\", "\\"), 40).withColumn("position", F.col("position").cast("long"))


@bound(f"""
with o as (select o_orderkey as k, o_orderkey % 4 as s, 'grupo' as fuente from orders),
r as (select k, s, case s when 0 then '{FB}/groups/9/posts/' || k when 1 then '{FB}/groups/9' when 2 then '{FB}/groups/9/search/?q=a%20b' else '' end as url from o),
m as (select k, s, s in (1, 3) as fixed, case s when 1 then '{FB}/groups/9/search/?q=Terreno%20plano' when 3 then '{FB}/groups/8/search/?q=Terreno%20plano' else url end as url from r)
select count(*) as total, count(*) filter (where fixed) as fixed, count(*) filter (where url like '%/search/%') as searches, count(*) filter (where url like '%/posts/%') as permalinks from m""")
def migrated_links(spark, d):
    """D-06, A-16: links of groups' listings moved to searches, counted as they are written."""
    k = F.col("o_orderkey")
    url = F.when(k % 4 == 0, F.concat(F.lit(f"{FB}/groups/9/posts/"), k.cast("string"))).when(k % 4 == 1, f"{FB}/groups/9").when(k % 4 == 2, f"{FB}/groups/9/search/?q=a%20b").otherwise("")
    rows = table(spark, d, "orders").select(F.concat(F.lit("8_"), k.cast("string")).alias("id_publicacion"), F.lit("Terreno plano").alias("titulo"), F.lit("").alias("descripcion"), F.lit("").alias("url_publicacion"), url.alias("url"), F.lit("grupo").alias("fuente"), F.lit("").alias("link_status"))
    did = written(captures.group_links(rows), shared_path(spark, "links"), total=F.count(F.lit(1)), fixed=F.count_if("fixed"), searches=F.count_if(F.col("link_status") == "search"), permalinks=F.count_if(F.col("link_status") == "permalink"))
    return spark.createDataFrame([tuple(did.values())], ", ".join(f"{n} long" for n in did))


@bound(f"""
with t as (select o_orderkey as k, case when o_orderkey % 3 = 0 then '{FB}/groups/1/posts/' || o_orderkey else '{FB}/groups/1' end as url, o_orderkey % 3 = 0 as there from orders),
n as (select l_orderkey as k, min(case when l_linenumber % 2 = 0 then '{FB}/groups/2/posts/' || l_linenumber end) as new from lineitem group by 1)
select k, case when not there and new is not null then new else url end as url, not there and new is not null as promoted from t left join n using (k)""")
def promoted_links(spark, d):
    """D-05: orders' links that are none of a post are replaced by the least such of their lines."""
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select(k.alias("k"), F.when(k % 3 == 0, F.concat(F.lit(f"{FB}/groups/1/posts/"), k.cast("string"))).otherwise(f"{FB}/groups/1").alias("url"))
    n = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(f"{FB}/groups/2/posts/"), F.col("l_linenumber").cast("string"))).otherwise(f"{FB}/groups/2").alias("url"))
    return resolve.promote_links(t, n, "k", "url", text.is_permalink)


@bound("""
with recursive r as (select event_id as ordinal, case when event_id % 3 <> 0 then user_id // 3 end as a, case when event_id % 3 <> 1 then 100000 + user_id // 5 end as b from events),
e as (select ordinal, 'a' || a as k from r where a is not null union all select ordinal, 'b' || b from r where b is not null),
n as (select distinct x.k as p, y.k as q from e x join e y using (ordinal)),
w(p, q) as (select p, q from n union select w.p, n.q from w join n on n.p = w.q),
c as (select p, min(o) as c from w join (select k, min(ordinal) as o from e group by 1) m on m.k = w.q group by 1)
select ordinal, min(c) as component from e join c on c.p = e.k group by 1""")
def alias_groups(spark, d):
    """D-03: events that share aliases, directly or by others, under the least of them."""
    u, k = F.col("user_id"), F.col("event_id")
    rows = table(spark, d, "events").select(k.alias("ordinal"), F.when(k % 3 != 0, F.floor(u / 3)).alias("remate_id"), F.when(k % 3 != 1, F.floor(u / 5) + 100000).alias("convocatoria_id"), F.lit("x").alias("content"))
    return resolve.alias_components(rows).select("ordinal", "component")


@bound("""
with o as (select o_orderkey as k, o_orderkey % 6 as s from orders)
select k, case s when 0 then 'Ana Perez' when 1 then 'Inmobiliaria Sur S.A.C.' when 2 then null when 4 then null end as name, case when s in (0, 1) then 50.0 when s = 2 then null end as percentage, case s when 2 then '123' end as document
from o where s < 3 or s = 4 and false""")
def owner_readings(spark, d):
    """C-34, F-18, K-10, C-32: owners written in six ways; those that say nothing go."""
    k = F.col("o_orderkey")
    m = lambda **f: F.create_map(*[F.lit(x) for kv in f.items() for x in kv])
    ways = [m(titular="ANA  PEREZ", porcentaje="50%"), m(nombre="inmobiliaria sur s.a.c.", percentage="0.5"), m(documento="123"), m(nada="x"), m(titular=" "), m(porcentaje="10")]
    rows = table(spark, d, "orders").select(k.alias("k"), F.array(F.element_at(F.array(*ways), (k % 6 + 1).cast("int"))).alias("items"))
    return captures.exploded(rows.withColumn("owners", captures.owners(F.col("items"))), "k", "owners").select("k", "name", "percentage", "document")


@bound("""
with c as (select c_custkey as k, '9_' || c_custkey as id, case when c_custkey % 2 = 0 then '987' || lpad(c_custkey::varchar, 6, '0') else '' end as phone from customer)
select k, case when k % 2 = 0 and k % 4 = 0 then '912345678' else phone end as telefono, k % 4 = 0 as phone_fixed, case when k % 3 = 0 then 'Yura' else 'Cayma' end as distrito, k % 3 = 0 as district_fixed from c""")
def repaired_listings(spark, d):
    """C-44: phones that are a part of the id, and districts that the title contradicts."""
    k = F.col("c_custkey")
    phone = F.when(k % 2 == 0, F.concat(F.lit("987"), F.lpad(k.cast("string"), 6, "0"))).otherwise("")
    id = F.when(k % 4 == 0, F.concat(F.lit("9_"), phone)).otherwise(F.concat(F.lit("9_"), k.cast("string")))
    said = F.when(k % 4 == 0, "cel 912345678").when(k % 4 == 2, F.concat(F.lit("cel "), phone)).otherwise("sin nada")
    rows = table(spark, d, "customer").select(k.alias("k"), id.alias("id_publicacion"), F.when(k % 3 == 0, "Lote en Yura").otherwise("Lote").alias("titulo"), said.alias("descripcion"), F.lit("Cayma").alias("distrito"), phone.alias("telefono"))
    return captures.repaired(rows).select("k", "telefono", "phone_fixed", "distrito", "district_fixed")


@bound("""
with a as (select c_custkey as k, ['requested', 'completed', 'cancelled'][c_custkey % 3 + 1] as status, case when c_custkey % 10 = 0 then 'https://x/REEMPLAZAR' else 'https://x/' || c_custkey end as url from customer)
select 'requested' as filter, count(*) as n from a where status = 'requested' union all select 'all', count(*) from a union all select 'nonsense', count(*) from a union all select 'groups', count(*) from a where not contains(url, 'REEMPLAZAR')""")
def state_filters(spark, d):
    """F-21, F-19: customers as actions by state, and as groups without those that nobody has filled in."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("k"), F.element_at(F.array(F.lit("requested"), F.lit("completed"), F.lit("cancelled")), (k % 3 + 1).cast("int")).alias("status"), F.when(k % 10 == 0, "https://x/REEMPLAZAR").otherwise(F.concat(F.lit("https://x/"), k.cast("string"))).alias("url"))
    n = lambda df, name: df.agg(F.lit(name).alias("filter"), F.count(F.lit(1)).alias("n"))
    out = n(views.without_placeholders(rows), "groups")
    for s in ("requested", "all", "nonsense"):
        out = out.unionByName(n(captures.action_filter(rows, s), s))
    return out


@bound(f"""
with c as (select c_custkey as ordinal, case c_custkey % 4 when 0 then '9_' || c_custkey else 'k' || c_custkey end as key, case when c_custkey % 4 = 3 then '#' else '{FB}/groups/9/posts/' || case when c_custkey % 4 = 2 then 500000 + c_custkey else c_custkey end end as href from customer)
select ordinal::bigint as ordinal, 'linked_key' as action, key as id from c where ordinal % 4 = 0
union all select ordinal, 'linked_text', '9_t' || ordinal from c where ordinal % 4 = 1
union all select ordinal, 'deleted', '9_d' || ordinal from c where ordinal % 4 = 2""")
def backfilled_links(spark, d):
    """J-08: customers as cards that give their link to the row of their key, else to the open row that says the same, else show a row of the same link to be a copy."""
    k = F.col("c_custkey")
    n = k.cast("string")
    said = F.concat(F.lit("terreno codigo"), n, F.lit(" esquina"), n, F.lit(" parque"), n)
    href = F.when(k % 4 == 3, "#").when(k % 4 == 2, F.concat(F.lit(f"{FB}/groups/9/posts/"), (k + 500000).cast("string"))).otherwise(F.concat(F.lit(f"{FB}/groups/9/posts/"), n))
    c = table(spark, d, "customer")
    cards = c.select(k.alias("ordinal"), F.when(k % 4 == 0, F.concat(F.lit("9_"), n)).otherwise(F.concat(F.lit("k"), n)).alias("key"), href.alias("href"), F.when(k % 4 == 2, F.concat(F.lit("unico"), n)).otherwise(said).alias("text"))
    id = F.when(k % 4 == 0, F.concat(F.lit("9_"), n)).when(k % 4 == 1, F.concat(F.lit("9_t"), n)).otherwise(F.concat(F.lit("9_d"), n))
    stored = c.filter(k % 4 < 3).select(id.alias("id"), F.when(k % 4 == 2, href).otherwise(f"{FB}/groups/9").alias("url"), F.when(k % 4 == 1, said).otherwise("x").alias("title"), F.lit("").alias("description"))
    return linkage.backfill(cards, stored, "9").select(F.col("ordinal").cast("long").alias("ordinal"), "action", "id")


@bound("""
select o_orderkey as k, ['Cayma', 'Yura', ''][o_orderkey % 3 + 1] as distrito, ['title', 'title', 'none'][o_orderkey % 3 + 1] as distrito_origen, [40000.0, 1000.0 + o_orderkey, null][o_orderkey % 3 + 1]::double as precio, ['PEN', 'USD', ''][o_orderkey % 3 + 1] as moneda, [300, null, null][o_orderkey % 3 + 1]::bigint as m2,
['999888777', '987654321', null][o_orderkey % 3 + 1] as telefono, ['lote', 'casa', 'otro'][o_orderkey % 3 + 1] as tipo, ['hace 2 horas', 'hoy', 'hoy'][o_orderkey % 3 + 1] as fecha_publicacion, ['grupo', 'marketplace', 'marketplace'][o_orderkey % 3 + 1] as fuente from orders""")
def card_listings(spark, d):
    """P-06: cards of three kinds as listings: one whose poster corrects its price, one that says all, one that says nothing."""
    k = F.col("o_orderkey")
    n = k.cast("string")
    of = lambda *v: F.element_at(F.array(*[x if not isinstance(x, str | None) else F.lit(x).cast("string") for x in v]), (k % 3 + 1).cast("int"))
    cards = table(spark, d, "orders").select(
        of(F.concat(F.lit("9_"), n), F.concat(F.lit("x"), n), F.concat(F.lit("x"), n)).alias("key"), of(F.concat(F.lit("https://f.com/groups/9/posts/"), n), "https://f.com/x", "https://f.com/y").alias("href"), of("lote bonito en Yura hace 2 horas", "Casa en Yura cel 987654321", "sin datos").alias("text"), F.lit("").alias("label"), F.lit("").alias("image_url"),
        of("Lote en Cayma", "Casa en Yura", "Facebook").alias("raw_title"), of("S/ 35", F.concat(F.lit("US$ "), (k + 1000).cast("string")), None).alias("raw_price"), F.lit("").alias("raw_location"), of("S/ 40,000 300 m2 999888777", None, None).alias("ocr"), k.alias("k"),
    )
    out = captures.listings(cards, "2026-01-02 03:04:05")
    id = F.regexp_replace("id_publicacion", "^(9_|x)", "").cast("long")
    return out.select(id.alias("k"), "distrito", "distrito_origen", "precio", "moneda", "m2", "telefono", "tipo", "fecha_publicacion", "fuente")


@bound("""
with w as (select n_nationkey as k, n_name, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda x: upper(x[1:1]) || x[2:]), ' ') as plain from nation),
c as (select c_custkey as k, c_nationkey, c_acctbal, c_custkey % 4 as s from customer)
select c.k, plain, plain || ' S.A.C.' as dotted, case s when 0 then (1000 + c.k)::double + 0.5 when 1 then (1000 + c.k)::double when 2 then c.k::double + 0.25 end as last_separator, case s when 0 then (1000 + c.k)::double + 0.5 when 1 then (1000 + c.k)::double when 2 then (c.k * 100 + 25)::double end as commas_thousands, nullif(concat_ws(', ', case when s > 0 then 'Urb. ' || c.k end, case when s > 1 then n_name end), '') as address
from c join w on w.k = c_nationkey""")
def name_readings(spark, d):
    """C-24, C-33, C-35: names in two cases, amounts by two rules, addresses of the parts that are there."""
    k = F.col("c_custkey")
    n = k.cast("string")
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    whole = F.format_string("%d", k + 1000)
    grouped = F.concat(F.floor((k + 1000) / 1000).cast("string"), F.lit(","), F.lpad(((k + 1000) % 1000).cast("string"), 3, "0"))
    s = k % 4
    amount = F.when(s == 0, F.concat(F.lit("S/ "), grouped, F.lit(".5"))).when(s == 1, F.concat(whole, F.lit(".00"))).when(s == 2, F.concat(n, F.lit(",25")))
    return rows.select(k.alias("k"), text.title_case(F.col("n_name")).alias("plain"), text.title_case_acronyms(F.concat("n_name", F.lit(" s.a.c."))).alias("dotted"), text.last_separator_number(amount).alias("last_separator"), text.number_commas_thousands(amount).alias("commas_thousands"), text.address(F.when(s > 0, F.concat(F.lit(" Urb. "), n)), F.when(s > 1, F.col("n_name")).otherwise(" ")).alias("address"))


@bound("""
select o_orderkey as k, case when o_orderkey % 2 = 0 then 'N' || o_orderkey when o_orderkey % 3 = 0 then 'r' || o_orderkey end as number, case when o_orderkey % 2 = 0 then 'here' else o_orderpriority end as place, case when o_orderkey % 2 = 0 then o_orderkey end as auction_id from orders""")
def auction_entries(spark, d):
    """P-11: orders as auctions with JSON of their own, normalised for half of them."""
    k = F.col("o_orderkey")
    n = k.cast("string")
    raw = F.when(k % 2 == 0, F.to_json(F.struct(F.concat(F.lit("r"), n).alias("partida"), F.struct(F.concat(F.lit("N"), n).alias("partida"), F.lit("here").alias("ubicacion"), k.alias("remateId")).alias("normalized")))).when(k % 3 == 0, F.to_json(F.struct(F.concat(F.lit("r"), n).alias("partida"))))
    items = table(spark, d, "orders").select(n.alias("external_id"), F.lit("u").alias("source_url"), F.lit("t").alias("title"), F.col("o_orderpriority").alias("district"), raw.alias("raw_data"))
    return views.auction_entry(items).select(F.col("external_id").cast("long").alias("k"), "number", "place", "auction_id")


@bound("""
select o_orderkey as id, o_orderkey % 3 = 0 as found, case when o_orderkey % 3 = 0 then o_orderpriority end as title from orders""")
def wanted_details(spark, d):
    """S-17, S-19: details of all orders, of which a third are at their source."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(F.lit("registry").alias("source"), k.cast("string").alias("id"), F.col("o_orderpriority").alias("title"))
    items = readers.with_default(o.filter("false"), o.filter(F.col("id").cast("long") % 3 == 0))
    return readers.details(items, o.select("source", "id")).select(F.col("id").cast("long").alias("id"), "found", "title")


@bound("""
select 'inicio,fin,busquedas,nuevos,estado' as line, 1 as n union all
select strftime(day, '%Y-%m-%d') || ',' || ' ' || ',' || n || ',' || fresh || ',"fin, ok"', 1 from (select o_orderdate as day, count(*) as n, count(*) filter (where o_orderkey % 2 = 0) as fresh from orders group by 1)""")
def run_log(spark, d):
    """K-07: a line for each day of orders, written in two goes, after one header."""
    days = table(spark, d, "orders").groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey") % 2 == 0).alias("fresh"))
    lines = days.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("inicio"), F.lit("\t").alias("fin"), F.col("n").alias("busquedas"), F.col("fresh").alias("nuevos"), F.lit("fin, ok").alias("estado"))
    path = shared_path(spark, "log")
    for k in range(2):
        sinks.append_log(lines.filter(F.month("inicio") % 2 == k), path, first=k == 0)
    read = spark.read.option("lineSep", "\r\n").text(path)
    return read.groupBy(F.replace("value", F.lit(sinks.MARK), F.lit("")).alias("line")).agg(F.count(F.lit(1)).cast("int").alias("n"))
