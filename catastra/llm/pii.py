"""Operator 9: personal data and the terms that disclose it. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, plain_names, salted_join, staged, without

# Each pattern begins where a run begins or where the last match ended, and never gives characters back: the same
# matches as the plain pattern, in time linear in the text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM = r"[\p{L}\p{N}]{3,}"
SPANS = "array<struct<start:long,k:int,end:long,value:string>>"


def bind(value: Column, body) -> Column:
    """body(value), which is evaluated once, however often body speaks of it."""
    return F.get(F.transform(F.array(value), body), 0)


#: A running sum goes through so many values at a time.
STRETCH = 128


def running(values: Column, zero: Column, add) -> Column:
    """What add has gathered from all earlier values of an array, for each. Stretches are gathered first, so that no array grows value by value over all."""

    def scan(of: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(of, F.struct(start.alias("at"), F.slice(F.array(start), 1, 0).alias("out")), step, lambda acc: acc["out"])

    def over(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / STRETCH), F.lit(0)).cast("int")), lambda g: F.slice(v, g * STRETCH + 1, STRETCH))
        return F.flatten(bind(parts, lambda p: F.zip_with(p, scan(F.transform(p, lambda x: F.aggregate(x, zero, add)), zero), scan)))

    return bind(values, over)


def spans(text: Column, pattern: str, kind: int, valid=None) -> Column:
    """struct(start, k, end, value) of the matches that hold, in order; places count code points, from 0."""

    def of(p: Column) -> Column:
        sized = F.zip_with(F.slice(p["gaps"], 1, F.size(p["found"])), p["found"], lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), m.alias("value")))
        before = running(F.transform(sized, lambda x: x["gap"] + x["size"]), F.lit(0).cast("long"), lambda a, x: a + x)
        every = F.zip_with(sized, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("k"), (at + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")))
        return F.filter(every, lambda s: valid(s["value"])) if valid else every

    none = F.array().cast(SPANS)
    pieces = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"))
    return bind(pieces, lambda p: F.when(F.size(p["found"]) > 0, of(p)).otherwise(none))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = F.filter(F.split(F.reverse(digits(value)), ""), lambda c: c != "")
    doubled = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    octet = lambda p: F.try_to_number(F.regexp_replace(p, "^0+(?=[0-9])", ""), F.lit("999")) <= 255
    none = F.array().cast(SPANS)
    email = F.when(F.contains(text, F.lit("@")), spans(text, EMAIL, 0)).otherwise(none)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), spans(text, IP, 1, lambda m: F.forall(F.split(m, r"\."), lambda p: F.coalesce(octet(p), F.lit(False))))).otherwise(none)
    card = F.when(text.rlike("[0-9](?:[ -]?[0-9]){11}"), spans(text, CARD, 2, lambda m: F.length(digits(m)).between(12, 19) & luhn(m))).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), spans(text, PHONE, 3, lambda m: F.length(digits(m)).between(9, 15))).otherwise(none)
    return F.array_sort(F.concat(email, ip, card, phone))


def sanitise(docs: DataFrame, radius: int = 60, min_support: int = 3, generalise: float = 0.8, remove: float = 0.95, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with pii: array of struct(start, kind, end) in order, and sanitised: the text without what they cover.

    Base kinds (email, ip, card, phone) come from patterns. Each value found is a protected entity e. A term t (three
    letters or digits or more, in lower case) within `radius` characters of e, on the same line, discloses e by
    PMI(e; t) / IC(e) = 1 + log(p(e | t)) / -log(p(e)), with p(e | t) the entity's windows that hold t over all
    occurrences of t in the corpus (1 at most), and p(e) the entity's occurrences over all term occurrences. Terms of at
    least min_support windows are kinds generalised (from `generalise`; the text keeps their shape: word or number) or
    removed (from `remove`), wherever they stand in a text that has that entity, but for what a base span covers. All
    counts are of all texts.

    Null texts have no spans and stay null; empty texts have none. Repeated rows count each. An empty table gives an
    empty result. Columns of docs named pii or sanitised are replaced. Windows are of bounded length, so an entity or
    line of any frequency makes rows in proportion to its occurrences.
    """
    keep, names, (text,) = plain_names(without(docs, [c for c in ("pii", "sanitised") if c != text.lower()]), text)
    keep = keep.withColumn(text, F.col(text).cast("string"))
    marks = staged(keep.withColumn("_base", base_spans(F.coalesce(F.col(text), F.lit("")))).withColumn("_row", F.monotonically_increasing_id()))
    work = marks.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    hits = work.filter(F.size("_base") > 0)

    # windows of each entity occurrence
    e = hits.select("_row", "_text", F.explode("_base").alias("s"))
    value = F.when(F.col("s.k").isin(2, 3), digits(F.col("s.value"))).otherwise(F.lower("s.value"))
    lo = F.greatest(F.col("s.start") - radius - 1, F.lit(0).cast("long"))
    e = e.select("_row", F.concat_ws(":", F.col("s.k").cast("string"), value).alias("entity"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), lo.alias("lo"),
                 F.col("_text").substr((lo + 1).cast("int"), (F.col("s.start") - lo).cast("int")).alias("left"), F.col("_text").substr((F.col("s.end") + 1).cast("int"), F.lit(radius + 1)).alias("right"))
    # a term cut by the window's edge does not count: one more character is read on either side
    cut_off = lambda side: (F.length(side) > radius) & ~F.contains(F.col(side), F.lit("\n"))
    left = F.when(cut_off("left"), F.regexp_replace("left", r"^[\p{L}\p{N}]+", "")).otherwise(F.regexp_extract("left", r"[^\n]*\z", 0))
    right = F.when(cut_off("right"), F.regexp_replace("right", r"[\p{L}\p{N}]+\z", "")).otherwise(F.regexp_extract("right", r"^[^\n]*", 0))
    e = staged(e.select("_row", "entity", "start", "end", left.alias("left"), right.alias("right")))
    shifted = lambda side, by: F.transform(spans(F.col(side), TERM, 0), lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), F.lower(s["value"]).alias("term")))
    terms = F.concat(shifted("left", F.col("start") - F.length("left")), shifted("right", F.col("end")))
    windows = staged(e.select("_row", "entity", terms.alias("terms")))

    occurrences = staged(windows.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")))
    pairs = windows.select("entity", F.explode(F.array_distinct(F.transform("terms", lambda t: t["term"]))).alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te")).filter(F.col("n_te") >= min_support)
    corpus = work.select(F.explode(F.regexp_extract_all("_text", F.lit(TERM), 0)).alias("term")).groupBy(F.lower("term").alias("term")).agg(F.count(F.lit(1)).alias("n_t"))
    corpus = staged(corpus)
    total = corpus.agg(F.coalesce(F.sum("n_t"), F.lit(0))).first()[0]  # one number
    p_e = F.col("n_e") / F.greatest(F.lit(total), F.col("n_e") + 1)
    ratio = 1 + F.log(F.least(F.lit(1.0), F.col("n_te") / F.col("n_t"))) / -F.log(p_e)
    telling = pairs.join(corpus, "term").join(occurrences, "entity").withColumn("ratio", ratio).filter(F.col("ratio") >= generalise).select("entity", "term", F.when(F.col("ratio") >= remove, 5).otherwise(4).alias("k"))

    # a telling term goes wherever it stands in a text that has the entity: of each such text, its terms and what becomes of them
    told = telling.groupBy("entity").agg(F.collect_list(F.struct("term", "k")).alias("told"))
    of_row = salted_join(windows.select("_row", "entity").distinct(), told, "entity", "_row", hot=hot_keys(occurrences.select("entity", F.col("n_e").alias("count"))))
    of_row = of_row.select("_row", F.explode("told").alias("t")).groupBy("_row", F.col("t.term").alias("term")).agg(F.max("t.k").alias("k"))
    of_row = of_row.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("term", "k"))).alias("_terms"))
    kind_of = lambda s: F.element_at("_terms", F.lower(s["value"]))
    inside = F.filter(spans(F.col("_text"), TERM, 0), lambda s: kind_of(s).isNotNull())
    found = F.when(F.col("_terms").isNotNull(), F.transform(inside, lambda s: F.struct(s["start"].alias("start"), kind_of(s).alias("k"), s["end"].alias("end"), F.lit("").alias("value"))))
    name = F.array(*[F.lit(k) for k in (*KINDS, "generalised", "removed")])
    named = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.element_at(name, s["k"] + 1).alias("kind"), s["end"].alias("end")))
    covered = lambda s: F.exists("_base", lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))
    every = F.array_sort(F.concat("_base", F.filter(F.coalesce("_found", F.array().cast(SPANS)), lambda s: ~covered(s))))

    def cut(s: Column, at: Column) -> Column:
        """What stands before a span, and what becomes of it; nothing, if one that began before it covers its start."""
        shape = F.when(F.col("_text").substr((s["start"] + 1).cast("int"), F.lit(1)).rlike("[0-9]"), "[NUMBER]").otherwise("[WORD]")
        label = F.when(s["kind"] == "removed", "").when(s["kind"] == "generalised", shape).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        between = F.col("_text").substr((at + 1).cast("int"), F.greatest(s["start"] - at, F.lit(0).cast("long")).cast("int"))
        return F.when(s["start"] >= at, F.concat(between, label)).otherwise("")

    ends = F.transform("pii", lambda s: s["end"])
    pieces = F.zip_with("pii", running(ends, F.lit(0).cast("long"), lambda a, x: F.greatest(a, x)), cut)
    body = F.concat(F.array_join(pieces, ""), F.substring(F.col("_text"), (F.array_max(ends) + 1).cast("int"), F.length("_text")))
    marked = hits.join(of_row, "_row", "left").withColumn("_found", found).withColumn("pii", named(every))
    out = marked.drop("_found", "_terms").unionByName(work.filter(F.size("_base") == 0).withColumn("pii", named(F.col("_base"))))
    shown = F.when(F.col(text).isNotNull(), F.when(F.size("pii") > 0, body).otherwise(F.col("_text")))
    return out.withColumn("sanitised", shown).select(*keep.columns, "pii", "sanitised").toDF(*names, "pii", "sanitised")
