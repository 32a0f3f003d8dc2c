"""Pages as rows of tags, elements with where they end, and what stands in what: the base of the card readers in cards.py.

A page is read once by patterns; nesting comes from running sums over its tags, so that every question about it is a
window or an equi-join. Nothing but one page's tags ever meets in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catastra.functions.text import folded

TAG = r"""</?[A-Za-z][A-Za-z0-9-]*(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
HIDDEN = r"(?is)<!--.*?-->|<(script|style|noscript|template)\b[^>]*+>.*?</\1\s*+>"
#: What stands for < inside hidden parts, so that no tag is seen in them.
MASK = "\x01"
MASKED = r"(?is)\x01!--.*?-->|\x01(script|style|noscript|template)\b[^>]*+>.*?\x01/\1\s*+>"
# Elements without an end; those whose end may be missing, so that they hold nothing for certain; those that part no words.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
LOOSE = ["p", "li", "dt", "dd", "option", "tr", "td", "th", "thead", "tbody", "tfoot", "colgroup"]
INLINE = ["a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "font", "i", "kbd", "label", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "var", "wbr"]


def unescaped(c: Column) -> Column:
    for a, b in (("&nbsp;", " "), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def parsed(pages: DataFrame, html: str) -> DataFrame:
    """pages with `tags`, an array of struct(tag, raw, text): each tag, and what follows it as it is written and as it is shown."""
    hidden = F.transform(F.regexp_extract_all(html, F.lit(HIDDEN), F.lit(0)), lambda h: F.translate(h, "<", MASK))
    clean = F.array_join(F.zip_with(F.split(html, HIDDEN, -1), hidden, lambda a, h: F.concat(a, F.coalesce(h, F.lit("")))), "")

    def row(tag: Column, after: Column) -> Column:
        blank = F.when(F.lower(F.regexp_extract(tag, r"^</?([A-Za-z0-9-]+)", 1)).isin(*INLINE), "").otherwise(" ")
        return F.struct(tag.alias("tag"), F.translate(after, MASK, "<").alias("raw"), F.concat(blank, unescaped(F.regexp_replace(after, MASKED, " "))).alias("text"))

    found = F.regexp_extract_all("_clean", F.lit(TAG), F.lit(0))
    return pages.withColumn("_clean", clean).withColumn("tags", F.zip_with(found, F.slice(F.split("_clean", TAG, -1), 2, F.size(found)), row)).drop("_clean")


def attribute(name: str, tag: str = "tag") -> Column:
    """The value of an attribute of a tag; null if it has none, blank if it has no value."""
    before = r"""(?is)^<[a-z][a-z0-9-]*(?:\s+[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*?"""
    value = rf"""{before}\s+{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    there = F.col(tag).rlike(rf"{before}\s+{name}(?=[\s=>/])")
    return F.when(there, unescaped(F.concat(*[F.regexp_extract(tag, value, k) for k in (1, 2, 3)])))


def elements(page: DataFrame, key: str) -> DataFrame:
    """(key, at, end, name, tag) of the elements of parsed pages: numbers of the tags that open and close them.

    Tags of one name are paired by their depth among themselves, so what is left open elsewhere does no harm. Void ones end
    where they begin, unclosed ones with the page.
    """
    rows = page.select(key, F.size("tags").alias("_n"), F.posexplode("tags").alias("at", "_t")).select(key, "_n", "at", F.col("_t.tag").alias("tag"))
    rows = rows.withColumn("name", F.lower(F.regexp_extract("tag", r"^</?([A-Za-z0-9-]+)", 1))).withColumn("_closes", F.startswith("tag", F.lit("</")))
    void = F.col("name").isin(*VOID) | F.endswith("tag", F.lit("/>"))
    level = F.sum(F.when(void, 0).when(F.col("_closes"), -1).otherwise(1)).over(Window.partitionBy(key, "name").orderBy("at"))
    rows = rows.withColumn("_void", void).withColumn("_level", level + F.when(F.col("_closes"), 1).otherwise(0))
    turn = Window.partitionBy(key, "name", "_void", "_level").orderBy("at")
    after = F.lead(F.struct("at", "_closes")).over(turn)
    end = F.when(F.col("_void"), F.col("at")).when(after["_closes"], after["at"]).otherwise(F.col("_n") - 1)
    return rows.withColumn("end", end).filter(~F.col("_closes")).select(key, "at", "end", "name", "tag")


def closest(inner: DataFrame, outer: DataFrame, key: str, to: str, itself: bool = True) -> DataFrame:
    """inner(key, at, ...) with `to`: the number of the innermost element of outer(key, at, end) that it stands in, itself too if so wanted; null if there is none.

    Depth is a running sum over what opens and closes; the last of outer that opened at a row's depth is the one around it.
    """
    rest = [c for c in inner.columns if c != key]
    none = F.lit(None)
    payload = F.struct(*rest)
    kind = inner.select(payload.alias("x")).schema["x"].dataType
    rows = inner.select(key, F.col("at").alias("_p"), F.lit(1 if itself else -1).alias("_k"), F.lit(0).alias("_d"), none.cast("int").alias("_o"), payload.alias("_x"))
    opens = outer.select(key, F.col("at").alias("_p"), F.lit(0).alias("_k"), F.lit(1).alias("_d"), F.col("at").cast("int").alias("_o"), none.cast(kind).alias("_x"))
    closes = outer.select(key, F.col("end").alias("_p"), F.lit(2).alias("_k"), F.lit(-1).alias("_d"), none.cast("int").alias("_o"), none.cast(kind).alias("_x"))
    depth = F.sum("_d").over(Window.partitionBy(key).orderBy("_p", "_k").rowsBetween(Window.unboundedPreceding, 0))
    events = rows.unionByName(opens).unionByName(closes).withColumn("_level", depth).filter("_d >= 0")
    around = F.last("_o", ignorenulls=True).over(Window.partitionBy(key, "_level").orderBy("_p", "_k").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("_o", F.when(F.col("_level") > 0, around)).filter("_d = 0").select(key, "_x.*", F.col("_o").alias(to))


def enclosing(inner: DataFrame, outer: DataFrame, key: str, to: str) -> DataFrame:
    """inner with a row for each element of outer that it stands in (itself too): as many rounds as elements of outer nest."""
    up = closest(outer.select(key, "at", "end"), outer, key, "_up", itself=False).select(key, F.col("at").alias(to), "_up")
    found = closest(inner, outer, key, to).filter(F.col(to).isNotNull())
    out = found
    while True:
        found = found.join(up, [key, to]).filter("_up is not null").drop(to).withColumnRenamed("_up", to).select(*out.columns)
        if found.isEmpty():
            return out
        out = out.unionByName(found)


def shown(at: str = "at", end: str = "end", tags: str = "tags") -> Column:
    """The text of an element, blanks folded."""
    return folded(F.array_join(F.transform(F.slice(tags, F.col(at) + 1, F.greatest(F.col(end) - F.col(at), F.lit(0))), lambda t: t["text"]), ""))


def written(at: str = "at", end: str = "end", tags: str = "tags") -> Column:
    """The element as it stands in the page."""
    return F.array_join(F.transform(F.slice(tags, F.col(at) + 1, F.col(end) - F.col(at) + 1), lambda t: F.concat(t["tag"], t["raw"])), "")
