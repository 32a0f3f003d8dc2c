"""Cards of captured pages (S-11 to S-13, A-12): what the readers in the browser would give, from the pages' text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catastra.functions import captures
from catastra.functions.captures import BASE, or_blank
from catastra.functions.text import blank_to_null, folded, trimmed
from catastra.operators.markup import LOOSE, attribute, closest, elements, enclosing, parsed, shown, written
from catastra.sources.shared import staged

# Words that show when something was published; weights of a link by what it looks like.
WHEN = r"(?iu)(?<![\p{L}\p{N}_])\d+\s*(?:min|seg|hora?s?|d[ií]as?|sem|semanas?|mes|meses|año|h(?![\p{L}\p{N}_])|s(?![\p{L}\p{N}_]))"
SAME_GROUP, SHOWS_TIME, POSTS, PHOTO, COMMENT, TIME_LINK, DESCRIBED, ENOUGH = 4, 3, 2, 1, -3, 10, 5, 5


def first_of(rows: DataFrame, by: list[str], order: str, *columns: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min(F.struct(*dict.fromkeys([order, *columns]))).alias("_m")).select(*by, *[F.col(f"_m.{c}") for c in columns])


def opened(pages: DataFrame, key: str, html: str) -> tuple[DataFrame, DataFrame]:
    page = staged(parsed(pages, html).drop(html))
    return page, staged(elements(page, key))


def marketplace_cards(pages: DataFrame, key: str, html: str) -> DataFrame:
    """S-11: (key, card, href, text, label, image, title, price, location) of the items that each page links to, each once.

    A card is the nearest search result, else the nearest article, around the first link to the item, or the link itself. Its label, or
    else its text, holds title, price and place between commas.
    """
    page, every = opened(pages, key, html)
    item = F.regexp_extract(or_blank(attribute("href")), r"/marketplace/item/(\d+)", 1)
    links = every.filter("name = 'a'").withColumn("href", attribute("href")).withColumn("card", item).filter("card <> ''").withColumn("label", trimmed(or_blank(attribute("aria-label"))))
    links = links.join(first_of(links, [key, "card"], "at", "at"), [key, "card", "at"])
    tests = [F.contains(or_blank(attribute("data-testid")), F.lit("marketplace_search_feed_result")), F.contains(or_blank(attribute("data-testid")), F.lit("rs-result")), attribute("role") == "article"]
    for k, test in enumerate(tests):
        links = closest(links, every.filter(test), key, f"_c{k}")
    links = links.withColumn("box", F.coalesce(*[F.col(f"_c{k}") for k in range(len(tests))], F.col("at")))
    boxes = links.select(key, F.col("box").alias("at")).distinct().join(every, [key, "at"])
    images = every.filter("name = 'img'").withColumn("src", attribute("src")).filter(F.startswith("src", F.lit("http")))
    images = first_of(enclosing(images.select(key, "at", "src"), boxes, key, "box"), [key, "box"], "at", "src")
    boxes = boxes.join(page.select(key, "tags"), key).select(key, F.col("at").alias("box"), shown().alias("text"))
    out = links.join(boxes, [key, "box"]).join(images, [key, "box"], "left")
    image = F.when(~F.contains("src", F.lit("data:")), F.col("src"))
    parts = captures.card_parts(F.when(F.col("label") != "", F.col("label")).otherwise(F.col("text")))
    href = F.when(F.startswith("href", F.lit("http")), F.col("href")).otherwise(F.concat(F.lit(BASE), "href"))
    return out.select(key, "card", href.alias("href"), "text", "label", or_blank(image).alias("image"), parts.alias("p")).select(key, "card", "href", "text", "label", "image", "p.*")


def portal_cards(pages: DataFrame, key: str, html: str, origin: str, source: str) -> DataFrame:
    """S-13: (key, card, title, price, location, description, features, image, href, phone, source) of the cards of a portal's pages, source adondevivir or urbania.

    Parts are the first of their selectors whose nearest card is theirs. Cards without a key go, and those without place, price and
    link. href is the card's own address, else its first link, resolved against `origin`; else the page's (null here).
    """
    page, every = opened(pages, key, html)
    kind, qa = or_blank(attribute("class")), or_blank(attribute("data-qa"))
    is_card = (F.col("name") == "div") & (F.startswith(qa, F.lit("posting")) | F.contains(kind, F.lit("postingCardLayout"))) | (F.col("name") == "article") & attribute("data").isNotNull()
    cards = staged(every.filter(is_card))
    box = closest(every, cards, key, "card", itself=False).filter("card is not null")
    galleries = every.filter(kind.rlike(r"(?:^|\s)postingGallery(?:\s|$)") | (qa == "POSTING_CARD_GALLERY"))
    pictures = closest(box.filter("name = 'img'"), galleries, key, "_g", itself=False).filter("_g is not null").withColumn("src", attribute("src")).filter("src is not null")
    tests = {
        "title": (qa == "POSTING_CARD_LOCATION") | F.col("name").isin("h2", "h3"), "price": (qa == "POSTING_CARD_PRICE") | F.contains(kind, F.lit("price")),
        "description": (qa == "POSTING_CARD_DESCRIPTION") | F.contains(kind, F.lit("Description")), "features": (qa == "POSTING_CARD_FEATURES") | F.contains(kind, F.lit("posting-main-features-block")),
    }
    named = F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])
    parts = box.select(key, "card", "at", "end", F.explode(F.array_compact(named)).alias("part"))
    parts = parts.join(first_of(parts, [key, "card", "part"], "at", "at"), [key, "card", "part", "at"]).join(page.select(key, "tags"), key)
    parts = parts.groupBy(key, "card").pivot("part", list(tests)).agg(F.first(shown()))
    links = box.filter("name = 'a'").withColumn("link", attribute("href")).filter("link is not null")
    chat = links.filter(F.contains("link", F.lit("wa.me")) | F.contains("link", F.lit("whatsapp")))
    chat = first_of(chat, [key, "card"], "at", "link").withColumn("phone", F.regexp_extract("link", r"phone=(\d+)", 1)).drop("link")
    own = cards.select(key, F.col("at").alias("card"), F.coalesce(blank_to_null(attribute("data-id")), blank_to_null(attribute("id"))).alias("own"), blank_to_null(attribute("data-to-posting")).alias("to")).filter("own is not null")
    out = own.join(parts, [key, "card"], "left").join(first_of(links, [key, "card"], "at", "link"), [key, "card"], "left").join(first_of(pictures, [key, "card"], "at", "src"), [key, "card"], "left").join(chat, [key, "card"], "left")
    raw = F.coalesce("to", blank_to_null(F.col("link")))
    href = F.when(raw.rlike("(?i)^[a-z][a-z0-9+.-]*:"), raw).when(F.startswith(raw, F.lit("//")), F.concat(F.lit("https:"), raw)).otherwise(F.concat(F.lit(origin.rstrip("/") + "/"), F.regexp_replace(raw, "^/+", "")))
    prefix = "av-" if source == "adondevivir" else "urb-"
    name = F.when(F.startswith("own", F.lit(prefix)), F.col("own")).otherwise(F.concat(F.lit(prefix), "own"))
    t = {n: or_blank(F.col(n)) for n in tests}
    out = out.filter((t["title"] != "") | (t["price"] != "") | href.isNotNull())
    return out.select(key, name.alias("card"), t["title"].alias("title"), t["price"].alias("price"), t["title"].alias("location"), t["description"].alias("description"), t["features"].alias("features"), or_blank(F.col("src")).alias("image"), href.alias("href"), or_blank(F.col("phone")).alias("phone"), F.lit(source).alias("source"))


def without_icons(c: Column) -> Column:
    return folded(F.regexp_replace(c, r"(?i)\b(?:Facebook\s*){2,}", " "))


def group_cards(pages: DataFrame, key: str, html: str, group: str) -> DataFrame:
    """S-12, A-12: (key, position, card, href, text, label, image, title) of the publications in each page of a group's feed, each post once.

    Cards are the feed's children, then other articles. A card's links are weighed by what they look like; the first of the
    heaviest is its own. If none is heavy enough, links around a time count most; if there is none at all, those of the parts that
    describe the card. A post that the card's data names stands in for a link below zero. Without any of these the key is
    made of the text (C-18), and the link a search. Cards with under 15 characters and the feed's own bar are left out.
    """
    page, every = opened(pages, key, html)
    firm = every.filter(~F.col("name").isin(*LOOSE))
    feeds = first_of(every.filter(attribute("role") == "feed"), [key], "at", "at").withColumnRenamed("at", "feed")
    children = closest(firm, firm, key, "up", itself=False).join(feeds, key).filter("up = feed").select(key, "at", "end", "tag", F.lit(0).alias("turn"))
    is_article = (attribute("role") == "article") | (attribute("data-ad-preview") == "message") | attribute("aria-describedby").isNotNull()
    articles = every.filter("name = 'div'").filter(is_article).select(key, "at", "end", "tag", F.lit(1).alias("turn"))
    boxes = children.unionByName(articles).groupBy(key, "at", "end", "tag").agg(F.min("turn").alias("turn"))
    texts = boxes.join(page.select(key, group, "tags"), key).withColumn("raw", without_icons(shown())).filter(F.length("raw") >= 15).filter(~(F.col("raw").rlike("(?i)ordenar feed del grupo") & (F.length("raw") < 120)))
    cards = staged(texts.select(key, group, "at", "end", "tag", "turn", "raw", written().alias("markup"), attribute("aria-describedby").alias("by")))
    only = cards.select(key, "at", "end")

    images = enclosing(every.filter("name = 'img'").select(key, "at", attribute("alt").alias("alt"), or_blank(attribute("src")).alias("src")), only, key, "card")
    told = F.length("alt") > 10
    alt = F.when(told & ~F.contains("alt", F.lit("may be an image of")), F.struct("at", "alt"))
    usable = F.startswith("src", F.lit("http")) & ~F.contains("src", F.lit("static")) & ~F.contains("src", F.lit("rsrc"))
    images = images.groupBy(key, "card").agg(F.array_join(F.transform(F.array_sort(F.collect_list(alt)), lambda a: a["alt"]), " ").alias("alts"), F.min(F.when(usable, F.struct("at", "src")))["src"].alias("image"))

    anchors = every.filter("name = 'a'").withColumn("href", trimmed(or_blank(attribute("href")))).filter("href <> ''")
    times = closest(every.filter("name = 'time'"), anchors, key, "link").filter("link is not null")
    timed = times.select(key, F.col("link").alias("at")).distinct().withColumn("timed", F.lit(True))
    links = anchors.join(page.select(key, group, "tags"), key).withColumn("p", captures.post_link(F.col("href"), F.col(group))).filter("p is not null").withColumn("words", shown())
    links = staged(links.join(timed, [key, "at"], "left").select(key, group, "at", "href", "p", "words", "timed"))
    raw, mine = F.col("href"), F.concat(F.lit("groups/"), F.col(group))
    weigh = lambda test, n: F.when(test, n).otherwise(0)
    score = weigh(F.contains(raw, mine) | F.contains("p.url", mine), SAME_GROUP) + weigh(F.coalesce("timed", F.lit(False)) | F.col("words").rlike(WHEN), SHOWS_TIME) + weigh(raw.rlike("/groups/[^/]+/posts/"), POSTS) + weigh(raw.rlike(r"set=gm\."), PHOTO) + weigh(F.contains(raw, F.lit("comment_id=")), COMMENT)
    plain = enclosing(links.withColumn("score", score).drop("words", "timed", "href", group), only, key, "card").select(key, "card", F.lit(0).alias("way"), "at", "score", "p")
    plain = staged(plain.filter(~F.col("p.url").rlike(r"^https?://[^/]+/groups/[^/?#]+/?$")))
    best = plain.groupBy(key, "card").agg(F.max("score").alias("top"))
    by_time = enclosing(times.select(key, "at", "link"), only, key, "card").join(links.select(key, F.col("at").alias("link"), "p"), [key, "link"])
    by_time = by_time.join(best, [key, "card"], "left").filter(F.coalesce("top", F.lit(-99)) < ENOUGH).select(key, "card", F.lit(1).alias("way"), "at", F.lit(TIME_LINK).alias("score"), "p")
    named = first_of(every.withColumn("id", attribute("id")).filter("id <> ''"), [key, "id"], "at", "at", "end")
    parts = cards.select(key, F.col("at").alias("card"), F.explode(F.split(trimmed(F.col("by")), r"\s+")).alias("id")).filter("id <> ''").join(named, [key, "id"])
    inside = enclosing(links.select(key, "at", "p"), parts.select(key, "at", "end").distinct(), key, "part")
    described = parts.select(key, "card", F.col("at").alias("part")).join(inside, [key, "part"]).select(key, "card", F.lit(2).alias("way"), "at", F.lit(DESCRIBED).alias("score"), "p")
    described = described.join(plain.unionByName(by_time).select(key, "card").distinct(), [key, "card"], "left_anti")
    chosen = plain.unionByName(by_time).unionByName(described).groupBy(key, "card").agg(F.min(F.struct((-F.col("score")).alias("less"), "way", "at", "p")).alias("b")).select(key, "card", (-F.col("b.less")).alias("score"), "b.p.post", "b.p.url")

    number = lambda k: F.when(F.get_json_object("ft", f"$.{k}").rlike(r"^\d+$"), F.get_json_object("ft", f"$.{k}"))
    data = enclosing(every.withColumn("ft", attribute("data-ft")).filter("ft is not null").select(key, "at", number("top_level_post_id").alias("top"), F.coalesce(*[number(k) for k in ("mf_story_key", "story_fbid", "post_id")]).alias("other")), only, key, "card")
    data = data.groupBy(key, "card").agg(F.coalesce(F.min(F.when(F.col("top").isNotNull(), F.struct("at", "top")))["top"], F.min(F.when(F.col("other").isNotNull(), F.struct("at", "other")))["other"]).alias("real"))

    out = cards.withColumnRenamed("at", "card").join(images, [key, "card"], "left").join(chosen, [key, "card"], "left").join(data, [key, "card"], "left")
    out = out.withColumn("full", without_icons(F.concat_ws(" ", "raw", blank_to_null(F.col("alts"))))).withColumn("real", F.coalesce("real", captures.post_from_markup(F.col("markup")))).withColumn("image", or_blank(F.col("image")))
    use = F.col("url").isNotNull() & ((F.col("score") >= 0) | F.col("real").isNull())
    words = captures.search_words(F.col("full"), prefix=100)
    home = F.concat(F.lit(f"{BASE}/groups/"), F.col(group))
    search = F.when(words == "", home).otherwise(F.concat(home, F.lit("/search/?q="), F.replace(F.url_encode(words), F.lit("+"), F.lit("%20"))))
    post = F.when(use, F.col("post")).otherwise(F.coalesce("real", captures.synthetic_key(F.col("full"), F.col("image"))))
    href = F.when(use, F.col("url")).when(F.col("real").isNotNull(), F.concat(home, F.lit("/posts/"), "real")).otherwise(search)
    says = trimmed(F.regexp_replace("full", r"(?i)^\s*(?:Facebook\s*)+", ""))
    title = lambda n: F.coalesce(blank_to_null(F.substring(says, 1, n)), F.substring("full", 1, n))
    out = out.select(key, "turn", F.col("card").alias("at"), F.concat_ws("_", group, post).alias("card"), href.alias("href"), F.col("full").alias("text"), title(140).alias("label"), "image", title(100).alias("title"))
    rest = [c for c in out.columns if c not in (key, "card")]
    once = out.groupBy(key, "card").agg(F.min(F.struct(*rest)).alias("m")).select(key, "card", "m.*")
    return once.select(key, F.col("at").alias("position"), "card", "href", "text", "label", "image", "title")
