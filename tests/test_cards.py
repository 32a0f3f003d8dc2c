"""Cards from raw pages against a reader that walks a tree made by the standard parser."""

import html as h
import json
import random
import re
from html.parser import HTMLParser

import pytest

from catastra.operators import cards, markup

VOID = {"img", "br", "hr", "input", "meta", "link"}
INLINE = {"a", "b", "i", "em", "strong", "span", "time"}
G = "77"


class Node:
    def __init__(self, tag, attrs, parent, start):
        self.tag, self.attrs, self.parent, self.parts, self.start = tag, dict(attrs), parent, [], start

    def walk(self):
        yield self
        for p in self.parts:
            if isinstance(p, Node):
                yield from p.walk()

    def text(self):
        out = ""
        for p in self.parts:
            if isinstance(p, str):
                out += p
            else:
                gap = "" if p.tag in INLINE else " "
                out += gap + p.text() + gap
        return out

    def up(self, test):
        n = self
        while n and not test(n):
            n = n.parent
        return n

    def get(self, name):
        return self.attrs.get(name) if name in self.attrs else None


class Tree(HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.top = self.now = Node("#", {}, None, 0)
        self.page, self.lines = page, [0]
        for line in page.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(page)
        self.close()

    def at(self):
        line, col = self.getpos()
        return self.lines[line - 1] + col

    def handle_starttag(self, tag, attrs):
        n = Node(tag, attrs, self.now, self.at())
        self.now.parts.append(n)
        if tag not in VOID:
            self.now = n
        else:
            n.outer = self.get_starttag_text()

    def handle_endtag(self, tag):
        if tag not in VOID:
            self.now.outer = self.page[self.now.start : self.at() + len(tag) + 3]
            self.now = self.now.parent

    def handle_data(self, data):
        if self.now.tag not in ("script", "style"):
            self.now.parts.append(data)


fold = lambda s: " ".join(s.split())
icons = lambda s: fold(re.sub(r"\b(?:Facebook\s*){2,}", " ", s, flags=re.I))


def link_of(raw):
    if not raw or raw == "#":
        return None
    base = "https://www.facebook.com"
    if m := re.search(r"/groups/([^/?#]+)/(?:posts|permalink|multi_permalink)/([\w.-]+)", raw):
        return m[2], f"{base}/groups/{m[1]}/posts/{m[2]}"
    for p in (r"[?&]story_fbid=(\d+)(?:&|#|$)", r"[?&]multi_permalinks=(\d+)(?:&|#|$)", r"/photo(?:\.php)?\?(?:[^#]*&)?set=gm\.(\d+)"):
        if m := re.search(p, raw):
            return m[1], f"{base}/groups/{G}/posts/{m[1]}"
    m = re.search(r"/share/[pvg]/([A-Za-z0-9_-]+)", raw)
    return m and (m[1], f"{base}/share/p/{m[1]}")


def made_key(text, image):
    def units(s):
        b = s.encode("utf-16-be")
        return [int.from_bytes(b[i : i + 2], "big") for i in range(0, len(b), 2)]

    x = 0
    for u in units(fold(text).lower())[:400] + units(f"|{len(units(text))}|{image}"):
        x = (x * 31 + u + 2**31) % 2**32 - 2**31
    n, out = abs(x), ""
    while n or not out:
        out, n = "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36] + out, n // 36
    return "p_" + out


def feed_cards(page):
    top = Tree(page).top
    every = list(top.walk())
    feed = next((n for n in every if n.get("role") == "feed"), None)
    boxes = [p for p in feed.parts if isinstance(p, Node)] if feed else []
    boxes += [n for n in every if n.tag == "div" and (n.get("role") == "article" or n.get("data-ad-preview") == "message" or n.get("aria-describedby") is not None) and n not in boxes]
    out = {}
    for box in boxes:
        raw = icons(box.text())
        if len(raw) < 15 or (re.search("ordenar feed del grupo", raw, re.I) and len(raw) < 120):
            continue
        inner = list(box.walk())
        alts, image = [], ""
        for i in (n for n in inner if n.tag == "img"):
            alt, src = i.get("alt") or "", i.get("src") or ""
            if len(alt) > 10 and "may be an image of" not in alt:
                alts.append(alt)
            if not image and src.startswith("http") and "static" not in src and "rsrc" not in src:
                image = src
        full = icons(" ".join([raw, *alts]))
        found = []
        for a in (n for n in inner if n.tag == "a" and n.get("href")):
            href = a.get("href").strip()
            got = link_of(href)
            if not got:
                continue
            score = 4 * (f"groups/{G}" in href or f"groups/{G}" in got[1])
            score += 3 * bool(any(n.tag == "time" for n in a.walk()) or re.search(r"\b(\d+\s*(min|seg|hora?s?|d[ií]as?|sem|semanas?|mes|meses|año|h\b|s\b))", fold(a.text()), re.I))
            score += 2 * bool(re.search("/groups/[^/]+/posts/", href)) + ("set=gm." in href) - 3 * ("comment_id=" in href)
            found.append((score, got))
        if not any(s >= 5 for s, _ in found):
            for t in (n for n in inner if n.tag == "time"):
                a = t.up(lambda n: n.tag == "a" and n.get("href"))
                if a and (got := link_of(a.get("href").strip())):
                    found.append((10, got))
        if not found:
            for part in (box.get("aria-describedby") or "").split():
                el = next((n for n in every if n.get("id") == part), None)
                for a in (n for n in el.walk() if n.tag == "a" and n.get("href")) if el else ():
                    if got := link_of(a.get("href").strip()):
                        found.append((5, got))
        best = max(found, key=lambda f: f[0], default=None)
        tops, others = [], []
        for n in inner:
            try:
                data = json.loads(n.get("data-ft") or "")
            except ValueError:
                continue
            tops += [str(data["top_level_post_id"])] if str(data.get("top_level_post_id", "")).isdigit() else []
            others += [str(data[k]) for k in ("mf_story_key", "story_fbid", "post_id") if str(data.get(k, "")).isdigit()][:1]
        real = (tops or others or [None])[0]
        if not real:
            m = re.search(r"""(?:story_fbid|top_level_post_id|stableID)["'\s]*[:=]["'\s]*"?(\d{10,})""", box.outer)
            real = m[1] if m else None
        home = f"https://www.facebook.com/groups/{G}"
        if best and (best[0] >= 0 or not real):
            post, url = best[1]
        elif real:
            post, url = real, f"{home}/posts/{real}"
        else:
            post, url = made_key(full, image), None
        out.setdefault(f"{G}_{post}", (url, full, image))
    return out


WORDS = ["Vendo", "terreno", "en Cayma", "lote", "casa &amp; jardín", "S/ 90 000", "Facebook Facebook", "mañana", "<b>gran</b>", "ocasión", "<br>", "área&nbsp;verde", "<!-- <a href='/groups/77/posts/000'>no</a> -->"]


def feed_page(r):
    number = lambda: str(r.randrange(10**10, 10**10 + 60))

    def link():
        n = number()
        href = r.choice([f"/groups/{G}/posts/{n}/", f"https://www.facebook.com/groups/{G}/permalink/{n}?comment_id=4", f"/groups/88/posts/{n}", f"/photo?fbid=3&amp;set=gm.{n}", f"/x?story_fbid={n}&amp;id=2", "/share/p/AbC_" + n, "#", "/user/9", "", f"/x?multi_permalinks={n}&amp;comment_id=1"])
        text = r.choice(["ver más", "3 h", "hace 2 días", "<time>ayer</time>", "12 min", "foto", "15 septiembre"])
        return f"""<a class="x" {r.choice(['', 'title="a > b" '])}href={r.choice(['"', "'"])}{href}{'"' if False else ''}""".replace("href='" + href, f"href='{href}'").replace('href="' + href, f'href="{href}"') + f">{text}</a>"

    def box(depth):
        body = " ".join(r.choice(WORDS) for _ in range(r.randint(1, 12)))
        body += " ".join(link() for _ in range(r.choice([0, 0, 1, 2, 4])))
        if r.random() < 0.3:
            body += f'<img alt="{r.choice(["foto de un terreno amplio", "corta", "may be an image of a house"])}" src="{r.choice(["https://i/1.jpg", "https://static/2.png", "/3.jpg"])}">'
        if r.random() < 0.15:
            body += f"""<span data-ft="{h.escape(json.dumps({r.choice(['top_level_post_id', 'mf_story_key', 'none']): number()}))}">.</span>"""
        if r.random() < 0.15:
            body += f'<script>var s = "<div>"; x = {{"story_fbid":"{number()}"}};</script>'
        if depth and r.random() < 0.4:
            body += box(depth - 1)
        kind = r.choice(['role="article"', 'data-ad-preview="message"', f'aria-describedby="d{r.randrange(4)} d9"', 'class="plain"', f'''role="article" data-ft='{{"story_fbid":"{number()}"}}' '''])
        return f"<div {kind}>{body}</div>"

    parts = "".join(f'<div id="d{i}">{link()}</div>' for i in range(3))
    feed = '<div role="feed"><div>Ordenar feed del grupo</div>' + "".join(box(2) for _ in range(r.randint(0, 5))) + "</div>" if r.random() < 0.8 else ""
    return f"<html><head><title>t</title></head><body>{parts}{feed}<section>{box(1)}{box(2)}</section></body></html>"


def test_feed_cards(spark):
    r = random.Random(1)
    pages = [(i, feed_page(r), G) for i in range(60)] + [(100, "", G), (101, None, G), (102, "no tags at all", G)]
    out = {}
    for x in cards.group_cards(spark.createDataFrame(pages, "page int, html string, gid string").repartition(4), "page", "html", "gid").collect():
        out.setdefault(x.page, {})[x.card] = (x.href, x.text, x.image)
    for i, page, _ in pages[:60]:
        want, got = feed_cards(page), out.get(i, {})
        assert got == {k: (url or got[k][0], full, image) for k, (url, full, image) in want.items()}
        assert all("/search/?q=" in got[k][0] or got[k][0].endswith(f"/groups/{G}") for k, (url, *_) in want.items() if not url)
    assert sum(map(len, out.values())) > 200 and not {100, 101, 102} & set(out)


@pytest.mark.parametrize(("tag", "name", "value"), [('<a href="x">', "href", "x"), ("<a title='href=\"y\"' HREF = z>", "href", "z"), ("<a data-href=x>", "href", None), ("<input disabled>", "disabled", ""), ("<a href='a &amp; b'>", "href", "a & b"), ('<a title="no > end" id=q>', "id", "q")])
def test_attributes(spark, tag, name, value):
    df = spark.createDataFrame([(tag,)], "tag string")
    assert df.select(markup.attribute(name).alias("v")).first().v == value


def test_marketplace_cards(spark):
    page = """<div data-testid="marketplace_search_feed_results"><div role="article"><img src="data:x"><a href="/marketplace/item/123/?ref=1" aria-label="Terreno en Cayma, S/ 90,000, Arequipa, AR, publicación 5"><span>Terreno</span> bonito</a> <img src="https://i/a.jpg"></div>
<a href="/marketplace/item/123/">again</a></div><div role="article"><p>Lote, 500</p><a href="https://www.facebook.com/marketplace/item/456/">ver</a></div><a href='/marketplace/item/9'>Casa</a><a href="/other">x</a>"""
    got = {r.card: r for r in cards.marketplace_cards(spark.createDataFrame([(1, page), (2, None)], "page int, html string"), "page", "html").collect()}
    assert set(got) == {"123", "456", "9"}
    a, b, c = got["123"], got["456"], got["9"]
    assert (a.href, a.title, a.price, a.location, a.image) == ("https://www.facebook.com/marketplace/item/123/?ref=1", "Terreno en Cayma, S/ 90, 000", "Arequipa", "AR", "https://i/a.jpg")
    assert a.text == "Terreno bonito again" and b.text == "Lote, 500 ver" and (b.title, b.price, b.image) == ("Lote", "500 ver", "")
    assert (c.text, c.title, c.label) == ("Casa", "Casa", "")


def test_portal_cards(spark):
    page = """<div data-qa="posting PROPERTY" data-id="11" data-to-posting="/propiedades/11.html"><div data-qa="POSTING_CARD_PRICE">S/ <b>90</b></div><h2> Cayma,  Arequipa </h2><h3>later</h3>
<div class="postingGallery x"><img alt="no source"><img src="https://i/1.jpg"></div><span data-qa="POSTING_CARD_FEATURES">120 m2</span><a href="https://wa.me/send?phone=51987654321">w</a></div>
<article data="x" id="av-12"><p class="Description-short">d</p><a href="ver/12">v</a></article><div class="big postingCardLayout-1" id="13"></div><div data-qa="posting"><h2>no key</h2></div>"""
    rows = cards.portal_cards(spark.createDataFrame([(1, page)], "page int, html string"), "page", "html", "https://portal.pe", "adondevivir").collect()
    got = {r.card: r for r in rows}
    assert set(got) == {"av-11", "av-12"}
    a, b = got["av-11"], got["av-12"]
    assert (a.title, a.price, a.features, a.description, a.image, a.href, a.phone) == ("Cayma, Arequipa", "S/ 90", "120 m2", "", "https://i/1.jpg", "https://portal.pe/propiedades/11.html", "51987654321")
    assert (b.title, b.price, b.description, b.href, b.phone) == ("", "", "d", "https://portal.pe/ver/12", "")
