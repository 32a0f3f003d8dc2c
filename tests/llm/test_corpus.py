"""Operators that look at the whole table: mixing, language model, SimHash, shards, personal data, quotations."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from catastra.llm import common, lm, mixing, pii, quotes, sharding, simhash
from catastra.llm.components import connected
from catastra.llm.queries import ORACLE, QUERIES
from tests.llm.helpers import WORDS, components, edges, fingerprint, prose
from tests.test_oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    compare(QUERIES[name](spark, SF), ORACLE[name])


# ---- mixing ----------------------------------------------------------------------------------------------------------


def test_mixture_meets_its_weights(spark):
    rows = [(i, "x" * 99, "en", "big" if i % 10 else "small", 99) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix_sources(docs, weights={"big": 0.25, "small": 0.75}, shuffle=False).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in out}
    assert abs(n["big"] - 5_000) < 5 * math.sqrt(5_000) and abs(n["small"] - 15_000) < 5 * math.sqrt(15_000)


def test_large_means_and_broadcast_or_salted_join_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "t", "en", "rare" if i < 5 else "often", 1) for i in range(3_000)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = lambda: sorted((r.doc_id, r.copy) for r in mixing.mix_sources(docs, power=0.0).collect())
    a = rows()
    assert Counter(d < 5 for d, _ in a)[True] == pytest.approx(1_500, abs=200)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert rows() == a


def test_global_shuffle(spark):
    docs = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(2_000)], "doc_id long, text string, lang string, source string, n_chars long")
    keys = [r.shuffle_key for r in mixing.mix_sources(docs, epochs=2.0).collect()]
    assert keys == sorted(keys) and len(keys) == pytest.approx(4_000, abs=400)


# ---- language model --------------------------------------------------------------------------------------------------


def plain_backoff(texts, order, alpha, least):
    words = [WORDS.findall(t or "") for t in texts]
    c = Counter(tuple(w[i - n : i]) for w in words for n in range(1, order + 1) for i in range(n, len(w) + 1))
    total, out = sum(map(len, words)), []
    for w in words:
        s = 0.0
        for i in range(1, len(w) + 1):
            n = min(order, i)
            while n > 1 and c[tuple(w[i - n : i])] < least:
                s += math.log(alpha)
                n -= 1
            s += math.log(c[tuple(w[i - n : i])] / (c[tuple(w[i - n : i - 1])] if n > 1 else total))
        out.append((len(w), s))
    return out


@pytest.mark.parametrize(("order", "least"), [(1, 1), (2, 1), (3, 2), (4, 2)])
def test_scores_against_a_plain_model(spark, monkeypatch, order, least):
    monkeypatch.setattr(lm, "CHUNK_WORDS", 400)
    r = random.Random(order)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(0, 60))) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_words, x.log_score or 0.0) for x in lm.backoff_scores(docs, order, 0.4, least).collect()}
    for i, (n, s) in enumerate(plain_backoff(texts, order, 0.4, least)):
        assert got[i][0] == n and got[i][1] == pytest.approx(s, abs=1e-6)


# ---- SimHash ---------------------------------------------------------------------------------------------------------


def test_simhash_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fp = {d: fingerprint(t) for d, t in texts.items()}
    ids = sorted(fp)
    want = components([(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 3], ids)
    got = QUERIES["op5_simhash"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fp[d]:016x}", want[d]) for d in ids}


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_all_links_are_found(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "LARGE_BUCKET", 3)
    r = np.random.default_rng(radius)
    centres = r.integers(0, 2**63, 20, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 8), replace=False)) for c in centres for _ in range(12)} | {0, 1, 2**64 - 1}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "id long, fp long").repartition(3)
    want = components([(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps) if i < j and ((a ^ b) & (2**64 - 1)).bit_count() <= radius], range(len(fps)))
    got = {x.fp: x.component_id for x in simhash.classes(df, radius)[0].collect()}
    assert {i: got[f] for i, f in enumerate(fps)} == want


@pytest.mark.parametrize(("radius", "large"), [(0, 5), (3, 5), (3, 60), (7, 60), (7, 400)])
def test_split_buckets_lose_no_pair(radius, large):
    r = np.random.default_rng(radius + large)
    centres = r.integers(0, 2**63, 12, dtype=np.uint64)
    fp = np.array([int(c) ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 6), replace=False)) for c in centres for _ in range(40)], np.uint64)
    r.shuffle(fp)
    group = np.sort(r.integers(0, 3, len(fp)))
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if group[i] == group[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= radius}
    assert {(min(i, j), max(i, j)) for x, y in simhash.near_pairs(fp, group, radius, large) for i, j in zip(x.tolist(), y.tolist(), strict=True)} == want
    a, b = simhash.links_of(fp, group, radius, large=large)
    whole = components([(int(fp[i]), int(fp[j])) for i, j in want], {int(x) for x in fp})
    assert components(list(zip(map(int, fp[a]), map(int, fp[b]), strict=True)), whole) == whole


def test_plan_is_a_pigeonhole():
    r = np.random.default_rng(0)
    x = r.random((500, 64)) < np.linspace(0.1, 0.9, 64)
    x[:, 10] = x[:, 50]
    both = (x.astype(float).T @ x).astype(float)
    for n in (500, 10**6, 10**10):
        chosen = simhash.plan(n, both, 3)
        bits = [b for part, _ in chosen for b in part]
        assert len(bits) == len(set(bits))
        assert sum(t + 1 for _, t in chosen) == 4  # over all groups, t adds up to radius - groups + 1
    assert any({10, 50} <= set(part) for part, _ in simhash.plan(500, both, 3))


def test_components_of_long_chains(spark):
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 2000), (2000, 3000), (5, 5)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == components(pairs, {x for p in pairs for x in p}) | {}


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    pairs = [(0, i) for i in range(1, 30)] + [(100, i) for i in range(20, 60)] + [(200, 201), (300, 301), (301, 302)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == components(pairs, {x for p in pairs for x in p})


# ---- shards ----------------------------------------------------------------------------------------------------------


def test_shards_are_contiguous_and_even(spark):
    docs = spark.createDataFrame([(i, "x" * (i * 7919 % 997)) for i in range(3_000)], "doc_id long, text string").repartition(5)
    rows = sorted(sharding.shard_by_bytes(docs, 8).collect(), key=lambda r: r.doc_id)
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    share = sum(r["size"] for r in rows) / 8
    assert all([r.slot for r in g] == list(range(len(g))) for g in by.values())
    assert all(abs(sum(r["size"] for r in g) - share) < 998 for g in by.values())


def test_running_totals_over_many_partitions(spark):
    df = spark.createDataFrame([(i % 50, i % 7) for i in range(1_000)], "k long, v long").repartition(7)
    out, total, count = common.running_totals(df, ["k"], "v")
    at = 0
    for r in sorted(out.collect(), key=lambda r: r._rank):
        assert r._before == at
        at += r.v
    assert (at, count) == (total, 1_000)


# ---- personal data ---------------------------------------------------------------------------------------------------


def plain_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


TRICKY = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1112 79927398713", "+1 (415) 555-0100. +12 +1234567890123456", "ü😎 me@ex.org\n+49 30 1234567", "9" * 30_000, "1.1." * 5_000, "a." * 20_000 + "@", "", "@@..@a.b", "4111111111111111 " * 300]


def test_base_spans_against_plain_patterns(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.pii if s.kind in pii.KINDS] for r in pii.sanitise(docs, min_support=10**6).collect()}
    assert got == {i: plain_pii(t) for i, t in enumerate(TRICKY)}


def test_pii_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op9_pii"](spark, SF).collect():
        spans = plain_pii(texts[r.doc_id])
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in spans) for i in range(4))


def plain_terms(texts, radius, support, low, high):
    """Spans of the terms that disclose, counted in plain loops."""
    term = re.compile(r"[^\W_]{3,}")
    corpus = Counter(m[0].lower() for t in texts for m in term.finditer(t))
    total, windows = sum(corpus.values()), []
    for i, t in enumerate(texts):
        for a, k, b in plain_pii(t):
            v = re.sub("[^0-9]", "", t[a:b]) if k in (2, 3) else t[a:b].lower()
            lo, hi = a, b  # as far as the radius, the line and the text go
            while lo > max(0, a - radius) and t[lo - 1] != "\n":
                lo -= 1
            while hi < min(len(t), b + radius) and t[hi] != "\n":
                hi += 1
            inside = lambda m, p, q: p <= m.start() and m.end() <= q  # noqa: E731  a term that the edge cuts does not count
            windows.append((i, f"{k}:{v}", {m[0].lower() for m in term.finditer(t) if inside(m, lo, a) or inside(m, b, hi)}))
    n_e = Counter(e for _, e, _ in windows)
    n_te = Counter((e, w) for _, e, f in windows for w in f)
    telling = defaultdict(dict)
    for (e, w), n in n_te.items():
        p = n_e[e] / max(total, n_e[e] + 1)
        ratio = 1 + math.log(min(1.0, n / corpus[w])) / -math.log(p)
        if n >= support and ratio >= low:
            telling[e][w] = "removed" if ratio >= high else "generalised"
    out = defaultdict(dict)
    for i, e, _ in windows:
        for m in term.finditer(texts[i]):
            if (k := telling[e].get(m[0].lower())) and not any(a < m.end() and m.start() < b for a, _, b in plain_pii(texts[i])):
                out[i][m.start(), m.end()] = max(out[i].get((m.start(), m.end()), ""), k)
    return out


def plain_sanitised(text, found):
    """The text with each span replaced, from the last to the first."""
    spans = [(a, b, f"[{pii.KINDS[k].upper()}]") for a, k, b in plain_pii(text)]
    spans += [(a, b, "" if k == "removed" else "[NUMBER]" if text[a].isdigit() else "[WORD]") for (a, b), k in found.items()]
    for a, b, label in sorted(spans, reverse=True):
        text = text[:a] + label + text[b:]
    return text


def test_disclosing_terms(spark):
    r = random.Random(3)
    texts = []
    for i in range(120):
        line = [prose(r.randrange(30), 1) for _ in range(14)]
        if i % 4 == 0:
            line[4:4] = ["Zurbaran", "ann@acme.org", "office77"]
        if i % 8 == 0:
            line += ["filler"] * 12 + ["Zurbaran"]  # far from the entity
        if i % 6 == 0:
            line.append("Zurbaran" if i % 12 else "+51 987 654 321")
        texts.append(" ".join(line) + ("\nother line" if i % 5 == 0 else ""))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = plain_terms(texts, 60, 3, 0.8, 0.95)
    assert want
    for row in pii.sanitise(docs).collect():
        got = {(s.start, s.end, s.kind) for s in row.pii if s.kind in ("generalised", "removed")}
        assert got == {(a, b, k) for (a, b), k in want[row.doc_id].items()}
        assert row.sanitised == plain_sanitised(texts[row.doc_id], want[row.doc_id])


def test_sanitised_texts_of_the_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    want = plain_terms([docs[d] for d in ids], 60, 3, 0.8, 0.95)
    overlap = lambda t: any(x[2] > y[0] for x, y in zip(plain_pii(t), plain_pii(t)[1:], strict=False))  # noqa: E731  (nested base spans: another rule)
    got = {r.doc_id: r for r in QUERIES["op9_pii"](spark, SF).collect()}
    for i, d in enumerate(ids):
        if not overlap(docs[d]):
            assert got[d].sanitised_sha256 == hashlib.sha256(plain_sanitised(docs[d], want[i]).encode()).hexdigest()


# ---- quotations ------------------------------------------------------------------------------------------------------

MAIL = [
    (1, 0, "a", "Shall we meet on Monday in the usual place?\nBring the plans."),
    (1, 1, "b", "On Friday A wrote:\n> Shall we meet on   Monday in the usual place?\n\nYes, at ten."),
    (1, 2, "c", "No plans here."),
    (1, 3, "a", "> Yes, at ten.\n>> Shall we meet on Monday in the usual place?\nFine."),
    (2, 0, "d", "> shall we meet on monday in the usual place?\nI can not come, sorry."),
    (2, 1, "e", "> I can not come, sorry.\nPity."),
    (3, 0, "f", "> nobody ever said this\nhello"),
    (3, 1, "f", "hello"),
    (3, 2, "g", "> hello\nagain"),
]


def test_quotations(spark):
    df = spark.createDataFrame(MAIL, "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.turn): r for r in quotes.link_quotations(df).collect()}
    answers = {k: (r.reply_conversation, r.reply_turn) for k, r in out.items() if r.reply_turn is not None}
    assert answers == {(1, 1): (1, 0), (1, 3): (1, 1), (2, 0): (1, 0), (2, 1): (2, 0), (3, 2): (3, 0)}
    assert out[1, 1].content == "\nYes, at ten.".strip("\n") and out[1, 3].content == "Fine."
    assert {k: r.depth for k, r in out.items() if r.depth} == {(1, 1): 1, (1, 3): 2, (2, 0): 1, (2, 1): 2, (3, 2): 1}
    assert [out[k].position for k in sorted(k for k, r in out.items() if r.thread == 1)] == list(range(6))
    assert all(out[k].position > out[v].position for k, v in answers.items())


def test_long_chains_of_answers(spark):
    rows = [(1, 0, "a", "message number 0")] + [(1, i, "a", f"> message number {i - 1}\nmessage number {i}") for i in range(1, 40)]
    out = quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.turn, r.depth, r.position) for r in out) == [(i, i, i) for i in range(40)]


def plain_answers(rows, far_words=8):
    """Which message each one answers, by loops over all messages and passages."""
    norm = lambda x: " ".join(x.lower().split())
    level = lambda x: len(re.sub(r"[ \t]", "", re.match(r"[ \t]*((?:>[ \t]?)*)", x)[1]))
    own, quotes_ = {}, {}
    for c, t, _, text in rows:
        lines = text.split("\n")
        own[c, t] = [x for x in lines if not level(x)]
        blocks, last = [], None
        for x in lines:
            n = level(x)
            if n:
                body = re.sub(r"^[ \t]*(?:>[ \t]?)+", "", x)
                if last == n:
                    blocks[-1][1].append(body)
                else:
                    blocks.append((n, [body]))
                last = n
            elif x.strip():
                last = None
        quotes_[c, t] = blocks
    parts = lambda lines: ({norm(" ".join(lines))} | {norm(x) for x in lines} | {norm(p.replace("\n", " ")) for p in re.split(r"\n[ \t]*\n", "\n".join(lines))}) - {""}
    offers = defaultdict(list)
    for k in sorted(own):
        for u in parts(own[k]):
            offers[u].append(k)
    out = {}
    for k, blocks in quotes_.items():
        units = {}
        for n, lines in blocks:
            for u in parts(lines):
                units[u] = min(n, units.get(u, 99))
        votes = defaultdict(lambda: [99, 0])
        for u, n in units.items():
            near = [o for o in offers[u] if o[0] == k[0] and o[1] < k[1]]
            far = [o for o in offers[u] if o < k] if len(u.split()) >= far_words else []
            first = near[0] if near else far[0] if far and offers[u][0] == far[0] else None
            if first:
                votes[first][0] = min(votes[first][0], n)
                votes[first][1] += len(u.split())
        if votes:
            out[k] = max(votes, key=lambda o: (-votes[o][0], votes[o][1], o))
    return out


def test_quotations_against_loops(spark):
    r, rows = random.Random(11), []
    pool = [prose(500 + i, r.randint(1, 14)) for i in range(40)]
    for c in range(8):
        for t in range(10):
            lines = []
            for _ in range(r.randint(0, 3)):
                n = r.randint(1, 3)
                lines += ["> " * n + r.choice(pool) for _ in range(r.randint(1, 2))] + [""] * r.randint(0, 1)
                lines += [r.choice(pool)] * r.randint(0, 1)
            rows.append((c, t, "u", "\n".join([*lines, r.choice(pool)])))
    want = plain_answers(rows)
    out = {(x.conv_id, x.turn): x for x in quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    assert len(want) > 20 and {k: (x.reply_conversation, x.reply_turn) for k, x in out.items() if x.reply_turn is not None} == want

    def chain(k):
        return (k, 0) if k not in want else (lambda top: (top[0], top[1] + 1))(chain(want[k]))

    threads = defaultdict(list)
    for k, x in out.items():
        assert (x.thread, x.depth) == (chain(k)[0][0], chain(k)[1])
        threads[x.thread].append(k)
    assert all([out[k].position for k in sorted(ks)] == list(range(len(ks))) for ks in threads.values())


def test_quotations_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain_answers([(c, t, x, y or "") for c, t, x, y in rows])
    got = QUERIES["op10_quotations"](spark, SF).collect()
    assert len(got) == len(rows) and {(r.conv_id, r.turn): (r.reply_conversation, r.reply_turn) for r in got if r.reply_turn is not None} == want
    assert all(r.content == (dict(((c, t), y) for c, t, _, y in rows)[r.conv_id, r.turn] or "") for r in got if (r.conv_id, r.turn) not in want)


def test_deep_and_long_messages(spark):
    deep = "\n".join(">" * n + " line" for n in range(1, 2_000))
    rows = [(1, 0, "a", "line"), (1, 1, "a", deep), (1, 2, "a", "> line\n" * 5_000 + "x" * 100_000)]
    out = {r.turn: r for r in quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (out[1].reply_turn, out[2].reply_turn, out[1].content, out[2].content) == (0, 0, "", "x" * 100_000)


def test_edges_keep_their_columns(spark):
    df = edges(spark)
    assert [c.lower() for c in sharding.shard_by_bytes(df).columns if c.lower() in ("size", "shard", "slot")] == ["size", "shard", "slot"]
    assert simhash.keep_one_of_each(df.drop("_fp")).columns == df.drop("_fp").columns


def test_near_copies_go_and_others_stay(spark):
    texts = [prose(i, 200) for i in range(30)]
    r, rows = random.Random(5), list(enumerate(texts))
    for i, t in enumerate(texts[:20]):
        w = t.split()
        for k in r.sample(range(200), 3):
            w[k] = "changed" + str(k)
        rows.append((100 + i, " ".join(w)))  # five-word similarity of about 0.86
    left = {x.doc_id for x in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(30)) <= left and len(left & set(range(100, 120))) <= 1
