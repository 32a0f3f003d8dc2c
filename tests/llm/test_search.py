"""Ranked search against scores of every document for every query."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from catastra.llm import search
from tests.llm.helpers import edges, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, queries, k):
    """{item: [(id, score)]}, by the contract's words."""
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in queries:
        asked.setdefault(item, Counter()).update(terms(text))
    out = {}
    for item, q in asked.items():
        rows = []
        for d, c, n in held:
            s = sum(many * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * (100 - 75 + 75 * n * n_docs // n_terms))) for t, many in q.items() if c[t])
            if s > 0:
                rows.append((-s, d is not None, d, s))
        if rows:
            out[item] = [(d, s) for _, _, d, s in sorted(rows)[:k]]
    return out


def ranked(df, k):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id]) <= k
    return out


def corpus(seed, n):
    """Words of a steep distribution, copies, lengths from nothing to hundreds, ids in no order."""
    r = random.Random(seed)
    words = ["w%d" % i for i in range(300)] + ["ÑÀ", "Été", "x1", "日本"]
    text = lambda m: r.choice([" ", "-", "\n", "_"]).join(words[min(int(r.paretovariate(0.5)), len(words)) - 1].upper() if r.random() < 0.2 else words[min(int(r.paretovariate(0.5)), len(words)) - 1] for _ in range(m))
    docs = [(i, text(r.choice([0, 3, 9, 40, 300]))) for i in r.sample(range(10 * n), n)] + [(10 * n, None)]
    docs += [(10 * n + 1 + i, docs[r.randrange(n // 3)][1]) for i in range(n // 3)]
    return docs, [(i, text(r.choice([0, 1, 2, 8, 30]))) for i in range(25)] + [(99, None), (3, "w1 w2 nowhere"), (98, "nowhere")]


@pytest.mark.parametrize(("seed", "shard_terms", "stretch", "block"), [(1, 1 << 21, 2048, 1 << 16), (2, 3_000, 16, 40), (3, 500, 7, 1 << 16)])
def test_every_score(spark, monkeypatch, seed, shard_terms, stretch, block):
    for name, value in (("SHARD_TERMS", shard_terms), ("STRETCH", stretch), ("BLOCK_ROWS", block), ("SLICE", 50)):
        monkeypatch.setattr(search, name, value)
    docs, queries = corpus(seed, 400)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = search.build_index(table)
    assert index.filter("term is null").agg({"documents": "sum"}).first()[0] == sum(bool(terms(t)) for _, t in docs)
    for k in (1, 10):
        assert ranked(search.search(index, spark.createDataFrame(queries, "item_id long, text string"), k), k) == plain(docs, queries, k)


def test_lists_that_are_not_essential_are_left_out():
    """A rare term's first documents set a threshold that the common term cannot reach, so its list is only probed."""
    n = 40
    common, rare = np.arange(n), np.array([0, 1, 30])
    rows = [{"term": t, "places": at.astype("<u2").tobytes(), "tfs": np.ones(len(at), "u1").tobytes(), "best_tf": np.array([1], "<u4").tobytes(), "best_n": np.array([5], "<u4").tobytes()} for t, at in (("common", common), ("rare", rare))]
    lists = search.Lists(np.full(n, 5), rows, {"common": 5, "rare": 4_000}, n, 5 * n)
    asked = []
    of = lists.of
    lists.of = lambda t: asked.append(t) or of(t)
    search_stretch, search.STRETCH = search.STRETCH, 4
    try:
        top, _ = search.max_score(lists, [("common", 1), ("rare", 1)], 2, np.arange(n))
    finally:
        search.STRETCH = search_stretch
    assert top.tolist() == [0, 1] and asked.count("common") == 2 and asked.count("rare") == 10


def test_skyline_holds_the_largest_gain():
    r = np.random.default_rng(1)
    term, tf, n = np.sort(r.integers(0, 30, 500)), r.integers(1, 9, 500), r.integers(1, 60, 500)
    term = np.unique(term, return_inverse=True)[1]
    best = search.skyline(term, tf, n)
    for scale in (1, 7, 500):
        m = 25 + 75 * n * scale // 10
        every = [search.gains(tf[term == t], m[term == t]).max() for t in range(term.max() + 1)]
        assert every == [search.gains(tf[best][term[best] == t], m[best][term[best] == t]).max() for t in range(term.max() + 1)]
    assert len(best) < 200


def test_long_sums_stay_whole():
    n = np.array([3, 5_000_000])
    assert search.Lists.lengthened(n, 10**12, 10**13).tolist() == [25 + 75 * 3 // 10, 25 + 75 * 5_000_000 // 10]


def test_edges(spark):
    docs = edges(spark)
    queries = spark.createDataFrame([(1, "one"), (None, "x y"), (2, None), (3, ""), (None, "ünï")], "item_id long, text string")
    got = ranked(search.search(search.build_index(docs), queries), 10)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in queries.collect()], 10)
    assert set(got) == {1, None}
    assert search.search(search.build_index(empty(spark)), queries).collect() == []
    assert search.search(search.build_index(docs), queries.filter("false")).collect() == []
    texts = spark.createDataFrame([("b", "same"), (None, "same"), ("a", "same"), ("a", "same")], "doc_id string, text string")
    named = spark.createDataFrame([("q", "same")], "item_id string, text string")
    assert [d for d, _ in ranked(search.search(search.build_index(texts), named), 10).get("q", [])] == [None, "a", "a", "b"]
