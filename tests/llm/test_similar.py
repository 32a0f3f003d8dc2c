"""Near-duplicates of the pipeline against brute-force Jaccard similarity."""

import random

import pytest

from catastra.llm import similar, simhash
from tests.llm.helpers import WORDS, components, prose


def plain_set(text, n=5):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)} - {()}


def plain_kept(texts):
    sets = {d: plain_set(t) for d, t in texts.items()}
    ids = sorted(sets)
    like = lambda x, y: x == y or 5 * len(x & y) >= 4 * len(x | y)
    up = components([(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if like(sets[a], sets[b])], ids)
    return {d for d in ids if up[d] == d}


@pytest.mark.parametrize(("small", "block", "radius", "large"), [(4, 20, 0, 50_000), (64, 8_192, 7, 50_000), (4, 7, 0, 30)])  # 20: buckets are cut, and SimHash proposes next to nothing; 30: so are keys, before they go to tasks
def test_pairs_around_the_threshold(spark, monkeypatch, small, block, radius, large):
    monkeypatch.setattr(similar, "LARGE_KEY", large)
    monkeypatch.setattr(similar, "LOOKED_AT", 1)
    monkeypatch.setattr(similar, "SMALL_BUCKET", small)
    monkeypatch.setattr(similar, "BLOCK_ROWS", block)
    r, texts = random.Random(1), {}
    for i in range(60):
        w = prose(i, r.randint(20, 400)).split()
        texts[2 * i] = " ".join(w)
        for k in r.sample(range(len(w)), max(1, int(len(w) * r.uniform(0.01, 0.05)))):
            w[k] = "changed"
        texts[2 * i + 1] = " ".join(w)
    common = prose(99, 30)
    texts |= {200 + i: f"{common} {prose(300 + i, r.randint(3, 12))}" for i in range(90)}  # one large group, some of them too far apart
    texts |= {400: "", 401: None, 402: "One two", 403: "one  TWO", 404: "two one"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {x.doc_id for x in simhash.keep_one_of_each(docs, radius=radius).collect()} == plain_kept(texts)


def test_exactly_at_the_threshold(spark):
    words = [f"w{i}" for i in range(200)]
    at = {1: words[:16] + words[50:50], 2: words[:19], 3: words[20:33], 4: words[20:36], 5: words[100:108], 6: words[100:109], 7: words[110:117], 8: words[110:118]}  # 12/15, 9/12, 4/5, 3/4
    texts = {d: " ".join(w) for d, w in at.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = {x.doc_id for x in simhash.keep_one_of_each(docs).collect()}
    assert left == plain_kept(texts) == {1, 3, 4, 5, 7, 8}


def test_rows_of_a_dense_bucket_meet_in_some_pair_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE_BUCKET", 10)
    rows = [(0, 5, fp, 1, 7) for fp in range(45)] + [(0, 6, fp, 1, 7) for fp in range(4)]
    df = spark.createDataFrame(rows, "part int, key long, fp long, sub int, subkey long")
    found = {}
    for r in simhash.paired(df, 3).collect():
        found.setdefault((r.part, r.key, r.sub, r.subkey), []).append(r.fp)
    assert found.pop((0, 6, 1, 7)) and (0, 5, 1, 7) not in found
    met = {(a, b) for fps in found.values() for a in fps for b in fps if a < b}
    assert len(found) == 15 and max(map(len, found.values())) < 45
    assert met == {(a, b) for a in range(45) for b in range(a + 1, 45)}


def test_rows_of_a_large_key_meet_in_some_cell(spark, monkeypatch):
    monkeypatch.setattr(similar, "LARGE_KEY", 40)
    monkeypatch.setattr(similar, "LOOKED_AT", 1)
    monkeypatch.setattr(similar, "BLOCK_ROWS", 6)
    rows = [(1, n, n % 50 + 1, 0, n % 3) for n in range(150)] + [(2, n, 9, 0, 1) for n in range(90)] + [(3, n, 5, 0, n) for n in range(4)]
    df = spark.createDataFrame(rows, "key long, node long, size int, at int, label long")
    rest, cells = similar.dealt(df, 150, 0.8)
    assert {r.key for r in rest.collect()} == {3}
    met, sizes, most = set(), dict((n, s) for k, n, s, _, _ in rows if k == 1), 0
    held = {}
    for r in cells.collect():
        assert r.key == 1  # all rows of 2 are of one label
        held.setdefault(r.cell, ([], []))[r.side].append(r.node)
    for a, b in held.values():
        most = max(most, len(a), len(b))
        met |= {(min(x, y), max(x, y)) for x in a for y in (b or a) if x != y}
    assert {(x, y) for x in range(150) for y in range(x + 1, 150) if min(sizes[x], sizes[y]) >= 0.8 * max(sizes[x], sizes[y])} <= met
    assert most < 30
