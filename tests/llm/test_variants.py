"""Spelling variants against comparisons of every two words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catastra.llm import variants
from tests.llm.helpers import edges, empty


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    best = {w: min(xs, key=lambda x: (-words[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in best.items() if words[x] >= 2 * words[w]}
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None)
    return out


def got(df):
    rows = df.collect()
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def vocabulary(seed):
    r = random.Random(seed)
    if seed == 0:  # runs of one letter: the same word comes out wherever a letter is skipped
        words = {"".join(r.choice("aab") for _ in range(r.randint(0, 6))) for _ in range(150)}
    else:
        letters = "abcdé日" if seed == 1 else "xyz"
        words = {"".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(250)}
        words |= {w[:i] + c + w[i + 1 :] for w in r.sample(sorted(words), 40) for i in range(len(w)) for c in r.sample(letters, 2)} | {"", "q" * 3_000, "q" * 2_999, "q" * 1_500 + "r" + "q" * 1_499}
    return {w: int(r.paretovariate(0.4)) + 1 for w in words}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_every_two_words(spark, monkeypatch, seed):
    monkeypatch.setattr(variants, "GROUP_CHARS", 300)
    words = vocabulary(seed)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert got(variants.spelling_variants(df)) == plain(words)


def test_any_heavy_letter_will_do(spark, monkeypatch):
    """Prefixes that share a hash share the letter: nothing is lost."""
    edges_of = variants.trie_edges
    monkeypatch.setattr(variants, "trie_edges", lambda w: edges_of(w).withColumn("prefix", F.pmod("prefix", F.lit(5))))
    words = vocabulary(1)
    assert got(variants.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == plain(words)


def test_light_edges_are_few(spark):
    r = random.Random(4)
    words = sorted({"".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9))) for _ in range(3_000)})
    df = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    per_word = Counter(x.id for x in variants.light_edges(df).select("id", "letter").filter("letter != ''").collect())
    assert max(per_word.values()) <= len(words).bit_length()


def slips(docs):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def test_words_of_texts(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD_WORDS", 50)
    monkeypatch.setattr(variants, "SLICE", 64)
    r = random.Random(5)
    docs = [(i, "".join(r.choice(["Straße", "ÉTÉ", "été", "naïve÷x", "word", "Wording", "wordings", "日本語", "ÿÀ×plain", "_", " ", "\n", "3"]) for _ in range(r.randint(0, 400)))) for i in range(80)] + [(None, "Wording wording"), (90, None), (91, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {x.word: x.n for x in variants.noisy_words(df).collect()} == slips(docs)


def test_edges(spark):
    df = edges(spark).filter("doc_id is null or doc_id not in (5, 6)")  # 20,000 words are too many for the loops below
    assert got(variants.spelling_variants(variants.noisy_words(df, least_count=1))) == plain({w: n for w, n in _all(df).items()})
    assert variants.spelling_variants(variants.noisy_words(empty(spark))).collect() == []
    odd = spark.createDataFrame([(None, 3), ("alpha", None), ("alpha", 5), ("alphas", 2)], "word string, n long")
    assert got(variants.spelling_variants(odd)) == {"alpha": (None, "alpha", 5, 1, None), "alphas": ("alpha", "alpha", 2, 1, 5)}


def _all(df):
    n = Counter()
    for r in df.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.lower() if run.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= 5}
