"""Rows and plain reference versions for the tests of this folder."""

import re

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["n_words", "kept", "secrets", "copy", "shuffle_key", "_fp", "fp", "id", "pii", "sanitised", "leaks", "size", "shard", "slot", "_pid", "_row", "_text", "chunk", "component_id", "Kept", "least", "_source"]


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghijklmnop"), r.integers(2, 8))) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Null, empty and blank texts, ties, repeated rows, null ids and sources, one very long text."""
    long = prose(1, 20_000)
    return [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n", None, None, 3), (4, "one", "en", "b", 3), (5, long, "en", "b", len(long)), (6, long, "en", "b", len(long)), (7, prose(2, 60), "en", "a", 1), (7, prose(2, 60), "en", "a", 1), (8, "x y ünï 😎", "fr", "a", 5), (None, prose(3, 40), None, "a", None), (None, None, None, None, None), (9, "a" * 50_000, "en", "a", 50_000)]


def edges(spark, clashing: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), COLUMNS)
    seen = {c.lower() for c in df.columns}
    for c in CLASHING if clashing else []:
        if c.lower() not in seen:
            seen.add(c.lower())
            df = df.withColumn(c, F.lit("mine"))
    return df


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def fingerprint(text, n: int = 3, once: bool = False) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in (set(shingles) if once else shingles)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs, nodes) -> dict:
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
