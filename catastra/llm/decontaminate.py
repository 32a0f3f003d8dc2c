"""Operator 7: benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hot_keys, plain_names, salted_join, staged, without, word_hashes, windows

#: A benchmark of up to so many bytes of text goes to each task; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20
PUNCTUATION = bytes(0x20 if (c < 0x30 or 0x3A <= c < 0x41 or 0x5B <= c < 0x61 or 0x7B <= c < 0x80) else c for c in range(256))


@dataclass(frozen=True)
class TilingRules:
    min_match: int = 5
    coverage: float = 0.6


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words in lower case, ASCII punctuation counting as blanks."""
    return word_hashes((text or "").lower().encode("utf-8", "replace").translate(PUNCTUATION))


def maximal(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Matches (start in text, start in item, length) from the places where n-word windows agree."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(i - j) != 0) | (np.diff(i) != 1))))
    runs = np.diff(np.append(new, len(i)))
    return [(int(i[a]), int(j[a]), int(r) + n - 1) for a, r in zip(new, runs, strict=True)]


def tile(matches: list[tuple[int, int, int]], text_words: int, item_words: int, n: int) -> np.ndarray:
    """Which words of the item are tiled: longest match first, each word of either side used once, tiles of n words or more.

    A match that meets marked words is cut to the stretches still free, which wait for their own turn.
    """
    used_text, used_item = np.zeros(text_words, bool), np.zeros(item_words, bool)
    heap = [(-k, a, b) for a, b, k in matches]
    heapq.heapify(heap)
    while heap:
        k, a, b = heapq.heappop(heap)
        k = -k
        taken = used_text[a : a + k] | used_item[b : b + k]
        if not taken.any():
            used_text[a : a + k] = used_item[b : b + k] = True
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([1], taken.view(np.int8), [1]))))
        for lo, hi in zip(edge[::2], edge[1::2], strict=True):
            if hi - lo >= n:
                heapq.heappush(heap, (-int(hi - lo), a + int(lo), b + int(lo)))
    return used_item


def rolling(h: np.ndarray):
    """A function of the length that gives the Karp-Rabin hashes of all windows, from prefix sums."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), odd)]))
    down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), back)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down[:-1])])
    return lambda length: (total[length:] - total[: len(total) - length]) * up[length - 1 : len(h)]


def tile_running(text: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """As tile(), from the words' hashes alone: the longest length with a free match is searched by window hashes, each hit
    is confirmed on the words, and its matches are marked in order. Memory grows with the sum of both lengths only."""
    used_text, used_item = np.zeros(len(text), bool), np.zeros(len(item), bool)
    of_text, of_item = rolling(text), rolling(item)

    def free(used, length):
        c = np.concatenate(([0], np.cumsum(used)))
        return np.flatnonzero(c[length:] == c[: len(c) - length])

    def hits(length):
        a, b = free(used_text, length), free(used_item, length)
        x, y = of_text(length)[a], of_item(length)[b]
        return a[np.isin(x, y)], b[np.isin(y, x)]

    longest = min(len(text), len(item))
    while True:
        lo, hi = n - 1, longest
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if len(hits(mid)[0]) else (lo, mid - 1)
        if lo < n:
            return used_item
        longest = lo
        a, b = hits(lo)
        key = of_item(lo)
        places: dict[int, list[int]] = {}
        for j in b[::-1].tolist():
            places.setdefault(int(key[j]), []).append(j)
        key, done, marked = of_text(lo), -1, False
        for i in a.tolist():
            if i < done:
                continue
            left = places[int(key[i])]
            while left and used_item[left[-1] : left[-1] + lo].any():
                left.pop()  # a marked word stays marked
            if left and np.array_equal(text[i : i + lo], item[left[-1] : left[-1] + lo]):
                j = left.pop()
                used_text[i : i + lo] = used_item[j : j + lo] = marked = True
                done = i + lo
        if not marked:  # equal hashes of unequal words
            longest = lo - 1


#: A text and an item with more pairs of equal seeds are tiled by tile_running.
PAIRS_AT_ONCE = 1_000_000


class Items:
    """The windows of all items, sorted, with the items and places that have them."""

    def __init__(self, keys: list, hashes: list[np.ndarray], n: int):
        self.keys, self.sizes, self.n, self.hashes = keys, [len(h) for h in hashes], n, hashes
        w = [windows(h, n) for h in hashes]
        seed = np.concatenate([np.empty(0, np.uint64), *w])
        item = np.repeat(np.arange(len(w)), [len(x) for x in w])
        place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(x)) for x in w]])
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place = seed[order], item[order], place[order]

    def tiled(self, h: np.ndarray, coverage: float = 0.0) -> list[tuple]:
        """(item's key, words tiled, words) for each item that shares seeds with the text, but for those whose shared seeds lie over fewer words than `coverage` of them."""
        if not len(self.seed) or len(h) < self.n:
            return []
        w = windows(h, self.n)
        lo = np.searchsorted(self.seed, w)
        at = np.flatnonzero(self.seed[np.minimum(lo, len(self.seed) - 1)] == w)
        if not len(at):
            return []
        # pairs of equal seeds by item, without making them: each seed of the text and each range of the items' seeds once
        seeds, times = np.unique(w[at], return_counts=True)
        start = np.searchsorted(self.seed, seeds)
        many = np.searchsorted(self.seed, seeds, "right") - start
        k = np.repeat(start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        by_item = np.lexsort((self.place[k], self.item[k]))
        item, place, weight = self.item[k][by_item], self.place[k][by_item], np.repeat(times, many)[by_item]
        first = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
        # words of an item that its shared seeds lie over: n for the last place, for others as far as the next
        over = np.minimum(np.diff(place, append=0), self.n)
        over[np.append(first[1:], len(item)) - 1] = self.n
        covered, pairs = np.add.reduceat(over, first), np.add.reduceat(weight, first)
        out = []
        for lo, hi, words, total in zip(first.tolist(), [*first[1:].tolist(), len(item)], covered.tolist(), pairs.tolist(), strict=True):
            x = int(item[lo])
            if words < coverage * self.sizes[x]:
                continue
            if total > PAIRS_AT_ONCE:
                used = tile_running(h, self.hashes[x], self.n)
            else:
                mine = np.sort(k[by_item[lo:hi]])  # in order of the seeds
                seed, places = self.seed[mine], self.place[mine]
                low, high = np.searchsorted(seed, w[at]), np.searchsorted(seed, w[at], "right")
                i = np.repeat(at, high - low)
                j = places[np.repeat(low, high - low) + np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)]
                same = h[i] == self.hashes[x][j]  # hits of the rolling hash are confirmed word by word, on the words' 64-bit hashes
                for step in range(1, self.n):
                    same &= h[i + step] == self.hashes[x][j + step]
                i, j = i[same], j[same]
                used = tile(maximal(i, j, self.n), len(h), self.sizes[x], self.n) if len(i) else np.zeros(1, bool)
            out.append((self.keys[x], int(used.sum()), self.sizes[x]))
        return out


LEAKS = "array<struct<item:string,words:int,of:int>>"


def leaks(docs: DataFrame, benchmark: DataFrame, rules: TilingRules = TilingRules(), text: str = "text", item: str = "item_id", item_text: str = "text", to: str = "leaks") -> DataFrame:
    """docs with `to`: the benchmark items whose words are tiled to rules.coverage or more, with the words tiled and all.

    Seeds are windows of min_match words that text and item share (lower case, punctuation aside). Rolling hashes find
    them; runs of seeds are maximal matches; tile() marks the longest free ones first, so a passage counts in whatever
    order its parts stand. Items of fewer than min_match words have no seeds and are never reported; null and empty
    texts have no leaks; equal items are reported each, repeated rows of docs are judged each. A column named like `to`
    is replaced.

    A benchmark of at most BROADCAST_BYTES goes to the tasks that read docs, with no shuffle. A larger one is joined:
    see leaks_by_join.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    if size > BROADCAST_BYTES:
        return leaks_by_join(docs, benchmark, rules, text, item, item_text, to)
    rows = sorted(benchmark.select(F.col(item).cast("string"), item_text).collect(), key=str)
    keys, hashes = [r[0] for r in rows], [tokens(r[1]) for r in rows]
    held = docs.sparkSession.sparkContext.broadcast(Items(keys, hashes, rules.min_match))

    @F.pandas_udf(LEAKS)
    def of(texts: pd.Series) -> pd.Series:
        index = held.value
        return pd.Series([[{"item": k, "words": w, "of": n} for k, w, n in index.tiled(tokens(t), rules.coverage) if w >= rules.coverage * n] for t in texts])

    return without(docs, [to]).withColumn(to, of(F.col(text).cast("string")))


def leaks_by_join(docs: DataFrame, benchmark: DataFrame, rules: TilingRules, text: str = "text", item: str = "item_id", item_text: str = "text", to: str = "leaks") -> DataFrame:
    """As leaks(), for a benchmark of any size: seeds of texts and items meet in a join, each pair found is tiled once.

    Tiles that cover a share of an item's words hold at least a min_match-th of those in seeds of their own, r say. So an
    item is known by its seeds but for the r - 1 that most texts have: a leak shares one of the others.
    """
    n = rules.min_match

    @F.pandas_udf("array<long>")
    def seeds(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(windows(tokens(t), n)).view(np.int64) for t in texts])

    @F.pandas_udf("struct<words:int,of:int>")
    def tiled(texts: pd.Series, items: pd.Series) -> pd.DataFrame:
        out = []
        for t, x in zip(texts, items, strict=True):
            found = Items([0], [tokens(x)], n).tiled(tokens(t))
            out.append((found[0][1], found[0][2]) if found else (0, 1))
        return pd.DataFrame(out, columns=["words", "of"])

    @F.pandas_udf("int")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([len(tokens(t)) for t in texts], dtype="int32")

    left, names, (text,) = plain_names(without(docs, [to] if to.lower() != text.lower() else []), text)
    key = F.xxhash64(F.lit(1), F.col(text)), F.xxhash64(F.lit(2), F.col(text))  # equal texts have equal leaks
    texts = left.select(key[0].alias("_a"), key[1].alias("_b"), F.col(text).cast("string").alias("_text")).dropDuplicates(["_a", "_b"])
    items = staged(benchmark.select(F.col(item).cast("string").alias("_item"), F.col(item_text).cast("string").alias("_item_text")).withColumn("_row", F.monotonically_increasing_id()))
    doc_seeds = staged(texts.select("_a", "_b", F.explode(seeds("_text")).alias("_seed")))
    counts = doc_seeds.groupBy("_seed").agg(F.count(F.lit(1)).alias("count"))
    item_seeds = items.select("_row", words("_item_text").alias("_words"), F.explode(seeds("_item_text")).alias("_seed"))
    counts = staged(counts.join(item_seeds.select("_seed").distinct(), "_seed", "left_semi"))
    spare = F.ceil(F.col("_words") * rules.coverage / n) - 1
    often = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("count"), "_seed"))
    item_seeds = staged(item_seeds.join(counts, "_seed").withColumn("_often", often).filter(F.col("_often") > spare).select("_seed", "_row"))
    hot = hot_keys(counts.join(item_seeds.select("_seed").distinct(), "_seed", "left_semi"))
    pairs = salted_join(doc_seeds, item_seeds, "_seed", "_a", hot=hot).select("_a", "_b", "_row").distinct()
    found = pairs.join(texts, ["_a", "_b"]).join(items, "_row").withColumn("_t", tiled("_text", "_item_text")).filter(F.col("_t.words") >= rules.coverage * F.col("_t.of"))
    per = found.groupBy("_a", "_b").agg(F.array_sort(F.collect_list(F.struct(F.col("_item").alias("item"), F.col("_t.words").alias("words"), F.col("_t.of").alias("of")))).alias("_leaks"))
    out = left.withColumn("_a", key[0]).withColumn("_b", key[1]).join(per, ["_a", "_b"], "left")
    return out.select(*left.columns, F.coalesce("_leaks", F.array().cast(LEAKS)).alias("_leaks")).toDF(*names, to)


def decontaminated(docs: DataFrame, benchmark: DataFrame, rules: TilingRules = TilingRules()) -> DataFrame:
    """The rows of docs without leaks, with the columns of docs, whatever their names. Null and empty texts and repeated rows stay."""
    plain, names, (text,) = plain_names(docs, "text")
    return leaks(plain, benchmark, rules, text=text, to="_leaks").filter(F.size("_leaks") == 0).drop("_leaks").toDF(*names)
