"""Operator 5: SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from itertools import combinations
from math import comb, exp, lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, hot_keys, partitions, plain_names, salted_join, staged, without
from .components import connected

BITS = 64
#: A probe row (6 microseconds to make, deal, sort and read) costs about as much as so many comparisons (5.5 nanoseconds each).
PROBE_COST = 1_000
#: A task splits a bucket with more rows by blocks of bits before it compares.
SPLIT_BUCKET = 2_000
#: Buckets with more rows are split by the rest of their bits before they go to tasks.
LARGE_BUCKET = 50_000


def majority(h: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have; 0 without hashes."""
    total = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), 65536):
        total += np.unpackbits(h[lo : lo + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def fingerprint(text: str | None, n: int = 3) -> int:
    """Bits that over half of the XXH64 values (seed 42) of the n-word shingles have; 0 for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only the six blanks part
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= n:
        shingles = [flat]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = [flat[a:b] for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles)))


def with_fingerprint(docs: DataFrame, text: str, to: str, shingle: int) -> DataFrame:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(to, of(F.col(text).cast("string")))


def bit_counts(uniq: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints have both of each two bits set; on the diagonal, each one. Over all fingerprints."""

    def count(frames):
        m, n = np.zeros((BITS, BITS)), 0
        for pdf in frames:
            bits = np.unpackbits(pdf.fp.to_numpy(np.int64).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            m, n = m + bits.T @ bits, n + len(bits)
        i, j = np.triu_indices(BITS)
        yield pd.DataFrame({"i": [*i, -1], "j": [*j, -1], "n": [*m[i, j].astype(np.int64), n]})

    rows = uniq.select("fp").mapInPandas(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 2081 rows for any input
    m, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r.i < 0:
            n = r.n
        else:
            m[r.i, r.j] = m[r.j, r.i] = r.n
    return n, m


def plan(n: int, both: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """Groups of bits (numbered from the highest) with a threshold each; those with none (-1) are left out.

    For each number of groups, bits that correlate are put together. By the generalised pigeonhole principle, of two
    fingerprints within `radius` at least one group differs in no more bits than its threshold, if the thresholds add
    up to radius - groups + 1. They are allotted by dynamic programming over the estimated number of candidates,
    n * n / 2 * P(a group differs in at most t bits), and of probes.
    """
    n = max(n, 1)  # without rows, too, probes have a cost
    p = np.clip(np.diag(both) / n, 1e-9, 1 - 1e-9)
    joint = both / n
    cov = joint - np.outer(p, p)
    # of two fingerprints drawn at random: whether they differ in a bit, and whether in both of two bits
    differ = 2 * p * (1 - p)
    differ2 = 2 * (joint * (1 - p[:, None] - p[None, :] + joint) + (p[:, None] - joint) * (p[None, :] - joint))

    def within(part: list[int], t: int) -> float:
        """Chance that two fingerprints differ in at most t bits of a group: a beta-binomial law of the same mean and variance, since its bits go together."""
        k, mean = len(part), float(differ[part].sum())
        spread = float((differ2[np.ix_(part, part)] - np.outer(differ[part], differ[part])).sum())
        plain = mean * (1 - mean / k)
        rho = min(max((spread / plain - 1) / (k - 1), 1e-6), 0.99) if k > 1 and plain > 0 else 1e-6
        a, b = mean / k * (1 / rho - 1), (1 - mean / k) * (1 / rho - 1)
        log = lambda j: lgamma(k + 1) - lgamma(j + 1) - lgamma(k - j + 1) + lgamma(j + a) + lgamma(k - j + b) - lgamma(k + a + b) + lgamma(a + b) - lgamma(a) - lgamma(b)
        return min(1.0, sum(exp(log(j)) for j in range(min(t, k) + 1)))

    corr = np.abs(cov / np.sqrt(np.outer(p * (1 - p), p * (1 - p))))
    np.fill_diagonal(corr, -1)
    best = None
    for groups in range(min(2, radius + 1), radius + 2):
        left, parts = set(range(BITS)), []
        for g in range(groups):
            room = -(-len(left) // (groups - g))
            part = [max(left, key=lambda b: (max(corr[b][c] for c in left), -b))]
            left.discard(part[0])
            while len(part) < room:
                nxt = max(left, key=lambda b: (corr[b][part].mean(), -b))
                part.append(nxt)
                left.discard(nxt)
            parts.append(sorted(part))

        def cost(part: list[int], t: int) -> float:
            if t < 0:
                return 0.0
            balls = sum(comb(len(part), k) for k in range(t + 1))
            return n * n / 2 * within(part, t) + PROBE_COST * n * (balls + (t > 0))

        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            after: dict[int, tuple[float, list[int]]] = {}
            for total, (c, ts) in states.items():
                for t in range(-1, radius + 1):
                    new = (c + cost(part, t), [*ts, t])
                    if total + t not in after or new[0] < after[total + t][0]:
                        after[total + t] = new
            states = after
        c, ts = states[radius - groups + 1]
        if best is None or c < best[0]:
            best = (c, [(part, t) for part, t in zip(parts, ts, strict=True) if t >= 0])
    return best[1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask(bits) -> int:
    return sum(1 << (BITS - 1 - b) for b in bits)


def probes(uniq: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key) and the columns of uniq: each fingerprint under the bits of each group, and under all keys within the group's threshold."""
    keys = []
    for i, (bits, t) in enumerate(chosen):
        flips = [mask(c) for k in range(t + 1) for c in combinations(bits, k)]
        keys += [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(mask(bits)))).bitwiseXOR(F.lit(signed(f))).alias("key")) for f in flips]
    return uniq.select(*uniq.columns, F.explode(F.array(*keys)).alias("k")).select("k.part", "k.key", *uniq.columns)


def refined(rows: DataFrame, chosen: list[tuple[list[int], int]], radius: int) -> DataFrame:
    """rows with (sub, subkey); a large bucket is split by radius + 1 blocks of its other bits, of which one must agree; what stays large, by pairs of blocks of rows."""
    large = staged(rows.groupBy("part", "key").count().filter(F.col("count") > LARGE_BUCKET).select("part", "key"))
    n = large.count()
    plain = rows.withColumn("sub", F.lit(-1)).withColumn("subkey", F.lit(0).cast("long"))
    if not n:
        return plain
    large = F.broadcast(large) if n <= BROADCAST_ROWS else large
    subs = []
    for i, (bits, _) in enumerate(chosen):
        rest = [b for b in range(BITS) if b not in set(bits)]
        blocks = [rest[k :: radius + 1] for k in range(radius + 1)]
        subs.append(F.array(*[F.struct(F.lit(k).alias("sub"), F.col("fp").bitwiseAND(F.lit(signed(mask(b)))).alias("subkey")) for k, b in enumerate(blocks)]))
    split = rows.join(large, ["part", "key"]).select(*rows.columns, F.explode(F.element_at(F.array(*subs), F.col("part") + 1)).alias("s")).select(*rows.columns, "s.sub", "s.subkey")
    return plain.join(large, ["part", "key"], "left_anti").unionByName(paired(staged(split), radius))


def paired(rows: DataFrame, radius: int) -> DataFrame:
    """rows of which the buckets (part, key, sub, subkey) that are still large are dealt by a hash over blocks of at most about LARGE_BUCKET rows; each pair of blocks becomes a bucket, so that any two rows meet in one."""
    keys = ["part", "key", "sub", "subkey"]
    large = staged(rows.groupBy(*keys).count().filter(F.col("count") > LARGE_BUCKET).select(*keys, F.ceil(F.col("count") / LARGE_BUCKET).alias("blocks")))
    n = large.count()
    if not n:
        return rows
    large = F.broadcast(large) if n <= BROADCAST_ROWS else large
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    dealt = rows.join(large, keys).select("*", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    pair = F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")
    dealt = dealt.withColumn("sub", (F.col("sub") + (radius + 1) * (pair + 1)).cast("int"))  # a number that no other bucket of the key has
    return rows.join(large.drop("blocks"), keys, "left_anti").unionByName(dealt.select(*rows.columns))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes and links between them, the least node of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def near_pairs(fp: np.ndarray, group: np.ndarray, radius: int, large: int | None = None):
    """Places (i, j) of all pairs that share a group and are within `radius`, in arrays. Rows of a group stand together.

    Groups of more than `large` rows are split by each of radius + 1 blocks of bits, one of which any such pair agrees in.
    """
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(first, len(group)))
    split = size > large if large else np.zeros(len(size), bool)
    # small groups all at once, a step apart and then more; others by blocks of rows against all later rows
    small = size <= 48
    left = np.where(np.repeat(small, size), np.repeat(first + size, size) - np.arange(len(group)) - 1, 0)  # rows of the group after each row
    for step in range(1, int(size[small].max(initial=1))):
        at = np.flatnonzero(left >= step)
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
        yield near, near + step
    for lo, n in zip(first[~small & ~split], size[~small & ~split], strict=True):
        x = fp[lo : lo + n]
        rows = max(1, 2_000_000 // int(n))
        for i in range(0, int(n), rows):
            p, q = np.nonzero(np.bitwise_count(x[i : i + rows, None] ^ x[None, i:]) <= radius)
            p, q = p[q > p], q[q > p]
            yield lo + i + p, lo + i + q
    for lo, n in zip(first[split], size[split], strict=True):
        for k in range(radius + 1):
            block = fp[lo : lo + n] & np.uint64(mask(range(k, BITS, radius + 1)))
            order = np.argsort(block)
            for p, q in near_pairs(fp[lo + order], block[order], radius):
                yield lo + order[p], lo + order[q]


def links_of(fp: np.ndarray, group: np.ndarray, radius: int, large: int | None = SPLIT_BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places: a spanning forest of the near_pairs."""
    a, b, many, label = [], [], 0, np.arange(len(fp))
    for x, y in near_pairs(fp, group, radius, large):
        a.append(x)
        b.append(y)
        many += len(x)
        if many > 2_000_000:
            label = forest(np.concatenate([np.arange(len(fp)), *a]), np.concatenate([label, *b]), len(fp))
            a, b, many = [], [], 0
    label = forest(np.concatenate([np.arange(len(fp)), *a]), np.concatenate([label, *b]), len(fp))
    at = np.flatnonzero((label != np.arange(len(fp))) & (fp != fp[label]))
    return at, label[at]


def nearest_of(fp: np.ndarray, group: np.ndarray, radius: int, large: int | None = SPLIT_BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places: each row and the nearest of the earlier ones near it in its bucket."""
    best, far = np.full(len(fp), -1), np.full(len(fp), BITS + 1)
    for x, y in near_pairs(fp, group, radius, large):
        x, y = np.minimum(x, y), np.maximum(x, y)
        d = np.bitwise_count(fp[x] ^ fp[y]).astype(np.int64)
        order = np.lexsort((x, -d))
        x, y, d = x[order], y[order], d[order]  # of equal y, the last one written is the nearest
        closer = d < far[y]
        best[y[closer]], far[y[closer]] = x[closer], d[closer]
    at = np.flatnonzero(best >= 0)
    return best[at], at


def near_links(uniq: DataFrame, radius: int = 3, nearest: bool = False) -> DataFrame:
    """Links (a, b) between the distinct rows of uniq(fp): enough to connect all that any link connects.

    With nearest: only pairs that are within the radius, of each fingerprint and bucket that of the nearest earlier one.
    """
    n, both = bit_counts(uniq)
    chosen = plan(n, both, radius)
    rows = refined(probes(uniq, chosen), chosen, radius)
    keys = ["part", "key", "sub", "subkey"]

    def link(frames):
        kept: list = []
        for pdf in frames:
            if not len(pdf):
                continue
            k = pdf[keys].to_numpy()
            new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(1))))
            last = int(new[-1])
            if last or (kept and (kept[-1][keys].iloc[-1].to_numpy() != k[-1]).any()):
                yield frame(pd.concat([*kept, pdf.iloc[:last]], ignore_index=True))
                kept = []
            kept.append(pdf.iloc[last:])
        if kept:
            yield frame(pd.concat(kept, ignore_index=True))

    def frame(pdf):
        k = pdf[keys].to_numpy()
        group = np.cumsum(np.concatenate(([True], (k[1:] != k[:-1]).any(1)))) if len(k) else np.empty(0, int)
        fp = pdf.fp.to_numpy(np.int64).view(np.uint64)
        a, b = (nearest_of if nearest else links_of)(fp, group, radius)
        return pd.DataFrame({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)})

    dealt = rows.repartition(partitions(uniq.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(link, "a long, b long").distinct()


def classes(fps: DataFrame, radius: int = 3) -> tuple[DataFrame, DataFrame | None]:
    """For each distinct fp of fps(id, fp) its component_id, the least id that links reach from it; and the fingerprints of very many rows."""
    uniq = staged(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("count")))
    labels = connected(staged(near_links(uniq.select("fp"), radius)))  # only linked ones
    named = uniq.select("fp", "least", F.col("fp").alias("node")).join(labels, "node", "left").select("fp", "least", F.coalesce("label", "node").alias("label"))
    counts = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("count"))
    counts = staged(counts)
    of = salted_join(named, counts.drop("count"), "label", "fp", hot=hot_keys(counts.select("label", "count")))
    return of.select("fp", "component_id"), hot_keys(uniq.select("fp", "count"))


def simhash_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """A row for each row of docs: its id, fingerprint (long) and component_id.

    All pairs of fingerprints that differ in at most `radius` bits are linked, exactly: groups of bits and thresholds
    (see plan) give candidates, each is verified, and only a spanning forest of a bucket's links leaves it.
    Equal fingerprints are one node, however many rows have them. Texts without words, and null texts, have fingerprint
    zero and are linked like any other. Repeated rows stay. Null ids never name a component unless all its ids are null.
    """
    fps = staged(with_fingerprint(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", "fp", shingle).select("id", "fp"))
    of, hot = classes(fps, radius)
    return salted_join(fps, of, "fp", "id", hot=hot).select(F.col("id").alias(id), F.col("fp").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 7) -> DataFrame:
    """docs with only one row of each near-duplicate component, that of least id (null ids last).

    Two texts are linked exactly if their sets of five-word shingles have a Jaccard similarity of 0.8 or more; no such
    pair is missed (see similar.py). SimHash fingerprints within `radius` bits propose links first; the radius changes
    the work only. Texts without words, null ones among them, are alike. Of repeated rows one stays. An empty table
    stays empty. All columns of docs stay as they are, whatever their names.
    """
    from .similar import similar_classes, with_prefix

    inner = ["_fp", "_fp2", "_size", "_sim", "_prefix", "_node", "_set"]
    plain, names, (id, text) = plain_names(docs, id, text)
    work = staged(with_prefix(plain, text, shingle, similarity).withColumn("_node", F.monotonically_increasing_id()))
    kept = work.join(similar_classes(work, id, text, shingle, similarity, radius), "_node", "left_semi")
    return kept.drop(*inner).toDF(*names)
