"""Near-duplicate classes by the exact Jaccard similarity of word shingles.

SimHash fingerprints of the shingles (operator 5: groups of bits, probes) propose most links; each is verified on the sets
themselves. Prefix, length and place filters then propose what SimHash can't see, among texts that are still apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, hot_keys, partitions, salted_join, staged, windows, word_hashes
from .components import connected
from .simhash import majority, near_links, signed

#: All texts up to so many, and a sixteenth of more, show which shingles are frequent. Only the work depends on it.
SAMPLE = 10_000
#: So many frequent shingles go to every task.
FREQUENT = 100_000
#: Texts that are similar share so many shingles of their prefixes (fewer only if they have fewer).
SHARED = 3
#: Buckets with more rows are compared by sketches of the texts, in blocks of at most so many rows.
SMALL_BUCKET = 64
BLOCK_ROWS = 8_192


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of the whole text if it has fewer words."""
    h = word_hashes((text or "").encode("utf-8", "replace").lower())  # bytes: only A-Z change, only the six blanks part
    return np.unique(windows(h, min(n, len(h)) or 1))


def least_overlap(n, similarity: float):
    """How many of n shingles any set as similar as that shares."""
    return np.ceil(np.asarray(n) * similarity - 1e-9).astype(np.int64)


def frequent(docs: DataFrame, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, that stand in three or more texts of a sample, and in how many."""

    def of(frames):
        for pdf in frames:
            sets = [shingles(t, n) for t in pdf["t"]]
            yield pd.DataFrame({"h": (np.concatenate(sets) if sets else np.empty(0, np.uint64)).view(np.int64)})

    few = docs.count() <= SAMPLE
    some = docs if few else docs.filter(F.pmod(F.xxhash64(text, F.lit("sample")), F.lit(16)) == 0)
    rows = some.select(F.col(text).alias("t")).mapInPandas(of, "h long").groupBy("h").count().filter("count >= 3").orderBy(F.desc("count"), "h").limit(FREQUENT).toPandas()
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["count"].to_numpy(np.int64)[order]


def with_prefix(docs: DataFrame, text: str, n: int, similarity: float) -> DataFrame:
    """docs with _fp and _fp2 (128 bits that name the set of shingles), _size (of the set), _sim (its SimHash) and _prefix.

    The prefix is the first size - least_overlap + SHARED shingles, rarest first by one order for all texts: two sets as
    similar as that share so many shingles of both prefixes (all they share, if fewer), whatever the order is.
    """
    hashes, counts = frequent(docs, text, n)
    sent = docs.sparkSession.sparkContext.broadcast((hashes, counts))

    @F.pandas_udf("struct<a:long,b:long,size:int,sim:long,prefix:array<long>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        known, many = sent.value
        out = []
        for t in texts:
            s = shingles(t, n)
            name = xxhash.xxh3_128_digest(s.tobytes())
            weight = np.zeros(len(s), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                weight = np.where(known[at] == s, many[at], 0)
            order = np.lexsort((s, weight))
            length = len(s) - int(least_overlap(len(s), similarity)) + SHARED
            sim = signed(majority((s ^ s >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)))
            out.append((int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True), len(s), sim, s[order[:length]].view(np.int64)))
        return pd.DataFrame(out, columns=["a", "b", "size", "sim", "prefix"])

    k = F.col("_set")
    return docs.withColumn("_set", of(F.col(text).cast("string"))).select(*docs.columns, k["a"].alias("_fp"), k["b"].alias("_fp2"), k["size"].alias("_size"), k["sim"].alias("_sim"), k["prefix"].alias("_prefix"))


def whole_groups(frames, key: str = "key"):
    """Frames, sorted by key, cut so that no group stands in two."""
    kept: list = []
    for pdf in frames:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        last = int(np.searchsorted(k, k[-1]))
        if last or (kept and kept[-1][key].iloc[-1] != k[-1]):
            yield pd.concat([*kept, pdf.iloc[:last]], ignore_index=True)
            kept = []
        kept.append(pdf.iloc[last:])
    if kept:
        yield pd.concat(kept, ignore_index=True)


def runs(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group starts, and its length."""
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(k)))


def needed(size_x: np.ndarray, size_y: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles two sets of these sizes share at least, if they are as similar as that."""
    return np.ceil(similarity / (1 + similarity) * (size_x + size_y) - 1e-9).astype(np.int64)


def possible(size: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes, with one of their first SHARED shared shingles at these places, may be similar enough."""
    return np.minimum(size[x] - at[x], size[y] - at[y]) >= needed(size[x], size[y], similarity) - (SHARED - 1)


#: So many sets are few beside the texts that they are made of.
FEW_SETS = 10_000
#: A key with more rows than that is dealt over cells before its rows go to tasks. Keys are looked for in one of so many texts.
LARGE_KEY = 50_000
LOOKED_AT = 16
COLUMNS = ("key", "node", "size", "at", "label")
PAIR_OR_BLOCK = "a long, b long, need long, key long, cell long, side int, node long, size int, at int, label long"
NAMES = [c.split()[0] for c in PAIR_OR_BLOCK.split(", ")]


def arrays(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: pdf[c].to_numpy(np.int64) for c in COLUMNS}


def bucketed(rows: DataFrame, similarity: float) -> DataFrame:
    """Of rows(key, node, size, at, label), what stands together under a key and is not of one label: all pairs (a, b, need) of
    a small bucket that may be similar; the rows of a large one, in order of size and cut into blocks, under each cell (pair of
    blocks whose sizes are near enough)."""

    def blocks(b, at):
        at = at[np.argsort(b["size"][at], kind="stable")]
        cut = [at[i : i + BLOCK_ROWS] for i in range(0, len(at), BLOCK_ROWS)]
        for i, x in enumerate(cut):
            for j in range(i, len(cut)):
                y = cut[j]
                if b["size"][y[0]] * similarity > b["size"][x[-1]]:
                    break
                for side, z in enumerate((x, y)[: 1 + (i != j)]):
                    yield pd.DataFrame({"cell": i * len(cut) + j, "side": side} | {c: b[c][z] for c in COLUMNS})

    def of(frames):
        for pdf in whole_groups(frames):
            b = arrays(pdf)
            if not len(pdf):
                continue
            first, length = runs(b["key"])
            apart = np.minimum.reduceat(b["label"], first) != np.maximum.reduceat(b["label"], first)
            b = {c: v[np.repeat(apart, length)] for c, v in b.items()}
            first, length = runs(b["key"])
            small = length <= SMALL_BUCKET
            left = np.where(np.repeat(small, length), np.repeat(first + length, length) - np.arange(len(b["key"])) - 1, 0)
            found = [np.empty((3, 0), np.int64)]
            for step in range(1, int(length[small].max(initial=1))):
                x = np.flatnonzero(left >= step)
                y = x + step
                good = (b["label"][x] != b["label"][y]) & possible(b["size"], b["at"], x, y, similarity)
                x, y = x[good], y[good]
                found.append(np.stack([np.minimum(b["node"][x], b["node"][y]), np.maximum(b["node"][x], b["node"][y]), np.minimum(SHARED, needed(b["size"][x], b["size"][y], similarity))]))
            yield pd.DataFrame(dict(zip(("a", "b", "need"), np.concatenate(found, axis=1), strict=True)))
            for lo, many in zip(first[~small].tolist(), length[~small].tolist(), strict=True):
                yield from blocks(b, np.arange(lo, lo + many))

    n = partitions(rows.sparkSession)
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInPandas(lambda f: (x.reindex(columns=NAMES) for x in of(f)), PAIR_OR_BLOCK)


def dealt(rows: DataFrame, nodes: int, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """rows(key, node, size, at, label) less those of keys with more than LARGE_KEY rows, and the cells of these, if there are any, as bucketed() gives them.

    Such a key's rows stand in stretches of size, cut so that similar sets are of one stretch or two that follow each
    other, and each stretch in blocks by a hash of the node. A cell is a pair of blocks that may hold similar sets; it is of a
    bounded size whatever the key. A row goes to as many cells as its key has such blocks. Keys whose rows are all of
    one label are left out.
    """
    if nodes <= LARGE_KEY:  # a node has a key once
        return rows, None
    seen = rows.filter(F.pmod(F.xxhash64("node", F.lit("large")), F.lit(LOOKED_AT)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("count"))
    large = staged(seen.filter(F.col("count") > LARGE_KEY // (2 * LOOKED_AT)).select("key"))
    many = large.count()
    if not many:
        return rows, None
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    large = small(large, many)
    stretch = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / float(-np.log(similarity * (1 - 1e-9)))).alias("stretch")
    mine = rows.join(large, "key", "left_semi").select("*", stretch)
    counts = staged(mine.groupBy("key", "stretch").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"), F.min("label").alias("least"), F.max("label").alias("most")))
    apart = counts.groupBy("key").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least != most").select("key")
    of = counts.join(apart, "key", "left_semi").select("key", "stretch", "blocks")
    beside = lambda by, name: of.select("key", (F.col("stretch") + by).alias("stretch"), F.col("blocks").alias(name))
    sizes = small(of.join(beside(-1, "above"), ["key", "stretch"], "left").join(beside(1, "below"), ["key", "stretch"], "left").na.fill(0, ["above", "below"]), counts.count())
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.col(n)), lambda j: j < F.col(n))
    cell = lambda lower, i, kind, j, side: F.struct(F.xxhash64(lower, i, F.lit(kind), j).alias("cell"), side.cast("int").alias("side"))
    within = F.transform(upto("blocks"), lambda j: cell(F.col("stretch"), F.least("own", j), "same", F.greatest(F.col("own"), j), F.when(F.col("own") <= j, 0).otherwise(1)))
    up = F.transform(upto("above"), lambda j: cell(F.col("stretch"), F.col("own"), "next", j, F.lit(0)))
    down = F.transform(upto("below"), lambda j: cell(F.col("stretch") - 1, j, "next", F.col("own"), F.lit(1)))
    cells = mine.join(sizes, ["key", "stretch"]).withColumn("own", own).select(*COLUMNS, F.explode(F.concat(within, up, down)).alias("c")).select(*COLUMNS, "c.*")
    none = F.lit(None).cast("long")
    cells = cells.select(none.alias("a"), none.alias("b"), none.alias("need"), "key", "cell", F.col("side").cast("int").alias("side"), "node", F.col("size").cast("int").alias("size"), F.col("at").cast("int").alias("at"), "label")
    return rows.join(large, "key", "left_anti"), cells


def compared(cells: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """Pairs (a, b) of different labels in the cells of large buckets, of rows with sketches (k), that may be similar by all filters. With nearest, of each row in a cell only its nearest by the sketches."""

    def of(frames):
        for pdf in whole_groups(frames, "group"):
            b, side, k = arrays(pdf), pdf["side"].to_numpy(), pdf["k"].to_numpy()
            for lo, many in zip(*runs(pdf["group"].to_numpy()), strict=True):
                at = np.arange(lo, lo + many)
                xs, ys = at[side[at] == 0], at[side[at] == 1]
                best, apart = np.full(many, -1), np.full(many, np.iinfo(np.int64).max)
                for x, y, d in near(b, k, xs, ys if len(ys) else xs):
                    if not nearest:
                        yield frame(b, x, y)
                        continue
                    for p, q in ((x, y), (y, x)):
                        order = np.argsort(-d, kind="stable")  # of equal places, the last one written is the nearest
                        p, q, e = p[order], q[order], d[order]
                        closer = e < apart[p - lo]
                        best[p[closer] - lo], apart[p[closer] - lo] = q[closer], e[closer]
                if nearest:
                    x = np.flatnonzero(best >= 0)
                    yield frame(b, lo + x, best[x])

    def frame(b, x, y):
        return pd.DataFrame({"a": np.minimum(b["node"][x], b["node"][y]), "b": np.maximum(b["node"][x], b["node"][y])}).drop_duplicates()

    def near(b, k, xs, ys):
        """Places and sketch distances, a stretch of xs and a size of sketches at a time; of one side (ys is xs), each pair once."""
        sized = lambda at: {n: at[[len(k[i]) == n for i in at]] for n in {len(k[i]) for i in at}}
        left, right = sized(xs), sized(ys)
        bits = lambda at, n: np.bitwise_xor.reduce(np.stack([np.frombuffer(k[i], np.uint64) for i in at]).reshape(len(at), -1, n // 8), axis=1)
        for n, x in left.items():
            for m, y in right.items():
                if ys is xs and m < n:
                    continue
                p, q = bits(x, min(n, m)), bits(y, min(n, m))
                step = max(1, 4_000_000 // (len(y) * p.shape[1]))
                for i in range(0, len(x), step):
                    z = x[i : i + step]
                    d = np.bitwise_count(p[i : i + step, None] ^ q[None]).sum(-1, dtype=np.int64)
                    most = (1 - similarity) / (1 + similarity) * (b["size"][z, None] + b["size"][None, y]) + 1e-9
                    e, f = np.nonzero((d <= most) & (b["label"][z, None] != b["label"][None, y]))
                    if ys is xs and m == n:
                        e, f = e[f > e + i], f[f > e + i]
                    good = possible(b["size"], b["at"], z[e], y[f], similarity)
                    yield z[e[good]], y[f[good]], d[e[good], f[good]]

    n = partitions(cells.sparkSession)
    return cells.repartition(n, "group").sortWithinPartitions("group").mapInPandas(of, "a long, b long").distinct()


def sketch(h: np.ndarray) -> bytes:
    """Parities of how many hashes fall to each of 256 bits or more, at least two for each hash."""
    bits = 256
    while bits < 2 * len(h):
        bits *= 2
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) % 2 == 1).tobytes()


def sketched(a: bytes, b: bytes) -> int:
    """From two sketches, a number that the sets' symmetric difference is not below."""
    p, q = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    m = min(len(p), len(q))
    return int(np.bitwise_count(np.bitwise_xor.reduce(p.reshape(-1, m)) ^ np.bitwise_xor.reduce(q.reshape(-1, m))).sum())


def packed(nodes: DataFrame, docs: DataFrame, text: str, n: int, sets: bool = True) -> DataFrame:
    """(node, k, n, s) of the distinct nodes(node): the sketch of the text's set, its size and, with sets, the set itself."""

    @F.pandas_udf("struct<k:binary,n:int,s:binary>")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [shingles(t, n) for t in texts]
        return pd.DataFrame({"k": [sketch(x) for x in found], "n": np.array([len(x) for x in found], np.int32), "s": [x.tobytes() if sets else None for x in found]})

    only = staged(nodes.select(F.col("node").alias("_node")).distinct())
    many = only.count()
    only = F.broadcast(only) if many <= BROADCAST_ROWS else only
    return staged(docs.select("_node", F.col(text).cast("string").alias("t")).join(only, "_node", "left_semi").select(F.col("_node").alias("node"), of("t").alias("p")).select("node", "p.*"), few=not sets or many <= FEW_SETS)


def similar(pairs: DataFrame, docs: DataFrame, text: str, n: int, similarity: float) -> DataFrame:
    """The pairs(a, b) of values of docs._node whose sets have that Jaccard similarity or more.

    Short sketches, which bound it from above, go to all pairs, and sets to those that are left.
    """

    @F.pandas_udf("boolean")
    def maybe(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        apart = np.array([sketched(x, y) for x, y in zip(a, b, strict=True)], np.int64)
        return pd.Series(apart <= (1 - similarity) / (1 + similarity) * (na.to_numpy() + nb.to_numpy()) + 1e-9)

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
        return pd.Series(out, dtype=bool)

    def with_both(pairs, *columns):
        for end, other in (("a", "b"), ("b", "a")):
            named = sets.select(F.col("node").alias(end), *[F.col(c).alias(c + end) for c in columns])
            pairs = salted_join(pairs, named, end, other, hot=hot_keys(pairs.groupBy(end).count()) if end == "a" else None)
        return pairs

    sets = packed(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, text, n)
    left = staged(with_both(pairs, "k", "n").filter(maybe("ka", "kb", "na", "nb")).select("a", "b"), few=True)
    return with_both(left, "s").filter(near("sa", "sb")).select("a", "b")


def similar_classes(work: DataFrame, id: str, text: str, n: int, similarity: float, radius: int) -> DataFrame:
    """The _node of one row for each class of work(id, text, _fp, _fp2, _size, _sim, _prefix, _node): of least id (null ids last).

    A link is a pair of sets with that Jaccard similarity; classes are what links connect. Equal sets are one node.
    Pairs that SimHash proposes join most of each group first. Then pairs under a common shingle of the prefixes are
    judged, where the texts are still apart: all of small buckets; of large ones the nearest of each text, and last, all
    that are apart even then and whose sketches are near enough. So no link between classes is left out.
    """
    order = F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col("_node").alias("node"))
    uniq = staged(work.groupBy("_fp", "_fp2").agg(F.min(order).alias("k")).select("k", F.col("k.node").alias("node")))
    docs = work.select("_node", text)
    judged = lambda pairs: staged(similar(staged(pairs, few=True), docs, text, n, similarity), few=True)

    first = staged(work.select(F.col("_node").alias("node"), "_sim").join(uniq.select("node"), "node", "left_semi"))
    sims = staged(first.groupBy("_sim").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("count")))
    rep = lambda end: sims.select(F.col("_sim").alias(end), F.col("rep").alias(f"{end}_rep"))
    far = staged(near_links(sims.select(F.col("_sim").alias("fp")), radius, nearest=True), few=True).join(rep("a"), "a").join(rep("b"), "b").select("a_rep", "b_rep")
    same = salted_join(first, sims.select("_sim", "rep"), "_sim", "node", hot=hot_keys(sims.select("_sim", "count"))).filter("node != rep").select("node", "rep")
    links = judged(far.union(same).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    labels = staged(connected(links))

    label = lambda df: df.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = work.select(F.col("_node").alias("node"), F.col("_size").alias("size"), "_prefix").join(label(uniq.select("node")), "node").select("node", "size", "label", F.posexplode("_prefix").alias("at", "key"))
    rows, spread = dealt(rows, uniq.count(), similarity)
    found = bucketed(rows, similarity)
    found = staged(found.unionByName(spread) if spread is not None else found)
    pairs = found.filter("a is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("many"), F.max("need").alias("need")).filter("many >= need").select("a", "b")
    cells = found.filter("key is not null").drop("a", "b", "need")
    large = cells.limit(1).count()
    if large:
        cells = staged(cells.withColumn("group", F.xxhash64("key", "cell")).join(packed(cells, docs, text, n, sets=False).select("node", "k"), "node"))
        pairs = pairs.unionByName(compared(cells, similarity, nearest=True)).distinct()
    links = staged(links.unionByName(judged(pairs)))
    labels = staged(connected(links))
    if large:
        last = judged(compared(label(cells.drop("label")), similarity, nearest=False))
        if last.limit(1).count():
            labels = staged(connected(links.unionByName(last)))
    named = uniq.join(labels, "node", "left").select("k", F.coalesce("label", "node").alias("label"))
    return named.groupBy("label").agg(F.min("k").alias("k")).select(F.col("k.node").alias("_node"))
