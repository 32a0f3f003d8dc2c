"""Operator 11: ranked lexical search, MaxScore in every shard of an index dealt by documents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, staged

#: A shard closes at so many terms or documents; places of documents in it are 16-bit numbers.
SHARD_TERMS = 1 << 21
SHARD_DOCUMENTS = 1 << 16
#: Documents that are scored between two looks at the threshold.
STRETCH = 2048
#: A block of queries has about so many rows (item, term); it is sent to every task.
BLOCK_ROWS = 1 << 16
SLICE = 1 << 22

#: ASCII letters and digits stay, A-Z in lower case; every other ASCII character ends a term; the rest are letters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, a slice of it at a time."""
    data, at = data.translate(FOLD), 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def skyline(term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which postings no other of their term beats in both a larger tf and a shorter document: a score's maximum is among them, whatever the statistics. term: ascending numbers from 0."""
    order = np.lexsort((n, -tf.astype(np.int64), term))
    falling = n[order].astype(np.int64) - (term[order].astype(np.int64) << 33)  # falls at each new term, so that the minimum begins anew
    least = np.minimum.accumulate(falling)
    keep = np.ones(len(order), bool)
    keep[1:] = least[1:] < least[:-1]
    return order[keep]


def narrowest(a: np.ndarray) -> np.ndarray:
    most = int(a.max(initial=0))
    return a.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index of all terms of docs, in shards of whole documents.

    A row (shard, term, documents, places, tfs, best_tf, best_n) for each term of a shard: the number of documents that
    hold it, their places in the shard in order, its occurrences there, and the skyline of (occurrences, length of the
    document). And a row without a term for each shard: its documents' ids and numbers of terms, how many have any, and
    the sum. Null and empty texts are in it with no terms; rows that share an id are documents of their own. Other columns
    do not matter; an empty docs gives an empty index.

    Each task indexes what it reads and closes shards of a bounded size, so nothing is shuffled.
    """
    kind = docs.schema[id].dataType
    schema = T.StructType().add("shard", "long").add("term", "string").add("documents", "long").add("words", "long").add("places", "binary").add("tfs", "binary").add("best_tf", "binary").add("best_n", "binary").add("ids", T.ArrayType(kind)).add("lengths", "binary")

    def shard_rows(shard: int, ids: list, id_type, counts: list[int], found: list, vocabulary: dict):
        import pyarrow as pa

        def table(many: int, **columns):
            types = {"shard": pa.int64(), "term": pa.string(), "documents": pa.int64(), "words": pa.int64(), "ids": pa.list_(id_type)}
            names = [f.name for f in schema]
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(many, types.get(c, pa.binary())) for c in names], names=names)

        n = np.array(counts, np.int64)
        yield table(1, shard=pa.array([shard]), documents=pa.array([int((n > 0).sum())]), words=pa.array([int(n.sum())]), ids=pa.array([ids], pa.list_(id_type)), lengths=pa.array([n.astype("<u4").tobytes()], pa.binary()))
        key = np.concatenate([np.empty(0, np.uint64), *found]) << np.uint64(16)
        key |= np.repeat(np.arange(len(n), dtype=np.uint64), n)
        pairs, tf = np.unique(key, return_counts=True)
        if not len(pairs):
            return
        term, place = (pairs >> np.uint64(16)).astype(np.int64), (pairs & np.uint64(0xFFFF)).astype("<u2")
        best = skyline(term, tf, n[place])
        cut = lambda numbers, of: (np.searchsorted(of, np.arange(len(vocabulary) + 1)) * numbers.itemsize).astype(np.int32)
        lists = lambda numbers, of: pa.Array.from_buffers(pa.binary(), len(vocabulary), [None, pa.py_buffer(cut(numbers, of).tobytes()), pa.py_buffer(numbers.tobytes())])
        columns = {"shard": pa.array(np.full(len(vocabulary), shard)), "term": pa.array([w.decode() for w in vocabulary]), "documents": pa.array(np.bincount(term, minlength=len(vocabulary))), "places": lists(place, term), "tfs": lists(narrowest(tf), term), "best_tf": lists(tf[best].astype("<u4"), term[best]), "best_n": lists(n[place[best]].astype("<u4"), term[best])}
        whole = table(len(vocabulary), **columns)
        for lo in range(0, whole.num_rows, 8192):
            yield whole.slice(lo, 8192)

    def index(batches):
        from pyspark import TaskContext

        def anew():
            vocabulary = defaultdict()
            vocabulary.default_factory = vocabulary.__len__
            return [], [], [], vocabulary, 0

        shard, id_type = TaskContext.get().partitionId() << 32, None
        ids, counts, found, vocabulary, words = anew()
        for b in batches:
            id_type = b.schema.field(0).type
            for k in range(b.num_rows):
                ids.append(b.column(0)[k].as_py())
                here = 0
                for part in terms_of(b.column(1)[k].as_py() or b""):
                    found.append(np.fromiter(map(vocabulary.__getitem__, part), np.uint64, len(part)))
                    here += len(part)
                counts.append(here)
                words += here
                if words >= SHARD_TERMS or len(ids) >= SHARD_DOCUMENTS:
                    yield from shard_rows(shard, ids, id_type, counts, found, vocabulary)
                    shard += 1
                    ids, counts, found, vocabulary, words = anew()
        if ids:
            yield from shard_rows(shard, ids, id_type, counts, found, vocabulary)

    return staged(docs.select(F.col(id).alias("id"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(index, schema))


def query_terms(queries: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term, many) of the queries; rows that share an item are one query."""
    kind = queries.schema[item].dataType

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                for part in terms_of(b.column(1)[k].as_py() or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * len(part), b.schema.field(0).type), pa.array([w.decode() for w in part], pa.string())], names=["item", "term"])

    rows = queries.select(F.col(item).alias("item"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(cut, T.StructType().add("item", kind).add("term", "string"))
    return rows.groupBy("item", "term").agg(F.count(F.lit(1)).alias("many"))


def gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1_000 * tf + 8 * m)


class Lists:
    """The posting lists of one shard; a list's gains are worked out when it is first scored or probed."""

    def __init__(self, lengths: np.ndarray, rows, weight: dict[str, int], documents: int, words: int) -> None:
        self.documents = len(lengths)
        self.m = self.lengthened(lengths, documents, words)
        self.weight, self.postings, self.bound, self.scored = weight, {}, {}, {}
        for r in rows:
            w = weight[r["term"]]
            best = gains(np.frombuffer(r["best_tf"], "<u4"), self.lengthened(np.frombuffer(r["best_n"], "<u4"), documents, words))
            self.bound[r["term"]] = w * int(best.max())
            self.postings[r["term"]] = (r["places"], r["tfs"])

    @staticmethod
    def lengthened(n: np.ndarray, documents: int, words: int) -> np.ndarray:
        if 75 * int(n.max(initial=0)) * documents < 1 << 63:
            return 25 + 75 * n.astype(np.int64) * documents // words
        return np.array([25 + 75 * x * documents // words for x in n.tolist()], np.int64)

    def of(self, term: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, what the term adds to the score at each, and where each stretch of documents begins among them."""
        if term not in self.scored:
            places, tfs = self.postings[term]
            at = np.frombuffer(places, "<u2").astype(np.int64)
            tf = np.frombuffer(tfs, f"<u{len(tfs) // len(at)}")
            self.scored[term] = at, self.weight[term] * gains(tf, self.m[at]), np.searchsorted(at, np.arange(0, self.documents + STRETCH, STRETCH))
        return self.scored[term]


def max_score(lists: Lists, terms: list[tuple[str, int]], k: int, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the shard's k best documents for a query of (term, times), ties by `tie`; scores above 0.

    Lists stand in order of the most that they can add. As soon as k documents are known, the lists that together stay
    under the k-th score are not essential: a document in none of the others can't qualify. Documents are taken stretch by
    stretch from the essential lists; the rest are probed from the largest bound down, for those documents alone whose
    score can still reach the k-th.
    """
    mine = sorted((lists.bound[t] * many, t, many) for t, many in terms if t in lists.bound)
    below = np.concatenate(([0], np.cumsum([b for b, _, _ in mine]))).astype(np.int64)  # the most that the first j lists add
    top, score, least, free = np.empty(0, np.int64), np.empty(0, np.int64), 0, 0
    for s in range(-(-lists.documents // STRETCH)):
        if len(top) == k:
            free = int(np.searchsorted(below, least)) - 1  # the first `free` lists add less than the k-th score
            if free == len(mine):
                break
        base, gained = s * STRETCH, np.zeros(STRETCH, np.int64)
        for _, t, many in mine[free:]:
            at, gain, cuts = lists.of(t)
            lo, hi = cuts[s], cuts[s + 1]
            gained[at[lo:hi] - base] += gain[lo:hi] * many
        found = np.flatnonzero(gained)
        got = gained[found]
        for j in range(free - 1, -1, -1):
            can = got + below[j + 1] >= least
            found, got = found[can], got[can]
            if not len(found):
                break
            at, gain, cuts = lists.of(mine[j][1])
            at, gain = at[cuts[s] : cuts[s + 1]], gain[cuts[s] : cuts[s + 1]]
            if len(at):
                where = np.minimum(np.searchsorted(at, found + base), len(at) - 1)
                got = got + np.where(at[where] == found + base, gain[where] * mine[j][2], 0)
        can = got >= max(least, 1)
        if can.any():
            top, score = np.concatenate((top, found[can] + base)), np.concatenate((score, got[can]))
            order = np.lexsort((tie[top], -score))[:k]
            top, score = top[order], score[order]
            least = int(score[-1]) if len(top) == k else 0
    return top, score


def search(index: DataFrame, queries: DataFrame, k: int = 10, item: str = "item_id", text: str = "text", id: str = "doc_id") -> DataFrame:
    """(item, rank, id, score) of the k best documents of index (see build_index) for each query, from rank 1; equal scores by least id, null ids first.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), of N documents with a term of which df hold it. A document
    of n terms, of L in all, scores for each term of the query, repeats included, the weight times
    10^9 tf div (1000 tf + 8 m), where m is 25 + (75 n N) div L. Documents without a score have no row, nor have queries
    without a document. Queries of null or empty text find nothing; rows that share an item are one query, null items too.

    Queries go in blocks of about BLOCK_ROWS terms, which every task has by broadcast. A block's posting lists meet their
    shard's documents by the number of the shard; a shard is of a bounded size, and gives k rows for a query at most.
    """
    spark = index.sparkSession
    wanted = staged(query_terms(queries, item, text))
    terms = wanted.select("term").distinct()
    terms = F.broadcast(terms) if wanted.count() <= BROADCAST_ROWS else terms
    n_documents, n_words = index.filter("term is null").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()  # two numbers
    frequency = index.filter("term is not null").select("term", "documents").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("documents").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_documents + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = staged(wanted.join(frequency, "term").select("item", "term", "many", weight.alias("weight")).filter("weight > 0"))
    blocks = max(1, -(-weights.count() // BLOCK_ROWS))
    item_type, id_type = queries.schema[item].dataType, index.schema["ids"].dataType.elementType
    schema = T.StructType().add("item", item_type).add("id", id_type).add("score", "long")
    kinds = to_arrow_schema(schema)

    def found(block: int) -> DataFrame:
        mine = weights.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        asked, weigh = defaultdict(list), {}
        for r in mine.collect():  # a block of queries
            asked[r["item"]].append((r["term"], r["many"]))
            weigh[r["term"]] = r["weight"]
        block_terms = F.broadcast(spark.createDataFrame([(t,) for t in weigh], "term string"))  # BLOCK_ROWS or so
        sent = spark.sparkContext.broadcast(([*asked.items()], weigh))

        def best(table):
            import pyarrow as pa

            shard, rows = None, []
            for r in table.select(["term", "places", "tfs", "best_tf", "best_n", "ids", "lengths"]).to_pylist():
                if r["term"] is None:
                    shard = r
                else:
                    rows.append(r)
            queries, weigh = sent.value
            lists = Lists(np.frombuffer(shard["lengths"], "<u4"), rows, weigh, n_documents, n_words)
            ids = shard["ids"]
            tie = np.empty(len(ids), np.int64)
            tie[sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))] = np.arange(len(ids))
            out = [(q, ids[p], s) for q, terms in queries for p, s in zip(*(x.tolist() for x in max_score(lists, terms, k, tie)), strict=True)]
            return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), kinds.types, strict=True)], schema=kinds)

        lists = index.filter("term is not null").join(block_terms, "term", "left_semi").unionByName(index.filter("term is null"))
        return lists.groupBy("shard").applyInArrow(best, schema)

    every = found(0)
    for block in range(1, blocks):
        every = every.unionByName(found(block))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_first())
    ranked = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("id").alias(id), "score")


def oracle(k: int = 10) -> str:
    """DuckDB SQL for the op11 query over documents and benchmark."""
    cut = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
with docs as materialized (select row_number() over () as rid, doc_id, {cut} as w from documents),
sizes as (select rid, doc_id, len(w)::bigint as n from docs),
whole as (select count(*) filter (where n > 0)::bigint as all_docs, sum(n)::bigint as all_terms from sizes),
asked as (select item_id, term, count(*)::bigint as many from (select item_id, unnest({cut}) as term from benchmark) group by 1, 2),
held as (select rid, term, count(*)::bigint as tf from (select rid, unnest(w) as term from docs) where term in (select term from asked) group by 1, 2),
weights as (select term, floor(1000 * ln((2 * all_docs + 2)::double / (2 * df + 1)::double))::bigint as weight from (select term, count(*)::bigint as df from held group by 1), whole),
lengths as (select rid, doc_id, 25 + ((75 * n * all_docs) // all_terms) as m from sizes, whole where n > 0),
scored as (select item_id, rid, sum(many * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from asked join weights using (term) join held using (term) join lengths using (rid) group by 1, 2),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls first)::int as rank, doc_id, score from scored join sizes using (rid) where score > 0)
select * from ranked where rank <= {k}"""
