"""Operator 4: stupid-backoff scores from n-gram count tables partitioned by hash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, partitions, word_hashes, windows

#: A chunk of documents closes at so many words, a bucket of the count tables holds about so many n-grams.
CHUNK_WORDS = 1 << 20
BUCKET_NGRAMS = 1 << 20

#: Hashes are kept so long that of 2 ** SPARE_BITS n-grams about one shares its hash with another, at any size of corpus (64 bits at most).
SPARE_BITS = 24

CHUNK = "chunk long, ids array<string>, lengths binary, vocabulary binary, words binary, n long"
TABLE = "n int, bucket long, chunk long, many long, hashes binary, counts binary"
TOTALS = "chunk long, n int, bucket long, many long, totals binary"


def planes(a: np.ndarray) -> bytes:
    """The bytes of a, compressed; all lowest bytes first, so that the zeros of the high bytes lie together."""
    import zstandard

    if not len(a):
        return b""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T), 1)


def unplanes(b: bytes, kind) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    if not b:
        return np.empty(0, kind)
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack(h: np.ndarray) -> bytes:
    return planes(np.diff(h, prepend=np.uint64(0)))


def unpack(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, np.uint64), dtype=np.uint64)


def chunks(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Documents of a partition in chunks: their ids, lengths and words as indexes of the chunk's own vocabulary."""

    def pack_chunk(number: int, ids: list, hashes: list):
        import pyarrow as pa

        h = np.concatenate([np.empty(0, np.uint64), *hashes])
        vocabulary, words = np.unique(h, return_inverse=True)
        row = [[number], [ids], [planes(np.fromiter(map(len, hashes), np.int32, len(hashes)))], [pack(vocabulary)], [planes(words.astype(np.uint32))], [len(h)]]
        kinds = [pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["chunk", "ids", "lengths", "vocabulary", "words", "n"])

    def cut(batches):
        from pyspark import TaskContext

        number, ids, hashes, n = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = word_hashes((t.as_py() or "").encode("utf-8", "replace"))
                ids.append(key)
                hashes.append(h)
                n += len(h)
                if n >= CHUNK_WORDS or len(ids) >= CHUNK_WORDS // 4:
                    yield pack_chunk(number, ids, hashes)
                    number, ids, hashes, n = number + 1, [], [], 0
        if ids:
            yield pack_chunk(number, ids, hashes)

    return docs.select(F.col(id).cast("string").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, CHUNK)


def ngrams(lengths: np.ndarray, h: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (the highest `bits`) of the n-grams that end at each word, and whether there is one (none reaches over the start of a document)."""
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.empty(0, int)
    at = np.arange(len(h)) - np.repeat(starts, lengths)
    out = np.zeros(len(h), np.uint64)
    if len(h) >= n:
        out[n - 1 :] = windows(h, n)
    return out >> np.uint64(64 - bits), at >= n - 1


def cuts(u: np.ndarray, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of sorted hashes, and where each bucket begins."""
    b = ((u >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.unique(b, return_index=True)


def backoff_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, min_count: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's id, n_words, log_score (sum over its words of the log of the stupid-backoff score) and mean_log_score.

    S(w | context) is count(context w) / count(context) for the longest context with a count of at least min_count
    (1 for single words), times alpha for each word that the context was shortened by; S(w) is count(w) over all
    words. Counts come from all texts of docs; contexts do not reach over the start of a text.

    Words are 64-bit hashes, n-grams hashes of a length that grows with the corpus (see SPARE_BITS). Each chunk of documents sends every n-gram that it holds once, with its count,
    to the bucket of its hash; the buckets add the counts up, and send to each chunk the totals it asked for; the chunk
    looks its documents' n-grams up and sums. So a frequent n-gram costs one entry a chunk, never one an occurrence.

    Null and empty texts have n_words 0 and null scores. Repeated rows count and are scored as often as they occur.
    Ids are of any type that text casts to. Other columns do not matter.
    """
    spark = docs.sparkSession
    total = int(docs.agg(F.coalesce(F.sum(F.regexp_count(F.col(text).cast("string"), F.lit(WORD))), F.lit(0))).first()[0])
    buckets = max(2 * partitions(spark), -(-total // BUCKET_NGRAMS))
    bits = min(64, max(32, (total * order).bit_length() + SPARE_BITS))
    # one exchange, which both the counting and the scoring read
    table = chunks(docs, id, text).repartition(partitions(spark), "chunk")

    def send(frames):
        for pdf in frames:
            for c in pdf.itertuples(index=False):
                lengths, h = unplanes(c.lengths, np.int32), unpack(c.vocabulary)[unplanes(c.words, np.uint32)]
                for n in range(1, order + 1):
                    out = []
                    g, there = ngrams(lengths, h, n, bits)
                    u, counts = np.unique(g[there], return_counts=True)
                    if not len(u):
                        continue
                    b, at = cuts(u, buckets, bits)
                    for k, lo, hi in zip(b, at, [*at[1:], len(u)], strict=True):
                        out.append((n, int(k), c.chunk, hi - lo, pack(u[lo:hi]), planes(counts[lo:hi].astype(np.int64))))
                    yield pd.DataFrame(out, columns=["n", "bucket", "chunk", "many", "hashes", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        u, which = np.unique(np.concatenate([unpack(x) for x in pdf.hashes]), return_inverse=True)
        total = np.zeros(len(u), np.int64)
        np.add.at(total, which, np.concatenate([unplanes(x, np.int64) for x in pdf.counts]))
        ends = np.cumsum(pdf.many)
        return pd.DataFrame({"chunk": pdf.chunk, "n": pdf.n, "bucket": pdf.bucket, "many": pdf.many, "totals": [planes(total[which[e - m : e]]) for e, m in zip(ends, pdf.many, strict=True)]})

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        c = left.iloc[0]
        lengths, h = unplanes(c.lengths, np.int32), unpack(c.vocabulary)[unplanes(c.words, np.uint32)]
        right = right.sort_values(["n", "bucket"])
        count = []
        for n in range(1, order + 1):
            g, there = ngrams(lengths, h, n, bits)
            u, which = np.unique(g[there], return_inverse=True)
            mine = right[right.n == n]
            totals = np.concatenate([np.empty(0, np.int64), *[unplanes(x, np.int64) for x in mine.totals]])
            full = np.zeros(len(h), np.int64)
            full[there] = totals[which]
            count.append(full)
        s, done = np.zeros(len(h)), np.zeros(len(h), bool)
        for n in range(order, 1, -1):
            hit = ~done & (count[n - 1] >= min_count)
            before = np.concatenate(([0], count[n - 2][:-1]))
            s[hit] = np.log(count[n - 1][hit]) - np.log(before[hit]) + (order - n) * np.log(alpha)
            done |= hit
        s[~done] = np.log(count[0][~done]) - np.log(total) + (order - 1) * np.log(alpha)
        # at the start of a document only so many words of context exist, and nothing was shortened
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.empty(0, int)
        at = np.arange(len(h)) - np.repeat(starts, lengths)
        s -= np.maximum(0, order - 1 - at) * np.log(alpha)
        sums = np.zeros(len(lengths))
        np.add.at(sums, np.repeat(np.arange(len(lengths)), lengths), s)
        some = lengths > 0
        return pd.DataFrame({"id": c.ids, "n_words": lengths.astype(np.int64), "log_score": np.where(some, sums, np.nan), "mean_log_score": np.where(some, sums / np.maximum(lengths, 1), np.nan)})

    sent = table.mapInPandas(send, TABLE)  # of all columns: with fewer, the exchange would be another
    totals = sent.groupBy("n", "bucket").applyInPandas(add, TOTALS)
    out = table.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInPandas(score, "id string, n_words long, log_score double, mean_log_score double")
    blank = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select(F.col("id").cast(docs.schema[id].dataType).alias(id), "n_words", blank("log_score"), blank("mean_log_score"))


def oracle(order: int = 3, alpha: float = 0.4, min_count: int = 2) -> str:
    """DuckDB SQL for backoff_scores over documents."""
    back = lambda k: f"lag(g1, {k}) over w" if k else "g1"
    grams = [f"""case when i >= {n} then {" || ' ' || ".join(back(k) for k in range(n - 1, -1, -1))} end as g{n}""" for n in range(2, order + 1)]
    case, left = "", []
    for n in range(order, 1, -1):
        case += f"when c{n} >= {min_count} then ln(c{n}) - ln(p{n - 1}) + (least({order}, i) - {n}) * ln({alpha}) "
        left.append(n)
    joins = " ".join(f"left join (select g{n} as k, count(*) as c from pos where g{n} is not null group by 1) t{n} on t{n}.k = pos.g{n}" for n in range(1, order + 1))
    cols = ", ".join(f"t{n}.c as c{n}" for n in range(1, order + 1))
    lags = ", ".join(f"lag(c{n}) over (partition by rid order by i) as p{n}" for n in range(1, order))
    return rf"""
with words as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
placed as (select rid, doc_id, unnest(w) as g1, generate_subscripts(w, 1) as i from words),
pos as (select rid, doc_id, i, {", ".join(["g1", *grams])} from placed window w as (partition by rid order by i)),
counted as (select pos.rid, pos.doc_id, pos.i, {cols} from pos {joins}),
lagged as (select *, {lags} from counted),
scored as (select rid, case {case} else ln(c1) - ln((select count(*) from pos)) + (least({order}, i) - 1) * ln({alpha}) end as s from lagged),
sums as (select rid, sum(s) as s, count(*) as n from scored group by rid)
select w.doc_id, coalesce(n, 0)::bigint as n_words, round(s, 4) as log_score, round(s / n, 6) as mean_log_score from words w left join sums using (rid)"""
