"""Operator 6: token counts by a separator scan over flat token files without an index."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, running_totals, staged
from .flat import opened

BLOCK_TOKENS = 1 << 18
BLOCKS = "file long, block long, first long, tokens binary"


@lru_cache(maxsize=2)
def encoding_of(vocabulary: str, pattern: str):
    """The tokenizer, built once in each worker, which many tasks share."""
    import base64

    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_flat(docs: DataFrame, vocabulary: str, pattern: str, end_of_document: int, id: str = "doc_id", text: str = "text", dtype: str = "uint16", block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Texts as flat token files cut into blocks that heed no document, and (file, ordinal, id) of the documents in them.

    vocabulary: a file of base64 byte pairs and ranks, on every machine; pattern: the words that pairs are merged in.
    A file is what one task writes. Null and empty texts become a separator alone. Ids are of any type.
    """
    kind = docs.schema[id].dataType.simpleString()

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoding = encoding_of(vocabulary, pattern)
        file, block, first, ordinal = TaskContext.get().partitionId(), 0, 0, 0
        open_, n = [], 0
        schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("tokens", pa.binary())])
        kinds = None

        def out(tokens, ids):
            return pa.RecordBatch.from_pylist([{"file": file, "block": block, "first": first, "tokens": tokens, "ids": ids}], schema=schema.append(pa.field("ids", pa.list_(kinds))))

        for b in batches:
            ids, kinds = [], b.schema.field(0).type
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                tokens = np.array([*encoding.encode_ordinary(t.as_py() or ""), end_of_document], dtype)
                open_.append(tokens)
                n += len(tokens)
                ids.append(key)
                ordinal += 1
                if n >= block_tokens:
                    flat = np.concatenate(open_)
                    for lo in range(0, len(flat) - block_tokens + 1, block_tokens):
                        yield out(flat[lo : lo + block_tokens].tobytes(), ids)
                        block, ids = block + 1, []
                        first = ordinal
                    open_ = [flat[len(flat) // block_tokens * block_tokens :]]
                    n = len(open_[0])
            if ids:
                yield out(None, ids)
                first = ordinal
        if n:
            yield out(np.concatenate(open_).tobytes(), [])

    rows = staged(docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(encode, f"{BLOCKS}, ids array<{kind}>"))
    names = rows.filter(F.size("ids") > 0).select("file", F.posexplode("ids").alias("at", "id"), "first").select("file", (F.col("first") + F.col("at")).alias("ordinal"), "id")
    return rows.filter("tokens is not null").select("file", "block", "tokens"), names


#: Spark hands over no larger file in one value.
LARGE_FILE = 2_000_000_000


def read_flat(spark: SparkSession, path: str, dtype: str = "uint16", block_tokens: int = BLOCK_TOKENS, large: int = LARGE_FILE) -> DataFrame:
    """Blocks (file, block, tokens) of the raw token files under path.

    Spark reads files of up to `large` bytes. Of larger ones each task reads a stretch itself, through pyarrow's file systems.
    """
    width = np.dtype(dtype).itemsize * block_tokens
    files = spark.read.format("binaryFile").load(path)

    def cut(frames):
        for pdf in frames:
            for name, data in zip(pdf.file, pdf.content, strict=True):
                for k in range(0, len(data), width):
                    yield pd.DataFrame({"file": [name], "block": [k // width], "tokens": [data[k : k + width]]})

    def part(frames):
        for pdf in frames:
            for name, k, size in zip(pdf.file, pdf.block, pdf.length, strict=True):
                with opened(name) as source:
                    source.seek(k * width)
                    yield pd.DataFrame({"file": [name], "block": [k], "tokens": [source.read(min(width, size - k * width))]})

    small = files.filter(F.col("length") <= large).select(F.col("path").alias("file"), "content").mapInPandas(cut, "file string, block long, tokens binary")
    others = files.select(F.col("path").alias("file"), "length").filter(F.col("length") > large)
    rows = others.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / width) - 1)).alias("block"))
    return small.unionByName(rows.repartition(partitions(spark), "file", "block").mapInPandas(part, "file string, block long, tokens binary"))


def separator_scan(blocks: DataFrame, end_of_document: int, dtype: str = "uint16") -> DataFrame:
    """(file, ordinal, start, n_tokens) of each document in blocks(file, block, tokens); the separator is not counted.

    Each block is searched by itself. Running totals over all blocks in order (a prefix scan: sums inside partitions,
    then of partitions) tell how many tokens and separators stand before it, and the last separator before it where
    its first document began, so a document may reach over any number of blocks. Tokens after a file's last separator
    are a document too. Blocks of no tokens add nothing; a file without tokens has no documents.
    """
    kind = blocks.schema["file"].dataType.simpleString()

    def search(frames):
        for pdf in frames:
            found = [np.flatnonzero(np.frombuffer(t or b"", dtype) == end_of_document) for t in pdf.tokens]
            sizes = [len(t or b"") // np.dtype(dtype).itemsize for t in pdf.tokens]
            yield pd.DataFrame({"file": pdf.file, "block": pdf.block, "size": sizes, "many": [len(x) for x in found], "at": [x.astype(np.int64) for x in found]})

    found = blocks.select("file", "block", "tokens").mapInPandas(search, f"file {kind}, block long, size long, many long, at array<long>")
    scanned, _, _ = running_totals(found.filter("size > 0"), ["file", "block"], "size")
    counted, _, _ = running_totals(scanned.withColumnRenamed("_before", "before").drop("_rank"), ["file", "block"], "many")
    # per file: the positions and separators before it
    per_file = counted.groupBy("file").agg(F.min("before").alias("base"), F.min("_before").alias("earlier"), F.max(F.col("before") + F.col("size")).alias("end"), F.max(F.col("_before") + F.col("many")).alias("last"))
    ends = counted.select("file", "before", "_before", F.posexplode("at").alias("k", "p")).select("file", (F.col("_before") + F.col("k")).alias("nth"), (F.col("before") + F.col("p")).alias("stop"))
    tails = per_file.select("file", F.col("last").alias("nth"), F.col("end").alias("stop"), F.lit(True).alias("tail"))
    stops = staged(ends.withColumn("tail", F.lit(False)).unionByName(tails))
    # document nth begins after separator nth - 1
    starts = stops.filter("not tail").select("file", (F.col("nth") + 1).alias("nth"), (F.col("stop") + 1).alias("start"))
    out = stops.join(starts, ["file", "nth"], "left").join(per_file.select("file", "base", "earlier"), "file")
    out = out.withColumn("start", F.coalesce("start", "base")).filter("not tail or stop > start")
    return out.select("file", (F.col("nth") - F.col("earlier")).alias("ordinal"), (F.col("start") - F.col("base")).alias("start"), (F.col("stop") - F.col("start")).alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, end_of_document: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens) of each row of docs: written as flat files, then counted by separator_scan alone.

    Repeated rows are counted each; null and empty texts have 0 tokens; other columns do not matter. Ids are of any type.
    """
    blocks, names = write_flat(docs, vocabulary, pattern, end_of_document, id, text)
    counts = separator_scan(blocks, end_of_document)
    return names.join(counts, ["file", "ordinal"]).select(F.col("id").alias(id), "n_tokens")
