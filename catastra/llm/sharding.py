"""Operator 8: contiguous shards of near-equal bytes by a global prefix sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_names, running_totals, without


def shard_by_bytes(docs: DataFrame, shards: int = 8, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with size (UTF-8 bytes of the text and one more), shard (0 to shards - 1) and slot (0, 1, ... in each shard).

    Rows stand in order of id (nulls first), rows of one id by a hash of their texts (no text is a sort key: the driver
    samples those). The bytes before a row, over the whole table, say which of the
    equal stretches of the total it begins in; so shards are contiguous, and differ from an equal share by less than
    the largest row. Null and empty texts have size 1; rows that are alike in id and text may stand either way round.
    An empty table gives an empty result; a shard may stay empty where rows are larger than a share. Columns of docs
    named size, shard or slot are replaced.
    """
    plain, names, (id, text) = plain_names(without(docs, ["size", "shard", "slot"]), id, text)
    columns = plain.columns
    sized = plain.select(*columns, (F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))) + 1).cast("long").alias("size"), F.xxhash64(text).alias("_tie"))
    placed, total, _ = running_totals(sized, [id, "_tie"], "size")
    shard = F.least(F.lit(shards - 1), F.floor(F.col("_before").cast("decimal(38,0)") * shards / F.lit(max(total, 1)))).cast("int")
    placed = placed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_start"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(*columns, "size", "shard", (F.col("_rank") - F.col("_start")).alias("slot")).toDF(*names, "size", "shard", "slot")


#: CRC-32 (polynomial 0xEDB88320) of the sixteen half-bytes.
def half_bytes() -> list[int]:
    out = []
    for k in range(16):
        for _ in range(4):
            k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
        out.append(k)
    return out


def oracle(shards: int = 8) -> str:
    """DuckDB SQL for the op8 query over documents."""
    table = "[" + ", ".join(f"{x}::bigint" for x in half_bytes()) + "]"
    step = lambda c: f"xor({c} >> 4, list_extract({table}, ({c} & 15) + 1))"
    return f"""
with sized as (select doc_id, coalesce(text, '')::varchar as text, strlen(coalesce(text, '')) + 1 as size from documents),
placed as (select *, sum(size) over (order by doc_id nulls first, text rows between unbounded preceding and current row) - size as before, sum(size) over () as total from sized),
cut as (select *, least({shards - 1}, (before * {shards}) // total)::int as shard from placed),
bytes as (select *, hex(text) as h from cut),
crc as (select *, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, size), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::bigint)), lambda a, x: {step(step("xor(a, x)"))}) as c from bytes)
select doc_id, size::bigint as size, xor(c, 4294967295)::bigint as text_crc32, 'bytes' as law, shard, (row_number() over (partition by shard order by before) - 1)::bigint as slot, null::int as grown_shard from crc"""
