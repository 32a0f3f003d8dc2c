"""The operators' queries and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, flat, lm, mixing, pii, quality, quotes, search, secrets, sharding, simhash, tokens, variants
from .common import read, scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: How the public byte-level vocabulary parts a text before pairs are merged (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_DOCUMENT = 50256


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_quality(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col("secrets")
    return found.select("doc_id", *[counted(s, k) for k in secrets.BASE], F.sha2(joined(F.filter(s, lambda x: x["kind"].isin(*secrets.BASE))), 256).alias("base_sha256"), joined(s).alias("spans"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.backoff_scores(read(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY, PATTERN, END_OF_DOCUMENT)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each leak: the document and the item."""
    found = decontaminate.leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    leak = found.select("doc_id", F.explode("leaks").alias("l"))
    return leak.select("doc_id", F.col("l.item").cast("long").alias("item_id"), F.col("l.words").alias("tiled_words"), F.col("l.of").alias("item_words"), F.lit(True).alias("contaminated"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(read(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return out.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(read(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col("pii")
    return found.select("doc_id", *[counted(s, k) for k in pii.KINDS], F.sha2(joined(F.filter(s, lambda x: x["kind"].isin(*pii.KINDS))), 256).alias("base_sha256"), joined(s).alias("spans"), F.sha2("sanitised", 256).alias("sanitised_sha256"), F.length("sanitised").cast("long").alias("sanitised_chars"))


def op10_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotations(read(spark, sf_dir, "conversations")).drop("text")


def op11_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.noisy_words(read(spark, sf_dir, "documents")))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = read(spark, sf_dir, "documents"), scratch(spark, "tokens")
    flat.write_tokens(docs, path, TOKENIZER, 0)
    return flat.read_tokens(spark, path, dict(docs.dtypes)["doc_id"]).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_quality, op2_secrets, op3_mixing, op4_lm_scores, op5_simhash, op6_token_counts, op7_decontamination, op8_sharding, op9_pii, op10_quotations, op11_maxscore_search, op12_spelling_variants, op13_token_files)}
ORACLE = {"op1_quality": quality.oracle(), "op3_mixing": mixing.oracle(), "op4_lm_scores": lm.oracle(), "op8_sharding": sharding.oracle(), "op11_maxscore_search": search.oracle(), "op12_spelling_variants": variants.oracle()}


def tokenizer_there() -> bool:
    return Path(VOCABULARY).exists()
