"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from catastra.llm import decontaminate, lm, mixing, pii, quality, quotes, secrets, sharding, simhash, tokens
from catastra.llm.queries import END_OF_DOCUMENT, PATTERN, VOCABULARY, tokenizer_there
from tests.llm.helpers import edge_rows, edges, empty

BENCHMARK = [(1, None), (2, ""), (3, "few words"), (4, "a benchmark item of quite enough words to be told apart")]


def benchmark(spark):
    return spark.createDataFrame(BENCHMARK, "item_id long, text string")


EVERY = {
    "quality": lambda d: quality.repetition_quality(d),
    "keep_quality": lambda d: quality.keep_quality(d),
    "secrets": lambda d: secrets.scan_secrets(d),
    "mixing": lambda d: mixing.mix_sources(d),
    "lm": lambda d: lm.backoff_scores(d),
    "simhash": lambda d: simhash.simhash_groups(d),
    "keep_one": lambda d: simhash.keep_one_of_each(d),
    "leaks": lambda d: decontaminate.leaks(d, benchmark(d.sparkSession)),
    "leaks_by_join": lambda d: decontaminate.leaks_by_join(d, benchmark(d.sparkSession), decontaminate.TilingRules()),
    "sharding": lambda d: sharding.shard_by_bytes(d),
    "pii": lambda d: pii.sanitise(d),
}
if tokenizer_there():
    EVERY["tokens"] = lambda d: tokens.token_counts(d, VOCABULARY, PATTERN, END_OF_DOCUMENT)
ALL_ROWS = {"quality", "secrets", "lm", "simhash", "leaks", "leaks_by_join", "sharding", "pii", "tokens"}


@pytest.mark.parametrize("name", sorted(EVERY))
def test_edges(spark, name):
    rows = EVERY[name](edges(spark)).collect()
    if name in ALL_ROWS:
        assert len(rows) == len(edge_rows())


@pytest.mark.parametrize("name", sorted(EVERY))
def test_empty_table(spark, name):
    assert EVERY[name](empty(spark)).collect() == []


def test_defined_results(spark):
    by = {r.doc_id: r for r in quality.repetition_quality(edges(spark)).collect() if r.doc_id}
    assert (by[1].n_words, by[2].n_words, by[3].n_words, by[9].n_words) == (0, 0, 0, 1)
    assert not any(by[k].kept for k in (1, 2, 3, 4, 9)) and by[5].kept and by[7].kept
    scores = {r.doc_id: r for r in lm.backoff_scores(edges(spark)).collect() if r.doc_id}
    assert (scores[1].n_words, scores[1].log_score, scores[2].mean_log_score) == (0, None, None)
    size = {r.doc_id: r["size"] for r in sharding.shard_by_bytes(edges(spark)).collect()}
    assert (size[1], size[2], size[9]) == (1, 1, 50_001)
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(edges(spark)).collect() if r.doc_id) == [1, 4, 5, 7, 8, 9]


def test_conversations_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "user", ""), (1, 1, "user", "> quoted\nreply"), (None, 2, "user", "> x\ny"), (2, None, None, "text"), (3, 0, "user", "quoted")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("mine"))
    out = quotes.link_quotations(df).collect()
    assert len(out) == len(rows) and all(r.depth == 0 for r in out)
    assert quotes.link_quotations(df.filter("false")).collect() == []
