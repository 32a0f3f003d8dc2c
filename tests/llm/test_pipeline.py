"""The pipeline against each stage done by other means: SQL, or plain Python that shares no code with it."""

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F

from catastra.llm import mixing, quality, sharding
from tests.llm.helpers import CLASHING, COLUMNS, edge_rows
from tests.llm.test_rows import plain_leaks
from tests.llm.test_similar import plain_kept

SF = "/root/testdata/sf0.001"


def by_sql(documents, sql):
    """Rows of the SQL over a table of documents."""
    db = duckdb.connect()
    db.register("given", documents)
    db.execute("create table documents as select * from given")
    return db.execute(sql).df()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    judged = by_sql(docs.toPandas(), quality.oracle())
    kept = set(judged[judged.kept].doc_id)
    first = corpus_pipeline.quality(spark, docs, SF)
    assert {r.doc_id for r in first.collect()} == kept and first.columns == docs.columns

    second = corpus_pipeline.near_duplicates(spark, first, SF)
    left = {r.doc_id for r in second.collect()}
    assert left == plain_kept({d: rows[d].text for d in kept}) and second.columns == docs.columns

    third = corpus_pipeline.decontamination(spark, second, SF)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    clean = left - {d for d, _ in plain_leaks({d: rows[d].text for d in left}, items)}
    assert {r.doc_id for r in third.collect()} == clean and third.columns == docs.columns

    fourth = corpus_pipeline.mixture(spark, third, SF)
    mixed = fourth.toPandas()
    want = by_sql(third.toPandas(), mixing.oracle())
    assert sorted(mixed.doc_id) == sorted(want.doc_id) and fourth.columns == docs.columns
    assert list(mixed.doc_id) == list(want.sort_values("shuffle_key").doc_id)

    last = corpus_pipeline.shards(spark, fourth, SF)
    rows = sorted((r.doc_id, r["size"], r.shard, r.slot) for r in last.collect())
    placed = by_sql(mixed, sharding.oracle())
    assert rows == sorted(placed[["doc_id", "size", "shard", "slot"]].itertuples(index=False, name=None))


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "size", "shard", "slot"} <= set(out.columns) and out.agg(F.countDistinct("shard")).first()[0] == 8


def test_edges_of_the_stages(spark):
    """Empty tables, nulls and columns that clash with names the stages use."""
    docs = spark.createDataFrame(edge_rows(), COLUMNS)
    for c in [*CLASHING, "_leaks", "_sim", "_node", "c0"]:
        if c.lower() not in {x.lower() for x in docs.columns} | {"copy", "shuffle_key"}:
            docs = docs.withColumn(c, F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), SF).collect() == []
        out = stage(spark, docs, SF)
        if name in ("quality", "near_duplicates", "decontamination"):
            assert out.columns == docs.columns and all(r["_leaks"] == "mine" for r in out.collect())
        else:
            assert out.count() > 0
