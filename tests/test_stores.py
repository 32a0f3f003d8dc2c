"""Stored tables, memos, connectors and retries: batches that come twice, runs that are cut off, sources that fail."""

import os
import random

import pytest
from pyspark.sql import functions as F

from catastra.sources.connectors import Connector, Connectors
from catastra.sources.memo import recognised
from catastra.sources.store import StoredTable, written
from catastra.streaming import jobs, retries


def files(path):
    return {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part")}


def test_batches_and_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    store = StoredTable(spark, path, ["k"], ["n"], parts=8)
    assert store.read() is None and store.audit() is None and store.counters(0) is None
    first = spark.createDataFrame([(k, 1, f"a{k}") for k in range(40)] + [(5, 2, "later"), (None, 1, "x")], "k int, n int, v string")
    assert store.upsert(first, 0) == {"inserted": 40, "updated": 0, "unchanged": 0, "written": 40}
    before = files(f"{path}/data")
    second = spark.createDataFrame([(5, 2, "later"), (7, 9, "new"), (7, 3, "old")], "k int, n int, v string")
    did = store.upsert(second, 1)
    assert {k: did[k] for k in ("inserted", "updated", "unchanged")} == {"inserted": 0, "updated": 1, "unchanged": 1} and did["written"] < 40
    after = files(f"{path}/data")
    assert 0 < len(set(before) & set(after)) < len(before) and all(before[f] == after[f] for f in set(before) & set(after))
    rows = sorted(tuple(r) for r in store.read().collect())
    assert rows == [(k, *{5: (2, "later"), 7: (9, "new")}.get(k, (1, f"a{k}"))) for k in range(40)]
    # the same batch again: nothing is written
    assert store.upsert(second, 1) == did and files(path) == files(path) and files(f"{path}/data") == after
    # a batch that was cut off before it was marked as done
    os.rename(f"{path}/done/batch=1", f"{path}/lost")
    again = store.upsert(second, 1)
    assert again["unchanged"] == 2 and sorted(tuple(r) for r in store.read().collect()) == rows
    assert sorted((r.key, r.action, r.batch) for r in store.audit().filter("batch = 1").collect()) == [("7", "updated", 1)]
    assert [tuple(r) for r in store.get(k=7).collect()] == [(7, 9, "new")] and store.get(k=999).count() == 0
    plan = store.get(k=7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan and "EqualTo(k,7)" in plan
    assert store.upsert(second.filter("false"), 2) == {"inserted": 0, "updated": 0, "unchanged": 0, "written": 0}
    assert sorted(tuple(r) for r in store.read().collect()) == rows


def test_audit_faults_stop_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    os.makedirs(path)
    open(f"{path}/audit", "w").close()  # a file where the folder should be
    store = StoredTable(spark, path, ["k"], ["k"], parts=2)
    assert store.upsert(spark.createDataFrame([(1, "a")], "k int, v string"), 0)["inserted"] == 1


def test_upserts_of_a_stream(spark, tmp_path):
    src, path = str(tmp_path / "src"), str(tmp_path / "t")
    r = random.Random(1)
    rows = [(r.randrange(30), i, r.random()) for i in range(200)]
    for lo in range(0, 200, 50):
        spark.createDataFrame(rows[lo : lo + 50], "k int, n int, v double").coalesce(1).write.mode("append").parquet(src)
    store = StoredTable(spark, path, ["k"], ["n"], parts=4)

    def twice(batch, number):
        store.upsert(batch, number)
        store.upsert(batch, number)

    stream = spark.readStream.schema("k int, n int, v double").option("maxFilesPerTrigger", 1).parquet(src)
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {r.k for r in store.read().collect()} == {k for k, _, _ in rows} and store.read().count() == len({k for k, _, _ in rows})
    assert store.counters(3) is not None and store.counters(4) is None


def test_counters_come_with_the_write(spark, tmp_path):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    did = written(df, str(tmp_path / "w"), n=F.count(F.lit(1)), zeros=F.count_if(F.col("g") == 0))
    assert did == {"n": 100, "zeros": 34} and spark.read.parquet(str(tmp_path / "w")).count() == 100


def test_memo_asks_for_new_keys_alone(spark, tmp_path):
    calls, path = str(tmp_path / "calls"), str(tmp_path / "memo")
    os.makedirs(calls)

    def say(urls):
        import uuid

        with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(urls))
        if any("fault" in u for u in urls):
            raise OSError("unreadable")
        return [None if "none" in u else "" if "blank" in u else u[-3:] for u in urls]

    def asked():
        out = sorted(x for f in os.listdir(calls) for x in open(f"{calls}/{f}").read().split("\n") if x)
        for f in os.listdir(calls):
            os.rename(f"{calls}/{f}", str(tmp_path / f))
        return out

    rows = [("a", "http://b/001"), ("a", "http://a/002"), (None, "http://c/003"), ("n", "http://none"), ("f", "http://fault"), ("x", "ftp://y"), ("e", "http://blank"), (None, None)]
    df = spark.createDataFrame(rows, "key string, url string")
    got = sorted((str(r.key), str(r.url), r.text) for r in recognised(spark, df, path, say, 1).collect())
    assert asked() == ["http://a/002", "http://blank", "http://c/003", "http://fault", "http://none"]
    assert got == sorted((str(k), str(u), {"a": "002", "e": ""}.get(k, "003" if u == "http://c/003" else None)) for k, u in rows)
    more = spark.createDataFrame([*rows, ("g", "http://d/004")], "key string, url string")
    assert {r.key: r.text for r in recognised(spark, more, path, say, 1).filter("key in ('g', 'a')").collect()} == {"g": "004", "a": "002"}
    assert asked() == ["http://d/004", "http://fault", "http://none"]


def test_a_source_that_fails_is_alone_in_it(spark):
    def good(part):
        return [(f"{part}{i}", "t", None) for i in range(3)]

    def late(part):
        yield ("1", "t", None)
        if part == "b":
            raise ValueError("broken off")

    def check():
        raise OSError("gone")

    all_ = Connectors(Connector("good", good, ["x", "y"]), Connector("late", late, ["a", "b"], check), Connector("empty", lambda part: [], []))
    items, failed = all_.search(spark)
    assert sorted((r.source, r.id) for r in items.collect()) == [*(("good", f"{p}{i}") for p in "xy" for i in range(3)), ("late", "1")]
    assert [(r.source, r.part, r.error) for r in failed.collect()] == [("late", "b", "ValueError: broken off")]
    assert {r.source: r.status for r in all_.statuses(spark).collect()} == {"good": "available", "late": "error", "empty": "available"}
    all_.register(Connector("late", good))
    assert all_.has("late") and not all_.has("other") and all_.get("other") is None
    items, failed = all_.search(spark, "late", "other")
    assert {r.source for r in items.collect()} == {"late"} and failed.count() == 0


def test_filters_on_the_source_reach_the_reader():
    from pyspark.sql.datasource import EqualTo, In

    from catastra.sources.connectors import Reader

    def reader():
        return Reader({n: Connector(n, lambda part: []) for n in "abc"})

    one = reader()
    assert list(one.pushFilters([EqualTo(("source",), "b"), EqualTo(("id",), "1")])) == [EqualTo(("id",), "1")] and [p.name for p in one.partitions()] == ["b"]
    two = reader()
    assert list(two.pushFilters([In(("source",), ("a", "c", "d"))])) == [] and [p.name for p in two.partitions()] == ["a", "c"]


@pytest.mark.parametrize("restart", [False, True])
def test_retries(spark, tmp_path, restart):
    """Attempts by time and outcome against a model, in several batches, some of them delivered twice."""
    r, src, policy = random.Random(5), str(tmp_path / "src"), retries.Policy(attempts=3, wait_ms=1_000)
    rows = [(r.choice("ab"), str(i), 10_000 * i + r.randrange(500)) for i in range(40)]
    for lo in range(0, 40, 8):
        part = rows[lo : lo + 8] + (rows[lo - 3 : lo] if lo else [])  # the last three come again
        spark.createDataFrame(part, "k string, job string, ms long").select("k", "job", F.timestamp_millis("ms").alias("at")).coalesce(1).write.mode("append").parquet(src)

    def work(job, attempt):
        if int(job) % 7 == 6:
            raise ValueError
        return attempt > int(job) % 4

    out = str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema("k string, job string, at timestamp").option("maxFilesPerTrigger", 1).parquet(src)
        q = retries.tried(stream, "k", "job", "at", work, policy).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(out)
        q.awaitTermination()

    if restart:
        run()
    spark.createDataFrame([("z", "999", 10**9)], "k string, job string, ms long").select("k", "job", F.timestamp_millis("ms").alias("at")).coalesce(1).write.mode("append").parquet(src)
    run()
    want = set()
    for k, job, ms in rows:
        at = ms
        for attempt in (1, 2, 3):
            ok = int(job) % 7 != 6 and attempt > int(job) % 4
            want.add((k, job, attempt, ok, ok or attempt == 3, at))
            if ok:
                break
            at += 1_000 << (attempt - 1)
    got = [tuple(x) for x in spark.read.parquet(out).filter("k <> 'z'").select("k", "job", "attempt", "ok", "last", "at_ms").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_finished_jobs_are_kept_by_age_and_number():
    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    t = retries.Tries(None, retries.Policy(completed_age_ms=100, completed_count=3, failed_age_ms=1_000, failed_count=2), "k")
    t.kept = Value()
    for i in range(6):
        t.remember(f"c{i}", True, 10 * i)
        t.remember(f"f{i}", False, 10 * i)
    assert [x[0] for x in t.kept.get()[0]] == ["c3", "c4", "f4", "c5", "f5"]
    t.remember("late", True, 145)
    assert [x[0] for x in t.kept.get()[0]] == ["f4", "c5", "f5", "late"]


def test_calls_to_the_store_do_not_grow_with_the_jobs():
    class Store:
        def __init__(self, value):
            self.value, self.calls = value, 0

        def exists(self):
            return bool(self.value)

        def get(self):
            self.calls += 1
            return self.value

        def update(self, v):
            self.calls, self.value = self.calls + 1, v

        def put(self, v):
            self.calls, self.value = self.calls + 1, v

        def appendList(self, v):
            self.calls, self.value = self.calls + 1, [*self.value, *v]

        def clear(self):
            self.calls, self.value = self.calls + 1, []

    class Times:
        registerTimer = staticmethod(lambda at: timers.append(at))

    def now(ms):
        return type("T", (), {"getCurrentWatermarkInMs": staticmethod(lambda: ms)})

    timers, n = [], 500
    t = retries.Tries(lambda job, attempt: int(job) % 2 == 0 or attempt > 1, retries.Policy(attempts=2, wait_ms=10), "k")
    t.kept, t.waiting, t.handle = Store(()), Store([]), Times()
    jobs_ = [type("R", (), {"job": str(i), "at_ms": i}) for i in range(n)]
    assert sum(x["last"] for x in t.handleInputRows(("a",), iter(jobs_), now(0))) == n // 2 and timers == [11]
    assert list(t.handleInputRows(("a",), iter(jobs_[1::2]), now(0))) == []
    done = [x for at in timers for x in t.handleExpiredTimer(("a",), now(10**6), None)]
    assert [x["job"] for x in done] == [str(i) for i in range(1, n, 2)] and all(x["last"] and x["ok"] for x in done)
    assert t.waiting.value == [] and t.kept.calls + t.waiting.calls < 20


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    """R-03, R-05: the same files through run_all's writer twice."""
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "s"))
    assert jobs.run_all(stream).count() == jobs.run_all(stream).count() == 10


def test_registry_outlives_a_source_that_fails_in_a_task(spark):
    from catastra.sources.readers import Registry, Source
    from catastra.sources.schemas import SOURCE_ITEM

    rows = lambda name, n: lambda s, p: s.createDataFrame([(name, str(i), "t", None) for i in range(n)], SOURCE_ITEM)
    r = Registry()
    r.register(Source("a", "available", rows("a", 3)))
    r.register(Source("late", "available", lambda s, p: rows("late", 5)(s, p).withColumn("raw", F.when(F.col("id") == "3", F.raise_error(F.lit("broken"))).otherwise(F.col("raw")))))
    r.register(Source("plan", "available", lambda s, p: s.table("there is none")))
    r.register(Source("b", "available", rows("b", 2)))
    assert sorted(x.source for x in r.search(spark, {}).collect()) == ["a", "a", "a", "b", "b"]
