"""Folded histories against a model that takes one step after the other."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catastra.operators import lifecycle

DONE = {"completed", "failed", "skipped", "unavailable", "blocked"}
RETRYABLE = {"failed", "blocked", "unavailable", "requires_manual_action"}
TASK = {
    "pending": "running completed failed requires_manual_action blocked unavailable skipped", "running": "completed failed requires_manual_action blocked unavailable skipped",
    "requires_manual_action": "running pending completed", "blocked": "running pending unavailable", "failed": "running pending", "unavailable": "running pending", "completed": "", "skipped": "",
}
CASE = {"pending": "queued running completed partial failed", "created": "queued running completed partial failed", "queued": "running completed partial failed", "running": "completed partial failed cancelled", "completed": "", "partial": "", "failed": "", "cancelled": ""}


def model(steps, graph, first):
    """steps: (status, at, error) in order. The row of the task or case after them."""
    task = graph is TASK
    now, retries, rejected, started, ended, error, manual = first, 0, 0, None, None, None, False
    for new, at, err in steps:
        if new == now:
            continue
        if new not in graph[now].split():
            rejected += 1
            continue
        if new == "running":
            started = at
        elif task and new not in ("pending",) and started is None:
            started = at
        if new in (DONE if task else {"completed", "partial", "failed", "cancelled"}):
            ended = at
        if err is not None:
            error = err
        if task and new == "completed":
            error, manual = err, False
        if task and new == "requires_manual_action":
            manual = True
        if task and now in RETRYABLE and new in ("pending", "running"):
            retries, ended = retries + 1, None
        now = new
    return (now, retries, rejected, started, ended, error, manual)


@pytest.mark.parametrize("long", [10_000, 7])
@pytest.mark.parametrize(("life", "graph", "first"), [(lifecycle.TASK, TASK, "pending"), (lifecycle.CASE, CASE, "created")])
def test_histories(spark, monkeypatch, long, life, graph, first):
    monkeypatch.setattr(lifecycle, "LONG", long)
    monkeypatch.setattr(lifecycle, "FAN", 3)
    r, rows, want, zero = random.Random(long), [], {}, datetime(2024, 1, 1)
    for k in range(60):
        steps = [(r.choice([*graph, *graph, "no state"] if r.random() < 0.5 else [s for s in graph if graph[s]]), zero + timedelta(seconds=r.randrange(10**6)), r.choice([None, None, f"e{i}"])) for i in range(r.choice([1, 2, 9, 40, 200]))]
        rows += [(k, i * 3, *s) for i, s in enumerate(steps)]
        want[k] = model(steps, graph, first)
    rows.append((None, 1, "running", zero, None))
    df = spark.createDataFrame(r.sample(rows, len(rows)), "k int, n int, status string, at timestamp, error string").repartition(5)
    out = lifecycle.fold(df, life, "k", "n", "status", "at", "error")
    # times by their microseconds, whatever the zone of this process
    us = lambda t: None if t is None else round((t - zero).total_seconds() * 1e6)
    base = F.unix_micros(F.lit(zero).cast("timestamp"))
    got = {x.k: (x.status, x.retries, x.rejected, x.s, x.e, x.error, x.requires_manual_action) for x in out.withColumn("s", F.unix_micros("started_at") - base).withColumn("e", F.unix_micros("completed_at") - base).collect()}
    assert got == {k: (*w[:3], us(w[3]), us(w[4]), *w[5:]) for k, w in want.items()}


def test_a_task_that_settles_without_running_has_a_start(spark):
    df = spark.sql("select 1 as k, 1 as n, 'completed' as status, timestamp'2024-01-01 00:00:05' as at")
    r = lifecycle.fold(df, lifecycle.TASK, "k", "n", "status", "at").first()
    assert (r.status, r.started_at, r.completed_at) == ("completed", r.completed_at, r.started_at) and r.started_at is not None


def test_no_history(spark):
    df = spark.createDataFrame([], "k int, n int, status string, at timestamp")
    assert lifecycle.fold(df, lifecycle.TASK, "k", "n", "status", "at").collect() == []
