from catastra.plans import bindings
from catastra.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_states_agree_with_a_fold(spark):
    graph = {"signup": ["view", "click"], "view": ["click", "error", "signup"], "click": ["purchase", "view", "error"], "purchase": ["view"], "error": ["view"]}
    want = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").collect():
        now, rejected = want.get(r.user_id, ("signup", 0))
        if r.event_type != now:
            now, rejected = (r.event_type, rejected) if r.event_type in graph[now] else (now, rejected + 1)
        want[r.user_id] = (now, rejected)
    got = {r.user_id: (r.status, r.rejected) for r in bindings.QUERIES["stream_task_states"](spark, SF).collect()}
    assert got == want


def test_cycles(spark):
    out = jobs.run_all(jobs.cycle_totals(jobs.event_stream(spark, SF), "ts", "1 hour", "60 minutes", "event_type"))
    assert 0 < out.groupBy().sum("n").first()[0] <= 1000  # the last cycles wait for their watermark
