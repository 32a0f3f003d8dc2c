"""Task and case state machines (T-01, T-03, T-05 to T-12, T-15; lifecycle.py folds their histories), writes on them (K-13, D-07), progress (A-06), run numbers (A-07, W-01), transitions (W-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catastra.operators.resolve import earliest

# From each state, the states that it may become.
TASK_EDGES = {
    "pending": ["running", "completed", "failed", "requires_manual_action", "blocked", "unavailable", "skipped"],
    "running": ["completed", "failed", "requires_manual_action", "blocked", "unavailable", "skipped"],
    "requires_manual_action": ["running", "pending", "completed"],
    "blocked": ["running", "pending", "unavailable"],
    "failed": ["running", "pending"],
    "unavailable": ["running", "pending"],
    "completed": [],
    "skipped": [],
}
CASE_EDGES = {
    "pending": ["queued", "running", "completed", "partial", "failed"],
    "created": ["queued", "running", "completed", "partial", "failed"],
    "queued": ["running", "completed", "partial", "failed"],
    "running": ["completed", "partial", "failed", "cancelled"],
    "completed": [],
    "partial": [],
    "failed": [],
    "cancelled": [],
}
TASK_TERMINAL = ["completed", "skipped"]
TASK_SETTLED = ["completed", "failed", "skipped", "unavailable", "blocked", "requires_manual_action"]
TASK_DONE = ["completed", "failed", "skipped", "unavailable", "blocked"]
TASK_RETRYABLE = ["failed", "blocked", "unavailable", "requires_manual_action"]
TASK_WARNING = ["requires_manual_action", "blocked", "unavailable"]
CASE_TERMINAL = ["completed", "partial", "failed", "cancelled"]
DEFAULT_TASKS = ["identity", "geolocation", "registry", "bgr", "urbanism", "judicial", "market", "risk"]
# The source that a task of each kind asks.
TASK_SOURCES = {"registry": "sunarp", "bgr": "sunarp_bgr", "urbanism": "impla", "judicial": "remaju"}


def edges(spark: SparkSession, graph: dict[str, list[str]]) -> DataFrame:
    """T-01, T-03: (source, target); a few dozen rows."""
    return spark.createDataFrame([(a, b) for a, bs in graph.items() for b in bs], "source string, target string")


def allowed(source: Column, target: Column, graph: dict[str, list[str]]) -> Column:
    """Whether the graph has the edge; a state may stay as it is."""
    out = F.lit(False)
    for a, bs in graph.items():
        if bs:
            out = out | ((source == a) & target.isin(*bs))
    return F.coalesce(out | (source == target), F.lit(False))


def transitions(history: DataFrame, key: str, order: list[str], status: str, graph: dict[str, list[str]]) -> DataFrame:
    """W-05: each step of a status history with previous and valid (the first step of a key is)."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    return history.withColumn("previous", before).withColumn("valid", F.col("previous").isNull() | allowed(F.col("previous"), F.col(status), graph))


def progress(tasks: DataFrame, case: str, status: str) -> DataFrame:
    """A-06: counts of each case and its status: open, or when all tasks are settled partial (any failed) or completed."""
    c = F.col(status)
    out = tasks.groupBy(case).agg(F.count(F.lit(1)).alias("total"), F.count_if(c.isin(*TASK_SETTLED)).alias("settled"), F.count_if(c == "failed").alias("failed"), F.count_if(c.isin(*TASK_WARNING)).alias("warnings"))
    return out.withColumn("case_status", F.when(F.col("settled") < F.col("total"), "running").when(F.col("failed") > 0, "partial").otherwise("completed"))


def next_run(cases: DataFrame, owner: str, run: str) -> DataFrame:
    """A-07."""
    return cases.groupBy(owner).agg((F.coalesce(F.max(run), F.lit(0)) + 1).alias("next_run"))


def number_runs(cases: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """W-01."""
    return cases.withColumn("run_number", F.row_number().over(Window.partitionBy(owner).orderBy(*order)))


def new_case_tasks(cases: DataFrame, case: str, kinds: list[str] = DEFAULT_TASKS) -> DataFrame:
    """T-05: a pending task of each kind for each case; identity first in priority."""
    return cases.select(case, F.explode(F.array(*[F.lit(k) for k in kinds])).alias("task_type")).withColumn("status", F.lit("pending")).withColumn("priority", F.when(F.col("task_type") == "identity", "high").otherwise("medium"))


def create_cases(properties: DataFrame, cases: DataFrame, requests: DataFrame) -> DataFrame:
    """T-05, A-07: of requests(property_id, ordinal, created_by) those whose property is in the table, as new cases with their run numbers, which go on from those of cases(property_id, run_number).

    A missing creator is the system. new_case_tasks makes their tasks.
    """
    real = requests.join(properties.select(F.col("id").alias("property_id")), "property_id", "left_semi")
    last = cases.groupBy("property_id").agg(F.max("run_number").alias("_last"))
    nth = F.row_number().over(Window.partitionBy("property_id").orderBy("ordinal"))
    out = real.withColumn("_nth", nth).join(last, "property_id", "left")
    return out.select("property_id", "ordinal", (F.coalesce("_last", F.lit(0)) + F.col("_nth")).cast("long").alias("run_number"), F.lit("created").alias("status"), F.lit(len(DEFAULT_TASKS)).alias("total_task_count"), F.coalesce("created_by", F.lit("system")).alias("created_by"))


def connector_outcome(status: Column) -> Column:
    """T-11: what becomes of a task, from its source's status; the first that holds."""
    return F.when(status.isin("unavailable", "maintenance", "rate_limited"), "unavailable").when(status.isin("requires_manual_action", "requires_auth"), "requires_manual_action").when(status == "error", "failed").otherwise("completed")


def geolocation_outcome(verified: Column, query: Column, hit: Column) -> Column:
    """T-09."""
    return F.when(verified, "skipped").when(F.coalesce(query, F.lit("")) == "", "requires_manual_action").when(~hit, "failed").otherwise("completed")


def auction_outcome(locality: Column, entries: Column, certain: Column) -> Column:
    """T-10: no place to look in is a person's; no auctions there is done, and so is one that is certainly the property's; else a person looks."""
    return F.when(F.coalesce(locality, F.lit("")) == "", "requires_manual_action").when((F.coalesce(entries, F.lit(0)) == 0) | F.coalesce(certain, F.lit(False)), "completed").otherwise("requires_manual_action")


def settle_manual(actions: DataFrame, tasks: DataFrame, task: str, outcome: str) -> DataFrame:
    """T-12: a task that waits for a person is completed if an action of its is; a cancelled action leaves it waiting."""
    done = actions.groupBy(task).agg(F.bool_or(F.col(outcome) == "completed").alias("_done"))
    settled = (F.col("status") == "requires_manual_action") & F.coalesce("_done", F.lit(False))
    return tasks.join(done, task, "left").withColumn("status", F.when(settled, "completed").otherwise(F.col("status"))).drop("_done")


def dispatch(kind: Column) -> Column:
    """T-07: how a task of this kind is done; kinds that nothing does are unavailable."""
    return F.when(kind.isin("identity", "geolocation"), kind).when(kind.isin("registry", "bgr", "urbanism"), "connector").when(kind == "judicial", "auction").otherwise("unavailable")


def task_source(kind: Column) -> Column:
    """J-15: the source of a kind of task; null if it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in TASK_SOURCES.items() for x in pair]), kind)


def compare_and_set(tasks: DataFrame, changes: DataFrame, key: str, status: str, graph: dict[str, list[str]]) -> DataFrame:
    """K-13: tasks with `applied`: null without a change, false where the state is not the expected one or may not become the target.

    changes: (key, ordinal, expected, target). Of several for a key the least ordinal counts, as the state that the
    others expect is gone; lifecycle.fold replays whole histories.
    """
    first = changes.groupBy(key).agg(F.min(F.struct("ordinal", "expected", "target")).alias("_c"))
    c = F.col("_c")
    fits = F.coalesce((F.col(status) == c["expected"]) & allowed(c["expected"], c["target"], graph), F.lit(False))
    out = tasks.join(first, key, "left").withColumn("applied", F.when(c.isNotNull(), fits))
    return out.withColumn(status, F.when(F.col("applied"), c["target"]).otherwise(F.col(status))).drop("_c")


def request_actions(actions: DataFrame, requests: DataFrame, task: str, ordinal: str) -> DataFrame:
    """D-07: actions and those that the requests add, told by `created`: one for each task without a requested one.

    actions: (task, action_kind, status, ordinal, ...); requests: (task, action_kind, ordinal, ...). A missing kind is a
    user's action.
    """
    live = actions.filter("status = 'requested'").select(task)
    new = earliest(requests, [task], [F.col(ordinal)]).join(live, task, "left_anti")
    new = new.withColumns({"action_kind": F.coalesce("action_kind", F.lit("user_action")), "status": F.lit("requested"), "created": F.lit(True)})
    return actions.withColumn("created", F.lit(False)).unionByName(new, allowMissingColumns=True)


def mark_geolocation(tasks: DataFrame, marks: DataFrame, owner: str) -> DataFrame:
    """T-15: the geolocation tasks of each marked property that are pending or running take the mark; settled ones stay.

    marks: (owner, ordinal, mark, error); of several the least ordinal counts. `moved` tells the tasks, `error` says why
    one that is not completed moved, `needs_action` which ones wait for a person now.
    """
    m = marks.groupBy(owner).agg(F.min(F.struct("ordinal", "mark", "error")).alias("_m"))
    moved = F.coalesce((F.col("task_type") == "geolocation") & F.col("status").isin("pending", "running") & F.col("_m").isNotNull(), F.lit(False))
    out = tasks.join(m, owner, "left").withColumn("moved", moved)
    done = F.col("_m.mark") == "completed"
    return out.withColumns({"status": F.when(F.col("moved"), F.col("_m.mark")).otherwise(F.col("status")), "error": F.when(F.col("moved") & ~done, F.col("_m.error")), "needs_action": F.col("moved") & F.coalesce(F.col("_m.mark") == "requires_manual_action", F.lit(False))}).drop("_m")
