"""Histories of tasks and cases as composed automata (T-02, T-04).

What a stretch of steps does is a map: from each state that it may begin in, the state that it ends in and what it does to
times, retries, error and flags. Maps compose associatively, so a history of any length folds by parts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catastra.operators import research
from catastra.sources.shared import staged

#: A history with more steps is cut into parts of about so many; so many parts are composed at a time.
LONG = 10_000
FAN = 64


@dataclass(frozen=True)
class Lifecycle:
    """A graph of states, the state that all begin in, and what entering a state does."""

    graph: dict[str, list[str]]
    first: str
    #: Sets started_at, each time.
    runs: str = "running"
    #: Set started_at if it is not set.
    settled: list[str] = field(default_factory=list)
    #: Set completed_at.
    done: list[str] = field(default_factory=list)
    #: A step from the former to the latter is a retry: it counts, and clears completed_at.
    retryable: list[str] = field(default_factory=list)
    again: list[str] = field(default_factory=list)
    #: Raises the flag for a person; the other one lowers it and clears the error.
    waits: str = ""
    clears: str = ""

    @property
    def states(self) -> list[str]:
        return list(self.graph)

    def number(self, status: Column) -> Column:
        """1 and on; 0 for what is no state."""
        return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in self.states]), status), F.lit(0)).cast("int")

    def among(self, state: Column, names) -> Column:
        return state.isin(*[self.states.index(s) + 1 for s in names if s]) if any(names) else F.lit(False)


TASK = Lifecycle(research.TASK_EDGES, "pending", settled=research.TASK_SETTLED, done=research.TASK_DONE, retryable=research.TASK_RETRYABLE, again=["pending", "running"], waits="requires_manual_action", clears="completed")
CASE = Lifecycle(research.CASE_EDGES, "created", done=research.CASE_TERMINAL)

EFFECT = "struct<state:int,retries:bigint,rejected:bigint,starts:int,started:timestamp,ends:boolean,ended:timestamp,fails:boolean,error:string,flags:boolean,manual:boolean>"
#: What a stretch does to started_at: nothing, sets it if there is none, sets it.
KEEPS, FILLS, SETS = 0, 1, 2


def nothing(state: Column) -> Column:
    none, no = F.lit(None), F.lit(False)
    return F.struct(state, F.lit(0), F.lit(0), F.lit(KEEPS), none, no, none, no, none, no, none).cast(EFFECT)


def effect(state, retries, rejected, starts, started, ends, ended, fails, error, flags, manual) -> Column:
    return F.struct(state, retries, rejected, starts, started, ends, ended, fails, error, flags, manual).cast(EFFECT)


def step(life: Lifecycle, a: Column, s: Column) -> Column:
    """a after one step s(new, at, error) more; the same state again is no step, a step that the graph lacks is rejected."""
    was, new = a["state"], s["new"]
    edges = F.lit("".join("1" if y in life.graph[x] else "0" for x in life.states for y in life.states))
    ok = (new > 0) & (edges.substr((was - 1) * len(life.states) + new, F.lit(1)) == "1")
    retry = ok & life.among(was, life.retryable) & life.among(new, life.again)
    runs, fills = ok & life.among(new, [life.runs]), ok & life.among(new, life.settled) & (a["starts"] == KEEPS)
    done, waits, clears = ok & life.among(new, life.done), ok & life.among(new, [life.waits]), ok & life.among(new, [life.clears])
    says = clears | ok & s["error"].isNotNull()
    return effect(
        F.when(ok, new).otherwise(was), a["retries"] + retry.cast("long"), a["rejected"] + (~ok & (new != was)).cast("long"),
        F.when(runs, SETS).when(fills, FILLS).otherwise(a["starts"]), F.when(runs | fills, s["at"]).otherwise(a["started"]),
        a["ends"] | retry | done, F.when(retry, None).when(done, s["at"]).otherwise(a["ended"]),
        a["fails"] | says, F.when(says, s["error"]).otherwise(a["error"]),
        a["flags"] | waits | clears, F.when(waits, True).when(clears, False).otherwise(a["manual"]),
    )


def then(a: Column, b: Column) -> Column:
    """What a and then b does, of which b begins where a ends."""
    starts = F.when(b["starts"] == SETS, b["starts"]).when(a["starts"] == KEEPS, b["starts"]).otherwise(a["starts"])
    started = F.when((b["starts"] == SETS) | (a["starts"] == KEEPS), b["started"]).otherwise(a["started"])
    last = lambda marks, value: F.when(b[marks], b[value]).otherwise(a[value])
    return effect(b["state"], a["retries"] + b["retries"], a["rejected"] + b["rejected"], starts, started, a["ends"] | b["ends"], last("ends", "ended"), a["fails"] | b["fails"], last("fails", "error"), a["flags"] | b["flags"], last("flags", "manual"))


def fold(history: DataFrame, life: Lifecycle, key: str, ordinal: str, status: str, at: str, error: str | None = None) -> DataFrame:
    """(key, status, retries, rejected, started_at, completed_at, error, requires_manual_action) of each key of history after its steps in order.

    A step into the running state sets started_at, one that settles a task that never ran does so too. completed_at is
    the time of the last step that ends the work, and goes with a retry, which counts. A step's error stays until another
    says one or the work is completed. Rejected steps change nothing but their count. Steps without a key are left out.

    Histories up to LONG steps are folded each in a row. Longer ones are dealt by the range of (key, ordinal) into
    parts, whose maps (one effect for each state) are composed FAN at a time, so no task holds a history.
    """
    kind = dict(history.dtypes)
    rows = history.select(F.col(key).alias("k"), F.col(ordinal).alias("o"), life.number(F.col(status)).alias("new"), F.col(at).cast("timestamp").alias("at"), (F.col(error).cast("string") if error else F.lit(None).cast("string")).alias("error")).filter("k is not null")
    counts = staged(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LONG))
    steps = F.array_sort(F.collect_list(F.struct("o", "new", "at", "error"))).alias("steps")
    over = lambda start: F.aggregate("steps", nothing(start), lambda a, s: step(life, a, s))
    first = life.states.index(life.first) + 1
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # one number
    long = counts.select("k")
    out = (rows.join(long, "k", "left_anti") if total else rows).groupBy("k").agg(steps).select("k", over(F.lit(first)).alias("e"))
    if total:
        parts = -(-total // LONG)
        dealt = rows.join(long, "k", "left_semi").repartitionByRange(parts, "k", "o").withColumn("part", F.spark_partition_id())
        every = F.array(*[F.lit(i + 1) for i in range(len(life.states))])
        maps = dealt.groupBy("k", "part").agg(steps).select("k", "part", F.transform(every, over).alias("map"))
        while parts > 1:
            inner = F.array_sort(F.collect_list(F.struct("part", "map"))).alias("maps")
            joined = F.aggregate("maps", F.transform(every, nothing), lambda a, m: F.transform(a, lambda e: then(e, F.element_at(m["map"], e["state"]))))
            maps = staged(maps.groupBy("k", F.floor(F.col("part") / FAN).cast("int").alias("part")).agg(inner).select("k", "part", joined.alias("map")))
            parts = -(-parts // FAN)
        out = out.unionByName(maps.select("k", F.element_at("map", first).alias("e")))
    e = F.col("e")
    when = lambda c, marked: F.when(marked, e[c]).cast(kind[at])
    name = reduce(lambda w, s: w.when(e["state"] == life.states.index(s) + 1, s), life.states, F)
    return out.select(F.col("k").alias(key), name.alias("status"), e["retries"].alias("retries"), e["rejected"].alias("rejected"), when("started", e["starts"] > KEEPS).alias("started_at"), when("ended", e["ends"]).alias("completed_at"), F.when(e["fails"], e["error"]).alias("error"), F.coalesce(F.when(e["flags"], e["manual"]), F.lit(False)).alias("requires_manual_action"))
