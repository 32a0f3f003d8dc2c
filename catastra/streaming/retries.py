"""R-03, R-05: jobs that are tried again after waits that double, as a keyed stream with timers; what is done is kept by age and number."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps lists, maps and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Policy:
    """attempts in all; the wait before the second, doubled before each further one; how long and how many finished jobs are remembered, completed and failed ones."""

    attempts: int = 2
    wait_ms: int = 5_000
    completed_age_ms: int = 86_400_000
    completed_count: int = 200
    failed_age_ms: int = 604_800_000
    failed_count: int = 500


class Kept:
    """Finished jobs that are remembered: those that succeeded and those that failed, oldest first."""

    def __init__(self, policy: Policy, jobs: list) -> None:
        self.most = {True: (policy.completed_age_ms, policy.completed_count), False: (policy.failed_age_ms, policy.failed_count)}
        self.jobs = {True: [], False: []}
        for job, ok, at in jobs:
            self.jobs[ok].append((job, ok, at))

    def add(self, job: str, ok: bool, at: int) -> None:
        insort(self.jobs[ok], (job, ok, at), key=itemgetter(2))
        for good, (age, most) in self.most.items():
            mine = self.jobs[good]
            del mine[: max(bisect_left(mine, at - age, key=itemgetter(2)), len(mine) - most, 0)]

    def all(self) -> list:
        return sorted([*self.jobs[True], *self.jobs[False]], key=itemgetter(2))


class Tries(StatefulProcessor):
    """Of each key: `waiting`, jobs to be tried again and when; `kept`, finished jobs, oldest first.

    Both are read once and written once for all jobs of a key that a batch brings or whose time has come, and one timer stands
    for the earliest of those that wait, so calls to the store do not grow with the jobs.
    """

    def __init__(self, work: Callable[[str, int], bool], policy: Policy, key: str) -> None:
        self.work, self.policy, self.key = work, policy, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "job string, attempt int, due long")
        self.kept = handle.getValueState("kept", "jobs array<struct<job:string,ok:boolean,at:bigint>>")

    def load(self) -> tuple[Kept, list]:
        return Kept(self.policy, [tuple(x) for x in self.kept.get()[0]] if self.kept.exists() else []), [tuple(x) for x in self.waiting.get()]

    def remember(self, job: str, ok: bool, at: int) -> None:
        """One job that is finished elsewhere."""
        kept = Kept(self.policy, [tuple(x) for x in self.kept.get()[0]] if self.kept.exists() else [])
        kept.add(job, ok, at)
        self.kept.update((kept.all(),))

    def try_it(self, key: tuple, job: str, attempt: int, at: int, upto: int, kept: Kept, later: list) -> Iterator[Row]:
        """Tries the job, and again as long as the next time is not after `upto`; beyond that it goes to `later`, for a timer."""
        while True:
            try:
                ok = bool(self.work(job, attempt))
            except Exception:
                ok = False
            last = ok or attempt >= self.policy.attempts
            yield Row(**{self.key: key[0], "job": job, "attempt": attempt, "ok": ok, "last": last, "at_ms": at})
            if last:
                kept.add(job, ok, at)
                return
            at += self.policy.wait_ms << (attempt - 1)
            attempt += 1
            if at > upto:
                later.append((job, attempt, at))
                return

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (kept, waiting), now, later = self.load(), timerValues.getCurrentWatermarkInMs(), []
        seen = {x[0] for x in kept.all()} | {x[0] for x in waiting}
        for r in rows:
            if r.job not in seen:
                seen.add(r.job)
                yield from self.try_it(key, r.job, 1, r.at_ms, now, kept, later)
        if kept.all():
            self.kept.update((kept.all(),))
        if later:
            self.waiting.appendList(later)
            self.handle.registerTimer(min(x[2] for x in later))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (kept, waiting), now = self.load(), timerValues.getCurrentWatermarkInMs()
        due = sorted((x for x in waiting if x[2] <= now), key=itemgetter(2, 0))
        if not due:
            return
        later = [x for x in waiting if x[2] > now]
        for job, attempt, at in due:
            yield from self.try_it(key, job, attempt, at, now, kept, later)
        if kept.all():
            self.kept.update((kept.all(),))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(x[2] for x in later))
        else:
            self.waiting.clear()


def tried(jobs: DataFrame, key: str, job: str, at: str, work: Callable[[str, int], bool], policy: Policy = Policy(), late: str = "0 seconds") -> DataFrame:
    """A row (key, job, attempt, ok, last, at_ms) for each attempt at a job of the stream jobs(key, job, at).

    work(job, attempt) says whether an attempt succeeds; an exception is a failure. Times are the stream's: a job is tried at its own
    time, and again when the watermark has passed the end of its wait. A job that comes again while it waits, or
    while it is remembered, is not tried again, so a batch that is delivered twice does nothing new. `last` marks the attempt that
    settles the job. State of a key is its waiting jobs and what the policy lets it remember.
    """
    jobs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = dict(jobs.dtypes)[key]
    rows = jobs.select(key, F.col(job).cast("string").alias("job"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", late)
    rows = rows.select(key, "job", "at", F.unix_millis("at").alias("at_ms"))
    return rows.groupBy(key).transformWithState(statefulProcessor=Tries(work, policy, key), outputStructType=f"{key} {kind}, job string, attempt int, ok boolean, last boolean, at_ms bigint", outputMode="append", timeMode="EventTime")
