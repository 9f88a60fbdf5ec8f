"""Jobs that run in small steps while nothing forbids it, and a simulation of them."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Items that one step may do.
STEP_ITEMS = 1000
TRACE = "tick bigint, action string, job_id string, work_done bigint, pending bigint"


@dataclass
class Job:
    id: str
    priority: int
    remaining: int
    seq: int = 0
    state: str = ""


@dataclass
class Scheduler:
    """Runs the queued job of highest priority, of equals the first, one bounded step at a tick."""

    jobs: list[Job] = field(default_factory=list)
    restored: bool = True

    def submit(self, job: Job) -> None:
        if not self.restored:
            raise RuntimeError("restore the queue before submitting")
        job.seq = max((j.seq for j in self.jobs), default=-1) + 1
        self.jobs.append(job)

    @property
    def pending(self) -> int:
        return sum(j.remaining for j in self.jobs)

    def tick(self, allowed: bool, step: int = STEP_ITEMS) -> tuple[str, str | None, int]:
        """(action, job, work): ran, blocked or drained."""
        queue = sorted((j for j in self.jobs if j.remaining > 0), key=lambda j: (-j.priority, j.seq))
        if not queue:
            return "drained", None, 0
        if not allowed:
            return "blocked", None, 0
        work = min(step, queue[0].remaining)
        queue[0].remaining -= work
        return "ran", queue[0].id, work

    def save(self, path: str) -> None:
        """Writes all jobs to a new file and puts it in place of the old one."""
        with open(path + ".tmp", "w") as out:
            json.dump([asdict(j) for j in self.jobs], out)
            out.flush()
            os.fsync(out.fileno())
        os.replace(path + ".tmp", path)

    @classmethod
    def load(cls, path: str) -> Scheduler:
        with open(path) as text:
            return cls([Job(**j) for j in json.load(text)])


def simulate(spark: SparkSession, jobs: list[Job], timeline: list[tuple[int, int, bool, bool, bool]], step: int = STEP_ITEMS) -> DataFrame:
    """The trace (tick, action, job_id, work_done, pending) of jobs along a scripted timeline.

    A line of the timeline is (first tick, tick after the last, on power, user idle, cool).
    """
    scheduler = Scheduler()
    for job in jobs:
        scheduler.submit(Job(job.id, job.priority, job.remaining))
    rows = []
    for begin, end, power, idle, cool in timeline:
        for tick in range(begin, end):
            action, job, work = scheduler.tick(power and idle and cool, step)
            rows.append((tick, action, job, work, scheduler.pending))
    return spark.createDataFrame(rows, TRACE)


def run_order(jobs: DataFrame) -> DataFrame:
    """(job_id, position): jobs by priority, then by order of arrival."""
    return jobs.withColumn("position", F.row_number().over(Window.partitionBy("queue").orderBy(F.desc("priority"), "seq")))


def gate(trace: DataFrame, step: int = STEP_ITEMS) -> DataFrame:
    """One row: no work while blocked, everything drained, no step too large."""
    return trace.agg(
        (F.coalesce(F.sum(F.when(F.col("action") == "blocked", F.col("work_done"))), F.lit(0)) == 0).alias("idle_when_blocked"),
        (F.min("pending") == 0).alias("drained"),
        (F.max("work_done") <= step).alias("bounded"),
    )
