"""Studies in the background: submit, poll, cancel, and a bounded store of results that expire.

A job is a plan that a thread builds and settles; its Spark jobs are one group, which tells its progress and by which it is cancelled. Results are tables in the shared folder. Jobs are
named by a key of what they compute (see request.analysis_key), so the same request is computed once while its result is kept.
"""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..functions.tables import dropped, settled

QUEUED, RUNNING, DONE, FAILED, CANCELLED = "queued", "running", "done", "failed", "cancelled"


@dataclass
class Job:
    key: str
    plan: Callable[[], DataFrame]
    state: str = QUEUED
    error: str = ""
    result: DataFrame | None = None
    ended: float = 0.0
    done: threading.Event = field(default_factory=threading.Event)


class Jobs:
    """At most `workers` jobs run at a time; at most `keep` results are held, each for `ttl` seconds after its end."""

    def __init__(self, spark: SparkSession, keep: int = 16, ttl: float = 3600.0, workers: int = 2, clock: Callable[[], float] = time.monotonic) -> None:
        self.spark, self.keep, self.ttl, self.clock = spark, keep, ttl, clock
        self._jobs: OrderedDict[str, Job] = OrderedDict()
        self._lock, self._slots = threading.RLock(), threading.Semaphore(workers)

    def submit(self, key: str, plan: Callable[[], DataFrame]) -> str:
        """The key, under which the job is polled. A job of that key that is running, or whose result is kept, is not run again."""
        with self._lock:
            self.purge()
            known = self._jobs.get(key)
            if known and known.state in (QUEUED, RUNNING, DONE):
                self._jobs.move_to_end(key)
                return key
            job = self._jobs[key] = Job(key, plan)
        threading.Thread(target=inheritable_thread_target(self.spark)(self._run), args=(job,), daemon=True).start()
        return key

    def _run(self, job: Job) -> None:
        with self._slots:
            if job.state == QUEUED:
                job.state = RUNNING
                self.spark.sparkContext.setJobGroup(job.key, job.key, interruptOnCancel=True)
                try:
                    found = settled(job.plan())
                    with self._lock:
                        job.result, job.state = (found, DONE) if job.state == RUNNING else (None, CANCELLED)
                    if job.state == CANCELLED:
                        dropped(found)
                except Exception as error:
                    job.state, job.error = (CANCELLED, "") if job.state == CANCELLED else (FAILED, str(error).split("\n", 1)[0])
            job.ended = self.clock()
        job.plan = None
        job.done.set()
        self.purge()

    def status(self, key: str) -> dict:
        """state, error, and of a running job how many of the tasks that are known so far have ended."""
        with self._lock:
            self.purge()
            job = self._jobs.get(key)
        if job is None:
            raise KeyError(f"no job {key!r}: it was never submitted, or has expired")
        tracker, tasks, ended = self.spark.sparkContext.statusTracker(), 0, 0
        for number in tracker.getJobIdsForGroup(key) if job.state == RUNNING else ():
            for stage in (info.stageIds if (info := tracker.getJobInfo(number)) else ()):
                if known := tracker.getStageInfo(stage):
                    tasks, ended = tasks + known.numTasks, ended + known.numCompletedTasks
        return {"key": key, "state": job.state, "error": job.error, "tasks": tasks, "tasks_done": ended}

    def wait(self, key: str, seconds: float | None = None) -> str:
        """The state after at most so many seconds."""
        job = self._jobs[key]
        job.done.wait(seconds)
        return job.state

    def result(self, key: str) -> DataFrame:
        state = self.status(key)["state"]
        if state != DONE:
            raise RuntimeError(f"job {key!r} is {state}")
        return self._jobs[key].result

    def cancel(self, key: str) -> None:
        """Ends a job that waits or runs; of one that has ended the result stays."""
        with self._lock:
            job = self._jobs[key]
            if job.state in (QUEUED, RUNNING):
                job.state = CANCELLED
        self.spark.sparkContext.cancelJobGroup(key)

    def purge(self) -> None:
        """Lets go of results that have expired, and of the least recently asked ones beyond `keep`; their tables are deleted."""
        with self._lock:
            ended = [j for j in self._jobs.values() if j.done.is_set()]
            old = [j for j in ended if self.clock() - j.ended >= self.ttl]
            fresh = [j for j in ended if j not in old]
            for job in [*old, *fresh[: max(0, len(fresh) - self.keep)]]:
                del self._jobs[job.key]
                if job.result is not None:
                    dropped(job.result)
