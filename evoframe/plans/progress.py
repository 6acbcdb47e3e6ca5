"""Progress of a running batch or loop, from Spark's status tracker.

A thread on the driver asks the tracker at intervals; the jobs themselves know nothing of
it. Reports come between samples too, as stages and tasks of running jobs move.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

_LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class Progress:
    """Samples done of all, and what runs now: the phase, its stages, and the tasks of these stages."""

    total: int
    completed: int
    phase: str | None
    stages: int
    tasks: int
    tasks_done: int
    seconds: float

    @property
    def remaining(self) -> int:
        return self.total - self.completed

    @property
    def percent(self) -> float:
        return 100 * self.completed / self.total if self.total else 100.0

    @property
    def seconds_left(self) -> float | None:
        """At the rate so far; None before the first sample is done."""
        return self.remaining * self.seconds / self.completed if self.completed else None


class Watch:
    """Reports the progress of the work inside a ``with`` to ``report``, whenever it has changed at a look.

    Only jobs of groups entered with begin() count, or every active job if none was. An
    error in ``report`` is logged and stops nothing. A last report comes at the end.
    """

    def __init__(self, spark: SparkSession, report: Callable[[Progress], None], total: int = 0, interval: float = 1.0):
        self.tracker = spark.sparkContext.statusTracker()
        self.report, self.total, self.interval = report, total, interval
        self.completed, self.phase = 0, None
        self._groups: set[str] = set()
        self._grouped = False
        self._lock, self._over = threading.Lock(), threading.Event()
        self._last: tuple | None = None

    def begin(self, group: str) -> None:
        with self._lock:
            self._grouped = True
            self._groups.add(group)

    def end(self, group: str, samples: int = 0) -> None:
        """A group's jobs are over, and with them so many samples."""
        with self._lock:
            self._groups.discard(group)
            self.completed += samples

    def _running(self) -> tuple[int, int, int]:
        with self._lock:
            groups = list(self._groups) if self._grouped else None
        if groups is None:
            jobs = list(self.tracker.getActiveJobsIds())
        else:
            jobs = [j for g in groups for j in self.tracker.getJobIdsForGroup(g)]
        infos = [i for i in map(self.tracker.getJobInfo, jobs) if i is not None and i.status == "RUNNING"]
        stages = [x for i in infos for x in map(self.tracker.getStageInfo, i.stageIds) if x is not None]
        return len(stages), sum(x.numTasks for x in stages), sum(x.numCompletedTasks for x in stages)

    def _look(self) -> None:
        try:
            stages, tasks, done = self._running()
            held = (self.total, self.completed, self.phase, stages, tasks, done)
            if held != self._last:
                self._last = held
                self.report(Progress(*held, time.perf_counter() - self._began))
        except Exception as error:
            _LOG.error("progress: %s", error)

    def _loop(self) -> None:
        while not self._over.wait(self.interval):
            self._look()

    def __enter__(self) -> Watch:
        self._began = time.perf_counter()
        self._thread = threading.Thread(target=self._loop, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *error) -> None:
        self._over.set()
        self._thread.join()
        self._look()
