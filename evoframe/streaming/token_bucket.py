"""Token-bucket admission as a fold over each key's rows in order of time.

Levels are kept in microseconds: a token costs ``interval_us``, the bucket holds
``capacity`` tokens and fills by the time that passes, so the arithmetic is exact.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoframe.sources.models import Registry

_OUT = "key long, event_id long, at_us long, allowed boolean, level_us long"


class Bucket:
    """Level and time of one key; a new key starts full."""

    def __init__(self, capacity: int, interval_us: int, level_us: int | None = None, at_us: int | None = None):
        self.cost, self.most = interval_us, capacity * interval_us
        self.level = self.most if level_us is None else level_us
        self.at = at_us

    def take(self, at_us: int) -> bool:
        if self.at is not None:
            self.level = min(self.most, self.level + max(0, at_us - self.at))
        self.at = at_us if self.at is None else max(self.at, at_us)
        if self.level < self.cost:
            return False
        self.level -= self.cost
        return True

    @property
    def full_at(self) -> int:
        """The time from which on the bucket equals that of a new key."""
        return self.at + self.most - self.level


def _fold(capacity: int, interval_us: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, bucket = None, None
        for frame in frames:
            allowed, level = [], []
            for k, at in zip(frame["key"].tolist(), frame["at_us"].tolist()):
                if bucket is None or k != key:
                    key, bucket = k, Bucket(capacity, interval_us)
                allowed.append(bucket.take(at))
                level.append(bucket.level)
            yield frame.assign(allowed=allowed, level_us=level)

    return run


def admitted(events: DataFrame, key: str, ts: str, event_id: str, capacity: int, interval_us: int) -> DataFrame:
    """key, event_id, at_us, allowed, level_us for every event; one key's events stream through in order, in constant memory."""
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(event_id).cast("long").alias("event_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"))
    return rows.repartition("key").sortWithinPartitions("key", "at_us", "event_id").mapInPandas(_fold(capacity, interval_us), _OUT)


def _stateful(capacity: int, interval_us: int, expires: bool):
    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        level, at = state.get if state.exists else (None, None)
        bucket = Bucket(capacity, interval_us, level, at)
        rows = pd.concat(list(frames)).sort_values(["at_us", "event_id"])
        allowed, levels = [], []
        for at_us in rows["at_us"].tolist():
            allowed.append(bucket.take(at_us))
            levels.append(bucket.level)
        full_ms = -(-bucket.full_at // 1000)
        if expires and full_ms <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
        else:
            state.update((bucket.level, bucket.at))
            if expires:
                state.setTimeoutTimestamp(full_ms)
        yield rows.assign(allowed=allowed, level_us=levels)[["key", "event_id", "at_us", "allowed", "level_us"]]

    return run


def admitted_stream(events: DataFrame, key: str, ts: str, event_id: str, capacity: int, interval_us: int, lateness: str | None = None) -> DataFrame:
    """The same fold over a stream; the state of a key is its level and time. Rows of a micro-batch are taken in order of time.

    With ``lateness``, an interval such as '10 minutes', a key's state goes once the
    watermark, which stays that much behind the latest time seen, has passed the time at
    which its bucket is full again: a new key starts full, so rows come out as if the state
    were still there, and states are as many as buckets not full. Rows older than the
    watermark are late and left out, as in every query with a watermark, and so are rows
    without a time. Without ``lateness`` no row is late and states stay.
    """
    if lateness is None:
        rows = events.select(F.col(key).cast("long").alias("key"), F.col(event_id).cast("long").alias("event_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"))
        return rows.groupBy("key").applyInPandasWithState(_stateful(capacity, interval_us, False), _OUT, "level long, at long", "append", "NoTimeout")
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(event_id).cast("long").alias("event_id"), F.col(ts).cast("timestamp").alias("at")).where("at IS NOT NULL")
    rows = rows.withWatermark("at", lateness).withColumn("at_us", F.unix_micros("at"))
    return rows.groupBy("key").applyInPandasWithState(_stateful(capacity, interval_us, True), _OUT, "level long, at long", "append", "EventTimeTimeout")


class RateLimiter:
    """Calls per minute and at once, for one process; waiting longer than ``timeout`` seconds is a TimeoutError.

    Wrap a provider's call in it; each executor process then holds its own share.
    """

    def __init__(self, per_minute: float, at_once: int, timeout: float = 60.0, clock=time.monotonic, sleep=time.sleep, burst: int | None = None):
        self.bucket = Bucket(max(1, int(per_minute)) if burst is None else burst, int(60_000_000 / per_minute))
        self.places = threading.BoundedSemaphore(at_once)
        self.lock = threading.Lock()
        self.timeout, self.clock, self.sleep = timeout, clock, sleep

    def __call__(self, call, *arguments):
        end = self.clock() + self.timeout
        if not self.places.acquire(timeout=self.timeout):
            raise TimeoutError("no free place in time")
        try:
            while True:
                with self.lock:
                    admitted_ = self.bucket.take(int(self.clock() * 1_000_000))
                if admitted_:
                    return call(*arguments)
                if self.clock() >= end:
                    raise TimeoutError("rate limit not free in time")
                self.sleep(min(0.05, max(0.0, end - self.clock())))
        finally:
            self.places.release()


_SHARED: dict[str, object] = {}


def shared(name: str, make):
    """One object a process under a name, made when first asked for: limiters, clients, caches on an executor."""
    return _SHARED[name] if name in _SHARED else _SHARED.setdefault(name, make())


class _Limited:
    def __init__(self, provider, share: float, name: str):
        self.provider, self.share, self.name = provider, share, name

    def __call__(self, prompts: list) -> list:
        limiter = shared(self.name, lambda: RateLimiter(self.share, 1, timeout=3600.0, burst=1))
        return [limiter(self.provider, [p])[0] for p in prompts]


def limited(provider, per_minute: float, tasks: int):
    """A provider, or a registry of them, of which all tasks together make at most ``per_minute`` calls, a prompt each.

    Each of at most ``tasks`` tasks that run at the same time has an equal share, held by
    its worker process, so the sum over the cluster stays under the limit wherever they run.
    """
    if isinstance(provider, Registry):
        return Registry({name: limited(p, per_minute, tasks) for name, p in provider.thinkers.items()}, provider.operator)
    return _Limited(provider, per_minute / tasks, f"limiter-{uuid.uuid4()}")
