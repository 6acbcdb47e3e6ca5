"""Runs over batches of samples with time limits, states and statistics."""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark import InheritableThread, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoframe.plans.progress import Progress, Watch
from evoframe.session import cut, remove_folder, use_checkpoint_dir
from evoframe.sources.files import write_json


@dataclass(frozen=True)
class BatchStatistics:
    """Samples by state, and the rate; a sample is timed out, failed or successful, never two of them."""

    total: int
    successful: int
    failed: int
    timed_out: int
    seconds: float

    @property
    def samples_per_minute(self) -> float:
        return self.successful / self.seconds * 60 if self.seconds > 0 else 0.0

    @property
    def success_percent(self) -> float:
        return 100 * self.successful / self.total if self.total else 0.0


def _within(spark, group: str, seconds: float | None, pool: str | None, job: Callable[[], DataFrame]) -> DataFrame | str:
    """The job's result, or what went wrong. Once the time is over its Spark jobs are cancelled, and those it would start later."""
    out = []

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "batch", interruptOnCancel=True)
        if pool is not None:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        try:
            out.append(job())
        except Exception as error:
            out.append(f"{type(error).__name__}: {error}")

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark._jsc.sc().cancelJobGroupAndFutureJobs(group)
        return "timeout"
    return out[0]


def process(
    samples: DataFrame,
    run: Callable[[DataFrame], DataFrame],
    batch_size: int = 1000,
    timeout: float | None = 300.0,
    progress: Callable[[int, int], None] | None = None,
    at_once: int = 1,
    watched: Callable[[Progress], None] | None = None,
    interval: float = 1.0,
) -> tuple[DataFrame, BatchStatistics]:
    """(results, statistics): ``run`` over batches of ``samples``, which have a unique ``id``.

    ``run`` returns rows with sample_id. Results have one row a sample with its columns,
    ``state`` (ok, error, timeout) and ``error``. Up to ``at_once`` batches run at the same
    time, each in a scheduler pool of its own. A batch that exceeds ``timeout`` seconds is
    cancelled with all it would start later, one that fails is marked, and the others go
    on. ``progress`` is told the samples done and in all after each batch, ``watched`` at
    intervals of seconds also the tasks of the batches that run. Samples are dealt by a hash of
    the id and written once, by batch; a batch reads its own folder.
    """
    spark, began = samples.sparkSession, time.perf_counter()
    total = samples.count()
    batches = max(1, -(-total // batch_size))
    folder = f"{use_checkpoint_dir(spark)}/batches-{uuid.uuid4()}"
    placed = samples.withColumn("_batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    placed.repartition("_batch").write.partitionBy("_batch").parquet(f"{folder}/samples")
    sizes = {r["_batch"]: r["count"] for r in spark.read.parquet(f"{folder}/samples").groupBy("_batch").count().collect()} if total else {}  # a row a batch
    done, lock = 0, threading.Lock()
    watch = Watch(spark, watched, total, interval) if watched is not None else None

    def one(batch: int) -> DataFrame:
        nonlocal done
        own = spark.read.schema(samples.schema).parquet(f"{folder}/samples/_batch={batch}")
        group = str(uuid.uuid4())
        if watch is not None:
            watch.begin(group)
        found = _within(spark, group, timeout, f"batch-{batch}" if at_once > 1 else None, lambda: cut(run(own)))
        if isinstance(found, str):
            rows = own.select(F.col("id").alias("sample_id"), F.lit("timeout" if found == "timeout" else "error").alias("state"), F.lit(found).alias("error"))
        else:
            rows = own.select("id").join(found.withColumn("_found", F.lit(True)), F.col("id") == F.col("sample_id"), "left").drop("sample_id").withColumnRenamed("id", "sample_id")
            rows = rows.withColumn("state", F.when(F.col("_found"), "ok").otherwise("error")).withColumn("error", F.when(F.col("_found").isNull(), "no result")).drop("_found")
        if watch is not None:
            watch.end(group, sizes[batch])
        with lock:
            done += sizes[batch]
            if progress is not None:
                progress(done, total)
        return rows

    with watch or contextlib.nullcontext(), ThreadPoolExecutor(at_once) as pool:
        parts = list(pool.map(inheritable_thread_target(spark)(one), sorted(sizes)))
    if not parts:
        parts = [samples.select(F.col("id").alias("sample_id"), F.lit("ok").alias("state"), F.lit(None).cast("string").alias("error"))]
    results = cut(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))
    remove_folder(spark, folder)
    states = {r.state: r["count"] for r in results.groupBy("state").count().collect()}  # three at most
    return results, BatchStatistics(total, states.get("ok", 0), states.get("error", 0), states.get("timeout", 0), time.perf_counter() - began)


def write_batch(results: DataFrame, statistics: BatchStatistics, folder: str) -> None:
    """Results and errors as JSON lines, by state, and a file of statistics beside them."""
    results.write.mode("overwrite").partitionBy("state").json(f"{folder}/results")
    held = asdict(statistics) | {"samples_per_minute": statistics.samples_per_minute, "success_percent": statistics.success_percent}
    write_json(results.sparkSession, f"{folder}/statistics.json", held)
