"""Session construction and the few session-level services operators need."""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
PART_ROWS = 200_000
#: Files of the checkpoints made inside checkpoints_released(), if one is open.
_HELD: ContextVar[list[str] | None] = ContextVar("held", default=None)


def local_session(cpus: int = 8, name: str = "evoframe", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    return SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=settings).getOrCreate()


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's own, else a local one in local mode.

    A cluster has to name its folder in ``spark.checkpoint.dir``; a machine-local
    folder would hide one executor's files from the others, so it is refused there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = os.path.join(tempfile.gettempdir(), f"evoframe-checkpoints-{os.getuid()}")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def parts_for(rows: int) -> int:
    """Partitions for a table of narrow rows: enough to bound a task, few enough not to scatter small tables over files."""
    return max(1, -(-rows // PART_ROWS))


def spread(rows: DataFrame, part_rows: int) -> DataFrame:
    """rows dealt evenly over partitions of about ``part_rows``, for long work on few bytes, which lie in few file parts."""
    parts = -(-rows.count() // part_rows)
    return rows.repartition(parts) if parts > 1 else rows


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store its path names; a missing one is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def checkpoints_released(spark: SparkSession) -> Iterator[None]:
    """Delete what cut() writes inside, once results that rest on it are written elsewhere."""
    held: list[str] = []
    token = _HELD.set(held)
    try:
        yield
    finally:
        _HELD.reset(token)
        for path in held:
            remove_folder(spark, path)


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Materialise a plan once in the shared folder, in ``parts`` partitions at most, and cut its lineage there.

    The files go when the session's cleaner finds them unused, where
    spark.cleaner.referenceTracking.cleanCheckpoints is set, or with checkpoints_released().
    """
    use_checkpoint_dir(df.sparkSession)
    out = (df if parts is None else df.coalesce(parts)).checkpoint(eager=True)
    held = _HELD.get()
    if held is not None:
        file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
        held.extend([file.get()] if file.isDefined() else [])
    return out


def written(df: DataFrame, path: str) -> DataFrame:
    """Materialise a plan as a Parquet table, a fraction of a checkpoint's size where values repeat.

    The caller removes it; inside checkpoints_released() it goes with the checkpoints.
    """
    df.write.parquet(path)
    held = _HELD.get()
    if held is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a narrow side if it has no more rows than ``limit``; else leave the join to shuffle."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df
