"""Keyed totals in shards: sums inside a task, then one cuckoo filter and its exact table per shard.

A shard owns the keys of one hash range and is sized for SHARD_KEYS of them. Many
shards share a partition, whose rows are sorted by shard, so that a task holds the
filter and the table of one shard at a time and the number of partitions follows
the rows, not the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoframe.llm.cuckoo import CuckooFilter

#: Keys a shard is sized for; its filter and table take about 40 MB.
SHARD_KEYS = 100_000
#: Shards that follow each other in a partition of a large table.
SHARDS_A_PART = 32
#: Rows a task adds up before they leave it.
TASK_ROWS = 500_000
#: How two values of a column become one; nulls give way.
JOINED = {"sum": lambda a, b: a + b, "min": min, "max": max}


def shards_for(keys: int) -> int:
    return max(1, -(-keys // SHARD_KEYS))


def shard_of(digest, shards: int):
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def parts_of(shards: int, spark) -> int:
    """Partitions for so many shards: all of a small number apart, SHARDS_A_PART together in a large one."""
    return max(min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-shards // SHARDS_A_PART))


def _schema(ops: dict[str, str]) -> str:
    return "digest binary, " + ", ".join(f"{c} long" for c in ops)


def added_in_task(rows: DataFrame, ops: dict[str, str]) -> DataFrame:
    """Rows of a digest joined by ``ops`` (column: sum, min or max) inside each task; other tasks may have it too."""
    names = ["digest", *ops]

    def added(tables: list[pa.Table]) -> list[pa.RecordBatch]:
        grouped = pa.concat_tables(tables).group_by("digest").aggregate(list(ops.items()))
        return grouped.rename_columns({f"{c}_{op}": c for c, op in ops.items()}).select(names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]).select(names))
            size += batch.num_rows
            if size >= TASK_ROWS:
                yield from added(held)
                held, size = [], 0
        if held:
            yield from added(held)

    return rows.select(names).mapInArrow(run, _schema(ops))


def join_values(stored: list, values: tuple, ops: list[str]) -> None:
    for i, op in enumerate(ops):
        if stored[i] is None:
            stored[i] = values[i]
        elif values[i] is not None:
            stored[i] = JOINED[op](stored[i], values[i])


def take(index: CuckooFilter, digests: list[bytes], values: list[tuple], ops: list[str]) -> None:
    """Rows into a shard: a filter miss is a new key, a hit is settled by the stored keys."""
    new: dict[bytes, list] = {}
    for digest, hit, row in zip(digests, index.maybe(digests), values):
        stored = index.get(digest) if hit else None
        stored = new.get(digest) if stored is None else stored
        if stored is None:
            new[digest] = list(row)
        else:
            join_values(stored, row, ops)
    index.insert(list(new.items()))


def folded(rows: DataFrame, shards: int, ops: dict[str, str]) -> DataFrame:
    """shard, digest and the columns of ``ops``, one row per distinct digest of ``rows``.

    An empty input gives an empty result.
    """
    names, kinds = list(ops), list(ops.values())

    def entries(shard: int, index: CuckooFilter) -> Iterator[pa.RecordBatch]:
        items = list(index.keys.items())
        for i in range(0, len(items), 10_000):
            part = items[i : i + 10_000]
            columns = [pa.array([shard] * len(part), pa.int32()), pa.array([k for k, _ in part], pa.binary())]
            columns += [pa.array([v[j] for _, v in part], pa.int64()) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "digest", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        for batch in batches:
            at = batch.column("shard").to_numpy(zero_copy_only=False)
            begin = 0
            while begin < len(at):  # rows come sorted by shard
                end = begin + int((at[begin:] != at[begin]).argmax() or len(at) - begin)
                if at[begin] != now:
                    if index is not None:
                        yield from entries(now, index)
                    now, index = int(at[begin]), CuckooFilter(SHARD_KEYS)
                part = batch.slice(begin, end - begin)
                take(index, part.column("digest").to_pylist(), list(zip(*[part.column(c).to_pylist() for c in names])), kinds)
                begin = end
        if index is not None:
            yield from entries(now, index)

    placed = added_in_task(rows, ops).select(shard_of("digest", shards).alias("shard"), "digest", *names)
    placed = placed.repartition(parts_of(shards, rows.sparkSession), "shard").sortWithinPartitions("shard")
    return placed.mapInArrow(run, "shard int, " + _schema(ops))
