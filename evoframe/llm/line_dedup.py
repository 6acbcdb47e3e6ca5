"""Incremental line dedup: sharded cuckoo filters over exact reference-count tables.

The key of a line is the digest of the line without white space at its ends and with
A-Z lower-cased. Every shard keeps, for each live key, how many rows of documents
refer to it and the smallest and largest of their ids, and a cuckoo filter that tells
new keys without a look into that table. Postings (doc_id, digest) are kept beside
it, so that a document can be deleted again: counts fall, a key without references
leaves table and filter, and a key that lost its first document finds the next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoframe.llm.common import id_text, meet
from evoframe.llm.cuckoo import CuckooFilter
from evoframe.llm.shards import SHARD_KEYS, folded, shard_of, shards_for, take
from evoframe.session import cut

#: Code points a key has at least; shorter lines are never counted.
KEY_CHARS = 10
#: Bytes of a key's SHA-256 that stand for it.
DIGEST_BYTES = 16
#: Rows of postings that leave a task together.
BATCH_ROWS = 50_000
OPS = {"refs": "sum", "first_id": "min", "last_id": "max"}
INDEX_SCHEMA = "shard int, digest binary, refs long, first_id long, last_id long, slots binary"


class LineIndex(NamedTuple):
    """``postings(doc_id, digest)``; ``counts`` by INDEX_SCHEMA, of which a row without digest holds a shard's filter."""

    postings: DataFrame
    counts: DataFrame
    shards: int

    @property
    def keys(self) -> DataFrame:
        return self.counts.where("digest IS NOT NULL").drop("slots")

    def save(self, path: str) -> None:
        """Write the index under ``path``; ``shards`` comes last and commits it."""
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        self.postings.sparkSession.range(1).select(F.lit(self.shards).alias("shards")).write.mode("overwrite").parquet(f"{path}/shards")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/shards").first()[0])


def _line_digests(text: bytes) -> list[bytes | None]:
    """The digest of each line's key, None for keys that are too short."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):  # bytes.lower() folds A-Z only, bytes.strip() the six ASCII blanks
        key = line.strip()
        long_enough = len(key) >= 4 * KEY_CHARS or (len(key) >= KEY_CHARS and len(key.decode(errors="replace")) >= KEY_CHARS)
        out.append(hashlib.sha256(key).digest()[:DIGEST_BYTES] if long_enough else None)
    return out


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int] = []
    digests: list[bytes] = []
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch.column("text"))):
            found = dict.fromkeys(_line_digests(text))
            found.pop(None, None)
            digests.extend(found)
            ids.extend([doc_id] * len(found))
            if len(ids) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "digest"])
                ids, digests = [], []
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "digest"])


def line_postings(docs: DataFrame) -> DataFrame:
    """doc_id and digest of each distinct key of each row that has a doc_id."""
    return id_text(docs).where("doc_id IS NOT NULL").mapInArrow(_posted, "doc_id long, digest binary")


def _as_counts(postings: DataFrame) -> DataFrame:
    return postings.select("digest", F.lit(1).cast("long").alias("refs"), F.col("doc_id").alias("first_id"), F.col("doc_id").alias("last_id"))


def build(docs: DataFrame) -> LineIndex:
    """The index of all rows of ``docs`` that have a doc_id.

    Texts are read once; null and empty texts have no key. Rows that repeat a doc_id
    refer once each, and their document is one. An empty table gives an empty index.
    """
    postings = cut(line_postings(docs))
    shards = shards_for(postings.count())
    counts = folded(_as_counts(postings), shards, OPS).withColumn("slots", F.lit(None).cast("binary"))
    return LineIndex(postings, cut(counts), shards)


def _changed(key, held: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """One shard after its changes; only a shard whose filter was never kept builds it from its keys."""
    rows = held[held.digest.notna()]
    index = CuckooFilter(max(SHARD_KEYS, len(rows)))
    keys = [(bytes(d), [int(n), int(a), int(b)]) for d, n, a, b in zip(rows.digest, rows.refs, rows.first_id, rows.last_id)]
    kept = held.slots[held.slots.notna()]
    if len(kept):
        index.restore(bytes(kept.iloc[0]), keys)
    else:
        index.insert(keys)
    added = changes[changes.refs > 0]
    take(index, [bytes(d) for d in added.digest], [(int(n), int(a), int(b)) for n, a, b in zip(added.refs, added.first_id, added.last_id)], list(OPS.values()))
    fewer = changes[changes.refs < 0]
    lost = [bytes(d) for d in fewer.digest]
    dead = []
    for digest, hit, n, first, last in zip(lost, index.maybe(lost), fewer.refs, fewer.first_id, fewer.last_id):
        stored = index.get(digest) if hit else None
        if stored is None:
            continue
        stored[0] += int(n)
        if stored[0] <= 0:
            dead.append(digest)
        elif not pd.isna(first):
            stored[1:] = [int(first), int(last)]
    index.delete(dead)
    values = list(index.keys.values())
    n = len(values)
    return pd.DataFrame(
        {
            "shard": np.full(n + 1, key[0], "int32"),
            "digest": [*index.keys, None],
            "refs": pd.array([v[0] for v in values] + [None], "Int64"),
            "first_id": pd.array([v[1] for v in values] + [None], "Int64"),
            "last_id": pd.array([v[2] for v in values] + [None], "Int64"),
            "slots": [None] * n + [index.slots.tobytes()],
        }
    )


def _apply(index: LineIndex, changes: DataFrame) -> DataFrame:
    placed = changes.select(shard_of("digest", index.shards).alias("shard"), "digest", "refs", "first_id", "last_id")
    return cut(index.counts.groupBy("shard").cogroup(placed.groupBy("shard")).applyInPandas(_changed, INDEX_SCHEMA))


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with the rows of ``docs`` added; only their texts are read.

    A shard that outgrows its size is dealt over more shards from the stored keys.
    """
    fresh = cut(line_postings(docs))
    changes = _as_counts(fresh).groupBy("digest").agg(F.sum("refs").alias("refs"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))
    grown = LineIndex(index.postings.unionByName(fresh), _apply(index, changes), index.shards)
    shards = shards_for(grown.keys.count())
    if shards <= 2 * index.shards:
        return grown
    counts = folded(grown.keys.drop("shard"), shards, OPS).withColumn("slots", F.lit(None).cast("binary"))
    return grown._replace(counts=cut(counts), shards=shards)


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents in ``ids(doc_id)``; ids it does not have change nothing.

    Counts fall by the rows that go. Only keys that stay and lose their first or last
    document look for another among the postings that stay.
    """
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    rest = cut(index.postings.join(ids, "doc_id", "left_anti"))
    gone = index.postings.join(ids, "doc_id", "left_semi").groupBy("digest").agg(F.count("*").alias("gone"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    gone = cut(gone)
    ends = gone.join(index.keys.select("digest", "refs", "first_id", "last_id"), "digest").where("refs > gone AND (low = first_id OR high = last_id)")
    again = rest.join(ends.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    changes = gone.select("digest", (-F.col("gone")).alias("refs")).join(again, "digest", "left")
    return LineIndex(rest, _apply(index, changes), index.shards)


def repeated_lines(index: LineIndex) -> DataFrame:
    """doc_id, digest: the keys each document loses, as a document of smaller id has them."""
    several = index.keys.where("first_id <> last_id").select("digest", "first_id", F.col("refs").alias("n"))
    return meet(index.postings, several, ["digest"], ["doc_id"]).where("doc_id <> first_id").select("doc_id", "digest")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, dropped, kept = [], [], []
        for text, gone in zip(_texts(batch.column("text")), batch.column("gone").to_pylist()):
            n, out = text.count(b"\n") + 1, text
            if gone:
                gone = set(gone)
                lines = [line for line, digest in zip(text.split(b"\n"), _line_digests(text)) if digest not in gone]
                out = b"\n".join(lines)
                dropped.append(n - len(lines))
            else:
                dropped.append(0)
            counts.append(n)
            kept.append(out)
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "text"])


def without_repeats(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, text: each row without the lines that a document of smaller id has.

    ``index`` is that of ``docs`` itself by default, or a kept one that knows them.
    Keys have KEY_CHARS code points or more and occur in at least two documents; the
    smallest doc_id keeps all its lines, also repeated ones. Null and empty texts are
    one empty line. Rows without doc_id hold no place in that order: they count for no
    key and keep all their lines. Rows of one doc_id are one document and all keep, or
    all lose, a key. An empty table gives an empty result; other columns are ignored.
    """
    index = build(docs) if index is None else index
    gone = repeated_lines(index).groupBy("doc_id").agg(F.collect_set("digest").alias("gone"))
    rows = id_text(docs)
    named = rows.where("doc_id IS NOT NULL").join(gone, "doc_id", "left")
    others = rows.where("doc_id IS NULL").withColumn("gone", F.lit(None).cast("array<binary>"))
    return named.unionByName(others).mapInArrow(_without, "doc_id long, n_lines long, n_dropped long, text string")


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
