"""Exact deduplication over a sharded cuckoo-filter index.

Digests are added up within the task that reads them, so a text that fills a third
of the corpus reaches its shard as a few rows a task. Each shard owns the digests of
one hash range: a cuckoo filter says which are certainly new, stored keys settle
the hits, and the index can be kept, extended and purged between runs. Equal
digests are then verified on content: the texts of multi-row groups are compared
with the row that stays, in buckets of bounded size, and rows that differ form
groups of their own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoframe.llm.common import ascii_lower, id_text, meet
from evoframe.llm.cuckoo import CuckooFilter
from evoframe.llm.shards import SHARD_KEYS, added_in_task, folded, shard_of, shards_for, take
from evoframe.session import cut

#: Members of a group of copies that are compared with the kept text in one place.
BUCKET_ROWS = 64
INDEX_SCHEMA = "shard int, digest binary, keep_id long, group_size long"


#: How rows of a digest become one.
OPS = {"keep_id": "max", "group_size": "sum"}


def build_index(digests: DataFrame, shards: int) -> DataFrame:
    """One row per distinct digest of ``digests(digest, keep_id, group_size)``: the live keys of the index.

    ``keep_id`` becomes the largest and ``group_size`` the sum over rows of a digest.
    An empty input gives an empty index.
    """
    return folded(digests, shards, OPS)


def _apply_changes(expected: int):
    def run(key, index: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
        known = lambda k: None if pd.isna(k) else int(k)
        held = CuckooFilter(max(expected, len(index)))
        held.insert([(bytes(d), [known(k), n]) for d, k, n in zip(index.digest, index.keep_id, index.group_size)])
        gone = [bytes(d) for d in changes.digest[changes.deleted]]
        held.delete([d for d, hit in zip(gone, held.maybe(gone)) if hit])
        added = changes[~changes.deleted]
        take(held, [bytes(d) for d in added.digest], [(known(k), n) for k, n in zip(added.keep_id, added.group_size)], list(OPS.values()))
        return pd.DataFrame({"shard": key[0], "digest": list(held.keys), "keep_id": pd.array([v[0] for v in held.keys.values()], "Int64"), "group_size": [v[1] for v in held.keys.values()]}).astype({"shard": "int32", "group_size": "int64"})

    return run


def update_index(index: DataFrame, shards: int, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """A kept index after deleting the digests of ``deleted`` and then adding ``inserted``.

    ``inserted`` has the columns of build_index's input, ``deleted`` has ``digest``.
    Deleting a digest that is not live changes nothing. Only shards are rebuilt, each in
    its own task; no text is read. Insertions are added up inside their tasks, and the
    filter settles what several tasks bring.
    """
    parts = []
    if deleted is not None:
        parts.append(deleted.select("digest", F.lit(0).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("deleted")).dropDuplicates(["digest"]))
    if inserted is not None:
        parts.append(added_in_task(inserted, OPS).withColumn("deleted", F.lit(False)))
    if not parts:
        return index
    changes = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    changes = changes.withColumn("shard", shard_of("digest", shards))
    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(_apply_changes(SHARD_KEYS), INDEX_SCHEMA)


def digest_table(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """doc_id, text_sha256 and the index key: the digest, or a prefix of it for tests of collisions."""
    rows = id_text(docs).select("doc_id", F.sha2(ascii_lower("text"), 256).alias("text_sha256"))
    return rows.withColumn("digest", F.substring(F.unhex("text_sha256"), 1, digest_bytes))


def group_copies(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null text is empty and
    equals empty text. The largest doc_id of a group stays; rows without doc_id stay only
    where no row of the group has one. Rows that repeat a doc_id count one each, and all
    of them are kept if theirs is. An empty table gives an empty result; other columns
    are ignored.
    """
    keyed = cut(digest_table(docs, digest_bytes))
    rows = keyed.count()
    out, left = [], keyed
    while rows:
        source = left.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
        index = cut(build_index(source, shards_for(rows)))
        owned = meet(left, index.select("digest", "keep_id", F.col("group_size").alias("n")), ["digest"], ["doc_id", "text_sha256"]).withColumnRenamed("n", "group_size")
        differing = cut(_differing(docs, owned.where("group_size > 1")))
        n_differing = differing.count()
        if n_differing:
            owned = owned.join(differing, owned["doc_id"].eqNullSafe(differing["other_id"]) & (owned["text_sha256"] == differing["other_sha256"]), "left_anti")
            sizes = owned.groupBy("digest").agg(F.count("*").alias("group_size"))
            owned = owned.drop("group_size").join(sizes, "digest")
            left = left.join(differing, left["doc_id"].eqNullSafe(differing["other_id"]) & (left["text_sha256"] == differing["other_sha256"]), "left_semi")
            left = cut(left)
        out.append(owned.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))
        rows = n_differing and left.count()
    if not out:
        return keyed.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def _differing(docs: DataFrame, several: DataFrame) -> DataFrame:
    """other_id, other_sha256: rows whose content is not that of the row their digest keeps.

    Texts come here by doc_id, which spreads the copies of one text. A group's members
    are then dealt over buckets of about BUCKET_ROWS, each with a copy of the kept text.
    """
    content = id_text(docs).select(F.col("doc_id").alias("content_id"), ascii_lower("text").alias("content"))
    members = several.select("digest", "doc_id", "keep_id", "text_sha256", F.ceil(F.col("group_size") / BUCKET_ROWS).cast("int").alias("buckets")).distinct()
    same_row = F.col("doc_id").eqNullSafe(F.col("content_id")) & (F.col("text_sha256") == F.sha2("content", 256))
    texts = members.join(content, same_row)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    every = F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket")
    keepers = texts.where(kept).groupBy("digest").agg(F.min("content").alias("kept_content"), F.max("buckets").alias("buckets")).select(F.col("digest").alias("kept_digest"), every, "kept_content")
    others = texts.select("digest", F.pmod(F.xxhash64("doc_id", "text_sha256"), F.col("buckets")).cast("int").alias("of"), "doc_id", "text_sha256", "content")
    met = others.join(keepers, (F.col("digest") == F.col("kept_digest")) & (F.col("of") == F.col("bucket")))
    return met.where("content <> kept_content").select(F.col("doc_id").alias("other_id"), F.col("text_sha256").alias("other_sha256")).distinct()
