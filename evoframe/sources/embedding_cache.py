"""A cache of embeddings that outlives a run: parts bucketed by key, named by versioned manifests.

A part is a folder of Parquet files bucketed by key; a manifest names the parts of a
version and is created once, never replaced. Whoever adds keys writes a part of its own
and then creates the next manifest; if another writer was first, its keys are left out
and the part is written anew. A part that no manifest names is never read, so a lost
executor, driver or writer leaves the cache as it was. Lookups deal their rows by key
into as many buckets and meet each part as it lies, without a shuffle of the cache.

Creating a file only if it is not there has to be atomic, as on a local or HDFS path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoframe.functions.text import cache_key
from evoframe.session import cut, remove_folder
from evoframe.sources.files import names, qualified, read_json, write_json
from evoframe.sources.models import Embed, embedded

BUCKETS = 32
#: Parts beyond which an addition merges them into one.
MERGE_PARTS = 8
_COLUMNS = "key STRING, embedding ARRAY<FLOAT>"


class EmbeddingCache:
    """Embeddings by SHA-256 of ``model:text`` under ``path``, one row a key over all parts."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, merge_parts: int = MERGE_PARTS):
        self.spark, self.path, self.merge_parts = spark, qualified(spark, path), merge_parts
        held = self._manifest()[1]
        self.buckets = held["buckets"] if held else buckets

    def _manifest(self) -> tuple[int, dict | None]:
        """The last version number taken, and the newest manifest that is whole."""
        found = [n for n in names(self.spark, f"{self.path}/manifests") if n.endswith(".json") and not n.startswith(".")]
        for name in reversed(found):
            held = read_json(self.spark, f"{self.path}/manifests/{name}")
            if held is not None:
                return int(found[-1][:-5]), held
        return int(found[-1][:-5]) if found else 0, None

    def parts(self) -> list[str]:
        held = self._manifest()[1]
        return held["parts"] if held else []

    def _commit(self, version: int, parts: list[str]) -> bool:
        return write_json(self.spark, f"{self.path}/manifests/{version:012d}.json", {"buckets": self.buckets, "parts": parts}, overwrite=False)

    def _table(self, part: str) -> DataFrame:
        """A part as an external bucketed table; the session's catalog only learns where it lies."""
        name = f"evoframe_cache_{part}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({_COLUMNS}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/parts/{part}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> str:
        part = uuid.uuid4().hex
        dealt = rows.select("key", F.col("embedding").cast("array<float>").alias("embedding")).repartition(self.buckets, "key")
        dealt.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path}/parts/{part}").saveAsTable(f"evoframe_cache_{part}")
        return part

    def _remove(self, parts: list[str]) -> None:
        for part in parts:
            self.spark.sql(f"DROP TABLE IF EXISTS evoframe_cache_{part}")
            remove_folder(self.spark, f"{self.path}/parts/{part}")

    def read(self) -> DataFrame:
        """key, embedding of the newest version."""
        out = self.spark.createDataFrame([], _COLUMNS)
        for part in self.parts():
            out = out.unionByName(self._table(part))
        return out

    def lookup(self, rows: DataFrame, model: str = "model", text: str = "text") -> DataFrame:
        """rows with ``key``, the cached ``embedding`` and ``hit``; a null text or model has no key and is no hit."""
        found = rows.drop("key", "embedding", "hit").withColumn("key", cache_key(model, text)).withColumn("embedding", F.lit(None).cast("array<float>"))
        for part in self.parts():
            held = self._table(part).select(F.col("key").alias("_key"), F.col("embedding").alias("_held"))
            found = found.join(held, F.col("key") == F.col("_key"), "left").withColumn("embedding", F.coalesce("embedding", "_held")).drop("_key", "_held")
        return found.withColumn("hit", F.col("embedding").isNotNull())

    def add(self, rows: DataFrame) -> int:
        """Keep the keys of ``rows(key, embedding)`` that are not held yet; the number of those.

        A key that comes twice is kept once; null keys and embeddings are left out.
        """
        given = cut(rows.where("key IS NOT NULL AND embedding IS NOT NULL").select("key", "embedding").dropDuplicates(["key"]))
        while True:
            version, held = self._manifest()
            parts = held["parts"] if held else []
            new = given
            for part in parts:
                new = new.join(self._table(part).select("key"), "key", "left_anti")
            new = cut(new)
            n = new.count()
            if not n:
                return 0
            part = self._write(new)
            if self._commit(version + 1, [*parts, part]):
                break
            self._remove([part])  # another writer was first
        if len(parts) >= self.merge_parts:
            self.compact()
        return n

    def compact(self) -> bool:
        """One part in place of all; False if another writer was first, which changes nothing."""
        version, held = self._manifest()
        if held is None or len(held["parts"]) < 2:
            return False
        part = self._write(self.read())
        if not self._commit(version + 1, [part]):
            self._remove([part])
            return False
        self._remove(held["parts"])
        return True

    def clear(self) -> None:
        """Commit an empty version, then delete the files of those before; lookups that run meanwhile fail."""
        while True:
            version, held = self._manifest()
            if self._commit(version + 1, []):
                break
        self._remove(held["parts"] if held else [])


def embedded_once(rows: DataFrame, text: str, embed: Embed, cache: EmbeddingCache, model: str) -> DataFrame:
    """rows with ``embedding``: held ones from the cache, each other (model, text) embedded once and kept there.

    Rows that have an embedding keep it and are not looked up. A text whose call fails has
    a null one, which is not kept.
    """
    held = rows.where("embedding IS NOT NULL") if "embedding" in rows.columns else None
    asked = rows if held is None else rows.where("embedding IS NULL")
    found = cut(cache.lookup(asked.drop("embedding").withColumn("_model", F.lit(model)).withColumn("_text", F.coalesce(text, F.lit(""))), "_model", "_text"))
    new = cut(embedded(found.where("NOT hit").select("key", "_text").dropDuplicates(["key"]), "_text", embed).drop("_text"))
    cache.add(new)
    new = new.select(F.col("key").alias("_key"), F.col("embedding").alias("_new"))
    out = found.join(new, F.col("key") == F.col("_key"), "left").withColumn("embedding", F.coalesce("embedding", "_new"))
    out = out.drop("_key", "_new", "_model", "_text", "key", "hit")
    return out if held is None else held.unionByName(out)
