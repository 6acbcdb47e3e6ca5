"""Embedding cache as a table, and retrieval over neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evoframe.functions.text import cache_key

RELIABLE = 0.7


def lookup(rows: DataFrame, cache: DataFrame, model: str = "model", text: str = "text") -> DataFrame:
    """rows with ``key``, the cached ``embedding`` and ``hit``; the cache has key and embedding, one row a key."""
    held = cache.select("key", F.col("embedding").alias("_embedding"), F.lit(True).alias("_hit"))
    found = rows.drop("embedding").withColumn("key", cache_key(model, text)).join(held, "key", "left")
    return found.withColumnsRenamed({"_embedding": "embedding"}).withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def misses(rows: DataFrame, cache: DataFrame, model: str = "model", text: str = "text") -> DataFrame:
    """One row for each key that has to be embedded, however many rows ask for it."""
    keyed = rows.withColumn("key", cache_key(model, text))
    return keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def extended(cache: DataFrame, embedded: DataFrame) -> DataFrame:
    """The cache with new keys; a key that is held already keeps its value."""
    new = embedded.select(*cache.columns).join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
    return cache.unionByName(new)


def hit_rate(found: DataFrame) -> DataFrame:
    """One row: hits, misses, hit_rate (0 without a lookup) and the keys looked up."""
    hits, n = F.count_if("hit"), F.count("*")
    return found.agg(hits.alias("hits"), (n - hits).alias("misses"), F.round(F.coalesce(F.try_divide(hits, n), F.lit(0.0)), 6).alias("hit_rate"), F.count_distinct("key").alias("keys"))


def top(neighbours: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest with their similarity 1 / (1 + distance)."""
    return neighbours.where(F.col("rank") <= k).withColumn("score", F.round(1 / (1 + F.col("dist")), 6))


def formatted(found: DataFrame, text: str = "text") -> DataFrame:
    """sample_id, id, context: '1. ...' and so on, an empty line between."""
    items = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t"))))
    line = F.transform(items, lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["t"]))
    return found.groupBy("sample_id", "id").agg(F.array_join(line, "\n\n").alias("context"))


def reliable(found: DataFrame, threshold: float = RELIABLE) -> DataFrame:
    """sample_id, id, reliable: whether the first result, not the best of all, reaches the threshold."""
    first = Window.partitionBy("sample_id", "id").orderBy("rank")
    return found.withColumn("_first", F.first("score").over(first)).where("rank = 1").select("sample_id", "id", (F.col("_first") >= threshold).alias("reliable"))
