"""The trajectory view over the driver's tables, in Spark and as a DuckDB common table expression.

Ten populations by the embeddings' label; documents are the reasoning, quality labels
say whether the answer matched and are unknown for most rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoframe.functions.text import fitness, length_score, word_count

#: Word bounds of the length score: the 15th and 85th percentile of the documents at sf0.01.
LENGTH_BOUNDS = (100, 651)

TRAJ_SQL = f"""
traj AS (
  SELECT e.label AS sample_id, e.vec_id AS id, e.vec_id AS pos, e.embedding, d.text AS reasoning, d.source AS source_model,
    l.quality = 1 AS exact_match, s.length_score, 1 + e.vec_id % 5 AS knowledge_score,
    CASE WHEN l.quality IS NULL THEN NULL ELSE
      (CASE WHEN l.quality = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.3::DOUBLE * s.length_score) + 0.5::DOUBLE * ((1 + e.vec_id % 5)::DOUBLE / 5.0::DOUBLE) END AS fitness
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
  JOIN (SELECT doc_id, CASE WHEN n < {LENGTH_BOUNDS[0]} THEN 0.0::DOUBLE WHEN n > {LENGTH_BOUNDS[1]} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS length_score
        FROM (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)) s ON s.doc_id = d.doc_id
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, id, pos, embedding, reasoning, source_model, exact_match, length_score, knowledge_score, fitness."""
    # Scored where texts are read, so that they are not shuffled unless asked for.
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source", length_score("text", *LENGTH_BOUNDS).alias("length_score"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "embeddings").join(documents, F.col("vec_id") == F.col("doc_id")).join(labels, "doc_id", "left")
    rows = rows.select(
        F.col("label").alias("sample_id"),
        F.col("vec_id").alias("id"),
        F.col("vec_id").alias("pos"),
        "embedding",
        F.col("text").alias("reasoning"),
        F.col("source").alias("source_model"),
        (F.col("quality") == 1).alias("exact_match"),
        "length_score",
        (1 + F.col("vec_id") % 5).alias("knowledge_score"),
    )
    return rows.withColumn("fitness", F.when(F.col("exact_match").isNotNull(), fitness("exact_match", "length_score", "knowledge_score")))


__all__ = ["LENGTH_BOUNDS", "TRAJ_SQL", "table", "traj", "word_count"]
