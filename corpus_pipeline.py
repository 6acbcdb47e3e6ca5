"""A training-data pipeline: toxicity, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and
all but the last return the columns of ``docs``, whatever further ones there are. Rows
keep their doc_id, null ones too; a null text counts as empty and stays null until it is
packed; tables without rows pass through empty; very long texts are read whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoframe.llm import exact_dedup, near_dedup, packing, pii, toxicity
from evoframe.llm.common import ascii_lower, quoted, read, unused
from evoframe.session import checkpoints_released, cut, remove_folder, use_checkpoint_dir

#: No SQL expresses the learned stages; tests hold every stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of these documents, rejects go."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, a row without doc_id only if none has one.

    Of rows with the same doc_id and equal texts, the one stays whose columns have the least hash as JSON.
    """
    groups = cut(exact_dedup.group_copies(docs).where("kept").select("doc_id", "text_sha256"))
    id_, sha = unused("kept_id", docs), unused("kept_sha", docs)
    same = lambda d, k: d["doc_id"].cast("long").eqNullSafe(k[id_]) & (F.sha2(ascii_lower(F.coalesce(d["text"], F.lit(""))), 256) == k[sha])
    counted = cut(groups.groupBy(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).agg(F.count("*").alias("n")))
    single, several = (counted.where(w).select(id_, sha) for w in ("n = 1", "n > 1"))
    out = docs.join(single, same(docs, single), "left_semi")
    if several.isEmpty():
        return out
    again = docs.join(several, same(docs, several))
    one = again.groupBy(id_, sha).agg(F.min_by(F.struct(*[docs[quoted(c)] for c in docs.columns]), F.xxhash64(F.to_json(F.struct(*[docs[quoted(c)] for c in docs.columns])))).alias("row"))
    return out.unionByName(one.select("row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays.

    Rows without doc_id are in no group and stay. Rows that repeat a doc_id share its fate.
    """
    id_ = unused("kept_id", docs)
    kept = near_dedup.near_groups(docs).where("kept").select(F.col("doc_id").alias(id_))
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept[id_]), "left_semi")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind; n_chars, where there is one, follows the text."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its sequence and place."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again.

    A stage's checkpoints go once it is written, and its predecessor's folder with them;
    the folder of the last stage is the result's and stays.
    """
    folder = f"{use_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with checkpoints_released(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return docs
