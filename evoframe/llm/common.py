"""Input shaping shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoframe.session import cut

#: A-Z and a-z for translate(): only these letters fold, whatever the locale.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Keys with more than a share of 1 / HOT_KEYS of all occurrences, and more than HOT_ROWS, are joined by a broadcast.
HOT_KEYS = 20_000
HOT_ROWS = 500
#: Characters that separate words: 0x20 and 0x09-0x0D.
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only ``doc_id`` (long) and ``text``, null text as empty, and columns named in ``more``.

    Selecting by name keeps extra columns of the input, whatever they are called,
    out of every operator's own namespace.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), *more)


def fixed_order(rows: DataFrame) -> DataFrame:
    """``rows`` with an order inside each partition that a repeated task sees again.

    Operators that number rows by partition and order rely on it. A scan has it, also
    joined with a broadcast; rows that come out of a shuffle do not, and are written once.
    """
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return cut(rows) if "Exchange" in plan.replace("BroadcastExchange", "") else rows


def unused(name: str, df: DataFrame) -> str:
    """``name``, with underscores added until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def meet(rows: DataFrame, found: DataFrame, key: list[str], spread: list[str]) -> DataFrame:
    """``rows`` joined with ``found``, which has ``key`` once each, ``n`` occurrences, and more columns.

    Keys of very many occurrences come by a broadcast; there are fewer than HOT_KEYS of
    them. Their rows are dealt by ``spread`` instead of by their key.
    """
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(total // HOT_KEYS, HOT_ROWS)
    values = F.struct(*[c for c in found.columns if c not in key])
    hot, cold = (found.where(w).select(*[F.col(k).alias(f"{name}_{k}") for k in key], values.alias(name)) for w, name in ((f"n > {limit}", "hot"), (f"n <= {limit}", "cold")))
    by = lambda side: [F.col(k) == F.col(f"{side}_{k}") for k in key]
    marked = rows.join(F.broadcast(hot), by("hot"), "left")  # fewer than HOT_KEYS rows
    place = F.when(F.col("hot").isNull(), F.xxhash64(*key)).otherwise(F.xxhash64(*spread))
    marked = marked.withColumn("_place", place)
    cold = cold.withColumn("cold_place", F.xxhash64(*[f"cold_{k}" for k in key]))
    met = marked.join(cold, [F.col("_place") == F.col("cold_place"), *by("cold")], "left")
    met = met.withColumn("met", F.coalesce("hot", "cold")).where("met IS NOT NULL")
    return met.select(*[rows[c] for c in rows.columns], "met.*")


def ascii_lower(text):
    return F.translate(text, UPPER, LOWER)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
