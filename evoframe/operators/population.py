"""Population algebra: filters, ranks, deduplication, trimming, replacement and statistics.

Order within a population is the column ``pos``; every operator that picks or reorders
says how, and rows without fitness count as the lowest where they take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_evaluated(traj: DataFrame) -> DataFrame:
    return traj.where("fitness IS NOT NULL")


def where_unevaluated(traj: DataFrame) -> DataFrame:
    return traj.where("fitness IS NULL")


def where_correct(traj: DataFrame) -> DataFrame:
    """Rows known to match; unknown is neither correct nor incorrect."""
    return traj.where(F.col("exact_match").eqNullSafe(True))


def where_incorrect(traj: DataFrame) -> DataFrame:
    return traj.where(F.col("exact_match").eqNullSafe(False))


def by_id(traj: DataFrame, id_) -> DataFrame:
    """The first row of an id."""
    return traj.where(F.col("id") == id_).orderBy("pos").limit(1)


def best(traj: DataFrame, n: int = 1) -> DataFrame:
    """The n fittest evaluated rows of each population, ties by pos, with their rank."""
    order = Window.partitionBy("sample_id").orderBy(F.desc("fitness"), "pos")
    return where_evaluated(traj).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def without_duplicates(traj: DataFrame) -> DataFrame:
    """The first row of each id in a population."""
    order = Window.partitionBy("sample_id", "id").orderBy("pos")
    return traj.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def without_lowest(traj: DataFrame, n: int | Column) -> DataFrame:
    """Each population without its n least fit rows, unevaluated first, then ties by pos.

    What stays is in ascending order of fitness and ``pos`` is renumbered from 0 to say
    so; a population that loses nothing keeps its order.
    """
    n = F.lit(n) if isinstance(n, int) else n
    order = Window.partitionBy("sample_id").orderBy(F.asc_nulls_first("fitness"), "pos")
    ranked = traj.withColumn("_nth", F.row_number().over(order)).withColumn("_cut", n)
    kept = ranked.where("_cut <= 0 OR _nth > _cut")
    return kept.withColumn("pos", F.when(F.col("_cut") > 0, (F.col("_nth") - F.col("_cut") - 1).cast("long")).otherwise(F.col("pos"))).drop("_nth", "_cut")


def replaced(traj: DataFrame, offspring: DataFrame, size: int, elite_ratio: float = 0.5) -> DataFrame:
    """The next generation: elites before offspring, one row an id, trimmed to ``size``.

    Elites are the fittest ``int(size * elite_ratio)`` rows, one at least. Offspring that
    have no fitness yet are trimmed first.
    """
    elites = best(traj, max(1, int(size * elite_ratio))).withColumn("pos", F.col("rank").cast("long") - 1).drop("rank")
    shift = 1 << 40
    joined = elites.unionByName(offspring.withColumn("pos", F.col("pos") + shift), allowMissingColumns=True)
    unique = without_duplicates(joined)
    counted = unique.withColumn("_n", F.count("*").over(Window.partitionBy("sample_id")))
    return without_lowest(counted, F.col("_n") - size).drop("_n")


def statistics(traj: DataFrame, *keys: str) -> DataFrame:
    """Per population: size, evaluated, correct, accuracy over evaluated (0 without any), average, highest and lowest fitness."""
    evaluated = F.count("fitness")
    correct = F.count_if("exact_match")
    return traj.groupBy(*(keys or ("sample_id",))).agg(
        F.count("*").alias("size"),
        evaluated.alias("evaluated"),
        correct.alias("correct"),
        F.coalesce(F.try_divide(correct, evaluated), F.lit(0.0)).alias("accuracy"),
        F.round(F.avg("fitness"), 6).alias("avg_fitness"),
        F.max("fitness").alias("max_fitness"),
        F.min("fitness").alias("min_fitness"),
    )


def history(scored: DataFrame, front: DataFrame) -> DataFrame:
    """statistics() with mean novelty and local competition and the size of the Pareto front."""
    extra = scored.groupBy("sample_id").agg(F.round(F.avg("novelty"), 6).alias("avg_novelty"), F.round(F.avg("local_competition"), 6).alias("avg_local_competition"))
    fronts = front.groupBy("sample_id").agg(F.count("*").alias("pareto_size"))
    return statistics(scored).join(extra, "sample_id").join(fronts, "sample_id", "left").na.fill(0, ["pareto_size"])


def log_statistics(traj: DataFrame) -> DataFrame:
    """Per population what the phase log holds: zeros where nothing is evaluated, length in characters."""
    evaluated = F.col("fitness").isNotNull()
    return traj.groupBy("sample_id").agg(
        F.count("*").alias("population_size"),
        F.round(F.coalesce(F.avg("fitness"), F.lit(0.0)), 6).alias("avg_fitness"),
        F.coalesce(F.max("fitness"), F.lit(0.0)).alias("max_fitness"),
        F.coalesce(F.min("fitness"), F.lit(0.0)).alias("min_fitness"),
        F.coalesce(F.try_divide(F.count_if(evaluated & F.col("exact_match")), F.count_if(evaluated)), F.lit(0.0)).alias("exact_match_rate"),
        F.round(F.avg(F.when(evaluated, F.length("reasoning"))), 6).alias("avg_reasoning_length"),
    )


def converged(traj: DataFrame, threshold: float = 1.0) -> DataFrame:
    """sample_id, converged: whether the best fitness reaches the threshold; false without any."""
    return traj.groupBy("sample_id").agg(F.coalesce(F.max("fitness") >= threshold, F.lit(False)).alias("converged"))


def run_summary(results: DataFrame) -> DataFrame:
    """One row over ``results(status, fitness)``: successful, failed, other, average and best fitness of the successful, success rate in percent."""
    ok = F.col("status") == "ok"
    return results.agg(
        F.count_if(ok).alias("successful"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.count_if(~F.col("status").isin("ok", "error")).alias("uncounted"),
        F.round(F.avg(F.when(ok, F.col("fitness"))), 6).alias("avg_fitness"),
        F.max(F.when(ok, F.col("fitness"))).alias("best_fitness"),
        F.round(F.coalesce(F.try_divide(F.count_if(ok) * 100.0, F.count("*")), F.lit(0.0)), 6).alias("success_percent"),
    )


def length_percentiles(texts: DataFrame, words: Column, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """One row: the word counts at two percentiles."""
    return texts.select(words.alias("w")).agg(F.percentile("w", low).alias("p_low"), F.percentile("w", high).alias("p_high"))


def without_row(traj: DataFrame, sample_id, id_) -> DataFrame:
    """A population without the first row that has an id; others of that id stay."""
    nth = F.row_number().over(Window.partitionBy("sample_id", "id").orderBy("pos"))
    gone = (F.col("sample_id") == F.lit(sample_id)) & (F.col("id") == F.lit(id_)) & (F.col("_nth") == 1)
    return traj.withColumn("_nth", nth).where(~F.coalesce(gone, F.lit(False))).drop("_nth")


def needing_embedding(traj: DataFrame) -> DataFrame:
    """Rows that have no embedding yet."""
    return traj.where("embedding IS NULL")


def operation_counts(children: DataFrame) -> DataFrame:
    """Per kind of variation: how many were tried and how many gave a row."""
    return children.groupBy("generation_method").agg(F.count("*").alias("tried"), F.count_if(~F.coalesce("failed", F.lit(False))).alias("successful"))
