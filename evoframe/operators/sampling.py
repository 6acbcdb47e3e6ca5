"""Sampling and routing with reproducible draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.functions.draws import uniform

#: Probability that two sums of the same weights, added in other orders, still agree on.
PLACES = 9


def probabilities(front: DataFrame, epsilon: float = 0.1, weight: str = "local_competition") -> DataFrame:
    """front with p, low and high: p proportional to weight + epsilon within a population, null weight as 0.

    [low, high) are adjoining intervals in order of ``pos``; a population whose weights
    are all 0 is uniform.
    """
    every = Window.partitionBy("sample_id")
    upto = every.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    raw = F.coalesce(F.col(weight), F.lit(0.0)) + F.lit(epsilon)
    rows = front.withColumn("_w", raw).withColumn("_sum", F.sum("_w").over(every)).withColumn("_n", F.count("*").over(every))
    rows = rows.withColumn("p", F.when(F.col("_sum") > 0, F.col("_w") / F.col("_sum")).otherwise(F.lit(1.0) / F.col("_n")))
    rows = rows.withColumn("high", F.round(F.sum("p").over(upto), PLACES)).withColumn("p", F.round("p", PLACES))
    low = F.lag("high", 1, 0.0).over(every.orderBy("pos"))
    last = F.row_number().over(every.orderBy(F.desc("pos"))) == 1
    return rows.withColumn("low", low).withColumn("high", F.when(last, F.lit(1.0)).otherwise(F.col("high"))).drop("_w", "_sum", "_n")


def with_replacement(front: DataFrame, n: int, seed: int, epsilon: float = 0.1, weight: str = "local_competition") -> DataFrame:
    """n draws a population: sample_id, slot, id. A row may be drawn again.

    Each slot's uniform number falls in one row's interval; slots and rows meet on the
    population and the interval.
    """
    ranges = probabilities(front, epsilon, weight).select("sample_id", "id", "low", "high")
    slots = ranges.select("sample_id").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else ranges.select("sample_id").limit(0).withColumn("slot", F.lit(0))
    drawn = slots.withColumn("u", uniform(seed, "sample_id", "slot"))
    return drawn.join(ranges, "sample_id").where("u >= low AND u < high").select("sample_id", "slot", "id")


def without_replacement(rows: DataFrame, n: int, seed: int, weight: Column | None = None) -> DataFrame:
    """n rows of each population, uniform or by weight; smaller populations whole.

    Weighted: the n smallest of -ln(u) / weight, after Efraimidis and Spirakis. Weights
    of 0 or less come last.
    """
    u = uniform(seed, "sample_id", "id")
    key = u if weight is None else F.when(weight > 0, F.round(-F.log(u + F.lit(1e-12)) / weight, PLACES)).otherwise(F.lit(float("inf")))
    order = Window.partitionBy("sample_id").orderBy("_key", "pos")
    return rows.withColumn("_key", key).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n).drop("_key", "_nth")


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """rows with ``pos`` renumbered from 0 in a random order of their own population."""
    order = Window.partitionBy("sample_id").orderBy(uniform(seed, "sample_id", "id"), "id", "pos")
    return rows.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


def choice(u: Column, weighted: list[tuple[str, float]]) -> Column:
    """One of several names by the inverse of their cumulative distribution; the last takes what rounding leaves."""
    total, out = 0.0, None
    for name, p in weighted[:-1]:
        total = round(total + p, 12)
        out = F.when(u < total, F.lit(name)) if out is None else out.when(u < total, F.lit(name))
    return F.lit(weighted[-1][0]) if out is None else out.otherwise(F.lit(weighted[-1][0]))


def crossover_route(u: Column, exact_match: Column, probability: float) -> Column:
    """'crossover' for known mismatches below the probability, else 'mutation'; unknown goes to mutation."""
    return F.when((u < probability) & exact_match.eqNullSafe(False), F.lit("crossover")).otherwise(F.lit("mutation"))


def parent_pairs(front: DataFrame, population: DataFrame, n: int, seed: int, epsilon: float = 0.1) -> DataFrame:
    """sample_id, slot, target_id, provider_id: targets drawn by weight, providers uniformly from the whole population."""
    targets = with_replacement(front, n, seed, epsilon).withColumnRenamed("id", "target_id")
    return with_providers(targets, population, seed + 1)


def parents(scored: DataFrame, front: DataFrame, n: int, seed: int, epsilon: float = 0.1) -> DataFrame:
    """n parents of each population: sample_id, slot, id, weight.

    A population of n rows or fewer gives all of them, in order and without weight. Else
    parents are drawn from its front with replacement, by local competition; where the
    front is empty, n different members are drawn uniformly. Weight is the row's local
    competition, null if it has none.
    """
    every = Window.partitionBy("sample_id")
    rows = scored.select("sample_id", "id", "pos", "local_competition").withColumn("_size", F.count("*").over(every))
    small = rows.where(F.col("_size") <= n).withColumn("slot", (F.row_number().over(every.orderBy("pos")) - 1).cast("int"))
    small = small.select("sample_id", "slot", "id", F.lit(None).cast("double").alias("weight"))
    large = rows.where(F.col("_size") > n)
    fronted = front.join(large.select("sample_id").distinct(), "sample_id", "left_semi")
    drawn = with_replacement(fronted, n, seed, epsilon)
    drawn = drawn.join(rows.select("sample_id", "id", F.col("local_competition").alias("weight")).dropDuplicates(["sample_id", "id"]), ["sample_id", "id"]).select("sample_id", "slot", "id", "weight")
    rest = large.join(fronted.select("sample_id").distinct(), "sample_id", "left_anti")
    order = every.orderBy(uniform(seed, "sample_id", "id"), "id", "pos")
    rest = rest.withColumn("slot", (F.row_number().over(order) - 1).cast("int")).where(F.col("slot") < n).select("sample_id", "slot", "id", F.col("local_competition").alias("weight"))
    return small.unionByName(drawn).unionByName(rest)


def offspring_pairs(chosen: DataFrame, population: DataFrame, n: int, seed: int, epsilon: float = 0.1) -> DataFrame:
    """sample_id, slot, target_id, provider_id: n targets drawn among the parents, providers uniformly from everyone.

    Targets are drawn by weight if the first parent has one, else uniformly; a parent that
    was drawn twice counts twice. Providers may equal their targets.
    """
    first = F.first("weight").over(Window.partitionBy("sample_id").orderBy("slot"))
    rows = chosen.withColumn("_first", first).withColumn("pos", F.col("slot").cast("long"))
    rows = rows.withColumn("weight", F.when(F.col("_first").isNotNull(), F.col("weight")).otherwise(F.lit(0.0)))
    rows = rows.select("sample_id", F.col("slot").cast("long").alias("id"), "pos", "weight", F.col("id").alias("target_id"))
    drawn = with_replacement(rows, n, seed, epsilon, "weight").withColumnRenamed("id", "_parent")
    targets = drawn.join(rows.select("sample_id", F.col("id").alias("_parent"), "target_id"), ["sample_id", "_parent"])
    return with_providers(targets.select("sample_id", "slot", "target_id"), population, seed + 1)


def with_providers(targets: DataFrame, population: DataFrame, seed: int) -> DataFrame:
    """sample_id, slot, target_id, provider_id: to each slot a member of its population, drawn uniformly."""
    order = Window.partitionBy("sample_id").orderBy("pos")
    numbered = population.select("sample_id", F.col("id").alias("provider_id"), (F.row_number().over(order) - 1).alias("_nth"))
    sizes = population.groupBy("sample_id").agg(F.count("*").alias("_n"))
    pick = F.floor(uniform(seed, "sample_id", "slot") * F.col("_n")).cast("int")
    return targets.join(sizes, "sample_id").withColumn("_nth", pick).join(numbered, ["sample_id", "_nth"]).select("sample_id", "slot", "target_id", "provider_id")
