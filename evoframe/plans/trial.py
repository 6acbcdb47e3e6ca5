"""A plainer loop for trials: the fittest stay, wrong ones are renewed, the rest is filled with enriched ones.

Nothing is drawn. As in the full loop one DataFrame holds all samples' populations, and
the driver loops over generations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.functions.text import clean_answer, fitness, length_score, strip, trajectory_id
from evoframe.operators import population as P
from evoframe.plans.variation import varied
from evoframe.session import cut
from evoframe.sources.models import Generate, Registry


@dataclass(frozen=True)
class TrialConfig:
    generations: int = 3
    population: int = 6
    elite_ratio: float = 0.3
    threshold: float = 1.0
    length_bounds: tuple[int, int] = (50, 300)
    weight_length: float = 0.3
    weight_knowledge: float = 0.5

    def __post_init__(self):
        if self.generations < 1 or self.population < 2:
            raise ValueError("at least one generation and a population of two")

    @property
    def elites(self) -> int:
        return max(2, int(self.population * self.elite_ratio))


def trial_match(answer, truth) -> Column:
    """A clean answer against the truth as it is written, both stripped and in lower case."""
    return F.coalesce(F.lower(strip(clean_answer(answer))) == F.lower(strip(truth)), F.lit(False))


def trial_fitness(exact: Column, reasoning, knowledge, config: TrialConfig) -> Column:
    """Fitness whose knowledge part is all or nothing: all where there is knowledge and any reasoning."""
    text, known = (F.col(x) if isinstance(x, str) else x for x in (reasoning, knowledge))
    used = (F.coalesce(F.length(known), F.lit(0)) > 0) & (F.coalesce(F.length(strip(text)), F.lit(0)) > 0)
    value = fitness(exact, length_score(text, *config.length_bounds), F.when(used, 5.0).otherwise(0.0), config.weight_length, config.weight_knowledge)
    return F.round(value, 6)


def tried(traj: DataFrame, config: TrialConfig) -> DataFrame:
    """Every row with exact_match and fitness; both depend on the row alone."""
    rows = traj.withColumn("exact_match", trial_match("answer", "truth"))
    return rows.withColumn("fitness", trial_fitness(F.col("exact_match"), "reasoning", "knowledge", config))


def elites(scored: DataFrame, config: TrialConfig) -> DataFrame:
    """The fittest of each population, ties by pos, with their ``rank`` from 1 and their number ``n``."""
    kept = P.best(scored, config.elites)
    return kept.withColumn("n", F.count("*").over(Window.partitionBy("sample_id")))


def _children(rows: DataFrame, generate: Generate | Registry, method: str) -> DataFrame:
    """rows, elites with ``slot``, after the steps of one kind of variation."""
    named = generate.operator_for(F.col("source_model")) if isinstance(generate, Registry) else F.col("source_model")
    asked = rows.select("sample_id", "slot", "query", "truth", "knowledge", "source_model", "reasoning", "answer", F.lit(None).cast("string").alias("other"), F.lit(method).alias("generation_method"), named.alias("operator"))
    return cut(varied(cut(asked), generate))


def trial_offspring(parents: DataFrame, config: TrialConfig, generate: Generate | Registry) -> DataFrame:
    """Up to ``population - elites`` rows a sample, in the order of ``pos``.

    The first half of the elites is renewed where the answer is wrong; a renewal that fails
    leaves no row. Slots still free go round the elites, enriched; where that fails the
    elite is copied, as method ``selection``.
    """
    free = config.population - config.elites
    wrong = parents.where((F.col("rank") <= config.elites // 2) & ~F.col("exact_match"))
    renewed = _children(wrong.withColumn("slot", F.col("rank")), generate, "mutation_innovate").where("NOT failed")
    renewed = renewed.withColumn("slot", F.row_number().over(Window.partitionBy("sample_id").orderBy("slot")) - 1).where(F.col("slot") < free)
    made = renewed.groupBy("sample_id").agg(F.count("*").alias("_made"))
    slots = parents.where("rank = 1").select("sample_id", "n").join(made, "sample_id", "left").withColumn("_made", F.coalesce("_made", F.lit(0)))
    slots = slots.where(F.col("_made") < free).withColumn("slot", F.explode(F.sequence(F.col("_made").cast("int"), F.lit(free - 1)))) if free > 0 else slots.limit(0).withColumn("slot", F.lit(0))
    slots = slots.select("sample_id", "slot", (F.col("slot") % F.col("n") + 1).cast("int").alias("rank"))
    filled = _children(slots.join(parents, ["sample_id", "rank"]), generate, "mutation_add")
    columns = ["sample_id", "slot", "query", "truth", "knowledge"]
    made_, kept = ~F.col("failed"), F.col("failed")
    out = renewed.unionByName(filled).select(
        *columns,
        F.when(made_, F.col("operator")).otherwise(F.col("source_model")).alias("source_model"),
        F.when(made_, F.col("new_reasoning")).otherwise(F.col("reasoning")).alias("reasoning"),
        F.when(made_, F.col("new_answer")).otherwise(F.col("answer")).alias("answer"),
        F.when(kept, F.lit("selection")).otherwise(F.col("generation_method")).alias("generation_method"),
    )
    return out.withColumn("id", trajectory_id("query", "reasoning", "source_model")).withColumn("pos", (F.col("slot") + config.elites).cast("long")).drop("slot")


def trial(pool: DataFrame, generate: Generate | Registry, config: TrialConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(best, history): the fittest row of each sample, and statistics() by generation.

    ``pool`` has sample_id, pos, id, query, truth, knowledge, source_model, reasoning,
    answer and generation_method; of larger populations the first rows by pos take part. A
    sample whose best reaches the threshold goes no further. Offspring of the last
    generation are evaluated too. An empty pool gives no rows.
    """
    config = config or TrialConfig()
    columns = ["sample_id", "pos", "id", "query", "truth", "knowledge", "source_model", "reasoning", "answer", "generation_method"]
    first = Window.partitionBy("sample_id").orderBy("pos", "id")
    current = pool.select(*columns).withColumn("pos", (F.row_number().over(first) - 1).cast("long")).where(F.col("pos") < config.population)
    current = cut(tried(current, config))
    done, history = None, None
    add = lambda held, rows: rows if held is None else held.unionByName(rows)
    for generation in range(1, config.generations + 1):
        history = add(history, P.statistics(current).withColumn("generation", F.lit(generation)))
        state = P.converged(current, config.threshold)
        done = add(done, P.best(current.join(state.where("converged").select("sample_id"), "sample_id", "left_semi"), 1))
        active = cut(current.join(state.where("NOT converged").select("sample_id"), "sample_id", "left_semi"))
        if active.isEmpty():
            current = active
            break
        parents = cut(elites(active, config))
        children = trial_offspring(parents, config, generate)
        kept = parents.withColumn("pos", (F.col("rank") - 1).cast("long")).drop("rank", "n")
        current = cut(kept.unionByName(tried(children, config)))
    best = cut(add(done, P.best(current, 1)).drop("rank"))
    return best, history


def trial_summary(best: DataFrame) -> DataFrame:
    """One row: samples, average and highest fitness, and how many answers are the truth as written, in any case, also in percent (0 without samples)."""
    equal = F.count_if(F.lower("answer") == F.lower("truth"))
    return best.agg(
        F.count("*").alias("samples"),
        F.round(F.avg("fitness"), 6).alias("avg_fitness"),
        F.max("fitness").alias("max_fitness"),
        equal.alias("exact_matches"),
        F.round(F.coalesce(F.try_divide(equal * 100.0, F.count("*")), F.lit(0.0)), 6).alias("exact_match_percent"),
    )
