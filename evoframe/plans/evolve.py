"""The evolution loop over all samples at once.

One DataFrame holds every sample's population; a driver loop runs per generation,
never per sample. Converged samples stop by leaving the active set. Each generation is
checkpointed once, which cuts its lineage and makes every opaque call run exactly once.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoframe.functions.draws import uniform
from evoframe.functions.text import exact_match, fitness, judge_score, length_score, reasoning_and_answer, trajectory_id
from evoframe.operators import population as P
from evoframe.operators import sampling as S
from evoframe.operators import selection as N
from evoframe.operators.corpus import CorpusIndex, retrieved
from evoframe.plans.progress import Watch
from evoframe.plans.templates import Template, described, template_prompt, template_reply, with_templates
from evoframe.plans.variation import judge_prompt, varied, with_knowledge
from evoframe.session import cut
from evoframe.sources.datasets import Run, identity_of, load_run, load_state, save_state, write_events
from evoframe.sources.embedding_cache import EmbeddingCache, embedded_once
from evoframe.sources.models import Embed, Generate, Registry, embedded, generated, offline_embed, offline_generate

MODES = (("add", 0.33), ("delete", 0.33), ("innovate", 0.34))


@dataclass(frozen=True)
class EvolutionConfig:
    generations: int = 3
    population: int = 6
    vanilla_ratio: float = 0.67
    elite_ratio: float = 0.5
    crossover_probability: float = 0.6
    neighbours: int = 5
    epsilon: float = 0.1
    threshold: float = 1.0
    length_bounds: tuple[int, int] = (1000, 4000)
    weight_length: float = 0.3
    weight_knowledge: float = 0.5
    modes: tuple[tuple[str, float], ...] = MODES
    seed: int = 42

    def __post_init__(self):
        if self.generations < 1 or self.population < 2:
            raise ValueError("at least one generation and a population of two")
        if not 0 <= self.crossover_probability <= 1 or not 0 <= self.elite_ratio <= 1:
            raise ValueError("probabilities and ratios lie in 0 to 1")
        if abs(sum(p for _, p in self.modes) - 1) > 0.01:
            raise ValueError("mode probabilities add up to 1")

    @property
    def vanilla(self) -> int:
        return int(self.population * self.vanilla_ratio)

    @property
    def parents(self) -> int:
        return max(2, int(self.population * (1 - self.elite_ratio)))


def _parsed(rows: DataFrame) -> DataFrame:
    """Replies that came through, as trajectory columns; with a column ``parser``, answers by the parser it names."""
    split = template_reply(F.col("output"), F.col("parser")) if "parser" in rows.columns else reasoning_and_answer("output")
    parts = rows.where("error IS NULL AND output IS NOT NULL").withColumn("p", split)
    named = parts.withColumn("reasoning", F.col("p.reasoning")).withColumn("answer", F.col("p.answer"))
    return named.withColumn("id", trajectory_id("query", "reasoning", "source_model")).drop("p", "output", "error", "prompt", "parser")


def _operators(rows: DataFrame, generate: Generate | Registry) -> DataFrame:
    """rows with ``operator``, the name of the model that varies them."""
    named = generate.operator_for(F.col("source_model")) if isinstance(generate, Registry) else F.col("source_model")
    return rows.withColumn("operator", named)


def initial_pool(samples: DataFrame, config: EvolutionConfig, generate: Generate | Registry, model: str = "offline", templates: Mapping[str | None, Template] | None = None) -> DataFrame:
    """``population`` draws a sample: plain ones first, then ones whose prompt holds the sample's knowledge.

    With ``templates`` samples have a column ``dataset``, which names the prompt and the
    parser of their replies.
    """
    if templates is not None:
        samples = with_templates(samples, templates)
    slots = samples.select(F.col("id").alias("sample_id"), F.coalesce("query", F.lit("")).alias("query"), F.col("answer").alias("truth"), "knowledge", *(["template"] if templates is not None else [])).withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(config.population - 1).cast("long"))))
    informed = (F.col("pos") >= config.vanilla) & F.col("knowledge").isNotNull()
    if templates is None:
        ask = F.concat(F.lit("Question:\n"), "query", F.when(informed, F.concat(F.lit("\nKnowledge:\n"), "knowledge")).otherwise(""))
    else:
        ask = template_prompt(F.col("query"), F.col("knowledge"), informed)
    ask = F.concat(ask, F.lit("\nDraw "), F.col("pos").cast("string"))
    thinker = generate.thinker_for(uniform(config.seed, "sample_id", "pos")) if isinstance(generate, Registry) else F.lit(model)
    if templates is not None:
        slots = slots.withColumn("parser", F.col("template.parser"))
    rows = slots.withColumn("prompt", ask).drop("template").withColumn("source_model", thinker).withColumn("generation_method", F.when(informed, "knowledge_augmented").otherwise("vanilla"))
    blank = {"fitness": "double", "exact_match": "boolean", "length_score": "double", "knowledge_score": "int", "embedding": "array<float>"}
    return _parsed(generated(rows, "prompt", generate, model="source_model")).withColumns({k: F.lit(None).cast(t) for k, t in blank.items()})


def evaluated(traj: DataFrame, config: EvolutionConfig, judge: Generate | None = None) -> DataFrame:
    """Rows without fitness get exact match, length score, with a judge a knowledge score, and fitness; others stay."""
    new = F.col("fitness").isNull()
    rows = traj.withColumn("exact_match", F.when(new, exact_match("answer", "truth")).otherwise(F.col("exact_match")))
    rows = rows.withColumn("length_score", F.when(new, length_score("reasoning", *config.length_bounds)).otherwise(F.col("length_score")))
    if "knowledge_score" not in rows.columns:
        rows = rows.withColumn("knowledge_score", F.lit(None).cast("int"))
    if judge is not None:
        ask = F.when(new, judge_prompt(F.col("query"), F.col("reasoning"), F.col("knowledge")))
        rows = generated(rows.withColumn("_ask", ask), "_ask", judge, out="_reply").drop("error")
        rows = rows.withColumn("knowledge_score", F.when(new & F.col("_reply").isNotNull(), judge_score("_reply")).otherwise(F.col("knowledge_score"))).drop("_ask", "_reply")
    value = fitness("exact_match", "length_score", F.col("knowledge_score").cast("double"), config.weight_length, config.weight_knowledge)
    return rows.withColumn("fitness", F.when(new, F.round(value, 6)).otherwise(F.col("fitness")))


def offspring(scored: DataFrame, config: EvolutionConfig, generate: Generate | Registry, generation: int) -> DataFrame:
    """New rows of each population, ``failed`` among them: crossover or a mutation of drawn parents.

    Parents are drawn first, then a target among them for each slot. A row whose steps
    fail is a copy of its target.
    """
    n = config.population - config.parents
    if n <= 0:
        return scored.limit(0).withColumn("failed", F.lit(False))
    seed = config.seed + 1000 * generation
    chosen = S.parents(scored, N.pareto_front(scored), config.parents, seed + 4, config.epsilon)
    pairs = S.offspring_pairs(chosen, scored, n, seed, config.epsilon)
    target = scored.select("sample_id", F.col("id").alias("target_id"), "query", "truth", "knowledge", "source_model", "reasoning", "answer", "exact_match").dropDuplicates(["sample_id", "target_id"])
    provider = scored.select("sample_id", F.col("id").alias("provider_id"), F.col("reasoning").alias("other")).dropDuplicates(["sample_id", "provider_id"])
    rows = pairs.join(target, ["sample_id", "target_id"]).join(provider, ["sample_id", "provider_id"])
    route = S.crossover_route(uniform(seed + 2, "sample_id", "slot"), F.col("exact_match"), config.crossover_probability)
    mode = S.choice(uniform(seed + 3, "sample_id", "slot"), list(config.modes))
    rows = rows.withColumn("generation_method", F.when(route == "crossover", route).otherwise(F.concat(F.lit("mutation_"), mode)))
    replies = varied(cut(_operators(rows, generate)), generate)
    made = ~F.col("failed")
    out = replies.select(
        "sample_id",
        "query",
        "truth",
        "knowledge",
        F.when(made, F.col("operator")).otherwise(F.col("source_model")).alias("source_model"),
        F.col("slot").cast("long").alias("pos"),
        F.when(made, F.col("new_reasoning")).otherwise(F.col("reasoning")).alias("reasoning"),
        F.when(made, F.col("new_answer")).otherwise(F.col("answer")).alias("answer"),
        F.when(made, F.col("generation_method")).otherwise(F.lit("copy")).alias("generation_method"),
        F.struct(F.array("target_id", "provider_id").alias("parents"), "target_bp", "provider_bp", "diagnosis").alias("meta"),
        "failed",
    )
    return out.withColumn("id", trajectory_id("query", "reasoning", "source_model"))


def _history(current: DataFrame, scored: DataFrame | None) -> DataFrame:
    """Statistics of every population, with novelty, competition and front size of those still active."""
    rows = P.statistics(current)
    if scored is None:
        return rows.withColumns({"avg_novelty": F.lit(None).cast("double"), "avg_local_competition": F.lit(None).cast("double"), "pareto_size": F.lit(None).cast("long")})
    extra = P.history(scored, N.pareto_front(scored)).select("sample_id", "avg_novelty", "avg_local_competition", "pareto_size")
    return rows.join(extra, "sample_id", "left")


def evolve(
    samples: DataFrame,
    config: EvolutionConfig | None = None,
    generate: Generate | Registry = offline_generate,
    embed: Embed = offline_embed,
    snapshots: str | None = None,
    judge: Generate | None = None,
    events: str | None = None,
    resume: bool = False,
    cache: EmbeddingCache | None = None,
    embed_model: str = "offline",
    corpus: CorpusIndex | None = None,
    fill_knowledge: bool = False,
    templates: Mapping[str | None, Template] | None = None,
    watch: Watch | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(best, history): the fittest trajectory of each sample, and statistics by generation.

    ``samples`` has id, query, answer and knowledge. The last generation's offspring are
    not evaluated, and so never the answer; elites keep the best fitness from falling.
    With ``snapshots`` every generation's state is kept there, and ``resume`` goes on from
    the last complete one of the same samples and configuration; a state of others is an
    error. With ``events`` each phase writes its log rows there, by run and generation.
    With ``cache`` each (embed_model, text) is embedded once over all runs that share it.
    Samples without knowledge get it before the pool is drawn: from ``corpus`` where
    retrieval is reliable, else, with ``fill_knowledge``, from the generator. ``templates``
    give the first prompts and parsers by the samples' ``dataset``. ``watch`` is told the
    phase, and the samples that have come to their end.
    """
    config = config or EvolutionConfig()
    spark = samples.sparkSession
    run = Run.new(identity_of(samples, asdict(config) | ({"templates": described(templates)} if templates is not None else {})) if snapshots else {})
    held = None
    if resume and snapshots:
        found = load_run(spark, snapshots, run.identity)
        if found is not None:
            run, held = found[0], load_state(spark, snapshots, run.identity)

    def log(rows: DataFrame, phase: str, generation: int) -> None:
        if events is not None:
            write_events(rows, phase, generation, run, events)

    def step(phase: str, finished: DataFrame | None = None) -> None:
        if watch is not None:
            watch.phase = phase
            if finished is not None:
                watch.completed += finished.select("sample_id").distinct().count()

    if watch is not None and not watch.total:
        watch.total = samples.count()
    step("initial")
    done: list[DataFrame] = []
    history: list[DataFrame] = []
    if held is None:
        if corpus is not None or fill_knowledge:
            found = retrieved(samples, corpus) if corpus is not None else None
            found = None if found is None else found.withColumnRenamed("id", "doc").withColumnRenamed("query", "id")
            samples = cut(with_knowledge(samples, generate if fill_knowledge else None, found))
        current, begun = cut(initial_pool(samples, config, generate, templates=templates)), 0
        log(current, "initial", 0)
    else:
        current, finished, before, begun = held
        current = cut(current.withColumn("embedding", F.lit(None).cast("array<float>")))
        done.append(finished)
        history.append(before)
        step("resumed", finished)
    for generation in range(begun + 1, config.generations + 1):
        step(f"evaluation {generation}")
        current = cut(evaluated(current, config, judge))
        log(current, "evaluation", generation)
        state = P.converged(current, config.threshold)
        finished = current.join(state.where("converged").select("sample_id"), "sample_id", "left_semi")
        log(finished, "early_stop", generation)
        done.append(finished)
        step(f"selection {generation}", finished)
        active = current.join(state.where("NOT converged").select("sample_id"), "sample_id", "left_semi")
        if active.isEmpty():
            current = active
            history.append(_history(done[-1], None).withColumn("generation", F.lit(generation)))
            if snapshots:
                save_state(run, current, finished, history[-1], snapshots, generation)
            break
        vectors = embedded(active, "reasoning", embed) if cache is None else embedded_once(active, "reasoning", embed, cache, embed_model)
        scored = cut(N.scores(vectors, config.neighbours))
        history.append(cut(_history(current, scored).withColumn("generation", F.lit(generation))))
        step(f"variation {generation}")
        children = cut(offspring(scored, config, generate, generation))
        for phase, method in (("crossover", "crossover%"), ("mutation", "mutation%"), ("error", "copy")):
            log(children.where(F.col("generation_method").like(method)), phase, generation)
        new = children.drop("meta", "failed")
        current = cut(P.replaced(scored.drop("novelty", "local_competition"), new, config.population, config.elite_ratio))
        log(current, "new_generation", generation)
        if snapshots:
            save_state(run, current, finished, history[-1], snapshots, generation)
    last = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*done, current])
    best = cut(P.best(last, 1).drop("rank"))
    log(best, "final_best", config.generations)
    if watch is not None:
        watch.phase, watch.completed = "over", watch.total
    return best, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), history)
