"""Command line: evolve the samples of a dataset and write the best trajectory of each."""

from __future__ import annotations

import argparse
import contextlib
import json
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoframe.config import config_from_file, models_from_file, read_mapping
from evoframe.functions.text import combined, truncated, word_count
from evoframe.operators.corpus import build_index
from evoframe.operators.population import run_summary
from evoframe.plans.evolve import evolve
from evoframe.plans.progress import Progress, Watch
from evoframe.plans.templates import templates_from
from evoframe.session import cut, local_session
from evoframe.sources.datasets import Catalog, write_results
from evoframe.sources.embedding_cache import EmbeddingCache
from evoframe.sources.models import HttpEmbedder, offline_embed, offline_generate, with_environment
from evoframe.streaming.token_bucket import limited


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__)
    out.add_argument("--dataset", required=True)
    out.add_argument("--catalog", default="config/datasets.json", help="JSON or YAML file that names datasets")
    out.add_argument("--max-samples", type=int, default=-1)
    out.add_argument("--config", help="JSON file of evolution parameters, under 'evolution' or at its root")
    out.add_argument("--models", help="JSON or YAML catalog of models; without it the offline ones")
    out.add_argument("--use-knowledge-judge", action="store_true", help="let the first model rate the use of knowledge")
    out.add_argument("--lambda-knowledge", type=float, help="weight of that rating, if not the configuration's")
    out.add_argument("--resume", action="store_true", help="go on from the last complete generation")
    out.add_argument("--split", choices=("train", "test"), default="train")
    out.add_argument("--output-dir", default="outputs")
    out.add_argument("--embedding-cache", help="folder of embeddings that all runs share")
    out.add_argument("--embedder", help="JSON or YAML file with model, base_url and api_key; without it the offline one")
    out.add_argument("--corpus", help="Parquet with id and text, or content, to retrieve knowledge from")
    out.add_argument("--no-knowledge", action="store_true", help="leave samples without knowledge as they are")
    out.add_argument("--requests-per-minute", type=float, help="of generation, dealt over the tasks that call")
    out.add_argument("--templates", help="JSON or YAML file of prompts and parsers by dataset")
    out.add_argument("--progress", type=float, metavar="SECONDS", help="report samples, phase and tasks to the error stream at this interval")
    out.add_argument("--lambda-length", type=float, help="weight of the length score, if not the configuration's")
    return out


def result_rows(samples: DataFrame, best: DataFrame) -> DataFrame:
    """One row a sample: its best trajectory, or status 'error' where nothing was evaluated."""
    found = best.select(F.col("sample_id").alias("id"), F.col("answer").alias("best_answer"), "reasoning", "fitness", "source_model", "generation_method")
    rows = samples.join(found, "id", "left")
    return rows.select(
        F.col("id").alias("sample_id"),
        "task",
        truncated("query").alias("query"),
        F.col("answer").alias("ground_truth"),
        "best_answer",
        F.col("fitness").alias("best_fitness"),
        word_count("reasoning").alias("best_reasoning_length"),
        "source_model",
        "generation_method",
        combined("reasoning", "best_answer").alias("full_output"),
        F.when(F.col("fitness").isNotNull(), "ok").otherwise("error").alias("status"),
        F.lit(datetime.now(UTC).isoformat()).alias("timestamp"),
    )


def report(state: Progress) -> None:
    """A line of progress on the error stream."""
    print(f"{state.phase}: {state.completed} of {state.total} samples, {state.tasks_done} of {state.tasks} tasks, {state.seconds:.0f} s", file=sys.stderr)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 once the run is over, even if samples failed; 1 for an unknown dataset or a failed run."""
    options = parser().parse_args(arguments)
    spark = spark or local_session()
    try:
        catalog = Catalog.from_file(options.catalog)
        dataset = catalog.get(options.dataset)
        samples = cut(catalog.load(spark, options.dataset, options.max_samples, options.split))
        config = config_from_file(options.config, length_bounds=dataset.percentiles, weight_length=options.lambda_length, weight_knowledge=options.lambda_knowledge)
        models = models_from_file(options.models) if options.models else None
        send = models or offline_generate
        if options.requests_per_minute:
            send = limited(send, options.requests_per_minute, spark.sparkContext.defaultParallelism)
        embed, embed_model = offline_embed, "offline"
        if options.embedder:
            held = {k: with_environment(v) for k, v in read_mapping(options.embedder).items()}
            embed, embed_model = HttpEmbedder(**held), held["model"]
        cache = EmbeddingCache(spark, options.embedding_cache) if options.embedding_cache else None
        corpus = build_index(spark.read.parquet(options.corpus)) if options.corpus else None
        judge = (models.get(models.names()[0]) if models else offline_generate) if options.use_knowledge_judge else None
        state = f"{options.output_dir}/{options.dataset}/state"
        templates = templates_from(read_mapping(options.templates)) if options.templates else None
        watch = Watch(spark, report, interval=options.progress) if options.progress else None
        with watch or contextlib.nullcontext():
            best, history = evolve(
                samples.withColumn("dataset", F.lit(options.dataset)), config, send, embed, snapshots=state, judge=judge, events=f"{options.output_dir}/{options.dataset}/events",
                resume=options.resume, cache=cache, embed_model=embed_model, corpus=corpus, fill_knowledge=not options.no_knowledge, templates=templates, watch=watch,
            )
        results = cut(result_rows(samples, best))
        write_results(results, f"{options.output_dir}/{options.dataset}/results")
        history.write.mode("overwrite").json(f"{options.output_dir}/{options.dataset}/history")
        print(json.dumps(run_summary(results.select("status", F.col("best_fitness").alias("fitness"))).first().asDict()))
    except (ValueError, FileNotFoundError) as error:
        print(f"error: {error}")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
