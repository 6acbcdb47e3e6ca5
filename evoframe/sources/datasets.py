"""Dataset catalog, question datasets from JSON, and result sinks."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evoframe.session import cut
from evoframe.sources.files import names, read_json, write_json

#: Length bounds of a dataset that names none (fixed values).
DEFAULT_PERCENTILES = (1000, 4000)


@dataclass(frozen=True)
class Dataset:
    name: str
    train_path: str = ""
    test_path: str = ""
    format: str = "json"
    percentiles: tuple[int, int] = DEFAULT_PERCENTILES
    system_prompt: str = ""
    tasks: dict[str, str] = field(default_factory=dict)


class Catalog:
    """Named datasets from a mapping, such as a parsed YAML or JSON file."""

    def __init__(self, datasets: dict[str, dict]):
        self._datasets = {}
        for name, held in datasets.items():
            bounds = held.get("length_percentiles") or {}
            self._datasets[name] = Dataset(
                name,
                held.get("train_path", held.get("path", "")),
                held.get("test_path", ""),
                held.get("format", "json"),
                (int(bounds.get("lower", DEFAULT_PERCENTILES[0])), int(bounds.get("upper", DEFAULT_PERCENTILES[1]))),
                held.get("system_prompt", ""),
                dict(held.get("tasks") or {}),
            )

    @classmethod
    def from_file(cls, path: str) -> Catalog:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith(".json"):
            held = json.loads(text)
        else:
            try:
                import yaml
            except ImportError as error:
                raise RuntimeError("YAML catalogs need the yaml package; use JSON") from error
            held = yaml.safe_load(text)
        return cls(held.get("datasets", held))

    def names(self) -> list[str]:
        return list(self._datasets)

    def get(self, name: str) -> Dataset:
        if name not in self._datasets:
            raise ValueError(f"unknown dataset {name!r}; known: {', '.join(self._datasets)}")
        return self._datasets[name]

    def load(self, spark: SparkSession, name: str, max_samples: int = -1, split: str = "train") -> DataFrame:
        found = self.get(name)
        paths = {"train": found.train_path, "test": found.test_path}
        if split not in paths:
            raise ValueError(f"unknown split {split!r}")
        return read_samples(spark, paths[split], max_samples, lines=found.format == "jsonl")


def _has(value: Column, key: str) -> Column:
    """Whether a JSON object has a key, even with a null under it."""
    return F.array_contains(F.json_object_keys(F.to_json(value)), key)


def read_samples(spark: SparkSession, path: str, max_samples: int = -1, lines: bool = False) -> DataFrame:
    """pos, id, query, answer, task, subtask, knowledge of a JSON array file, or of JSON lines.

    Rows count towards ``max_samples`` before those without a query key are dropped, so
    fewer may return; 0 returns none and a negative number all. An array is one file's
    single value and as such bound by Spark's largest variant (128 MB); larger datasets
    come as lines, which Spark splits.
    """
    if lines:
        parsed = spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
        # A limit without an order takes the first rows of the first partitions, so only those are numbered together.
        first = parsed.limit(max_samples) if max_samples >= 0 else parsed
        rows = first.withColumn("pos", F.monotonically_increasing_id())
    else:
        whole = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("j"))
        whole.createOrReplaceTempView("_evoframe_samples")
        rows = spark.sql("SELECT CAST(e.pos AS BIGINT) AS pos, e.value AS v FROM _evoframe_samples, LATERAL variant_explode(j) AS e")
    if max_samples >= 0:
        rows = rows.where(F.col("pos") < max_samples)
    return normalised(rows)


def normalised(rows: DataFrame) -> DataFrame:
    """Samples from ``pos`` and a variant ``v``: keys resolved in order of presence, defaults filled in.

    The answer is ``answer`` if that key is there, else what ``meta`` gives (``gt``, then
    ``answer``, else ''; a meta string is parsed as JSON, and stays itself if it isn't), else
    ``ground_truth``. A sample without id gets one from its content.
    """
    v = F.col("v")
    text = lambda key, base=v: F.try_variant_get(base, f"$.{key}", "string")
    raw_meta = text("meta")
    meta_kind = F.schema_of_variant(F.try_variant_get(v, "$.meta", "variant"))
    meta = F.when(meta_kind == "STRING", F.try_parse_json(raw_meta)).otherwise(F.try_variant_get(v, "$.meta", "variant"))
    is_object = F.coalesce(F.schema_of_variant(meta).startswith("OBJECT"), F.lit(False))
    from_meta = F.when(is_object, F.when(_has(meta, "gt"), text("gt", meta)).when(_has(meta, "answer"), text("answer", meta)).otherwise("")).otherwise(F.coalesce(raw_meta, F.lit("")))
    answer = F.when(_has(v, "answer"), text("answer")).when(_has(v, "meta"), from_meta).otherwise(F.coalesce(text("ground_truth"), F.lit("")))
    kept = rows.where(_has(v, "query"))
    return kept.select(
        "pos",
        F.coalesce(text("id"), F.md5(F.to_json(v).cast("binary"))).alias("id"),
        text("query").alias("query"),
        answer.alias("answer"),
        F.coalesce(text("task"), F.lit("")).alias("task"),
        F.coalesce(text("subtask"), F.lit("")).alias("subtask"),
        text("knowledge").alias("knowledge"),
    )


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines in one folder, by task where there is one."""
    writer = results.write.mode("overwrite")
    (writer.partitionBy("task") if "task" in results.columns else writer).json(path)


#: Columns of a trajectory that are kept in a snapshot; scores of the search are derived again.
PERSISTED = ("sample_id", "id", "pos", "query", "truth", "knowledge", "answer", "reasoning", "source_model", "generation_method", "fitness", "exact_match", "length_score", "knowledge_score")


def save_population(traj: DataFrame, path: str, generation: int) -> None:
    """A generation's snapshot as Parquet, partitioned so that one can be read alone."""
    kept = [c for c in PERSISTED if c in traj.columns]
    traj.select(*kept).write.mode("overwrite").parquet(f"{path}/generation={generation}")


def load_population(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """A saved generation, the last one unless named."""
    rows = spark.read.parquet(path)
    if generation is None:
        generation = rows.agg(F.max("generation")).first()[0]
    return rows.where(F.col("generation") == generation).drop("generation")


@dataclass(frozen=True)
class Run:
    """One run of the loop: its name, when it began, and what it runs on."""

    id: str
    begun: int
    identity: dict

    @classmethod
    def new(cls, identity: dict) -> Run:
        return cls(uuid.uuid4().hex, time.time_ns(), identity)


def identity_of(samples: DataFrame, config: Mapping) -> dict:
    """What a state belongs to: a hash of the configuration and one of the samples, whatever their order.

    The number of generations is no part of it, so a finished run can be taken further.
    """
    held = {k: v for k, v in config.items() if k != "generations"}
    row = samples.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "query", "answer", "knowledge").cast("decimal(38,0)")).alias("s")).first()
    return {"config": hashlib.sha256(json.dumps(held, sort_keys=True).encode()).hexdigest(), "samples": f"{row.n}:{row.s or 0}"}


def save_state(run: Run, population: DataFrame, finished: DataFrame, history: DataFrame, path: str, generation: int) -> None:
    """All that a run needs to go on after ``generation``; a manifest that names the parts is written last.

    What a run that was stopped before its manifest left behind is never read, and is
    replaced when the run gets there again.
    """
    spark = population.sparkSession
    at = f"run={run.id}/generation"
    finished.select(*[c for c in PERSISTED if c in finished.columns]).write.mode("overwrite").parquet(f"{path}_finished/{at}={generation}")
    history.drop("generation").write.mode("overwrite").parquet(f"{path}_history/{at}={generation}")
    save_population(population, f"{path}/run={run.id}", generation)
    upto = lambda part: [f"{path}_{part}/{at}={g}" for g in range(1, generation + 1)]
    held = {"run": run.id, "begun": run.begun, "identity": run.identity, "generation": generation, "population": f"{path}/{at}={generation}", "finished": upto("finished"), "history": upto("history")}
    write_json(spark, f"{path}_manifests/{run.begun:020d}-{run.id}-{generation:06d}.json", held)


def load_run(spark: SparkSession, path: str, identity: dict | None = None) -> tuple[Run, dict] | None:
    """The newest run under ``path`` and its last whole manifest; None if there is none.

    With ``identity`` the newest run of that identity, and an error if there are runs but
    none of it: a state is never taken up by other samples or another configuration.
    """
    found = [read_json(spark, f"{path}_manifests/{n}") for n in names(spark, f"{path}_manifests") if n.endswith(".json")]
    found = [m for m in found if m is not None]
    ours = [m for m in found if identity is None or m["identity"] == identity]
    if not ours:
        if found:
            last = found[-1]["identity"]
            differs = [k for k in identity if identity[k] != last.get(k)]
            raise ValueError(f"the state under {path} belongs to other {' and '.join(differs)}; run without resuming, or in another folder")
        return None
    last = max(ours, key=lambda m: (m["begun"], m["generation"]))
    return Run(last["run"], last["begun"], last["identity"]), last


def load_state(spark: SparkSession, path: str, identity: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame, int] | None:
    """Population, finished rows, history and number of the last complete generation of one run; None if there is none."""
    found = load_run(spark, path, identity)
    if found is None:
        return None
    run, held = found
    read = lambda part: spark.read.option("basePath", f"{path}_{part}/run={run.id}").parquet(*held[part])
    return spark.read.parquet(held["population"]), read("finished").drop("generation"), read("history"), held["generation"]


def write_samples(results: DataFrame, path: str) -> None:
    """One folder of JSON a sample, named by its number from 1 in order of id and the id's first 8 characters.

    Ids are dealt into ranges and numbered inside them, after the ids of the ranges before.
    """
    ranges = cut(results.select("sample_id").distinct().repartitionByRange("sample_id").withColumn("_range", F.spark_partition_id()))
    counts = sorted((r["_range"], r["count"]) for r in ranges.groupBy("_range").count().collect())  # a row a partition
    before = [(part, sum(n for p, n in counts if p < part)) for part, _ in counts]
    offsets = results.sparkSession.createDataFrame(before, "_range int, _before long")
    number = F.row_number().over(Window.partitionBy("_range").orderBy("sample_id")) + F.col("_before")
    named = ranges.join(F.broadcast(offsets), "_range").select("sample_id", F.concat_ws("_", F.lit("sample"), number.cast("string"), F.substring("sample_id", 1, 8)).alias("sample"))
    results.join(named, "sample_id").write.mode("overwrite").partitionBy("sample").json(path)


def write_events(rows: DataFrame, phase: str, generation: int, run: Run, path: str) -> None:
    """A phase's log rows under run, generation and phase; a phase that is run again replaces its rows."""
    log_events(rows, phase, generation).drop("phase", "generation").write.mode("overwrite").json(f"{path}/run={run.id}/generation={generation}/phase={phase}")


def log_events(rows: DataFrame, phase: str, generation: int) -> DataFrame:
    """Phase-log rows: sample_id, generation, phase, document; unknown values are written as 0 or false."""
    known = lambda name, kind: F.col(name) if name in rows.columns else F.lit(None).cast(kind)
    shown = F.struct(
        "id",
        F.coalesce(known("fitness", "double"), F.lit(0.0)).alias("fitness"),
        F.coalesce(known("exact_match", "boolean"), F.lit(False)).alias("exact_match"),
        (~F.coalesce(known("failed", "boolean"), F.lit(False))).alias("success"),
        F.length("reasoning").alias("reasoning_length"),
    )
    return rows.select("sample_id", F.lit(generation).alias("generation"), F.lit(phase).alias("phase"), F.to_json(shown).alias("document"))
