"""Datasets, sinks, model interfaces, rate limits and the evolution loop."""

import json

import pytest

from evoframe.plans.evolve import EvolutionConfig, evolve
from evoframe.sources.datasets import Catalog, load_population, read_samples, save_population, write_results
from evoframe.sources.models import Registry, generated, offline_generate
from evoframe.streaming.token_bucket import Bucket, admitted_stream

SAMPLES = [
    {"id": "a", "query": "q1", "answer": None, "meta": {"gt": "x"}},
    {"id": "b", "query": "q2", "meta": '{"answer": "y"}', "ground_truth": "z"},
    {"id": "c", "meta": {"gt": "no query"}},
    {"id": "d", "query": None, "meta": "plain"},
    {"query": "q5", "ground_truth": "z", "task": "t", "knowledge": "k"},
]


@pytest.mark.parametrize("lines", [False, True])
def test_samples(spark, tmp_path, lines):
    path = tmp_path / "data.json"
    path.write_text("\n".join(map(json.dumps, SAMPLES)) if lines else json.dumps(SAMPLES))
    rows = read_samples(spark, str(path), lines=lines).orderBy("pos").collect()
    assert [(r.id, r.query, r.answer) for r in rows[:3]] == [("a", "q1", None), ("b", "q2", "y"), ("d", None, "plain")]
    assert (rows[3].answer, rows[3].task, rows[3].subtask, rows[3].knowledge) == ("z", "t", "", "k") and len(rows[3].id) == 32
    assert read_samples(spark, str(path), 3, lines).count() == 2 and read_samples(spark, str(path), 0, lines).count() == 0


def test_catalog(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(SAMPLES))
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps({"datasets": {"d": {"train_path": str(tmp_path / "d.json")}}}))
    catalog = Catalog.from_file(str(path))
    assert catalog.names() == ["d"] and catalog.get("d").percentiles == (1000, 4000)
    assert catalog.load(spark, "d").count() == 4
    for call in (lambda: catalog.get("e"), lambda: catalog.load(spark, "d", split="dev")):
        with pytest.raises(ValueError):
            call()


def test_errors_are_data(spark):
    def sometimes(prompts):
        if "bad" in prompts:
            raise RuntimeError("refused")
        return [p.upper() for p in prompts]

    rows = generated(spark.createDataFrame([("a",), ("bad",)], "p string").coalesce(1), "p", sometimes).collect()
    assert {(r.p, r.output, r.error) for r in rows} == {("a", "A", None), ("bad", None, "RuntimeError: refused")}


def test_registry(spark):
    registry = Registry()
    registry.register("m1", offline_generate)
    registry.register("m2", offline_generate)
    rows = spark.createDataFrame([("m2",), ("other",)], "m string")
    found = [r[0] for r in rows.select(registry.operator_for(rows.m)).collect()]
    assert found[0] == "m2" and found[1] in ("m1", "m2")


def test_bucket():
    bucket = Bucket(2, 1_000_000)
    assert [bucket.take(t) for t in (0, 1, 2, 1_000_001, 1_000_002)] == [True, True, False, True, False]


def test_bucket_stream(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = admitted_stream(stream, "user_id", "ts", "event_id", 3, 3_600_000_000).writeStream.format("memory").queryName("bucket").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("bucket").count() == rows.count()


def test_evolution(spark, tmp_path):
    samples = spark.createDataFrame([("s1", "what is one", "1", "k"), ("s2", "what is two", "2", None)], "id string, query string, answer string, knowledge string")
    config = EvolutionConfig(generations=2, population=4, length_bounds=(1, 50), threshold=99.0)
    best, history = evolve(samples, config, snapshots=str(tmp_path / "snap"))
    rows = history.orderBy("sample_id", "generation").collect()
    assert {r.sample_id for r in best.collect()} == {"s1", "s2"}
    assert len(rows) == 4 and all(r["size"] <= 4 for r in rows)
    assert all(a.max_fitness <= b.max_fitness for a, b in zip(rows[::2], rows[1::2]))
    assert load_population(spark, str(tmp_path / "snap")).count() > 0


def test_config():
    for bad in ({"generations": 0}, {"population": 1}, {"crossover_probability": 2.0}, {"modes": (("add", 0.5),)}):
        with pytest.raises(ValueError):
            EvolutionConfig(**bad)
    assert (EvolutionConfig().vanilla, EvolutionConfig().parents) == (4, 3)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", "t", 1.0)], "sample_id string, task string, fitness double")
    write_results(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    save_population(rows, str(tmp_path / "pop"), 1)
    assert load_population(spark, str(tmp_path / "pop"), 1).count() == 1


def test_command_line(spark, tmp_path, capsys):
    from evoframe.cli import main

    (tmp_path / "d.json").write_text(json.dumps(SAMPLES))
    (tmp_path / "catalog.json").write_text(json.dumps({"d": {"train_path": str(tmp_path / "d.json")}}))
    (tmp_path / "config.json").write_text(json.dumps({"evolution": {"generations": 1, "population": 2}}))
    common = ["--catalog", str(tmp_path / "catalog.json"), "--output-dir", str(tmp_path / "out"), "--config", str(tmp_path / "config.json")]
    assert main(["--dataset", "d", *common], spark) == 0
    assert json.loads(capsys.readouterr().out)["successful"] == 4
    assert spark.read.json(str(tmp_path / "out/d/results")).count() == 4
    assert main(["--dataset", "none", *common], spark) == 1
