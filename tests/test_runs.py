"""Providers, variation steps, knowledge, resumed runs, batches, configuration and limits."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from evoframe.config import config_from_environment, config_from_file, default_config, models_from_environment, models_from_file, write_config
from evoframe.operators import sampling as S
from evoframe.operators import selection as N
from evoframe.plans.batch import process, write_batch
from evoframe.plans.evolve import EvolutionConfig, evaluated, evolve, initial_pool
from evoframe.plans.variation import varied, with_knowledge
from evoframe.sources.datasets import load_state, write_samples
from evoframe.sources.models import HttpEmbedder, HttpGenerator, Registry, embedded, generated
from evoframe.streaming.token_bucket import RateLimiter, shared

SAMPLES = "id string, query string, answer string, knowledge string"


@pytest.fixture(scope="module")
def server():
    """Answers every second call with an error, to be tried again."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body, self.headers.get("Authorization")))
            if len(seen) % 2:
                self.send_error(503)
                return
            if self.path.endswith("embeddings"):
                reply = {"data": [{"index": i, "embedding": [float(len(t)), float(i)]} for i, t in reversed(list(enumerate(body["input"])))]}
            else:
                reply = {"choices": [{"message": {"content": body["messages"][0]["content"].upper()}}]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/v1", seen
    http.shutdown()


def test_http_providers(server):
    base, seen = server
    send = HttpGenerator("m", base, "key", backoff=0.01, threads=1, temperature=0.1)
    assert send(["a", "b"]) == ["A", "B"]
    assert seen[-1][1]["temperature"] == 0.1 and seen[-1][2] == "Bearer key" and len(seen) == 4
    assert HttpEmbedder("e", base, backoff=0.01)(["x", "yyy"]) == [[1.0, 0.0], [3.0, 1.0]]
    with pytest.raises(OSError):
        HttpGenerator("m", base, retries=0, backoff=0.01)(["c"])


def test_registry_routes_rows(spark, tmp_path):
    registry = Registry({"a": lambda p: [f"a:{x}" for x in p], "b": lambda p: [f"b:{x}" for x in p]})
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "b", None), (4, "z", "w")], "id long, model string, prompt string")
    got = {r.id: (r.output, r.error) for r in generated(rows, "prompt", registry, model="model").collect()}
    assert got.pop(4) == (None, "ValueError: unknown model 'z'; known: a, b")
    assert got == {1: ("a:x", None), 2: ("b:y", None), 3: (None, None)}
    with pytest.raises(ValueError):
        registry.set_operator("z")
    registry.set_operator("b")
    assert rows.select(registry.operator_for(F.col("model")).alias("o")).distinct().collect()[0].o == "b"
    (tmp_path / "m.json").write_text(json.dumps({"thinkers": [{"name": "t", "base_url": "http://x", "api_key": "${NO_SUCH_KEY}"}], "operator": "t"}))
    found = models_from_file(str(tmp_path / "m.json"))
    assert found.names() == ["t"] and found.operator == "t" and found.get("t").api_key == "" and found.get("t").model == "t"
    assert models_from_environment({"EVOFRAME_MODELS": "p, q", "EVOFRAME_BASE_URL": "http://x"}).names() == ["p", "q"]


def test_embeddings_that_are_there_stay(spark):
    def embed(texts):
        if "bad" in texts:
            raise ValueError("bad")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "one", [9.0]), (2, "three", None), (3, "bad", None)], "id long, t string, embedding array<float>").coalesce(1)
    assert {r.id: r.embedding for r in embedded(rows, "t", embed).collect()} == {1: [9.0], 2: [5.0], 3: None}


def replies(prompts):
    """Speaks the format of each step; fails where the problem says so."""
    out = []
    for p in prompts:
        if "FAIL" in p:
            raise ValueError("no reply")
        if p.startswith("Quote"):
            out.append("[SENTENCE_START]Second.[SENTENCE_END]")
        elif p.startswith(("List", "Name")):
            out.append("* item one\n* item two")
        else:
            out.append(f"<|think|>{p.splitlines()[0][:9]}|{p.split('[')[-1]}<|answer|>42")
    return out


def test_variation_steps(spark):
    kinds = ["crossover", "mutation_add", "mutation_delete", "mutation_innovate"]
    rows = [(k, q, "t", "First. Second. Third.", "9", "Other. Second. Way.", "m") for k in kinds for q in ("q", "FAIL")]
    rows.append(("crossover", "start", "t", "Second. First.", "9", "Other. Second.", "m"))
    frame = spark.createDataFrame(rows, "generation_method string, query string, truth string, reasoning string, answer string, other string, operator string")
    got = {(r.generation_method, r.query): r for r in varied(frame, replies).collect()}
    assert len(got) == len(rows)
    assert {k for k, r in got.items() if r.failed} == {(k, "FAIL") for k in kinds} | {("crossover", "start")}
    cross = got["crossover", "q"]
    assert (cross.target_bp, cross.provider_bp) == (7, 7) and cross.new_answer == "42" and cross.new_reasoning.endswith("item one\nitem two")
    assert got["mutation_add", "q"].new_reasoning.startswith("Enrich") and got["mutation_delete", "q"].new_reasoning.startswith("Shorten")
    assert got["mutation_innovate", "q"].diagnosis == "item one\nitem two" and got["mutation_innovate", "q"].new_reasoning.startswith("Shorten")


def test_innovation_falls_back_to_shortening(spark):
    def only_short(prompts):
        if any(not p.startswith("Shorten") for p in prompts):
            raise ValueError
        return replies(prompts)

    frame = spark.createDataFrame([("mutation_innovate", "q", "t", "Some reasoning.", "9", "o", "m")], "generation_method string, query string, truth string, reasoning string, answer string, other string, operator string")
    (row,) = varied(frame, only_short).collect()
    assert not row.failed and row.new_reasoning.startswith("Shorten") and row.diagnosis is None


def test_knowledge(spark):
    samples = spark.createDataFrame([("a", "q", "x", None), ("b", "q", "x", None), ("c", "q", "x", "own"), ("d", "FAIL", "x", None)], SAMPLES)
    found = spark.createDataFrame([("a", 1, "snip", 0.9), ("a", 2, "more", 0.1), ("b", 1, "weak", 0.2), ("c", 1, "snip", 0.9)], "id string, rank int, text string, score double")
    got = {r.id: r.knowledge for r in with_knowledge(samples, replies, found).collect()}
    assert got == {"a": "1. snip\n\n2. more", "b": "item one\nitem two", "c": "own", "d": None}
    assert with_knowledge(samples, None, found).where("knowledge IS NULL").count() == 2
    with pytest.raises(ValueError):
        with_knowledge(samples)


def test_parents_fall_back(spark):
    """Small populations whole, an empty front at random, and size held while evolving equal texts."""
    same = [("eq", f"t{i}", i, [1.0, 1.0], 0.5, True) for i in range(5)]
    few = [("few", f"t{i}", i, [float(i), 0.0], 0.5, True) for i in range(2)]
    rows = spark.createDataFrame(same + few, "sample_id string, id string, pos long, embedding array<float>, fitness double, exact_match boolean")
    scored = N.scores(rows, 3)
    front = N.pareto_front(scored)
    assert front.where("sample_id = 'eq'").count() == 0
    got = S.parents(scored, front, 3, 1).collect()
    assert len({r.id for r in got if r.sample_id == "eq"}) == 3 and [r.slot for r in got if r.sample_id == "few"] == [0, 1]
    assert all(r.weight is None for r in got if r.sample_id == "few")
    pairs = S.offspring_pairs(S.parents(scored, front, 3, 1), scored, 4, 2).collect()
    assert sorted((r.sample_id, r.slot) for r in pairs) == [(s, k) for s in ("eq", "few") for k in range(4)]
    chosen = {r.id for r in got if r.sample_id == "eq"}
    assert {r.target_id for r in pairs if r.sample_id == "eq"} <= chosen


def test_judge_counts(spark):
    samples = spark.createDataFrame([("s", "q", "1", "k"), ("t", "q", "1", None)], SAMPLES)
    config = EvolutionConfig(generations=1, population=2, length_bounds=(0, 99))
    pool = initial_pool(samples, config, replies)
    got = {(r.sample_id, r.pos): r for r in evaluated(pool, config, judge=lambda prompts: ["4/5"] * len(prompts)).collect()}
    assert got["s", 0].knowledge_score == 4 and got["s", 0].fitness == pytest.approx(0.3 + 0.5 * 0.8) and got["t", 0].knowledge_score is None


def test_resumed_run_goes_on(spark, tmp_path):
    samples = spark.createDataFrame([("s1", "one", "42", "k"), ("s2", "two", "7", None)], SAMPLES)
    options = {"population": 4, "length_bounds": (0, 99), "threshold": 1.25, "crossover_probability": 0.0, "modes": (("add", 1.0),)}
    path, log = str(tmp_path / "state"), str(tmp_path / "events")
    evolve(samples, EvolutionConfig(generations=1, **options), replies, snapshots=path, events=log)
    population, finished, history, generation = load_state(spark, path)
    assert generation == 1 and finished.select("sample_id").distinct().collect()[0].sample_id == "s1" and history.count() == 2
    best, history = evolve(samples, EvolutionConfig(generations=2, **options), replies, snapshots=path, events=log, resume=True)
    assert {r.sample_id for r in best.collect()} == {"s1", "s2"}
    assert sorted((r.sample_id, r.generation) for r in history.collect()) == [("s1", 1), ("s2", 1), ("s2", 2)]
    phases = {r.phase for r in spark.read.json(log).select("phase").distinct().collect()}
    assert {"initial", "evaluation", "early_stop", "mutation", "new_generation", "final_best"} <= phases
    assert load_state(spark, str(tmp_path / "none")) is None
    write_samples(best.select("sample_id", "answer"), str(tmp_path / "samples"))
    assert spark.read.json(str(tmp_path / "samples")).select("sample").distinct().count() == 2


def test_batches(spark, tmp_path):
    samples = spark.createDataFrame([(f"s{i}",) for i in range(40)], "id string")
    seen = []
    results, statistics = process(samples, lambda b: b.where("id <> 's7'").select(F.col("id").alias("sample_id"), F.lit(1).alias("fitness")), 15, 60, lambda a, n: seen.append((a, n)))
    assert (statistics.total, statistics.successful, statistics.failed, statistics.timed_out) == (40, 39, 1, 0)
    assert seen[-1] == (40, 40) and statistics.samples_per_minute > 0 and statistics.success_percent == 97.5
    write_batch(results, statistics, str(tmp_path / "out"))
    assert json.loads((tmp_path / "out/statistics.json").read_text())["failed"] == 1

    def slow(batch):
        time.sleep(3)
        return batch.select(F.col("id").alias("sample_id"))

    assert process(samples, slow, 40, 0.2)[1].timed_out == 40
    assert process(samples, lambda b: b.select("missing"), 40)[1].failed == 40


def test_configuration(tmp_path):
    config = config_from_file(None, population=8, seed=None)
    assert config.population == 8 and config.seed == 42
    write_config(config, str(tmp_path / "c.json"))
    assert config_from_file(str(tmp_path / "c.json")) == config
    (tmp_path / "r.json").write_text(json.dumps({"evolution": {"vanilla_ratio": "2/3", "modes": {"add": 1.0}}}))
    assert config_from_file(str(tmp_path / "r.json")).vanilla == 4
    (tmp_path / "x.json").write_text(json.dumps({"nonsense": 1}))
    with pytest.raises(ValueError):
        config_from_file(str(tmp_path / "x.json"))
    assert config_from_environment({"EVOFRAME_POPULATION": "12", "EVOFRAME_EPSILON": "0.2"}).population == 12
    assert default_config(str(tmp_path / "none.json"))["parallel"]["batch_size"] == 20


def test_limits():
    now = [0.0]
    limiter = RateLimiter(60, 2, timeout=1.5, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + max(s, 0.01)))
    for _ in range(60):
        assert limiter(lambda x: x + 1, 1) == 2
    assert now[0] == 0.0 and limiter(lambda: 3) == 3 and now[0] >= 0.99
    slow = RateLimiter(1, 1, timeout=0.5, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + max(s, 0.01)))
    slow(lambda: 0)
    with pytest.raises(TimeoutError):
        slow(lambda: 0)
    assert shared("x", list) is shared("x", list)
