"""Templates and parsers by dataset, progress of running jobs, stream state that ends, the plain loop of trials."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from evoframe.functions import text as T
from evoframe.plans.batch import process
from evoframe.plans.evolve import EvolutionConfig, evolve, initial_pool
from evoframe.plans.progress import Progress, Watch
from evoframe.plans.templates import Template, filled, template_answer, templates_from, with_templates
from evoframe.plans.trial import TrialConfig, trial, trial_fitness, trial_match, trial_summary
from evoframe.streaming.token_bucket import Bucket, admitted, admitted_stream


def values(spark, function, *texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return [r.v for r in frame.select("id", function("t").alias("v")).orderBy("id").collect()]


def test_answer_parsers(spark):
    assert values(spark, T.answer_line, "a\n\n Answer:  42 \n \n", "THE ANSWER IS x", "Result: Answer: y", "", " \n ", None) == ["42", "x", "Answer: y", "", "", None]
    held = ['{"result": "a"} {"x": 1, "result": "b"} end', '{"result": "c"}\nx {"result": 5}', 'no\nResult: d', '{bad "result": "e"}', "", None]
    assert values(spark, T.answer_json, *held) == ["b", "c", "d", '{bad "result": "e"}', "", None]
    held = ["x [ANSWER_START] a [ANSWER_END] [ANSWER_START]b[ANSWER_END]", "[ANSWER_END] [ANSWER_START]\nc\n[ANSWER_END]", "[ANSWER_START] d\nAnswer: e", "[ANSWER_START][ANSWER_END]", "", None]
    assert values(spark, T.answer_marked, *held) == ["a", "c", "e", "", "", None]
    long = "[ANSWER_START] {" * 50_000 + " " * 100_000 + "\nAnswer: z" + "\n" * 100_000
    began = time.perf_counter()
    assert [values(spark, f, long)[0] for f in (T.answer_line, T.answer_json, T.answer_marked)] == ["z"] * 3
    assert time.perf_counter() - began < 30


def test_reasoning_lengths(spark):
    held = ["x <|think|> a bc <|answer|> d", "a b <|answer|> c <|think|> d", "<|think|> a b", "a  b", "", None]
    assert values(spark, lambda t: T.reasoning_length(t, "words"), *held) == [2, 0, 3, 2, 0, 0]
    assert values(spark, lambda t: T.reasoning_length(t, "chars"), *held) == [4, 0, 13, 4, 0, 0]
    assert values(spark, lambda t: T.reasoning_length(t, "raw_words"), *held) == [6, 6, 3, 2, 0, 0]
    with pytest.raises(ValueError):
        T.reasoning_length("t", "lines")


def test_places_are_filled_once(spark):
    (row,) = spark.createDataFrame([("{knowledge} {", None)], "q string, k string").select(
        filled(F.lit("a {query} {{query}} {other} } {knowledge}{"), {"query": F.col("q"), "knowledge": F.col("k")}).alias("x"), filled(F.lit(None).cast("string"), {"query": F.col("q")}).alias("none"), filled(F.lit(""), {}).alias("empty")
    ).collect()
    assert (row.x, row.none, row.empty) == ("a {knowledge} { {{knowledge} {} {other} } {", None, "")


def test_templates_are_checked(spark):
    assert templates_from({"default": {"parser": "line"}, "d": {}}) == {None: Template(parser="line"), "d": Template()}
    for bad in ({"plain": "no place"}, {"plain": "{query} {knowledge}"}, {"informed": "{query} {x}"}, {"parser": "none"}):
        with pytest.raises(ValueError):
            Template(**bad)
    rows = spark.createDataFrame([(1, "d", "x"), (2, None, "y"), (3, "e", "z")], "id int, dataset string, template string")
    assert [r.template.parser for r in with_templates(rows, {"d": Template(parser="json")}).orderBy("id").collect()] == ["json", "split", "split"]
    assert [r.template.parser for r in with_templates(rows, {None: Template(parser="line")}).collect()] == ["line"] * 3
    assert rows.limit(0).transform(with_templates, {"d": Template()}).count() == 0
    assert rows.select(template_answer(F.lit("a"), F.lit("none")).alias("x")).first().x is None


def answers(prompts):
    """Each dataset's own form of answer, with the prompt as reasoning."""
    out = []
    for p in prompts:
        answer = {"J": '{"result": "json"}', "M": "[ANSWER_START]marked[ANSWER_END]"}.get(p[0], "so\nAnswer: line")
        out.append(f"<|think|>{p}<|answer|>{answer}")
    return out


DATASETS = {"j": Template("J {query}", "J+ {query} {knowledge}", "json"), "m": Template("M {query}", "M+ {query} {knowledge}", "marked"), None: Template("L {query}", "L+ {query} {knowledge}", "line")}
SAMPLES = "id string, dataset string, query string, answer string, knowledge string"


def test_datasets_have_their_own_prompts_and_parsers(spark, tmp_path):
    samples = spark.createDataFrame([("1", "j", "q", "json", "k"), ("2", "m", "q", "x", None), ("3", "other", "q", "line", "k"), ("4", None, None, "x", "k")], SAMPLES)
    config = EvolutionConfig(generations=1, population=3, length_bounds=(1, 50))
    pool = initial_pool(samples, config, answers, templates=DATASETS)
    got = {(r.sample_id, r.pos): (r.reasoning, r.answer) for r in pool.collect()}
    assert got["1", 0] == ("J q\nDraw 0", "json") and got["1", 2] == ("J+ q k\nDraw 2", "json")
    assert got["2", 2] == ("M q\nDraw 2", "marked") and got["3", 2] == ("L+ q k\nDraw 2", "line") and got["4", 0] == ("L \nDraw 0", "line")
    state = str(tmp_path / "state")
    best, _ = evolve(samples, config, answers, snapshots=state, templates=DATASETS)
    assert {r.sample_id: r.exact_match for r in best.collect()} == {"1": True, "2": False, "3": True, "4": False}
    with pytest.raises(ValueError):  # a state belongs to its templates too
        evolve(samples, config, answers, snapshots=state, resume=True)


def test_progress_before_the_end(spark):
    samples = spark.createDataFrame([(f"s{i}",) for i in range(8)], "id string")
    seen, over = [], threading.Event()

    def run(batch):
        def slow(frames):
            for frame in frames:
                time.sleep(0.4)
                yield frame

        return batch.repartition(4).mapInPandas(slow, batch.schema).select(F.col("id").alias("sample_id"))

    def look(state):
        seen.append((over.is_set(), state))
        if len(seen) == 2:
            raise ValueError("reports may fail")

    results, statistics = process(samples, run, 4, 60, watched=look, interval=0.05)
    over.set()
    early = [s for late, s in seen if not late]
    assert statistics.successful == 8 and results.count() == 8
    assert any(s.tasks_done < s.tasks and s.completed < 8 for s in early)  # tasks move while samples do not
    assert [s.completed for s in early] == sorted(s.completed for s in early) and early[-1].completed == 8
    assert early[-1].remaining == 0 and early[-1].percent == 100.0 and Progress(0, 0, None, 0, 0, 0, 1.0).percent == 100.0
    assert Progress(4, 1, None, 0, 0, 0, 2.0).seconds_left == 6.0 and Progress(4, 0, None, 0, 0, 0, 2.0).seconds_left is None


def test_loop_tells_its_phase(spark):
    samples = spark.createDataFrame([("1", "j", "q", "json", None), ("2", "m", "q", "x", None)], SAMPLES)
    seen = []
    with Watch(spark, seen.append, interval=0.02) as watch:
        evolve(samples, EvolutionConfig(generations=1, population=2, length_bounds=(1, 50)), answers, templates=DATASETS, watch=watch)
    phases = [s.phase for s in seen]
    assert {"initial", "evaluation 1", "variation 1"} <= set(phases) and phases[-1] == "over"
    assert seen[-1].completed == seen[-1].total == 2 and any(s.completed == 1 for s in seen) and any(s.tasks for s in seen)


def test_bucket_is_full_again():
    bucket = Bucket(2, 10)
    bucket.take(100)
    assert bucket.full_at == 110 and bucket.take(105) and bucket.full_at == 120


def test_stream_state_ends(spark, tmp_path):
    rows = [(k, k * 1000 + i, f"2024-01-01 {h:02d}:{m:02d}:00") for h in range(6) for k in range(h * 5, h * 5 + 5) for i, m in enumerate((h, h, h + 1, 20, 20))]
    events = spark.createDataFrame(rows, "user_id long, event_id long, at string").withColumn("ts", F.col("at").cast("timestamp")).drop("at")
    for hour in range(6):
        events.where(F.hour("ts") == hour).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)

    def states(name, lateness):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = admitted_stream(stream, "user_id", "ts", "event_id", 2, 60_000_000, lateness).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        found.processAllAvailable()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in found.recentProgress if p["stateOperators"]]
        found.stop()
        return held

    kept, ended = states("kept", None), states("ended", "1 minute")
    same = lambda frame: sorted(map(tuple, frame.collect()))
    assert same(spark.table("ended")) == same(spark.table("kept")) == same(admitted(events, "user_id", "ts", "event_id", 2, 60_000_000))
    assert max(kept) == 30 and max(ended) <= 10 and ended[-1] <= 5


def brute_trial(pool, send, config):
    """The loop of one sample as nested statements; replies as the offline steps see them."""

    def score(t):
        ok = t["answer"].strip().lower() == t["truth"].strip().lower()
        n = len(t["reasoning"].split())
        length = 0.0 if n < config.length_bounds[0] else 0.5 if n > config.length_bounds[1] else 1.0
        t["ok"], t["fitness"] = ok, round((1.0 if ok else 0.0) + 0.3 * length + (0.5 if t["knowledge"] and t["reasoning"].strip() else 0.0), 6)

    population, sizes = pool[: config.population], []
    for _ in range(config.generations):
        for t in population:
            score(t)
        population.sort(key=lambda t: -t["fitness"])
        sizes.append(len(population))
        if population[0]["fitness"] >= config.threshold:
            return population[0], sizes
        parents = population[: config.elites]
        children = [c for t in parents[: config.elites // 2] if not t["ok"] and (c := send(t, "innovate"))]
        while len(children) < config.population - config.elites:
            t = parents[len(children) % len(parents)]
            children.append(send(t, "add") or dict(t))
        population = parents + children[: config.population - config.elites]
    for t in population:
        score(t)
    return max(population, key=lambda t: t["fitness"]), sizes


def steps(prompts):
    """Replies that lengthen a reasoning; a reasoning that names a failure fails every call."""
    out = []
    for p in prompts:
        if "broken" in p:
            raise ValueError
        told = p.split("[Reasoning]\n")[1].split("\n\n[")[0]
        out.append("* advice" if p.startswith("Name") else f"<|think|>{told} {'new' if p.startswith(('Solve', 'Shorten')) else 'more'}<|answer|>{len(told.split())}")
    return out


@pytest.mark.parametrize("population, elite_ratio", [(6, 0.3), (7, 0.6), (2, 0.5)])
def test_trial_equals_nested_statements(spark, population, elite_ratio):
    config = TrialConfig(generations=3, population=population, elite_ratio=elite_ratio, length_bounds=(3, 6))
    held = []
    for s, truth in enumerate(("never", "5", "4", "3", "never")):
        for i in range(s + 3):
            word = "broken" if s == 4 and i % 2 else f"w{i}"
            held.append((f"s{s}", i, f"{s}-{i}", "q", truth, "k" if s == 4 and i == 1 else None, "m", " ".join([word] * (1 + i % 4)), "0", "vanilla"))
    pool = spark.createDataFrame(held, "sample_id string, pos long, id string, query string, truth string, knowledge string, source_model string, reasoning string, answer string, generation_method string")

    def send(t, mode):
        if "broken" in t["reasoning"]:
            return None
        words = t["reasoning"].split()
        if mode == "add":
            return t | {"reasoning": " ".join([*words, "more"]), "answer": str(len(words))}
        return t | {"reasoning": " ".join([*words, "new", "new"]), "answer": str(len(words) + 1)}

    best, history = trial(pool, steps, config)
    got = {r.sample_id: (r.reasoning, r.answer, r.fitness) for r in best.collect()}
    counts = {}
    for r in history.orderBy("sample_id", "generation").collect():
        counts.setdefault(r.sample_id, []).append(r["size"])
    for s in range(5):
        rows = [dict(zip(("truth", "knowledge", "reasoning", "answer"), (h[4], h[5], h[7], h[8]))) for h in held if h[0] == f"s{s}"]
        want, sizes = brute_trial(rows, send, config)
        assert got[f"s{s}"] == (want["reasoning"], want["answer"], want["fitness"]) and counts[f"s{s}"] == sizes


def test_trial_edges(spark):
    rows = spark.createDataFrame([("Answer: X ", " x", "r", "k"), (None, "x", " ", "k"), ("x", None, "r", ""), ('{"result": "x"}', '{"result": "x"}', None, None)], "a string, t string, r string, k string")
    exact = trial_match("a", "t")
    assert [tuple(r) for r in rows.select(exact, trial_fitness(exact, "r", "k", TrialConfig(length_bounds=(1, 2)))).collect()] == [(True, 1.8), (False, 0.0), (False, 0.3), (False, 0.0)]
    pool = spark.createDataFrame([], "sample_id string, pos long, id string, query string, truth string, knowledge string, source_model string, reasoning string, answer string, generation_method string, extra int")
    best, history = trial(pool, steps)
    assert best.count() == 0 and history.count() == 0 and trial_summary(best).first().exact_match_percent == 0.0
    held = spark.createDataFrame([("A", "a", 1.0), ("b", "c", 0.5), (None, "c", None)], "answer string, truth string, fitness double")
    assert tuple(trial_summary(held).first()) == (3, 0.75, 1.0, 1, 33.333333)
    for bad in ({"generations": 0}, {"population": 1}):
        with pytest.raises(ValueError):
            TrialConfig(**bad)


def test_command_line_takes_templates_and_reports(spark, tmp_path, capsys):
    from evoframe.cli import main

    (tmp_path / "d.json").write_text(json.dumps([{"id": "a", "query": "q", "gt": "1", "task": "t"}]))
    (tmp_path / "catalog.json").write_text(json.dumps({"d": {"train_path": str(tmp_path / "d.json")}}))
    (tmp_path / "config.json").write_text(json.dumps({"generations": 1, "population": 2}))
    (tmp_path / "templates.json").write_text(json.dumps({"d": {"plain": "PLACE {query}", "parser": "line"}}))
    common = ["--dataset", "d", "--catalog", str(tmp_path / "catalog.json"), "--output-dir", str(tmp_path / "out"), "--config", str(tmp_path / "config.json"), "--no-knowledge"]
    assert main([*common, "--templates", str(tmp_path / "templates.json"), "--progress", "0.05"], spark) == 0
    told = capsys.readouterr()
    assert "evaluation 1: " in told.err and "over: 1 of 1 samples" in told.err and json.loads(told.out)["successful"] == 1
    (tmp_path / "templates.json").write_text(json.dumps({"d": {"parser": "none"}}))
    assert main([*common, "--templates", str(tmp_path / "templates.json")], spark) == 1
