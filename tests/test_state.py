"""What outlives a run: embedding caches, manifests of runs, corpus indexes; concurrent batches and shared limits."""

import collections
import math
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from evoframe.operators import corpus as C
from evoframe.plans import evolve as loop
from evoframe.plans.batch import process
from evoframe.plans.evolve import EvolutionConfig, evolve
from evoframe.sources.datasets import load_run, load_state, write_samples
from evoframe.sources.embedding_cache import EmbeddingCache, embedded_once
from evoframe.sources.models import offline_embed, offline_generate
from evoframe.streaming.token_bucket import limited

SAMPLES = "id string, query string, answer string, knowledge string"


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def texts(spark, *held):
    return spark.createDataFrame([(i, t) for i, t in enumerate(held)], "id long, text string")


def counted(folder):
    """An embedder that leaves a mark for every text it is sent."""

    def embed(batch):
        for t in batch:
            (folder / f"{time.time_ns()}-{random.random()}").write_text(t)
            if t == "bad":
                raise ValueError
        return [[float(len(t)), 1.0] for t in batch]

    return embed


def test_cache_outlives_a_run(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    where, embed = str(tmp_path / "cache"), counted(marks)
    asked = texts(spark, "one", "two", "one", "three", None)
    first = embedded_once(asked, "text", embed, EmbeddingCache(spark, where, buckets=4), "m")
    assert rows(first.select("id", F.col("embedding")[0])) == [(0, 3.0), (1, 3.0), (2, 3.0), (3, 5.0), (4, 0.0)]
    assert sorted(p.read_text() for p in marks.iterdir()) == ["", "one", "three", "two"]
    again = embedded_once(texts(spark, "two", "four").withColumn("embedding", F.lit(None).cast("array<float>")), "text", embed, EmbeddingCache(spark, where), "m")
    assert rows(again.select("id", F.col("embedding")[0])) == [(0, 3.0), (1, 4.0)] and len(list(marks.iterdir())) == 5
    cache = EmbeddingCache(spark, where)
    assert cache.buckets == 4 and len(cache.parts()) == 2 and cache.read().count() == 5
    assert not cache.lookup(texts(spark, "two").withColumn("model", F.lit("other"))).first().hit  # another model's
    assert cache.compact() and len(cache.parts()) == 1 and cache.read().count() == 5
    cache.clear()
    assert cache.parts() == [] and cache.read().count() == 0 and not cache.lookup(texts(spark, "two").withColumn("model", F.lit("m"))).first().hit


def test_cache_lookup_leaves_the_cache_where_it_lies(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "cache"), buckets=4)
    for k in range(2):
        cache.add(spark.range(k * 500, k * 500 + 600).select(F.sha2(F.concat(F.lit("m:"), F.col("id").cast("string")), 256).alias("key"), F.array(F.lit(1.0)).alias("embedding")))
    assert cache.read().count() == 1100 and cache.read().select("key").distinct().count() == 1100
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = cache.lookup(spark.range(1200).select(F.lit("m").alias("model"), F.col("id").cast("string").alias("text")))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan parquet") == 2
        assert found.where("hit").count() == 1100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cache_with_two_writers_and_a_lost_one(spark, tmp_path, monkeypatch):
    """The slower writer leaves out what the faster one kept; parts and manifests that were begun are never read."""
    where = str(tmp_path / "cache")
    cache, other = EmbeddingCache(spark, where, buckets=2), EmbeddingCache(spark, where, buckets=2)
    keyed = lambda *keys: spark.createDataFrame([(k, [1.0]) for k in keys], "key string, embedding array<float>")
    real, turns = EmbeddingCache._commit, []

    def late(self, version, parts):
        if not turns:
            turns.append(other.add(keyed("a", "b")) if turns.append(None) is None else None)
        return real(self, version, parts)

    monkeypatch.setattr(EmbeddingCache, "_commit", late)
    assert cache.add(keyed("b", "c")) == 1 and rows(cache.read().select("key")) == [("a",), ("b",), ("c",)]
    monkeypatch.setattr(EmbeddingCache, "_commit", lambda self, version, parts: (_ for _ in ()).throw(RuntimeError))
    with pytest.raises(RuntimeError):
        cache.add(keyed("d"))
    monkeypatch.setattr(EmbeddingCache, "_commit", real)
    (tmp_path / "cache/manifests/000000000099.json").write_text("{")
    assert EmbeddingCache(spark, where).read().count() == 3
    assert EmbeddingCache(spark, where).add(keyed("d", None)) == 1 and EmbeddingCache(spark, where).read().count() == 4


def test_loop_embeds_each_text_once(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    samples = spark.createDataFrame([("s1", "what is one", "1", "k"), ("s2", "what is two", "2", None)], SAMPLES)
    config = EvolutionConfig(generations=2, population=4, length_bounds=(1, 50), threshold=99.0)
    results = []
    for _ in range(2):
        best, history = evolve(samples, config, embed=counted(marks), cache=EmbeddingCache(spark, str(tmp_path / "cache")), embed_model="m")
        results.append((rows(best.select("sample_id", "id", "fitness")), rows(history.select("sample_id", "generation", "avg_novelty", "pareto_size"))))
    sent = [p.read_text() for p in marks.iterdir()]
    assert len(sent) == len(set(sent)) > 0 and results[0] == results[1]
    plain = evolve(samples, config, embed=lambda batch: [[float(len(t)), 1.0] for t in batch])
    assert rows(plain[0].select("sample_id", "id", "fitness")) == results[0][0]
    assert all(r[2] is not None and r[3] is not None for r in results[0][1])


def test_state_belongs_to_its_samples_and_configuration(spark, tmp_path):
    a = spark.createDataFrame([("q1", "one", "1", None), ("q2", "two", "2", None)], SAMPLES)
    z = spark.createDataFrame([("z1", "other", "9", None)], SAMPLES)
    path, options = str(tmp_path / "state"), {"population": 2, "threshold": 99.0}
    evolve(a, EvolutionConfig(generations=2, **options), snapshots=path)
    with pytest.raises(ValueError, match="samples"):
        evolve(z, EvolutionConfig(generations=2, **options), snapshots=path, resume=True)
    with pytest.raises(ValueError, match="config"):
        evolve(a, EvolutionConfig(generations=2, population=4, threshold=99.0), snapshots=path, resume=True)
    evolve(z, EvolutionConfig(generations=1, **options), snapshots=path)
    population, finished, history, generation = load_state(spark, path)
    assert generation == 1 and {r.sample_id for r in population.collect()} == {"z1"} == {r.sample_id for r in history.collect()}
    best, history = evolve(a, EvolutionConfig(generations=3, **options), snapshots=path, resume=True)
    assert {r.sample_id for r in best.collect()} == {"q1", "q2"} and sorted({r.generation for r in history.collect()}) == [1, 2, 3]
    assert load_run(spark, str(tmp_path / "none")) is None


@pytest.mark.parametrize("phase", ["offspring", "manifest"])
def test_killed_run_resumes_to_the_same_rows(spark, tmp_path, monkeypatch, phase):
    samples = spark.createDataFrame([("s1", "one", "1", "k"), ("s2", "two", "2", None)], SAMPLES)
    config = EvolutionConfig(generations=3, population=4, length_bounds=(1, 50), threshold=99.0)
    whole = evolve(samples, config, snapshots=str(tmp_path / "whole"), events=str(tmp_path / "whole_log"))
    name, module = ("offspring", loop) if phase == "offspring" else ("write_json", __import__("evoframe.sources.datasets", fromlist=["x"]))
    real, calls = getattr(module, name), []

    def killed(*arguments, **more):
        calls.append(None)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return real(*arguments, **more)

    monkeypatch.setattr(module, name, killed)
    path, log = str(tmp_path / "state"), str(tmp_path / "log")
    with pytest.raises(KeyboardInterrupt):
        evolve(samples, config, snapshots=path, events=log)
    monkeypatch.setattr(module, name, real)
    assert load_state(spark, path)[3] == 1
    resumed = evolve(samples, config, snapshots=path, events=log, resume=True)
    assert rows(resumed[0].select("sample_id", "id", "fitness")) == rows(whole[0].select("sample_id", "id", "fitness"))
    columns = sorted(whole[1].columns)
    assert rows(resumed[1].select(*columns)) == rows(whole[1].select(*columns))
    events = lambda where: rows(spark.read.json(where).groupBy("phase", "generation").count())
    assert events(log) == events(str(tmp_path / "whole_log"))  # no phase twice


def ranked(docs, queries, k):
    """BM25 of every query over every document."""
    words = lambda t: [w for w in (x.strip(C.MARKS) for x in "".join(c.lower() if c.isascii() else c for c in t).split()) if w]
    held = {i: collections.Counter(words(t)) for i, t in docs if t and words(t)}
    df = collections.Counter(w for c in held.values() for w in c)
    average, out = sum(map(lambda c: sum(c.values()), held.values())) / len(held), []
    idf = lambda w: math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5))
    for q, t in queries:
        found = {}
        for i, c in held.items():
            n = sum(c.values())
            common = [w for w in set(words(t or "")) if c[w]]
            if common:
                found[i] = round(sum(idf(w) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n / average)) for w in common), 6)
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [4, 128])
def test_retrieval_equals_a_full_scan(spark, tmp_path, block):
    rng = random.Random(block)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    docs = [(i, " ".join([*(word() for _ in range(rng.randint(1, 60))), "The", "the."])) for i in range(300)] + [(1000 + i, f"same text w{i % 2}") for i in range(40)] + [(2000, ""), (2001, None), (2002, " ... ")]
    queries = [(f"q{i}", " ".join(word() for _ in range(rng.randint(1, 9)))) for i in range(25)] + [("the", "the"), ("both", "The w1 same!"), ("none", "unheard"), ("empty", ""), ("null", None), ("one", "w7")]
    corpus = spark.createDataFrame(docs, "id long, content string").withColumn("term", F.lit("clash"))
    index = C.build_index(corpus, block_rows=block)
    index.save(str(tmp_path / "index"))
    index = C.CorpusIndex.load(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame(queries, "id string, query string")
    found = C.retrieved(asked, index)
    got = sorted((r["query"], r["rank"], r["id"], r["bm25"]) for r in found.collect())
    want = ranked(docs, queries, 3)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(g[3] == pytest.approx(w[3], abs=2e-6) for g, w in zip(got, want))
    assert all(0 < r.score <= 1 for r in found.collect())
    assert C.retrieved(asked, C.build_index(corpus.limit(0))).count() == 0


def test_frequent_words_bring_no_documents(spark):
    """Rare words decide: documents that only share a word of all texts are never candidates."""
    docs = spark.createDataFrame([(i, "the common words " + (f"rare rare{i}" if i < 5 else "of every text")) for i in range(2_000)], "id long, text string")
    found = C.retrieved(spark.createDataFrame([("q", "the common rare rare3")], "id string, query string"), C.build_index(docs))
    assert [r["id"] for r in found.orderBy("rank").collect()] == [3, 0, 1]
    made = []
    real, C._scored = C._scored, lambda pairs, live, index: made.append(pairs.count()) or real(pairs, live, index)
    try:
        C.retrieved(spark.createDataFrame([("q", "the common rare rare3")], "id string, query string"), C.build_index(docs))
    finally:
        C._scored = real
    assert sum(made) <= 12


def shuffled_bytes(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_postings_are_not_shuffled(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(5_000)}" for _ in range(60))) for i in range(3_000)], "id long, text string").repartition(4).localCheckpoint()
    before = shuffled_bytes(spark)
    index = C.build_index(docs, list_words=20_000)
    assert shuffled_bytes(spark) - before < 5_000  # 175,000 postings; only totals of tasks may move
    held = index.blocks.agg(F.sum("n"), F.sum(F.size("postings")), F.max("n"), F.count_distinct("term")).first()
    assert held[0] == held[1] > 150_000 and held[2] <= C.BLOCK_ROWS and held[3] <= 5_000 and index.n == 3_000 and index.average == 60


def test_lists_of_any_size_give_the_same_documents(spark):
    rng = random.Random(4)
    odd = ["\x1cw1\x1d", "w1\x85w2", "w1\xa0", "\u2028w2", "\x0bW1\x0c", "\u0130X", "\xc9t\xc9", "'(w1)!'", "...", "w.1", "K\u212a", "\r\nw2\t"]
    docs = [(i, " ".join(rng.choice([*odd, f"w{rng.randrange(9)}", "common"]) for _ in range(rng.randint(0, 40)))) for i in range(150)] + [(500, None), (501, "...")]
    queries = [(f"q{i}", w) for i, w in enumerate(odd)] + [(f"r{i}", docs[i][1]) for i in range(10)]
    corpus, asked = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "id string, query string")
    got = [C.retrieved(asked, C.build_index(corpus, block_rows=8, list_words=n)).select("query", "rank", "id", "bm25", "score").orderBy("query", "rank").collect() for n in (1, 70, C.LIST_WORDS)]
    assert got[0] == got[1] == got[2] and {r.query for r in got[0]} == {i for i, t in queries if t and t != "..."}
    words = corpus.select("id", F.explode(C.terms("text")).alias("term")).groupBy("id", "term").agg(F.count("*").cast("int").alias("tf"))
    listed = C.build_index(corpus, list_words=70).blocks.select(F.explode("postings").alias("p"), "term").select("p.id", "term", "p.tf")
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, words.collect()))


def test_knowledge_comes_before_the_pool(spark):
    samples = spark.createDataFrame([("a", "melting of glacier ice", "x", None), ("b", "zzz", "x", None), ("c", "q", "x", "own")], SAMPLES)
    corpus = C.build_index(spark.createDataFrame([(1, "melting of glacier ice"), (2, "unrelated words here")], "id long, text string"))
    send = lambda prompts: ["* an item" if p.startswith("List") else offline_generate([p])[0] for p in prompts]
    best, _ = evolve(samples, EvolutionConfig(generations=1, population=2, vanilla_ratio=0.5), send, corpus=corpus, fill_knowledge=True)
    assert {r.sample_id: r.knowledge for r in best.collect()} == {"a": "1. melting of glacier ice", "b": "an item", "c": "own"}


def test_batches_run_at_once_and_stop(spark):
    samples = spark.createDataFrame([(f"s{i}",) for i in range(60)], "id string")
    running, most, lock = [], [], threading.Lock()

    def run(batch):
        with lock:
            running.append(1)
            most.append(len(running))
        time.sleep(0.5)
        out = batch.select(F.col("id").alias("sample_id"), F.length("id").alias("n"))
        with lock:
            running.pop()
        return out

    results, statistics = process(samples, run, 10, 60, at_once=3)
    assert statistics.successful == 60 and 2 <= max(most) <= 3 and results.count() == 60
    started = []

    def late(batch):
        time.sleep(2)
        n = batch.select(F.expr("count(*)")).first()[0]  # a job that starts after the time is over
        started.append(n)
        return batch.select(F.col("id").alias("sample_id"))

    assert process(samples, late, 60, 0.3)[1].timed_out == 60
    time.sleep(4)
    assert started == []
    assert process(samples.limit(0), run, 10)[1].total == 0


def test_samples_are_numbered_by_ranges(spark, tmp_path):
    frame = spark.createDataFrame([(f"id{i:03d}", i) for i in range(50)] * 2, "sample_id string, n int")
    write_samples(frame.repartition(4), str(tmp_path / "out"))
    found = {r["sample"]: r.sample_id for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert found == {f"sample_{i + 1}_id{i:03d}": f"id{i:03d}" for i in range(50)}


def test_limit_holds_over_workers(spark):
    stamps = limited(lambda prompts: [str(time.time()) for _ in prompts], 240, 4)  # one a second in each of four tasks
    from evoframe.sources.models import generated

    asked = spark.range(12).repartition(4).select(F.col("id").cast("string").alias("p"))
    times = sorted(float(r.output) for r in generated(asked, "p", stamps).collect())
    assert len(times) == 12 and times[-1] - times[0] >= 1.5
    assert max(sum(t <= s < t + 1 for s in times) for t in times) <= 2 * 4
