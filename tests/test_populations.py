"""Population, selection and sampling operators on small tables with known results."""

import random

import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from evoframe.functions.text import cache_key
from evoframe.operators import population as P
from evoframe.operators import retrieval as R
from evoframe.operators import sampling as S
from evoframe.operators import selection as N
from evoframe.operators.evaluation import classification, kendall_tau_b
from evoframe.session import small_side

SCHEMA = "sample_id int, id long, pos long, embedding array<float>, reasoning string, exact_match boolean, fitness double"


@pytest.fixture(scope="module")
def ten(spark):
    return spark.createDataFrame([(1, i, i, [float(i), 0.0], f"r{i}", i < 7, 0.5 + 0.05 * i) for i in range(10)], SCHEMA)


def ids(df, *order):
    return [r.id for r in df.orderBy(*(order or ("pos",))).collect()]


def test_lowest_go_and_order_ascends(ten):
    assert ids(P.without_lowest(ten, 3)) == list(range(3, 10))
    assert [r.pos for r in P.without_lowest(ten, 3).orderBy("pos").collect()] == list(range(7))
    assert P.without_lowest(ten, 10).count() == 0
    assert ids(P.without_lowest(ten, 0)) == list(range(10))


def test_unevaluated_go_first(spark):
    rows = spark.createDataFrame([(1, 1, 0, None, "a", None, None), (1, 2, 1, None, "b", True, 0.1), (1, 3, 2, None, "c", True, 0.9)], SCHEMA)
    assert ids(P.without_lowest(rows, 1)) == [2, 3]
    assert ids(P.best(rows, 5), "rank") == [3, 2]
    assert ids(P.where_correct(rows)) == [2, 3] and ids(P.where_incorrect(rows)) == []


def test_statistics(ten):
    row = P.statistics(ten).first()
    assert (row["size"], row.correct, row.accuracy, row.avg_fitness) == (10, 7, 0.7, 0.725)
    assert P.converged(ten, 0.95).first().converged and not P.converged(ten, 0.96).first().converged


def test_first_duplicate_stays(ten):
    twice = ten.unionByName(ten.withColumn("pos", F.col("pos") + 100))
    assert sorted(r.pos for r in P.without_duplicates(twice).collect()) == list(range(10))


def test_neighbours_and_scores(spark):
    points = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [0.0, 2.0])]
    rows = spark.createDataFrame([(1, i, i, e, "", None, f) for (i, e), f in zip(points, (0.8, 0.5, 0.6, None, 0.1))], SCHEMA)
    near = N.nearest(rows, 2)
    assert [(r.nid, r.dist) for r in near.where("id = 0").orderBy("rank").collect()] == [(1, 1.0), (2, 1.0)]
    assert {(r.id, r.nid, r["rank"]) for r in near.collect()} == {(r.id, r.nid, r["rank"]) for r in N.nearest_join(rows, 2).collect()}
    scores = {r.id: (r.novelty, r.local_competition) for r in N.scores(rows, 2).collect()}
    assert scores[0] == (1.0, 0.25) and scores[3][1] == 0.0


def test_block_search_equals_join(spark):
    random.seed(3)
    rows = spark.createDataFrame([(i % 3, i, i, [random.random() for _ in range(5)], "", None, random.random()) for i in range(90)], SCHEMA)
    got = {(r.id, r.nid, r["rank"]) for r in N.nearest(rows, 4, block_rows=7).collect()}
    assert got == {(r.id, r.nid, r["rank"]) for r in N.nearest_join(rows, 4).collect()}


@pytest.mark.parametrize("strict", [False, True])
def test_front_equals_definition(spark, strict):
    random.seed(5)
    rows = spark.createDataFrame([(i % 4, i, i, random.randint(0, 6) / 2, random.randint(0, 6) / 2) for i in range(200)], "sample_id int, id long, pos long, novelty double, local_competition double")
    assert ids(N.pareto_front(rows, strict)) == ids(N.pareto_by_join(rows, strict))


def test_equal_rows_remove_each_other_unless_strict(spark):
    rows = spark.createDataFrame([(1, 1, 0, 1.0, 1.0), (1, 2, 1, 1.0, 1.0)], "sample_id int, id long, pos long, novelty double, local_competition double")
    assert N.pareto_front(rows).count() == 0 and N.pareto_front(rows, strict=True).count() == 2


def test_probabilities_and_draws(spark):
    rows = spark.createDataFrame([(1, i, i, lc) for i, lc in enumerate((0.8, 0.2, 0.5))], "sample_id int, id long, pos long, local_competition double")
    assert [r.p for r in S.probabilities(rows, 0.1).orderBy("pos").collect()] == pytest.approx([0.9 / 1.8, 0.3 / 1.8, 0.6 / 1.8], abs=1e-8)
    counts = {r.id: r["count"] for r in S.with_replacement(rows, 3000, 1, 0.1).groupBy("id").count().collect()}
    assert sum(counts.values()) == 3000 and abs(counts[0] - 1500) < 120
    flat = rows.withColumn("local_competition", F.lit(0.0))
    assert [round(r.p, 6) for r in S.probabilities(flat, 0.0).collect()] == [0.333333] * 3
    assert S.without_replacement(rows, 5, 1).count() == 3 and S.without_replacement(rows, 2, 1, F.col("local_competition")).count() == 2


def test_replacement_keeps_size_and_best(ten):
    kids = ten.select("sample_id", (F.col("id") + 100).alias("id"), "pos", "embedding", "reasoning", F.lit(None).cast("boolean").alias("exact_match"), F.lit(None).cast("double").alias("fitness"))
    out = P.replaced(ten, kids, 10)
    assert out.count() == 10 and 9 in ids(out)


def test_metrics(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "predicted boolean, truth boolean")
    assert tuple(classification(rows).first()) == (4, 0.5, 0.5, 0.5, 0.5)
    assert tuple(classification(rows.where("truth")).first()) == (2, 0.5, 0.0, 0.0, 0.0)
    ranks = spark.createDataFrame([(1, 1, 1), (1, 2, 3), (1, 3, 2), (2, 1, 1), (2, 2, 1)], "k int, x int, y int")
    assert {r.k: r.tau for r in kendall_tau_b(ranks, "k", "x", "y").collect()} == {1: pytest.approx(1 / 3, abs=1e-6), 2: None}


def test_cache(spark):
    rows = spark.createDataFrame([("m", "a"), ("m", "b"), ("m", "b")], "model string, text string")
    cache = rows.where("text = 'a'").select(cache_key("model", "text").alias("key"), F.array(F.lit(1.0)).alias("embedding"))
    assert tuple(R.hit_rate(R.lookup(rows, cache)).first()) == (1, 2, 0.333333, 2)
    new = R.misses(rows, cache)
    assert new.count() == 1
    assert R.extended(cache, new.withColumn("embedding", F.array(F.lit(2.0)))).count() == 2


def test_populations_beyond_the_join_are_searched_in_blocks(spark):
    random.seed(4)
    rows = spark.createDataFrame([(i % 7 % 2, i, i, [random.random() for _ in range(4)], "", None, None) for i in range(70)], SCHEMA)
    few, every = ({(r.sample_id, r.id, r.nid, r["rank"]) for r in N.nearest_join(rows, 3, join_rows=n).collect()} for n in (35, 1000))
    assert few == every and len(every) == 210


def test_meetings_of_one_population_are_dealt_over_tasks(spark, monkeypatch):
    """Each meeting reports its task; few share one, whether sizes are broadcast or not."""

    def places(k):
        def run(key, rows):
            at = TaskContext.get().partitionId()
            return pd.DataFrame({"sample_id": [key[0]], "id": [key[1] * 100 + key[2]], "nid": [at], "npos": [at], "dist": [0.0]})

        return run

    monkeypatch.setattr(N, "_cell_search", places)
    rows = spark.createDataFrame([(1, i, i, [float(i), 1.0], "", None, None) for i in range(70)], SCHEMA)
    for bound in (0, N.JOIN_ROWS):
        monkeypatch.setattr(N, "small_side", lambda df, held, bound=bound: small_side(df, held, bound), raising=False)
        met = [r.nid for r in N.nearest(rows, 1, block_rows=7).collect()]
        assert len(met) > 40 and len(set(met)) > len(met) / 2


def _brute(rows, k):
    out = []
    for i, p, v in rows:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w)) ** 0.5, 6), q, j) for j, q, w in rows if j != i)
        out += [(i, j, d) for d, _, j in near[:k]]
    return sorted(out)


@pytest.mark.parametrize("shift", [0.0, 10000.0])
def test_matrix_search_equals_definition(shift):
    """Copies, ties and rows far from the origin, in one block and in meetings of three."""
    random.seed(6)
    rows = [(i, (i * 37) % 400, [float(random.randint(0, 3)) + shift if i % 3 else shift for _ in range(4)]) for i in range(400)]
    for blocks in (1, 3):
        frame = pd.DataFrame([(i % blocks, i, p, v) for i, p, v in rows], columns=["own", "id", "pos", "embedding"])
        cells = [N._cell_search(3)((0, a, b), frame[frame["own"].isin([a, b])]) for a in range(blocks) for b in range(a, blocks)]
        found = pd.concat(cells).sort_values(["id", "dist", "npos"]).groupby("id").head(3)
        assert sorted(zip(found["id"], found["nid"], found["dist"])) == _brute(rows, 3)


def test_scores_search_neighbours_once(spark):
    """Fronts and draws over scores hold no search of their own."""
    rows = spark.createDataFrame([(1, i, i, [float(i), 1.0], "", None, 0.5) for i in range(6)], SCHEMA)
    plan = N.pareto_front(N.scores(rows, 2))._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell_search" not in plan and "InPandas" not in plan
