"""Novelty search with local competition over populations.

A population is the rows of one ``sample_id``; populations never meet, so it is the
partitioning key throughout. Rows carry ``id``, ``pos`` (insertion order), ``fitness``
and ``embedding``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evoframe.session import cut, small_side

#: Rows, and rows times components, of a block of the distance search; two blocks are one task's state.
BLOCK_ROWS, BLOCK_VALUES = 16384, 1 << 20
#: Rows that ask together, and pairs whose distance is taken exactly together.
TILE_ROWS, EXACT_PAIRS = 128, 1 << 16
#: Pairs that are worth a task, tasks a meeting of two blocks so that hashing seldom puts two in one, and tasks at most.
TASK_PAIRS, MEETING_TASKS, TASKS = 1 << 22, 4, 10_000
#: Rows of a population whose pairs a self-join makes one by one; larger ones are searched in blocks.
JOIN_ROWS = 256
#: Distances and scores are rounded before they are compared, as summation order is not fixed.
PLACES = 6


def nearest_join(traj: DataFrame, k: int, join_rows: int = JOIN_ROWS) -> DataFrame:
    """k nearest other rows of each row's population by a self-join.

    The join makes every pair of a population a row, so populations of more than
    ``join_rows`` rows go to the block search: rows joined stay below ``join_rows`` times
    the rows given.
    """
    rows = traj.where("embedding IS NOT NULL").select("sample_id", "id", "pos", "embedding")
    large = rows.groupBy("sample_id").count().where(F.col("count") > join_rows).select("sample_id")
    a = rows.join(large, "sample_id", "left_anti")
    b = a.select("sample_id", F.col("id").alias("nid"), F.col("pos").alias("npos"), F.col("embedding").alias("other"))
    square = F.aggregate(F.zip_with("embedding", "other", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    pairs = a.join(b, "sample_id").where("id <> nid").select("sample_id", "id", "nid", "npos", F.round(F.sqrt(square), PLACES).alias("dist"))
    return _k_smallest(pairs, k).unionByName(nearest(rows.join(large, "sample_id", "left_semi"), k))


def _k_smallest(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("sample_id", "id").orderBy("dist", "npos")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _without_idle_copies(rows: pd.DataFrame, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places, in order, of rows that can be among k nearest: of equal vectors the first k and one that may ask itself."""
    if not rows["id"].is_unique:
        return np.arange(len(rows))
    group = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.dtype.itemsize * vectors.shape[1]}").ravel(), return_inverse=True)[1].ravel()
    return np.flatnonzero(pd.Series(group).groupby(group).cumcount().to_numpy() <= k)


def _squares(x: np.ndarray, y: np.ndarray):
    """A function of rows of x: their squared distances to y, less a number a row, by one product of matrices; those numbers; and how far off they may be."""
    own, others = (x * x).sum(1), (y * y).sum(1)
    off = 8 * np.finfo(float).eps * (x.shape[1] + 8) * (own.max() + others.max())
    if not np.isfinite(off):  # squares beyond doubles
        return lambda at: np.stack([((q - y) ** 2).sum(1) for q in x[at]]), np.zeros(len(x)), 0.0
    left, right = np.hstack([-2 * x, np.ones((len(x), 1))]), np.hstack([y, others[:, None]]).T.copy()
    return lambda at: left[at] @ right, own, off


def _k_of(asking: pd.DataFrame, x: np.ndarray, asked: pd.DataFrame, y: np.ndarray, k: int, alike: bool) -> pd.DataFrame:
    """The k rows of ``asked``, which is in order of pos, nearest to each of ``asking``; ``alike``: rows of one id can be on both sides.

    Matrix products give a bound that the k-th distance keeps; the pairs within it are
    measured exactly, rounded and ranked.
    """
    keep = _without_idle_copies(asked, y, k)
    asked, y = asked.iloc[keep], y[keep]
    ids, nids, npos = asking["id"].to_numpy(), asked["id"].to_numpy(), asked["pos"].to_numpy()
    parts = []
    if len(x) and len(y) and k > 0:
        square, own, off = _squares(x, y)
        groups = len(y) // 16 if len(y) >= 64 * k else len(y)
        for low in range(0, len(x), TILE_ROWS):
            at = slice(low, low + TILE_ROWS)
            found = square(at)
            if alike:
                found[ids[at, None] == nids[None, :]] = np.inf
            # k groups of columns each have a row within the k-th least of the groups' minima.
            least = found[:, : len(y) // groups * groups].reshape(len(found), -1, groups).min(1)
            bound = np.partition(least, k - 1, axis=1)[:, k - 1] if k <= groups else np.full(len(found), np.inf)
            reach = (np.sqrt(np.maximum(bound + own[at] + off, 0)) * (1 + 1e-12) + 2 * 10.0**-PLACES) ** 2 - own[at] + off
            r, c = np.nonzero(found <= np.minimum(reach, np.finfo(float).max)[:, None])
            r, dist = r + low, np.empty(len(r))
            for i in range(0, len(r), EXACT_PAIRS):
                j = slice(i, i + EXACT_PAIRS)
                dist[j] = np.round(np.sqrt(((x[r[j]] - y[c[j]]) ** 2).sum(1)), PLACES)
            order = np.lexsort((c, dist, r))
            r, c, dist = r[order], c[order], dist[order]
            best = (np.arange(len(r)) - np.searchsorted(r, r) < k) & np.isfinite(dist)
            parts.append((ids[r[best]], nids[c[best]], npos[c[best]], dist[best]))
    found = [np.concatenate(p) for p in zip(*parts)] or [[]] * 4
    return pd.DataFrame(dict(zip(("id", "nid", "npos", "dist"), found)))


def _cell_search(k: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        vectors = np.stack(rows["embedding"]).astype(float)
        finite = np.isfinite(vectors).all(1)  # others are at no distance
        rows, vectors = rows[finite].drop(columns="embedding"), vectors[finite]
        sides = [(rows[held], vectors[held]) for held in ((rows["own"] == n).to_numpy() for n in sorted({key[1], key[2]}))]
        pairs = [(sides[0], sides[0])] if len(sides) == 1 else [(sides[0], sides[1]), (sides[1], sides[0])]
        return pd.concat([_k_of(*asking, *asked, k, len(sides) == 1) for asking, asked in pairs]).assign(sample_id=key[0])[["sample_id", "id", "nid", "npos", "dist"]]

    return run


def nearest(traj: DataFrame, k: int, block_rows: int = BLOCK_ROWS, materialised: bool = False) -> DataFrame:
    """k nearest other rows of each row's population: sample_id, id, nid, npos, dist, rank.

    Ties go by the neighbour's ``pos``. A row is not its own neighbour, nor are rows of
    the same id. Populations are dealt in hashed blocks of bounded size; two blocks meet in
    one task, which asks both ways, and each meeting hands on k rows a query only. All
    pairs are looked at, as no bound parts vectors of many components. Blocks are counted
    first, so that meetings are dealt by their own keys over tasks by their work: a join by
    population would leave all of a population's meetings in the task that holds its rows.
    Both steps read narrow columns, which are materialised unless traj is already.
    """
    rows = traj.where("embedding IS NOT NULL").select("sample_id", "id", "pos", "embedding")
    rows = rows if materialised else cut(rows)
    held = F.least(F.lit(block_rows), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_VALUES) / F.greatest(F.max(F.size("embedding")), F.lit(1)))))
    sizes = rows.where("sample_id IS NOT NULL").groupBy("sample_id").agg(F.count("*").cast("double").alias("n"), held.alias("held"))
    sizes = cut(sizes.withColumn("blocks", F.ceil(F.col("n") / F.col("held")).cast("int")))
    work = sizes.selectExpr("count(*) AS populations", "sum(n * blocks / held) AS filled", f"sum(n * n) / {TASK_PAIRS} AS shares", "sum(blocks * (blocks + 1D) / 2) AS meetings").first()
    tasks = int(min(TASKS, max(1, work.filled or 0, min(work.shares or 0, MEETING_TASKS * (work.meetings or 0)))))
    dealt = rows.join(small_side(sizes.select("sample_id", "blocks"), work.populations), "sample_id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("sample_id", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "pos", "embedding").repartition(tasks, "sample_id", "a", "b")
    of = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType().add("sample_id", of["sample_id"]).add("id", of["id"]).add("nid", of["id"]).add("npos", of["pos"]).add("dist", "double")
    return _k_smallest(met.groupBy("sample_id", "a", "b").applyInPandas(_cell_search(k), schema), k)


def novelty(neighbours: DataFrame, traj: DataFrame) -> DataFrame:
    """sample_id, id, novelty: mean distance to the neighbours there are, 0 without any."""
    mean = neighbours.groupBy("sample_id", "id").agg(F.round(F.avg("dist"), PLACES).alias("novelty"))
    return traj.where("embedding IS NOT NULL").select("sample_id", "id").distinct().join(mean, ["sample_id", "id"], "left").na.fill(0.0, ["novelty"])


def local_competition(neighbours: DataFrame, traj: DataFrame) -> DataFrame:
    """sample_id, id, local_competition: mean positive fitness advantage over neighbours that have a fitness.

    0 for a row without fitness and for a row without such a neighbour.
    """
    fit = traj.select("sample_id", "id", "fitness")
    other = fit.where("fitness IS NOT NULL").select("sample_id", F.col("id").alias("nid"), F.col("fitness").alias("nfitness"))
    gain = neighbours.join(fit.where("fitness IS NOT NULL"), ["sample_id", "id"]).join(other, ["sample_id", "nid"])
    mean = gain.groupBy("sample_id", "id").agg(F.round(F.avg(F.greatest(F.lit(0.0), F.col("fitness") - F.col("nfitness"))), PLACES).alias("local_competition"))
    return traj.where("embedding IS NOT NULL").select("sample_id", "id").distinct().join(mean, ["sample_id", "id"], "left").na.fill(0.0, ["local_competition"])


def scores(traj: DataFrame, k: int = 5) -> DataFrame:
    """traj with novelty and local_competition.

    Neighbours are searched once, whatever reads the result, and the narrow columns that it takes are read once.
    """
    held = cut(traj.select("sample_id", "id", "pos", "fitness", "embedding"))
    near = cut(nearest(held, k, materialised=True))
    rows = held.select("sample_id", "id", "fitness", "embedding")
    both = cut(novelty(near, rows).join(local_competition(near, rows), ["sample_id", "id"]))
    return traj.drop("novelty", "local_competition").join(both, ["sample_id", "id"], "left")


def pareto_front(scored: DataFrame, strict: bool = False) -> DataFrame:
    """Rows that no row of another id in their population dominates, for both scores the higher the better.

    The default counts equality on both scores as dominance, so different ids of equal
    scores remove each other; ``strict`` asks for one score to be better. Rows without a
    score are left out. One ordered window replaces the self-join: a row is dominated if
    rows before it in descending order reach its second score.
    """
    rows = scored.where("novelty IS NOT NULL AND local_competition IS NOT NULL")
    points = rows.groupBy("sample_id", "novelty", "local_competition").agg(F.count_distinct("id").alias("ids"))
    higher = Window.partitionBy("sample_id").orderBy(F.desc("novelty"), F.desc("local_competition")).rowsBetween(Window.unboundedPreceding, -1)
    front = points.withColumn("best", F.max("local_competition").over(higher)).where("best IS NULL OR best < local_competition")
    if not strict:
        front = front.where("ids = 1")
    return rows.join(front.select("sample_id", "novelty", "local_competition"), ["sample_id", "novelty", "local_competition"], "left_semi")


def pareto_by_join(scored: DataFrame, strict: bool = False) -> DataFrame:
    """The same front by an anti-join, as the definition reads."""
    rows = scored.where("novelty IS NOT NULL AND local_competition IS NOT NULL")
    n = rows.select(F.col("sample_id").alias("s"), F.col("id").alias("i"), F.col("novelty").alias("n"), F.col("local_competition").alias("l"))
    better = (F.col("n") >= F.col("novelty")) & (F.col("l") >= F.col("local_competition"))
    if strict:
        better = better & ((F.col("n") > F.col("novelty")) | (F.col("l") > F.col("local_competition")))
    return rows.join(n, (F.col("sample_id") == F.col("s")) & (F.col("id") != F.col("i")) & better, "left_anti")
