"""MinHash near-duplicate groups by one-permutation hashing.

Every text gives one pass of 64-bit shingle hashes. One permutation splits them
into bins; empty bins borrow by optimal densification; bands of bins are bucket
keys. Texts with equal shingle sets are one class from the start. Each bucket
links its members to its smallest one only (a star), so candidates grow with the
rows of the band table, never with its square. Full sets confirm the links.

A star can miss a link between two members that both differ from its centre.
Clusters of star candidates that the confirmed links leave in several components
are therefore searched once more. Two sets of similarity s share an element among the
1 - s of each that come first in any common order ("prefix filter", Chaudhuri, Ganti
and Kaushik, 2006); in an order by frequency those are rare ones, so a text's own words
tell it from others of its template. Stars over shared first elements, among sets of
admissible sizes, cut a cluster into small parts. In a part, rows outside its largest
component meet the rows of admissible sizes in blocks of bounded size, whose
intersections are counted inside the task, and only pairs of components leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoframe.llm import vectext
from evoframe.llm.common import id_text
from evoframe.llm.components import connected
from evoframe.session import cut, parts_for, small_side

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
BANDS = 60
ROWS = 6
#: Shingles, and rows, that a block of the search holds on either side in expectation.
BLOCK_SHINGLES = 1 << 17
BLOCK_ROWS = 2048
#: Bits of the hashed cells whose counts order shingles by frequency: a table of a megabyte, whatever the corpus.
CELL_BITS = 18
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_PROBES = 24


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document and the documents' offsets among them."""
    data = vectext.lowered(data)
    starts, ends, of = vectext.word_spans(data, at)
    runs, run_at = vectext.windows(vectext.span_hashes(data, starts, ends), of, words)
    runs = np.minimum(runs, _EMPTY - np.uint64(1))
    doc = np.repeat(np.arange(len(at) - 1), np.diff(run_at))
    order = np.lexsort((runs, doc))
    runs, doc = runs[order], doc[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])
    runs, doc = runs[new], doc[new]
    return runs, np.searchsorted(doc, np.arange(len(at)), "left")


class OnePermutation:
    """Densified one-permutation signatures of ``bins`` values.

    An empty bin walks a sequence of bins that depends only on its own number, and
    takes the value of the first one filled: some random probes, then all bins in a
    random order, so that even a set of one element fills its signature.
    """

    def __init__(self, bins: int):
        seeds = vectext.mix(np.arange(bins * _PROBES, dtype=np.uint64) + np.uint64(0xA5A5))
        self.bins = bins
        self.probes = (seeds % np.uint64(bins)).astype(np.int64).reshape(_PROBES, bins)
        self.order = vectext.mix(np.arange(bins * bins, dtype=np.uint64) + np.uint64(0x5A5A5A)).reshape(bins, bins)

    def __call__(self, hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """One row a set; sets must not be empty."""
        n = len(of) - 1
        doc = np.repeat(np.arange(n), np.diff(of))
        bin_ = (((hashes >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)).astype(np.int64)
        filled = np.full(n * self.bins, _EMPTY, np.uint64)
        np.minimum.at(filled, doc * self.bins + bin_, vectext.mix(hashes + np.uint64(1)) >> np.uint64(1))
        filled = filled.reshape(n, self.bins)
        out = filled.copy()
        rows, cols = np.nonzero(filled == _EMPTY)
        for probe in self.probes:
            if not len(rows):
                return out
            found = filled[rows, probe[cols]]
            out[rows, cols] = found
            rest = found == _EMPTY
            rows, cols = rows[rest], cols[rest]
        begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else []
        for a, b in zip(begins, np.r_[begins[1:], len(rows)] if len(rows) else []):
            there = np.flatnonzero(filled[rows[a]] != _EMPTY)
            out[rows[a], cols[a:b]] = filled[rows[a], there[self.order[np.ix_(cols[a:b], there)].argmin(1)]]
        return out


def _as_list(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1).view(np.int64)))


def _signatures(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signature = OnePermutation(bands * rows)
        for batch in batches:
            for part in vectext.slices(batch, "text"):
                sets, of = shingle_sets(*vectext.utf8(part.column("text")), words)
                sizes = np.diff(of)
                full = np.flatnonzero(sizes)
                keys = np.zeros((2, len(sizes)), np.uint64)
                band = np.zeros((len(sizes), 0), np.uint64)
                if len(full):
                    begins = of[:-1][full]
                    for k in range(2):
                        keys[k, full] = np.add.reduceat(vectext.mix(sets + np.uint64(0x1234567 + 0x9E3779B9 * (k + 1))), begins)
                    values = signature(sets, np.r_[begins, len(sets)]).reshape(len(full), bands, rows)
                    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(full), bands))
                    for r in range(rows):
                        key = vectext.mix(key * np.uint64(5) + values[:, :, r])
                    band = np.zeros((len(sizes), bands), np.uint64)
                    band[full] = key
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), _as_list(band)],
                    ["doc_id", "n_shingles", "key_a", "key_b", "bands"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vectext.slices(batch, "text"):
                sets, of = shingle_sets(*vectext.utf8(part.column("text")), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([sets[a:b].tobytes() for a, b in zip(of[:-1], of[1:])], pa.binary())], ["node", "elements"])

    return run


def similar(shared, size_a, size_b, percent: int = SIMILARITY_PERCENT):
    """Exact: 100 * intersection >= percent * union."""
    return 100 * shared >= percent * (size_a + size_b - shared)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column("set_u"), batch.column("set_v"))):
                a, b = a.as_py(), b.as_py()
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                ok[i] = similar(int((large[at] == small).sum()), len(x), len(y), percent)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(ok)], ["u", "v", "linked"])

    return run


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Intersection sizes of every left set with every right set, by incidence products over shared elements."""
    out = np.zeros((len(left), len(right)), np.float32)
    values = np.concatenate(left + right)
    side = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    _, number, count = np.unique(values, return_inverse=True, return_counts=True)
    common = count > 1
    rank = np.cumsum(common) - 1
    keep = common[number]
    number, side = rank[number[keep]], side[keep]
    order = np.argsort(number, kind="stable")
    number, side = number[order], side[order]
    for low in range(0, int(common.sum()), width):
        a, b = np.searchsorted(number, [low, low + width])
        x = np.zeros((len(left) + len(right), width), np.float32)
        x[side[a:b], number[a:b] - low] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out


def _search_blocks(percent: int):
    """Rows come sorted by (piece, window, query_block, row_block); each such group is one bounded search."""

    def search(rows: list[tuple]) -> list[tuple[int, int]]:
        asking = [r for r in rows if r[0]]
        asked = [r for r in rows if not r[0]]
        if not asking or not asked:
            return []
        a, b = [np.frombuffer(r[2], np.uint64) for r in asking], [np.frombuffer(r[2], np.uint64) for r in asked]
        shared = _shared_counts(a, b)
        linked = similar(shared, np.array([[len(x)] for x in a]), np.array([len(x) for x in b]), percent)
        x, y = np.array([r[1] for r in asking]), np.array([r[1] for r in asked])
        i, j = np.nonzero(linked & (x[:, None] != y))
        return list({(min(p, q), max(p, q)) for p, q in zip(x[i].tolist(), y[j].tolist())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.int64()), pa.array([q for _, q in pairs], pa.int64())], ["u", "v"])

        group, held = None, []
        for batch in batches:
            for *key, asks, comp, elements in zip(*(batch.column(c).to_pylist() for c in ("piece", "window", "query_block", "row_block", "asks", "comp", "elements"))):
                if key != group:
                    if pairs := search(held):
                        yield out(pairs)
                    group, held = key, []
                held.append((asks, comp, elements))
        if pairs := search(held):
            yield out(pairs)

    return run


def near_groups(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT, bands: int = BANDS, rows: int = ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set is its distinct ``words``-word shingles of A-Z-lowered text; a
    shorter text is one shingle. Sets with 100 * intersection >= percent * union are
    linked, and component_id is the smallest doc_id reachable. Null, empty and blank
    texts have no shingle and stay alone, as do rows without doc_id, whose component_id
    is null. Rows that repeat a doc_id share a component, whatever their texts. At
    similarity 0.8 the default bands miss a pair with probability 1e-8. Other columns
    are ignored; no rows give no rows.
    """
    texts = id_text(docs)
    signed = cut(texts.mapInArrow(_signatures(words, bands, rows), "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>"))
    keys = ["n_shingles", "key_a", "key_b"]
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    classes = cut(classes)
    banded = classes.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    stars = banded.groupBy("bucket").agg(F.min(F.struct("rep", "n_shingles")).alias("c"), F.count("*").alias("k")).where("k > 1")
    spokes = banded.join(stars.select("bucket", "c"), "bucket").where("rep <> c.rep")
    fits = (F.least("n_shingles", "c.n_shingles") * 100 >= F.greatest("n_shingles", "c.n_shingles") * percent)
    candidates = cut(spokes.select(F.col("c.rep").alias("u"), F.col("rep").alias("v"), F.col("c.n_shingles").alias("size_u"), F.col("n_shingles").alias("size_v"), fits.alias("fits")).distinct())
    parts = parts_for(candidates.count())
    candidates = candidates.coalesce(parts)
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("node"), F.col(f"size_{x}").alias("n_shingles")) for x in "uv"])).alias("end")
    nodes = cut(candidates.select(ends).select("end.*").distinct(), parts)
    wanted = small_side(nodes)
    sets = texts.join(wanted, texts["doc_id"] == wanted["node"], "left_semi")
    sets = cut(sets.mapInArrow(_sets(words), "node long, elements binary"))
    if sets.count() > nodes.count():  # rows that repeat a doc_id
        sets = cut(sets.distinct())
    ready = candidates.where("fits").select("u", "v")
    ready = ready.join(sets.select(F.col("node").alias("v"), F.col("elements").alias("set_v")), "v")
    ready = ready.join(sets.select(F.col("node").alias("u"), F.col("elements").alias("set_u")), "u")
    links = cut(ready.mapInArrow(_confirm(percent), "u long, v long, linked boolean").where("linked").select("u", "v"))
    roots = cut(connected(links), parts)
    more = _rest(candidates, roots, nodes, sets, percent, block_shingles, parts)
    if more is not None:
        stars_ = roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        roots = cut(connected(stars_.unionByName(more)), parts)
    placed = classes.select(*keys, "rep").join(roots, F.col("rep") == F.col("node"), "left").select(*keys, F.coalesce("root", "rep").alias("component"))
    out = signed.select("doc_id", *keys).join(placed, keys, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _cells(elements: np.ndarray) -> np.ndarray:
    return (vectext.mix(elements) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << CELL_BITS, np.int64)
    for batch in batches:
        for elements in batch.column("elements"):
            total += np.bincount(_cells(np.frombuffer(elements.as_py(), np.uint64)), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])


def prefix_length(n: int, percent: int) -> int:
    """How many first elements of a set of ``n`` must hold one of any similar set's first ones."""
    return n - -(-n * percent // 100) + 1


def _prefixes(frequency: np.ndarray, percent: int):
    """node, cluster, class, element: the first elements of each set by frequency, then hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                firsts = []
                for raw in part.column("elements"):
                    elements = np.frombuffer(raw.as_py(), np.uint64)
                    n = prefix_length(len(elements), percent)
                    firsts.append(elements[np.lexsort((elements, frequency[_cells(elements)]))[:n]])
                of = pa.array(np.repeat(np.arange(len(firsts)), [len(x) for x in firsts]))
                columns = [part.column(c).take(of) for c in ("node", "cluster", "class")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(firsts).view(np.int64))], ["node", "cluster", "class", "element"])

    return run


def _rest(candidates: DataFrame, roots: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, block_shingles: int, parts: int) -> DataFrame | None:
    """Links between components of one candidate cluster that no star has tested, as pairs of components."""
    clusters = cut(connected(candidates.select("u", "v")), parts).select("node", F.col("root").alias("cluster"))
    members = clusters.join(roots.select("node", F.col("root").alias("comp")), "node", "left").join(nodes, "node")
    # Similar sets are of one size class or of neighbouring ones.
    size_class = F.floor(F.log("n_shingles") / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    members = cut(members.select("node", "cluster", F.coalesce("comp", "node").alias("comp"), "n_shingles", size_class.alias("class")), parts)
    whole = members.groupBy("cluster").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("k"))
    open_ = members.join(whole.where("a <> b AND k > 2").select("cluster"), "cluster", "left_semi").select("node", "cluster", "class")
    rows = cut(open_.join(sets, "node"))
    if rows.isEmpty():
        return None
    frequency = np.zeros(1 << CELL_BITS, np.int64)
    counted = rows.mapInArrow(_cell_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # one row a cell
    frequency[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    first = rows.mapInArrow(_prefixes(frequency, percent), "node long, cluster long, class int, element long")
    # Classes a and a + 1 share the window a + 1.
    entries = first.select("node", "cluster", "element", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("window"))
    key = ["cluster", "element", "window"]
    centres = entries.groupBy(*key).agg(F.min("node").alias("centre"), F.count("*").alias("k")).where("k > 1").drop("k")
    spokes = cut(entries.join(centres, key).where("node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct())
    pieces = cut(connected(spokes), parts).select("node", F.col("root").alias("piece"))
    members = pieces.join(members, "node").select("node", "piece", "comp", "n_shingles", "class")
    return _searched(cut(members, parts), sets, percent, block_shingles, parts)


def _searched(members: DataFrame, sets: DataFrame, percent: int, block_shingles: int, parts: int) -> DataFrame | None:
    """Links between components of one piece: rows outside its largest component against its rows of like sizes."""
    largest = members.groupBy("piece", "comp").agg(F.count("*").alias("k")).groupBy("piece").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("k", "comp")).alias("main"))
    open_ = members.join(largest.where("comps > 1").select("piece", "main"), "piece")
    asking = open_.where("comp <> main").select("*", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("window"))
    asked = open_.withColumn("window", F.col("class"))
    blocks = lambda: F.greatest(F.ceil(F.sum("n_shingles") / F.lit(float(block_shingles))), F.ceil(F.count("*") / F.lit(float(BLOCK_ROWS)))).cast("int")
    sides = [side.groupBy("piece", "window").agg(blocks().alias(name)) for side, name in ((asking, "query_blocks"), (asked, "row_blocks"))]
    plan = cut(sides[0].join(sides[1], ["piece", "window"]), parts)
    if plan.isEmpty():
        return None
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = lambda side, asks, q, r: side.join(plan, ["piece", "window"]).select("node", "piece", "window", q.alias("query_block"), "row_blocks", F.lit(asks).alias("asks"), "comp").select("node", "piece", "window", "query_block", r.alias("row_block"), "asks", "comp")
    dealt = placed(asked, False, every("query_blocks"), at("row_blocks")).unionByName(placed(asking, True, at("query_blocks"), every("row_blocks")))
    group = ["piece", "window", "query_block", "row_block"]
    dealt = dealt.join(sets, "node").repartition(*group).sortWithinPartitions(*group)
    return cut(dealt.mapInArrow(_search_blocks(percent), "u long, v long").distinct())
