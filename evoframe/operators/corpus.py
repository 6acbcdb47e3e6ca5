"""Retrieval over a corpus by an inverted index, ranked by BM25.

Posting lists are made where texts are read, of some two million words at a time: postings
are not shuffled, and a document's lie together. They are cut into blocks of bounded size,
each with the largest weight in it. Queries meet the index by term. A query's rarest term
gives a first threshold, the score its k-th document surely has; terms whose weights
together stay below it name no document alone, and blocks that cannot reach it with all
other terms are not opened. What an opened posting gives is added up by document. Terms
too light to be opened are looked up only for the documents that can still be among the
best with them, so the top k are those of a full scan. Texts are read twice to build the
index, first for their lengths, and once for what is returned.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from evoframe.session import cut, small_side, use_checkpoint_dir, written

K1, B = 1.2, 0.75
#: Postings of a block at most.
BLOCK_ROWS = 128
#: Words whose posting lists are made together, a last whole document more.
LIST_WORDS = 1 << 21
#: Marks that are taken off either end of a word.
MARKS = ".,;:!?()[]\"'"
_MARKS = MARKS.encode()
#: Scores are rounded to six places before they are compared, so bounds leave as much room.
ROOM = 2e-6


def terms(text) -> Column:
    """Words of a text: parted at ASCII white space, without marks at either end, A-Z lower-cased; null for null."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.transform(F.split(lowered, r"[\x20\x09-\x0D]+", -1), lambda w: F.trim(w, F.lit(MARKS)))
    return F.filter(words, lambda w: w != "")


def idf(df, documents) -> Column:
    return F.log(1 + (documents - df + 0.5) / (df + 0.5))


def saturated(tf, length, average) -> Column:
    """How much of a term's weight its occurrences in a document give, 0 to K1 + 1; of Columns or of arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


class _Numbers(dict):
    """Numbers of the terms of raw lower-cased words in UTF-8, as terms() makes them; -1 for words of marks only."""

    def __init__(self):
        super().__init__()
        self.terms: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        term = word.strip(_MARKS)
        self[word] = number = self.terms.setdefault(term, len(self.terms)) if term else -1
        return number


def _lengths(batches):
    """Texts with a word, and their words, of Arrow batches (text)."""
    for batch in batches:
        lengths = [sum(map(bool, (w.strip(_MARKS) for w in (text.as_py() or b"").split()))) for text in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, lengths))], pa.int64()), pa.array([sum(lengths)], pa.int64())], ["n", "words"])


def _listed(ids: pa.Array, found: list[np.ndarray], numbers: _Numbers, average: float, block_rows: int) -> pa.RecordBatch:
    """Blocks (term, most, n, postings) of some documents, by term."""
    lengths = np.array([len(n) for n in found])
    terms = pa.array(list(numbers.terms), pa.binary())
    order = pc.array_sort_indices(terms).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    # Occurrences by term, then document: equal ones are counted.
    pairs, tf = np.unique(place[np.concatenate(found)] * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    term, row = np.divmod(pairs, len(ids))
    first = np.searchsorted(term, np.arange(len(order)))
    starts = np.flatnonzero((np.arange(len(term)) - first[term]) % block_rows == 0)
    most = np.maximum.reduceat(saturated(tf, lengths[row], average), starts)
    ends = np.append(starts, len(term))
    postings = pa.StructArray.from_arrays([ids.take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(lengths[row], pa.int32())], ["id", "tf", "length"])
    columns = [terms.take(pa.array(order[term[starts]])).cast(pa.string()), pa.array(most), pa.array(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), postings)]
    return pa.RecordBatch.from_arrays(columns, ["term", "most", "n", "postings"])


def _lists(average: float, block_rows: int, list_words: int):
    """A function of Arrow batches (id, text): blocks of posting lists of about ``list_words`` words each."""

    def run(batches):
        ids, found, numbers, words = [], [], _Numbers(), 0
        for batch in batches:
            of, low = batch.column(0), 0
            for i, text in enumerate(batch.column(1), 1):
                # bytes.lower and bytes.split know ASCII only, as terms() does.
                number = np.fromiter(map(numbers.__getitem__, (text.as_py() or b"").lower().split()), np.int32)
                found.append(number[number >= 0])
                words += len(found[-1])
                if words >= list_words:
                    yield _listed(pa.concat_arrays([*ids, of.slice(low, i - low)]), found, numbers, average, block_rows)
                    ids, found, numbers, words, low = [], [], _Numbers(), 0, i
            ids.append(of.slice(low))
        if words:
            yield _listed(pa.concat_arrays(ids), found, numbers, average, block_rows)

    return run


class CorpusIndex(NamedTuple):
    """``blocks(term, most, n, postings)``, ``documents(id, text)`` and two totals.

    ``most`` is the largest saturated() of the ``n`` postings, which have id, tf and
    length. A term has any number of blocks.
    """

    blocks: DataFrame
    documents: DataFrame
    n: int
    average: float

    def save(self, path: str) -> None:
        """Write the index under ``path``; the totals come last and mark it as whole."""
        for name in ("blocks", "documents"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        self.blocks.sparkSession.createDataFrame([(self.n, self.average)], "n long, average double").write.mode("overwrite").parquet(f"{path}/totals")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CorpusIndex:
        n, average = spark.read.parquet(f"{path}/totals").first()
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("blocks", "documents")), n, average)


def build_index(corpus: DataFrame, id_: str = "id", block_rows: int = BLOCK_ROWS, list_words: int = LIST_WORDS) -> CorpusIndex:
    """The index of ``corpus``: its id column and ``text``, or ``content`` where there is no text.

    Ids are unique; rows without id, and texts without a word, are left out. A list holds
    the documents that were read together, so no term's postings lie in one place.
    The blocks are a table in the shared folder and stay there with the index.
    """
    shown = F.coalesce(*[F.col(c) for c in ("text", "content") if c in corpus.columns])
    documents = corpus.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), shown.alias("text"))
    read = documents.select("id", F.col("text").cast("binary").alias("text"))
    totals = read.select("text").mapInArrow(_lengths, "n long, words long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.sum("words"), F.sum("n")), F.lit(1.0)).alias("average")).first()
    posting = StructType().add("id", documents.schema["id"].dataType).add("tf", "integer").add("length", "integer")
    schema = StructType().add("term", "string").add("most", "double").add("n", "integer").add("postings", ArrayType(posting))
    blocks = read.mapInArrow(_lists(totals.average, block_rows, list_words), schema)
    blocks = written(blocks, f"{use_checkpoint_dir(corpus.sparkSession)}/corpus-index-{uuid.uuid4()}")
    return CorpusIndex(blocks, documents, totals.n, totals.average)


def _scored(pairs: DataFrame, live: DataFrame, index: CorpusIndex) -> DataFrame:
    """query, id, bm25 of (query, id) pairs, summed over the query's terms in ``live``; no row for pairs without one.

    Posting lists are read where they lie and keep the pairs' documents only.
    """
    live = cut(live.select("query", "term", "idf"))
    lists = index.blocks.join(small_side(live.select("term").distinct()), "term", "left_semi")
    met = lists.select("term", F.explode("postings").alias("p")).select("term", "p.*").join(small_side(pairs), "id").join(small_side(live), ["query", "term"])
    return met.groupBy("query", "id").agg(F.sum(F.col("idf") * saturated(F.col("tf"), F.col("length"), F.lit(index.average))).alias("bm25"))


def retrieved(queries: DataFrame, index: CorpusIndex, k: int = 3, id_: str = "id", text: str = "query") -> DataFrame:
    """query, rank, id, text, bm25, score: the best ``k`` documents of each query, fewer if fewer share a term.

    ``bm25`` sums over the query's distinct terms; ``score`` is its share of what a document
    of average length with every term once would have, at most 1, so that queries compare.
    Ties go to the smaller id.
    Queries have unique ids; those without id, without words, or without any known term
    give no row.
    """
    words = queries.where(F.col(id_).isNotNull()).select(F.col(id_).alias("query"), F.explode(F.array_distinct(terms(text))).alias("term"))
    asked_terms = small_side(cut(words.select("term").distinct()))
    vocabulary = index.blocks.join(asked_terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most"))
    known = words.join(vocabulary, "term", "left").withColumn("idf", idf(F.coalesce("df", F.lit(0)), F.lit(float(index.n)))).withColumn("bound", F.col("idf") * F.coalesce("most", F.lit(0.0)))
    known = cut(known)
    asked = known.groupBy("query").agg(F.sum("idf").alias("_limit"), F.sum("bound").alias("_bounds"))
    asked = cut(asked)
    live = known.where("df IS NOT NULL").select("query", "term", "df", "idf", "bound")
    best = Window.partitionBy("query").orderBy(F.desc("bm25"), "id")
    ranked = lambda rows: rows.withColumn("bm25", F.round("bm25", 6)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # The rarest term with k documents at least, or the most frequent one, gives the first threshold.
    rarest = Window.partitionBy("query").orderBy(F.col("df") < k, F.when(F.col("df") >= k, F.col("df")), F.desc("df"), "term")
    seeds = live.withColumn("_r", F.row_number().over(rarest)).where("_r = 1").select("query", "term")
    pairs = cut(index.blocks.select("term", "postings").join(small_side(seeds), "term").select("query", F.explode("postings.id").alias("id")))
    floor = ranked(_scored(pairs, live, index)).where(F.col("rank") == k).select("query", F.col("bm25").alias("_floor"))
    bounded = live.join(floor, "query", "left").withColumn("_floor", F.coalesce("_floor", F.lit(0.0)) - ROOM).join(asked.select("query", "_bounds"), "query")
    upto = Window.partitionBy("query").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    graded = cut(bounded.withColumn("_upto", F.sum("bound").over(upto)))
    needed = small_side(graded.where("_upto >= _floor"))
    opened = index.blocks.join(needed, "term").where(F.col("idf") * F.col("most") + F.col("_bounds") - F.col("bound") >= F.col("_floor"))
    worth = opened.select("query", "idf", "_floor", (F.col("_bounds") - F.col("bound")).alias("_others"), F.explode("postings").alias("p"))
    worth = worth.withColumn("_weight", F.col("idf") * saturated(F.col("p.tf"), F.col("p.length"), F.lit(index.average))).where("_weight + _others >= _floor")
    # A posting left out above belongs to a document that cannot be among the best, so what is found is all that counts.
    partial = cut(worth.groupBy("query", F.col("p.id").alias("id")).agg(F.sum("_weight").alias("bm25")))
    sure = ranked(partial).where(F.col("rank") == k).select("query", (F.col("bm25") - ROOM).alias("_sure"))
    rest = graded.groupBy("query").agg(F.max("_floor").alias("_floor"), F.sum(F.when(F.col("_upto") < F.col("_floor"), F.col("bound")).otherwise(0.0)).alias("_rest"))
    rest = small_side(cut(rest.join(sure, "query", "left").select("query", "_rest", F.greatest("_floor", F.coalesce("_sure", F.lit(0.0))).alias("_floor"))))
    candidates = cut(partial.join(rest, "query").where("bm25 + _rest + 0.000002 >= _floor").select("query", "id", "bm25", "_rest"))
    # Terms too light to be opened are looked up in the few documents that are left.
    open_ = cut(candidates.where("_rest > 0").select("query", "id"))
    light = _scored(open_, graded.where("_upto < _floor"), index)
    scored = candidates.join(light.withColumnRenamed("bm25", "_light"), ["query", "id"], "left").select("query", "id", (F.col("bm25") + F.coalesce("_light", F.lit(0.0))).alias("bm25"))
    top = cut(ranked(scored))
    out = index.documents.select("id", "text").join(small_side(top), "id").join(small_side(asked.select("query", "_limit")), "query")
    return out.select("query", "rank", "id", "text", "bm25", F.round(F.least(F.col("bm25") / F.col("_limit"), F.lit(1.0)), 6).alias("score"))
