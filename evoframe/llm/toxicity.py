"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features are the distinct hashed words, word pairs and skip-grams of a text. The
learner is the per-coordinate FTRL-proximal of McMahan et al. ("Ad click prediction:
a view from the trenches", 2013): each coordinate has its own rate, and L1 keeps
weights at exactly zero until the evidence outweighs it, so the model that is
broadcast for scoring is a short list of coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoframe.llm import vectext
from evoframe.llm.common import id_text

BITS = 20
#: Documented bound of the training sample, in labelled documents (met in expectation).
SAMPLE_ROWS = 16_000
EPOCHS = 4
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def word_features(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each document, repeats included, and the document of each.

    A word is a run of ASCII letters, digits and non-ASCII bytes, A-Z lowered. The
    features are words, pairs of neighbours, and pairs with one word left out.
    """
    data = vectext.lowered(data)
    part = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    masked = np.where(part, data, np.uint8(32))
    starts, ends, of = vectext.word_spans(masked, at)
    word = vectext.span_hashes(masked, starts, ends)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(of))
    features, owners = [word], [doc]
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap] if len(doc) > gap else np.zeros(0, bool)
        if len(same):
            features.append(vectext.mix(word[:-gap] * np.uint64(2 * gap + 1) + word[gap:] + np.uint64(gap))[same])
            owners.append(doc[gap:][same])
    return (np.concatenate(features) >> np.uint64(64 - bits)).astype(np.uint32), np.concatenate(owners)


@dataclass
class Ftrl:
    """FTRL-proximal logistic regression on binary features."""

    size: int
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.05

    def __post_init__(self):
        self.z = np.zeros(self.size + 1)  # the last coordinate is the bias, without L1
        self.n = np.zeros(self.size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == self.size, 0.0, self.l1)
        held = np.abs(z) > l1
        return np.where(held, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2), 0.0)

    def learn(self, features: np.ndarray, label: int) -> float:
        """One step on distinct features; returns the probability before it."""
        at = np.append(features, self.size)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g
        return float(p)

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self.weights(np.arange(self.size + 1))
        at = np.flatnonzero(w[:-1])
        return at.astype(np.uint32), w[at], float(w[-1])


def _featured(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vectext.slices(batch, "text"):
                features, doc = word_features(*vectext.utf8(part.column("text")), bits)
                order = np.argsort(doc, kind="stable")
                features, doc = features[order], doc[order]
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
                rows = [np.unique(features[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), part.column("turn"), pa.array(rows, pa.binary())], ["toxic", "turn", "features"])

    return run


def _train(bits: int, options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(1 << bits, **options)
        for batch in batches:
            for label, features in zip(batch.column("toxic").to_pylist(), batch.column("features")):
                model.learn(np.frombuffer(features.as_py(), np.uint32).astype(np.int64), label)
        at, weights, bias = model.sparse()
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["at", "weights", "bias"])

    return run


@dataclass
class Model:
    """Non-zero weights by coordinate, and the bias."""

    bits: int
    at: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        known = np.zeros(1 << self.bits, bool)
        known[self.at] = True
        features, doc = word_features(data, offsets, self.bits)
        hit = known[features]
        pairs = np.unique(doc[hit].astype(np.int64) << self.bits | features[hit])
        value = self.weights[np.searchsorted(self.at, (pairs & ((1 << self.bits) - 1)).astype(np.uint32))]
        total = np.bincount(pairs >> self.bits, value, minlength=len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def held_out(doc_id):
    """A fifth of all ids, by the CRC-32 of the id as text; never learnt from. A missing id is in no fifth."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS, bits: int = BITS, **options: float) -> Model:
    """A model learnt from labelled documents that are not held out.

    The sample is a hash range of the labelled ids, expected to hold ``sample_rows`` at
    most, so it is the same wherever rows lie. A document labelled twice is toxic if any
    label says so; null labels count as none; of rows that repeat an id the text of the
    least hash is learnt, once. Without usable labels every score is 0.5.
    The learner sees ``epochs`` differently ordered passes, streamed through one task.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IS NOT NULL AND labelled_id IS NOT NULL")
    known = known.where(~held_out(F.col("labelled_id"))).groupBy("labelled_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if not n:
        return Model(bits, np.zeros(0, np.uint32), np.zeros(0), 0.0)
    share = min(1.0, sample_rows / n)
    chosen = known.where(F.pmod(F.xxhash64(F.lit(31), "labelled_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = id_text(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))  # bounded by sample_rows
    sample = sample.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    turns = F.explode(F.sequence(F.lit(1), F.lit(epochs)))
    rows = sample.select("text", "toxic", F.col("doc_id").alias("turn")).mapInArrow(_featured(bits), "toxic int, turn long, features binary")
    rows = rows.select("toxic", "features", turns.alias("epoch"), "turn").repartition(1).sortWithinPartitions("epoch", F.xxhash64("epoch", "turn"), "turn")
    found = rows.select("toxic", "features").mapInArrow(_train(bits, options), "at binary, weights binary, bias double").first()
    if found is None:
        return Model(bits, np.zeros(0, np.uint32), np.zeros(0), 0.0)
    return Model(bits, np.frombuffer(found.at, np.uint32), np.frombuffer(found.weights), found.bias)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vectext.slices(batch, "text"):
                scores = model.score(*vectext.utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score in 0 to 1, predicted (1 from 0.5 on): one row per document.

    Only the text is read. Null and empty texts get the bias' score. Repeated rows are
    scored each; other columns are ignored; no rows give no rows.
    """
    rows = id_text(docs).withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInArrow(_scored(model), SCHEMA)


def _passed(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vectext.slices(batch, "text"):
                clean = model.score(*vectext.utf8(part.column("text"))) < 0.5
                if clean.any():
                    yield part.filter(pa.array(clean))

    return run


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score() does not predict toxic.

    Null and empty texts get the bias' score; rows without doc_id and rows that repeat one
    are judged each, by their text; texts of any length are read whole; no rows give no rows.
    """
    return docs.mapInArrow(_passed(model), docs.schema)
