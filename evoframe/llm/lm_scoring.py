"""Cross-entropy difference scoring with two matched n-gram models.

After Moore and Lewis ("Intelligent selection of language model training data",
2010): a target and a background bigram model of the same form over one
vocabulary; a document's score is its mean per-token loss under the target less that
under the background, so lower is nearer to the target. The vocabulary is every word
and all counts are exact and come from every row. They grow with the corpus, so they
are never held in one place: blocks of documents send their distinct words and word
pairs, as 64-bit hashes with counts, to buckets of the hash; a bucket adds them up and
answers each block. Buckets are sorted inside a partition, which holds one at a time,
so the partitions follow the corpus at a fixed share of its buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoframe.llm import vectext
from evoframe.llm.common import fixed_order, id_text
from evoframe.session import BROADCAST_ROWS, cut, small_side

SMOOTHING = 32.0
#: Buckets that follow each other in a partition of a large corpus.
BUCKETS_A_PART = 256
_FLUSH_WORDS = 4_000_000
#: Tokens and rows of a block, and tokens of the corpus for each bucket of keys.
_BLOCK_WORDS = 1 << 21
_BLOCK_ROWS = 1 << 18
_BUCKET_WORDS = 1 << 20
#: Stands for the word before a document's first.
_START = np.uint64(0x9B1A5C3E7D2F4861)
_SENT = "bucket int, block long, asks boolean, body binary, counts binary, docs array<long>, lengths binary"

SCHEMA = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _word_hashes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, at = vectext.utf8(part.column("text"))
    data = vectext.lowered(data)
    starts, ends, of = vectext.word_spans(data, at)
    return vectext.span_hashes(data, starts, ends), of


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, background, target: words summed over a few million tokens of a task before they leave it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        words, target = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(words, kind="stable")
        words, target = words[order], target[order]
        begins = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        counts = np.diff(np.r_[begins, len(words)])
        return pa.RecordBatch.from_arrays([pa.array(words[begins].view(np.int64)), pa.array(counts), pa.array(np.add.reduceat(target, begins))], ["word", "background", "target"])

    for batch in batches:
        for part in vectext.slices(batch, "text"):
            words, of = _word_hashes(part)
            if not len(words):
                continue
            is_target = part.column("is_target").to_numpy(zero_copy_only=False)
            held.append((words, np.repeat(is_target, np.diff(of)).astype(np.int64)))
            size += len(words)
            if size >= _FLUSH_WORDS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _chains(ids: np.ndarray, of: np.ndarray, start: int) -> np.ndarray:
    """The id before each token; a document's first token follows ``start``."""
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    first = of[:-1][np.diff(of) > 0]
    before[first] = start
    return before


@dataclass
class ExactModels:
    """Both models as the rows they are counted from: exact counts of every word and word pair.

    p(w | h) = (c(h, w) + smoothing * p(w)) / (c(h) + smoothing), with p(w) from add-one
    counts over the vocabulary, the unknown word and nothing else, alike for both. The
    vocabulary is every word of the rows; other words are the unknown word, which was
    never seen.
    """

    docs: DataFrame
    rows: DataFrame  # doc_id, text, is_target
    words: int
    tokens: tuple[int, int]  # background, target
    smoothing: float = SMOOTHING


def _pairs(ids: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (word before) * (size + 1) + word of a block of ``size`` distinct words, and each token's place there."""
    return np.unique(_chains(ids, of, size) * (size + 1) + ids, return_inverse=True)


def _keys(words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a block's words, document start and pairs, and their order."""
    names = np.r_[words, _START]
    keys = np.r_[names, vectext.mix(vectext.mix(names[pairs // len(names)] + np.uint64(1)) + names[pairs % len(names)])]
    return keys, np.argsort(keys, kind="stable")


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, compressed."""
    planes = numbers.astype("<u8").reshape(-1, 1).view(np.uint8).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = pa.decompress(raw[8:], 8 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").ravel()


def _sent(bits: int, counts: bool, asks: bool):
    """Per block and bucket a row of keys, with their counts; for blocks that ask also a row of their own tokens."""

    def block_rows(block: int, held: list) -> Iterator[pa.RecordBatch]:
        words, lengths, marks = (np.concatenate([h[k] for h in held]) for k in range(3))
        docs = [d for h in held for d in h[3]]
        of = np.r_[0, np.cumsum(lengths)]
        names, ids, times = np.unique(words, return_inverse=True, return_counts=True)
        usual = np.argsort(-times, kind="stable")  # frequent words get small numbers, which compress
        number = np.empty_like(usual)
        number[usual] = np.arange(len(usual))
        names, ids = names[usual], number[ids]
        pairs, at = _pairs(ids, of, len(names))
        keys, order = _keys(names, pairs)
        found = np.zeros((2, len(keys)), np.int64)
        if counts:
            tokens = np.repeat(marks, lengths)
            for m, (live, of_docs) in enumerate(((slice(None), lengths > 0), (tokens, (lengths > 0) & marks))):
                found[m] = np.r_[np.bincount(ids[live], minlength=len(names)), of_docs.sum(), np.bincount(at[live], minlength=len(pairs))]
        buckets = (keys[order] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        begins = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        out = []
        for bucket, p in zip(buckets[begins].tolist(), np.split(order, begins[1:])):
            out.append((bucket, block, asks, _packed(np.diff(keys[p], prepend=np.uint64(0))), _packed(found[:, p].ravel()) if counts else None, None, None))
        if asks:
            any_bucket = int(vectext.mix(np.array([block], np.uint64))[0]) & ((1 << bits) - 1)
            out.append((any_bucket, block, None, names.tobytes(), _packed(ids), docs, lengths.astype("<i8").tobytes()))
        kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in _SENT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size, rows = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            for part in vectext.slices(batch, "text"):
                words, of = _word_hashes(part)
                marks = part.column("is_target").to_numpy(zero_copy_only=False) if counts else np.zeros(part.num_rows, bool)
                held.append((words, np.diff(of), marks, part.column("doc_id").to_pylist() if asks else []))
                size, rows = size + len(words), rows + part.num_rows
                if size >= _BLOCK_WORDS or rows >= _BLOCK_ROWS:
                    yield from block_rows(block, held)
                    block, held, size, rows = block + 1, [], 0, 0
        if held:
            yield from block_rows(block, held)

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket: its counts are summed by key and given back, in the order in which they were asked."""

    def answers(held: list) -> Iterator[pa.RecordBatch]:
        keys = [np.cumsum(_unpacked(r["body"]), dtype=np.uint64) for r in held]
        names, at = np.unique(np.concatenate(keys), return_inverse=True)
        given = np.concatenate([_unpacked(r["counts"]).astype(np.int64).reshape(2, -1) if r["counts"] is not None else np.zeros((2, len(k)), np.int64) for r, k in zip(held, keys)], 1)
        order = np.argsort(at, kind="stable")
        total = np.add.reduceat(given[:, order], np.searchsorted(at[order], np.arange(len(names))), axis=1)
        ends = np.cumsum([len(k) for k in keys])
        for r, k, end in zip(held, keys, ends):
            if r["asks"]:
                yield pa.RecordBatch.from_pylist([r | {"body": None, "counts": _packed(total[:, at[end - len(k) : end]].ravel())}], schema)

    held: list = []
    schema = None
    for batch in batches:
        schema = batch.schema
        own = batch.filter(batch.column("asks").is_null())
        if own.num_rows:
            yield own
        for r in batch.filter(batch.column("asks").is_valid()).to_pylist():
            if held and held[0]["bucket"] != r["bucket"]:
                yield from answers(held)
                held = []
            held.append(r)
    if held:
        yield from answers(held)


def _losses(words: int, tokens: tuple[int, int], smoothing: float):
    """Rows come sorted by block, its own first and then the answers by bucket; documents with their losses go out."""

    def scored(own: dict, answers: list[np.ndarray]) -> pa.RecordBatch:
        names, lengths = np.frombuffer(own["body"], np.uint64), np.frombuffer(own["lengths"], "<i8")
        pairs, at = _pairs(_unpacked(own["counts"]).astype(np.int64), np.r_[0, np.cumsum(lengths)], len(names))
        _, order = _keys(names, pairs)
        count = np.empty((2, len(order)))
        count[:, order] = np.concatenate(answers, 1)
        before, word = pairs // (len(names) + 1), pairs % (len(names) + 1)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        mean = []
        for m in range(2):
            unigram = (count[m][word] + 1) / (tokens[m] + words + 1)
            loss = -np.log((count[m][len(names) + 1 :] + smoothing * unigram) / (count[m][before] + smoothing))
            mean.append(np.bincount(doc, loss[at], minlength=len(lengths)) / np.maximum(lengths, 1))
        background, target = mean
        return pa.RecordBatch.from_arrays([pa.array(own["docs"], pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(target), pa.array(background), pa.array(target - background)], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, answers = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if r["asks"] is None:
                    if own is not None:
                        yield scored(own, answers)
                    own, answers = r, []
                else:
                    answers.append(_unpacked(r["counts"]).reshape(2, -1))
        if own is not None:
            yield scored(own, answers)

    return run


def _marked(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    ids = target_ids.select(F.col("doc_id").cast("long").alias("target_id")).where("target_id IS NOT NULL").distinct()
    ids = cut(ids)
    n = ids.count()
    joined = id_text(docs).join(small_side(ids, n), F.col("doc_id") == F.col("target_id"), "left").select("doc_id", "text", F.col("target_id").isNotNull().alias("is_target"))
    return fixed_order(joined) if n <= BROADCAST_ROWS else cut(joined)  # blocks need rows in a fixed order


def fit(docs: DataFrame, target_ids: DataFrame, smoothing: float = SMOOTHING) -> ExactModels:
    """Target and background models of ``docs``; ``target_ids(doc_id)`` names the target's rows.

    The background is every row, the target the named ones; both count whole texts.
    The shared vocabulary is every word of the background and pairs are counted exactly.
    Rows that repeat an id count one each, in the target too if it names them. Without
    target rows the target is the smoothed uniform model. No rows give an empty vocabulary.
    """
    rows = _marked(docs, target_ids)
    by_word = rows.mapInArrow(_word_counts, "word long, background long, target long").groupBy("word").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))
    n = by_word.agg(F.count("*").alias("words"), F.coalesce(F.sum("background"), F.lit(0)).alias("b"), F.coalesce(F.sum("target"), F.lit(0)).alias("t")).first()
    return ExactModels(docs, rows, n.words, (n.b, n.t), smoothing)


def buckets_and_parts(tokens: int, shuffle_parts: int) -> tuple[int, int]:
    """Bits of the buckets of so many tokens, and the partitions that share them, BUCKETS_A_PART each in a large corpus."""
    bits = max(0, -(-tokens // _BUCKET_WORDS) - 1).bit_length()
    return bits, max(min(1 << bits, shuffle_parts), (1 << bits) // BUCKETS_A_PART)


def _score_exactly(docs: DataFrame, models: ExactModels) -> DataFrame:
    size = models.tokens[0]
    if docs is not models.docs:
        size += (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 5
    bits, parts = buckets_and_parts(size, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if docs is models.docs:
        sent = models.rows.mapInArrow(_sent(bits, True, True), _SENT)
    else:
        sent = models.rows.mapInArrow(_sent(bits, True, False), _SENT).unionByName(fixed_order(id_text(docs)).mapInArrow(_sent(bits, False, True), _SENT))
    answered = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_answered, _SENT)
    by_block = answered.repartition(parts, "block").sortWithinPartitions("block", F.col("asks").isNotNull(), "bucket")
    return by_block.mapInArrow(_losses(models.words, models.tokens, models.smoothing), SCHEMA)


def score(docs: DataFrame, models: ExactModels) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (their difference), one row per document.

    Null, empty and blank texts have no tokens and score 0. Repeated rows are scored
    each; other columns are ignored; no rows give no rows.
    """
    return _score_exactly(docs, models)
