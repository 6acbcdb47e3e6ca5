"""Removal of passages that repeat, by hashed spans of consecutive sentences.

A text is split into sentences: at full stops, question and exclamation marks, at line
breaks, and, so that a passage shared inside longer sentences still meets, at places the
text itself defines: before the word of least hash among any few neighbouring words
("Winnowing", Schleimer, Wilkerson and Aiken, 2003). From every sentence on, the
shortest run of consecutive sentences that reaches a number of sentences and of words is
hashed. The hashes of all documents are counted; occurrences of those that stand there a
second time meet by 128 bits, and of each run all but the first occurrence is repeated
text, whose sentences go. Runs so frequent that one task should not hold their
occurrences are few by their definition; their first occurrences are broadcast instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evoframe.llm import vectext
from evoframe.llm.common import HOT_KEYS, HOT_ROWS, id_text
from evoframe.session import cut

RUN_SENTENCES = 2
RUN_WORDS = 20
#: A word begins a sentence if its hash is the least among some so many words on end.
CUT_WORDS = 6
#: Bits of the filter over repeated hashes, 8 MB however many there are. A fuller filter lets more runs through; the join decides.
FILTER_BITS = 26
_CHECK = np.uint64(0x6A09E667F3BCC909)
_RUNS = "run long, check long, doc_id long, version long, first int, stop int"


def units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as in vectext.word_spans, but each letter of a script without blanks (U+3040 to U+9FFF) is one.

    A full-width stop right after such a letter belongs to it; other text after it is a new word.
    """
    starts, ends, of = vectext.word_spans(data, at)
    second = np.r_[data[1:], np.uint8(0)] if len(data) else data
    alone = np.flatnonzero(((data == 0xE3) & (second >= 0x81)) | ((data >= 0xE4) & (data <= 0xE9)))
    if not len(alone):
        return starts, ends, of
    ended = _full_stops(data, alone + 6)
    begins = np.unique(np.r_[starts, alone, alone + 3 + 3 * ended])
    word = np.searchsorted(starts, begins, "right") - 1
    inside = begins < ends[word]
    begins, word = begins[inside], word[inside]
    return begins, np.minimum(np.r_[begins[1:], len(data)], ends[word]), np.searchsorted(begins, at, "left")


def _full_stops(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the three bytes before each place are a full-width full stop, exclamation or question mark."""
    found = (ends >= 3) & (ends <= len(data))
    held = [data[np.where(found, ends, 3) - k].astype(np.int64) for k in (3, 2, 1)] if len(data) >= 3 else [np.zeros(len(ends), np.int64)] * 3
    code = held[0] << 16 | held[1] << 8 | held[2]
    return found & ((code == 0xE38082) | (code == 0xEFBC81) | (code == 0xEFBC9F))


def _least(x: np.ndarray, near: int, pick) -> np.ndarray:
    """``pick`` over x[i : i + near], for every i at which it is whole."""
    width = 1
    while 2 * width <= near:
        x, width = pick(x[: len(x) - width], x[width:]), 2 * width
    return pick(x[: len(x) - (near - width)], x[near - width :]) if near > width else x


def content_cuts(hashes: np.ndarray, of: np.ndarray, near: int = CUT_WORDS) -> np.ndarray:
    """Whether each word has the least hash among some ``near`` words on end of its document, fewer at its ends.

    Equal words are all chosen. The choice rests on the words around alone, so two texts
    that share some are cut alike inside, and no sentence is longer than ``near`` words.
    """
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    place = np.arange(len(hashes)) + (near - 1) * (doc + 1)  # documents apart
    apart = np.full(int(place[-1]) + near, np.iinfo(np.uint64).max, np.uint64)
    apart[place] = hashes
    return hashes == _least(_least(apart, near, np.minimum), near, np.maximum)[place - (near - 1)]


def sentences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of every document by words: (word starts, word ends, word hashes, first word of each sentence, documents' offsets among sentences).

    A sentence ends with a word whose last character is ``.``, ``!`` or ``?``, or their
    full-width forms, before a line break, or before a word that content_cuts() chooses.
    Words between two ends are one sentence, so every word is in exactly one.
    """
    starts, ends, of = units(data, at)
    n = len(starts)
    if not n:
        return starts, ends, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = vectext.span_hashes(vectext.lowered(data), starts, ends)
    last = data[ends - 1]
    closes = (last == 46) | (last == 33) | (last == 63) | _full_stops(data, ends)
    lines = np.cumsum(data == 10)
    broken = np.zeros(n, bool)
    broken[:-1] = lines[starts[1:]] != lines[ends[:-1] - 1]
    first = content_cuts(word, of)
    first[1:] |= (closes | broken)[:-1]
    first[of[:-1][of[:-1] < n]] = True
    begin = np.flatnonzero(first)
    return starts, ends, word, begin, np.searchsorted(begin, of, "left")


def sentence_runs(data: np.ndarray, at: np.ndarray, run_sentences: int, run_words: int) -> dict[str, np.ndarray]:
    """Every run: its document, first sentence, sentence after its last, and two hashes."""
    starts, _, word, begin, of = sentences(data, at)
    m, n = len(begin), len(starts)
    after = np.r_[begin[1:], n].astype(np.int64) if m else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(of))
    index = np.arange(m)
    limit_at = of[1:][doc] if m else index
    enough = np.searchsorted(after, begin + run_words, "left") + 1 if m else index  # sentences up to the one that completes the words
    stop = np.maximum(index + run_sentences, enough)
    whole = stop <= limit_at
    first, stop = index[whole], stop[whole]
    hashes = []
    if m:
        order = (np.arange(n) - np.repeat(begin, after - begin)).astype(np.uint64)
        order = (order + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for salt in (np.uint64(0), _CHECK):
        run = np.zeros(len(first), np.uint64)
        sentence = vectext.mix(np.add.reduceat(vectext.mix((word ^ salt) + order), begin) + (after - begin).astype(np.uint64)) if m else run
        for k in range(int((stop - first).max()) if len(first) else 0):
            live = first + k < stop
            run = np.where(live, vectext.mix(run * np.uint64(3) + sentence[np.where(live, first + k, first)] + np.uint64(1)), run)
        hashes.append(run)
    return {"doc": doc[whole], "first": first - of[doc[whole]], "stop": stop - of[doc[whole]], "hash": hashes[0], "check": hashes[1]}


def _filter(several: DataFrame):
    """A broadcast Bloom filter of two bits over the hashes in ``run``, as 64-bit words."""
    mask = (1 << FILTER_BITS) - 1
    bits = F.array(F.shiftrightunsigned("run", 64 - FILTER_BITS), F.shiftrightunsigned("run", 10).bitwiseAND(F.lit(mask)))
    bit = several.select(F.explode(bits).alias("bit"))
    word = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")).toArrow()  # 2^20 words at most
    words = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    words[word["word"].to_numpy()] = word["bits"].to_numpy().view(np.uint64)
    return several.sparkSession.sparkContext.broadcast(words)


def _may_repeat(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    places = hashes >> np.uint64(64 - FILTER_BITS), (hashes >> np.uint64(10)) & np.uint64((1 << FILTER_BITS) - 1)
    return np.logical_and(*((words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & one).astype(bool) for p in places))


def _hashed(run_sentences: int, run_words: int, repeated=None, hot: np.ndarray | None = None, wanted: bool = False):
    """The runs of every document; given ``repeated``, those that it lets through and that are ``hot`` if ``wanted``, else are not."""

    def chosen(hashes: np.ndarray):
        if repeated is None:
            return slice(None)
        return _may_repeat(repeated.value, hashes) & (np.isin(hashes, hot) == wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _RUNS.split(", ")]
        for batch in batches:
            for part in vectext.slices(batch, "text"):
                found = sentence_runs(*vectext.utf8(part.column("text")), run_sentences, run_words)
                some = chosen(found["hash"])
                doc = pa.array(found["doc"][some])
                keys = [pa.array(found[k][some].view(np.int64)) for k in ("hash", "check")]
                ids = [part.column(k).take(doc) for k in ("doc_id", "version")]
                places = [pa.array(found[k][some].astype(np.int32)) for k in ("first", "stop")]
                yield pa.RecordBatch.from_arrays([*keys, *ids, *places], names)

    return run


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, version, text of rows with a doc_id; version tells different texts of one doc_id apart and is 0 elsewhere."""
    rows = id_text(docs).where("doc_id IS NOT NULL")
    shared = cut(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if shared.isEmpty():
        return rows.select("doc_id", F.lit(0).cast("long").alias("version"), "text")
    rows = rows.join(shared.withColumn("shared", F.lit(True)), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("shared"), F.xxhash64("text")).otherwise(0).cast("long").alias("version"), "text")


def repeated_runs(docs: DataFrame, run_sentences: int = RUN_SENTENCES, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, version, first, stop, first_doc_id: each occurrence of a run that isn't its first.

    The first occurrence is that of the smallest doc_id, then version, then of the earliest
    sentence; later ones in the same document count too. Places are sentences. Null, empty
    and short texts have no run; texts of any length are read whole. Rows without doc_id
    are left out; rows of one doc_id and text are one document. No rows give no rows.
    """
    texts = _documents(docs)
    options = run_sentences, run_words
    several = cut(texts.mapInArrow(_hashed(*options), _RUNS).groupBy("run").agg(F.count("*").alias("n")).where("n > 1"))
    limit = max((several.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS, HOT_ROWS)
    hot = np.array([r.run for r in several.where(F.col("n") > limit).collect()], np.int64).view(np.uint64)  # fewer than HOT_KEYS
    repeated = _filter(several)
    key, origin = ["run", "check"], F.min(F.struct("doc_id", "version", "first", "stop"))
    runs = texts.mapInArrow(_hashed(*options, repeated, hot), _RUNS).join(several.where(F.col("n") <= limit).select("run"), "run")
    every = Window.partitionBy(*key)
    again = runs.withColumn("origin", origin.over(every)).withColumn("n", F.count("*").over(every)).where("n > 1")
    if len(hot):
        runs = cut(texts.mapInArrow(_hashed(*options, repeated, hot, True), _RUNS))
        origins = runs.groupBy(*key).agg(origin.alias("origin"), F.count("*").alias("n")).where("n > 1")
        again = again.unionByName(runs.join(F.broadcast(origins), key))
    same = F.col("doc_id").eqNullSafe(F.col("origin.doc_id")) & (F.col("version") == F.col("origin.version"))
    again = again.where(~(same & (F.col("first") == F.col("origin.first"))))
    return again.select("doc_id", "version", "first", "stop", F.col("origin.doc_id").alias("first_doc_id"))


def _stretches(docs: DataFrame, run_sentences: int, run_words: int) -> DataFrame:
    runs = repeated_runs(docs, run_sentences, run_words)
    per_doc = runs.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.struct("first", "stop", "first_doc_id"))).alias("runs"))  # a document's own runs
    return per_doc.mapInArrow(_merged, "doc_id long, version long, first int, stop int, n_runs int, first_doc_id long")


def removed_spans(docs: DataFrame, run_sentences: int = RUN_SENTENCES, run_words: int = RUN_WORDS) -> DataFrame:
    """One row per maximal stretch of removed sentences: doc_id, first, stop, n_runs, first_doc_id.

    Sentences ``first`` to ``stop`` - 1 are covered by non-first runs; ``first_doc_id`` is
    the smallest document that had one of them. Null, empty and short texts have no runs.
    Words part at white space, and each letter of a script without blanks is one. Rows
    with the same doc_id and text are one document; other texts under its doc_id are
    documents of their own, whose stretches are listed too. Other columns are ignored; no
    rows give no rows. A passage of run_words + 5 * CUT_WORDS words that stands twice is
    found whatever surrounds it, and its words but for 2 * CUT_WORDS at either end go;
    most shorter ones from run_words on are found too.
    """
    return _stretches(docs, run_sentences, run_words).drop("version")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = batch.column("runs")
        flat = runs.flatten()
        first, stop, origin = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        counts = np.diff(runs.offsets.to_numpy())
        doc = np.repeat(np.arange(len(counts)), counts)
        shift = doc.astype(np.int64) << 33  # documents don't touch
        low, high = first + shift, np.maximum.accumulate(stop + shift) if len(stop) else stop + shift
        begins = np.flatnonzero(np.r_[True, low[1:] > high[:-1]]) if len(low) else np.zeros(0, np.int64)
        ends = np.r_[begins[1:], len(low)].astype(np.int64)
        if not len(begins):
            continue
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k).take(pa.array(doc[begins])) for k in ("doc_id", "version")), pa.array(first[begins].astype(np.int32)), pa.array((high[ends - 1] - shift[begins]).astype(np.int32)), pa.array((ends - begins).astype(np.int32)), pa.array(np.minimum.reduceat(origin, begins))],
            ["doc_id", "version", "first", "stop", "n_runs", "first_doc_id"],
        )


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, cut_ = [], []
        for text, gone in zip(batch.column("text"), batch.column("gone")):
            raw, spans = (text.as_py() or "").encode(), gone.as_py() or []
            at, parts = 0, []
            if spans:
                data = np.frombuffer(raw, np.uint8)
                starts, ends, _, begin, _ = sentences(data, np.array([0, len(data)]))
                after = np.r_[begin[1:], len(starts)].astype(np.int64)
            for s in spans:
                parts.append(raw[at : starts[begin[s["first"]]]])
                at = int(ends[after[s["stop"] - 1] - 1])
            out.append((b"".join(parts) + raw[at:]).decode())
            cut_.append(sum(s["stop"] - s["first"] for s in spans))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), pa.array(cut_, pa.int32())], ["doc_id", "text", "n_removed"])


def without_repeats(docs: DataFrame, run_sentences: int = RUN_SENTENCES, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, text without its repeated sentences, n_removed: one row per document.

    Those without doc_id stay whole; null texts become empty; texts of any length are read
    whole; rows that repeat a doc_id lose what their own text repeats. No rows give no rows.
    """
    gone = _stretches(docs, run_sentences, run_words).groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(F.struct("first", "stop"))).alias("gone"))
    ours = _documents(docs).join(gone, ["doc_id", "version"], "left").unionByName(id_text(docs).where("doc_id IS NULL"), allowMissingColumns=True)
    return ours.mapInArrow(_clean, "doc_id long, text string, n_removed int")
