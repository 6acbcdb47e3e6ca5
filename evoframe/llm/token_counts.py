"""Token counts of sections, attributed through character offsets.

A document is encoded once and whole, as a model would see it. Token byte lengths
give character spans; sections are character intervals; a sorted interval join
inside the document finds the sections a token touches. A token that crosses a
boundary goes to one section by a stated rule, so counts add up to the document's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoframe.llm.bpe import encoding
from evoframe.llm.common import id_text

#: From here on texts are split by the regex package: the library's own splitter recurses over a run of white space.
LONG_CHARS = 100_000
RULES = ("first", "last", "most")
_OUT = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def line_intervals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code-point intervals of the lines of UTF-8 bytes, each with its line break."""
    lead = (data & 0xC0) != 0x80
    ends = np.cumsum(lead)[data == 10]
    total = int(lead.sum())
    if not len(ends) or ends[-1] != total:
        ends = np.r_[ends, total]
    return np.r_[0, ends[:-1]].astype(np.int64), ends.astype(np.int64)


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, -1 if it touches none, and whether it touches several.

    Tokens span code points ``first`` to ``last`` inclusive. Sections are in order and
    don't overlap; gaps are allowed. ``first`` and ``last`` choose the first or last
    section touched; ``most`` the one with the most of its characters, the earlier of equals.
    """
    if not len(starts):
        return np.full(len(first), -1), np.zeros(len(first), bool)
    low = np.searchsorted(ends, first, "right")
    high = np.searchsorted(starts, last, "right") - 1
    touched = low <= high
    chosen = np.where(touched, high if rule == "last" else low, -1)
    crossing = touched & (low < high)
    if rule == "most":
        for i in np.flatnonzero(crossing):
            span = np.arange(low[i], high[i] + 1)
            share = np.minimum(ends[span], last[i] + 1) - np.maximum(starts[span], first[i])
            chosen[i] = span[int(share.argmax())]
    return chosen, crossing


def _count(path: str, pattern: str, rule: str, own: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        model, find = encoding(path, pattern), regex.compile(pattern).findall

        def encode(text: str) -> list[int]:
            if len(text) < LONG_CHARS:
                return model.encode_ordinary(text)
            return [i for piece in find(text) for i in model._encode_single_piece(piece)]

        size = np.zeros(model.n_vocab, np.int64)
        for token in model.token_byte_values():
            size[model.encode_single_token(token)] = len(token)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            rows = 0
            given = batch.column("sections") if own else [None] * batch.num_rows
            for doc, text, sections in zip(batch.column("doc_id").to_pylist(), batch.column("text"), given):
                text = text.as_py() or ""
                data = np.frombuffer(text.encode(), np.uint8)
                if own:
                    spans = sorted((s["start"], s["end"], s["section"]) for s in sections.as_py() or [])
                    starts, ends, numbers = (np.array([s[k] for s in spans], np.int64) for k in range(3))
                else:
                    starts, ends = line_intervals(data)
                    numbers = np.arange(len(starts))
                ids = np.array(encode(text), np.int64)
                to = np.cumsum(size[ids])
                point = np.cumsum((data & 0xC0) != 0x80) - 1  # code point of each byte
                if len(ids):
                    chosen, crossing = attribute(point[to - size[ids]], point[to - 1], starts, ends, rule)
                else:
                    chosen, crossing = np.zeros(0, np.int64), np.zeros(0, bool)
                there = chosen >= 0
                counts = np.bincount(chosen[there], minlength=len(starts))
                crossed = np.bincount(chosen[there & crossing], minlength=len(starts))
                for column, values in zip(out, (np.full(len(starts), doc), numbers, starts, ends, counts, crossed)):
                    column.append(values)
                rows += len(starts)
                if rows >= 50_000:
                    yield _batch(out)
                    out, rows = [[] for _ in range(6)], 0
            if rows:
                yield _batch(out)

    return run


def _batch(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(k) for c, k in zip(columns, kinds)], names)


def section_counts(docs: DataFrame, ranks: str, pattern: str, sections: DataFrame | None = None, rule: str = "first") -> DataFrame:
    """One row per section: doc_id, section, start, end, n_tokens, n_crossing.

    ``sections`` has doc_id, section (int), start and end in code points, in order and
    without overlap within a document; without it, each line with its break is a section,
    numbered from 0. Tokens that touch no section are not counted. Null and empty texts
    have the one empty line section 0 with no tokens. Rows that repeat a doc_id give their
    sections each. Other columns are ignored; no rows give no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    texts = id_text(docs)
    if sections is None:
        return texts.mapInArrow(_count(ranks, pattern, rule, False), _OUT)
    held = sections.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(F.struct(F.col("section").cast("int").alias("section"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).alias("sections"))
    return texts.join(held, "doc_id").select("doc_id", "text", "sections").mapInArrow(_count(ranks, pattern, rule, True), _OUT)
