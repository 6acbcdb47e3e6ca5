"""Best-fit packing by linear grouping over the histogram of lengths.

Documents of one length are interchangeable, so the plan is made from counts per
length, at most ``capacity`` of them however large the corpus. Large lengths are
put in groups of equal cardinality and rounded up to the group's largest; a linear
programme over configurations of those few sizes is solved by column generation;
actual documents take the slots of their group; small ones then go, longest first,
where they fit best. Bins are kept as runs of equal content, so the plan's size
does not follow the number of documents either.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evoframe.llm import vectext
from evoframe.llm.common import id_text
from evoframe.session import cut

CAPACITY = 4096
GROUPS = 16
#: Lengths above this part of the capacity are grouped and configured; others are placed by best fit.
LARGE_PART = 1 / 6
#: Distinct words a worker remembers; about 250 bytes each.
CACHE_WORDS = 800_000


# ---------------------------------------------------------------- the plan


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, longest first, in runs of about equal total count; a length may be split over groups."""
    total = sum(counts.values())
    share, out, room = -(-total // max(1, groups)), [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = share
            take = min(left, room)
            out[-1].append((length, take))
            left, room = left - take, room - take
    return out


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """A configuration of the largest total value, by dynamic programming over the capacity."""
    best = np.zeros(capacity + 1)
    chosen = np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        gain = best[room - sizes[fits]] + values[fits]
        k = int(gain.argmax())
        best[room], chosen[room] = (gain[k], fits[k]) if gain[k] > best[room - 1] + 1e-12 else (best[room - 1], -1)
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if chosen[room] < 0:
            room -= 1
        else:
            pattern[chosen[room]] += 1
            room -= int(sizes[chosen[room]])
    return pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """A near-optimal fractional cover of the demand: (configuration, times), by revised simplex with column generation."""
    sizes_, need = np.array(sizes), np.array(demand, float)
    most = capacity // sizes_
    columns = [np.eye(len(sizes), dtype=np.int64)[i] * most[i] for i in range(len(sizes))]
    basis = np.array(columns, float).T
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        prices = np.ones(len(sizes)) @ inverse
        pattern = _best_pattern(sizes_, prices, capacity)
        if prices @ pattern <= 1 + 1e-7:
            break
        direction, level = inverse @ pattern, inverse @ need
        ratio = np.where(direction > 1e-9, level / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out], columns[out] = pattern, pattern
    times = np.maximum(np.linalg.solve(basis, need), 0)
    return [(c, t) for c, t in zip(columns, times) if t > 1e-9]


class Plan:
    """Rows (length, rank, count, per_bin, sequence, offset): documents ``rank`` to ``rank + count`` of a length fill bins from ``sequence`` on, ``per_bin`` each, from ``offset``."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: int | None = None):
        self.capacity, self.rows, self.bins = capacity, [], 0
        self.rank = dict.fromkeys(counts, 0)
        self.open: list[tuple[int, int, int]] = []  # (room, first bin, bins), in order
        large = int(capacity * LARGE_PART) if large is None else large
        full = counts.get(capacity, 0)
        if full:
            self._place(capacity, full, 1, self._new(full), 0)
        big = {n: c for n, c in counts.items() if large < n < capacity and c}
        if big:
            self._configure(linear_groups(big, groups))
        for length in sorted((n for n, c in counts.items() if n <= large and n < capacity and c), reverse=True):
            self._fit(length, counts[length])

    def _new(self, bins: int) -> int:
        self.bins += bins
        return self.bins - bins

    def _place(self, length: int, count: int, per_bin: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.rank[length], count, per_bin, sequence, offset))
        self.rank[length] += count

    def _configure(self, groups: list[list[tuple[int, int]]]) -> None:
        by_size: dict[int, list[tuple[int, int]]] = {}
        for group in groups:
            by_size.setdefault(group[0][0], []).extend(group)
        sizes = list(by_size)
        stock = [[[n, c] for n, c in by_size[s]] for s in sizes]
        left = [sum(c for _, c in s) for s in stock]
        found = sorted(configurations(sizes, left, self.capacity), key=lambda x: -x[1])
        for pattern, times in found:
            whole = int(times + 1e-6)
            slots = [i for i, k in enumerate(pattern) for _ in range(k)]
            whole = min([whole, *(left[i] // k for i, k in enumerate(pattern) if k)])
            for i in slots:
                left[i] -= whole
            self._fill(slots, stock, whole)
        for group in stock:  # what rounding down left over goes by best fit
            for length, count in group:
                if count:
                    self._fit(length, count)

    def _fill(self, slots: list[int], stock: list[list[list[int]]], times: int) -> None:
        """``times`` bins with one actual document for each slot, in runs of equal lengths."""
        while times:
            need, held = {}, []
            run = times
            for i in slots:
                need[i] = need.get(i, 0) + 1
            for i, k in need.items():
                while not stock[i][0][1]:
                    stock[i].pop(0)
                length, count = stock[i][0]
                if count >= k:
                    run = min(run, count // k)
                    held.append([(i, 0, k)])
                else:  # a bin that straddles two lengths of its group
                    run, take, j = 1, [], 0
                    while k:
                        n = min(k, stock[i][j][1])
                        if n:
                            take.append((i, j, n))
                        k, j = k - n, j + 1
                    held.append(take)
            first, used = self._new(run), 0
            taken = [(stock[i][j], k) for take in held for i, j, k in take]
            for entry, k in taken:
                self._place(entry[0], run * k, k, first, used)
                entry[1] -= run * k
                used += k * entry[0]
            self._offer(self.capacity - used, first, run)
            times -= run

    def _offer(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            insort(self.open, (room, first, bins))

    def _fit(self, length: int, count: int) -> None:
        while count:
            at = bisect_left(self.open, (length, -1, 0))
            if at == len(self.open):
                per_bin = self.capacity // length
                bins = -(-count // per_bin)
                self._offer(self.capacity, self._new(bins), bins)
                continue
            room, first, bins = self.open.pop(at)
            per_bin = min(room // length, count)
            whole = min(bins, count // per_bin)
            self._place(length, whole * per_bin, per_bin, first, self.capacity - room)
            count -= whole * per_bin
            self._offer(room - per_bin * length, first, whole)
            self._offer(room, first + whole, bins - whole)

    def arrays(self) -> dict[str, np.ndarray]:
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 6)
        return dict(zip(("length", "rank", "count", "per_bin", "sequence", "offset"), rows.T))


# ---------------------------------------------------------------- token pieces


#: str.split() also splits at these four, which the tokenizer takes for symbols.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


class WordTokens:
    """Ids of a lower-casing byte-level BPE with an end-of-word suffix, as bytes, word by word.

    No token crosses white space, so each distinct chunk between white space is encoded
    once and remembered, up to ``cache`` chunks, and a text's ids are its chunks' ids
    joined. A chunk's pieces are merged by the tiktoken library: the suffix becomes the
    byte 0xFF, which UTF-8 never uses, and its pairs rank first. Texts with characters
    younger than Unicode 3.2, of which the tokenizers library may know another class, and
    texts that may hold an added token go through that library chunk by chunk.
    """

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        import regex
        import tiktoken
        import tokenizers

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, suffix = held["model"], held["model"]["end_of_word_suffix"]
        split = held["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or not suffix or not split["invert"]:
            raise ValueError(f"{path} is not a BPE with an end-of-word suffix over matched pieces")
        added = [t["content"].lower() for t in held["added_tokens"]]
        if any(not t.isascii() or len(t.split()) != 1 for t in added):
            raise ValueError(f"{path} has added tokens that white space does not part")
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)").search
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = tokenizers.Tokenizer.from_file(path)
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): bytes([b]) for b in own}
        byte |= {chr(256 + k): bytes([b]) for k, b in enumerate(b for b in range(256) if b not in own)}

        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return b"".join(byte[c] for c in (token[: -len(suffix)] if end else token)) + b"\xff" * end

        tokens = [bytes([b]) for b in range(256)] + [bytes([b, 255]) for b in range(256)]
        tokens += [raw("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        special = {t["content"] for t in held["added_tokens"]}
        number = {raw(token): i for token, i in model["vocab"].items() if token not in special}
        ranks = {token: i for i, token in reversed(list(enumerate(tokens)))}
        self.number = np.array([number.get(token, 0) for token in tokens], "<u4")
        self.single = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)._core_bpe.encode_single_piece
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.old = set(map(chr, range(128)))
        self.known: dict[str, bytes] = {}
        self.known_whole: dict[str, bytes] = {}
        self.known_pieces: dict[str, bytes] = {}
        self.cache = cache

    def piece(self, piece: str) -> bytes:
        if len(self.known_pieces) >= self.cache:
            self.known_pieces.clear()
        ids = self.known_pieces[piece] = self.number[self.single(piece.encode() + b"\xff")].tobytes()
        return ids

    def _plain(self, text: str) -> bool:
        """Whether all characters are old ones and no added token can be in the text."""
        if "<" in text and self.added(text.lower()):
            return False
        new = set(text) - self.old
        if new:
            self.old.update(c for c in new if unicodedata.ucd_3_2_0.category(c) != "Cn")
            return new <= self.old
        return True

    def __call__(self, text: str) -> bytes:
        if text.isascii() and "<" not in text:
            text, known = text.lower(), self.known
        elif self._plain(text):
            text, known = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower(), self.known  # lower() would make a final sigma
        else:
            known = self.known_whole
        words = _WORD.findall(text) if any(c in text for c in _NOT_SPACE) else text.split()
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        new = {w for w in words if w not in known}
        if len(known) + len(new) > self.cache:
            known.clear()
            new = set(words)
        if known is self.known:
            for word in new:
                known[word] = b"".join([self.known_pieces.get(p) or self.piece(p) for p in self.pieces(word)])
        else:
            new = list(new)
            for word, found in zip(new, self.library.encode_batch(new, add_special_tokens=False)):
                known[word] = np.array(found.ids, "<u4").tobytes()
        return b"".join([known[w] for w in words])


_ENCODERS: dict[str, WordTokens] = {}


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ENCODERS.get(path) or _ENCODERS.setdefault(path, WordTokens(path))
        for batch in batches:
            for part in vectext.slices(batch, "text"):
                out: list[list] = [[], [], [], [], []]
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                    ids = encode(text.as_py() or "") + end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        cut_ = ids[start : start + 4 * capacity]
                        for column, value in zip(out, (doc, piece, start // 4, len(cut_) // 4, zlib.crc32(cut_))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, ``end_id`` last, cut every ``capacity`` ids."""
    return id_text(docs).mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _assign(plan: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = np.int64(1) << 48
        starts = plan["length"] * stride + plan["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            row = np.searchsorted(starts, length * stride + rank, "right") - 1
            within = rank - plan["rank"][row]
            per_bin = plan["per_bin"][row]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(plan["sequence"][row] + within // per_bin), pa.array(plan["offset"][row] + within % per_bin * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, groups: int = GROUPS, end_id: int = 1) -> DataFrame:
    """All documents in few sequences of at most ``capacity`` tokens, one row per piece.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts
    are one end token. Documents longer than the capacity are cut, no others; repeated
    rows are packed once each; other columns are ignored; no rows give no rows.
    """
    pieces = cut(token_pieces(docs, tokenizer, capacity, end_id)).withColumn("part", F.spark_partition_id())
    counted = cut(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length, capacity rows at most
    plan = Plan(histogram, capacity, groups).arrays()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(inside)).join(starts, ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(_assign(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
