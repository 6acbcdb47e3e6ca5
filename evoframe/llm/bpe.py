"""Byte-level BPE by a global shuffle of distinct words.

A text is split into pre-tokens once. Each block of documents keeps, for every
document, the numbers of its pre-tokens in order, and sends its distinct
pre-tokens to buckets chosen by their hash. A bucket encodes each distinct word
once for the whole corpus and returns its ids to every block that asked; the block
then reassembles its documents by position. A frequent word is one entry a block,
whatever its count, so no key grows with the corpus' word frequencies.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoframe.llm import vectext
from evoframe.llm.common import fixed_order, id_text

BLOCK_BYTES = 12 << 20
BUCKETS = (16, 4096)
#: Distinct words a bucket task remembers; beyond, it starts anew and may encode a word again.
KNOWN_WORDS = 2_000_000

_SEQUENCE, _WORDS, _IDS = 0, 1, 2
_NO_ID = -(1 << 63)
_MOVED = "kind int, dest long, block long, bucket int, payload binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of base64 token and rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


_LOADED: dict[tuple, object] = {}


def encoding(path: str, pattern: str):
    """The tiktoken encoding over a rank file, one to a process."""
    if (path, pattern) not in _LOADED:
        import tiktoken

        _LOADED[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _LOADED[path, pattern]


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one compressed payload; integers go byte by byte of like weight, which compresses best."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    raw = np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(payload: bytes, *kinds: str | None) -> list:
    raw = pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 8 * len(kinds)
    for size, kind in zip(np.frombuffer(raw, "<i8", len(kinds)).tolist(), kinds):
        part = raw[at : at + size]
        if kind is not None:
            width = np.dtype(kind).itemsize
            part = np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)
        out.append(part)
        at += size
    return out


def _small(values: np.ndarray) -> np.ndarray:
    """Values as 16-bit where they all fit, else as 32-bit."""
    return values.astype("<u2" if not len(values) or values.max() < 1 << 16 else "<u4")


def _moved(kind: int, dest: list[int], block: int | list[int], bucket: list[int], payload: list[bytes]) -> pa.RecordBatch:
    n = len(dest)
    blocks = [block] * n if isinstance(block, int) else block
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.int32()), pa.array(dest, pa.int64()), pa.array(blocks, pa.int64()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())],
        ["kind", "dest", "block", "bucket", "payload"],
    )


def _bucket(words: list[bytes], buckets: int) -> np.ndarray:
    at = np.cumsum([0] + [len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    return (vectext.span_hashes(data, at[:-1], at[1:]) % np.uint64(buckets)).astype(np.int64)


def _explode(pattern: str, buckets: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        block = TaskContext.get().partitionId() << 32
        numbers: dict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        docs: list[int] = []
        sequences: list[np.ndarray] = []
        held = 0

        def flush():
            flat = np.concatenate(sequences)
            counts = np.bincount(flat, minlength=len(numbers))
            by_count = np.argsort(-counts, kind="stable")
            rank = np.empty(len(numbers), "<u4")
            rank[by_count] = np.arange(len(numbers))
            flat = rank[flat]
            often = np.minimum(flat, 255).astype(np.uint8)
            docs_ = np.array([_NO_ID if d is None else d for d in docs], "<i8")
            yield _moved(_SEQUENCE, [block], block, [-1], [_pack(docs_, np.array([len(s) for s in sequences], "<u4"), often, flat[often == 255] - np.uint32(255))])
            if not numbers:
                return
            spelled = list(numbers)
            words = [spelled[i].encode() for i in by_count.tolist()]
            of = _bucket(words, buckets)
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(buckets + 1))
            used, payload = [], []
            for b in np.flatnonzero(np.diff(ends)).tolist():
                mine = order[ends[b] : ends[b + 1]]
                chosen = [words[i] for i in mine.tolist()]
                used.append(b)
                payload.append(_pack(np.diff(mine, prepend=0).astype("<u4"), np.array([len(w) for w in chosen], "<u4"), b"".join(chosen)))
            yield _moved(_WORDS, used, block, used, payload)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                sequences.append(np.fromiter(map(numbers.__getitem__, find(text)), "<u4"))
                docs.append(doc)
                held += len(text) + 16
                if held >= block_bytes:
                    yield from flush()
                    numbers.clear()
                    docs, sequences, held = [], [], 0
                    block += 1
                    vectext.release_memory()
        if docs:
            yield from flush()
        numbers.clear()
        docs, sequences = [], []
        vectext.release_memory()

    return run


def _encode_words(path: str, pattern: str, known_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = encoding(path, pattern)._core_bpe.encode_single_piece
        known: dict[bytes, bytes] = {}
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            passed = batch.filter(pa.array(kind == _SEQUENCE))
            if passed.num_rows:
                yield passed
            for row in np.flatnonzero(kind == _WORDS).tolist():
                block, bucket = batch.column("block")[row].as_py(), batch.column("bucket")[row].as_py()
                steps, sizes, raw = _unpack(batch.column("payload")[row].as_py(), "<u4", "<u4", None)
                ends = np.cumsum(sizes).tolist()
                out, at = [], 0
                for end in ends:
                    word = raw[at:end]
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= known_words:
                            known.clear()
                        ids = known[word] = np.array(single(word), "<u4").tobytes()
                    out.append(ids)
                    at = end
                flat = _small(np.frombuffer(b"".join(out), "<u4"))
                payload = _pack(steps, np.array([len(x) >> 2 for x in out], "<u4"), bytes([flat.itemsize]), flat)
                yield _moved(_IDS, [block], block, [bucket], [payload])
        known.clear()
        vectext.release_memory()

    return run


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + size), one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def _unpack_ids(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = _unpack(payload, "<u4", "<u4", None, None)
    kind = f"<u{raw[2][0]}"
    ids = np.ascontiguousarray(np.frombuffer(raw[3], np.uint8).reshape(raw[2][0], -1).T).reshape(-1).view(kind)
    return raw[0], raw[1], ids.astype("<u4")


def _reassemble(table: pa.Table) -> pa.Table:
    kind = table.column("kind").to_numpy()
    payload = table.column("payload")
    numbers, sizes, flat = [], [], []
    for row in np.flatnonzero(kind == _IDS).tolist():
        steps, size, ids = _unpack_ids(payload[row].as_py())
        numbers.append(np.cumsum(steps, dtype=np.int64))
        sizes.append(size)
        flat.append(ids)
    flat = np.concatenate(flat) if flat else np.zeros(0, "<u4")
    size = np.zeros(sum(map(len, numbers)), np.int64)
    start = np.zeros(len(size), np.int64)
    if numbers:
        number, found = np.concatenate(numbers), np.concatenate(sizes).astype(np.int64)
        size[number] = found
        start[number] = np.cumsum(found) - found
    docs, ids = [], []
    for row in np.flatnonzero(kind == _SEQUENCE).tolist():
        doc, lengths, often, rest = _unpack(payload[row].as_py(), "<i8", "<u4", "u1", "<u4")
        docs.extend(None if d == _NO_ID else d for d in doc.tolist())
        sequence = often.astype(np.int64)
        sequence[often == 255] += rest
        at = 0
        for length in lengths.tolist():
            words = sequence[at : at + length]
            ids.append(flat[_gather(start[words], size[words])].astype("<u4").tobytes())
            at += length
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "ids": pa.array(ids, pa.binary())})


def encode(docs: DataFrame, ranks: str, pattern: str, buckets: int | None = None, block_bytes: int = BLOCK_BYTES, known_words: int = KNOWN_WORDS) -> DataFrame:
    """doc_id, ids: each whole text's token ids as little-endian unsigned 32-bit integers.

    Every match of ``pattern`` is encoded by itself, without special tokens. Null and
    empty texts have no ids. Rows that repeat a doc_id give a row each. Other columns are
    ignored; no rows give no rows. ``ranks`` is a path each executor can read.
    """
    texts = fixed_order(id_text(docs))  # words are numbered as they come
    parts = texts.rdd.getNumPartitions() if buckets is None else buckets
    buckets = min(max(parts, BUCKETS[0]), BUCKETS[1]) if buckets is None else buckets
    moved = texts.mapInArrow(_explode(pattern, buckets, block_bytes), _MOVED)
    # Sequences pass through this stage as they are, spread by block.
    worded = moved.repartition(buckets, "kind", "dest").mapInArrow(_encode_words(ranks, pattern, known_words), _MOVED)
    return worded.select("kind", "block", "payload").groupBy("block").applyInArrow(_reassemble, "doc_id long, ids binary")


def _decode(path: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, "bytes") not in _LOADED:
            ranks = read_ranks(path)
            tokens = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                tokens[rank] = token
            size = np.array([len(t) for t in tokens], np.int64)
            _LOADED[path, "bytes"] = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size
        flat, start, size = _LOADED[path, "bytes"]
        for whole in batches:
            for low in range(0, whole.num_rows, 512):  # small outputs keep a task's memory low
                batch = whole.slice(low, 512)
                out = []
                for ids in batch.column(column):
                    ids = np.frombuffer(ids.as_py() or b"", "<u4")
                    out.append(flat[_gather(start[ids], size[ids])].tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])
            vectext.release_memory()

    return run


def decode(encoded: DataFrame, ranks: str, column: str = "ids") -> DataFrame:
    """The input with ``decoded`` (binary): its ids joined with the table of token bytes, which the vocabulary bounds.

    Null and empty ids decode to no bytes. An id outside the table is an error.
    """
    from pyspark.sql.types import BinaryType, StructType

    schema = StructType(list(encoded.schema.fields)).add("decoded", BinaryType())
    return encoded.mapInArrow(_decode(ranks, column), schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of ids and of decoded bytes, from encode() and decode(), row by row.

    Null ids have null digests; empty ones are no tokens and the digest of no bytes.
    """
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
