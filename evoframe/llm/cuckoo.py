"""A cuckoo filter over digests, with the keys it holds, and its sharded form.

The filter answers "maybe seen" in two bucket reads; the stored keys answer
exactly, allow a digest to be deleted again, and rebuild the filter at twice the
size when an insertion finds no room.
"""

from __future__ import annotations

import numpy as np

from evoframe.llm.vectext import mix

SLOTS = 4
MAX_KICKS = 200
LOAD = 0.84


class CuckooFilter:
    """16-bit fingerprints, four to a bucket, over live byte-string keys.

    ``keys`` maps each live key to a value; a filter hit is only a candidate and
    ``get`` settles it there. ``max_kicks`` bounds the evictions of one insertion.
    """

    def __init__(self, expected: int = 1, max_kicks: int = MAX_KICKS, seed: int = 7):
        self.max_kicks = max_kicks
        self.random = np.random.default_rng(seed)
        self.keys: dict[bytes, object] = {}
        self.resizes = 0
        self._allocate(expected)

    def _allocate(self, expected: int) -> None:
        buckets = 1
        while buckets * SLOTS * LOAD < expected:
            buckets *= 2
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), np.uint16)

    def _places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, bucket and other bucket of each key; keys are digests of 8 bytes or more."""
        head = mix(np.frombuffer(b"".join(k[:8].ljust(8, b"\0") for k in keys), "<u8"))
        print_ = (head >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = (head & np.uint64(self.buckets - 1)).astype(np.int64)
        return print_, first, self._other(first, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(print_.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def maybe(self, keys: list[bytes]) -> np.ndarray:
        """Whether each key may be live: never false for a live key."""
        if not keys:
            return np.zeros(0, bool)
        print_, first, second = self._places(keys)
        return (self.slots[first] == print_[:, None]).any(1) | (self.slots[second] == print_[:, None]).any(1)

    def get(self, key: bytes, default=None):
        return self.keys.get(key, default)

    def restore(self, slots: bytes, pairs: list[tuple[bytes, object]]) -> None:
        """Take up a kept filter, the bytes of ``slots``, with the live keys it stands for."""
        self.slots = np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy()
        self.buckets = len(self.slots)
        self.keys = dict(pairs)

    def insert(self, pairs: list[tuple[bytes, object]]) -> None:
        """Make keys live; a key that is live already only takes the new value."""
        fresh = {k: v for k, v in pairs if k not in self.keys}
        self.keys.update(pairs)
        if fresh and not self._place(list(fresh)):
            self._rebuild()

    def _place(self, keys: list[bytes]) -> bool:
        print_, first, second = self._places(keys)
        waiting = np.arange(len(keys))
        for bucket in (first, second):  # most keys find room without an eviction, all at once
            order = waiting[np.argsort(bucket[waiting], kind="stable")]
            at = bucket[order]
            begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
            rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
            free = self.slots[at] == 0
            fits = rank < free.sum(1)
            column = (np.cumsum(free[fits], 1) > rank[fits, None]).argmax(1)
            self.slots[at[fits], column] = print_[order[fits]]
            waiting = order[~fits]
        return all(self._kick(int(print_[i]), int(second[i])) for i in waiting)

    def _kick(self, print_: int, bucket: int) -> bool:
        for _ in range(self.max_kicks):
            empty = np.flatnonzero(self.slots[bucket] == 0)
            if len(empty):
                self.slots[bucket, empty[0]] = print_
                return True
            victim = int(self.random.integers(SLOTS))
            print_, self.slots[bucket, victim] = int(self.slots[bucket, victim]), print_
            bucket = int(self._other(np.array([bucket]), np.array([print_], np.uint16))[0])
        return False

    def _rebuild(self) -> None:
        """Grow until every stored key has a place."""
        size = max(len(self.keys), int(self.buckets * SLOTS * LOAD) + 1)
        while True:
            self.resizes += 1
            self._allocate(size)
            if self._place(list(self.keys)):
                return
            size = int(self.buckets * SLOTS * LOAD) + 1

    def delete(self, keys: list[bytes]) -> int:
        """Remove keys that are live, one fingerprint each; others are left alone."""
        live = list(dict.fromkeys(k for k in keys if k in self.keys))
        if not live:
            return 0
        for key, print_, *buckets in zip(live, *self._places(live)):
            bucket = next(b for b in buckets if (self.slots[b] == print_).any())
            self.slots[bucket, np.flatnonzero(self.slots[bucket] == print_)[0]] = 0
            del self.keys[key]
        return len(live)
