"""The pieces under the operators, without Spark."""

import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evoframe.llm import vectext
from evoframe.llm.cuckoo import CuckooFilter
from evoframe.llm.near_dedup import OnePermutation, _shared_counts
from evoframe.llm.packing import Plan, WordTokens
from evoframe.llm.pii import estimate, train
from evoframe.llm.toxicity import Ftrl
from tests.llm.conftest import EDGES


def spans(texts):
    data, at = vectext.utf8(pa.array(texts, pa.string()))
    starts, ends, of = vectext.word_spans(data, at)
    return [[bytes(data[a:b]) for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(of[:-1], of[1:])], (data, starts, ends, of)


def test_words_and_hashes():
    words, (data, starts, ends, of) = spans(EDGES)
    assert words == [[w.encode() for w in re.findall("[^\x20\x09-\x0d]+", t or "")] for t in EDGES]
    hashes = vectext.span_hashes(data, starts, ends)
    flat = [w for ws in words for w in ws]
    assert len({(w, h) for w, h in zip(flat, hashes.tolist())}) == len(set(flat)) == len(set(hashes.tolist()))


def test_windows_of_short_texts():
    _, (data, starts, ends, of) = spans(["a b c d", "a b", "", "a b c"])
    runs, at = vectext.windows(vectext.span_hashes(data, starts, ends), of, 3)
    assert np.diff(at).tolist() == [2, 1, 0, 1] and runs[0] == runs[3]


def test_cuckoo_filter():
    random.seed(1)
    keys = [random.randbytes(32) for _ in range(5000)]
    index = CuckooFilter(100, max_kicks=20)
    index.insert([(k, i) for i, k in enumerate(keys)])
    assert index.resizes > 0 and index.maybe(keys).all() and index.get(keys[7]) == 7
    others = [random.randbytes(32) for _ in range(5000)]
    assert index.maybe(others).mean() < 0.01
    assert index.delete(keys[:2000] + others[:10]) == 2000
    assert index.maybe(keys[2000:]).all() and index.maybe(keys[:2000]).mean() < 0.01
    index.insert([(keys[0], 9)])
    assert index.maybe(keys[:1]).all() and index.get(keys[0]) == 9


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    signature = OnePermutation(360)
    for size in (2, 5, 40, 900):
        agree = []
        for _ in range(30):
            pool = rng.integers(0, 2**63, size * 10 // 9 + 1).astype(np.uint64)
            a, b = np.sort(pool[:size]), np.sort(pool[-size:])
            both = signature(np.concatenate([a, b]), np.array([0, size, 2 * size]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            agree.append((both[0] == both[1]).mean() - true)
        assert abs(np.mean(agree)) < 0.05


def test_shared_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, 80)).astype(np.uint64) for _ in range(20)]
    assert _shared_counts(sets[:8], sets[8:], 16).tolist() == [[len(np.intersect1d(a, b)) for b in sets[8:]] for a in sets[:8]]


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_everything_once(seed):
    random.seed(seed)
    shape = [lambda: random.randint(1, 4096), lambda: random.randint(600, 1500), lambda: random.choice([1, 4096, 2049]), lambda: random.randint(1, 30), lambda: 1365, lambda: int(random.paretovariate(0.7)) % 4096 + 1][seed]
    counts = {}
    for _ in range(700):
        n = shape()
        counts[n] = counts.get(n, 0) + 1
    plan = Plan(counts)
    bins, placed = {}, {}
    for length, rank, count, per_bin, sequence, offset in plan.rows:
        assert rank == placed.get(length, 0)
        placed[length] = rank + count
        for i in range(count):
            bins.setdefault(sequence + i // per_bin, []).append((offset + i % per_bin * length, length))
    assert placed == counts and len(bins) == plan.bins
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096


def test_word_tokens_equal_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    encode = WordTokens(path, cache=50)
    random.seed(4)
    alphabet = "aAbBeéÉêßΣσςİ'’st 0١²Ⅷ,.!?-_<|>\n\t\x1c\x85\xa0é日本語한😀ﬁ#"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(500)] + [t or "" for t in EDGES]
    texts += ["".join(random.choice(["<|endoftext|>", "<|", "ENDOFTEXT|>", " ", "A", "\u0558", "\ua7cb", "\u0301", "\xa0"]) for _ in range(8)) for _ in range(300)]
    texts += ["a".join(map(chr, range(c, c + 256))) for c in range(0, 0x32000, 256) if not 0xD800 <= c < 0xE000]
    for text in texts:
        assert encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_expectation_maximisation_finds_the_reliable():
    random.seed(5)
    patterns = {}
    for _ in range(4000):
        true = random.random() < 0.4
        votes = tuple((1 if (true if random.random() < q else not true) else -1) for q in (0.95, 0.9, 0.6))
        patterns[votes] = patterns.get(votes, 0) + 1
    found, posterior = estimate(patterns, 3)
    assert found[0].yes[0] > 0.88 and found[2].yes[0] < 0.75 and posterior[1, 1, -1] > 0.9 > 0.1 > posterior[-1, -1, 1]
    assert estimate({}, 3)[1] == {}
    weights = train([((1, 0), 50.0, 1.0), ((0, 1), 50.0, 0.0)])
    assert weights[0] + weights[2] > 0 > weights[1] + weights[2]


def test_ftrl_learns_a_sparse_model():
    rng = np.random.default_rng(6)
    model = Ftrl(4096)
    for _ in range(3000):
        label = int(rng.random() < 0.3)
        model.learn(np.unique(np.r_[rng.integers(10, 4096, 40), 3 if label else 4]), label)
    at, weights, _ = model.sparse()
    held = dict(zip(at.tolist(), weights.tolist()))
    assert held[3] > 1 and len(at) < 400
