"""Operators and pipeline stages against brute force, and on edge cases."""

import collections
import functools
import hashlib
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from evoframe.llm import bpe, exact_dedup, lm_scoring, near_dedup, packing, pii, quality_rules, queries, shards, substring_dedup, token_counts, toxicity, vectext
from evoframe.llm.cuckoo import CuckooFilter
from tests.llm.conftest import EDGES

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def ordinary(model, text):
    """Ids as the library gives them; it cannot split a million blanks at once, so such texts are split before."""
    if len(text or "") < 500_000:
        return model.encode_ordinary(text or "")
    return [i for piece in regex.findall(public_tokenizers.PATTERN, text) for i in model._encode_single_piece(piece)]


def near_texts(seed=0):
    """Groups of near and exact copies whose members often differ from each other more than from the first."""
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    out = list(EDGES)
    for _ in range(6):
        base = [word() for _ in range(60)]
        for _ in range(12):
            copy = list(base)
            for _ in range(random.randint(0, 3)):
                copy[random.randrange(60)] = word()
            out.append(" ".join(copy))
    return out


def components(texts, words, percent=80):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))]


@pytest.mark.parametrize("words, blocks", [(4, 1 << 17), (5, 200)])
def test_near_groups(make, words, blocks):
    texts = near_texts(words)
    got = near_dedup.near_groups(make(texts, extra=True), words=words, block_shingles=blocks)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == components(texts, words)


def test_links_that_stars_miss_are_found(make, spark):
    """With bands of one row all texts share buckets, so the search has to find what the stars leave."""
    texts = near_texts(9)[len(EDGES) :]
    got = near_dedup.near_groups(make(texts), words=4, bands=30, rows=1, block_shingles=300)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == components(texts, 4)


def template_texts(seed=5):
    """Many short texts around shared phrases, and chains in which each text differs little from the next."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    phrases = [[f"p{k}{c}" for c in "abcdef"] for k in range(3)]
    texts = []
    for _ in range(900):
        own = [word() for _ in range(rng.randint(0, 5))]
        at = rng.randint(0, len(own))
        texts.append(" ".join(own[:at] + rng.choice(phrases) + own[at:]))
    for changes in (1, 2, 3):
        now = [f"t{changes}{i}" for i in range(40)]
        for _ in range(60):
            for _ in range(changes):
                now[rng.randrange(40)] = word()
            texts.append(" ".join(now))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("options", [{}, {"bands": 30, "rows": 1, "block_shingles": 500}])
def test_templates_and_chains(make, monkeypatch, options):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 50)
    texts = template_texts()
    got = near_dedup.near_groups(make(texts), words=4, **options)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == components(texts, 4)


def test_prefixes_meet():
    """Similar sets share one of their first elements, whatever the order."""
    rng = random.Random(4)
    for _ in range(3000):
        both, a, b = (rng.randrange(n) for n in (30, 6, 6))
        x = set(range(both + a))
        y = set(range(both)) | set(range(100, 100 + b))
        order = {e: rng.random() for e in x | y}
        if x and y and near_dedup.similar(both, len(x), len(y), 80):
            first = [set(sorted(s, key=order.get)[: near_dedup.prefix_length(len(s), 80)]) for s in (x, y)]
            assert first[0] & first[1]


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_copies(make, digest_bytes):
    """One-byte digests collide all the time, so content decides."""
    texts = EDGES + near_texts(2) + [f"t{i % 40}" for i in range(200)]
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[(t or "").translate(LOWER)].append(i)
    wanted = sorted((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    got = exact_dedup.group_copies(make(texts, extra=True), digest_bytes)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == wanted


def test_index_inserts_and_deletes(make):
    table = lambda texts: exact_dedup.digest_table(make(texts)).select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    index = exact_dedup.build_index(table(["a", "b", "c", "a"]), 3)
    assert rows(index, "keep_id", "group_size") == [(1, 1), (2, 1), (3, 2)]
    changed = exact_dedup.update_index(index, 3, inserted=table(["c", "d"]), deleted=table(["b", "zz"]))
    assert sorted(r.group_size for r in changed.collect()) == [1, 2, 2] and changed.count() == 3
    assert exact_dedup.update_index(index, 3) is index


def test_filters_settle_copies_of_different_tasks(make, monkeypatch):
    digests = exact_dedup.digest_table(make([(None, "a"), (7, "b"), (None, "c")] + [(i, f"t{i % 50}") for i in range(400)] + [((1 << 60) + 1, "a")]))
    digests = digests.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    index = exact_dedup.build_index(digests.repartition(4), 3)
    assert "Aggregate" not in index._jdf.queryExecution().toString()  # nothing else groups the digests
    assert collections.Counter((r.keep_id, r.group_size) for r in index.collect()) == collections.Counter([((1 << 60) + 1, 2), (7, 1), (None, 1), *((350 + i, 8) for i in range(50))])
    hits = []
    real = CuckooFilter.get
    monkeypatch.setattr(CuckooFilter, "get", lambda self, key: hits.append(key) or real(self, key))
    held, keys = CuckooFilter(100), [bytes(r.digest) for r in digests.limit(3).collect()]
    for _ in range(2):
        shards.take(held, keys, [(None, 1)] * 3, ["max", "sum"])
    assert len(set(hits)) == 3 and list(held.keys.values()) == [[None, 2]] * 3


def test_partitions_follow_rows_not_shards(spark):
    """Many shards share a partition in a large table, and so do many buckets."""
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [shards.parts_of(n, spark) for n in (1, 4, 100, 400_000)] == [1, min(4, few), max(few, 4), 12_500]
    assert [lm_scoring.buckets_and_parts(n << 20, 8) for n in (1, 16, 1 << 24)] == [(0, 1), (4, 8), (24, 1 << 16)]


def test_packing(make):
    got = packing.pack(make(EDGES, extra=True), WORDS).collect()
    encode = Tokenizer.from_file(WORDS)
    wanted = {}
    for i, text in enumerate(EDGES):
        ids = struct.pack("<I", 1)
        if text:
            ids = np.array(encode.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + ids
        for k, s in enumerate(range(0, len(ids), 4 * 4096)):
            piece = ids[s : s + 4 * 4096]
            wanted[i, k] = (s // 4, len(piece) // 4, zlib.crc32(piece))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == wanted
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(r.length for r in got) // 4096)


def test_bpe_round_trip(make, corpus):
    texts = EDGES + [t for _, t in corpus[:60]] + ["the the the"] * 50
    encoded = bpe.encode(make(texts, extra=True), RANKS, public_tokenizers.PATTERN, buckets=5, block_bytes=20_000, known_words=100)
    model = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: (bytes(r.ids), bytes(r.decoded)) for r in bpe.decode(encoded, RANKS).collect()}
    assert got == {i: (np.array(ordinary(model, t), "<u4").tobytes(), (t or "").encode()) for i, t in enumerate(texts)}


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(make, spark, rule):
    texts = EDGES + ["one\ntwo three\n\nfour", "日本\n語"]
    got = token_counts.section_counts(make(texts, extra=True), RANKS, public_tokenizers.PATTERN, rule=rule)
    model = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    totals = {r.doc_id: (r.n, r.end) for r in got.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("end").alias("end")).collect()}
    assert totals == {i: (len(ordinary(model, t)), len(t or "")) for i, t in enumerate(texts)}
    sections = spark.createDataFrame([(0, 0, 0, 3), (0, 1, 5, 9)], "doc_id long, section int, start long, end long")
    own = token_counts.section_counts(make(["abc  defg hi"]), RANKS, public_tokenizers.PATTERN, sections, rule)
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+|\s+", "abc  defg hi")]
    assert len(words) == 5 and sum(r.n_tokens for r in own.collect()) <= len(model.encode_ordinary("abc  defg hi"))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_by_section(make, spark, corpus, rule):
    """Every token of every text placed by a plain loop over characters and sections."""
    rng = random.Random(12)
    texts = [t or "" for t in EDGES[:5]] + ["one\ntwo  three\n\nfour 日本語テキスト 😀😀", "x" * 300] + [t[:3000] for _, t in corpus[:40]]
    given = {}
    for i, t in enumerate(texts):
        cuts = sorted(rng.sample(range(len(t) + 1), min(len(t) + 1, 2 * rng.randint(0, 6))))
        given[i] = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[::2], cuts[1::2])) if a < b]
    sections = spark.createDataFrame([(i, *s) for i, held in given.items() for s in held], "doc_id long, section int, start long, end long")
    model = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    wanted = {}
    for i, t in enumerate(texts):
        place = [k for k, c in enumerate(t) for _ in c.encode()]
        counts = {k: [a, b, 0, 0] for k, a, b in given[i]}
        at = 0
        for token in ordinary(model, t):
            n = len(model.decode_single_token_bytes(token))
            chars = set(place[at : at + n])
            at += n
            share = {k: sum(a <= c < b for c in chars) for k, a, b in given[i]}
            touched = [k for k, v in share.items() if v]
            if touched:
                chosen = {"first": touched[0], "last": touched[-1], "most": max(touched, key=lambda k: (share[k], -k))}[rule]
                counts[chosen][2] += 1
                counts[chosen][3] += len(touched) > 1
        wanted |= {(i, k): tuple(v) for k, v in counts.items()}
    got = token_counts.section_counts(make(texts, extra=True), RANKS, public_tokenizers.PATTERN, sections, rule)
    assert {(r.doc_id, r.section): (r.start, r.end, r.n_tokens, r.n_crossing) for r in got.collect()} == wanted


def test_attribution_rules():
    starts, ends = np.array([0, 4]), np.array([4, 9])
    first, last = np.array([0, 3, 2, 8]), np.array([2, 6, 5, 11])
    assert [token_counts.attribute(first, last, starts, ends, r)[0].tolist() for r in token_counts.RULES] == [[0, 0, 0, 1], [0, 1, 1, 1], [0, 1, 0, 1]]
    assert token_counts.attribute(first, last, starts[:0], ends[:0], "first")[0].tolist() == [-1] * 4


def split_sentences(text, near=substring_dedup.CUT_WORDS):
    """Sentences as tuples of lower-cased words: they end at marks, line breaks and before words of locally least hash."""
    words = [(w, line) for line, part in enumerate(text.split("\n")) for w in WORD.findall(part)]
    hashes = [word_hash(w.translate(LOWER)) for w, _ in words]
    least = [min(hashes[max(a, 0) : a + near]) for a in range(1 - near, len(words)) if words]  # of windows from a on
    out = []
    for i, (w, line) in enumerate(words):
        chosen = any(least[a + near - 1] == hashes[i] for a in range(i - near + 1, i + 1))
        if not i or chosen or words[i - 1][0][-1] in ".!?" or words[i - 1][1] != line:
            out.append(())
        out[-1] += (w.translate(LOWER),)
    return out


@functools.cache
def word_hash(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(vectext.span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def test_repeated_spans(make, corpus):
    texts = [*EDGES, *[t for _, t in corpus[:120]]]
    places = collections.defaultdict(list)
    for i, text in enumerate(texts):
        s = split_sentences(text or "")
        for a in range(len(s)):
            b = n = 0
            while a + b < len(s) and (b < 2 or n < 20):
                n += len(s[a + b])
                b += 1
            if b >= 2 and n >= 20:
                places[tuple(s[a : a + b])].append((i, a, a + b))
    wanted = collections.defaultdict(set)
    for held in places.values():
        for i, a, b in sorted(held)[1:]:
            wanted[i] |= set(range(a, b))
    got = collections.defaultdict(set)
    for r in substring_dedup.removed_spans(make(texts, extra=True)).collect():
        got[r.doc_id] |= set(range(r.first, r.stop))
    assert got == wanted
    clean = {r.doc_id: r for r in substring_dedup.without_repeats(make(texts)).collect()}
    assert len(clean) == len(texts) and all(r.n_removed == len(wanted.get(i, ())) for i, r in clean.items())
    assert all(clean[i].text == (texts[i] or "") for i in clean if i not in wanted)


def test_language_models(make, spark):
    texts = [*EDGES, *["alpha beta gamma"] * 20, *["delta beta gamma"] * 20]
    target = spark.createDataFrame([(i,) for i in range(len(EDGES), len(EDGES) + 20)], "doc_id long")
    models = lm_scoring.fit(make(texts, extra=True), target)
    got = {r.doc_id: r for r in lm_scoring.score(make(texts, extra=True), models).collect()}
    assert got[len(EDGES)].score < 0 < got[len(texts) - 1].score and got[0].score == got[1].score == 0 and len(got) == len(texts)
    words = [w for t in texts for w in WORD.findall((t or "").translate(LOWER))]
    assert models.words == len(set(words)) and models.tokens == (len(words), 60)
    empty = lm_scoring.fit(make([]), target)
    assert lm_scoring.score(make(["a b"]), empty).first().n_tokens == 2


def test_repeats_inside_sentences(make):
    """A passage of 60 words at any offset of a long sentence, and one between changed ends of short sentences."""
    rng = random.Random(3)
    fresh = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    passage, short = fresh(60), [*fresh(24), "One", "two.", *fresh(24)]  # 50 words: run words and five times the cut's
    texts = [*EDGES, " ".join(fresh(7) + passage + fresh(9)), " ".join(fresh(5) + short + fresh(5))]
    origins = len(texts) - 2, len(texts) - 1
    planted = {}
    for offset in range(0, 45):
        planted[len(texts)] = offset, 60, origins[0]
        texts.append(" ".join(fresh(offset) + passage + fresh(30)))
    for offset in (0, 3, 11, 24):
        planted[len(texts)] = offset, len(short), origins[1]
        texts.append(" ".join(fresh(offset) + short + fresh(3)) + ".")
    found = collections.defaultdict(list)
    for r in substring_dedup.removed_spans(make(texts, extra=True)).collect():
        found[r.doc_id].append(r)
    near = 2 * substring_dedup.CUT_WORDS
    at_word = lambda i, k: sum(map(len, split_sentences(texts[i])[:k]))
    for i, (offset, n, origin) in planted.items():
        (r,) = found[i]
        assert offset <= at_word(i, r.first) <= offset + near and offset + n - near <= at_word(i, r.stop) <= offset + n and r.first_doc_id == origin
    assert not set(origins) & set(found)
    clean = {r.doc_id: r for r in substring_dedup.without_repeats(make(texts)).collect()}
    for i in planted:
        w, (r,) = WORD.findall(texts[i]), found[i]
        assert WORD.findall(clean[i].text) == w[: at_word(i, r.first)] + w[at_word(i, r.stop) :] and clean[i].n_removed == r.stop - r.first
    for i, text in enumerate(EDGES):  # equal runs of one text: all but the first
        if text and text.startswith("word "):
            assert [(r.first, r.stop) for r in found[i]] == [(1, 30_000)]


def test_repeats_without_blanks(make):
    """A passage in a script without blanks, under other beginnings and ends, and under an id with other texts."""
    rng = random.Random(6)
    fresh = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))
    passage = "".join(fresh(9) + "。" for _ in range(25))
    texts = [fresh(40) + "。" + passage + fresh(30), fresh(17) + passage + fresh(11), "clean " + fresh(60), "the cat " + passage]
    docs = make([*enumerate(texts), (3, "other words under the same id " * 2), (None, passage)])
    found = collections.defaultdict(list)
    for r in substring_dedup.removed_spans(docs).collect():
        found[r.doc_id].append((r.first, r.stop))
    assert set(found) == {1, 3} and len(found[1]) == len(found[3]) == 1
    clean = sorted((r.doc_id or -1, r.text, r.n_removed) for r in substring_dedup.without_repeats(docs).collect())
    near = 2 * substring_dedup.CUT_WORDS
    for i, own in ((1, 28), (3, 6)):  # letters, and "the cat"; full stops of the passage go with their letters
        (kept,) = [t for j, t, n in clean if i == j and n]
        assert own <= len(kept) <= own + 2 * near + 4
    assert (3, "other words under the same id " * 2, 0) in clean and (-1, passage, 0) in clean and len(clean) == 6
    (short,) = [t for i, t, n in clean if i == 3 and n]
    assert short.startswith("the cat") and len(short) < 30


def test_hot_runs(make, monkeypatch):
    """Runs above the limit take another way to the same rows."""
    words = [" ".join(f"s{i}" for i in range(45)) + f" tail{k} " + " ".join(f"u{k}x{i}" for i in range(30)) + "." for k in range(60)]
    texts = words + [f"{w} one more two more" for w in words[:3]]
    results = []
    for limit in (500, 5):
        monkeypatch.setattr(substring_dedup, "HOT_ROWS", limit)
        monkeypatch.setattr(substring_dedup, "HOT_KEYS", 1 << 40)
        results.append(rows(substring_dedup.removed_spans(make(texts)), "doc_id", "first", "stop", "n_runs", "first_doc_id"))
    assert results[0] == results[1] and len({r[0] for r in results[0]}) == 62


def exact_losses(texts, chosen, smoothing=32.0):
    """(background loss, target loss) of every text from counts of all words and pairs in dicts."""
    words = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    models = []
    for named in (range(len(texts)), chosen):
        one, two, context = collections.Counter(), collections.Counter(), collections.Counter()
        for i in named:
            one.update(words[i])
            two.update(zip([None, *words[i]], words[i]))
            context.update(words[i] + [None] * bool(words[i]))
        models.append((one, two, context, sum(one.values())))
    size, out = len(models[0][0]), []
    for w in words:
        p = [[(two[h, x] + smoothing * (one[x] + 1) / (n + size + 1)) / (context[h] + smoothing) for h, x in zip([None, *w], w)] for one, two, context, n in models]
        out.append([-sum(map(math.log, q)) / max(len(w), 1) for q in p])
    return out


@pytest.mark.parametrize("n_docs", [30, 300])
def test_language_models_count_exactly(make, spark, monkeypatch, n_docs):
    monkeypatch.setattr(lm_scoring, "_BUCKET_WORDS", 1 << 12)
    rng = random.Random(n_docs)
    texts = [*EDGES[:7], *(" ".join(f"w{int(rng.paretovariate(0.2)) % 10**6}" for _ in range(400)) for _ in range(n_docs))]
    if n_docs == 300:
        texts += [" ".join(f"u{i}" for i in range(k, k + 5_000)) for k in range(0, 80_000, 5_000)]  # more words than a fixed vocabulary holds
    chosen = range(5, len(texts), 3)
    docs, target = make(texts, extra=True), spark.createDataFrame([(i,) for i in chosen], "doc_id long")
    models = lm_scoring.fit(docs, target)
    want = exact_losses(texts, chosen)
    for frame in (docs, make(texts)):  # the rows counted, and rows that only ask
        got = {r.doc_id: r for r in lm_scoring.score(frame, models).collect()}
        assert len(got) == len(texts)
        for i, (background, target_loss) in enumerate(want):
            assert got[i].background_loss == pytest.approx(background, abs=1e-9) and got[i].target_loss == pytest.approx(target_loss, abs=1e-9)


def test_toxicity(make, spark):
    random.seed(7)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(3))
    texts = [" ".join([word() for _ in range(30)] + (["Awful", "trash"] if i % 3 == 0 else [])) for i in range(600)]
    labels = spark.createDataFrame([(i, None if i == 5 else int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    docs = make([*texts, None, ""], extra=True)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert {i for i, r in got.items() if r.held_out} == {i for i in range(602) if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [i for i in range(600) if got[i].held_out]
    assert sum(got[i].predicted == int(i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert len(got) == 602 and got[600].score == got[601].score
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got.values())
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).agg(F.max("score")).first()[0] == 0.5


def test_toxicity_scores_by_hand(make, spark):
    """The learner and the scores against dictionaries: one step a labelled row, in the learner's own order."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["nice", "day", "Bad", "awful", "rain", "über", "x1"]) for _ in range(rng.randint(0, 9))) for _ in range(120)]
    labels = {i: int("awful" in t and "Bad" in t) for i, t in enumerate(texts) if i % 4}
    docs = make([*texts, None], extra=True)
    model = toxicity.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), epochs=2, l1=0.5)

    def features(text):
        found = toxicity.word_features(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))[0]
        return sorted(set(found.tolist()))

    order = spark.createDataFrame([(e, i) for e in (1, 2) for i in labels if zlib.crc32(str(i).encode()) % 5], "epoch int, turn long")
    z, n, bias = collections.defaultdict(float), collections.defaultdict(float), "bias"
    alpha, beta, l1, l2 = 3.0, 1.0, 0.5, 0.05

    def weight(k):
        strong = 0.0 if k == bias else l1
        return 0.0 if abs(z[k]) <= strong else -(z[k] - math.copysign(strong, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for row in order.orderBy("epoch", F.xxhash64("epoch", "turn"), "turn").collect():
        held = {k: weight(k) for k in [*features(texts[row.turn]), bias]}
        g = 1 / (1 + math.exp(-sum(held.values()))) - labels[row.turn]
        for k, w in held.items():
            z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w
            n[k] += g * g
    for r in toxicity.score(docs, model).collect():
        text = texts[r.doc_id] if r.doc_id < len(texts) else ""
        assert r.score == pytest.approx(1 / (1 + math.exp(-sum(weight(k) for k in [*features(text), bias]))), abs=1e-9)


def test_features_of_a_text():
    """Words, neighbours and pairs around one word, told apart by a dictionary."""
    hashed = lambda t: collections.Counter(toxicity.word_features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 60)[0].tolist())
    one = hashed("Ab, cd-ab: É")
    assert sum(one.values()) == 4 + 3 + 2 and hashed("ab cd ab É") == one and max(one.values()) == 2
    assert len(hashed("ab cd") & hashed("cd ab")) == 2 and not hashed("") and not hashed("!?")


def statistics(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count = collections.Counter(tuple(w[a : a + 3]) for a in range(len(w) - 2))
    covered = {a + k for a in range(len(w) - 2) if count[tuple(w[a : a + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_text_statistics(make):
    texts = [*EDGES, "a b c a b c", "a a a a", "x\nx\n x\n\n#*$ <|>&%"]
    got = rows(quality_rules.text_statistics(make(texts, extra=True)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == [(i, *statistics(t or "")) for i, t in enumerate(texts)]


def test_decision_list(make, spark):
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7)))
    texts = [" ".join(word() + ("%%" if i % 4 == 0 else "") for _ in range(70)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)], "doc_id long, quality int")
    docs = make([*texts, None, "short"], extra=True)
    got = quality_rules.judge(docs, labels)
    assert {r.doc_id for r in got.where("NOT kept").collect()} == {i for i in range(400) if i % 4 == 0} | {400, 401}
    assert quality_rules.judge(docs, labels.where("quality = 1")).where("kept").count() == 400
    assert quality_rules.judge(make([]), labels).count() == 0


def test_verdicts_by_hand(make, spark, corpus):
    """Rules applied by plain arithmetic on plain counts."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = dict(corpus) | {10_000 + i: t for i, t in enumerate(EDGES)}
    docs = make(list(texts.items()), extra=True)
    table = quality_rules.text_statistics(docs)
    rules = quality_rules.learn(table.where(~quality_rules.base_failed()), labels)
    rules = rules + [quality_rules.Rule((quality_rules.Term("upper_share", True, 0.05), quality_rules.Term("words_per_line", False, 40.0)))]
    ratio = lambda a, b: a / b if b else 0.0
    kept = {}
    for i, t in texts.items():
        t = t or ""
        n, chars, symbols, dup, repeat = statistics(t)
        lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
        count = lambda chars, t=t: sum(c in chars for c in t)
        value = {"n_words": n, "chars_per_word": ratio(chars, n), "symbols_per_word": ratio(symbols, n), "dup_line_share": ratio(dup, lines), "repeat_share": ratio(repeat, n), "words_per_line": ratio(n, lines), "upper_share": ratio(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars), "marks_per_word": ratio(count("!?"), n), "digit_share": ratio(count("0123456789"), chars)}
        met = any(all((value[x.feature] > x.cut) == x.above for x in rule.terms) for rule in rules)
        kept[i] = not (n < 50 or 100 * repeat > 50 * n or met)
    assert {r.doc_id: r.kept for r in quality_rules.apply_rules(table, rules).collect()} == kept
    assert set(kept.values()) == {True, False}


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and max(map(int, m[0].split("."))) > 255 or name == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or name == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), name))
    return [f"{n}:{a}:{b}" for a, _, b, n in sorted(out)]


def personal_texts():
    random.seed(10)
    bits = ["a.b+c@x-y.co.uk", "@", ".", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "000000001.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+1", " ", "é", "\n", "-", "9" * 30, "x_y@z.w_a@b.c", "12", "+44 20 7946 0958 ", "😀"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 14))) for _ in range(300)]
    return [*EDGES, *texts, "1 " * 20_000, "a" * 60_000 + "@", "1." * 30_000, ("n@m.org 10.0.0.1 " * 1500)]


def test_personal_data(make):
    texts = personal_texts()
    got = pii.digests(pii.find(make(texts, extra=True)))
    wanted = [base_spans(t or "") for t in texts]
    for r in got.collect():
        spans = wanted[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), texts[r.doc_id][:200]
        assert [getattr(r, f"n_{n}") for n, _ in PATTERNS] == [sum(s.startswith(n) for s in spans) for n, _ in PATTERNS]
        assert set(spans) <= set(r.spans.split(",")) or not spans


def test_added_spans_and_mask(make):
    secret = hashlib.sha1(b"s").hexdigest()
    texts = [f'token = "{hashlib.sha1(bytes([i])).hexdigest()}" end' for i in range(30)] + ["plainwordthatgoesonandon42 x" for _ in range(30)] + [f'a@b.cd token = "{secret}" 1.2.3.4', None, "clean"]
    found = {r.doc_id: r.spans for r in pii.digests(pii.find(make(texts))).collect()}
    assert found[0] == "secret:9:49" and found[40] == "" and found[60].count("secret") == 1 and found[62] == ""
    clean = {r.doc_id: (r.text, r.n_chars) for r in pii.mask(make(texts)).collect()}
    assert clean[60] == ('[EMAIL] token = "[SECRET]" [IP]', 31) and clean[61] == (None, None) and clean[62] == ("clean", 5)


def added_spans(text, weights):
    """Candidates by Python's own search, judged with the weights and dropped where a base span is."""
    base = [tuple(map(int, s.split(":")[1:])) for s in base_spans(text)]
    out = []
    for kind, pattern in (("secret", pii.SECRET), ("national_id", pii.NATIONAL)):
        for m in re.finditer(pattern, text) if re.search("[0-9]", text) else ():
            hit, before = m[0], text[max(0, m.start() - pii.CONTEXT_CHARS) : m.start()]
            share = sum(c in "0123456789" for c in hit) / len(hit)
            marks = [kind == "national_id", len(hit) >= 32, share >= 0.25, share >= 0.6, bool(re.search("^[0-9a-fA-F-]+$", hit)), bool(re.search("[_-]", hit)), bool(re.search("[\"'=:]\\s*[\"']?$", before)), bool(re.search("[A-Za-z]{8,}", hit))]
            if weights[-1] + sum(w for w, on in zip(weights, marks) if on) >= 0 and not any(a < m.end() and m.start() < b for a, b in base):
                out.append((m.start(), len(PATTERNS) + (kind != "secret"), m.end(), kind))
    return out


def masked_text(text, spans):
    out, at = [], 0
    for start, _, end, kind in spans:
        if start >= at:
            out.append(text[at:start] + f"[{kind.upper()}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def test_added_spans_by_hand(make, corpus):
    rng = random.Random(13)
    key = lambda n: "".join(rng.choice("abcdefABCDEF0123456789_") for _ in range(n))
    bits = [lambda: f"token: {key(40)}", lambda: f"id {rng.randrange(100, 900)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", lambda: f"https://x.y/{key(22)}", lambda: "a.b@c.de", lambda: "plainword", lambda: "10.0.0.7", lambda: "é😀", lambda: "+44 20 7946 0958 12-3456789-01"]
    texts = personal_texts()[len(EDGES) :][:100] + [" ".join(rng.choice(bits)() for _ in range(rng.randint(1, 12))) for _ in range(200)]
    texts += [" ".join(rng.choice(bits)() for _ in range(1500)), f"{key(30)} " * 700, "a@b.cd " * 3000 + key(30), "x" * 5000 + "é" * 3000 + f" {key(40)} 1.2.3.4"]
    docs = make(texts)
    weights = pii._classifier(docs)
    wanted = {}
    for i, t in enumerate(texts):
        base = [(int(a), [n for n, _ in PATTERNS].index(k), int(b), k) for k, a, b in (s.split(":") for s in base_spans(t))]
        wanted[i] = sorted(base + added_spans(t, weights))
    found = {r.doc_id: r.spans for r in pii.digests(pii.find(docs)).collect()}
    assert found == {i: ",".join(f"{k}:{a}:{b}" for a, _, b, k in s) for i, s in wanted.items()}
    assert any(k == "secret" for s in wanted.values() for *_, k in s) and any(k == "national_id" for s in wanted.values() for *_, k in s)
    assert {r.doc_id: r.text for r in pii.mask(docs).collect()} == {i: masked_text(t, wanted[i]) for i, t in enumerate(texts)}


def test_empty_tables(make, spark):
    none = make([])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    results = [packing.pack(none, WORDS), near_dedup.near_groups(none), token_counts.section_counts(none, RANKS, public_tokenizers.PATTERN), substring_dedup.removed_spans(none), toxicity.score(none, toxicity.fit(none, labels)), pii.find(none), bpe.decode(bpe.encode(none, RANKS, public_tokenizers.PATTERN), RANKS), exact_dedup.group_copies(none)]
    assert [r.count() for r in results] == [0] * len(results)


def test_null_and_repeated_ids(make):
    docs = make([(None, "one two three four five six"), (1, "one two three four five six"), (1, "one two three four five six"), (None, None)])
    assert near_dedup.near_groups(docs).count() == exact_dedup.group_copies(docs).count() == 4
    assert packing.pack(docs, WORDS).count() == bpe.encode(docs, RANKS, public_tokenizers.PATTERN).count() == 4
    for frame in (token_counts.section_counts(docs, RANKS, public_tokenizers.PATTERN), substring_dedup.without_repeats(docs), pii.find(docs), quality_rules.text_statistics(docs)):
        assert frame.count() == 4


def test_exact_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = queries.QUERIES["op10_exact_dedup"](spark, SF)
    duck.register("found", found.toArrow())
    duck.execute("CREATE TABLE ours AS SELECT * FROM found")
    assert duck.execute(f"SELECT * FROM ours EXCEPT ALL ({queries.ORACLE_SQL['op10_exact_dedup']})").fetchall() == []


def test_pipeline_stages(spark, corpus):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["exact_dedup"](spark, docs, SF)
    last = {}
    for i, t in corpus:
        last[t.translate(LOWER)] = max(i, last.get(t.translate(LOWER), -1))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(last.values())
    texts = [t for _, t in corpus]
    assert [i for i, _ in corpus] == list(range(len(texts)))
    near = stages["near_dedup"](spark, docs, SF)
    assert sorted(r.doc_id for r in near.collect()) == [i for i, _, _, k in components(texts, 5) if k]
    masked = {r.doc_id: r.text for r in stages["pii"](spark, docs, SF).collect()}
    assert all((masked[i] == t) for i, t in corpus if not re.search(r"[0-9]", t)) and not any(base_spans(t) for t in masked.values())


def test_pipeline_stages_on_edges(spark, make):
    """Null and repeated ids, clashing names, nulls, ties, long texts and empty tables, in every stage."""
    stages = dict(corpus_pipeline.STAGES)
    base = " ".join(f"w{i}" for i in range(60))
    pairs = [*enumerate(EDGES), (100, base), (100, base), (101, base + " x"), (None, base), (None, "alone in the world"), (None, "alone in the world"), (102, "ab Cd"), (102, "AB cd"), (103, "a@b.cd " * 2)]
    docs = make(pairs, extra=True).withColumns({c: F.lit("own") for c in ("kept_id", "kept_sha", "KEPT_ID_", "n", "a b", "row")})
    out = {name: stages[name](spark, docs, SF) for name in ("toxicity", "exact_dedup", "near_dedup", "pii")}
    assert all(o.columns == docs.columns for o in out.values())
    exact = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in out["exact_dedup"].collect())
    groups = collections.defaultdict(list)
    for i, t in pairs:
        groups[(t or "").translate(LOWER)].append(-1 if i is None else i)
    assert sorted(i for i, _ in exact) == sorted(max(g) for g in groups.values()) and len(exact) == len(groups)
    near = collections.Counter(r.doc_id for r in out["near_dedup"].collect())
    assert near[100] == 2 and near[101] == 0 and near[None] == 3 and near[102] == 2
    masked = {r.doc_id: r.text for r in out["pii"].collect()}
    assert masked[103] == "[EMAIL] [EMAIL] " and masked[0] is None and masked[6] == EDGES[6] and out["pii"].count() == len(pairs)
    assert out["toxicity"].count() <= len(pairs) and {r["a b"] for r in out["toxicity"].collect()} == {"own"}
    packed = stages["packing"](spark, docs, SF)
    assert packed.select("doc_id", "text_" if "text_" in packed.columns else "piece").count() >= len(pairs)
    none = docs.limit(0)
    assert [s(spark, none, SF).count() for s in stages.values()] == [0] * 5


def test_pipeline_runs(spark):
    import os

    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = {d for d in os.listdir(folder) if d.startswith("rdd-")}
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and "sequence_id" in out.columns
    assert {d for d in os.listdir(folder) if d.startswith("rdd-")} <= before
    assert [os.listdir(f"{folder}/{d}") for d in os.listdir(folder) if d.startswith("pipeline-")] == [["packing"]]


def test_only_shuffled_rows_are_written_for_a_fixed_order(spark, tmp_path):
    from evoframe.llm.common import fixed_order

    spark.range(100).write.parquet(f"{tmp_path}/ids")
    ids = spark.read.parquet(f"{tmp_path}/ids")
    joined = ids.join(F.broadcast(ids.withColumnRenamed("id", "other")), F.col("id") == F.col("other"), "left")
    assert fixed_order(ids) is ids
    assert fixed_order(joined) is joined
    shuffled = ids.repartition(3, "id")
    assert fixed_order(shuffled) is not shuffled
