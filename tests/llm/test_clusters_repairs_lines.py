"""Centroid clustering, conversation repair and line dedup against brute force and SQL, and on edge cases."""

import collections
import functools
import hashlib
import itertools
import random
import zlib
from math import floor, isfinite

import duckdb
import pytest
from pyspark.sql import functions as F

from evoframe.llm import centroids, conversations, line_dedup, queries
from tests.llm.conftest import EDGES

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def rows(frame):
    return collections.Counter(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("name, table", [("op11_centroid_clustering", "embeddings"), ("op12_conversation_repair", "conversations"), ("op13_line_dedup", "documents")])
def test_queries_equal_sql(spark, name, table):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    found = queries.QUERIES[name](spark, SF)
    wanted = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert rows(found) == collections.Counter(wanted) and wanted


# Centroids


def clustered(vectors, dimensions, clusters, rounds, scale, seed):
    """(vec_id, cluster, distance, cluster inertia, inertia, hash) by plain loops."""
    kept = [(i, [floor(scale * x) for x in v]) for i, v in vectors if v is not None and len(v) == dimensions and all(x is not None and isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    centres = [v for _, v in first]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((square(v, c), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        of = collections.defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        for k, held in of.items():
            centres[k] = [sum(x) // len(held) for x in zip(*held)]
    placed = [(i, near(v)) for i, v in kept]
    inertia = collections.Counter()
    for _, (d, k) in placed:
        inertia[k] += d
    return collections.Counter((i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for i, (d, k) in placed)


@pytest.mark.parametrize("block", [40, 4096])
def test_clusters(spark, monkeypatch, block):
    """Blobs, exact copies, ties, vectors without id, and ones to leave out."""
    monkeypatch.setattr(centroids, "BLOCK_ROWS", block)
    rng = random.Random(block)
    blobs = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(5)]
    vectors = [(i, [x + rng.gauss(0, 0.02) for x in rng.choice(blobs)]) for i in range(600)]
    vectors += [(1000 + i, [0.5, -0.25, 0.125]) for i in range(300)] + [(i, [i % 2 - 0.5, 0.0, 0.0]) for i in range(60)]
    vectors += [(None, [0.1, 0.2, 0.3])] * 3
    vectors += [(5000, None), (5001, []), (5002, [0.1, 0.2]), (5003, [0.1, None, 0.2]), (5004, [float("nan"), 0.0, 0.0]), (5005, [float("inf"), 0.0, 0.0]), (5006, [0.0, -0.0, 1e-9])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).withColumn("v", F.lit("clash"))
    options = dict(dimensions=3, clusters=7, rounds=4, scale=1024, seed=3)
    assert rows(centroids.cluster(frame.repartition(3), **options)) == clustered(vectors, **options)


def test_few_and_far_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0])], schema)
    assert sorted((r.vec_id, r.distance, r.inertia) for r in centroids.cluster(few, 2).collect()) == [(1, 0, 0), (2, 0, 0)]
    assert centroids.cluster(few, 3).count() == 0 and centroids.cluster(few.limit(0), 2).count() == 0
    far = spark.createDataFrame([(i, [3e38 * (-1) ** i] * 64) for i in range(4)], schema)
    found = centroids.cluster(far, 64, clusters=1, rounds=1).collect()
    assert len(found) == 4 and {r.distance for r in found} <= {64 * (1 << 54), 64 * ((1 << 27) + 1) ** 2, 64 * ((1 << 27) - 1) ** 2}


def test_balls_go_whole():
    """Of well separated blobs no leaf is compared row by row."""
    import numpy as np

    random_ = np.random.default_rng(0)
    centres = np.array([[0] * 8, [10**6] * 8, [-(10**6)] * 8])
    vectors = (centres[random_.integers(0, 3, 3000)] + random_.integers(-1000, 1000, (3000, 8))).astype(np.int64)
    order, nodes, sums, radii = centroids._tree(vectors)
    block = object.__new__(centroids._Block)
    block.vectors, block.nodes, block.sums, block.radii = vectors[order], nodes, sums, radii
    parts = list(centroids._assigned(block, centres))
    assert not any(len(r) for _, _, r in parts) and sum(len(n) for n, _, _ in parts) <= 6
    assert (centroids._numbers(block, centres) == centroids._nearest(block.vectors, centres, np.arange(3))[0]).all()


# Conversations


def edits(signature):
    """The cheapest audit by trying every edit, with up to two insertions in every gap."""
    faults = {code: fault for fault, codes in conversations.FAULTS.items() for code in codes}
    roles = {code: role for codes in conversations.FAULTS.values() for code, role in zip(codes, "suao")}
    legal = lambda out: out in ("", "s") or (out.lstrip("s") == ("ua" * len(out))[: len(out.lstrip("s"))] and out.count("s") <= 1 and "s" not in out[1:])

    def tried(i, out, cost, audit, room):
        if not legal(out):
            return
        if i == len(signature) and (not out or out.endswith("a")):
            yield cost, audit
        if room:
            for role in "ua":
                yield from tried(i, out + role, cost + 5, audit + "I", room - 1)
        if i < len(signature):
            yield from tried(i + 1, out, cost + 2, audit + "D", 2)
            fault = faults[signature[i]]
            if fault in ("", "truncated"):
                stays = 5 if fault else 0
                yield from tried(i + 1, out + roles[signature[i]], cost + stays, audit + "K", 2)
                for role in "ua":
                    yield from tried(i + 1, out + role, cost + stays + 1, audit + "R", 2)

    return min(tried(0, "", 0, "", 2))


def test_signatures_are_solved():
    solver, rng = conversations.Solver(), random.Random(1)
    every = "".join(conversations.FAULTS.values())
    short = ["".join(s) for n in range(4) for s in itertools.product("suaoSUA05", repeat=n)]
    for signature in [*short, *("".join(rng.choices(every + "uauaua", k=rng.randint(4, 6))) for _ in range(150))]:
        assert solver.solve(signature) == edits(signature), signature
    assert len(solver.steps) < 2_000  # few states, whatever the signatures
    cost, audit = solver.solve("ua" * 100_000 + "s")
    assert cost == 2 and len(audit) == 200_001


def repaired(conversation_rows):
    """The result by plain loops: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, hash."""
    kept = collections.defaultdict(list)
    for conv, turn, role, text in conversation_rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        held = kept[conv]
        if kind == 0:
            continue
        text = {1: "", 2: text.translate(str.maketrans("", "", ".!?"))}.get(kind, text)
        role = "user" if kind == 4 else role
        held += [(turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text)] * (2 if kind == 3 else 1)
    solver, out = conversations.Solver(), []
    for conv, held in kept.items():
        held.sort()
        seen, signature, counts = set(), "", collections.Counter()
        for _, _, role, _, text in held:
            end = text.rstrip(BLANKS)[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            place = "sua".find(role[:1]) if role[:1] else -1
            signature += conversations.FAULTS[fault][place if place >= 0 else 3]
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        turns = {t for known, t, *_ in held if known}
        cost, audit = solver.solve(signature)
        new, at = [], iter(held)
        for edit in audit:
            row = next(at) if edit != "I" else None
            if edit == "D":
                continue
            wanted = "user" if not new or new[-1][0][0] in "sa" else "assistant"
            new.append((row[2] if edit == "K" else wanted, row[4] if row else ""))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in new).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest))
    return collections.Counter(out)


def test_conversations(spark):
    """Nulls, ties, repeats, odd roles, conversations that lose all rows, and a long one."""
    rng = random.Random(4)
    texts = ["Fine.", "So?", "Yes!", "cut off", "", " \n\t", None, "Ende. ", "É.", "x" * 50_000 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    data = [(c, rng.choice([None, *range(-2, 9)]), rng.choice(roles), rng.choice(texts)) for c in range(150) for _ in range(rng.randint(1, 7))]
    data += [(None, t, rng.choice(roles), rng.choice(texts[:5])) for t in range(6)] + [(7, 3, "user", "Twice.")] * 3
    data += [(9_999, t, ("user", "assistant")[t % 2], f"Row {t}.") for t in range(4_000)]
    data += [(c, t, "user", "Gone.") for c in range(20_000, 20_400) for t in (1,) if zlib.crc32(f"{c}:1".encode()) % 20 == 0]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    for name in ("code", "part", "audit", "digest", "alive"):
        frame = frame.withColumn(name, F.lit("clash"))
    found = conversations.digests(conversations.repair(conversations.damaged(frame.repartition(5))))
    got, wanted = rows(found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")), repaired(data)
    assert got == wanted
    empty = conversations.damaged(frame.limit(0))
    audited, messages = conversations.repair(empty)
    assert audited.count() == messages.count() == 0


def test_replayed_messages(spark):
    data = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "You?"), (2, 5, "assistant", "Well."), (2, 6, "tool", "ok.")]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("alive", F.lit(True))
    audited, messages = conversations.repair(frame)
    assert {(r.conv_id, r.cost, r.audit) for r in audited.collect()} == {(1, 1, "KKR"), (2, 2, "RR")}
    assert [tuple(r) for r in messages.orderBy("conv_id", "place").collect()] == [
        (1, 0, "K", 0, "system", "Be kind."), (1, 1, "K", 1, "user", "Hi."), (1, 2, "R", 2, "assistant", "You?"), (2, 0, "R", 5, "user", "Well."), (2, 1, "R", 6, "assistant", "ok."),
    ]


# Lines


def deduped(texts):
    """(doc_id, lines, dropped, text) by a dict of keys."""
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(BLANKS).translate(fold)
    holders = collections.defaultdict(set)
    for i, text in texts:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, text in texts:
        lines = (text or "").split("\n")
        held = [holders.get(key(line), ()) for line in lines]
        kept = [line for line, h in zip(lines, held) if i is None or len(h) < 2 or min(h) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


def line_texts(seed):
    rng = random.Random(seed)
    common = ["A common footer", "  a COMMON footer\t", "ärger überall!", "日本日本日本日本日本", "short", "", "\r", "exactly 10", "nine char", "É" * 10, "é" * 10, "é" * 9]
    return [(i % 90 if i < 100 else i, "\n".join(rng.choice(common) if rng.random() < 0.5 else f"line number {rng.randrange(60)}" for _ in range(rng.randint(0, 12)))) for i in range(160)] + [(None, "A common footer\nx"), (None, "A common footer")]


def test_lines(make, corpus):
    texts = [*((1000 + i, t) for i, t in enumerate(EDGES)), *line_texts(2), *corpus]
    assert rows(line_dedup.without_repeats(make(texts, extra=True).repartition(4))) == deduped(texts)
    assert line_dedup.without_repeats(make([])).count() == 0


def test_line_index_is_reversible(make, spark, tmp_path, monkeypatch):
    """Insertions and deletions leave the index that the documents alone would build; filters are kept and taken up."""
    texts = line_texts(5)
    first, second = texts[:80], texts[80:]
    state = lambda index: rows(index.keys.select("digest", "refs", "first_id", "last_id"))
    built = line_dedup.build(make(first))
    grown = line_dedup.insert(built, make(second))
    assert state(grown) == state(line_dedup.build(make(texts))) and grown.counts.where("slots IS NOT NULL").count() >= 1
    grown.save(str(tmp_path / "index"))
    grown = line_dedup.LineIndex.load(spark, str(tmp_path / "index"))
    ids = {i for i, _ in second if i is not None}
    less = line_dedup.delete(grown, spark.createDataFrame([(i,) for i in ids] + [(777_777,), (None,)], "doc_id long"))
    assert state(less) == state(line_dedup.build(make([t for t in texts if t[0] not in ids])))
    rest = [t for t in texts if t[0] not in ids]
    assert rows(line_dedup.without_repeats(make(rest), less)) == deduped(rest)
    again = line_dedup.insert(less, make([t for t in texts if t[0] in ids]))
    assert state(again) == state(grown)
    monkeypatch.setattr("evoframe.llm.shards.SHARD_KEYS", 10)
    dealt = line_dedup.insert(built, make(second))
    assert dealt.shards > 2 and state(dealt) == state(grown)


def test_kept_filters_are_taken_up():
    from evoframe.llm.cuckoo import CuckooFilter

    keys = [hashlib.sha256(str(i).encode()).digest()[:16] for i in range(500)]
    made = CuckooFilter(100)
    made.insert([(k, [1, 2, 3]) for k in keys])
    held = CuckooFilter(1)
    held.restore(made.slots.tobytes(), [(k, [1, 2, 3]) for k in keys])
    assert held.maybe(keys).all() and held.delete(keys[:250]) == 250 and held.maybe(keys[250:]).all()
    assert not held.maybe(keys[:250]).all() and functools.reduce(lambda n, k: n + (held.get(k) is not None), keys, 0) == 250
