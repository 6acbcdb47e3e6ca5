"""Conversation structure repair by signature deduplication.

A conversation's rows, in order, become one character each: the initial of the role
and the fault of the row. Every distinct signature is solved once for its cheapest
edits, by a recursion from its end that is memoised on (row, state of the rest); the
audits are joined back and replayed over the texts, which are streamed in order.

The states of a sequence that is to read (s?(ua)+)? are 0 begin, 1 after a leading s,
2 after u, 3 after a; it may end in 0 and 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.llm.common import SPACES, meet
from evoframe.session import cut

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Codes of rows by class of role (s, u, a, other) without fault and by fault.
CLASSES = "suao"
FAULTS = {"": "suao", "truncated": "SUAO", "blank": "0123", "duplicate": "4567"}
ROLES = ("system", "user", "assistant")
#: Role that an inserted or reroled row takes in each state, and the state after it.
NEXT = (2, 2, 3, 2)
GIVEN = ("user", "user", "assistant", "user")
#: State after a kept row of class s, u, a in each state.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FAR = 1 << 30
_ORDER = {"": -1, "D": 0, "I": 1, "K": 2, "R": 3}
_SPACE_CLASS = r"[\x20\x09-\x0D]"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, alive: rows after the damage that crc32 of ``conv_id:turn`` picks by its remainder of 20.

    0 drops the row (it stays here with ``alive`` false, for its conversation), 1
    empties its text, 2 removes ``.!?`` from it, 3 repeats it, 4 makes the role user. A
    null is one space: in the key, as role and as text; conv_id and turn stay null in
    their columns. Other columns are ignored, an empty table gives an empty result.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("alive"), copies.alias("copy")).drop("copy")


def _row_digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _code(again: Column) -> Column:
    """The character of a row; ``again`` says that an equal row stands before it."""
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    kind = F.when(last == "", FAULTS["blank"]).when(again, FAULTS["duplicate"]).when(~last.isin(".", "!", "?"), FAULTS["truncated"]).otherwise(FAULTS[""])
    return F.substring(kind, place, F.lit(1))


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps: one row per conversation of ``rows`` as damaged() gives them.

    Rows stand by turn, nulls first; rows of one turn by role and SHA-256 of role and
    text, equal rows are interchangeable. Only narrow rows are shuffled, by conv_id, and
    sorted there with spill; a conversation is streamed and takes one byte a row. Repeats are
    found before, by conversation and digest.
    """
    narrow = rows.select("conv_id", "turn", "role", F.when(F.col("alive"), _row_digest()).alias("digest"), F.when(F.col("alive"), _code(F.lit(False))).alias("first"), F.when(F.col("alive"), _code(F.lit(True))).alias("again"))
    narrow = narrow.repartition("conv_id", "digest").sortWithinPartitions("conv_id", "digest", "turn").mapInArrow(_repeats, "conv_id long, turn long, role string, digest binary, code string")
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    return ordered.select("conv_id", "turn", "code").mapInArrow(_signed, "conv_id long, signature string, gaps long")


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and digest: those after the first of a digest take the code of a repeat."""
    last = None
    for batch in batches:
        codes = []
        for conv, digest, first, again in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "first", "again"))):
            codes.append(again if (conv, digest) == last else first)
            last = (conv, digest)
        columns = [batch.column(c) for c in ("conv_id", "turn", "role", "digest")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(codes, pa.string())], ["conv_id", "turn", "role", "digest", "code"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn: the codes of each as one string, and the turns missing in between."""
    now: object = _signed  # no conversation yet
    text, low, high, turns = bytearray(), None, None, 0
    out: list[tuple] = []

    def closed() -> tuple:
        return now, text.decode(), 0 if low is None else high - low + 1 - turns

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64()))], ["conv_id", "signature", "gaps"])

    for batch in batches:
        for conv, turn, code in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "code"))):
            if conv != now:
                if now is not _signed:
                    out.append(closed())
                now, text, low, high, turns = conv, bytearray(), None, None, 0
            if code is None:
                continue
            text += code.encode()
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
        if out:
            yield batch_of()
            out = []
    if now is not _signed:
        out.append(closed())
        yield batch_of()


def _step(code: str | None, rest: tuple) -> tuple:
    """One row before ``rest``: (rest with it, cost it adds to all, what each state does).

    A rest is the cost and the rank, among each other in ASCII order, of the cheapest audit
    from each state. What a state does is (states in which a row is inserted first, edit).
    """
    costs, ranks = rest
    found = []  # without a row inserted first: cost, (edit, rank of the audit after it)
    for state in range(4):
        if code is None:
            found.append((0 if state in (0, 3) else FAR, ("", 0)))
            continue
        fault = next(f for f, codes in FAULTS.items() if code in codes)
        role = CLASSES[FAULTS[fault].index(code)]
        ways = [(costs[state] + DELETE, ("D", ranks[state]))]
        if fault in ("", "truncated"):
            stays = TRUNCATED if fault else 0
            if role in AFTER[state]:
                after = AFTER[state][role]
                ways.append((costs[after] + stays, ("K", ranks[after])))
            after = NEXT[state]
            ways.append((costs[after] + stays + REROLE, ("R", ranks[after])))
        found.append(min(ways, key=lambda w: (w[0], _ORDER[w[1][0]], w[1][1])))
    best = []
    for state in range(4):
        ways, at = [], state
        for inserted in range(3):  # two in a row close a pair; more never pay
            cost, (edit, rank) = found[at]
            ways.append((cost + INSERT * inserted, (1,) * inserted + (_ORDER[edit], rank), inserted, edit))
            at = NEXT[at]
        best.append(min(ways))
    least = min(b[0] for b in best)
    places = {audit: i for i, audit in enumerate(sorted({b[1] for b in best}))}
    after = tuple(min(b[0] - least, FAR) for b in best), tuple(places[b[1]] for b in best)
    return after, least, tuple((b[2], b[3]) for b in best)


class Solver:
    """Cheapest edits of signatures; steps are remembered over all of them, and there are few."""

    def __init__(self) -> None:
        self.steps: dict[tuple, tuple] = {}

    def _solved(self, code: str | None, rest: tuple) -> tuple:
        key = code, rest
        if key not in self.steps:
            self.steps[key] = _step(code, rest)
        return self.steps[key]

    def solve(self, signature: str) -> tuple[int, str]:
        """Cost and audit; time and memory are linear in the signature."""
        rest, cost, does = self._solved(None, ((0,) * 4, (0,) * 4))
        done = [does]
        for code in reversed(signature):
            rest, more, does = self._solved(code, rest)
            cost += more
            done.append(does)
        state, audit = 0, []
        total = cost + rest[0][0]
        for i, does in enumerate(reversed(done)):
            inserted, edit = does[state]
            for _ in range(inserted):
                audit.append("I")
                state = NEXT[state]
            if edit == "K":
                code = signature[i]
                state = AFTER[state][CLASSES[next(c for c in FAULTS.values() if code in c).index(code)]]
            elif edit == "R":
                state = NEXT[state]
            audit.append(edit)
        return total, "".join(audit)


_SOLVED_SCHEMA = "signature string, n long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    solver = Solver()
    role_of = {code: role for codes in FAULTS.values() for code, role in zip(codes, CLASSES)}
    for batch in batches:
        rows = []
        for signature, n in zip(batch.signature, batch.n):
            faults = [sum(map(signature.count, FAULTS[f])) for f in ("blank", "duplicate", "truncated")]
            roles = "".join(map(role_of.get, signature))
            illegal = sum(pair not in (("s", "u"), ("u", "a"), ("a", "u")) for pair in zip(roles, roles[1:]))
            rows.append((signature, n, *faults, illegal, *solver.solve(signature)))
        yield pd.DataFrame(rows, columns=["signature", "n", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def audits(signed: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: each distinct signature solved once and joined back."""
    distinct = signed.groupBy("signature").agg(F.count("*").alias("n"))
    solved = cut(distinct.mapInPandas(_solved, _SOLVED_SCHEMA))
    return meet(signed, solved, ["signature"], ["conv_id"]).drop("signature", "n")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of each conversation, its audit before them: the edited rows, in order.

    ``part`` is 0 for the audit, 1 for rows; an insertion after the last row follows when
    the conversation ends.
    """
    names = ["conv_id", "place", "edit", "turn", "role", "text"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    conv, audit, at, state, place = None, "", 0, 0, 0
    out: list[tuple] = []

    def inserted() -> None:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            out.append((conv, place, "I", None, GIVEN[state], ""))
            at, state, place = at + 1, NEXT[state], place + 1

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    for batch in batches:
        for part, key, given, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("part", "conv_id", "audit", "turn", "role", "text"))):
            if part == 0:
                inserted()
                conv, audit, at, state, place = key, given, 0, 0, 0
                continue
            inserted()
            edit = audit[at]
            at += 1
            if edit == "K":
                state = AFTER[state][role[:1]]
            elif edit == "R":
                role, state = GIVEN[state], NEXT[state]
            if edit != "D":
                out.append((conv, place, edit, turn, role, text))
                place += 1
        if out:
            yield batch_of()
            out = []
    inserted()
    if out:
        yield batch_of()


def _sorted_with_audits(rows: DataFrame, audited: DataFrame) -> DataFrame:
    texts = rows.where("alive").select(F.lit(1).alias("part"), "conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("audit"), _row_digest().alias("digest"))
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    heads = audited.select(F.lit(0).alias("part"), "conv_id", none("long", "turn"), none("string", "role"), none("string", "text"), "audit", none("binary", "digest"))
    return texts.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest")


def replay(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id, place, edit, turn, role, text: the repaired conversations, a row a message, places from 0."""
    schema = "conv_id long, place long, edit string, turn long, role string, text string"
    return _sorted_with_audits(rows, audited).drop("digest").mapInArrow(_replayed, schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text``, joined by newlines, from rows that come in order."""
    now: object = _hashed  # no conversation yet
    digest = hashlib.sha256()
    for batch in batches:
        out: list[tuple] = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if conv == now:
                digest.update(b"\n")
            else:
                if now is not _hashed:
                    out.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256()
            digest.update(f"{role}:{text}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string()))], ["hashed_id", "repaired_sha256"])
    if now is not _hashed:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["hashed_id", "repaired_sha256"])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The audits (a row a conversation) and the repaired messages of ``rows``, which are as damaged() gives them.

    Edits: K keep; R rerole to user or assistant, 1; D delete, 2, required of blank rows
    and of rows whose role and text were seen before; I insert an empty user or assistant
    row, 5; a truncated row that stays adds 5. The result's role initials read
    (s?(ua)+)? ; of equally cheap audits the ASCII-least is taken. A conversation
    without rows has an empty audit and no messages; null conv_ids are one conversation;
    rows of one turn, repeated or not, stand by role and SHA-256. Roles are judged by
    their first character; an empty role is as one that is neither s, u nor a. The hash
    of a conversation needs its texts one after another, so they pass one task, sorted
    with spill and streamed.
    """
    audited = cut(audits(cut(signatures(rows))))
    return audited, replay(rows, audited)


def digests(repaired: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The audits with repaired_sha256, the hash of the repaired ``role:text``, newline-joined."""
    audited, messages = repaired
    hashed = messages.select("conv_id", "role", "text").mapInArrow(_hashed, "hashed_id long, repaired_sha256 string")
    joined = audited.join(hashed, audited["conv_id"].eqNullSafe(hashed["hashed_id"]), "left").drop("hashed_id")
    empty = hashlib.sha256(b"").hexdigest()
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(empty)))
