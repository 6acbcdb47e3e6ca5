"""Molecule graphs from line notation, and what is counted and compared on them.

A small reader turns a structure into arrays of atoms and bonds; everything else is an
expression over those arrays: hydrogens from valences, six-rings by walks, descriptors as
sums, circular fingerprints by rounds of hashing. A structure is one row, so the work is
spread by rows and nothing is shuffled; a table of short structures is dealt over PART_ROWS
first, as many of its rows lie in one part of a file.

Not covered: kekulisation of aromatic systems (an impossible one passes as valid),
stereochemistry (read and left aside), log P, QED, polar surface, refractivity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard atomic weights, atomic number by symbol, usual valences, groups that can be counted.
WEIGHTS = {"H": 1.008, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "As": 74.922, "Se": 78.971, "Br": 79.904, "Sb": 121.76, "Te": 127.6, "I": 126.904, "Bi": 208.98, "Li": 6.94, "Na": 22.99, "K": 39.098, "Mg": 24.305, "Ca": 40.078, "Zn": 65.38, "Al": 26.982, "Fe": 55.845, "Cu": 63.546}
VALENCES = {"H": [1], "B": [3], "C": [4], "N": [3], "O": [2], "F": [1], "Si": [4], "P": [3, 5, 7], "S": [2, 4, 6], "Cl": [1], "Br": [1], "I": [1, 3, 5]}
ELEMENTS = {"carbon": "C", "nitrogen": "N", "oxygen": "O", "fluorine": "F", "phosphorus": "P", "sulfur": "S", "chlorine": "Cl", "bromine": "Br", "iodine": "I", "boron": "B", "silicon": "Si", "selenium": "Se"}
#: One atom outside brackets, one inside, a bond, a ring closure (fixed patterns).
TOKEN = re.compile(r"(?P<atom>Cl|Br|[BCNOPSFI]|[bcnops])|\[(?P<isotope>\d+)?(?P<symbol>[A-Z][a-z]?|se|as|te|[bcnops])(?P<chiral>@{0,2})(?P<h>H\d?)?(?P<charge>\+\d+|-\d+|\++|-+)?(?::\d+)?\]|(?P<bond>[-=#:/\\~])|(?P<ring>%\d\d|\d)|(?P<open>\()|(?P<close>\))|(?P<dot>\.)")
ORDERS = {"-": 1, "=": 2, "#": 3, ":": 4, "/": 1, "\\": 1, "~": 1}
#: Bits of a fingerprint, rounds of hashing, and the similarity that an edited molecule must exceed.
BITS, RADIUS, SIMILAR = 2048, 2, 0.9
#: Structures of a partition.
PART_ROWS = 5000
_ATOM = "struct<symbol:string,aromatic:boolean,charge:int,given:int,near:array<struct<kind:int,to:int>>>"
_BOND = "struct<a:int,b:int,kind:int,ring:boolean>"
GRAPH = f"struct<atoms:array<{_ATOM}>,bonds:array<{_BOND}>,parts:int>"


def _read(text: str | None) -> tuple | None:
    """Atoms (symbol, aromatic, charge, hydrogens given in brackets) and bonds (a, b, kind; 4 is aromatic) of a structure; None if it is malformed."""
    atoms, bonds, stack, open_rings = [], [], [], {}
    last, kind, place, text = None, None, 0, (text or "").strip()
    while place < len(text):
        m = TOKEN.match(text, place)
        if m is None:
            return None
        place, what = m.end(), m.lastgroup
        if m["atom"] or m["symbol"]:
            symbol = (m["atom"] or m["symbol"]).capitalize()
            if symbol not in WEIGHTS:
                return None
            charge = m["charge"] or ""
            charge = 0 if not charge else int(charge) if charge[1:].isdigit() else (1 if charge[0] == "+" else -1) * len(charge)
            given = None if m["atom"] else int(m["h"][1:] or 1) if m["h"] else 0
            aromatic = (m["atom"] or m["symbol"])[0].islower()
            atoms.append((symbol, aromatic, charge, given))
            if last is not None:
                bonds.append((last, len(atoms) - 1, kind or (4 if aromatic and atoms[last][1] else 1)))
            last, kind = len(atoms) - 1, None
        elif what == "bond":
            if last is None or kind is not None:
                return None
            kind = ORDERS[m["bond"]]
        elif what == "ring":
            if last is None:
                return None
            number = int(m["ring"].lstrip("%"))
            if number in open_rings:
                other, before = open_rings.pop(number)
                if other == last or before and kind and before != kind or any({other, last} == {a, b} for a, b, _ in bonds):
                    return None
                bonds.append((other, last, before or kind or (4 if atoms[other][1] and atoms[last][1] else 1)))
            else:
                open_rings[number] = last, kind
            kind = None
        elif what == "open":
            if last is None or kind is not None:
                return None
            stack.append(last)
        elif what == "close":
            if not stack or kind is not None or text[m.start() - 1] == "(":
                return None
            last = stack.pop()
        else:
            if last is None or kind is not None or stack:
                return None
            last = None
    if not atoms or stack or open_rings or kind is not None or last is None:
        return None
    return atoms, bonds


def _ways(n: int, bonds: list[tuple]) -> list[list[tuple[int, int]]]:
    """For each atom its neighbours and the bonds to them, in the order of the bonds."""
    ways: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for i, (a, b, _) in enumerate(bonds):
        ways[a].append((b, i))
        ways[b].append((a, i))
    return ways


def _rings(ways: list[list[tuple[int, int]]], bonds: list[tuple]) -> tuple[list[bool], int]:
    """Whether each bond lies in a ring, and the number of connected parts: a bond outside rings is a bridge of a depth-first walk."""
    n = len(ways)
    seen, low, inside, parts = [-1] * n, [0] * n, [True] * len(bonds), 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        parts, count = parts + 1, 0
        seen[root] = low[root] = 0
        todo = [(root, -1, iter(ways[root]))]
        while todo:
            at, came, more = todo[-1]
            for to, bond in more:
                if bond == came:
                    continue
                if seen[to] >= 0:
                    low[at] = min(low[at], seen[to])
                    continue
                count += 1
                seen[to] = low[to] = count
                todo.append((to, bond, iter(ways[to])))
                break
            else:
                todo.pop()
                if todo:
                    up = todo[-1][0]
                    low[up] = min(low[up], low[at])
                    inside[came] = low[at] <= seen[up]
    return inside, parts


def _arrow(graphs: list[tuple | None]) -> pa.Array:
    """Structures as an array of GRAPH, filled by fields."""
    atoms, bonds, near, parts = [], [], [], []
    ends, bond_ends, near_ends = [0], [0], [0]
    for found in graphs:
        if found is not None:
            ways = _ways(len(found[0]), found[1])
            inside, n = _rings(ways, found[1])
            atoms.extend(found[0])
            bonds.extend((*b, r) for b, r in zip(found[1], inside))
            for way in ways:
                near.extend((found[1][i][2], to) for to, i in way)
                near_ends.append(len(near))
        parts.append(None if found is None else n)
        ends.append(len(atoms))
        bond_ends.append(len(bonds))
    broken = pa.array([found is None for found in graphs], pa.bool_())
    struct = lambda rows, **kinds: pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds.values())], list(kinds))
    lists = lambda at, values, mask=None: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values, mask=mask)
    own = struct(atoms, symbol=pa.string(), aromatic=pa.bool_(), charge=pa.int32(), given=pa.int32())
    whole = pa.StructArray.from_arrays([*own.flatten(), lists(near_ends, struct(near, kind=pa.int32(), to=pa.int32()))], ["symbol", "aromatic", "charge", "given", "near"])
    held = struct(bonds, a=pa.int32(), b=pa.int32(), kind=pa.int32(), ring=pa.bool_())
    return pa.StructArray.from_arrays([lists(ends, whole, broken), lists(bond_ends, held, broken), pa.array(parts, pa.int32())], ["atoms", "bonds", "parts"])


def graph(structure) -> Column:
    """The graph of a line-notation structure by GRAPH; null for null, empty and malformed ones."""

    @F.arrow_udf(GRAPH)
    def read(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield _arrow(list(map(_read, batch.to_pylist())))

    return read(structure)


def _looked_up(table: dict, key: Column, kind: str) -> Column:
    held = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))])
    return F.try_element_at(held, key).cast(kind)


def with_graph(rows: DataFrame, structure: str, into: str = "m") -> DataFrame:
    """rows with ``into``: valid, and of valid structures atoms with their neighbours and hydrogens, bonds and parts.

    Null, empty and malformed structures, and such with an atom of more bonds than its
    element takes, are not valid, and everything counted on them is null.
    """
    # Every step is an expression over the atoms before it alone. A column that a lambda reads is
    # worked out again for each element once the optimizer has merged the projections.
    g = F.col("_g")
    fields = lambda a, *names: [a[n].alias(n) for n in names]
    plain = lambda a: F.aggregate(a["near"], F.lit(0), lambda s, e: s + F.when(e["kind"] == 4, 1).otherwise(e["kind"]))
    bonded = F.transform(g["atoms"], lambda a: F.struct(*fields(a, "symbol", "aromatic", "charge", "given", "near"), plain(a).alias("plain"), _looked_up(VALENCES, a["symbol"], "array<int>").alias("valences")))
    extra = lambda a: F.when(a["given"].isNull() & a["aromatic"] & a["symbol"].isin("C", "N", "B", "P") & F.exists(a["near"], lambda e: e["kind"] == 4) & ~F.exists(a["near"], lambda e: e["kind"] == 2), 1).otherwise(0)
    used = F.transform(bonded, lambda a: F.struct(*fields(a, "symbol", "aromatic", "charge", "given", "near", "plain", "valences"), (a["plain"] + extra(a)).alias("used")))
    enough = lambda a: F.when(a["aromatic"], F.element_at(a["valences"], 1)).otherwise(F.try_element_at(F.filter(a["valences"], lambda v: v >= a["used"]), F.lit(1)))
    implicit = lambda a: F.greatest(F.lit(0), enough(a) - a["used"])
    # A charge moves the largest valence by one each way it can: N+ takes four bonds, O- one.
    most = lambda a: F.array_max(a["valences"]) + F.when(a["symbol"].isin("N", "O", "P", "S"), a["charge"]).otherwise(-F.abs(a["charge"]))
    wrong = lambda a: F.coalesce(a["plain"] + F.coalesce(a["given"], F.lit(0)) > most(a), F.lit(False))

    def whole(atoms: Column) -> Column:
        held = F.transform(atoms, lambda a: F.struct(*fields(a, "symbol", "aromatic", "charge"), F.coalesce(a["given"], implicit(a), F.lit(0)).alias("h"), a["near"].alias("near")))
        valid = F.coalesce(~F.exists(atoms, wrong), F.lit(False))
        return F.struct(valid.alias("valid"), F.when(valid, held).alias("atoms"), F.when(valid, g["bonds"]).alias("bonds"), F.when(valid, g["parts"]).alias("parts"))

    # The one element of an array is worked out once, however often the lambda reads it.
    return rows.withColumn("_g", graph(structure)).withColumn(into, F.get(F.transform(F.array(used), whole), F.lit(0))).drop("_g")


def six_rings(m: Column) -> Column:
    """Rings of six atoms that no shorter way cuts, each once, as atoms in order from the smallest."""
    near = lambda i: F.transform(F.get(m["atoms"], i)["near"], lambda e: e["to"])
    joined = lambda a, b: F.array_contains(near(a), b)
    paths = F.transform(m["atoms"], lambda a, i: F.array(i))
    for _ in range(5):
        paths = F.flatten(F.transform(paths, lambda p: F.transform(F.filter(near(F.element_at(p, -1)), lambda n: (n > F.get(p, F.lit(0))) & ~F.array_contains(p, n)), lambda n: F.concat(p, F.array(n)))))
    at = lambda p, k: F.get(p, F.lit(k % 6))

    def whole(p: Column) -> Column:
        closed = (at(p, 1) < at(p, 5)) & joined(at(p, 5), at(p, 0))
        for k in range(6):
            closed = closed & ~joined(at(p, k), at(p, k + 2))
        for k in range(3):
            closed = closed & ~joined(at(p, k), at(p, k + 3)) & ~F.arrays_overlap(near(at(p, k)), near(at(p, k + 3)))
        return closed

    return F.filter(paths, whole)


def benzene_atoms(m: Column) -> Column:
    """Aromatic atoms that lie in a ring of six; atoms are counted, not rings."""
    inside = F.array_distinct(F.flatten(six_rings(m)))
    return F.size(F.filter(inside, lambda i: F.get(m["atoms"], i)["aromatic"]))


def _count(m: Column, which) -> Column:
    return F.when(m["valid"], F.size(F.filter(m["atoms"], which)))


def hydrogens(m: Column) -> Column:
    """Hydrogens that are no atoms of their own, and those that are."""
    return F.when(m["valid"], F.aggregate(m["atoms"], F.lit(0), lambda s, a: s + a["h"] + F.when(a["symbol"] == "H", 1).otherwise(0)))


def group_count(m: Column, group: str) -> Column:
    """Atoms of an element, atoms of benzene rings, hydrogens, or a descriptor by name; null for others and for invalid structures."""
    group = "benzene_ring" if group == "benzene" else group
    if group in ELEMENTS:
        return _count(m, lambda a: a["symbol"] == ELEMENTS[group])
    if group == "benzene_ring":
        return F.when(m["valid"], benzene_atoms(m))
    return hydrogens(m) if group == "hydrogen" else F.lit(None).cast("int")


def descriptors(m: Column) -> dict[str, Column]:
    """weight, HBD, HBA, rot_bonds and ring_count of a graph.

    HBD: N, O and S with a hydrogen. HBA: N and O without a positive charge, but no
    aromatic N that holds a hydrogen or three bonds. rot_bonds: single bonds outside rings
    between atoms that both have another neighbour and no triple bond. ring_count:
    independent rings.
    """
    mass = F.aggregate(m["atoms"], F.lit(0.0), lambda s, a: s + _looked_up(WEIGHTS, a["symbol"], "double") + a["h"] * F.lit(WEIGHTS["H"]))
    aromatic = lambda a: a["aromatic"] & (a["symbol"] == "N") & ((a["h"] > 0) | (F.size(a["near"]) == 3))
    inner = lambda i: (F.size(F.get(m["atoms"], i)["near"]) > 1) & ~F.exists(F.get(m["atoms"], i)["near"], lambda e: e["kind"] == 3)
    turns = F.size(F.filter(m["bonds"], lambda b: (b["kind"] == 1) & ~b["ring"] & inner(b["a"]) & inner(b["b"])))
    return {
        "weight": F.when(m["valid"], F.round(mass, 3)),
        "HBD": _count(m, lambda a: a["symbol"].isin("N", "O", "S") & (a["h"] > 0)),
        "HBA": _count(m, lambda a: a["symbol"].isin("N", "O") & (a["charge"] <= 0) & ~aromatic(a)),
        "rot_bonds": F.when(m["valid"], turns),
        "ring_count": F.when(m["valid"], F.size(m["bonds"]) - F.size(m["atoms"]) + m["parts"]),
    }


def with_fingerprint(rows: DataFrame, m: str = "m", into: str = "bits", radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """rows with the set bits of a circular fingerprint: every atom's surroundings of 0 to ``radius`` bonds, hashed.

    The hashing is this library's own, so bits differ from those of others; equal graphs
    have equal bits, however they are written. Invalid structures have null.
    """
    g = F.col(m)
    own = lambda a: F.xxhash64(a["symbol"], a["aromatic"], a["charge"], a["h"], F.size(a["near"]), F.array_sort(F.transform(a["near"], lambda e: e["kind"])))
    out = rows.withColumn("_r0", F.transform(g["atoms"], own))
    for r in range(1, radius + 1):
        before, turn = F.col(f"_r{r - 1}"), F.lit(r)

        def grown(a: Column, i: Column) -> Column:
            around = F.transform(a["near"], lambda e: F.struct(e["kind"].alias("kind"), F.get(before, e["to"]).alias("held")))
            return F.xxhash64(turn, F.get(before, i), F.array_sort(around))

        out = out.withColumn(f"_r{r}", F.transform(g["atoms"], grown))
    every = F.flatten(F.array(*[F.col(f"_r{r}") for r in range(radius + 1)]))
    return out.withColumn(into, F.array_sort(F.array_distinct(F.transform(every, lambda x: F.pmod(x, F.lit(bits)).cast("int"))))).drop(*[f"_r{r}" for r in range(radius + 1)])


def tanimoto(a: Column, b: Column) -> Column:
    """Shared bits over all bits of two fingerprints; 0 where one is missing or both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def edited(rows: DataFrame, source: str, prediction: str, truth: str, added: str | None = None, removed: str | None = None, strict: bool = False) -> DataFrame:
    """rows with valid, edit_valid, similarity and exact_match of an edited molecule.

    An edit is valid if the prediction has one of ``added`` more than the source and one of
    ``removed`` less, as far as they are named. It is right if it is valid and more than
    SIMILAR like the truth, in strict mode if it is written as the truth. Groups that
    cannot be counted make no valid edit; nothing holds of an invalid prediction.
    """
    out = rows
    for side, name in (("_s", source), ("_p", prediction), ("_t", truth)):
        out = with_graph(out, name, side)
    out = with_fingerprint(with_fingerprint(out, "_p", "_pb"), "_t", "_tb")
    checks = [group_count(F.col("_p"), g) == group_count(F.col("_s"), g) + d for g, d in ((added, 1), (removed, -1)) if g is not None]
    met = F.lit(bool(checks))
    for check in checks:
        met = met & F.coalesce(check, F.lit(False))
    valid = F.col("_p.valid")
    out = out.withColumn("valid", valid).withColumn("edit_valid", valid & met).withColumn("similarity", F.when(valid, F.round(tanimoto(F.col("_pb"), F.col("_tb")), 6)).otherwise(0.0))
    right = F.col(prediction) == F.col(truth) if strict else F.col("edit_valid") & (F.col("similarity") > SIMILAR)
    return out.withColumn("exact_match", valid & F.coalesce(right, F.lit(False))).drop("_s", "_p", "_t", "_pb", "_tb")
