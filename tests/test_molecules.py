"""Molecule graphs against hand-counted structures."""

import pytest
from pyspark.sql import functions as F

from evoframe.operators import molecules as M

#: structure: hydrogens, benzene atoms, rings, rotatable bonds, donors, acceptors, weight
KNOWN = {
    "C": (4, 0, 0, 0, 0, 0, 16.043),
    "CCO": (6, 0, 0, 0, 1, 1, 46.069),
    "CC(=O)O": (4, 0, 0, 0, 1, 2, 60.052),
    "c1ccccc1": (6, 6, 1, 0, 0, 0, 78.114),
    "C1=CC=CC=C1": (6, 0, 1, 0, 0, 0, 78.114),
    "Cc1ccccc1CC": (12, 6, 1, 1, 0, 0, 120.195),
    "c1ccc2ccccc2c1": (8, 10, 2, 0, 0, 0, 128.174),
    "c1ccncc1": (5, 6, 1, 0, 0, 1, 79.102),
    "c1cc[nH]c1": (5, 0, 1, 0, 1, 0, 67.091),
    "c1ccc2[nH]ccc2c1": (7, 6, 2, 0, 1, 0, 117.151),
    "Cn1cnc2c1c(=O)n(C)c(=O)n2C": (10, 6, 2, 0, 0, 3, 194.194),
    "CC(=O)Oc1ccccc1C(=O)O": (8, 6, 1, 3, 1, 4, 180.159),
    "C1CCC2CCC1C2": (14, 0, 2, 0, 0, 0, 110.2),
    "[NH4+].[Cl-]": (4, 0, 0, 0, 1, 0, 53.489),
    "C#N": (1, 0, 0, 0, 0, 1, 27.026),
    "OS(=O)(=O)O": (2, 0, 0, 0, 2, 4, 98.072),
    "FC(Cl)(Br)I": (0, 0, 0, 0, 0, 0, 12.011 + 18.998 + 35.45 + 79.904 + 126.904),
    "C[C@@H](N)C(=O)O": (7, 0, 0, 1, 2, 3, 89.094),
    "[H]O[H]": (2, 0, 0, 0, 0, 1, 18.015),
    "C%12CCCCC%12": (12, 0, 1, 0, 0, 0, 84.162),
    "c1ccc(cc1)-c1ccccc1": (10, 12, 2, 1, 0, 0, 154.212),
}
BROKEN = [None, "", "  ", "C(", "C)", "C1CC", "CX", "C==C", "[C", "C()", "=C", "C(=O)(=O)(=O)C", "CC(C)(C)(C)C", "F=C", "C.", "hello world", "C11", "1CC1"]


@pytest.fixture(scope="module")
def made(spark):
    rows = [(i, s) for i, s in enumerate([*KNOWN, *BROKEN])]
    frame = M.with_graph(spark.createDataFrame(rows, "id int, structure string"), "structure")
    m = F.col("m")
    return {r.structure if r.structure in KNOWN else r.id: r for r in frame.select("id", "structure", m["valid"].alias("valid"), M.group_count(m, "hydrogen").alias("h"), M.group_count(m, "benzene").alias("b"), M.group_count(m, "carbon").alias("c"), M.group_count(m, "tellurium").alias("unknown"), *[c.alias(n) for n, c in M.descriptors(m).items()]).collect()}


def test_known_molecules(made):
    for structure, (h, benzene, rings, turns, donors, acceptors, weight) in KNOWN.items():
        r = made[structure]
        assert r.valid and (r.h, r.b, r.ring_count, r.rot_bonds, r.HBD, r.HBA) == (h, benzene, rings, turns, donors, acceptors), (structure, r)
        assert r.weight == pytest.approx(weight, abs=0.02) and r.unknown is None


def test_broken_structures(made):
    for i, structure in enumerate(BROKEN, len(KNOWN)):
        r = made[i]
        assert not r.valid and {r.h, r.b, r.c, r.weight, r.HBD, r.ring_count} == {None}, structure


def surroundings(structure, radius=2):
    """The hash-free form of a fingerprint: every atom's surroundings as nested tuples."""
    atoms, bonds = M._read(structure)
    near = [[(k, b if a == i else a) for a, b, k in bonds if i in (a, b)] for i in range(len(atoms))]
    now = [(atoms[i], len(near[i]), tuple(sorted(k for k, _ in near[i]))) for i in range(len(atoms))]
    out = set(map(repr, now))
    for _ in range(radius):
        now = [(now[i], tuple(sorted((k, repr(now[to])) for k, to in near[i]))) for i in range(len(atoms))]
        out |= set(map(repr, now))
    return out


def test_fingerprints(spark):
    pairs = [("CCO", "OCC"), ("CC(=O)Oc1ccccc1C(=O)O", "OC(=O)c1ccccc1OC(C)=O"), ("CCO", "CCN"), ("CCCCCCO", "CCCCCCCO"), ("c1ccccc1C", "Cc1ccccc1"), ("C", "O"), ("CCO", "broken(")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    for side in "ab":
        frame = M.with_fingerprint(M.with_graph(frame, side, f"m{side}"), f"m{side}", f"f{side}")
    got = {(r.a, r.b): r for r in frame.select("a", "b", "fa", "fb", M.tanimoto(F.col("fa"), F.col("fb")).alias("t")).collect()}
    for a, b in pairs[:-1]:
        x, y, r = surroundings(a), surroundings(b), got[a, b]
        assert len(r.fa) == len(x) and len(r.fb) == len(y)  # no two hashes meet in these
        assert r.t == pytest.approx(len(x & y) / len(x | y)), (a, b)
    assert got["CCO", "OCC"].t == 1.0 and got["CCO", "broken("].t == 0.0 and got["C", "O"].t == 0.0


def test_edits(spark):
    rows = [("CCO", "CCOCl", "ClOCC"), ("CCO", "CCO", "CCOCl"), ("CCO", "CC(O", "CCOCl"), ("CCO", "CCCl", "CCCl")]
    frame = spark.createDataFrame(rows, "source string, said string, truth string")
    got = M.edited(frame, "source", "said", "truth", added="chlorine").collect()
    assert [(r.valid, r.edit_valid, r.similarity == 1.0, r.exact_match) for r in got] == [(True, True, True, True), (True, False, False, False), (False, False, False, False), (True, True, True, True)]
    swapped = M.edited(frame, "source", "said", "truth", added="chlorine", removed="oxygen", strict=True).collect()
    assert [(r.edit_valid, r.exact_match) for r in swapped] == [(False, False)] * 3 + [(True, True)]
    assert not any(r.edit_valid for r in M.edited(frame, "source", "said", "truth", added="nonsense").collect())


def test_each_column_is_worked_out_once(spark):
    """No lambda holds a column of a lower projection, which would be worked out anew for each atom."""
    frame = spark.createDataFrame([("CCO", "CCOCl", "ClOCC")], "source string, said string, truth string")
    plan = M.edited(frame, "source", "said", "truth", added="chlorine")._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten(transform(_g" not in plan and "flatten(transform(pythonUDF" not in plan


def test_structures_are_dealt_over_partitions(spark):
    from evoframe.session import spread

    rows = spark.range(1000, numPartitions=1)
    assert spread(rows, 100).rdd.getNumPartitions() == 10 and spread(rows, 1000).rdd.getNumPartitions() == 1
    assert spread(rows, 100).agg(F.sum("id")).first()[0] == 499500
