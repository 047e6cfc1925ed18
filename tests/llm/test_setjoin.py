import random

import pytest
from pyspark.sql import functions as F

from spectraloom.llm import setjoin
from spectraloom.llm.residues import pieces, residues
from spectraloom.llm.setjoin import similar_sets

SCHEMA = "id long, set array<string>, cell string"


def brute(left, right, t):
    return {(a, b) for a, x, _ in left for b, y, _ in right if x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= t}


@pytest.mark.parametrize("t,pivots,rare,broadcast", [(0.5, 8, 8, 100), (0.8, 8, 0, 0), (0.3, 2, 3, 0), (0.5, 0, 0, 100), (0.5, 0, 1000, 0), (1.0, 4, 2, 0)])
def test_against_brute_force(spark, monkeypatch, t, pivots, rare, broadcast):
    monkeypatch.setattr(setjoin, "BLOCK", 20)
    monkeypatch.setattr(setjoin, "SLICE", 7)
    monkeypatch.setattr(setjoin, "RARE", rare)
    monkeypatch.setattr(setjoin, "MAX_BROADCAST_VALUES", broadcast)
    monkeypatch.setattr(setjoin, "PAIRWISE_SIZE", 12)
    rng = random.Random(3)
    family = [f"f{n}" for n in range(20)]
    right = []
    for n in range(160):
        kind = n % 4
        base = family if kind == 0 else [f"v{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 3, 6, 14, 30]))]
        own = {v if rng.random() > 0.1 else f"w{rng.randrange(9)}" for v in base}
        right.append((n, sorted(own), "x"))
    right += [(900, [], "x"), (901, None, "x")]
    left = [(1000 + a, s, c) for a, s, c in right[::2]]
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    found = similar_sets(make(left), make(right), t, pivots=pivots).collect()
    assert len(found) == len({(r.a, r.b) for r in found})
    assert {(r.a, r.b) for r in found} == brute(left, right, t)
    # The same sets on both sides: each pair once, the smaller set first.
    once = similar_sets(make(right), make(right), t, pivots=pivots, symmetric=True).collect()
    size = {n: len(s or []) for n, s, _ in right}
    assert sorted((r.a, r.b) for r in once) == sorted((a, b) for a, b in brute(right, right, t) if (size[a], a) <= (size[b], b))


def test_pivots_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "PIVOT_VALUES", 10)
    rows = spark.createDataFrame([(n, [f"v{n}-{k}" for k in range(4)]) for n in range(9)] + [(99, [f"w{k}" for k in range(11)])], "id long, set array<string>")
    assert [len(p) for p in setjoin.first_pivots(rows, 8)] == [4, 4]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, ["a"], "x")], SCHEMA)
    assert similar_sets(none, none, 0.5).count() == similar_sets(one, none, 0.5).count() == similar_sets(none, one, 0.5).count() == 0


def test_residues_and_pieces(spark):
    cases = {"K.PEP*TIDE.R": "PEPTIDE", " -.pep.R\t": "PEP", "PEPTIDE": "PEPTIDE", "AB.PEP.R": "ABPEPR", "": "", None: None, "A.B": "AB"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", residues(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == cases
    made = spark.createDataFrame([("ABABA",), ("AB",), (None,)], "t string").select(pieces(F.col("t"), 3).alias("p")).collect()
    assert [sorted(r.p) for r in made] == [["ABA", "BAB"], [], []]
