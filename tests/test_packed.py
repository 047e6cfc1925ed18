import pytest

from spectraloom.functions.segment import automaton, segment
from spectraloom.operators import packed
from spectraloom.operators.packed import split_packed, with_values

LONG = "x,a b,c d,e f,g h,i j,k l,m n,o p,q"
KNOWN = ["sp|P1|A", "sp|P2|B", "sp|P3|3'X", "odd; one", LONG, "actin (fragment)", "(odd) start"]
CASES = [
    (None, []),
    ("", []),
    (" ;, / ", []),
    ("sp|P1|A", ["sp|P1|A"]),
    ("sp|P1|A;sp|P2|B", ["sp|P1|A", "sp|P2|B"]),
    (";sp|P1|A,,sp|P2|B;", ["sp|P1|A", "sp|P2|B"]),
    ("sp|P1|A||sp|P2|B", ["sp|P1|A", "sp|P2|B"]),
    ("[sp|P1|A / new_1]", ["sp|P1|A", "new_1"]),
    ('"sp|P1|A; isoform 2",sp|P2|B', ["sp|P1|A; isoform 2", "sp|P2|B"]),
    ('"sp|P1|A ""x"" variant, 4"', ['sp|P1|A "x" variant, 4']),
    ("'sp|P1|A, chain 2' sp|P3|3'X", ["sp|P1|A, chain 2", "sp|P3|3'X"]),
    (r"sp|P1|A\;x sp|P2|B", ["sp|P1|A;x", "sp|P2|B"]),
    ('sp|P1|A ,"sp|P2|B', ["sp|P1|A", "sp|P2|B"]),
    ("'sp|P1|A, 'sp|P2|B'", ["sp|P1|A", "sp|P2|B"]),
    ("sp|P1|A, odd; one", ["sp|P1|A", "odd; one"]),
    ("sp|P1|A;sp|P1|A", ["sp|P1|A", "sp|P1|A"]),
    (f"sp|P1|A;{LONG};sp|P2|B", ["sp|P1|A", LONG, "sp|P2|B"]),
    ("new_1;actin (fragment), (odd) start", ["new_1", "actin (fragment)", "(odd) start"]),
    ("actin (fragment);actin", ["actin (fragment)", "actin"]),
]


@pytest.mark.parametrize("field,expected", CASES)
def test_segment(field, expected):
    assert segment(field, automaton(KNOWN)) == expected


def test_long_field_stays_linear_enough():
    field = ";".join(f"id_{n}" for n in range(20_000))
    assert len(segment(field, automaton(KNOWN))) == 20_000


def rows(spark):
    return spark.createDataFrame([(n, field, "x", 9) for n, (field, _) in enumerate(CASES)], "id long, Protein string, values string, pos int")


@pytest.mark.parametrize("bound,block", [(1000, 9), (2, 1000), (1, 3), (0, 9)])
def test_split_both_ways(spark, monkeypatch, bound, block):
    monkeypatch.setattr(packed, "BLOCK_FIELDS", block)
    known = spark.createDataFrame([(k,) for k in KNOWN] + [(None,), ("",)], "protein_id string")
    got = split_packed(rows(spark), "Protein", known, "protein_id", keep=["id"], max_broadcast=bound).collect()
    want = sorted((n, k + 1, v) for n, (_, values) in enumerate(CASES) for k, v in enumerate(values))
    assert sorted((r.id, r.pos, r.value) for r in got) == want


def test_empty_tables_and_clashing_names(spark):
    known = spark.createDataFrame([], "protein_id string")
    assert with_values(rows(spark).limit(0), "Protein", known, "protein_id").count() == 0
    got = with_values(rows(spark), "Protein", known, "protein_id", out="values")
    assert got.columns == ["id", "Protein", "values", "pos"]
    assert {r.id: r["values"] for r in got.collect()}[4] == ["sp|P1|A", "sp|P2|B"]


def test_pre_filter_is_necessary_only(spark):
    known = spark.createDataFrame([(k,) for k in KNOWN], "protein_id string")
    got = split_packed(rows(spark), "Protein", known, "protein_id", keep=["id"], least=2)
    assert {r.id for r in got.select("id").distinct().collect()} == {n for n, (_, values) in enumerate(CASES) if len(values) > 1}
