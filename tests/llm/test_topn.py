import math
import random

import pytest

from spectraloom.llm.topn import top_n

SCHEMA = "grp long, score double, ident long, rank_no string, c int"


def brute(rows, n, ascending=True):
    groups = {}
    for g, s, i, *_ in rows:
        if g is not None and s is not None and not math.isnan(s) and i is not None:
            groups.setdefault(g, set()).add((s if ascending else -s, i))
    return {(g, k + 1, i) for g, own in groups.items() for k, (_, i) in enumerate(sorted(own)[:n])}


@pytest.mark.parametrize("ascending", [True, False])
def test_against_brute_force(spark, ascending):
    rng = random.Random(5)
    values = [0.0, -0.0, 1e-300, 5e-20, 5e-20, 1.0, -3.5, math.inf, -math.inf, math.nan, None]
    rows = [(rng.choice([1, 1, 1, 2, 3, None, rng.randrange(50)]), rng.choice([*values, rng.random(), 10 ** rng.uniform(-20, 0)]), n, "x", 1) for n in range(4000)]
    rows += rows[:50] + [(1, 0.5, None, "x", 1)]
    got = {tuple(r) for r in top_n(spark.createDataFrame(rows, SCHEMA), "grp", "score", "ident", 3, ascending).collect()}
    assert got == brute(rows, 3, ascending)


def test_one_hot_group_of_equal_scores(spark):
    rows = [(7, 1e-9, n * 13 % 5003, "x", 1) for n in range(5003)]
    got = {tuple(r) for r in top_n(spark.createDataFrame(rows, SCHEMA), "grp", "score", "ident", 3).collect()}
    assert got == {(7, 1, 0), (7, 2, 1), (7, 3, 2)}


def test_empty_table(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), "grp", "score", "ident", 3).collect() == []
