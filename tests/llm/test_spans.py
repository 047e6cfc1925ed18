import random

import pytest

from spectraloom.llm.spans import shared_spans, super_kmers

SCHEMA = "id long, seq string, text string, start int"


def test_super_kmers_cover_every_window_once():
    rng = random.Random(1)
    for length in (0, 15, 16, 17, 90, 1000):
        text = "".join(rng.choice("ACDE") for _ in range(length))
        found = [(start + n, packed[n : n + 16]) for _, start, packed in super_kmers(text, 16, 7) for n in range(len(packed) - 15)]
        assert found == [(n, text[n : n + 16]) for n in range(length - 15)]
        assert all(mini in packed for mini, _, packed in super_kmers(text, 16, 7))


def brute(rows, k, both):
    texts = {(i, s) for i, s, *_ in rows if i is not None and s}
    out = set()
    for i, s in texts:
        others = [t for j, u in texts if j != i for t in ([u, u[::-1]] if both else [u])]
        shared = [False] * len(s)
        for at in range(len(s) - k + 1):
            if any(s[at : at + k] in t for t in others):
                shared[at : at + k] = [True] * k
        start = None
        for at, flag in enumerate([*shared, False]):
            if flag and start is None:
                start = at
            if not flag and start is not None:
                out.add((i, start + 1, at))
                start = None
    return out


@pytest.mark.parametrize("both,max_strings", [(True, 50_000), (False, 50_000), (True, 1)])
def test_against_brute_force(spark, both, max_strings):
    rng = random.Random(2)
    pool = ["".join(rng.choice("ACD") for _ in range(40)) for _ in range(6)]
    rows = []
    for n in range(80):
        a, b = rng.choice(pool), rng.choice(pool)
        text = a[rng.randrange(20) :] + "".join(rng.choice("EFGH") for _ in range(rng.randrange(12))) + b[: rng.randrange(40)]
        rows.append((n, text[::-1] if n % 5 == 0 else text, "x", 1))
    rows += [(200, rows[0][1], "x", 1), (201, "ABCDEFGHIKLMNOP" * 3, "x", 1), (201, "ABCDEFGHIKLMNOP" * 3, "x", 1), (202, None, "x", 1), (203, "", "x", 1), (None, rows[1][1], "x", 1), (204, "XYZ" * 3000, "x", 1)]
    got = shared_spans(spark.createDataFrame(rows, SCHEMA), "id", "seq", 12, m=5, both_ways=both, max_strings=max_strings, bucket_windows=100).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(rows, 12, both))


def test_own_reverse_and_empty(spark):
    palindrome = "ACDEFGHIKLMMLKIHGFEDCA"
    assert shared_spans(spark.createDataFrame([(1, palindrome, "x", 1)], SCHEMA), "id", "seq", 16, both_ways=True).count() == 0
    assert shared_spans(spark.createDataFrame([], SCHEMA), "id", "seq", 16).count() == 0
