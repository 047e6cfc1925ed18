import random

import numpy as np
import pytest

from spectraloom.llm import leakage
from spectraloom.llm.leakage import leaks, words

DOC, ITEM = "doc_id long, text string, start int, id string", "item_id long, passage string, h int"


def test_words():
    assert words("<p class=x>Été&nbsp;im&#8203;mer</p> Straße_2 <b>ＡＢ</b>") == ["ete", "immer", "strasse", "2", "ab"]
    assert words("a < b > c") == ["a", "b", "c"] and words("") == []


def brute(docs, items):
    out = set()
    for d, text, *_ in docs:
        own = words(text) if d is not None and text is not None else []
        held = {tuple(own[k : k + 10]) for k in range(len(own) - 9)}
        for i, passage, _ in items:
            w = words(passage) if i is not None and passage is not None else []
            if any(tuple(w[k : k + 10]) in held for k in range(len(w) - 9)):
                out.add((d, i))
    return out


def test_filter_loses_nothing(spark, monkeypatch):
    rng = np.random.default_rng(9)
    hashes = np.r_[rng.integers(-(2**63), 2**63 - 1, 3000, dtype="int64"), [0, -1, 2**63 - 1, -(2**63)]]
    frame = spark.createDataFrame([(int(h),) for h in hashes], "h long")
    others = rng.integers(-(2**63), 2**63 - 1, 50_000, dtype="int64")
    for bits, false in ((26, 0.001), (16, 0.05), (6, 1.0)):
        monkeypatch.setattr(leakage, "FILTER_BITS", bits)
        held = leakage.shingle_filter(frame)
        assert leakage._may_hold(held, hashes).all() and leakage._may_hold(held, others).mean() <= false


@pytest.mark.parametrize("bound,bits", [(1_000_000, 26), (10, 26), (10, 6)])
def test_against_brute_force(spark, monkeypatch, bound, bits):
    monkeypatch.setattr(leakage, "FILTER_BITS", bits)
    rng = random.Random(8)
    vocabulary = [f"w{n}" for n in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(n, text(rng.choice([5, 10, 11, 30, 60])), 1) for n in range(40)]
    items += [(100, items[3][1], 1), (101, None, 1), (102, "", 1), (None, text(20), 1), items[4]]
    docs = []
    for n in range(200):
        w = items[rng.randrange(40)][1].split()
        take = w[rng.randrange(len(w)) :][: rng.choice([8, 9, 10, 25])]
        docs.append((n, text(rng.randrange(30)) + ", " + " <i>".join(w.upper() for w in take) + " " + text(5), 1, "x"))
    docs += [(300, None, 1, "x"), (301, "", 1, "x"), docs[5], (302, text(30_000), 1, "x"), (None, docs[6][1], 1, "x")]
    monkeypatch.setattr(leakage, "MAX_BROADCAST_SHINGLES", bound)
    got = leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(docs, items))


def test_empty(spark):
    none = spark.createDataFrame([], DOC)
    assert leaks(none, spark.createDataFrame([(1, "a " * 20, 1)], ITEM)).count() == 0
    assert leaks(spark.createDataFrame([(1, "a " * 20, 1, "x")], DOC), spark.createDataFrame([], ITEM)).count() == 0
