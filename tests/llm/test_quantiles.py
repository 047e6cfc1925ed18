import datetime
import math

import numpy as np
import pytest

from spectraloom.llm import quantiles as Q

SCHEMA = "grp string, x double, y double, at timestamp, n int, value string"
PROBS = (0.0, 0.01, 0.5, 0.9, 1.0)


def test_merge_keeps_true_bounds():
    rng = np.random.default_rng(1)
    parts = [np.round(rng.exponential(1, size), 2) for size in (1, 50, 5000, 300)]
    values = np.concatenate(parts)
    whole = Q.merge([Q.summarise(p, 0.05) for p in parts], 0.05)
    assert whole[0] == len(values) and len(whole[1]) <= 2 * Q.LEVELS / 0.05
    for v, le, lt in zip(*whole[1:]):
        assert le <= (values <= v).sum() and lt >= (values < v).sum()
    for p, v, rank, error in Q.answer(whole, (0.01, 0.5, 0.99)):
        assert (values < v).sum() + 1 - error <= rank <= (values <= v).sum() + error
        assert error <= 0.05 * len(values)


@pytest.mark.parametrize("chunk", [131_072, 100])
def test_over_tables(spark, monkeypatch, chunk):
    monkeypatch.setattr(Q, "CHUNK", chunk)
    monkeypatch.setattr(Q, "FAN_IN", 2)
    rng = np.random.default_rng(2)
    day = datetime.datetime(2025, 3, 1)
    rows = [(["a", "a", "b", None][k % 4], [float(rng.exponential()), 0.0, math.nan, None, math.inf][min(k % 9, 4)] if k % 9 < 5 else float(rng.normal()), None, day + datetime.timedelta(days=int(k % 5)) if k % 11 else None, 1, "v") for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    days = Q.day_summaries(df, "grp", ["x", "y"], "at", 0.05)
    for late in (False, True):
        chosen = days.filter("day >= '2025-03-03'") if late else days
        keep = lambda t: not late or t is not None and t >= datetime.datetime(2025, 3, 3)
        got = Q.percentiles(chosen, PROBS, 0.05).collect()
        assert {(r.grp, r.measure) for r in got} == {("a", "x"), ("b", "x"), (None, "x")}
        for r in got:
            own = np.array([x for g, x, _, t, *_ in rows if g == r.grp and x is not None and not math.isnan(x) and keep(t)])
            rank = max(1, math.ceil(r.prob * len(own)))
            assert r.n == len(own) and r.rank_no == rank
            assert max(0, (own < r.value).sum() + 1 - rank, rank - (own <= r.value).sum()) <= r.rank_error <= 0.05 * len(own)
    whole = Q.whole_summaries(days, 0.05)
    for bound in (100_000, 0):
        placed = Q.ranks(df, "grp", ["x", "y"], whole, ["n"], max_tuples=bound, rank_rows=200).collect()
        assert len(placed) == sum(x is not None and not math.isnan(x) for _, x, *_ in rows)
        for r in placed[:300]:
            own = np.array([x for g, x, *_ in rows if g == r.grp and x is not None and not math.isnan(x)])
            assert r.n_ == 1 and r.measure == "x"
            assert r.rank_low <= (own < r.x).sum() and r.rank_high >= (own <= r.x).sum()


def test_empty(spark):
    days = Q.day_summaries(spark.createDataFrame([], SCHEMA), "grp", ["x"], "at", 0.05)
    assert Q.percentiles(days, PROBS, 0.05).count() == 0


def exact_error(s, values):
    """By how many ranks the answers are really off, at most."""
    ordered = np.sort(values)
    off = [max(0, np.searchsorted(ordered, v, "left") + 1 - rank, rank - np.searchsorted(ordered, v, "right")) for _, v, rank, _ in Q.answer(s, np.linspace(0, 1, 1001))]
    return max(off)


@pytest.mark.parametrize("order", ["random", "sorted", "skewed", "narrowing"])
def test_error_stays_in_bound_in_any_order(order):
    rng = np.random.default_rng(3)
    epsilon, pile, chain = 0.02, [], None
    values = {"random": rng.normal(size=300_000), "sorted": np.arange(300_000.0), "skewed": np.round(rng.exponential(size=300_000) ** 4, 1), "narrowing": np.concatenate([rng.normal(size=500) / (1 + k) for k in range(600)])}[order]
    for own in np.split(values, 600):
        fresh = Q.summarise(own, epsilon)
        Q.pile_up(pile, fresh, epsilon)
        # The worst order of merging: one part after the other.
        chain = fresh if chain is None else Q.merge([chain, fresh], epsilon)
    whole = Q.whole_pile(pile, epsilon)
    assert whole[0] == chain[0] == 300_000 and max(map(len, pile)) < Q.FAN_IN
    for s in (whole, chain):
        stated = max(error for *_, error in Q.answer(s, np.linspace(0, 1, 1001)))
        assert exact_error(s, values) <= stated <= epsilon * 300_000
        assert len(s[1]) <= 2 * Q.LEVELS / epsilon
