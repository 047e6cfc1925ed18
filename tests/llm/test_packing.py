import os
import random

import numpy as np
import pytest

from spectraloom.llm import packing
from spectraloom.llm.packing import best_fit_decreasing, pack, token_counts


def brute_bins(sizes, capacity):
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= size]
        if fits:
            rooms[min(fits)[1]] -= size
        else:
            rooms.append(capacity - size)
    return len(rooms)


def test_best_fit_matches_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([1, 7, 20, 64, 100])
        sizes = np.array([rng.randint(1, capacity) for _ in range(rng.randint(0, 80))], dtype="int64")
        bins = best_fit_decreasing(sizes, capacity)
        assert len(set(bins.tolist())) == brute_bins(sizes.tolist(), capacity)
        assert not len(sizes) or np.bincount(bins, weights=sizes).max() <= capacity


def test_pack_is_whole(spark):
    rng = random.Random(6)
    rows = [(n, rng.choice([0, 1, 30, 99, 100, 101, 250, 1000])) for n in range(700)] + [(3, 1)]
    want = {}
    for n, t in rows:
        want[n] = max(t, want.get(n, 0))
    got = pack(spark.createDataFrame(rows, "id long, tokens long"), 100, shard_pieces=200).collect()
    fill, tokens = {}, {}
    for r in got:
        tokens[r.id] = tokens.get(r.id, 0) + r.n_tokens
        assert (r.container is None) == (r.n_tokens == 0) and r.first_token == r.piece * 100
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
        assert r.piece == 0 or want[r.id] > 100
    assert tokens == want and max(fill.values()) <= 100
    fill.pop(None)
    assert 1 - sum(fill.values()) / (100 * len(fill)) < 0.02
    assert pack(spark.createDataFrame([], "id long, tokens long"), 100).count() == 0


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZERS), reason="no vocabulary files here")
def test_token_counts(spark):
    long = " ".join(f"word{n} und, mehr" for n in range(20_000))
    rows = [(1, "Hello world, it's 42!", "x"), (2, "", "x"), (3, None, "x"), (4, long, "x"), (None, "a", "x"), (5, "语" * 50_000, "x")]
    got = {r.id: r.tokens for r in token_counts(spark.createDataFrame(rows, "id long, text string, tokens string"), "id", "text").collect()}
    encoding = packing._encoding(os.path.join(packing.TOKENIZERS, "byte_bpe_50k.tiktoken"))
    assert got == {i: len(encoding.encode_ordinary(t)) for i, t, _ in rows if i is not None and t is not None}
