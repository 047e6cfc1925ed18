"""Texts into containers of one token capacity, by best-fit decreasing."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.session import materialize

#: Where the public tokenizers' files are; tests and clusters may set another place.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Pieces that one task packs on average.
SHARD_PIECES = 50_000
#: Containers filled less than this after the first round are packed again.
FULL = 0.98
#: Text is tokenized in stretches of about so many characters, cut at white space.
STRETCH = 20_000

#: The vocabulary's published split pattern (fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("corpus", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _stretches(text: str) -> Iterator[str]:
    """``text`` in stretches that begin at white space, so that their tokens are those of the whole text."""
    at = 0
    while len(text) - at > 2 * STRETCH:
        end = text.find(" ", at + STRETCH)
        # A blank alone before a letter belongs to the word behind it: the cut goes before it.
        while 0 <= end and (text[end - 1].isspace() or not text[end + 1 : end + 2].isalnum()):
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def token_counts(df: DataFrame, ident: str, text: str, vocabulary: str = "byte_bpe_50k.tiktoken", directory: str | None = None) -> DataFrame:
    """(id, tokens): how many tokens each whole text has; 0 for an empty one, no row for a null text or id."""
    path = os.path.join(directory or TOKENIZERS, vocabulary)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path)
        for batch in batches:
            yield batch.map(lambda t: sum(len(encoding.encode_ordinary(part)) for part in _stretches(t))).astype("int64")

    rows = df.select(F.col(ident).cast("bigint").alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    return rows.select("id", F.pandas_udf(count, "bigint")("text").alias("tokens"))


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of every item, items taken from the largest down, each into the tightest open bin that holds it.

    A segment tree over the remaining capacities 0..capacity tells which of
    them have an open bin; the tightest fit is the first such leaf at or after
    the item's size, found in O(log capacity).
    """
    width = 1
    while width < capacity + 1:
        width *= 2
    tree = bytearray(2 * width)
    open_bins: dict[int, list[int]] = {}
    bins = np.zeros(len(sizes), dtype="int64")
    opened = 0

    def mark(leaf: int, on: int) -> None:
        node = leaf + width
        tree[node] = on
        node >>= 1
        while node:
            state = tree[2 * node] | tree[2 * node + 1]
            if tree[node] == state:
                return
            tree[node] = state
            node >>= 1

    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        node = size + width
        while not tree[node]:
            # Up until a subtree to the right has an open bin.
            while node & 1:
                node >>= 1
            if node == 0:
                break
            node += 1
        if node and tree[node]:
            while node < width:
                node = 2 * node if tree[2 * node] else 2 * node + 1
            room = node - width
            target = open_bins[room].pop()
            if not open_bins[room]:
                mark(room, 0)
        else:
            target, room = opened, capacity
            opened += 1
        bins[item] = target
        left = room - size
        if left:
            held = open_bins.setdefault(left, [])
            held.append(target)
            if len(held) == 1:
                mark(left, 1)
    return bins


def _pack(pieces: DataFrame, shards: int, capacity: int, tag: str) -> DataFrame:
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["id", "piece"], ignore_index=True)
        bins = best_fit_decreasing(shard["size"].to_numpy(), capacity)
        name = np.char.add(f"{tag}{shard['shard'].iloc[0]}-", bins.astype(str))
        return shard[["id", "piece", "size"]].assign(container=name)

    spread = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).cast("int"))
    return spread.groupBy("shard").applyInPandas(run, "id bigint, piece int, size bigint, container string")


def pack(counts: DataFrame, capacity: int, shard_pieces: int = SHARD_PIECES, full: float = FULL) -> DataFrame:
    """(id, piece, first_token, n_tokens, container) from (id bigint, tokens bigint).

    A text of more than ``capacity`` tokens is cut into full pieces, each a
    container of its own, and a rest; nothing else is cut. Rests and whole
    texts are spread over shards by hash, so that each has the sizes of the
    whole, and packed there by best-fit decreasing. Containers left emptier
    than ``full`` are opened again and their pieces packed together, in shards
    of the same bounded size. Texts without tokens have a row with piece 0
    and no container. Repeated ids are taken for one text.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    texts = counts.groupBy("id").agg(F.max("tokens").alias("tokens"))
    cut = texts.filter("tokens > 0").withColumn("pieces", F.ceil(F.col("tokens") / capacity).cast("int"))
    pieces = cut.select("id", "tokens", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")).select("id", "piece", F.least(F.lit(capacity), F.col("tokens") - F.col("piece").cast("bigint") * capacity).cast("bigint").alias("size"))
    pieces = materialize(pieces, "pack-pieces")
    whole = pieces.filter(F.col("size") == capacity).withColumn("container", F.concat(F.lit("w"), "id", F.lit("-"), "piece"))
    loose = pieces.filter(F.col("size") < capacity)
    shards = max(1, -(-loose.count() // shard_pieces))
    once = materialize(_pack(loose, shards, capacity, "a"), "pack-once")
    # There are as many containers as the texts fill: those joins are shuffled.
    fill = once.groupBy("container").agg(F.sum("size").alias("fill"))
    slack = materialize(once.join(fill.filter(F.col("fill") < full * capacity).select("container").hint("merge"), "container", "left_semi").select("id", "piece", "size"), "pack-slack")
    again = _pack(slack, max(1, -(-slack.count() // shard_pieces)), capacity, "b")
    tight = once.join(fill.filter(F.col("fill") >= full * capacity).select("container").hint("merge"), "container", "left_semi")
    out = whole.unionByName(tight).unionByName(again)
    empty = texts.filter("tokens = 0").select("id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("string").alias("container"))
    return out.unionByName(empty).select("id", "piece", (F.col("piece").cast("bigint") * capacity).alias("first_token"), F.col("size").alias("n_tokens"), "container")
