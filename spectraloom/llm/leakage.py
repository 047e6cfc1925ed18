"""Held-out passages inside a corpus: shingles in order of rarity, prefix join, exact check."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.session import fits, materialize

#: Words of a shingle, and consecutive words that make a leak.
SHINGLE, RUN = 5, 10
#: Shingles of items, or ids of candidate pages (8 bytes each), that are sent to every executor at most.
MAX_BROADCAST_SHINGLES = 1_000_000
#: Bits of the filter that tasks hold against the corpus' shingles: 8 MB, whatever the number of items.
FILTER_BITS = 26
#: Where in a hash the three places of the filter begin.
_SLICES = (0, 19, 38)
#: Characters of text whose words a task holds at once, about.
CHUNK = 2_000_000

_TAG = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)>")
_WORDS = re.compile(r"[^\W_]+")
_FORMAT = re.compile("[­؀-؅؜۝܏࣢᠎​-‏‪-‮⁠-⁤⁦-⁯﻿￹-￻\U000e0001\U000e0020-\U000e007f]")
_PLAIN = re.compile(r"[\x00-\x7f]*\Z")


def words(text: str) -> list[str]:
    """Runs of letters and digits without regard to case and accents, after tags, entities and invisible characters."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not _PLAIN.match(text):
        text = _FORMAT.sub("", text)
        text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c)).casefold()
    else:
        text = text.lower()
    return _WORDS.findall(text)


def _hashes(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash) of every shingle of a batch of texts; positions count words from 0."""
    found = [words(text) for text in texts]
    sizes = np.array([len(own) for own in found], dtype="int64")
    codes, distinct = pd.factorize(np.array([w for own in found for w in own], dtype=object))
    table = np.array([xxhash.xxh64_intdigest(w) for w in distinct], dtype="uint64")
    hashed = table[codes] if len(codes) else np.zeros(0, "uint64")
    total = len(hashed)
    if total < SHINGLE:
        return np.zeros(0, "int64"), np.zeros(0, "int32"), np.zeros(0, "int64")
    mixed = np.zeros(total - SHINGLE + 1, dtype="uint64")
    for k in range(SHINGLE):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashed[k : total - SHINGLE + 1 + k]
        mixed ^= mixed >> np.uint64(29)
    row = np.repeat(np.arange(len(sizes)), sizes)
    position = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.flatnonzero(row[: len(mixed)] == row[SHINGLE - 1 :])
    return row[whole], position[whole].astype("int32"), mixed[whole].view("int64")


def shingle_filter(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of hashes (h), as words of 64 bits: made on Spark, of constant size, so that at most its words come to the driver."""
    mask = F.lit(2**FILTER_BITS - 1).cast("bigint")
    places = F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(mask) for s in _SLICES])
    bits = wanted.select(F.explode(places).alias("p")).select(F.shiftright("p", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(F.lit(63).cast("bigint")).cast("int")).alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(max(1, 2**FILTER_BITS // 64), dtype="int64")
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    return words


def _may_hold(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be among those of the filter: all that are, and few others."""
    out = np.ones(len(h), dtype=bool)
    for s in _SLICES:
        place = (h.view("uint64") >> np.uint64(s)) & np.uint64(2**FILTER_BITS - 1)
        out &= (words[place >> np.uint64(6)].view("uint64") >> (place & np.uint64(63))) & np.uint64(1) == 1
    return out


def shingles(df: DataFrame, ident: str, text: str, among: np.ndarray | None = None) -> DataFrame:
    """(id, at, h): every shingle of every text with its place; of those that the filter ``among`` rules out none."""
    shipped = None if among is None else df.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = np.cumsum(batch["text"].str.len().to_numpy()) // CHUNK
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            for first, last in zip(cuts[:-1], cuts[1:]):
                own = batch.iloc[first:last]
                row, at, h = _hashes(own["text"])
                if shipped is not None:
                    kept = _may_hold(shipped.value, h)
                    row, at, h = row[kept], at[kept], h[kept]
                yield pd.DataFrame({"id": own["id"].to_numpy()[row], "at": at, "h": h})

    rows = df.select(F.col(ident).cast("bigint").alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    return rows.mapInPandas(run, "id bigint, at int, h bigint")


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of every text and the windows it may hold, the items of those it does hold, word by word."""
    for batch in batches:
        out = []
        for ident, text, found in zip(batch["id"], batch["text"], batch["found"]):
            own = words(text)
            items = {c["item"] for c in found if own[c["start"] : c["start"] + RUN] == list(c["window"])}
            out += [(ident, item) for item in items]
        yield pd.DataFrame(out, columns=["id", "item"])


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id): documents that hold RUN consecutive words of an item's passage as consecutive words.

    Each window of RUN words of a passage is a set of RUN - SHINGLE + 1
    shingles, all of which a document must hold: the rarest one, by its count
    over all documents, is the necessary prefix. Only those meet the corpus.
    A hit fixes where the window would start in the document; it must fit
    there (position and length bounds) and is then compared word by word. Items
    that share a window are each reported. Null ids or texts and passages of
    fewer than RUN words take no part; repeated rows of an id count once.
    """

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(words)

    held = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(passage).alias("text")).filter("item is not null and text is not null").distinct()
    parts = materialize(held.select("item", "text", split("text").alias("words")).filter(F.size("words") >= RUN), "leak-items")
    # The shingles of the items by window; equal windows of several items travel once.
    starts = parts.select("item", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - RUN + 1), lambda s: F.slice("words", s, RUN))).alias("start", "window"))
    owners = materialize(starts.select("item", "window").distinct(), "leak-owners")
    windows = owners.select("window").distinct().withColumn("w", F.xxhash64("window"))
    hashed = shingles(windows.select(F.col("w").alias("id"), F.array_join("window", " ").alias("text")), "id", "text")
    listed = materialize(hashed.select(F.col("id").alias("w"), F.col("at").alias("inside"), "h"), "leak-shingles")

    wanted = materialize(listed.select("h").distinct(), "leak-wanted")
    # Tasks leave out what the filter rules out; what is left meets the shingles themselves, in place up to MAX_BROADCAST_SHINGLES.
    few = fits(wanted, MAX_BROADCAST_SHINGLES)
    exact = F.broadcast(wanted) if few else wanted.hint("merge")
    seen = materialize(shingles(documents, doc_id, text, shingle_filter(wanted)).join(exact, "h", "left_semi"), "leak-seen")
    counts = seen.groupBy("h").agg(F.count_distinct("id").alias("pages"))
    # A window with a shingle that no document holds is in no document.
    rarity = listed.join(counts.hint("merge"), "h").groupBy("w").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("pages", "h", "inside")).alias("prefix"))
    prefixes = rarity.filter(F.col("k") == RUN - SHINGLE + 1).select("w", "prefix.h", "prefix.inside")
    # There are about as many windows as shingles of items.
    hits = seen.join(prefixes if few else prefixes.hint("merge"), "h").withColumn("start", F.col("at") - F.col("inside")).filter("start >= 0").select("id", "w", "start").distinct()
    # Length bound: the window's last shingle must be there as well.
    last = listed.filter(F.col("inside") == RUN - SHINGLE).select("w", F.col("h").alias("last"))
    ends = seen.select("id", F.col("h").alias("last"), (F.col("at") - (RUN - SHINGLE)).alias("start"))
    bounded = hits.join(last if few else last.hint("merge"), "w").join(ends.hint("merge"), ["id", "last", "start"], "left_semi").select("id", "w", "start")
    named = owners.withColumn("w", F.xxhash64("window"))
    candidates = materialize(bounded.join(named if few else named.hint("merge"), "w").groupBy("id").agg(F.collect_set(F.struct("item", "start", "window")).alias("found")), "leak-candidates")
    texts = documents.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")).filter("text is not null")
    named_ids = candidates.select("id")
    if fits(named_ids, MAX_BROADCAST_SHINGLES):
        # Only the texts of candidates travel.
        texts = texts.join(F.broadcast(named_ids), "id", "left_semi")
    proven = texts.join(candidates.hint("merge"), "id").mapInPandas(_verify, "id bigint, item bigint").distinct()
    return proven.select(F.col("id").alias(doc_id), F.col("item").alias(item_id))
