"""Long exact spans that several records share, by super-k-mer partitioning."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.session import materialize

#: Windows that one bucket holds on average.
BUCKET_WINDOWS = 200_000
#: A minimiser with more distinct packed strings is split by window instead.
MAX_STRINGS = 50_000


def super_kmers(text: str, k: int, m: int) -> Iterator[tuple[str, int, str]]:
    """(minimiser, start, packed string): maximal stretches of windows of ``k`` whose least ``m``-piece is the same one.

    Pieces are ordered by a hash, so that frequent ones are not favoured. The
    starts count from 0. Linear in the length of the text.
    """
    windows, width = len(text) - k + 1, k - m + 1
    if windows <= 0:
        return
    order = [zlib.crc32(text[at : at + m].encode()) for at in range(len(text) - m + 1)]
    least: deque[int] = deque()
    first, chosen = 0, -1
    for at, key in enumerate(order):
        while least and order[least[-1]] > key:
            least.pop()
        least.append(at)
        window = at - width + 1
        if window < 0:
            continue
        if least[0] < window:
            least.popleft()
        if least[0] != chosen:
            if chosen >= 0:
                yield text[chosen : chosen + m], first, text[first : window - 1 + k]
            first, chosen = window, least[0]
    yield text[chosen : chosen + m], first, text[first:]


def _count_bucket(k: int):
    """Sorts the windows of one bucket; says of each packed string which of its windows several records hold."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        packed = bucket["packed"].tolist()
        sizes = np.array([len(text) - k + 1 for text in packed])
        owner = np.repeat(np.arange(len(packed)), sizes)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        windows = np.array([text[at : at + k] for text in packed for at in range(len(text) - k + 1)])
        order = np.argsort(windows, kind="stable")
        ordered = windows[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        low = np.minimum.reduceat(bucket["low"].to_numpy()[owner[order]], starts)
        high = np.maximum.reduceat(bucket["high"].to_numpy()[owner[order]], starts)
        shared = np.sort(order[np.repeat(low != high, np.diff(np.r_[starts, len(ordered)]))])
        # Consecutive windows of one string are one stretch.
        fresh = np.flatnonzero(np.r_[True, (owner[shared[1:]] != owner[shared[:-1]]) | (shared[1:] != shared[:-1] + 1)][: len(shared)])
        ends = np.r_[fresh[1:] - 1, len(shared) - 1][: len(fresh)]
        first, last = offset[shared[fresh]], offset[shared[ends]]
        return pd.DataFrame({"packed": bucket["packed"].to_numpy()[owner[shared[fresh]]], "first": first.astype("int32"), "last": last.astype("int32")})

    return run


def _minimised(df: DataFrame, text: str, k: int, m: int) -> DataFrame:
    """One row per super-k-mer of ``text``: minimiser, start and packed string in its place."""

    @F.pandas_udf("array<struct<minimiser:string,start:int,packed:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"minimiser": a, "start": b, "packed": c} for a, b, c in super_kmers(text, k, m)] for text in texts], dtype=object)

    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.explode(cut(text)).alias("p")).select(*rest, "p.*")


def shared_windows(records: DataFrame, k: int, m: int, both_ways: bool, max_strings: int = MAX_STRINGS, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """(record, first, last): stretches of window starts, from 0, that another record's text holds too; one row per super-k-mer and stretch.

    ``records`` has ``record`` (unique), ``text`` (distinct), ``low`` and
    ``high``, the least and greatest id with that text. Every text is cut into
    super-k-mers, which travel to their minimiser's bucket; equal strings are
    merged on the way. The text itself stays where it is.
    """
    long = records.filter(F.length("text") >= k)
    pieces = materialize(_minimised(long.select("record", "low", "high", "text"), "text", k, m), "spans-pieces")
    sources = pieces.select("minimiser", "packed", "low", "high")
    if both_ways:
        sources = sources.unionByName(_minimised(long.select("low", "high", F.reverse("text").alias("text")), "text", k, m).drop("start"))
    strings = materialize(sources.groupBy("minimiser", "packed").agg(F.min("low").alias("low"), F.max("high").alias("high")), "spans-strings")
    sizes = strings.groupBy("minimiser").agg(F.count(F.lit(1)).alias("strings"))
    hot = materialize(sizes.filter(F.col("strings") > max_strings).select("minimiser"), "spans-hot")
    windows = strings.agg(F.sum(F.length("packed") - k + 1)).first()[0] or 0
    buckets = max(1, -(-int(windows) // bucket_windows))
    # There are at most (distinct strings / max_strings) hot minimisers: one in 50,000 strings.
    usual = strings.join(hot.hint("merge"), "minimiser", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("minimiser"), F.lit(buckets)))
    counted = usual.groupBy("bucket").applyInPandas(_count_bucket(k), "packed string, first int, last int")
    split = strings.join(hot.hint("merge"), "minimiser", "left_semi").select("low", "high", "packed", F.explode(F.sequence(F.lit(0), F.length("packed") - k)).alias("offset"))
    split = split.withColumn("window", F.substr("packed", F.col("offset") + 1, F.lit(k)))
    several = split.groupBy("window").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l <> h").select("window")
    single = split.join(several.hint("merge"), "window", "left_semi").select("packed", F.col("offset").alias("first"), F.col("offset").alias("last"))
    hits = counted.unionByName(single)
    met = pieces.select("record", "start", "packed").join(hits.hint("merge"), "packed")
    return met.select("record", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))


def _runs(k: int):
    """Joins the stretches of one record, in any order, to maximal runs of characters (start and end, from 1)."""

    @F.pandas_udf("array<struct<span_start:int,span_end:int>>")
    def joined(stretches: pd.Series) -> pd.Series:
        out = []
        for own in stretches:
            first = np.array([s["first"] for s in own], dtype="int64")
            last = np.array([s["last"] for s in own], dtype="int64")
            order = np.argsort(first, kind="stable")
            first, upto = first[order], np.maximum.accumulate(last[order])
            fresh = np.flatnonzero(np.r_[True, first[1:] > upto[:-1] + k])
            ends = upto[np.r_[fresh[1:] - 1, len(upto) - 1]]
            out.append([{"span_start": int(a) + 1, "span_end": int(b) + k} for a, b in zip(first[fresh], ends)])
        return pd.Series(out, dtype=object)

    return joined


def shared_spans(df: DataFrame, ident: str, text: str, k: int, m: int = 7, both_ways: bool = False, **bounds: int) -> DataFrame:
    """(ident, span_start, span_end): maximal runs of characters that lie in ``k`` consecutive ones held by another record too.

    Positions count from 1 and both ends belong to the run. With ``both_ways``
    the other record's reversed text counts as well. Records are told apart by
    ``ident``: two rows of one id are one record only if their texts agree,
    and a row's own reversed text is not another record. Null, empty and short
    texts have no spans, nor do rows with a null id. Other columns are ignored.

    Texts travel three times: where equal ones are merged, where runs meet
    their text and where the text meets its ids. Between those a number stands
    for them. The stretches of one text are gathered in one row, which is no
    longer than the text.
    """
    if not 0 < m <= k:
        raise ValueError("the minimiser must be no longer than the span")
    rows = df.select(F.col(ident).alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= k))
    merged = rows.groupBy("text").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    # Numbered once and written: the numbers do not change afterwards.
    records = materialize(merged.withColumn("record", F.monotonically_increasing_id()), "spans-records")
    stretches = shared_windows(records, k, m, both_ways, **bounds).groupBy("record").agg(F.collect_list(F.struct("first", "last")).alias("stretches"))
    runs = stretches.select("record", _runs(k)("stretches").alias("runs"))
    found = records.select("record", "text").join(runs.hint("merge"), "record").select("text", "runs")
    met = rows.distinct().join(found.hint("merge"), "text").select("id", F.explode("runs").alias("run"))
    return met.select(F.col("id").alias(ident), "run.span_start", "run.span_end")
