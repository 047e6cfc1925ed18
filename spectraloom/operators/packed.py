"""Fields that pack several values: one row per value, with its place."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.segment import automaton, cover, marks, segment
from spectraloom.session import fits, materialize

#: Largest dictionary that is sent whole to the executors (about 20 MB of ids).
MAX_BROADCAST_VALUES = 200_000
#: Distinct fields that one shard of a larger dictionary meets at once.
BLOCK_FIELDS = 200_000


def may_hold_several(column: Column) -> Column:
    """A necessary condition for two or more values: something that can separate them."""
    return column.rlike(r"[^\p{L}\p{N}_.\-:'|]|\|\|")


def _with_broadcast(df: DataFrame, column: str, values: list[str], out: str) -> DataFrame:
    shipped = df.sparkSession.sparkContext.broadcast(values)

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = automaton(shipped.value)
        for batch in batches:
            codes, distinct = pd.factorize(batch, use_na_sentinel=True)
            parts = [segment(field, known) for field in distinct]
            yield pd.Series([parts[code] if code >= 0 else [] for code in codes], dtype=object)

    # Not for chance: else a filter on the result is pushed down and cuts every field a second time.
    return df.withColumn(out, F.pandas_udf(cut, "array<string>").asNondeterministic()(F.col(column)))


def _with_shards(df: DataFrame, column: str, dictionary: DataFrame, out: str, shard_values: int) -> DataFrame:
    """For a dictionary of any size: one automaton per shard of it, each of which marks every distinct field; one cover over all marks.

    Fields and shards meet in blocks, so that a task holds ``shard_values``
    values and ``BLOCK_FIELDS`` fields, about. A number stands for a field
    until its marks are together.
    """
    field, spans = "__field", "array<struct<first:int,end:int>>"
    distinct = df.select(F.col(column).alias(field)).filter(F.length(field) > 0).distinct()
    fields = materialize(distinct.withColumn("__no", F.monotonically_increasing_id()), "packed-fields")
    shards = max(1, -(-dictionary.count() // max(1, shard_values)))
    blocks = max(1, -(-fields.count() // BLOCK_FIELDS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    texts = fields.withColumn("block", F.pmod(F.xxhash64("__no"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    values = dictionary.withColumn("shard", F.pmod(F.xxhash64("value"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))

    def mark(own: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        known = automaton(shard["value"].tolist())
        found = [(no, [{"first": a, "end": b} for a, b in marked]) for no, text in zip(own["__no"], own[field]) if (marked := marks(text, known))]
        return pd.DataFrame(found, columns=["__no", "__spans"])

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series, marked: pd.Series) -> pd.Series:
        return pd.Series([cover(text, [(s["first"], s["end"]) for own in parts for s in own] if parts is not None else []) for text, parts in zip(texts, marked)], dtype=object)

    keys = ["shard", "block"]
    hits = texts.groupBy(*keys).cogroup(values.groupBy(*keys)).applyInPandas(mark, f"__no bigint, __spans {spans}")
    marked = hits.groupBy("__no").agg(F.collect_list("__spans").alias("__spans"))
    cuts = fields.join(marked.hint("merge"), "__no", "left").select(field, cut.asNondeterministic()(field, "__spans").alias("__cut"))
    met = df.join(cuts.hint("merge"), df[column] == cuts[field], "left")
    return met.withColumn(out, F.coalesce("__cut", F.array().cast("array<string>"))).drop(field, "__cut")


def with_values(df: DataFrame, column: str, dictionary: DataFrame, dictionary_column: str, prefixes: Sequence[str] = ("", "XXX_"), out: str = "values", max_broadcast: int = MAX_BROADCAST_VALUES) -> DataFrame:
    """Add ``out``, the array of values packed in ``column``.

    ``dictionary`` lists the known values; each also counts behind every one
    of ``prefixes``. Up to ``max_broadcast`` entries it goes to the executors
    as one automaton; a larger one stays distributed, in shards of that many
    values with an automaton each. Both ways give the same values.

    Null or empty fields give an empty array, as do fields of separators only.
    Repeated values all count. An empty dictionary leaves the grammar alone to
    decide. Other columns pass unchanged; a column called ``out`` is replaced.
    """
    own = dictionary.select(F.col(dictionary_column).alias("value")).filter(F.length("value") > 0)
    known = own.select(F.explode(F.array(*[F.concat(F.lit(p), "value") for p in prefixes])).alias("value")).distinct()
    if fits(known, max_broadcast):
        return _with_broadcast(df, column, [row.value for row in known.sort("value").collect()], out)
    return _with_shards(df, column, known, out, max_broadcast)


def split_packed(df: DataFrame, column: str, dictionary: DataFrame, dictionary_column: str, keep: Sequence[str], value: str = "value", pos: str = "pos", least: int = 1, **options: object) -> DataFrame:
    """One row per value: the ``keep`` columns, ``pos`` (from 1) and ``value``.

    Rows with fewer than ``least`` values are left out; rows that cannot have
    two values are dropped before the automaton sees them when ``least`` > 1.
    """
    rows = df.select(*keep, F.col(column).alias("__packed"))
    if least > 1:
        rows = rows.filter(may_hold_several(F.col("__packed")))
    cut = with_values(rows, "__packed", dictionary, dictionary_column, out="__values", **options)
    cut = cut.filter(F.size("__values") >= least) if least > 1 else cut
    return cut.select(*keep, F.posexplode("__values").alias("__at", value)).withColumn(pos, (F.col("__at") + 1).cast("int")).select(*keep, pos, value)
