"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.operators import ordered
from spectraloom.operators.ordered import largest_group, running
from spectraloom.session import materialize


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]):
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def attach(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``a`` with the other columns of ``b``; null keys are equal."""
    named = b.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return a.join(named, on, how).drop(*[f"__r_{k}" for k in keys])


def ranked_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, v, n, upto, total): each distinct value with its count, how many values it and smaller ones have, and all."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # Read three times below: what leads to it must not run three times.
    counts = materialize(counts, "value-counts")
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    # No group is larger than the table, whose rows its files tell.
    large = counts.count() > ordered.MAX_GROUP_ROWS and largest_group(counts, keys) > ordered.MAX_GROUP_ROWS
    return attach(running(counts, keys, ["v"], {"upto": F.col("n")}, large), totals, keys)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """(keys, one column per prob): quantiles with linear interpolation.

    Equal values are counted first and then ranked, so that no task holds a
    group whole; a group without values has no row.
    """
    ranked = ranked_values(df, keys, value)

    def at(index):
        return F.max(F.when((F.col("upto") > index) & (F.col("upto") - F.col("n") <= index), F.col("v")))

    columns = []
    for name, p in probs.items():
        place = F.lit(p) * (F.col("total") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        share = F.max(place - F.floor(place))
        columns.append((low + (high - low) * share).alias(name))
    return ranked.groupBy(*keys).agg(*columns)


def percentiles_of(df: DataFrame, keys: Sequence[str], probs: dict[str, dict[str, float]]) -> DataFrame:
    """``exact_percentiles`` of several columns in one pass: (keys, one column per name in ``probs``, which gives each column's names and probs).

    A group that has no value of a column has null there.
    """
    names = {name: (column, p) for column, own in probs.items() for name, p in own.items()}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in probs]))
    long = df.select(*keys, pairs.alias("__p")).select(*keys, F.col("__p.c").alias("__c"), F.col("__p.v").alias("__x"))
    every = sorted({p for _, p in names.values()})
    found = exact_percentiles(long, [*keys, "__c"], "__x", {f"__q{k}": p for k, p in enumerate(every)})
    pick = lambda name: F.max(F.when(F.col("__c") == names[name][0], F.col(f"__q{every.index(names[name][1])}"))).alias(name)
    return found.groupBy(*keys).agg(*[pick(name) for name in names])
