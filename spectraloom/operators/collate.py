"""Putting runs side by side: distinct entities, gains, losses and their checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.scalars import either
from spectraloom.operators.quantile import attach


def entity_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key: distinct values of each column, trimmed; empty text and the text ``nan`` are no values."""
    clean = lambda c: F.nullif(F.nullif(F.trim(either(c).cast("string")), F.lit("")), F.lit("nan"))
    return df.groupBy(*keys).agg(*[F.count_distinct(clean(c)).alias(c) for c in columns])


def set_changes(df: DataFrame, column: str, before: str, after: str) -> DataFrame:
    """One row: distinct entities before and after, gained, lost, net."""
    sides = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.bool_or(before).alias("b"), F.bool_or(after).alias("a"))
    return sides.agg(
        F.lit(column).alias("entity"), F.count_if("b").alias("baseline"), F.count_if("a").alias("variant"), F.count_if(F.col("a") & ~F.col("b")).alias("gained"),
        F.count_if(F.col("b") & ~F.col("a")).alias("lost"), (F.count_if("a") - F.count_if("b")).alias("net"),
    )


def gains(baseline: DataFrame, corrected: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key, null being one of its own: counts before, after and their difference for each column."""
    a = baseline.select(*keys, *[F.col(c).alias(f"Baseline{c}") for c in columns])
    b = corrected.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"Corrected{c}") for c in columns])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    counts = [f"{side}{c}" for side in ("Baseline", "Corrected") for c in columns]
    joint = a.join(b, same, "full").select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], *counts).fillna(0, counts)
    return joint.withColumns({f"{c}Gain": F.col(f"Corrected{c}") - F.col(f"Baseline{c}") for c in columns})


def recovery_with_gains(recovery: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return recovery.join(found, key, "left")


def recovery_faults(summary: DataFrame) -> DataFrame:
    """Rows of a recovery summary that contradict themselves, with the reason."""
    total, got, rest = F.col("total"), F.col("recovered"), F.col("unrecovered")
    checks = {"sum": got + rest != total, "range": (got < 0) | (got > total), "layers": F.col("recovered_sic") + F.col("recovered_syn") < got, "sic": F.col("recovered_sic") > got, "fraction": F.abs(F.col("fraction") - F.try_divide(got, total)) > 1e-9}
    reasons = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda r: r.isNotNull())
    return summary.withColumn("faults", reasons).filter(F.size("faults") > 0)


def capped_list(df: DataFrame, keys: Sequence[str], column: str, out: str, cap: int | None = 100, separator: str = ";") -> DataFrame:
    """(keys, ``out``): each key's distinct values, sorted, the first ``cap`` of them by name and then how many more there are.

    With a cap no more than that many values of a key are ever gathered;
    without one (None) all are, so say None only where keys are small. Null
    and empty values are none; a key without values has no row.
    """
    values = df.select(*keys, F.col(column).alias("__v")).filter("__v is not null and __v <> ''").distinct()
    if cap is None:
        return values.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("__v")), separator).alias(out))
    named = values.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy("__v"))).filter(F.col("__at") <= cap)
    lists = named.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("__v")), separator).alias(out))
    more = values.groupBy(*keys).agg((F.count(F.lit(1)) - cap).alias("__more")).filter("__more > 0")
    return attach(lists, more, keys, "left").withColumn(out, F.concat(out, F.coalesce(F.concat(F.lit(f"{separator}...(+"), F.col("__more").cast("string"), F.lit(" more)")), F.lit("")))).drop("__more")


def seeded_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 1) -> DataFrame:
    """``n`` rows in a random order that the keys and the seed fix."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)
