"""Database partitions: shuffled peptides in groups of equal size, and all pairs of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.operators.ordered import in_slices


def shuffle_key(column: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(column)))


def group_assignments(peptides: DataFrame, groups: int, seed: int = 1) -> DataFrame:
    """(Peptide, Group): groups whose sizes differ by one at most, earlier ones larger, in a reproducible random order.

    The order is global, so no window spans it: range slices are numbered in
    parallel and shifted by the rows of the slices before.
    """
    keyed = peptides.select("Peptide").distinct().withColumn("__key", shuffle_key("Peptide", seed))
    total = keyed.count()
    sliced = in_slices(keyed, [], ["__key", "Peptide"], total)
    inner = Window.partitionBy("__slice").orderBy("__key", "Peptide")
    sizes = sliced.groupBy("__slice").count()
    # One row per slice.
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__slice", "__before")
    place = sliced.withColumn("__at", F.row_number().over(inner) - 1).join(offsets, "__slice").withColumn("__at", F.col("__at") + F.col("__before"))
    small, extra = divmod(total, groups)
    edge = (small + 1) * extra
    group = F.when(F.col("__at") < edge, F.floor(F.col("__at") / (small + 1))).otherwise(extra + F.floor((F.col("__at") - edge) / max(small, 1))) + 1
    return place.select("Peptide", group.cast("int").alias("Group"))


def pair_assignments(assigned: DataFrame, groups: int) -> DataFrame:
    """(PairGroupA, PairGroupB, Peptide): the union of both groups for every pair A < B."""
    others = F.array(*[F.lit(g) for g in range(1, groups + 1)])
    exploded = assigned.withColumn("other", F.explode(others)).filter(F.col("other") != F.col("Group"))
    return exploded.select(F.least("Group", "other").alias("PairGroupA"), F.greatest("Group", "other").alias("PairGroupB"), "Peptide")


def bin_summary(assigned: DataFrame, groups: int) -> DataFrame:
    sizes = assigned.groupBy("Group").count()
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.sum("count").alias("peptides"), F.min("count").alias("smallest"), F.max("count").alias("largest"), F.lit(groups * (groups - 1) // 2).cast("bigint").alias("expected_pairs"))


def size_label(size: int) -> str:
    """1200000 -> 1.2M, 600000 -> 600k."""
    for unit, name in ((1_000_000, "M"), (1_000, "k")):
        if size >= unit:
            return f"{size / unit:g}{name}"
    return str(size)


def parse_size(label: str) -> int:
    """1.2M -> 1200000, 600k -> 600000."""
    units = {"m": 1_000_000, "k": 1_000}
    text = label.strip().lower()
    factor = units.get(text[-1:], 1)
    return round(float(text[:-1] if factor > 1 else text) * factor)


def nearest_group_count(total: int, target: int) -> int:
    """How many groups come nearest to ``target`` peptides each: half up, at least 1."""
    return max(1, (2 * total + target) // (2 * target))
