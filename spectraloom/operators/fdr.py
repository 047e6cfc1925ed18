"""Target-decoy false discovery rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.scalars import is_decoy, minus_log10
from spectraloom.operators.ordered import MAX_GROUP_ROWS, in_slices, largest_group, least_from_here, running


def best_per_scan(df: DataFrame, keys: Sequence[str], intensity: str, ties: Sequence[str]) -> DataFrame:
    """The row of highest intensity of every scan; scans without any intensity have none."""
    best = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(intensity), *ties)
    return df.filter(F.col(intensity).isNotNull()).withColumn("__rank", F.row_number().over(best)).filter("__rank = 1").drop("__rank")


def monotone_fdr(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str], protein: str = "Protein", max_group_rows: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Adds IsDecoy, FDR and MSMSScore.

    FDR is decoys / targets up to a row in order of score (nulls last, then
    ``ties``), at most 1, then the least of this and all later rows. Rows
    before the first target have none. Zero scores count as 1 in MSMSScore.
    ``counted`` is a frame with the keys and at least the rows of ``df`` that
    is cheaper to count groups on, such as the table that ``df`` was chosen from.
    """
    order = [score, *ties]
    marked = df.withColumn("IsDecoy", is_decoy(protein))
    large = largest_group((df if counted is None else counted).select(*keys), keys) > (MAX_GROUP_ROWS if max_group_rows is None else max_group_rows)
    if large:
        marked = in_slices(marked, keys, order, marked.count(), max_group_rows)
    counted = running(marked, keys, order, {"__decoys": F.col("IsDecoy").cast("bigint"), "__targets": (~F.col("IsDecoy")).cast("bigint")}, large)
    ratio = F.least(F.lit(1.0), F.col("__decoys") / F.nullif(F.col("__targets"), F.lit(0)))
    lowered = least_from_here(counted.withColumn("__ratio", ratio), keys, order, "__ratio", "FDR", large)
    scored = lowered.withColumn("FDR", F.when(F.col("__targets") > 0, F.col("FDR"))).withColumn("MSMSScore", minus_log10(score))
    return scored.drop("__decoys", "__targets", "__ratio", "__slice")


def entity_fdr(df: DataFrame, entity: str, score: str, ties: Sequence[str], guard_targets: bool = False) -> DataFrame:
    """One row: percent of decoys among entities, each judged by its best row; ``guard_targets`` gives 0 where no target is left."""
    best = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.min(F.struct(F.col(score).isNull().alias("no"), F.col(score), *ties, is_decoy("Protein").alias("decoy")))["decoy"].alias("decoy"))
    percent = F.coalesce(F.try_divide(F.count_if("decoy"), F.count(F.lit(1))), F.lit(0.0)) * 100
    value = F.when(F.count_if(~F.col("decoy")) == 0, 0.0).otherwise(percent) if guard_targets else percent
    return best.agg(F.count_if(~F.col("decoy")).alias("targets"), F.count_if("decoy").alias("decoys"), F.round(value, 2).alias("fdr_percent"))


def run_totals(df: DataFrame, run: str) -> DataFrame:
    """One row: distinct scans, peptides and proteins per run, summed over runs, and the percent of decoys."""
    per_run = df.withColumn("__decoy", is_decoy("Protein")).groupBy(run).agg(
        F.count_distinct("ScanNum").alias("scans"), F.count_distinct("Peptide").alias("peptides"), F.count_distinct("Protein").alias("proteins"), F.count_if("__decoy").alias("decoys"), F.count_if(~F.col("__decoy")).alias("targets")
    )
    totals = per_run.agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in ("scans", "peptides", "proteins", "decoys", "targets")])
    return totals.withColumn("decoy_percent", F.round(F.coalesce(F.try_divide(F.col("decoys"), F.col("decoys") + F.col("targets")), F.lit(0.0)) * 100, 6))
