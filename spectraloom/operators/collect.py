"""Partition-level FDR observations, and what they say of every scan and peptide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.scalars import core_peptide, joined, unmodified_peptide

OBSERVATION = ("RunFolder", "ScanNum", "CorePeptide")


def with_cores(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"CorePeptide": core_peptide("Peptide"), "UnmodifiedPeptide": unmodified_peptide("Peptide")})


def observations(rows: DataFrame) -> DataFrame:
    """One row per (RunFolder, ScanNum, CorePeptide): the best by SpecEValue, FDR, peptide and protein, with its distinct forms and proteins."""
    # Most observations are one row: a window sorts them once, where an aggregate would sort on both sides of the shuffle.
    best = Window.partitionBy(*OBSERVATION).orderBy(*[F.asc_nulls_last(c) for c in ("SpecEValue", "PartitionFDR", "Peptide", "Protein", "MSGFScore")])
    group = Window.partitionBy(*OBSERVATION)
    marked = rows.withColumns({"__rank": F.row_number().over(best), "__forms": F.collect_set("Peptide").over(group), "__proteins": F.size(F.collect_set("Protein").over(group))})
    return marked.filter("__rank = 1").withColumns({"PartitionExactPeptideForms": joined(F.col("__forms")), "PartitionExactPeptideFormCount": F.size("__forms"), "PartitionProteinMappingCount": F.col("__proteins")}).drop("__rank", "__forms", "__proteins")


def conflicts(rows: DataFrame) -> DataFrame:
    """Observations with more than one FDR or more than one score."""
    found = rows.groupBy(*OBSERVATION).agg(
        F.count_distinct("Peptide").alias("ExactPeptideForms"), F.count_distinct("Protein").alias("ProteinMappings"),
        F.count_distinct("PartitionFDR").alias("PartitionFDRUnique"), F.min("PartitionFDR").alias("PartitionFDRMin"), F.max("PartitionFDR").alias("PartitionFDRMax"),
        F.count_distinct("SpecEValue").alias("SpecEValueUnique"), F.min("SpecEValue").alias("SpecEValueMin"), F.max("SpecEValue").alias("SpecEValueMax"),
    )
    return found.filter("PartitionFDRUnique > 1 or SpecEValueUnique > 1")


def require_no_conflicts(rows: DataFrame) -> None:
    """Stops a run whose partitions contradict themselves."""
    some = conflicts(rows).limit(5).collect()
    if some:
        raise ValueError(f"observations with several FDR values or scores, such as {some}")


def fdr_summary(rows: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Statistics of the partition FDR per key, and ``more``. A key has one row per partition, so the median's group is small."""
    fdr = "PartitionFDR"
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("RowsAcrossBins"), F.size(F.collect_set("RunFolder")).cast("bigint").alias("PartitionBinsRepresented"),
        F.avg(fdr).alias("BinnedFDRMean"), F.median(fdr).alias("BinnedFDRMedian"), F.min(fdr).alias("BinnedFDRMin"), F.max(fdr).alias("BinnedFDRMax"),
        F.stddev_samp(fdr).alias("BinnedFDRStd"), F.count(fdr).alias("BinnedFDRCount"), joined(F.collect_set("RunFolder")).alias("BinnedRunFolders"),
        F.min("MSGFScore").alias("MSGFScoreMin"), F.max("MSGFScore").alias("MSGFScoreMax"), *more,
    )
    return out.withColumns({"BinnedFDRRange": F.col("BinnedFDRMax") - F.col("BinnedFDRMin"), "MSGFScoreRange": F.col("MSGFScoreMax") - F.col("MSGFScoreMin")})


def core_summary(observed: DataFrame) -> DataFrame:
    """``fdr_summary`` per (ScanNum, CorePeptide) with the peptide forms and proteins seen."""
    forms = F.flatten(F.collect_set(F.split("PartitionExactPeptideForms", ";")))
    return fdr_summary(
        observed, ["ScanNum", "CorePeptide"],
        F.coalesce(F.min(F.nullif("UnmodifiedPeptide", F.lit(""))), F.lit("")).alias("UnmodifiedPeptide"), joined(forms).alias("BinnedPeptideForms"),
        F.size(F.array_distinct(F.filter(forms, lambda f: f != ""))).alias("BinnedPeptideFormCount"), F.size(F.collect_set("Protein")).cast("bigint").alias("BinnedProteinCount"), joined(F.collect_set("Protein")).alias("BinnedProteins"),
        F.max("PartitionExactPeptideFormCount").alias("MaxExactFormsWithinPartition"), F.count_if(F.col("PartitionExactPeptideFormCount") > 1).alias("PartitionsWithMultipleExactForms"),
    )


def representatives(observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One observation per key: the least SpecEValue, then PartitionFDR (nulls last), then RunFolder. It lends its metadata and decides nothing."""
    order = [f for c in ("SpecEValue", "PartitionFDR") for f in (F.col(c).isNull().alias(f"__{c}"), F.col(c))]
    rest = [c for c in observed.columns if c not in (*keys, "SpecEValue", "PartitionFDR", "RunFolder")]
    best = observed.groupBy(*keys).agg(F.min(F.struct(*order, "RunFolder", *rest)).alias("__best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__best.{c}") for c in observed.columns])
