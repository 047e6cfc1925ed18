"""Queries on scans and false discovery rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.fixtures import fixture, oracle
from spectraloom.operators.fdr import best_per_scan, entity_fdr, monotone_fdr, run_totals

TIES = ["Ord", "Ord2", "Ord3"]


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_per_scan(fixture(spark, sf_dir, "fx_psm_raw"), ["Run", "ScanNum"], "ParentIonIntensity", TIES)


def sic_best_per_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("Run", "ScanNum", "Peptide", "Protein", "SpecEValue", "ParentIonIntensity")


def psm_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rounding drops the sign of the -0.0 that a score of 1 gives; the outer minus restores it.
    scored = monotone_fdr(_best(spark, sf_dir), ["Run"], "SpecEValue", ["ScanNum", *TIES], counted=fixture(spark, sf_dir, "fx_psm_raw"))
    return scored.select("Run", "ScanNum", "Peptide", "Protein", "IsDecoy", F.abs("DelM_PPM").alias("absPPM"), F.round("FDR", 9).alias("FDR"), (-F.round(-F.col("MSMSScore"), 9)).alias("MSMSScore"))


def psm_fdr_leading_decoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for scans read so that decoys lead: rows before the first target have no FDR."""
    rows = fixture(spark, sf_dir, "fx_psm_raw").withColumn("Protein", F.when(F.col("SpecEValue") < 0.000004, F.concat(F.lit("XXX_"), "Protein")).otherwise(F.col("Protein")))
    scored = monotone_fdr(rows, ["Run"], "SpecEValue", ["ScanNum", *TIES])
    return scored.groupBy("Run").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("FDR").isNull()).alias("without_fdr"), F.round(F.min("FDR"), 9).alias("least"), F.round(F.max("FDR"), 9).alias("most"))


def _score_order() -> list[str]:
    return ["Run", "ScanNum", *TIES]


def peptide_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_fdr(fixture(spark, sf_dir, "fx_psm_raw"), "Peptide", "SpecEValue", _score_order())


def protein_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_fdr(fixture(spark, sf_dir, "fx_psm_raw"), "Protein", "SpecEValue", _score_order(), guard_targets=True)


def run_totals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_totals(fixture(spark, sf_dir, "fx_psm_raw"), "Run")


_BEST = """best as (select * from fx_psm_raw where ParentIonIntensity is not null
  qualify row_number() over (partition by Run, ScanNum order by ParentIonIntensity desc, Ord, Ord2, Ord3) = 1)"""
_FDR = """marked as (select *, starts_with(Protein, 'XXX_') as IsDecoy from {source}),
counted as (select *, sum(IsDecoy::int) over w as d, sum((not IsDecoy)::int) over w as t from marked
  window w as (partition by Run order by SpecEValue, ScanNum, Ord, Ord2, Ord3 rows unbounded preceding)),
rated as (select *, case when t > 0 then least(1.0::double, d / t) end as ratio from counted),
scored as (select *, case when t > 0 then min(ratio) over (partition by Run order by SpecEValue, ScanNum, Ord, Ord2, Ord3 rows between current row and unbounded following) end as FDR from rated)
"""
_ENTITY = """best as (select starts_with(Protein, 'XXX_') as decoy from fx_psm_raw
  qualify row_number() over (partition by {0} order by SpecEValue, Run, ScanNum, Ord, Ord2, Ord3) = 1)
select count(*) filter (not decoy) as targets, count(*) filter (decoy) as decoys, {1} as fdr_percent from best"""

QUERIES = {
    "sic_best_per_scan": sic_best_per_scan,
    "psm_fdr": psm_fdr,
    "psm_fdr_leading_decoys": psm_fdr_leading_decoys,
    "peptide_fdr": peptide_fdr,
    "protein_fdr": protein_fdr,
    "run_totals": run_totals_query,
}
SQL = {
    "sic_best_per_scan": oracle("fx_psm_raw", then=_BEST + " select Run, ScanNum, Peptide, Protein, SpecEValue, ParentIonIntensity from best"),
    "psm_fdr": oracle("fx_psm_raw", then=_BEST + ", " + _FDR.format(source="best") + "select Run, ScanNum, Peptide, Protein, IsDecoy, abs(DelM_PPM) as absPPM, round(FDR, 9) as FDR, round(-log10(case when SpecEValue = 0 then 1 else SpecEValue end), 9) as MSMSScore from scored"),
    "psm_fdr_leading_decoys": oracle("fx_psm_raw", then="shifted as (select * replace (case when SpecEValue < 0.000004 then concat('XXX_', Protein) else Protein end as Protein) from fx_psm_raw), " + _FDR.format(source="shifted") + "select Run, count(*) as rows, count(*) filter (FDR is null) as without_fdr, round(min(FDR), 9) as least, round(max(FDR), 9) as most from scored group by Run"),
    "peptide_fdr": oracle("fx_psm_raw", then=_ENTITY.format("Peptide", "round(100.0 * count(*) filter (decoy) / count(*), 2)")),
    "protein_fdr": oracle("fx_psm_raw", then=_ENTITY.format("Protein", "case when count(*) filter (not decoy) = 0 then 0.0 else round(100.0 * count(*) filter (decoy) / count(*), 2) end")),
    "run_totals": oracle(
        "fx_psm_raw",
        then="""per as (select Run, count(distinct ScanNum) as scans, count(distinct Peptide) as peptides, count(distinct Protein) as proteins,
  count(*) filter (starts_with(Protein, 'XXX_')) as decoys, count(*) filter (not starts_with(Protein, 'XXX_')) as targets from fx_psm_raw group by Run)
select count(*) as files, sum(scans)::bigint as scans, sum(peptides)::bigint as peptides, sum(proteins)::bigint as proteins, sum(decoys)::bigint as decoys,
       sum(targets)::bigint as targets, round(100.0 * sum(decoys) / (sum(decoys) + sum(targets)), 6) as decoy_percent from per""",
    ),
}
