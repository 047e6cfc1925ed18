"""Queries on names, flags, partition folders, cluster listings and the checks of recovery tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.fixtures import fixture, oracle
from spectraloom.functions.scalars import accession_keys, boolish, finite, normal_peptide
from spectraloom.operators import collate, conflicts
from spectraloom.plans.compare_queries import _R, rounded
from spectraloom.plans.source_queries import _fasta, _place
from spectraloom.session import table
from spectraloom.sources import fasta, tables

_HEADED = "header is not null"


def accession_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every protein under the six ways to name it."""
    proteins = table(spark, sf_dir, "protein_fasta").filter(_HEADED)
    return proteins.select("protein_id", *[key.alias(name) for name, key in accession_keys("header").items()])


def cluster_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of protein ids, as a listing that is written and read back."""
    path = _place(spark, "clusters")
    members = table(spark, sf_dir, "protein_fasta").filter("cluster_no is not null and protein_id is not null").groupBy("cluster_no").agg(F.array_sort(F.collect_list("protein_id")).alias("ids"))
    line = F.transform("ids", lambda ident, at: F.concat(at.cast("string"), F.lit("\t9aa, >"), ident, F.lit("... *")))
    members.select(F.concat(F.lit(">Cluster "), (F.col("cluster_no").cast("int") - 1).cast("string"), F.lit("\n"), F.array_join(line, "\n"))).write.text(path)
    return fasta.read_clusters(spark, path)


def clustered_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with the cluster that a listing by accession, by whole first word or by neither gives."""
    proteins = table(spark, sf_dir, "protein_fasta").filter(_HEADED)
    keys = accession_keys("header")
    listed = proteins.filter("cluster_no is not null").select(F.coalesce(keys["uniprot"], keys["raw"]).alias("seq_id"), F.col("cluster_no").alias("cluster"))
    return conflicts.header_clusters(proteins.select("protein_id", "header"), "header", listed.groupBy("seq_id").agg(F.min("cluster").alias("cluster"))).select("protein_id", "Cluster", "ClusteredHeader")


def fasta_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and description of every record of a FASTA folder."""
    return fasta.protein_info(fasta.read_fasta(spark, _fasta(spark, sf_dir)))


def normal_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peptides as given: trimmed, in upper case, with I as L, and whether they are letters only."""
    text = normal_peptide("t1", ignore_il=True)
    return table(spark, sf_dir, "target_peptides").select("peptide_id", text.alias("Peptide"), text.rlike("^[A-Z]+$").alias("valid"))


def flag_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags spelled in five ways, read back and counted per condition."""
    spelled = lambda c: F.when(F.col(c), F.element_at(F.array(*map(F.lit, ("True", " 1 ", "YES", "y", "t"))), (F.col("ScanNum") % 5 + 1).cast("int"))).when(~F.col(c), F.element_at(F.array(*map(F.lit, ("False", "0", "no", "", "f"))), (F.col("ScanNum") % 5 + 1).cast("int")))
    rows = table(spark, sf_dir, "fdr_compare_wide").select("ConditionName", spelled("InBase").alias("base"), spelled("InBinning").alias("binning"))
    return rows.groupBy("ConditionName").agg(F.count_if(boolish("base")).alias("base"), F.count_if(boolish("binning")).alias("binning"), F.count_if(boolish("base", ("true", "1", "yes", "y"))).alias("strict_base"))


def finite_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per condition: rows whose three measures are all finite, and what they come to."""
    measures = ("BaseFDR", "BinnedFDRMedian", "DeltaBinnedMedianMinusBase")
    kept = table(spark, sf_dir, "fdr_compare_wide").filter(finite(measures[0]) & finite(measures[1]) & finite(measures[2]))
    return rounded(kept.groupBy("ConditionName").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in measures]))


def _recovery(rows: DataFrame) -> DataFrame:
    """A recovery table of the comparison: what binning finds again of each status and condition; unknown flags show as faults."""
    got = F.col("InBinning")
    counts = rows.groupBy("ConditionName", "ComparisonStatus").agg(
        F.count("InBase").alias("total"), F.count_if(got).alias("recovered"), F.count_if(~got).alias("unrecovered"),
        F.count_if(got & F.col("InBase")).alias("recovered_sic"), F.count_if(got & ~F.col("InBase")).alias("recovered_syn"), F.count_if(got & F.col("BaseFDR").isNotNull()).alias("__with"),
    )
    return counts.withColumn("fraction", F.try_divide("__with", "total")).drop("__with")


def recovery_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a recovery table that contradict themselves, with the reasons."""
    faults = collate.recovery_faults(_recovery(table(spark, sf_dir, "fdr_compare_wide")))
    return rounded(faults.withColumn("faults", F.array_join("faults", ";")))


def recovery_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recovery table with the gains of each condition beside it."""
    rows = table(spark, sf_dir, "fdr_compare_wide")
    count = lambda side: rows.filter(side).groupBy("ConditionName").agg(F.count_distinct("CorePeptide").alias("Peptides"))
    found = collate.gains(count("InBase"), count("InBinning"), ["ConditionName"], ["Peptides"])
    return collate.recovery_with_gains(_recovery(rows).select("ConditionName", "ComparisonStatus", "total", "recovered"), found, "ConditionName")


def partition_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations written as a folder per partition and read back as one table with what the folders' names say."""
    path = _place(spark, "partitions")
    rows = fixture(spark, sf_dir, "fx_partition_obs").select(F.col("RunFolder").alias("folder"), F.col("ScanNum").cast("string").alias("Scan"), "Peptide")
    rows.repartition("folder").write.partitionBy("folder").option("sep", "\t").option("header", True).csv(path)
    back = tables.read_partitions(spark, f"{path}/folder=*/*")
    return back.groupBy("PartitionType", "PartitionID", "Group", "PairGroupA", "PairGroupB").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("Peptide").alias("peptides"), F.sum(F.col("Scan").cast("bigint")).alias("scans"))


def first_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows alike in scan, peptide and proteins the one loaded first."""
    keys = ["ScanNum", "Peptide", "Protein"]
    return fasta.first_per_key(table(spark, sf_dir, "psm_syn").select("RowID", "LoadedAt", *keys), keys, ["LoadedAt", "RowID"]).select("RowID", *keys)


_NAMED = f"""named as (select protein_id, header, cluster_no, regexp_extract(trim(header), '^\\S*') as raw from protein_fasta where {_HEADED}),
 keyed as (select *, case when len(string_split(raw, '|')) >= 3 and string_split(raw, '|')[1] in ('sp', 'tr') then string_split(raw, '|')[2] end as uniprot,
  case when len(string_split(raw, '|')) >= 2 then string_split(raw, '|')[2] end as pipe, trim(regexp_replace(header, '^\\S+\\s*', '')) as description,
  regexp_replace(raw, '\\.\\d+$', '') as no_version, regexp_replace(header, '\\s+', '', 'g') as no_space from named)"""
_RECOVERY = """rec as (select ConditionName, ComparisonStatus, count(InBase) as total, count(*) filter (InBinning) as recovered, count(*) filter (not InBinning) as unrecovered, count(*) filter (InBinning and InBase) as recovered_sic,
  count(*) filter (InBinning and not InBase) as recovered_syn, case when count(InBase) > 0 then count(*) filter (InBinning and BaseFDR is not null) / count(InBase) end as fraction from fdr_compare_wide group by all)"""
_FINITE = " and ".join(f"{m} is not null and isfinite({m})" for m in ("BaseFDR", "BinnedFDRMedian", "DeltaBinnedMedianMinusBase"))

QUERIES = {
    "accession_names": accession_names, "cluster_listing": cluster_listing, "clustered_headers": clustered_headers, "fasta_info": fasta_info, "normal_peptides": normal_peptides, "flag_spellings": flag_spellings,
    "finite_pairs": finite_pairs, "recovery_audit": recovery_audit, "recovery_gains": recovery_gains, "partition_folders": partition_folders, "first_delivery": first_delivery,
}
SQL = {
    "accession_names": f"with {_NAMED} select protein_id, uniprot, pipe, raw, description, no_version, no_space from keyed",
    "cluster_listing": "select protein_id as seq_id, lpad(cast(cast(cluster_no as integer) as varchar), 4, '0') as cluster from protein_fasta where cluster_no is not null and protein_id is not null",
    "clustered_headers": f"""with {_NAMED}, listed as (select coalesce(uniprot, raw) as seq_id, min(cluster_no) as cluster from keyed where cluster_no is not null group by all),
 hit as (select protein_id, header, coalesce({", ".join(f"(select cluster from listed where seq_id = {k})" for k in ("uniprot", "pipe", "raw", "description", "no_version", "no_space"))}, 'Unassigned') as Cluster from keyed)
 select protein_id, Cluster, concat(header, ' Cluster=', Cluster) as ClusteredHeader from hit""",
    "fasta_info": f"with {_NAMED} select raw as id, nullif(regexp_extract(trim(header), 'Cluster=(\\S+)', 1), '') as cluster, regexp_replace(trim(header), '^\\S+\\s*', '') as tail from named",
    "normal_peptides": "select peptide_id, translate(upper(trim(t1)), 'I', 'L') as Peptide, regexp_matches(translate(upper(trim(t1)), 'I', 'L'), '^[A-Z]+$') as valid from target_peptides",
    "flag_spellings": "select ConditionName, count(*) filter (InBase and ScanNum is not null) as base, count(*) filter (InBinning and ScanNum is not null) as binning, count(*) filter (InBase and ScanNum % 5 <> 4) as strict_base from fdr_compare_wide group by all",
    "finite_pairs": f"select ConditionName, count(*) as n, {_R('avg(BaseFDR)', 'BaseFDR')}, {_R('avg(BinnedFDRMedian)', 'BinnedFDRMedian')}, {_R('avg(DeltaBinnedMedianMinusBase)', 'DeltaBinnedMedianMinusBase')} from fdr_compare_wide where {_FINITE} group by all",
    "recovery_audit": f"""with {_RECOVERY}, f as (select * exclude (fraction), {_R('fraction', 'fraction')}, concat_ws(';', case when recovered + unrecovered <> total then 'sum' end, case when recovered > total then 'range' end,
  case when recovered_sic + recovered_syn < recovered then 'layers' end, case when recovered_sic > recovered then 'sic' end, case when abs(fraction - recovered / total) > 1e-9 then 'fraction' end) as faults from rec) select * from f where faults <> ''""",
    "recovery_gains": f"""with {_RECOVERY}, g as (select ConditionName, count(distinct CorePeptide) filter (InBase) as b, count(distinct CorePeptide) filter (InBinning) as c from fdr_compare_wide where InBase or InBinning group by all)
 select rec.ConditionName, ComparisonStatus, total, recovered, b as BaselinePeptides, c as CorrectedPeptides, c - b as PeptidesGain from rec left join g on rec.ConditionName = g.ConditionName""",
    "partition_folders": oracle("fx_partition_obs", then="""select 'group' as PartitionType, concat('group_', n) as PartitionID, n as "Group", cast(null as integer) as PairGroupA, cast(null as integer) as PairGroupB, count(*) as n, count(distinct Peptide) as peptides, cast(sum(ScanNum) as bigint) as scans
 from (select *, cast(regexp_extract(RunFolder, '(\\d+)$', 1) as integer) as n from fx_partition_obs) group by all"""),
    "first_delivery": "select RowID, ScanNum, Peptide, Protein from psm_syn qualify row_number() over (partition by ScanNum, Peptide, Protein order by LoadedAt nulls first, RowID nulls first) = 1",
}
