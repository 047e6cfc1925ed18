"""Queries on files: tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.plans import correction_queries, psm_queries
from spectraloom.plans.compare_queries import _R, rounded
from spectraloom.session import shared_dir, table
from spectraloom.sources import fasta, tables


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _fasta(spark: SparkSession, sf_dir: str) -> str:
    """A FASTA folder of all proteins with a header; a null sequence is an empty one."""
    path = _place(spark, "fasta")
    fasta.write_fasta(table(spark, sf_dir, "protein_fasta").filter("header is not null").withColumn("seq", F.coalesce("seq", F.lit(""))), path)
    return path


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fasta.read_fasta(spark, _fasta(spark, sf_dir)).select("id", "header", "seq")


def fasta_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fasta.read_peptides(spark, _fasta(spark, sf_dir), shortest=30, ignore_il=True)


def fasta_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fasta.sequences_by_id(fasta.canonical_only(fasta.read_fasta(spark, _fasta(spark, sf_dir))))


def fasta_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every protein under its first word and under its whole header."""
    return fasta.lookup_keys(fasta.read_fasta(spark, _fasta(spark, sf_dir)))


def numbered_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digested peptides under numbered headers, as written and read back."""
    path = _place(spark, "numbered")
    fasta.write_fasta(fasta.numbered_headers(psm_queries.digest_map(spark, sf_dir).select("Peptide"), "pep_"), path)
    return fasta.read_fasta(spark, path).select("id", "seq")


def syn_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """psm_syn as a tab-separated table with other column names, read back with its derived columns."""
    path = _place(spark, "syn")
    rows = table(spark, sf_dir, "psm_syn").select(F.col("ScanNum").alias("Scan"), "Peptide", F.regexp_replace("Protein", r"[\t\r\n]", " ").alias("Protein"), F.col("SpecEValue").alias("MSGFDB_SpecEValue"), "QValue", F.col("RowID").cast("double").alias("MSGFScore"))
    tables.write_tsv(rows, path)
    back = tables.read_syn(spark, path)
    return back.select(F.col("MSGFScore").cast("bigint").alias("RowID"), "ScanNum", "Peptide", "Protein", "SpecEValue", "QValue", "CorePeptide", "IsDecoy", "SourceLayer")


def formula_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchors of every condition's formula, read back from their documents."""
    path = _place(spark, "formulas")
    tables.write_formulas(correction_queries.curve(spark, sf_dir), path)
    return rounded(tables.read_formulas(spark, path))


_HEADS = "heads as (select regexp_extract(trim(header), '^\\S*') as id, trim(header) as header, coalesce(seq, '') as seq from protein_fasta where header is not null)"
_NULLS = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"

QUERIES = {
    "fasta_round_trip": fasta_round_trip, "fasta_peptides": fasta_peptides, "fasta_by_id": fasta_by_id, "fasta_lookup": fasta_lookup, "numbered_peptides": numbered_peptides, "syn_table": syn_table, "formula_round_trip": formula_round_trip,
}
SQL = {
    "fasta_round_trip": f"with {_HEADS} select * from heads",
    "fasta_peptides": f"with {_HEADS} select distinct translate(upper(seq), 'I', 'L') as Peptide from heads where regexp_matches(upper(seq), '^[A-Z]+$') and length(seq) >= 30",
    "fasta_by_id": f"with {_HEADS} select id, seq from heads where seq <> '' and not regexp_matches(seq, '[^ACDEFGHIKLMNPQRSTVWY]')",
    "fasta_lookup": f"with {_HEADS} select id as key, seq from heads union select header, seq from heads",
    "numbered_peptides": psm_queries.oracle("fx_protein", then=psm_queries._DIGEST + " select concat('pep_', row_number() over (order by Peptide)) as id, Peptide as seq from mapped"),
    "syn_table": f"""with x as (select RowID, ScanNum, case when Peptide not in {_NULLS} then Peptide end as Peptide, case when regexp_replace(Protein, '[\\t\\r\\n]', ' ', 'g') not in {_NULLS} then regexp_replace(Protein, '[\\t\\r\\n]', ' ', 'g') end as Protein, case when not isnan(SpecEValue) then SpecEValue end as SpecEValue, case when not isnan(QValue) then QValue end as QValue from psm_syn)
 select *, {psm_queries._C} as CorePeptide, coalesce(len(list_filter(regexp_split_to_array(Protein, '[;,\\s]+'), lambda p: starts_with(p, 'XXX_'))) > 0, false) as IsDecoy, 'SYN' as SourceLayer from x""",
    "formula_round_trip": correction_queries._UP_TO + f" select grp, {_R('fdr_anchor', 'fdr_anchor')}, {_R('c', 'corrected')} from curve",
}
