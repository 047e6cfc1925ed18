"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.residues import residues
from spectraloom.llm.spans import shared_spans
from spectraloom.session import table

SPAN = 16


def _peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "target_peptides").select("peptide_id", residues(F.col("t1")).alias("seq"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of residues shared with another peptide or its reversed residues."""
    return shared_spans(_peptides(spark, sf_dir), "peptide_id", "seq", SPAN, both_ways=True)


def p4_shared_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every peptide is shared: residues, windows and the fraction of its length."""
    peptides = _peptides(spark, sf_dir)
    spans = p4_found(spark, sf_dir).groupBy("peptide_id").agg(
        F.sum(F.col("span_end") - F.col("span_start") + 1).alias("shared"), F.count(F.lit(1)).alias("spans")
    )
    joined = peptides.join(spans, "peptide_id", "left")
    shared = F.coalesce("shared", F.lit(0)).cast("bigint")
    return joined.select("peptide_id", F.length("seq").cast("bigint").alias("residues"), shared.alias("shared_residues"), F.coalesce("spans", F.lit(0)).cast("bigint").alias("spans"), F.round(shared / F.nullif(F.length("seq"), F.lit(0)), 6).alias("shared_frac"))


_RESIDUES = """
peptides as (
  select peptide_id, regexp_replace(upper(regexp_replace(regexp_replace(t1, '^\\s+|\\s+$', '', 'g'), '^[A-Za-z\\-]\\.(.*)\\.[A-Za-z\\-]$', '\\1')), '[^A-Z]', '', 'g') as seq
  from target_peptides
)"""
_SPANS = (
    "with "
    + _RESIDUES
    + """,
windows as (
  select peptide_id, pos, substr(seq, pos, 16) as w from (select peptide_id, seq, unnest(range(1, greatest(length(seq) - 14, 1))) as pos from peptides)
),
sources as (
  select peptide_id, w from windows
  union
  select peptide_id, substr(r, pos, 16) from (select peptide_id, reverse(seq) as r, unnest(range(1, greatest(length(seq) - 14, 1))) as pos from peptides)
),
several as (select w from sources group by w having min(peptide_id) <> max(peptide_id)),
hits as (select peptide_id, pos, lag(pos) over (partition by peptide_id order by pos) as earlier from windows where w in (select w from several)),
runs as (select peptide_id, pos, sum(case when earlier is null or pos > earlier + 16 then 1 else 0 end) over (partition by peptide_id order by pos) as run from hits),
spans as (select peptide_id, cast(min(pos) as integer) as span_start, cast(max(pos) + 15 as integer) as span_end from runs group by peptide_id, run)
"""
)

QUERIES = {"p4_found": p4_found, "p4_shared_amount": p4_shared_amount}
SQL = {
    "p4_found": _SPANS + "select peptide_id, span_start, span_end from spans",
    "p4_shared_amount": _SPANS
    + """
select p.peptide_id, length(seq) as residues, cast(coalesce(sum(span_end - span_start + 1), 0) as bigint) as shared_residues,
       count(span_start) as spans, round(coalesce(sum(span_end - span_start + 1), 0) / nullif(length(seq), 0), 6) as shared_frac
from peptides p left join spans s on p.peptide_id = s.peptide_id
group by p.peptide_id, seq
""",
}
