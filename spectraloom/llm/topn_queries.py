"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.topn import top_n
from spectraloom.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best candidates of every scan by SpecEValue, then RowID."""
    rows = table(spark, sf_dir, "psm_syn").filter("ScanNum is not null and SpecEValue > 0 and not isnan(SpecEValue)")
    candidates = rows.groupBy("ScanNum", "Charge", "Peptide", "Protein", "SpecEValue").agg(F.min("RowID").alias("RowID"))
    best = top_n(candidates, "ScanNum", "SpecEValue", "RowID", 3, unique=True)
    return best.select(F.col("ScanNum").alias("scannum"), "rank_no", F.col("RowID").alias("rowid"))


QUERIES = {"p3_found": p3_found}
SQL = {
    "p3_found": """
with candidates as (
  select ScanNum, SpecEValue, min(RowID) as RowID
  from psm_syn
  where ScanNum is not null and SpecEValue > 0 and not isnan(SpecEValue)
  group by ScanNum, Charge, Peptide, Protein, SpecEValue
), ranked as (
  select ScanNum, RowID, row_number() over (partition by ScanNum order by SpecEValue, RowID) as rank_no
  from candidates
)
select ScanNum as scannum, cast(rank_no as integer) as rank_no, RowID as rowid from ranked where rank_no <= 3
"""
}
