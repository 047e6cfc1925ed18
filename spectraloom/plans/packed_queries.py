"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.operators.packed import split_packed
from spectraloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every psm_syn row whose ``Protein`` holds two or more."""
    rows = table(spark, sf_dir, "psm_syn")
    known = table(spark, sf_dir, "protein_fasta")
    found = split_packed(rows, "Protein", known, "protein_id", keep=["RowID"], value="protein", least=2)
    return found.select(F.col("RowID").cast("bigint").alias("rowid"), "pos", "protein")


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
