"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.leakage import leaks
from spectraloom.session import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold ten or more consecutive words of an item's passage."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: on how many pages it leaked, and the first of them."""
    found = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("pages"), F.min("doc_id").alias("first_doc"))
    return table(spark, sf_dir, "eval_items").select("item_id", "suite").join(found, "item_id", "left").select("item_id", "suite", F.coalesce("pages", F.lit(0)).cast("bigint").alias("pages"), "first_doc")


QUERIES = {"p7_found": p7_found, "p7_leaked_items": p7_leaked_items}
SQL: dict[str, str] = {}
