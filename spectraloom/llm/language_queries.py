"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectraloom.llm.language import document_languages, fit, segments
from spectraloom.session import table

#: Characters of its sentences from which on a language counts for a page.
LEAST, LEAST_OF = 200, {"zh": 100}


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    model = fit(table(spark, sf_dir, "lang_samples"))
    return segments(table(spark, sf_dir, "documents"), model, "doc_id", "text", "raw"), model.languages


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of pages whose label is missing, unknown or wrong, or that count more than one."""
    found, known = _segments(spark, sf_dir)
    least = F.lit(LEAST)
    for lang, chars in LEAST_OF.items():
        least = F.when(F.col("lang") == lang, chars).otherwise(least)
    counting = document_languages(found).filter(F.col("chars") >= least)
    page = Window.partitionBy("id")
    # The main language is that of most characters, weighed against what each language needs to count.
    main = F.first("lang").over(page.orderBy(F.desc(F.col("chars") / least), "lang"))
    counted = counting.withColumn("main", main).withColumn("several", F.count(F.lit(1)).over(page) > 1)
    label = F.lower(F.regexp_extract(F.trim("lang"), r"^([^-_]*)", 1))
    labels = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), label.alias("label"))
    wrong = F.coalesce(~F.col("label").isin(known), F.lit(True)) | (F.col("label") != F.col("main"))
    return counted.join(labels, "id").filter(F.col("several") | wrong).select(F.col("id").alias("doc_id"), "lang")


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage in one language of every page, with its language and confidence."""
    found, _ = _segments(spark, sf_dir)
    return found.select(F.col("id").alias("doc_id"), "segment", "lang", F.round("confidence", 6).alias("confidence"), "chars")


QUERIES = {"p8_found": p8_found, "p8_segments": p8_segments}
SQL: dict[str, str] = {}
