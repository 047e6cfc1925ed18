"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.quantiles import day_summaries, percentiles, ranks, whole_summaries
from spectraloom.session import materialize, table

COLUMNS = ("BaseFDR", "BinnedFDRMedian", "DeltaBinnedMedianMinusBase")
PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
EPSILON = 0.005


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(day_summaries(table(spark, sf_dir, "fdr_compare_wide"), "ConditionName", COLUMNS, "LoadedAt", EPSILON), "quantile-days")


def p5_fdr_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the three FDR columns per condition over all load days, with their rank error."""
    return percentiles(_days(spark, sf_dir), PROBS, EPSILON).withColumnRenamed("grp", "ConditionName")


def p5_value_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each value of the three FDR columns stands among those of its condition: bounds of its rank, and the percentile between them."""
    whole = materialize(whole_summaries(_days(spark, sf_dir), EPSILON), "quantile-whole")
    placed = ranks(table(spark, sf_dir, "fdr_compare_wide"), "ConditionName", COLUMNS, whole, keep=["ScanNum", "CorePeptide", "LoadedAt"])
    percentile = F.round((F.col("rank_low") + 1 + F.col("rank_high")) / 2 / F.col("n"), 6)
    return placed.select("ScanNum", "CorePeptide", "LoadedAt", F.col("grp").alias("ConditionName"), "measure", F.col("x").alias("value"), "rank_low", "rank_high", "n", percentile.alias("percentile"))


def p5_within_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each percentile held against exact counts over the whole table: is it off by no more than it says, and that by no more than EPSILON n?"""
    found = materialize(p5_fdr_percentiles(spark, sf_dir), "quantile-answers")
    rows = table(spark, sf_dir, "fdr_compare_wide")
    long = rows.select(F.col("ConditionName").alias("c"), F.explode(F.array(*[F.struct(F.lit(name).alias("m"), F.col(name).alias("x")) for name in COLUMNS])).alias("s")).select("c", "s.*").filter("x is not null and not isnan(x)")
    # Equal values are counted first: what meets the answers is one row per value.
    values = long.groupBy("c", "m", "x").agg(F.count(F.lit(1)).alias("k"))
    met = values.join(found, F.col("c").eqNullSafe(F.col("ConditionName")) & (F.col("m") == F.col("measure")))
    ranked = met.groupBy("ConditionName", "measure", "prob", "value", "rank_no", "rank_error", "n").agg(F.sum(F.when(F.col("x") < F.col("value"), F.col("k")).otherwise(0)).alias("lt"), F.sum(F.when(F.col("x") <= F.col("value"), F.col("k")).otherwise(0)).alias("le"))
    off = F.greatest(F.lit(0), F.col("lt") + 1 - F.col("rank_no"), F.col("rank_no") - F.col("le"))
    return ranked.select("ConditionName", "measure", "prob", "n", (off <= F.col("rank_error")).alias("within_stated"), (F.col("rank_error") <= EPSILON * F.col("n")).alias("within_epsilon"))


QUERIES = {"p5_value_ranks": p5_value_ranks, "p5_fdr_percentiles": p5_fdr_percentiles, "p5_within_bound": p5_within_bound}
SQL = {
    "p5_within_bound": " union all ".join(
        f"""select ConditionName, '{name}' as measure, prob, count(*) as n, true as within_stated, true as within_epsilon
        from fdr_compare_wide, (select unnest([{", ".join(map(str, PROBS))}]::double[]) as prob) where {name} is not null and not isnan({name}) group by 1, 2, 3"""
        for name in COLUMNS
    )
}
