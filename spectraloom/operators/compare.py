"""Full-database FDR against partition FDR."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.scalars import core_peptide, interval_label, interval_name, is_decoy, joined_capped, number
from spectraloom.operators.quantile import attach, exact_percentiles, percentiles_of

KEYS = ["ScanNum", "CorePeptide"]
STATISTICS = ("Mean", "Median", "Min", "Max")
#: Edges of the reported intervals of the base FDR (fixed values).
EDGES = [0.0, 0.001, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.075, 0.1, 0.2, 0.5, 1.0]


def base_summary(base: DataFrame) -> DataFrame:
    """The full-database search per (ScanNum, CorePeptide)."""
    return base.withColumn("CorePeptide", core_peptide("Peptide")).groupBy(*KEYS).agg(
        F.median("FDR").alias("BaseFDR"), F.avg("FDR").alias("BaseFDRMean"), F.min("FDR").alias("BaseFDRMin"), F.max("FDR").alias("BaseFDRMax"), F.count(F.lit(1)).alias("BaseRows"),
        joined_capped(F.collect_set("Peptide")).alias("BasePeptideForms"), F.count_distinct("Protein").alias("BaseProteinCount"), F.bool_or(is_decoy("Protein")).alias("BaseAnyDecoy"),
    )


def compare(base: DataFrame, binned: DataFrame) -> DataFrame:
    """Full outer join of both summaries with ComparisonStatus, deltas and what each side has."""
    a, b = base.withColumn("InBase", F.lit(True)), binned.withColumn("InBinning", F.lit(True))
    joint = a.join(b, KEYS, "full").withColumns({"InBase": F.coalesce("InBase", F.lit(False)), "InBinning": F.coalesce("InBinning", F.lit(False))})
    status = F.when(F.col("InBase") & F.col("InBinning"), "shared").when(F.col("InBase"), "base_only").otherwise("binning_only")
    deltas = {f"DeltaBinned{s}MinusBase": F.col(f"BinnedFDR{s}") - F.col("BaseFDR") for s in STATISTICS if f"BinnedFDR{s}" in binned.columns}
    return joint.withColumn("ComparisonStatus", status).withColumns(deltas)


def passes(x: str, threshold: float) -> Column:
    return F.coalesce(number(x) <= threshold, F.lit(False))


def with_pass_columns(wide: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Adds BasePass_0p01 and the like."""
    made = {}
    for t in thresholds:
        tag = str(t).replace(".", "p")
        made[f"BasePass_{tag}"] = passes("BaseFDR", t)
        made |= {f"Binned{s}Pass_{tag}": passes(f"BinnedFDR{s}", t) for s in STATISTICS if f"BinnedFDR{s}" in wide.columns}
    return wide.withColumns(made)


def threshold_report(wide: DataFrame, thresholds: Sequence[float], statistics: Sequence[str]) -> DataFrame:
    """Per threshold, statistic and scope: keys and distinct peptides that pass on either side.

    Each row is unfolded over the combinations once and pre-aggregated by
    peptide, so that distinct counts need no further shuffle of the rows.
    """
    combos = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s.lower()).alias("s"), passes("BaseFDR", t).alias("b"), passes(f"BinnedFDR{s}", t).alias("p")) for t in thresholds for s in statistics])
    scopes = F.when(F.col("ComparisonStatus") == "shared", F.array(F.lit("all"), F.lit("shared"))).otherwise(F.array(F.lit("all")))
    long = wide.select("UnmodifiedPeptide", F.explode(combos).alias("c"), scopes.alias("scopes")).select("UnmodifiedPeptide", "c.*", F.explode("scopes").alias("Scope"))
    flags = {"BasePass": "b", "BinnedPass": "p", "PassBoth": "b and p", "BasePass_BinnedFail": "b and not p", "BaseFail_BinnedPass": "not b and p"}
    by_peptide = long.groupBy(F.col("t").alias("Threshold"), F.col("s").alias("BinnedStatistic"), "Scope", "UnmodifiedPeptide").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(e)).alias(name) for name, e in flags.items()])
    known = F.col("UnmodifiedPeptide").isNotNull()
    return by_peptide.groupBy("Threshold", "BinnedStatistic", "Scope").agg(
        F.sum("n").alias("TotalKeys"), *[F.sum(name).alias(f"{name}Keys") for name in flags],
        F.count_if(known).alias("UniquePeptides_Total"), *[F.count_if(known & (F.col(name) > 0)).alias(f"UniquePeptides_{name}") for name in flags],
    )


def shared_rows(wide: DataFrame, dataset: str, statistic: str = "Median") -> DataFrame:
    """(Dataset, BaseFDR, BinnedFDR, DeltaFDR, UnmodifiedPeptide) of shared keys with finite values."""
    base, binned = number("BaseFDR"), number(f"BinnedFDR{statistic}")
    rows = wide.filter("ComparisonStatus = 'shared'").select(F.col(dataset).alias("Dataset"), base.alias("BaseFDR"), binned.alias("BinnedFDR"), (binned - base).alias("DeltaFDR"), "UnmodifiedPeptide")
    return rows.filter("BaseFDR is not null and BinnedFDR is not null")


def bias_corrected(skew: Column, kurt: Column, n: Column) -> tuple[Column, Column]:
    """Sample skewness (n >= 3) and excess kurtosis (n >= 4) from the population forms."""
    return F.when(n >= 3, skew * F.sqrt(n * (n - 1)) / (n - 2)), F.when(n >= 4, ((n + 1) * kurt + 6) * (n - 1) / ((n - 2) * (n - 3)))


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``x``, which is computed once however often ``then`` names it."""
    return F.transform(F.array(x), then)[0]


def k_squared(skew: Column, kurt: Column, n: Column) -> tuple[Column, Column]:
    """D'Agostino's K-squared from the population moments, and its p-value (chi-squared with two degrees of freedom)."""

    def z1(g: Column, n: Column) -> Column:
        b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
        scaled = lambda w2: let(g * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2))) / F.sqrt(2 / (w2 - 1)), lambda y: F.log(y + F.sqrt(y * y + 1)) / F.sqrt(0.5 * F.log(w2)))
        return let(F.sqrt(2 * (b2 - 1)) - 1, scaled)

    def z2(k: Column, n: Column) -> Column:
        var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
        beta = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
        score = lambda a, ratio: (1 - 2 / (9 * a) - F.signum(ratio) * F.pow(F.abs(ratio), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
        shape = let(beta, lambda s: 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s))))
        return let(shape, lambda a: let((1 - 2 / a) / (1 + (k + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(var) * F.sqrt(2 / (a - 4))), lambda r: score(a, r)))

    def both(m: Column) -> Column:
        return let(z1(m["g"], m["n"]), lambda a: a * a) + let(z2(m["k"], m["n"]), lambda b: b * b)

    moments = F.struct(skew.alias("g"), kurt.alias("k"), n.cast("double").alias("n"))
    k2 = let(moments, both)
    return k2, let(k2, lambda v: F.exp(-v / 2))


def delta_statistics(wide: DataFrame, value: str, delta: str, edges: Sequence[float]) -> DataFrame:
    """Per interval of ``value``: 19 statistics of ``delta``, with D'Agostino's test from 20 values on."""
    rows = wide.select(interval_label(number(value), list(edges)).alias("Interval"), number(delta).alias("d"), "UnmodifiedPeptide").filter("Interval is not null")
    n, d = F.count("d"), F.col("d")
    skew, kurt = bias_corrected(F.skewness("d"), F.kurtosis("d"), n)
    test = F.when(n < 8, "not_run_n_lt_8").when(n < 20, "not_run_shapiro").otherwise("DAgostinoK2")
    stats = rows.groupBy("Interval").agg(
        F.count(F.lit(1)).alias("N_ScanPeptideKeys"), F.count_distinct("UnmodifiedPeptide").alias("N_UniquePeptides"), F.avg("d").alias("DeltaMean"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("DeltaStd"),
        F.min("d").alias("DeltaMin"), F.max("d").alias("DeltaMax"), skew.alias("Skew"), kurt.alias("ExcessKurtosis"),
        (F.count_if(d < 0) / n).alias("FractionNegative"), (F.count_if(d > 0) / n).alias("FractionPositive"), (F.count_if(d == 0) / n).alias("FractionZero"),
        test.alias("NormalityTest"), F.skewness("d").alias("__g"), F.kurtosis("d").alias("__k"), n.alias("__n"),
    ).filter("DeltaMean is not null")
    k2, p = k_squared(F.col("__g"), F.col("__k"), F.col("__n"))
    tested = F.col("__n") >= 20
    stats = stats.withColumns({"NormalityStatistic": F.when(tested, k2), "NormalityPValue": F.when(tested, p)}).drop("__g", "__k", "__n")
    quantiles = {"DeltaMedian": 0.5, "DeltaQ01": 0.01, "DeltaQ05": 0.05, "DeltaQ25": 0.25, "DeltaQ75": 0.75, "DeltaQ95": 0.95, "DeltaQ99": 0.99}
    return attach(stats, exact_percentiles(rows, ["Interval"], "d", quantiles), ["Interval"])


def overall_summary(rows: DataFrame) -> DataFrame:
    """Per dataset: means, medians, quantiles of the delta, and how many improved, stayed or worsened."""
    d = F.col("DeltaFDR")
    out = rows.groupBy("Dataset").agg(
        F.count(F.lit(1)).alias("N"), F.avg("BaseFDR").alias("BaseFDRMean"), F.avg("BinnedFDR").alias("BinnedFDRMean"), F.avg("DeltaFDR").alias("DeltaFDRMean"),
        F.count_if(d < 0).alias("ImprovedCount"), F.count_if(F.abs(d) <= 1e-15).alias("UnchangedCount"), F.count_if(d > 0).alias("WorsenedCount"),
        F.avg((d < 0).cast("int")).alias("ImprovedFraction"), F.avg((d > 0).cast("int")).alias("WorsenedFraction"), F.count_distinct("UnmodifiedPeptide").alias("UniquePeptides"),
    )
    quantiles = {"BaseFDR": {"BaseFDRMedian": 0.5}, "BinnedFDR": {"BinnedFDRMedian": 0.5}, "DeltaFDR": {"DeltaFDRMedian": 0.5, "DeltaFDRQ05": 0.05, "DeltaFDRQ25": 0.25, "DeltaFDRQ75": 0.75, "DeltaFDRQ95": 0.95}}
    return attach(out, percentiles_of(rows, ["Dataset"], quantiles), ["Dataset"])


def delta_histogram(rows: DataFrame, buckets: int = 40) -> DataFrame:
    """(Dataset, Bucket, Low, High, N): the data of the delta's histogram over [-1, 1]; the last bucket includes 1."""
    width = 2 / buckets
    bucket = F.least(F.floor((F.col("DeltaFDR") + 1) / width), F.lit(buckets - 1)).cast("int")
    counted = rows.groupBy("Dataset", bucket.alias("Bucket")).agg(F.count(F.lit(1)).alias("N"))
    return counted.select("Dataset", "Bucket", (F.col("Bucket") * width - 1).alias("Low"), ((F.col("Bucket") + 1) * width - 1).alias("High"), "N")


def interval_summary(rows: DataFrame, edges: Sequence[float] = tuple(EDGES)) -> DataFrame:
    """Per dataset and interval of the base FDR, empty ones too: the delta's mean, quartiles and signs."""
    spark, d = rows.sparkSession, F.col("DeltaFDR")
    edges = list(edges)
    intervals = spark.createDataFrame([(interval_name(edges, k), a, b, (a + b) / 2) for k, (a, b) in enumerate(zip(edges, edges[1:]))], "BaseFDRInterval string, IntervalLeft double, IntervalRight double, IntervalMidpoint double")
    labelled = rows.withColumn("BaseFDRInterval", interval_label(F.col("BaseFDR"), edges)).filter("BaseFDRInterval is not null")
    keys = ["Dataset", "BaseFDRInterval"]
    stats = labelled.groupBy(*keys).agg(F.count("DeltaFDR").alias("N"), F.avg("DeltaFDR").alias("DeltaFDRMean"), F.avg((d < 0).cast("int")).alias("ImprovedFraction"), F.avg((d > 0).cast("int")).alias("WorsenedFraction"))
    stats = attach(stats, exact_percentiles(labelled, keys, "DeltaFDR", {"DeltaFDRMedian": 0.5, "DeltaFDRQ25": 0.25, "DeltaFDRQ75": 0.75}), keys)
    # Twelve intervals for every dataset.
    every = rows.select("Dataset").distinct().crossJoin(F.broadcast(intervals))
    return attach(every, stats, keys, "left").withColumn("N", F.coalesce("N", F.lit(0)))


def threshold_summary(rows: DataFrame, thresholds: Sequence[float] = (0.01, 0.05)) -> DataFrame:
    """Per dataset and threshold: keys that pass on either side, gained and lost, with their distinct peptides."""
    long = rows.withColumn("Threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    b, p = F.col("BaseFDR") <= F.col("Threshold"), F.col("BinnedFDR") <= F.col("Threshold")
    return long.groupBy("Dataset", "Threshold").agg(
        F.count(F.lit(1)).alias("N"), F.count_if(b).alias("BasePassCount"), F.count_if(p).alias("PartitionPassCount"), (F.count_if(p) - F.count_if(b)).alias("NetPassChange"),
        F.count_if(~b & p).alias("GainedPassCount"), F.count_if(b & ~p).alias("LostPassCount"), F.count_if(b & p).alias("PassBothCount"),
        F.count_distinct(F.when(~b & p, F.col("UnmodifiedPeptide"))).alias("GainedUniquePeptides"), F.count_distinct(F.when(b & ~p, F.col("UnmodifiedPeptide"))).alias("LostUniquePeptides"),
    )
