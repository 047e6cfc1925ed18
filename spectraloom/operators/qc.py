"""How alike target and decoy sets are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.scalars import peptide_mass
from spectraloom.operators import ordered
from spectraloom.operators.ordered import running
from spectraloom.operators.quantile import exact_percentiles


def overlap(targets: DataFrame, decoys: DataFrame) -> DataFrame:
    """One row: distinct targets and decoys, how many are both, and palindromes. Both are distinct (Peptide)."""
    tagged = targets.select("Peptide", F.lit(1).alias("t"), F.lit(0).alias("d")).unionByName(decoys.select("Peptide", F.lit(0).alias("t"), F.lit(1).alias("d")))
    sides = tagged.groupBy("Peptide").agg(F.max("t").alias("t"), F.max("d").alias("d"))
    same = F.col("Peptide") == F.reverse("Peptide")
    counts = sides.agg(F.sum("t").alias("targets"), F.sum("d").alias("decoys"), F.count_if((F.col("t") == 1) & (F.col("d") == 1)).alias("overlap"), F.count_if(same & (F.col("t") == 1)).alias("palindromes"))
    part = lambda n: F.round(F.try_divide(F.col("overlap"), F.col(n)), 9)
    return counts.withColumns({"overlap_of_targets": part("targets"), "overlap_of_decoys": part("decoys")})


def kolmogorov_smirnov(a: DataFrame, b: DataFrame, value: Column) -> DataFrame:
    """One row ``ks``: the largest gap between both distributions of ``value``; nulls are left aside."""
    tagged = a.select(value.alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(value.alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    counts = tagged.filter("v is not null").groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    totals = counts.agg(F.sum("x").alias("tx"), F.sum("y").alias("ty"))
    large = counts.count() > ordered.MAX_GROUP_ROWS
    cumulated = running(counts, [], ["v"], {"cx": F.col("x"), "cy": F.col("y")}, large)
    # One row of totals.
    return cumulated.crossJoin(F.broadcast(totals)).agg(F.max(F.abs(F.try_divide(F.col("cx"), F.col("tx")) - F.try_divide(F.col("cy"), F.col("ty")))).alias("ks"))


def frequencies(peptides: DataFrame, size: int) -> DataFrame:
    """(piece, f): share of every residue (size 1) or pair of residues (size 2)."""
    starts = F.when(F.length("Peptide") >= size, F.sequence(F.lit(1), F.length("Peptide") - size + 1)).otherwise(F.array().cast("array<int>"))
    counts = peptides.select(F.explode(F.transform(starts, lambda at: F.substr("Peptide", at, F.lit(size)))).alias("piece")).groupBy("piece").count()
    # At most a few hundred pieces.
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("count").alias("total")))).select("piece", (F.col("count") / F.col("total")).alias("f"))


def jensen_shannon(a: DataFrame, b: DataFrame, size: int, eps: float = 1e-12) -> DataFrame:
    """One row ``jsd`` in bits, not below 0."""
    both = frequencies(a, size).withColumnRenamed("f", "p").join(frequencies(b, size).withColumnRenamed("f", "q"), "piece", "full").fillna(0.0, ["p", "q"])
    middle = (F.col("p") + F.col("q")) / 2 + eps
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / middle)).otherwise(0.0)
    return both.agg(F.greatest(F.lit(0.0), F.sum(part("p") + part("q")) / 2).alias("jsd"))


def mass_collisions(a: DataFrame, b: DataFrame, ppm: float = 10.0) -> DataFrame:
    """One row: tolerance in Da (ppm of the median target mass), target masses, and the share with a decoy mass within it.

    A range join by cells as wide as the tolerance: a mass looks into its own
    cell and both beside it.
    """
    left = a.select("Peptide", peptide_mass("Peptide").alias("m")).filter("m is not null")
    tolerance = exact_percentiles(left.select("m", F.lit(1).alias("g")), ["g"], "m", {"median": 0.5}).select((F.col("median") * ppm * 1e-6).alias("tol"))
    one = F.broadcast(tolerance)  # one row
    cells = lambda m: F.floor(m / F.col("tol"))
    masses = b.select(peptide_mass("Peptide").alias("other")).filter("other is not null").distinct().crossJoin(one)
    spread = masses.select("other", F.explode(F.array(*[cells(F.col("other")) + k for k in (-1, 0, 1)])).alias("cell"))
    near = left.crossJoin(one).withColumn("cell", cells(F.col("m"))).alias("l")
    hits = near.join(spread.alias("r"), (F.col("l.cell") == F.col("r.cell")) & (F.abs(F.col("m") - F.col("other")) <= F.col("tol")), "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    return left.agg(F.count(F.lit(1)).alias("targets")).crossJoin(one).crossJoin(hits).select("targets", "hits", F.round("tol", 9).alias("tolerance"), F.round(F.try_divide(F.col("hits"), F.col("targets")), 9).alias("fraction"))
