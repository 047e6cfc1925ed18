"""Peptide matrices over samples: building, annotating, rolling up, and sequence coverage."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.scalars import cluster_of, flanked_parts, flanked_positions, function_of, gene_of, joined
from spectraloom.operators.quantile import attach, exact_percentiles

KEY = ["PeptideFlanked", "Protein"]


def reduced(rows: DataFrame, how: str = "sum") -> DataFrame:
    """(sample, PeptideFlanked, Protein, Intensity): sum or maximum; rows without a key are left out."""
    return rows.dropna(subset=["sample", *KEY]).groupBy("sample", *KEY).agg(getattr(F, how)("Intensity").alias("Intensity"))


def dominant(rows: DataFrame, core: str) -> DataFrame:
    """(PeptideFlanked, Protein, core): the most frequent core of each key, the smallest of equally frequent ones."""
    counts = rows.groupBy(*KEY, core).count()
    return counts.groupBy(*KEY).agg(F.min(F.struct(-F.col("count"), F.col(core).alias("c")))["c"].alias(core))


def crosstab(long: DataFrame, samples: Sequence[str]) -> DataFrame:
    """One row per (PeptideFlanked, Protein), one column per sample; what is missing is 0. One shuffle for all samples."""
    wide = long.groupBy(*KEY).pivot("sample", list(samples)).agg(F.first("Intensity"))
    return wide.select(*KEY, *[F.round(F.coalesce(s, F.lit(0.0)), 6).alias(s) for s in samples])


def header_info(proteins: DataFrame, ident: str, header: str) -> DataFrame:
    """(Protein, Cluster, Gene, Function) from headers."""
    info = F.regexp_replace(F.coalesce(header, F.lit("")), r"^\S+\s*", "")
    tail = F.regexp_extract(info, r"(OS.*)$", 1)
    return proteins.select(F.col(ident).alias("Protein"), cluster_of(info).alias("Cluster"), gene_of(tail).alias("Gene"), function_of(info).alias("Function"))


def annotated(wide: DataFrame, info: DataFrame, unique_to_cluster: bool = False) -> DataFrame:
    """Adds Cluster, Gene, Function, Unique, Shared and Unique to Cluster; null counts as a value of its own."""
    joint = wide.join(info, "Protein", "left")
    number = lambda c: (F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))) == 1
    # One row per peptide; a peptide in very many proteins is one key of this join, not one task's window.
    flags = joint.groupBy("PeptideFlanked").agg(number("Protein").alias("Unique"), number("Cluster").alias("Unique to Cluster"))
    out = attach(joint, flags, ["PeptideFlanked"]).withColumn("Shared", ~F.col("Unique"))
    return out.filter(F.col("Unique to Cluster")) if unique_to_cluster else out


def by_mode(rows: DataFrame, mode: str, entity: str) -> DataFrame:
    """all_matches, unique_only, or requires_unique: all rows of entities with a unique peptide."""
    if mode == "all_matches":
        return rows
    if mode == "unique_only":
        return rows.filter("Unique")
    if mode == "requires_unique":
        return rows.join(rows.filter("Unique").select(entity).distinct(), entity, "left_semi")
    raise ValueError(f"no such mode: {mode}")


def entity_facts(rows: DataFrame, entity: str) -> DataFrame:
    """Per entity: whether it has unique and shared peptides, how many peptides, and which."""
    return rows.groupBy(entity).agg(F.bool_or("Unique").alias("HasUnique"), F.bool_or(~F.col("Unique")).alias("HasShared"), F.count_distinct("PeptideFlanked").alias("PeptideNumber"), joined(F.collect_set("PeptideFlanked")).alias("FlankedPeptides"))


def rollup(rows: DataFrame, entity: str, samples: Sequence[str], how: str = "sum", mode: str = "all_matches") -> DataFrame:
    """One row per entity: sum, mean or median of its peptides per sample, zeros included; missing values are left aside."""
    kept = by_mode(rows, mode, entity).filter(F.col(entity).isNotNull())
    if how in ("sum", "mean"):
        fold = F.sum if how == "sum" else F.avg
        return _with_facts(kept.groupBy(entity).agg(*[fold(s).alias(s) for s in samples]), kept, entity)
    if how != "median":
        raise ValueError(f"no such rollup: {how}")
    return _with_facts(_medians(_unfolded(kept, entity, samples), entity, samples), kept, entity)


def _with_facts(values: DataFrame, rows: DataFrame, entity: str) -> DataFrame:
    """The entities of ``rows`` with their ``values`` and facts; an entity without any value keeps its facts."""
    facts = entity_facts(rows, entity)
    met = attach(facts, values, [entity], "left")
    return met.select(entity, *[c for c in values.columns if c != entity], *[c for c in facts.columns if c != entity])


def with_annotations(rolled: DataFrame, rows: DataFrame, entity: str, mode: str = "all_matches") -> DataFrame:
    """Adds what the annotated ``rows`` say of each entity: Cluster, Gene and Function of a protein, a name for a cluster, and Unique to Cluster."""
    kept = by_mode(rows, mode, entity).filter(F.col(entity).isNotNull())
    own = F.bool_or("Unique to Cluster").alias("Unique to Cluster")
    if entity == "Cluster":
        name = F.concat(F.lit("Cluster "), F.coalesce(F.col("Cluster").try_cast("bigint").cast("string"), "Cluster"))
        return attach(rolled, kept.groupBy(entity).agg(own), [entity]).withColumns({"Protein": name, "Gene": F.lit(""), "Function": F.lit("")})
    carried = [F.min(F.nullif(F.col(c), F.lit(""))).alias(c) for c in ("Cluster", "Gene", "Function")]
    return attach(rolled, kept.groupBy(entity).agg(*carried, own), [entity])


def covered_only(rolled: DataFrame, rows: DataFrame, entity: str, covered: DataFrame) -> DataFrame:
    """The entities with a protein in the coverage table; the annotated ``rows`` tell a protein's cluster."""
    proteins = covered.select("Protein").distinct()
    ids = proteins if entity == "Protein" else rows.join(proteins, "Protein", "left_semi").select(entity).distinct()
    return rolled.join(ids, entity, "left_semi")


def _unfolded(rows: DataFrame, entity: str, samples: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), F.col(s).alias("x")) for s in samples]))
    return rows.select(entity, "PeptideFlanked", "Protein", pairs.alias("p")).select(entity, "PeptideFlanked", "Protein", "p.*") if entity != "Protein" else rows.select("Protein", "PeptideFlanked", pairs.alias("p")).select("Protein", "PeptideFlanked", "p.*")


def _medians(long: DataFrame, entity: str, samples: Sequence[str]) -> DataFrame:
    medians = exact_percentiles(long, [entity, "sample"], "x", {"x": 0.5})
    return medians.groupBy(entity).pivot("sample", list(samples)).agg(F.first("x"))


def rrollup(rows: DataFrame, entity: str, samples: Sequence[str], mode: str = "all_matches", alpha: float | None = None, summary: str = "median") -> DataFrame:
    """Per entity and sample the median or mean of its peptides, each scaled to the entity's reference peptide.

    The reference is the peptide with the fewest missing values (null or NaN),
    then with the largest total, then with the smallest name. A peptide is
    scaled by the median ratio of reference to peptide over the samples where
    both have a value and the peptide's is not 0; one that cannot be scaled is
    left out. With ``alpha`` at most one outlier per entity and sample goes.
    Missing values are no values: where none is left the result is null.
    """
    if summary not in ("median", "mean"):
        raise ValueError(f"no such summary: {summary}")
    kept = by_mode(rows, mode, entity).filter(F.col(entity).isNotNull())
    own = ["PeptideFlanked", "Protein"]
    values = F.array(*[F.when(~F.isnan(s), F.col(s)) for s in samples])
    held = F.filter("v", lambda x: x.isNotNull())
    vector = kept.select(entity, *[c for c in own if c != entity], values.alias("v")).withColumns({"missing": F.size("v") - F.size(held), "total": F.aggregate(held, F.lit(0.0), lambda a, x: a + x)})
    name = F.struct(*own)
    reference = vector.groupBy(entity).agg(F.min(F.struct("missing", (-F.col("total")).alias("t"), name.alias("name"), F.col("v").alias("ref"))).alias("r"), F.count(F.lit(1)).alias("peptides")).select(entity, "r.name", "r.ref", "peptides")
    met = attach(vector, reference, [entity])
    both = F.filter(F.arrays_zip("v", "ref"), lambda p: p["v"].isNotNull() & p["ref"].isNotNull() & (p["v"] != 0))
    ratios = F.array_sort(F.transform(both, lambda p: p["ref"] / p["v"]))
    size = F.size("ratios")
    middle = F.when(size > 0, (F.get("ratios", F.floor((size - 1) / 2).cast("int")) + F.get("ratios", F.floor(size / 2).cast("int"))) / 2)
    is_reference = (F.col("peptides") == 1) | (F.struct(*own) == F.col("name"))
    factor = F.when(is_reference, F.lit(1.0)).otherwise(F.nullif(F.col("middle"), F.lit(0.0)))
    scaled = met.withColumn("ratios", ratios).withColumn("middle", middle).withColumn("factor", factor)
    long = scaled.select(entity, name.alias("name"), F.posexplode("v").alias("k", "raw"), "factor").select(entity, "name", F.element_at(F.array(*[F.lit(s) for s in samples]), F.col("k") + 1).alias("sample"), (F.col("raw") * F.col("factor")).alias("x"))
    if alpha is not None:
        long = without_outlier(long, [entity, "sample"], "name", "x", alpha)
    if summary == "mean":
        return _with_facts(long.groupBy(entity).pivot("sample", list(samples)).agg(F.avg("x")), kept, entity)
    return _with_facts(_medians(long, entity, samples), kept, entity)


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t, by bisection on its distribution function."""

    def tail(t: float) -> float:
        # Regularised incomplete beta of df/(df+t^2), by its continued fraction.
        a, b, x = df / 2, 0.5, df / (df + t * t)
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        return beta(a, b, x)

    def beta(a: float, b: float, x: float) -> float:
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a if 0 < x < 1 else 0.0
        f, c, d = 1.0, 1.0, 0.0
        for i in range(200):
            m = i // 2
            step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / (1 + step * d)
            c = 1 + step / c
            f *= c * d
            if abs(1 - c * d) < 1e-14:
                break
        return front * (f - 1)

    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        if 1 - tail(middle) / 2 < p:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def grubbs_limit(n: int, alpha: float) -> float:
    t = t_quantile(1 - alpha / (2 * n), n - 2)
    return (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))


def without_outlier(long: DataFrame, keys: Sequence[str], name: str, value: str, alpha: float) -> DataFrame:
    """Grubbs' two-sided test: takes from every group of three or more the value farthest from its mean, if that is too far."""
    stats = long.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("__n"), F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd"))

    def limits(sizes: pd.Series) -> pd.Series:
        return sizes.map({n: grubbs_limit(int(n), alpha) for n in sizes.unique()})

    # One limit per distinct group size.
    table = stats.filter("__n >= 3").select("__n").distinct().withColumn("__limit", F.pandas_udf(limits, "double")("__n"))
    far = attach(long, stats.filter("__n >= 3 and __sd > 0").join(table, "__n"), keys).withColumn("__z", F.abs(F.col(value) - F.col("__mean")) / F.col("__sd"))
    worst = far.filter("__z is not null").groupBy(*keys).agg(F.max("__z").alias("__g"), F.min(F.struct(-F.col("__z"), F.col(name).alias("name")))["name"].alias("__out"), F.max("__limit").alias("__limit")).filter("__g > __limit").select(*keys, "__out")
    return attach(long, worst, keys, "left").filter(~F.coalesce(F.col("__out") == F.col(name), F.lit(False))).drop("__out")


def coverage(rows: DataFrame, proteins: DataFrame) -> DataFrame:
    """(sample, Protein, num_pep, Coverage): distinct peptides, and the percent of residues they cover.

    ``rows`` is (sample, PeptideFlanked, Protein), ``proteins`` (Protein, seq).
    A flank must agree with the residue beside; ``-`` asks for nothing.
    """
    distinct = rows.select("sample", "PeptideFlanked", "Protein").distinct()
    parts = distinct.join(proteins, "Protein").withColumn("p", flanked_parts("PeptideFlanked"))
    starts = flanked_positions(F.col("p.core"), F.col("p.n_flank"), F.col("p.c_flank"), F.col("seq"))
    spans = parts.select("sample", "Protein", F.length("seq").alias("residues"), F.length("p.core").alias("width"), F.posexplode_outer(starts).alias("k", "start"))
    # What a span adds is what lies behind the farthest end so far.
    before = Window.partitionBy("sample", "Protein").orderBy(F.asc_nulls_last("start")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("width") - 1
    fresh = F.greatest(end - F.greatest(F.col("start") - 1, F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    counts = spans.withColumn("fresh", F.when(F.col("start").isNotNull(), fresh)).groupBy("sample", "Protein").agg(
        F.count_if(F.coalesce(F.col("k") == 0, F.lit(True))).alias("num_pep"), F.max("residues").alias("residues"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("covered")
    )
    return counts.select("sample", "Protein", "num_pep", (100 * F.col("covered") / F.greatest("residues", F.lit(1))).alias("Coverage"))


def with_enough_peptides(covered: DataFrame, rows: DataFrame, least: int, scope: str = "per_sample") -> DataFrame:
    """Coverage of proteins with ``least`` distinct peptides or more, in the sample or (``global``) over all samples of ``rows``."""
    if scope == "per_sample":
        return covered.filter(F.col("num_pep") >= least)
    if scope != "global":
        raise ValueError(f"no such scope: {scope}")
    known = rows.groupBy("Protein").agg(F.count_distinct("PeptideFlanked").alias("n")).filter(F.col("n") >= least)
    return covered.join(known, "Protein", "left_semi")


def coverage_matrix(covered: DataFrame, samples: Sequence[str], least: int = 1) -> DataFrame:
    kept = covered.filter(F.col("num_pep") >= least)
    return kept.groupBy("Protein").pivot("sample", list(samples)).agg(F.first("Coverage")).fillna(0.0)


def heatmap_rows(matrix: DataFrame, samples: Sequence[str], top: int = 100) -> DataFrame:
    """The proteins of highest coverage in any sample."""
    return matrix.orderBy(F.desc(F.greatest(*samples)), "Protein").limit(top)
