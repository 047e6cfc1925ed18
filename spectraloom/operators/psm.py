"""Working on peptide-spectrum matches: more proteins, mapped peptides, filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.scalars import canonical_peptide, either, is_decoy, peptide_core
from spectraloom.session import materialize

DEFAULTS = {"FDR": 0.01, "QValue": 0.01, "MSMSScore": 10.0}
#: The two-sided limits of the strict filter (fixed values).
STRINGENT = {"FDR": 0.01, "MSMSScore": 10.0, "QValue": 0.05}


def template_rows(fdr: DataFrame, keys: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """The row of lowest QValue of every group."""
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("QValue"), *[F.asc_nulls_last(t) for t in ties])
    return fdr.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def append_syn(fdr: DataFrame, syn: DataFrame, syn_scan: str, keys: Sequence[str] = ("Run",), ties: Sequence[str] = ("Protein",)) -> DataFrame:
    """``fdr`` with a row for every further protein that ``syn`` has for one of its (scan, peptide); ``Appended`` marks those."""
    scan = [*keys, "ScanNum", "Peptide"]
    # Read three times below.
    clean = materialize(fdr.withColumns({"Peptide": F.trim("Peptide"), "Protein": F.trim("Protein")}), "psm")
    triples = syn.select(*keys, F.col(syn_scan).alias("ScanNum"), F.trim("Peptide").alias("Peptide"), F.trim("Protein").alias("Protein")).distinct()
    fresh = triples.join(clean.select(*scan, "Protein").distinct(), [*scan, "Protein"], "left_anti")
    template = template_rows(clean, scan, ties).drop("Protein")
    rows = fresh.join(template, scan).withColumn("IsDecoy", is_decoy("Protein")).withColumn("Appended", F.lit(True))
    return clean.withColumn("IsDecoy", is_decoy("Protein")).withColumn("Appended", F.lit(False)).unionByName(rows, allowMissingColumns=True)


def expand_by_map(psm: DataFrame, edges: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Each row once per protein that its peptide maps to; ``Mapped`` is direct, fallback or none.

    A row that is no decoy and whose own peptide is not in the map takes the
    peptides of its protein entry in ``parents`` (Protein, ParentPeptide)
    instead. Rows that still find nothing pass unchanged.
    """
    known = edges.select(F.col("Peptide").alias("__peptide"), F.col("Protein").alias("__mapped")).distinct()
    keyed = psm.withColumn("__key", canonical_peptide("Peptide"))
    out = keyed.join(known, F.col("__key") == F.col("__peptide"), "left")
    how, protein = F.when(F.col("__mapped").isNotNull(), F.lit("direct")), [F.col("__mapped")]
    if parents is not None:
        lookup = parents.select(F.col("Protein").alias("__parent"), canonical_peptide("ParentPeptide").alias("__pp")).distinct().join(known, F.col("__pp") == F.col("__peptide")).select("__parent", F.col("__mapped").alias("__fallback")).distinct()
        out = out.join(lookup, F.col("__mapped").isNull() & (F.col("Protein") == F.col("__parent")) & ~is_decoy("Protein"), "left")
        how, protein = how.when(F.col("__fallback").isNotNull(), F.lit("fallback")), [*protein, F.col("__fallback")]
    named = out.withColumn("Mapped", how.otherwise(F.lit("none"))).withColumn("OriginalProtein", F.col("Protein")).withColumn("Protein", F.coalesce(*protein, "Protein"))
    return named.drop("__key", "__peptide", "__mapped", "__parent", "__fallback")


def expansion_audit(expanded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows before and after, how many were mapped which way, and the fan-out. ``keys`` tell the rows before."""
    before = expanded.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("Mapped").alias("how"))
    return before.agg(
        F.count(F.lit(1)).alias("rows_in"), F.sum("n").alias("rows_out"), F.count_if(F.col("how") == "direct").alias("direct"), F.count_if(F.col("how") == "fallback").alias("fallback"),
        F.count_if(F.col("how") == "none").alias("unmapped"), F.sum(F.col("n") - 1).alias("extra_rows"), F.round(F.avg("n"), 9).alias("fan_out"),
    )


def metric_filter(df: DataFrame, metric: str, threshold: float | None = None) -> DataFrame:
    """FDR and QValue at most, MSMSScore at least the threshold; a table without the column passes."""
    if metric == "stringent":
        for name, limit in STRINGENT.items():
            df = metric_filter(df, name, limit)
        return df
    if metric not in DEFAULTS:
        raise ValueError(f"no such metric: {metric}")
    if metric not in df.columns:
        return df
    limit = DEFAULTS[metric] if threshold is None else threshold
    return df.filter(F.col(metric) >= limit if metric == "MSMSScore" else F.col(metric) <= limit)


def filtered_targets(df: DataFrame, metric: str = "FDR", threshold: float | None = None, metric2: str | None = None, threshold2: float | None = None, floor: float = 5e3) -> DataFrame:
    """The kept target rows: one or two metric filters, no contaminants, no decoys, intensity at ``floor`` or more where there is one."""
    out = metric_filter(df, metric, threshold)
    if metric2 == "stringent" or metric2 and threshold2 is not None:
        out = metric_filter(out, metric2, threshold2)
    out = out.filter(~F.coalesce(F.contains(F.lower("Protein"), F.lit("contaminant")), F.lit(False)))
    decoy = F.coalesce(F.col("IsDecoy"), F.lit(False)) if "IsDecoy" in df.columns else is_decoy("Protein")
    out = out.filter(~decoy)
    if "ParentIonIntensity" in df.columns:
        out = out.filter(F.col("ParentIonIntensity") >= floor)
    return out.withColumn("PeptideFlanked", F.col("Peptide")).withColumn("Peptide", peptide_core("Peptide")).distinct()


def peptide_view(df: DataFrame) -> DataFrame:
    """(Peptide, QValue, IsDecoy): least QValue, and whether all rows are decoys."""
    return df.groupBy("Peptide").agg(F.min("QValue").alias("QValue"), F.bool_and("IsDecoy").alias("IsDecoy"))


def filter_stats(df: DataFrame) -> DataFrame:
    """One row: distinct peptides and proteins, and the percent of decoys among them."""
    peptides = peptide_view(df).agg(F.count(F.lit(1)).alias("peptides"), F.count_if("IsDecoy").alias("d"))
    proteins = df.groupBy("Protein").agg(F.bool_and("IsDecoy").alias("IsDecoy")).agg(F.count(F.lit(1)).alias("proteins"), F.count_if("IsDecoy").alias("e"))
    # Two frames of one row.
    both = peptides.crossJoin(proteins)
    percent = lambda d, n: F.round(100 * either(d) / F.greatest(F.lit(1), either(n)), 4)
    return both.select("peptides", percent("d", "peptides").alias("peptide_decoy_percent"), "proteins", percent("e", "proteins").alias("protein_decoy_percent"))
