"""In-silico digestion: peptides, the proteins they come from, and those that are removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.scalars import is_canonical, joined, trypsin


def digest_edges(proteins: DataFrame, ident: str, seq: str, shortest: int = 6, longest: int = 50) -> DataFrame:
    """Distinct (Peptide, Protein) of all fragments of fitting length."""
    pieces = proteins.filter(F.col(seq).isNotNull()).select(F.col(ident).alias("Protein"), F.explode(trypsin(F.upper(seq))).alias("Peptide"))
    return pieces.filter(F.length("Peptide").between(shortest, longest)).select("Peptide", "Protein").distinct()


def digest_map(edges: DataFrame) -> DataFrame:
    """(Peptide, ProteinCount, Proteins): each peptide with its proteins, sorted."""
    return edges.groupBy("Peptide").agg(F.count(F.lit(1)).alias("ProteinCount"), joined(F.collect_set("Protein")).alias("Proteins"))


def reversed_pairs(peptides: DataFrame) -> DataFrame:
    """(Peptide, Partner): peptides whose reversed residues are a peptide too, palindromes with themselves."""
    other = peptides.select(F.col("Peptide").alias("Partner"))
    return peptides.select("Peptide").join(other, F.reverse("Peptide") == F.col("Partner"))


def removed(mapped: DataFrame) -> DataFrame:
    """(Peptide, ProteinCount, Proteins, Reason, Partner): peptides with other residues, and both members of every reversed pair."""
    foreign = mapped.filter(~is_canonical("Peptide")).select("*", F.lit("noncanonical").alias("Reason"), F.lit("").alias("Partner"))
    kept = mapped.filter(is_canonical("Peptide"))
    pairs = reversed_pairs(kept)
    overlapping = kept.join(pairs, "Peptide").select(*mapped.columns, F.lit("tda_overlap").alias("Reason"), "Partner")
    return foreign.unionByName(overlapping)


def cleaned(mapped: DataFrame, gone: DataFrame) -> DataFrame:
    return mapped.join(gone.select("Peptide").distinct(), "Peptide", "left_anti")


def digest_stats(mapped: DataFrame, gone: DataFrame) -> DataFrame:
    """One row of counts of what the digest gave and what was removed."""
    lost = gone.select("Peptide", "Reason").distinct().withColumnRenamed("Peptide", "__gone")
    joint = mapped.join(lost, F.col("Peptide") == F.col("__gone"), "left")
    return joint.agg(
        F.count(F.lit(1)).alias("peptides"),
        F.count_if(F.col("ProteinCount") > 1).alias("shared_peptides"),
        F.sum("ProteinCount").alias("edges"),
        F.count_if(F.col("Reason") == "noncanonical").alias("noncanonical"),
        F.count_if(F.col("Reason") == "tda_overlap").alias("tda_overlap"),
        F.count_if(F.col("Reason").isNull()).alias("kept"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("Reason") == "tda_overlap"), F.count_if(~F.coalesce(F.col("Reason") == "noncanonical", F.lit(False)))), F.lit(0.0)), 10).alias("overlap_fraction"),
    )


def digest_report(proteins: DataFrame, ident: str, seq: str, shortest: int = 6, longest: int = 50, remove_overlaps: bool = True) -> DataFrame:
    """One row with every counter of a digest: proteins, fragments before and after each removal, reversed pairs and palindromes."""
    upper = F.upper(F.coalesce(seq, F.lit("")))
    read = proteins.agg(F.count(F.lit(1)).alias("proteins_read"), F.count_if(~is_canonical(upper)).alias("proteins_with_noncanonical_residues"))
    pieces = proteins.select(F.explode(trypsin(upper)).alias("Peptide")).filter(F.length("Peptide").between(shortest, longest))
    counts = pieces.groupBy("Peptide").agg(F.count(F.lit(1)).alias("n"))
    partner = counts.filter(is_canonical("Peptide")).select(F.reverse("Peptide").alias("__partner"))
    clean, met = is_canonical("Peptide"), F.col("__partner").isNotNull() & F.lit(remove_overlaps)
    joint = counts.join(partner, F.col("Peptide") == F.col("__partner"), "left")
    totals = joint.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("peptides_generated_pre_dedup"),
        F.count_if(clean).alias("unique_canonical_peptides_output_pre_tda"),
        F.coalesce(F.sum(F.when(~clean, F.col("n"))), F.lit(0)).alias("noncanonical_peptides_removed_total"),
        F.count_if(~clean).alias("noncanonical_peptides_removed_unique"),
        F.count_if(clean & met & (F.col("Peptide") <= F.reverse("Peptide"))).alias("tda_overlap_pairs"),
        F.count_if(clean & met).alias("tda_overlap_removed_unique"),
        F.count_if(clean & met & (F.col("Peptide") == F.reverse("Peptide"))).alias("tda_overlap_palindromes"),
    )
    share = F.coalesce(F.try_divide(F.col("tda_overlap_removed_unique"), F.col("unique_canonical_peptides_output_pre_tda")), F.lit(0.0))
    # Two frames of one row.
    return read.crossJoin(totals).withColumns({
        "tda_overlap_removed_fraction": F.round(share, 10), "tda_overlap_removed_percent": F.round(100 * share, 10), "tda_overlap_removal_enabled": F.lit(int(remove_overlaps)),
        "unique_canonical_peptides_output_post_tda": F.col("unique_canonical_peptides_output_pre_tda") - F.col("tda_overlap_removed_unique"),
    })
