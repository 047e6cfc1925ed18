"""Reference-guided culling: keep what the full-database search supports, fill up from candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.scalars import core_peptide, has_decoy, joined

#: How a fallback candidate is chosen: column and whether high is good (fixed order).
CHOICE = (("SpecEValue", False), ("MSGFDB_SpecEValue", False), ("EValue", False), ("QValue", False), ("PepQValue", False), ("MSGFScore", True), ("MSMSScore", True))


def reference_keys(reference: DataFrame) -> DataFrame:
    """Distinct (ScanNum, CorePeptide) of the reference."""
    return reference.select("ScanNum", core_peptide("Peptide").alias("CorePeptide")).filter("ScanNum is not null and CorePeptide is not null").distinct()


def reference_summary(reference: DataFrame) -> DataFrame:
    """Per (ScanNum, CorePeptide): its peptide forms and proteins as sorted text, and whether any is a decoy."""
    return reference.withColumn("CorePeptide", core_peptide("Peptide")).groupBy("ScanNum", "CorePeptide").agg(joined(F.collect_set("Peptide")).alias("Peptides"), joined(F.collect_set("Protein")).alias("Proteins"), F.bool_or(has_decoy("Protein")).alias("AnyDecoy"))


def supported(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.withColumn("CorePeptide", core_peptide("Peptide")).join(keys, ["ScanNum", "CorePeptide"], "left_semi")


def cull(sic: DataFrame, syn: DataFrame, keys: DataFrame, partition: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Supported SIC rows; for scans without one, the best supported SYN row. ``SourceLayer`` tells which.

    The result has the columns of ``sic`` and one row per partition and scan:
    one order over both layers decides. SIC comes first, then the smaller core
    peptide, then, among SYN rows, what CHOICE says, then the ties.
    """
    layer = lambda df, name: df.withColumn("SourceLayer", F.lit(name))
    both = supported(layer(sic, "SIC").unionByName(layer(syn, "SYN"), allowMissingColumns=True), keys)
    of_syn = lambda c: F.when(F.col("SourceLayer") == "SYN", F.col(c))
    choice = [F.desc_nulls_last(of_syn(c)) if high else F.asc_nulls_last(of_syn(c)) for c, high in CHOICE if c in syn.columns]
    first = Window.partitionBy(*partition, "ScanNum").orderBy("SourceLayer", F.asc_nulls_last("CorePeptide"), *choice, *[F.asc_nulls_last(t) for t in ties])
    return both.withColumn("__rank", F.row_number().over(first)).filter("__rank = 1").select(*sic.columns, "CorePeptide", "SourceLayer")


def scan_categories(sic: DataFrame, syn: DataFrame, keys: DataFrame, culled: DataFrame, partition: Sequence[str]) -> DataFrame:
    """(partition, ScanNum, Category) of every scan that either table has."""
    scan = [*partition, "ScanNum"]
    flag = lambda df, name: df.select(*scan).distinct().withColumn(name, F.lit(True))
    everything = sic.select(*scan).union(syn.select(*scan)).distinct()
    known = keys.select("ScanNum").distinct().withColumn("in_reference", F.lit(True))
    joint = everything.join(flag(culled.filter("SourceLayer = 'SIC'"), "by_sic"), scan, "left").join(flag(culled.filter("SourceLayer = 'SYN'"), "by_syn"), scan, "left").join(flag(sic, "in_sic"), scan, "left").join(known, "ScanNum", "left")
    category = (
        F.when(F.col("by_sic"), F.lit("recovered_by_sic"))
        .when(F.col("by_syn") & F.col("in_sic").isNull(), F.lit("recovered_by_syn_absent_from_sic"))
        .when(F.col("by_syn"), F.lit("recovered_by_syn"))
        .when(F.col("in_reference"), F.lit("alternative_only"))
        .otherwise(F.lit("not_in_reference"))
    )
    return joint.select(*scan, category.alias("Category"))


def recovery_by_scan(keys: DataFrame, culled: DataFrame, syn: DataFrame, partition: str) -> DataFrame:
    """Per reference scan in how many partitions it was recovered, by which layer, and in how many SYN saw its peptide."""
    scans = keys.select("ScanNum").distinct()
    got = culled.groupBy("ScanNum").agg(F.count_distinct(partition).alias("any"), F.count_distinct(F.when(F.col("SourceLayer") == "SIC", F.col(partition))).alias("sic"), F.count_distinct(F.when(F.col("SourceLayer") == "SYN", F.col(partition))).alias("syn"))
    seen = supported(syn, keys).groupBy("ScanNum").agg(F.count_distinct(partition).alias("seen"))
    filled = lambda c, name: F.coalesce(c, F.lit(0)).cast("bigint").alias(name)
    return scans.join(got, "ScanNum", "left").join(seen, "ScanNum", "left").select("ScanNum", filled("any", "Recovered"), filled("sic", "RecoveredSIC"), filled("syn", "AddedSYN"), filled("seen", "ObservedSYN"))


def recovery_summary(by_scan: DataFrame) -> DataFrame:
    """One row: scans, how many were recovered, by which layer, seen in SYN, and of each in how many partitions, as text ``k:n``."""
    layers = {"Recovered": "recovered", "RecoveredSIC": "recovered_sic", "AddedSYN": "recovered_syn", "ObservedSYN": "observed_syn"}
    text = lambda layer: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("layer") == layer, F.struct("partitions", "scans")))), lambda s: F.concat(s["partitions"].cast("string"), F.lit(":"), s["scans"].cast("string"))), ";")
    # One row per layer and number of partitions.
    histograms = recovery_distributions(by_scan).agg(*[text(layer).alias("histogram" if name == "recovered" else f"{name}_histogram") for layer, name in layers.items()])
    counts = by_scan.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(layer) > 0).alias(name) for layer, name in layers.items()])
    # Two frames of one row.
    return counts.crossJoin(histograms).withColumn("unrecovered", F.col("total") - F.col("recovered")).withColumn("fraction", F.round(F.coalesce(F.try_divide(F.col("recovered"), F.col("total")), F.lit(0.0)), 9))


def recovery_distributions(by_scan: DataFrame) -> DataFrame:
    """(layer, partitions, scans): in how many partitions the scans were recovered, by SIC, by SYN, and seen in SYN."""
    layers = F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).alias("partitions")) for c in ("Recovered", "RecoveredSIC", "AddedSYN", "ObservedSYN")])
    return by_scan.select(F.explode(layers).alias("l")).groupBy("l.layer", "l.partitions").agg(F.count(F.lit(1)).alias("scans"))


def file_summary(sic: DataFrame, syn: DataFrame, culled: DataFrame, partition: str) -> DataFrame:
    """Per partition: rows and scans of each input, rows kept from each layer, distinct peptides and proteins kept."""
    a = sic.groupBy(partition).agg(F.count(F.lit(1)).alias("sic_rows"), F.count_distinct("ScanNum").alias("sic_scans"))
    b = syn.groupBy(partition).agg(F.count(F.lit(1)).alias("syn_rows"), F.count_distinct("ScanNum").alias("syn_scans"))
    c = culled.groupBy(partition).agg(F.count(F.lit(1)).alias("kept_rows"), F.count_if(F.col("SourceLayer") == "SIC").alias("kept_sic"), F.count_if(F.col("SourceLayer") == "SYN").alias("kept_syn"), F.count_distinct("CorePeptide").alias("kept_peptides"), F.count_distinct("Protein").alias("kept_proteins"))
    joint = a.join(b, partition, "full").join(c, partition, "full")
    return joint.select(partition, *[F.coalesce(x, F.lit(0)).alias(x) for x in joint.columns if x != partition])


def file_report(sic: DataFrame, syn: DataFrame, keys: DataFrame, culled: DataFrame, partition: str, expected: DataFrame | None = None) -> DataFrame:
    """Per partition every counter of the culling: rows in, kept and added, targets and decoys, scans by category, and what SYN could give.

    ``expected`` (partition) lists partitions that must have a row: one whose
    inputs are missing has zeros and no RowFDR.
    """
    scan = [partition, "ScanNum"]
    none = {name: F.lit(0) for name in ("sic", "kept", "named", "syn", "out_sic", "out_syn", "decoys")}
    tagged = lambda df, **own: df.select(*scan, *[own.get(name, zero).cast("int").alias(name) for name, zero in none.items()])
    marked = keys.withColumn("__kept", F.lit(1))
    core = core_peptide("Peptide")
    mine = sic.withColumn("CorePeptide", core).join(marked, ["ScanNum", "CorePeptide"], "left")
    layer = lambda name: F.col("SourceLayer") == name
    rows = tagged(mine, sic=F.lit(1), kept=F.coalesce("__kept", F.lit(0)), named=F.coalesce(F.col("CorePeptide") != "", F.lit(False)))
    rows = rows.unionByName(tagged(supported(syn, keys), syn=F.lit(1)))
    rows = rows.unionByName(tagged(culled, out_sic=layer("SIC"), out_syn=layer("SYN"), decoys=has_decoy("Protein")))
    scans = rows.groupBy(*scan).agg(*[F.sum(name).alias(name) for name in none])
    known = keys.select("ScanNum").distinct().withColumn("__known", F.lit(True))
    joint = scans.join(known, "ScanNum", "left").withColumn("__known", F.coalesce("__known", F.lit(False)))
    named, got = F.col("named") > 0, (F.col("kept") > 0) | (F.col("out_syn") > 0)
    out = joint.groupBy(partition).agg(
        F.sum("sic").alias("InputRows"), F.sum("kept").alias("SICRowsKept"), F.sum("out_syn").alias("SYNFallbackRowsAdded"), F.sum(F.col("out_sic") + F.col("out_syn")).alias("OutputRows"),
        F.sum(F.col("out_sic") + F.col("out_syn") - F.col("decoys")).alias("TargetRows"), F.sum("decoys").alias("DecoyRows"),
        F.count_if(named).alias("GroupUniqueScans"), F.count_if(F.col("kept") > 0).alias("SICRecoveredScans"), F.count_if(F.col("out_syn") > 0).alias("SYNFallbackScans"), F.count_if(got).alias("RecoveredScans"),
        F.count_if(named & F.col("__known") & ~got).alias("AlternativeOnlyScans"), F.count_if(named & ~F.col("__known")).alias("GroupScansNotInReference"),
        F.sum("syn").alias("SYNMatchingRowsAvailable"), F.count_if(F.col("syn") > 0).alias("SYNMatchingScansAvailable"),
    )
    if expected is not None:
        out = expected.select(partition).distinct().join(out, partition, "left").fillna(0, [c for c in out.columns if c != partition])
    return out.withColumn("RowFDR", F.try_divide(F.col("DecoyRows"), F.col("OutputRows")))
