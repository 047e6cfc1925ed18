"""Whole runs: each composes operators over all partitions or samples at once and writes its tables."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectraloom.functions import scalars
from spectraloom.operators import bins, collect, compare, conflicts, correction, crosstab, cull, digest, psm
from spectraloom.operators.fdr import best_per_scan, monotone_fdr
from spectraloom.operators.ordered import running
from spectraloom.operators.quantile import attach
from spectraloom.session import materialize
from spectraloom.sources import discovery, fasta, tables
from spectraloom.sources.names import natural


def cluster_database(proteins: DataFrame, out: str) -> DataFrame:
    """Proteins (id, header, seq) with ``Cluster=`` in their headers, from greedy clusters that are numbered by their representatives' ids."""
    members = materialize(conflicts.cluster_sequences(proteins, "id", "seq"), "clusters")
    heads = members.select("representative").distinct().withColumn("__one", F.lit(1))
    numbered = running(heads, [], ["representative"], {"n": F.col("__one")}, heads.count() > 4_000_000)
    clusters = members.join(numbered.hint("merge"), "representative").select("id", F.lpad(F.col("n").cast("string"), 4, "0").alias("Cluster"))
    named = proteins.join(clusters.hint("merge"), "id", "left").withColumn("header", scalars.with_cluster("header", "Cluster"))
    kept = materialize(named.select("id", "header", "seq"), "clustered")
    tables.write_tsv(clusters, f"{out}/clusters")
    fasta.write_fasta(kept, f"{out}/clustered_fasta")
    return kept


def prepare_databases(spark: SparkSession, fasta_path: str, out: str, groups: int = 9, targets: Sequence[str] = (), cluster: bool = False) -> None:
    """Cluster (if asked), digest, clean and partition a protein database: the main build, and one series per target size such as 600k."""
    proteins = fasta.read_fasta(spark, fasta_path)
    if cluster:
        proteins = cluster_database(proteins, out)
    mapped = materialize(digest.digest_map(digest.digest_edges(proteins, "id", "seq")), "digest")
    gone = materialize(digest.removed(mapped), "removed")
    kept = materialize(digest.cleaned(mapped, gone), "peptides")
    tables.write_tsv(kept, f"{out}/digest_map")
    tables.write_tsv(gone, f"{out}/removed_peptides")
    tables.write_tsv(digest.digest_stats(mapped, gone), f"{out}/digest_stats", one_file=True)
    tables.write_tsv(digest.digest_report(proteins, "id", "seq"), f"{out}/digest_report", one_file=True)
    total = kept.count()
    named = lambda bins_of: bins_of.withColumns({"header": F.col("Peptide"), "seq": F.col("Peptide")})
    for label, count in [("main", groups), *[(t, bins.nearest_group_count(total, bins.parse_size(t))) for t in targets]]:
        assigned = materialize(bins.group_assignments(kept, count), "groups")
        tables.write_partitioned(assigned, f"{out}/{label}/groups", ["Group"])
        fasta.write_fasta_bins(named(assigned), f"{out}/{label}/group_fasta", ["Group"])
        tables.write_tsv(bins.bin_summary(assigned, count), f"{out}/{label}/summary", one_file=True)
        if label == "main":
            pairs = bins.pair_assignments(assigned, count)
            tables.write_partitioned(pairs, f"{out}/{label}/pairs", ["PairGroupA", "PairGroupB"])
            fasta.write_fasta_bins(named(pairs), f"{out}/{label}/pair_fasta", ["PairGroupA", "PairGroupB"])


def score_runs(sic: DataFrame, syn: DataFrame, run: str) -> DataFrame:
    """Best row per scan, monotone FDR per run, and the further proteins of SYN."""
    best = best_per_scan(sic, [run, "ScanNum"], "ParentIonIntensity", ["SpecEValue", "Peptide", "Protein"])
    return psm.append_syn(monotone_fdr(best, [run], "SpecEValue", ["ScanNum", "Peptide", "Protein"]), syn, "ScanNum", keys=[run])


def binning_run(reference: DataFrame, sic: DataFrame, syn: DataFrame, out: str, strict: bool = True) -> DataFrame:
    """From a scored full search and the partitions' tables (both with RunFolder) to the wide comparison, all partitions in one job."""
    ties = ["Peptide", "Protein", "SpecEValue"]
    keys = materialize(cull.reference_keys(reference), "reference")
    culled = materialize(cull.cull(sic, syn, keys, ["RunFolder"], ties), "culled")
    rated = score_runs(culled.drop("CorePeptide", "SourceLayer"), syn, "RunFolder").withColumnRenamed("FDR", "PartitionFDR")
    rows = materialize(collect.with_cores(rated), "partition-rows")
    if strict:
        collect.require_no_conflicts(rows)
    summary = collect.core_summary(collect.observations(rows))
    wide = compare.with_pass_columns(compare.compare(compare.base_summary(reference), summary), [0.01, 0.05])
    tables.write_tsv(cull.file_report(sic, syn, keys, culled, "RunFolder"), f"{out}/culling_by_file", one_file=True)
    tables.write_tsv(cull.reference_summary(reference), f"{out}/reference_scan_peptides")
    tables.write_tsv(cull.scan_categories(sic, syn, keys, culled, ["RunFolder"]), f"{out}/scan_audit")
    by_scan = materialize(cull.recovery_by_scan(keys, culled, syn, "RunFolder"), "recovery")
    tables.write_tsv(by_scan, f"{out}/recovery_by_scan")
    tables.write_tsv(by_scan.filter("Recovered = 0"), f"{out}/unrecovered_scans")
    tables.write_tsv(cull.recovery_summary(by_scan), f"{out}/recovery_summary", one_file=True)
    tables.write_tsv(cull.recovery_distributions(by_scan), f"{out}/recovery_distributions", one_file=True)
    names = ("culling_by_file", "reference_scan_peptides", "scan_audit", "recovery_by_scan", "unrecovered_scans", "recovery_summary", "recovery_distributions", "wide")
    tables.write_manifest(wide.sparkSession, f"{out}/manifest", {name: f"{out}/{name}" for name in names})
    wide.write.parquet(f"{out}/wide")
    return wide.sparkSession.read.parquet(f"{out}/wide")


def derive_formula(wide: DataFrame, group: str, window: int = 100, stride: int = 10, held_out: float = 0.0) -> DataFrame:
    """The monotone correction curve of every condition, from all rows but the share ``held_out`` for tests."""
    if not 0 <= held_out < 1:
        raise ValueError("0 <= held_out < 1")
    train = correction.training_rows(wide, group)
    levels = materialize(correction.fdr_levels(train.filter(~correction.test_flag(held_out)) if held_out else train), "levels")
    return materialize(correction.monotone_anchors(correction.anchors(correction.rolling_windows(levels, window, stride))), "curve")


def correction_package(wide: DataFrame, group: str, out: str, window: int = 100, stride: int = 10, held_out: float = 0.0, sample_rows: int = 1000) -> DataFrame:
    """Derives every condition's curve and writes what speaks for it; gives the curve back.

    Intervals, anchors, formulas, errors over all rows and per window, passes
    per cutoff, a sample of predictions per condition and the numbers behind
    them. With ``held_out`` errors and passes are told for both splits.
    """
    train = materialize(correction.training_rows(wide, group), "train")
    test = correction.test_flag(held_out) if held_out else F.lit(False)
    split = train.withColumn("DatasetSplit", F.when(test, F.lit("test")).otherwise(F.lit("train" if held_out else "all_data")))
    levels = materialize(correction.fdr_levels(split.filter("DatasetSplit <> 'test'")), "levels")
    intervals = materialize(correction.rolling_windows(levels, window, stride), "intervals")
    curve = materialize(correction.monotone_anchors(correction.anchors(intervals)), "curve")
    predicted = materialize(correction.apply_curve(split, curve, "ClassicFDR", "PredictedFDR"), "predicted")
    keys = ["grp", "DatasetSplit"]
    tables.write_tsv(intervals, f"{out}/correction_interval_summary")
    tables.write_tsv(curve, f"{out}/correction_anchors")
    tables.write_formulas(curve, f"{out}/correction_formula")
    tables.write_tsv(correction.error_statistics(predicted, keys), f"{out}/validation_overall", one_file=True)
    tables.write_tsv(correction.error_statistics(correction.in_windows(predicted), [*keys, "window_index"]), f"{out}/validation_by_fdr_interval", one_file=True)
    tables.write_tsv(correction.cutoff_behavior(predicted, keys=keys), f"{out}/cutoff_behavior", one_file=True)
    drawn = Window.partitionBy("grp").orderBy(F.xxhash64(F.lit(1), "ScanNum", "PeptideKey"), "ScanNum", "PeptideKey")
    sample = predicted.withColumn("__at", F.row_number().over(drawn)).filter(F.col("__at") <= sample_rows).drop("__at")
    tables.write_tsv(sample, f"{out}/prediction_sample")
    facts = split.groupBy("grp").agg(
        F.count(F.lit(1)).alias("rows_after_validation_and_key_collapse"), F.count_if(F.col("DatasetSplit") != "test").alias("train_rows"), F.count_if(F.col("DatasetSplit") == "test").alias("test_rows"),
        F.count_distinct("ScanNum").alias("unique_scans"), F.count_distinct("ClassicFDR").alias("distinct_classical_fdr_values"),
    )
    counted = intervals.groupBy("grp").agg(F.count(F.lit(1)).alias("intervals_total"))
    metadata = attach(attach(facts, counted, ["grp"], "left"), correction.reversals(curve), ["grp"], "left")
    named = metadata.withColumns({"rolling_window_n": F.lit(window), "rolling_stride_n": F.lit(stride), "test_fraction": F.lit(held_out), "monotonic_method": F.lit("isotonic"), "rolling_window_unit": F.lit("distinct_classical_fdr")})
    tables.write_tsv(named, f"{out}/formula_metadata", one_file=True)
    return curve


def apply_formula(scored: DataFrame, curve: DataFrame, group: str) -> DataFrame:
    """Rows with OriginalFDR, CorrectedFDR and FDR replaced."""
    original = scored.withColumns({"grp": F.col(group), "OriginalFDR": F.col("FDR")})
    fixed = correction.apply_curve(original, curve, "OriginalFDR")
    return fixed.withColumns({"FDR": F.col("CorrectedFDR"), "FDRCorrectionDelta": F.col("CorrectedFDR") - F.col("OriginalFDR")}).drop("grp")


def report_correction(fixed: DataFrame, source: str, out: str, thresholds: Sequence[float] = (0.01, 0.05)) -> None:
    """What the correction did to each source: its scans, gains and losses, and diagnostics. ``fixed`` comes from ``apply_formula``."""
    rows = materialize(fixed.withColumn("PeptideKey", scalars.core_peptide("Peptide")), "corrected")
    scans = materialize(correction.scan_table(rows, source), "scans")
    tables.write_tsv(scans, f"{out}/corrected_scans")
    tables.write_tsv(correction.gains_and_losses(scans, source, list(thresholds)), f"{out}/gains_and_losses", one_file=True)
    tables.write_tsv(correction.file_diagnostics(rows, source), f"{out}/correction_diagnostics", one_file=True)


def corrected_run(wide: DataFrame, scored: DataFrame, proteins: DataFrame, group: str, sample: str, out: str, held_out: float = 0.0, **options) -> None:
    """Derive every condition's formula, apply it to the scored rows, and take those downstream. ``options`` go to ``downstream``."""
    curve = correction_package(wide, group, f"{out}/formula", held_out=held_out)
    fixed = materialize(apply_formula(scored, curve, group), "fixed")
    report_correction(fixed, sample, f"{out}/correction")
    downstream(fixed, proteins, sample, f"{out}/downstream", **options)


def matched_run(scored: DataFrame, curves: DataFrame, proteins: DataFrame, sample: str, out: str, **options) -> DataFrame:
    """Correct each sample by the formula whose name matches its own, all in one job, and roll them up together; gives the pairs back.

    ``curves`` is (grp, fdr_anchor, corrected) of all formulas. A sample
    without a formula, and a formula for two samples, stop the run.
    """
    spark = scored.sparkSession
    # Names of samples and formulas: a few each.
    names = lambda df, c: sorted((r[0] for r in df.select(c).distinct().collect()), key=natural)
    pairs = discovery.pair_samples(spark, names(scored, sample), names(curves, "grp"))
    alone = [r["sample"] for r in pairs.filter("formula is null").collect()]
    if alone:
        raise ValueError(f"no formula for {', '.join(alone)}")
    named = scored.join(F.broadcast(pairs.select(F.col("sample").alias(sample), F.col("formula").alias("__formula"))), sample)
    fixed = materialize(apply_formula(named, curves, "__formula").drop("__formula"), "fixed")
    tables.write_tsv(pairs, f"{out}/matched_formulas", one_file=True)
    report_correction(fixed, sample, f"{out}/correction")
    downstream(fixed, proteins, sample, f"{out}/downstream", **options)
    return pairs


def all_runs(spark: SparkSession, runs: Mapping[str, Callable[[], object]], out: str, include: str = "", exclude: str | None = None) -> DataFrame:
    """Runs every design whose name holds ``include`` and not ``exclude`` (patterns), in natural order; one that fails does not stop the others.

    (Design, Status, Seconds, Error) of all designs, also written to ``out``.
    """
    rows = []
    for name in sorted(runs, key=natural):
        if not re.search(include, name) or exclude and re.search(exclude, name):
            rows.append((name, "skipped", 0.0, ""))
            continue
        begun = time.monotonic()
        try:
            runs[name]()
            rows.append((name, "done", round(time.monotonic() - begun, 1), ""))
        except Exception as error:
            rows.append((name, "failed", round(time.monotonic() - begun, 1), str(error).split("\n")[0][:500]))
    status = spark.createDataFrame(rows, "Design string, Status string, Seconds double, Error string")
    tables.write_tsv(status, f"{out}/status", one_file=True)
    return status


def downstream(scored: DataFrame, proteins: DataFrame, sample: str, out: str, rollup: str = "sum", mode: str = "all_matches", stages: Sequence[tuple] = (("MSMSScore", 8.0), ("FDR", 0.05)), least_peptides: int = 1, scope: str = "per_sample", summary: str = "median", alpha: float | None = None) -> None:
    """Filter, crosstab, annotate, cover and roll up all samples. ``proteins`` has id, header and seq.

    ``rollup`` is sum, mean, median or rrollup, the latter with a ``summary``
    and, given ``alpha``, without outliers. Rollups hold the entities of the coverage table, which asks for
    ``least_peptides`` in the sample or (``scope`` global) over all samples.
    """
    (metric, threshold), (metric2, threshold2) = stages
    kept = materialize(psm.filtered_targets(scored, metric, threshold, metric2, threshold2).withColumnsRenamed({sample: "sample", "ParentIonIntensity": "Intensity"}), "filtered")
    samples = sorted((r["sample"] for r in kept.select("sample").distinct().collect()), key=natural)
    wide = crosstab.crosstab(crosstab.reduced(kept, "max"), samples)
    marked = materialize(crosstab.annotated(wide, crosstab.header_info(proteins, "id", "header")), "annotated")
    tables.write_tsv(marked, f"{out}/peptide_crosstab_annotated")
    found = crosstab.coverage(kept, proteins.select(F.col("id").alias("Protein"), "seq").filter("seq <> ''"))
    covered = materialize(crosstab.with_enough_peptides(found, kept, least_peptides, scope), "covered")
    tables.write_tsv(crosstab.coverage_matrix(covered, samples), f"{out}/grouped_coverage")
    for entity, name in (("Protein", "protein"), ("Cluster", "clustered")):
        rows = crosstab.rrollup(marked, entity, samples, mode, alpha, summary) if rollup == "rrollup" else crosstab.rollup(marked, entity, samples, rollup, mode)
        rolled = crosstab.covered_only(rows, marked, entity, covered)
        tables.write_tsv(crosstab.with_annotations(rolled, marked, entity, mode), f"{out}/{name}_crosstab_annotated")


def removal_series(peptides: DataFrame, out: str, thresholds: Sequence[float] = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)) -> DataFrame:
    """Find conflicts once, then the removal at every threshold in one pass; no qualifying edge may be left."""
    edges = materialize(conflicts.kmer_conflicts(peptides), "conflicts")
    tables.write_tsv(edges, f"{out}/conflicts")
    series = materialize(conflicts.cull_series(peptides, edges, list(thresholds)), "series")
    if not series.filter("remaining_edges > 0").isEmpty():
        raise ValueError("conflicts remain after the removal")
    gone = conflicts.removal_counts(edges, list(thresholds))
    tables.write_tsv(gone, f"{out}/removed_peptides")
    tables.write_tsv(series, f"{out}/series", one_file=True)
    return series
