"""Deriving, validating and applying an empirical monotone FDR correction, per condition.

Rows are (grp, ScanNum, PeptideKey, ClassicFDR, PartitionedFDR); every step
works on all conditions at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.scalars import clip01, hash_fraction, in_interval, is_close, number
from spectraloom.operators import ordered
from spectraloom.operators.ordered import MAX_GROUP_ROWS, following, largest_group, latest, running
from spectraloom.operators.collate import capped_list
from spectraloom.operators.quantile import attach, percentiles_of, ranked_values
from spectraloom.session import fits, materialize

#: (low, high, bins) of the segments of the classical FDR (fixed values).
SEGMENTS = ((0.0, 0.001, 5), (0.001, 0.01, 10), (0.01, 0.05, 20), (0.05, 0.1, 10), (0.1, 0.2, 10), (0.2, 0.5, 15), (0.5, 1.0, 20))
#: Overlapping windows of validation (fixed values).
WINDOWS = ((0, 0.001), (0.001, 0.005), (0.005, 0.01), (0.01, 0.02), (0.02, 0.05), (0.05, 0.1), (0.1, 0.2), (0.2, 0.5), (0.5, 1.0), (0, 0.05), (0, 0.1), (0, 0.2), (0, 1.0))
CUTOFFS = (0.01, 0.05, 0.1, 0.2)


def training_rows(wide: DataFrame, group: str) -> DataFrame:
    """One row per condition, scan and peptide: the least of both FDRs, both within [0, 1]."""
    rows = wide.select(F.col(group).alias("grp"), "ScanNum", F.trim("CorePeptide").alias("PeptideKey"), number("BaseFDR").alias("c"), number("BinnedFDRMedian").alias("p"))
    valid = rows.filter("ScanNum is not null and PeptideKey <> '' and c between 0 and 1 and p between 0 and 1")
    out = valid.groupBy("grp", "ScanNum", "PeptideKey").agg(F.min("c").alias("ClassicFDR"), F.min("p").alias("PartitionedFDR"), F.count(F.lit(1)).alias("SourceRows"))
    return out.withColumn("Delta", F.col("PartitionedFDR") - F.col("ClassicFDR"))


def test_flag(fraction: float) -> Column:
    """Whether a row is held out: the same rows always, whatever their order."""
    return hash_fraction("ScanNum", "PeptideKey") < fraction


def fdr_levels(train: DataFrame) -> DataFrame:
    """One row per condition and distinct classical FDR: rows, scans, peptides, medians and means."""
    keys = ["grp", "ClassicFDR"]
    out = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("ScanNum").alias("scans"), F.count_distinct("PeptideKey").alias("peptides"), F.avg("Delta").alias("mean_delta"), F.avg("PartitionedFDR").alias("mean_partitioned"))
    return attach(out, percentiles_of(train, keys, {"Delta": {"median_delta": 0.5}, "PartitionedFDR": {"median_partitioned": 0.5}}), keys)


def segment_of(fdr: Column, segments: Sequence[tuple] = SEGMENTS) -> Column:
    """Index of the segment, from 1; the last one includes its upper end."""
    made = F.lit(None).cast("int")
    for k, (low, high, _) in reversed(list(enumerate(segments, 1))):
        made = F.when(in_interval(fdr, low, high, k == len(segments)), k).otherwise(made)
    return made


def rolling_windows(levels: DataFrame, window: int = 100, stride: int = 10, segments: Sequence[tuple] = SEGMENTS) -> DataFrame:
    """Statistics over windows of ``window`` distinct levels, restarted in every segment.

    Windows start every ``stride`` levels; a last one ends with the segment,
    and a segment with fewer levels is one window. Every level is unfolded to
    the few windows that hold it, so no range join is needed.
    """
    seg = levels.withColumn("segment", segment_of(F.col("ClassicFDR"), segments)).filter("segment is not null")
    sizes = seg.groupBy("grp", "segment").agg(F.count(F.lit(1)).alias("levels"))
    large = levels.count() > ordered.MAX_GROUP_ROWS and (sizes.agg(F.max("levels")).first()[0] or 0) > ordered.MAX_GROUP_ROWS
    placed = attach(running(seg, ["grp", "segment"], ["ClassicFDR"], {"__upto": F.lit(1)}, large), sizes, ["grp", "segment"]).withColumn("at", F.col("__upto") - 1)
    final = F.greatest(F.col("levels") - window, F.lit(0))
    low, high = F.greatest(F.ceil((F.col("at") - window + 1) / stride), F.lit(0)), F.least(F.floor(F.col("at") / stride), F.floor(final / stride))
    regular = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: k * stride)).otherwise(F.array().cast("array<bigint>"))
    starts = F.array_distinct(F.concat(regular, F.when(F.col("at") >= final, F.array(final.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))))
    member = placed.withColumn("start", F.explode(starts))
    # A window holds at most ``window`` levels: their values in order answer all its quantiles.
    values = lambda c: F.array_sort(F.collect_list(c))
    d = F.col("median_delta")
    held = member.groupBy("grp", "segment", "start").agg(
        F.count(F.lit(1)).alias("n_train"), F.sum("rows").alias("n_source_rows"), F.min("ClassicFDR").alias("min_fdr"), F.max("ClassicFDR").alias("max_fdr"), F.avg("ClassicFDR").alias("mean_classic_fdr"),
        F.avg("mean_partitioned").alias("mean_partitioned_fdr"), F.avg("mean_delta").alias("mean_delta"), F.stddev_samp("median_delta").alias("sd_delta"),
        F.avg((d < 0).cast("int")).alias("fraction_lower"), F.avg((d == 0).cast("int")).alias("fraction_equal"), F.avg((d > 0).cast("int")).alias("fraction_higher"),
        values("ClassicFDR").alias("__c"), values("median_partitioned").alias("__p"), values("median_delta").alias("__d"),
    )

    def at(array: str, p: float) -> Column:
        place = (F.size(array) - 1) * F.lit(p)
        low, high = F.get(array, F.floor(place).cast("int")), F.get(array, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    named = {"median_classic_fdr": at("__c", 0.5), "median_partitioned_fdr": at("__p", 0.5), "median_delta": at("__d", 0.5), **{f"q{int(100 * p)}_delta": at("__d", p) for p in (0.1, 0.25, 0.75, 0.9)}}
    return held.withColumns({**named, "sem_delta": F.col("sd_delta") / F.sqrt("n_train")}).drop("__c", "__p", "__d")


def quantile_bins(train: DataFrame, least: int, segments: Sequence[tuple] = SEGMENTS) -> DataFrame:
    """(grp, segment, bin, low, high): quantile bins per segment, as many as asked for but of about ``least`` rows or more.

    A condition without rows in a segment has one bin for it.
    """
    seg = train.withColumn("segment", segment_of(F.col("ClassicFDR"), segments)).filter("segment is not null")
    ranked = ranked_values(seg, ["grp", "segment"], "ClassicFDR")
    plan = seg.groupBy("grp", "segment").agg(F.count(F.lit(1)).alias("total_rows"))
    limits = train.sparkSession.createDataFrame([(k, float(a), float(b), n) for k, (a, b, n) in enumerate(segments, 1)], "segment int, seg_low double, seg_high double, asked int")
    # A few segments for every condition.
    every = attach(train.select("grp").distinct().crossJoin(F.broadcast(limits)), plan, ["grp", "segment"], "left")
    supported = F.floor(F.coalesce("total_rows", F.lit(0)) / least) if least > 0 else F.col("asked")
    planned = every.withColumn("bins", F.greatest(F.lit(1), F.least("asked", supported)).cast("int"))
    inner = planned.filter("bins > 1").select("grp", "segment", "bins", F.explode(F.sequence(F.lit(1), F.col("bins") - 1)).alias("j"))
    met = attach(ranked, inner, ["grp", "segment"]).withColumn("place", F.col("j") / F.col("bins") * (F.col("total") - 1))
    holds = lambda index: (F.col("upto") > index) & (F.col("upto") - F.col("n") <= index)
    cuts = met.filter(holds(F.floor("place")) | holds(F.ceil("place"))).groupBy("grp", "segment", "j").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.max(F.col("place") - F.floor("place")).alias("share"))
    edges = cuts.groupBy("grp", "segment").agg(F.collect_list(F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("inner"))
    joint = attach(planned, edges, ["grp", "segment"], "left")
    all_edges = F.array_sort(F.array_distinct(F.concat(F.array("seg_low"), F.coalesce("inner", F.array().cast("array<double>")), F.array("seg_high"))))
    listed = joint.withColumn("edges", all_edges)
    pairs = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda k: F.struct(k.alias("bin"), F.get("edges", k - 1).alias("low"), F.get("edges", k).alias("high")))
    return listed.select("grp", "segment", F.explode(pairs).alias("b")).select("grp", "segment", "b.*")


def in_bins(train: DataFrame, bins: DataFrame, segments: Sequence[tuple] = SEGMENTS) -> DataFrame:
    """Each row with the bin of its segment that holds it, half-open but for the last one."""
    seg = train.withColumn("segment", segment_of(F.col("ClassicFDR"), segments)).filter("segment is not null")
    # Per condition and segment a short array of bins travels to the rows.
    arrays = bins.groupBy("grp", "segment").agg(F.array_sort(F.collect_list(F.struct("bin", "low", "high"))).alias("bins"))
    last = F.col("segment") == len(segments)
    found = F.filter("bins", lambda b: (F.col("ClassicFDR") >= b["low"]) & ((F.col("ClassicFDR") < b["high"]) | last & (F.col("ClassicFDR") == b["high"])))
    return attach(seg, arrays, ["grp", "segment"]).withColumn("bin", F.element_at(found, -1)["bin"]).drop("bins")


def bin_summary(train: DataFrame, bins: DataFrame, segments: Sequence[tuple] = SEGMENTS) -> DataFrame:
    """Per bin: rows, means, medians, quantiles, signs and standard error of the delta."""
    keys = ["grp", "segment", "bin"]
    rows = in_bins(train, bins, segments)
    d = F.col("Delta")
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_train"), F.avg("ClassicFDR").alias("mean_classic_fdr"), F.avg("PartitionedFDR").alias("mean_partitioned_fdr"), F.avg("Delta").alias("mean_delta"), F.stddev_samp("Delta").alias("sd_delta"),
        F.avg((d < 0).cast("int")).alias("fraction_lower"), F.avg((d == 0).cast("int")).alias("fraction_equal"), F.avg((d > 0).cast("int")).alias("fraction_higher"),
    ).withColumn("sem_delta", F.col("sd_delta") / F.sqrt("n_train"))
    quantiles = {"ClassicFDR": {"median_classic_fdr": 0.5}, "PartitionedFDR": {"median_partitioned_fdr": 0.5}, "Delta": {"median_delta": 0.5, "q10_delta": 0.1, "q25_delta": 0.25, "q75_delta": 0.75, "q90_delta": 0.9}}
    stats = attach(stats, percentiles_of(rows, keys, quantiles), keys)
    return attach(bins, stats, keys, "left").withColumn("n_train", F.coalesce("n_train", F.lit(0)))


def merge_sparse(counted: DataFrame, least: int) -> DataFrame:
    """(grp, segment, bin, low, high, n, merged): neighbouring bins of a segment joined from the left until each has ``least`` rows.

    What is left over goes to the bin before, unless the whole segment has too
    few rows. ``counted`` is (grp, segment, bin, low, high, n), a few dozen
    bins per condition.
    """
    kind = dict(counted.dtypes)["grp"]

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        own, out, open_bins = own.sort_values("bin"), [], []
        small = own["n"].sum() < least
        for row in own.itertuples():
            open_bins.append(row)
            if sum(b.n for b in open_bins) >= least:
                out.append(open_bins)
                open_bins = []
        if open_bins and out and not small:
            out[-1] = out[-1] + open_bins
        elif open_bins:
            out.append(open_bins)
        return pd.DataFrame([(own["grp"].iloc[0], own["segment"].iloc[0], k, m[0].low, m[-1].high, sum(b.n for b in m), len(m)) for k, m in enumerate(out, 1)], columns=["grp", "segment", "bin", "low", "high", "n", "merged"])

    return counted.groupBy("grp", "segment").applyInPandas(fold, f"grp {kind}, segment int, bin int, low double, high double, n bigint, merged int")


def anchors(intervals: DataFrame, statistic: str = "median") -> DataFrame:
    """(grp, fdr_anchor, delta_anchor, n_train, role): one per distinct median FDR, and one at 0 and 1 where those are missing."""
    delta = F.col(f"{statistic}_delta")
    merged = F.median(delta) if statistic == "median" else F.avg(delta)
    seen = intervals.filter(f"n_train > 0 and median_classic_fdr is not null and {statistic}_delta is not null")
    observed = seen.groupBy("grp", F.col("median_classic_fdr").alias("fdr_anchor")).agg(merged.alias("delta_anchor"), F.sum("n_train").alias("n_train")).withColumn("role", F.lit("observed_interval"))
    ends = observed.groupBy("grp").agg(F.min(F.struct("fdr_anchor", "delta_anchor")).alias("first"), F.max(F.struct("fdr_anchor", "delta_anchor")).alias("last"))
    edge = lambda which, at, missing: ends.filter(missing).select("grp", F.lit(at).alias("fdr_anchor"), F.col(which)["delta_anchor"].alias("delta_anchor"), F.lit(0).cast("bigint").alias("n_train"), F.lit("domain_boundary").alias("role"))
    return observed.unionByName(edge("first", 0.0, "first.fdr_anchor > 0")).unionByName(edge("last", 1.0, "last.fdr_anchor < 1"))


def pooled(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per value the number of its block: neighbours that violate the order are pooled until the weighted means of the blocks rise."""
    blocks: list[list[float]] = []
    for value, weight in zip(values, weights):
        blocks.append([value * weight, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
            total, weight, size = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + weight, blocks[-1][2] + size]
    return np.repeat(np.arange(len(blocks)), [int(b[2]) for b in blocks]) if blocks else np.zeros(0, "int64")


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted least-squares nondecreasing fit."""
    block = pooled(values, weights)
    return (np.bincount(block, values * weights) / np.bincount(block, weights))[block] if len(block) else np.zeros(0)


#: Anchors of one condition that one task may fit.
MAX_FIT = 1_000_000


def monotone_anchors(points: DataFrame, method: str = "isotonic", max_fit: int = MAX_FIT) -> DataFrame:
    """Adds raw_corrected and corrected: the anchor plus its delta within [0, 1], and that made nondecreasing per condition.

    A task fits a condition of up to ``max_fit`` anchors. Where one has more,
    the anchors are range-partitioned by condition and FDR, every slice is
    pooled by itself, and its blocks, with their weights, take the place of the
    anchors: what pooling joins within a slice stays joined in the whole fit,
    so that the result is the same. This is repeated with other slices until
    no block of a condition is below the one before it.
    """
    raw = points.withColumn("raw_corrected", clip01(F.col("fdr_anchor") + F.col("delta_anchor")))
    if method == "none":
        return raw.withColumn("corrected", F.col("raw_corrected"))
    raw, weight = materialize(raw, "anchors"), F.greatest(F.col("n_train").cast("double"), F.lit(1.0))
    if fits(raw, max_fit) or largest_group(raw, ["grp"]) <= max_fit:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in raw.schema) + ", corrected double"

        def fit(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("fdr_anchor")
            return own.assign(corrected=np.clip(isotonic(own["raw_corrected"].to_numpy(), np.maximum(own["n_train"].to_numpy("float64"), 1.0)), 0, 1))

        return raw.groupBy("grp").applyInPandas(fit, schema)
    kind = raw.schema["grp"].dataType.simpleString()

    def pool(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("low")
        block = pooled(own["y"].to_numpy(), own["w"].to_numpy())
        ends = own.assign(block=block, total=own["y"] * own["w"]).groupby("block").agg(low=("low", "min"), high=("high", "max"), total=("total", "sum"), w=("w", "sum"))
        return ends.assign(grp=own["grp"].iloc[0], y=ends["total"] / ends["w"])[["grp", "low", "high", "y", "w"]]

    blocks = raw.select("grp", F.col("fdr_anchor").alias("low"), F.col("fdr_anchor").alias("high"), F.col("raw_corrected").alias("y"), weight.alias("w"))
    schema, turn, falls = f"grp {kind}, low double, high double, y double, w double", 0, True
    while falls:
        # One slice more every second time: no inner border of these slices is one of those.
        parts = max(2, -(-blocks.count() * 2 // max_fit)) + turn % 2
        sliced = materialize(blocks.repartitionByRange(parts, "grp", "low").withColumn("__slice", F.spark_partition_id()), "slices")
        blocks = materialize(sliced.groupBy("grp", "__slice").applyInPandas(pool, schema), "blocks")
        pairs = following(blocks, ["grp"], ["low"], {"__after": "y"}, largest_group(blocks, ["grp"]) > max_fit, max_fit)
        falls = not pairs.filter(F.col("y") > F.col("__after") * (1 + 1e-12)).isEmpty()
        turn += 1
    # Blocks follow each other without a gap: the last one that begins at or before an anchor holds it.
    marks = blocks.select("grp", F.col("low").alias("fdr_anchor"), clip01(F.col("y")).alias("__y"))
    fitted = attach(raw, marks, ["grp", "fdr_anchor"], "left")
    return latest(fitted, ["grp"], ["fdr_anchor"], "__y", "corrected", True, max_fit).drop("__y")


def _beside(curve: DataFrame, columns: dict[str, str], max_rows: int) -> DataFrame:
    """Each anchor with values of the next one of its condition; a condition of over ``max_rows`` anchors is ordered in slices."""
    kept = materialize(curve, "curve")
    large = not fits(kept, max_rows) and largest_group(kept, ["grp"]) > max_rows
    return following(kept, ["grp"], ["fdr_anchor"], columns, large, max_rows)


def reversals(curve: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Per condition: anchors, and how often the raw curve falls."""
    marked = _beside(curve, {"__after": "raw_corrected"}, max_rows).withColumn("fall", (F.col("__after") - F.col("raw_corrected") < -1e-15).cast("int"))
    return marked.groupBy("grp").agg(F.count(F.lit(1)).alias("anchors"), F.coalesce(F.sum("fall"), F.lit(0)).alias("reversals"), F.max(F.abs(F.col("corrected") - F.col("raw_corrected"))).alias("largest_adjustment"))


#: Cells that the domain [0, 1] is cut into for finding the anchors around a value.
CELLS = 1024
#: Stretches that a part of a cell holds, about; a cell with more is cut into that many parts.
CELL_STRETCHES = 8


def apply_curve(rows: DataFrame, curve: DataFrame, value: str, out: str = "CorrectedFDR", max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Adds ``out``: the linear blend of the anchors around ``value``; null where the condition has no curve or the value none.

    A stretch between two anchors is listed under every cell it touches, and
    in a cell of many stretches under every part of it, so that a row finds
    its one by an equi-join on condition, cell and part. No window has to
    order the rows, and the work does not grow where anchors are dense.
    """
    both = _beside(curve.select("grp", "fdr_anchor", "corrected"), {"__x2": "fdr_anchor", "__y2": "corrected"}, max_rows)
    stretch = both.select(F.col("grp").alias("__grp"), F.col("fdr_anchor").alias("__x"), F.col("corrected").alias("__y"), "__x2", "__y2").filter("__x2 is not null")
    cell = lambda v: F.least(F.floor(v * CELLS), F.lit(CELLS - 1)).cast("int")
    part = lambda v, c, n: F.greatest(F.lit(0), F.least(F.floor((v * CELLS - c) * n), n - 1)).cast("int")
    listed = materialize(stretch.withColumn("__cell", F.explode(F.sequence(cell(F.col("__x")), cell(F.col("__x2"))))), "stretches")
    # At most CELLS rows per condition.
    parts = listed.groupBy("__grp", "__cell").agg(F.ceil(F.count(F.lit(1)) / CELL_STRETCHES).cast("int").alias("__parts"))
    cut = attach(listed, parts, ["__grp", "__cell"]).withColumn("__part", F.explode(F.sequence(part(F.col("__x"), F.col("__cell"), F.col("__parts")), part(F.col("__x2"), F.col("__cell"), F.col("__parts"))))).drop("__parts")
    v = F.col(value)
    known = parts.select(F.col("__grp").alias("__g"), F.col("__cell").alias("__c"), "__parts")
    keyed = rows.withColumn("__own_cell", cell(v)).join(known, F.col("grp").eqNullSafe(F.col("__g")) & (F.col("__own_cell") == F.col("__c")), "left").withColumn("__own_part", part(v, F.col("__own_cell"), F.col("__parts"))).drop("__g", "__c", "__parts")
    inside = F.col("grp").eqNullSafe(F.col("__grp")) & (F.col("__own_cell") == F.col("__cell")) & (F.col("__own_part") == F.col("__part")) & (v >= F.col("__x")) & ((v < F.col("__x2")) | (F.col("__x2") == 1.0) & (v == 1.0))
    blend = F.col("__y") + (F.col("__y2") - F.col("__y")) / (F.col("__x2") - F.col("__x")) * (v - F.col("__x"))
    return keyed.join(cut, inside, "left").withColumn(out, clip01(blend)).drop("__grp", "__own_cell", "__own_part", "__cell", "__part", "__x", "__y", "__x2", "__y2")


def error_statistics(predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: n, mean and quantiles of predicted minus partitioned FDR."""
    rows = predicted.withColumn("error", F.col("PredictedFDR") - F.col("PartitionedFDR")).withColumn("off", F.abs("error"))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean_error"), F.avg("off").alias("mae"), F.max("off").alias("max_abs_error"))
    quantiles = {"error": {"median_error": 0.5}, "off": {"median_abs_error": 0.5, "q75_abs_error": 0.75, "q90_abs_error": 0.9, "q95_abs_error": 0.95}}
    return attach(out, percentiles_of(rows, keys, quantiles), keys)


def in_windows(predicted: DataFrame, windows: Sequence[tuple] = WINDOWS) -> DataFrame:
    """Each row once per validation window that holds its classical FDR."""
    holding = F.filter(F.array(*[F.when(in_interval(F.col("ClassicFDR"), a, b, b == 1.0), k) for k, (a, b) in enumerate(windows, 1)]), lambda k: k.isNotNull())
    return predicted.withColumn("window_index", F.explode(holding))


def cutoff_behavior(predicted: DataFrame, cutoffs: Sequence[float] = CUTOFFS, keys: Sequence[str] = ("grp",)) -> DataFrame:
    """Per key (the condition) and cutoff: how the predicted pass agrees with the observed one, and gains and losses against the classical."""
    long = predicted.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
    c, o, p = (F.col(x) <= F.col("cutoff") for x in ("ClassicFDR", "PartitionedFDR", "PredictedFDR"))
    out = long.groupBy(*keys, "cutoff").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c).alias("classic_pass"), F.count_if(o).alias("observed_pass"), F.count_if(p).alias("predicted_pass"),
        F.count_if(p & o).alias("tp"), F.count_if(~p & ~o).alias("tn"), F.count_if(p & ~o).alias("fp"), F.count_if(~p & o).alias("fn"),
        F.count_if(o & ~c).alias("observed_gain"), F.count_if(~o & c).alias("observed_loss"), F.count_if(p & ~c).alias("predicted_gain"), F.count_if(~p & c).alias("predicted_loss"),
    )
    return out.withColumns({"accuracy": (F.col("tp") + F.col("tn")) / F.col("n"), "precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})


def scan_table(rows: DataFrame, source: str, cap: int | None = 100) -> DataFrame:
    """Per source and scan: least original and corrected FDR, rows, distinct FDR values and peptides, of which at most ``cap`` are named (all if None)."""
    usable = rows.filter("ScanNum is not null and OriginalFDR is not null")
    keys = [source, "ScanNum"]
    scans = usable.groupBy(*keys).agg(F.min("OriginalFDR").alias("OriginalFDR"), F.min("CorrectedFDR").alias("CorrectedFDR"), F.count(F.lit(1)).alias("SourceRows"), F.count_distinct("OriginalFDR").alias("DistinctOriginalFDRValues"))
    return attach(scans, capped_list(usable, keys, "PeptideKey", "Peptide", cap), keys, "left").withColumn("Peptide", F.coalesce("Peptide", F.lit("")))


def gains_and_losses(scans: DataFrame, source: str, thresholds: Sequence[float]) -> DataFrame:
    """Per source and threshold, and for all sources together: scans that pass before and after, gained and lost."""
    long = scans.withColumn("Threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    a, b = F.coalesce(F.col("OriginalFDR") <= F.col("Threshold"), F.lit(False)), F.coalesce(F.col("CorrectedFDR") <= F.col("Threshold"), F.lit(False))
    measures = [F.count(F.lit(1)).alias("UniqueScans"), F.count_if(a).alias("OriginalPassScans"), F.count_if(b).alias("CorrectedPassScans"), F.count_if(~a & b).alias("GainedScans"), F.count_if(a & ~b).alias("LostScans"), (F.count_if(b) - F.count_if(a)).alias("NetPassScanChange"), F.count_if(a & b).alias("PassBothScans"), F.count_if(~a & ~b).alias("FailBothScans"), F.count_distinct(F.when(~a & b & (F.col("Peptide") != ""), F.col("Peptide"))).alias("GainedUniquePeptideStrings")]
    grouped = long.groupingSets([[source, "Threshold"], ["Threshold"]], source, "Threshold").agg(F.grouping(source).alias("__all"), *measures)
    return grouped.withColumn("Scope", F.when(F.col("__all") == 1, "ALL_FILES").otherwise("file")).drop("__all")


def file_diagnostics(rows: DataFrame, source: str) -> DataFrame:
    """Per source: rows, what is missing or out of range, the range of both FDRs, and how the correction moved them.

    ``equal`` counts values that are close (1e-8 + 1e-5 x original), so that a
    value may be lower or higher and equal.
    """
    o, c = F.col("OriginalFDR"), F.col("CorrectedFDR")
    several = rows.filter("ScanNum is not null and OriginalFDR is not null").groupBy(source, "ScanNum").agg((F.min("OriginalFDR") != F.max("OriginalFDR")).alias("several"))
    scans = several.groupBy(source).agg(F.count(F.lit(1)).alias("scans_with_fdr"), F.count_if("several").alias("scans_with_several_fdrs"))
    out = rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("rows"), F.count(o).alias("with_fdr"), F.count_if(o.isNull()).alias("missing_fdr"), F.count_if((o < 0) | (o > 1)).alias("out_of_range"), F.count_if(c.isNull() & o.isNotNull()).alias("uncorrected"),
        F.min(o).alias("least_original"), F.max(o).alias("most_original"), F.min(c).alias("least_corrected"), F.max(c).alias("most_corrected"), F.count_if(c == 0.0).alias("corrected_to_zero"), F.count_if(c == 1.0).alias("corrected_to_one"),
        F.count_if(c < o).alias("lowered"), F.count_if(c == o).alias("unchanged"), F.count_if(is_close(c, o)).alias("equal"), F.count_if(c > o).alias("raised"), F.count_distinct("ScanNum").alias("scans"), F.avg(c - o).alias("mean_shift"), F.max(F.abs(c - o)).alias("largest_shift"),
    )
    return attach(out, scans, [source], "left").fillna(0, ["scans_with_fdr", "scans_with_several_fdrs"])
