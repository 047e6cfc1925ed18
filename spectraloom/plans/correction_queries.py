"""Queries on the FDR correction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.operators import correction as C
from spectraloom.plans.compare_queries import _R, rounded
from spectraloom.session import materialize, table

LEAST, WINDOW, STRIDE = 40, 100, 10


def _train(spark, sf_dir):
    """The training rows, written once: every step behind them reads them more than once."""
    return materialize(C.training_rows(table(spark, sf_dir, "fdr_compare_wide"), "ConditionName"), "train")


def _levels(train):
    return materialize(C.fdr_levels(train), "levels")


def _curve(train):
    windows = C.rolling_windows(_levels(train), WINDOW, STRIDE)
    return materialize(C.monotone_anchors(C.anchors(windows)), "curve")


def _predicted(spark, sf_dir):
    train = _train(spark, sf_dir)
    return C.apply_curve(train, _curve(train), "ClassicFDR", "PredictedFDR")


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monotone anchors of every condition."""
    return _curve(_train(spark, sf_dir))


def correction_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.fdr_levels(_train(spark, sf_dir)))


def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.rolling_windows(_levels(_train(spark, sf_dir)), WINDOW, STRIDE))


def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _train(spark, sf_dir)
    return rounded(C.bin_summary(train, materialize(C.quantile_bins(train, LEAST), "bins")))


def sparse_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile bins for a tenth of the wanted rows, joined until they have the wanted rows."""
    train = _train(spark, sf_dir)
    bins = materialize(C.quantile_bins(train, LEAST // 10), "bins")
    counts = C.in_bins(train, bins).groupBy("grp", "segment", "bin").agg(F.count(F.lit(1)).alias("n"))
    counted = C.attach(bins, counts, ["grp", "segment", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rounded(C.merge_sparse(counted, LEAST))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.anchors(C.rolling_windows(_levels(_train(spark, sf_dir)), WINDOW, STRIDE)))


def isotonic_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_curve(_train(spark, sf_dir)).select("grp", "fdr_anchor", "n_train", "raw_corrected", "corrected"))


def curve_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.reversals(_curve(_train(spark, sf_dir))), 8)


def apply_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_predicted(spark, sf_dir).select("grp", "ScanNum", "PeptideKey", "ClassicFDR", "PredictedFDR"))


def validation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.error_statistics(C.in_windows(materialize(_predicted(spark, sf_dir), "predicted")), ["grp", "window_index"]), 7)


def cutoff_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.cutoff_behavior(_predicted(spark, sf_dir)))


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out and training rows per condition."""
    return _train(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), F.count_if(C.test_flag(0.2)).alias("held_out"))


def _scans(spark, sf_dir):
    rows = _predicted(spark, sf_dir).select("grp", "ScanNum", "PeptideKey", F.col("ClassicFDR").alias("OriginalFDR"), F.round("PredictedFDR", 8).alias("CorrectedFDR"))
    return C.scan_table(rows, "grp")


def scan_gain_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.gains_and_losses(_scans(spark, sf_dir), "grp", [0.01, 0.05])


def correction_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predicted(spark, sf_dir).select("grp", "ScanNum", F.col("ClassicFDR").alias("OriginalFDR"), F.round("PredictedFDR", 8).alias("CorrectedFDR"))
    return rounded(C.file_diagnostics(rows, "grp"), 7)


_TRAIN = """train as (select ConditionName as grp, ScanNum, trim(CorePeptide) as PeptideKey, min(BaseFDR) as ClassicFDR, min(BinnedFDRMedian) as PartitionedFDR, min(BinnedFDRMedian) - min(BaseFDR) as Delta
 from fdr_compare_wide where ScanNum is not null and trim(CorePeptide) <> '' and BaseFDR between 0 and 1 and BinnedFDRMedian between 0 and 1 and not isnan(BaseFDR) and not isnan(BinnedFDRMedian) group by all)"""
_SEG = "case " + " ".join(f"when ClassicFDR >= {a} and ClassicFDR {'<=' if b == 1.0 else '<'} {b} then {k}" for k, (a, b, _) in enumerate(C.SEGMENTS, 1)) + " end"
_LEVELS = """, levels as (select grp, ClassicFDR, count(*) as rows, count(distinct ScanNum) as scans, count(distinct PeptideKey) as peptides, avg(Delta) as mean_delta, avg(PartitionedFDR) as mean_partitioned, median(Delta) as median_delta, median(PartitionedFDR) as median_partitioned from train group by 1, 2)"""
_WINDOWS = f""", placed as (select *, {_SEG} as segment, row_number() over (partition by grp, {_SEG} order by ClassicFDR) - 1 as at_, count(*) over (partition by grp, {_SEG}) as n from levels),
starts as (select distinct grp, segment, n, unnest(list_distinct(list_append(range(0, greatest(n - {WINDOW}, 0) + 1, {STRIDE}), greatest(n - {WINDOW}, 0)))) as start from placed),
windows as (select s.grp, s.segment, start, count(*) as n_train, sum(rows)::bigint as n_source_rows, min(ClassicFDR) as min_fdr, max(ClassicFDR) as max_fdr, median(ClassicFDR) as median_classic_fdr, avg(ClassicFDR) as mean_classic_fdr,
 median(median_partitioned) as median_partitioned_fdr, avg(mean_partitioned) as mean_partitioned_fdr, median(median_delta) as median_delta, avg(mean_delta) as mean_delta, stddev_samp(median_delta) as sd_delta,
 quantile_cont(median_delta, 0.1) as q10_delta, quantile_cont(median_delta, 0.25) as q25_delta, quantile_cont(median_delta, 0.75) as q75_delta, quantile_cont(median_delta, 0.9) as q90_delta,
 avg((median_delta < 0)::int) as fraction_lower, avg((median_delta = 0)::int) as fraction_equal, avg((median_delta > 0)::int) as fraction_higher, stddev_samp(median_delta) / sqrt(count(*)) as sem_delta
 from starts s join placed p on p.grp is not distinct from s.grp and p.segment = s.segment and p.at_ >= s.start and p.at_ < s.start + {WINDOW} group by 1, 2, 3)"""
_ANCHORS = """, observed as (select grp, median_classic_fdr as fdr_anchor, median(median_delta) as delta_anchor, sum(n_train)::bigint as n_train, 'observed_interval' as role from windows group by 1, 2),
ends as (select grp, min(fdr_anchor) as lo, max(fdr_anchor) as hi, arg_min(delta_anchor, fdr_anchor) as dlo, arg_max(delta_anchor, fdr_anchor) as dhi from observed group by 1),
anchors as (select * from observed union all select grp, 0.0, dlo, 0, 'domain_boundary' from ends where lo > 0 union all select grp, 1.0, dhi, 0, 'domain_boundary' from ends where hi < 1)"""
_CURVE = """, raw as (select *, greatest(0, least(1, fdr_anchor + delta_anchor)) as y, greatest(n_train, 1) as w, row_number() over (partition by grp order by fdr_anchor) as i from anchors),
sums as (select *, sum(y * w) over (partition by grp order by i) as sy, sum(w) over (partition by grp order by i) as sw from raw),
blocks as (select a.grp, a.i as a, b.i as b, (b.sy - a.sy + a.y * a.w) / (b.sw - a.sw + a.w) as m from sums a join sums b on a.grp is not distinct from b.grp and b.i >= a.i),
low as (select grp, a, b as i, min(m) over (partition by grp, a order by b desc) as m from blocks),
fit as (select grp, i, max(m) as f from low group by 1, 2),
curve as (select r.*, greatest(0, least(1, f)) as c from raw r join fit on fit.grp is not distinct from r.grp and fit.i = r.i)"""
_APPLY = """, stretch as (select grp, fdr_anchor as x, c as y, lead(fdr_anchor) over w as x2, lead(c) over w as y2 from curve window w as (partition by grp order by fdr_anchor)),
predicted as (select t.*, greatest(0, least(1, s.y + (s.y2 - s.y) / (s.x2 - s.x) * (ClassicFDR - s.x))) as PredictedFDR from train t left join stretch s on s.grp is not distinct from t.grp and x2 is not null and ClassicFDR >= x and (ClassicFDR < x2 or (x2 = 1 and ClassicFDR = 1)))"""
_UP_TO = "with " + _TRAIN + _LEVELS + _WINDOWS + _ANCHORS + _CURVE
_names = ("n_train n_source_rows", "min_fdr max_fdr median_classic_fdr mean_classic_fdr median_partitioned_fdr mean_partitioned_fdr median_delta mean_delta sd_delta q10_delta q25_delta q75_delta q90_delta fraction_lower fraction_equal fraction_higher sem_delta")

QUERIES = {
    "correction_levels": correction_levels, "rolling_windows": rolling_windows, "quantile_bins": quantile_bins, "sparse_bins": sparse_bins, "anchors": anchors, "isotonic_curve": isotonic_curve, "curve_reversals": curve_reversals,
    "apply_correction": apply_correction, "validation_windows": validation_windows, "cutoff_confusion": cutoff_confusion, "hash_split": hash_split, "scan_gain_loss": scan_gain_loss, "correction_diagnostics": correction_diagnostics,
}
# Quantile bins: every (grp, segment) with its edges at (j / bins) of its values, then what each bin holds.
_LIMITS = "limits as (select * from (values " + ", ".join(f"({k}, {float(a)}::double, {float(b)}::double, {n})" for k, (a, b, n) in enumerate(C.SEGMENTS, 1)) + ") v(segment, seg_low, seg_high, asked))"


def _bins_sql(least: int) -> str:
    return f""", {_LIMITS}, seg as (select *, {_SEG} as segment from train where {_SEG} is not null),
ranked as (select grp, segment, ClassicFDR as v, row_number() over (partition by grp, segment order by ClassicFDR) - 1 as i, count(*) over (partition by grp, segment) as total from seg),
planned as (select g.grp, l.*, greatest(1, least(asked, coalesce(c.n, 0) // {least})) as bins, coalesce(c.n, 0) as n from (select distinct grp from train) g cross join limits l left join (select grp, segment, count(*) as n from seg group by 1, 2) c on c.grp is not distinct from g.grp and c.segment = l.segment),
places as (select grp, segment, j, j / bins * (n - 1) as place from (select *, unnest(range(1, bins)) as j from planned)),
cuts as (select p.grp, p.segment, j, min(v) + (max(v) - min(v)) * any_value(place - floor(place)) as edge from places p join ranked r on r.grp is not distinct from p.grp and r.segment = p.segment and r.i in (floor(place)::bigint, ceil(place)::bigint) group by 1, 2, 3),
edges as (select p.grp, p.segment, list_sort(list_distinct(list_concat([any_value(seg_low), any_value(seg_high)], coalesce(list(edge) filter (edge is not null), [])))) as e from planned p left join cuts c on c.grp is not distinct from p.grp and c.segment = p.segment group by 1, 2),
bins as (select grp, segment, b as bin, e[b] as low, e[b + 1] as high from (select *, unnest(range(1, len(e))) as b from edges)),
held as (select b.grp, b.segment, b.bin, low, high, s.ClassicFDR, s.PartitionedFDR, s.Delta from bins b left join seg s on s.grp is not distinct from b.grp and s.segment = b.segment and s.ClassicFDR >= low and (s.ClassicFDR < high or b.segment = {len(C.SEGMENTS)} and s.ClassicFDR = high and high = 1))"""


_SPARSE = _bins_sql(LEAST // 10) + f""", counted as (select grp, segment, bin, low, high, count(ClassicFDR) as n from held group by all),
numbered as (select *, row_number() over (partition by grp, segment order by bin) as i, sum(n) over (partition by grp, segment) as total from counted),
walk as (select grp, segment, i, low, high, n, total, 1 as k, n as open_rows, 1 as size from numbered where i = 1
 union all select x.grp, x.segment, x.i, x.low, x.high, x.n, x.total, case when w.open_rows >= {LEAST} then k + 1 else k end, case when w.open_rows >= {LEAST} then x.n else w.open_rows + x.n end, 1 from walk w join numbered x on x.grp is not distinct from w.grp and x.segment = w.segment and x.i = w.i + 1),
last_open as (select grp, segment, max(k) as k, arg_max(open_rows, i) as open_rows from walk group by 1, 2),
placed as (select w.grp, w.segment, w.i, w.low, w.high, w.n, case when w.k = l.k and l.open_rows < {LEAST} and l.k > 1 then l.k - 1 else w.k end as bin from walk w join last_open l on l.grp is not distinct from w.grp and l.segment = w.segment)
select grp, segment, bin::integer as bin, {_R("min(low)", "low")}, {_R("max(high)", "high")}, sum(n)::bigint as n, count(*)::integer as merged from placed group by 1, 2, 3"""
SQL = {
    "quantile_bins": "with " + _TRAIN + _bins_sql(LEAST) + f""" select grp, segment, bin::integer as bin, {_R("any_value(low)", "low")}, {_R("any_value(high)", "high")}, count(ClassicFDR) as n_train, {_R("avg(ClassicFDR)", "mean_classic_fdr")}, {_R("avg(PartitionedFDR)", "mean_partitioned_fdr")}, {_R("avg(Delta)", "mean_delta")}, {_R("stddev_samp(Delta)", "sd_delta")},
 {_R("avg((Delta < 0)::int)", "fraction_lower")}, {_R("avg((Delta = 0)::int)", "fraction_equal")}, {_R("avg((Delta > 0)::int)", "fraction_higher")}, {_R("stddev_samp(Delta) / sqrt(count(Delta))", "sem_delta")}, {_R("median(ClassicFDR)", "median_classic_fdr")}, {_R("median(PartitionedFDR)", "median_partitioned_fdr")},
 {_R("median(Delta)", "median_delta")}, {_R("quantile_cont(Delta, 0.1)", "q10_delta")}, {_R("quantile_cont(Delta, 0.25)", "q25_delta")}, {_R("quantile_cont(Delta, 0.75)", "q75_delta")}, {_R("quantile_cont(Delta, 0.9)", "q90_delta")} from held group by 1, 2, 3""",
    "sparse_bins": "with recursive " + _TRAIN + _SPARSE,
    "correction_levels": "with " + _TRAIN + _LEVELS + f" select grp, {_R('ClassicFDR', 'ClassicFDR')}, rows, scans, peptides, {_R('mean_delta', 'mean_delta')}, {_R('mean_partitioned', 'mean_partitioned')}, {_R('median_delta', 'median_delta')}, {_R('median_partitioned', 'median_partitioned')} from levels",
    "rolling_windows": "with " + _TRAIN + _LEVELS + _WINDOWS + f" select grp, segment, start, {_names[0].replace(' ', ', ')}, {', '.join(_R(n, n) for n in _names[1].split())} from windows",
    "anchors": "with " + _TRAIN + _LEVELS + _WINDOWS + _ANCHORS + f" select grp, {_R('fdr_anchor', 'fdr_anchor')}, {_R('delta_anchor', 'delta_anchor')}, n_train, role from anchors",
    "isotonic_curve": _UP_TO + f" select grp, {_R("fdr_anchor", "fdr_anchor")}, n_train, {_R("y", "raw_corrected")}, {_R("c", "corrected")} from curve",
    "curve_reversals": _UP_TO + f", d as (select *, y - lag(y) over (partition by grp order by fdr_anchor) < -1e-15 as fall from curve) select grp, count(*) as anchors, coalesce(sum(fall::int), 0)::bigint as reversals, {_R('max(abs(c - y))', 'largest_adjustment', 8)} from d group by grp",
    "apply_correction": _UP_TO + _APPLY + f" select grp, ScanNum, PeptideKey, {_R("ClassicFDR", "ClassicFDR")}, {_R("PredictedFDR", "PredictedFDR")} from predicted",
    "validation_windows": _UP_TO + _APPLY + ", win as (select * from (values " + ", ".join(f"({k}, {float(a)}::double, {float(b)}::double)" for k, (a, b) in enumerate(C.WINDOWS, 1)) + f""") v(window_index, lo, hi)), e as (select p.grp, window_index, PredictedFDR - PartitionedFDR as error from predicted p join win on ClassicFDR >= lo and (ClassicFDR < hi or (hi = 1 and ClassicFDR <= 1)))
 select grp, window_index, count(*) as n, {_R('avg(error)', 'mean_error', 7)}, {_R('avg(abs(error))', 'mae', 7)}, {_R('max(abs(error))', 'max_abs_error', 7)}, {_R('median(error)', 'median_error', 7)}, {_R('median(abs(error))', 'median_abs_error', 7)},
 {_R('quantile_cont(abs(error), 0.75)', 'q75_abs_error', 7)}, {_R('quantile_cont(abs(error), 0.9)', 'q90_abs_error', 7)}, {_R('quantile_cont(abs(error), 0.95)', 'q95_abs_error', 7)} from e group by 1, 2""",
    "cutoff_confusion": _UP_TO + _APPLY + f""", x as (select *, unnest([0.01, 0.05, 0.1, 0.2]::double[]) as cutoff from predicted), y as (select *, ClassicFDR <= cutoff as k, PartitionedFDR <= cutoff as o, PredictedFDR <= cutoff as p from x),
 z as (select grp, cutoff, count(*) as n, count(*) filter (k) as classic_pass, count(*) filter (o) as observed_pass, count(*) filter (p) as predicted_pass, count(*) filter (p and o) as tp, count(*) filter (not p and not o) as tn, count(*) filter (p and not o) as fp, count(*) filter (not p and o) as fn,
  count(*) filter (o and not k) as observed_gain, count(*) filter (not o and k) as observed_loss, count(*) filter (p and not k) as predicted_gain, count(*) filter (not p and k) as predicted_loss from y group by 1, 2)
 select *, {_R('(tp + tn) / n', 'accuracy')}, {_R('tp / nullif(tp + fp, 0)', 'precision')}, {_R('tp / nullif(tp + fn, 0)', 'recall')} from z""",
    "hash_split": "with " + _TRAIN + " select grp, count(*) as rows, count(*) filter (cast(concat('0x', substr(sha256(concat(ScanNum, '|', PeptideKey)), 1, 16)) as ubigint)::double / 18446744073709551615::double < 0.2) as held_out from train group by grp",
    "scan_gain_loss": _UP_TO + _APPLY + """, scans as (select grp, ScanNum, min(ClassicFDR) as o, min(round(PredictedFDR, 8)) as c, string_agg(distinct PeptideKey, ';' order by PeptideKey) as pep from predicted group by 1, 2),
 x as (select *, unnest([0.01, 0.05]::double[]) as Threshold from scans), y as (select *, coalesce(o <= Threshold, false) as a, coalesce(c <= Threshold, false) as b from x)
 select grp, Threshold, count(*) as UniqueScans, count(*) filter (a) as OriginalPassScans, count(*) filter (b) as CorrectedPassScans, count(*) filter (not a and b) as GainedScans, count(*) filter (a and not b) as LostScans,
  count(*) filter (b) - count(*) filter (a) as NetPassScanChange, count(*) filter (a and b) as PassBothScans, count(*) filter (not a and not b) as FailBothScans, count(distinct pep) filter (not a and b and pep <> '') as GainedUniquePeptideStrings,
  case when grouping(grp) = 1 then 'ALL_FILES' else 'file' end as Scope from y group by grouping sets ((grp, Threshold), (Threshold))""",
    "correction_diagnostics": _UP_TO + _APPLY + f""", r0 as (select grp, ScanNum, ClassicFDR as o, round(PredictedFDR, 8) as c from predicted),
 s as (select grp as g, count(*) as n, count(*) filter (k > 1) as several from (select grp, ScanNum, count(distinct o) as k from r0 group by 1, 2) group by 1), r as (select r0.*, n, several from r0 join s on s.g is not distinct from r0.grp)
 select grp, count(*) as rows, count(*) filter (o is null) as missing_fdr, count(*) filter (o < 0 or o > 1) as out_of_range, count(*) filter (c is null and o is not null) as uncorrected, count(*) filter (c < o) as lowered, count(*) filter (c = o) as unchanged, count(*) filter (c > o) as raised,
  count(o) as with_fdr, {_R('min(o)', 'least_original', 7)}, {_R('max(o)', 'most_original', 7)}, {_R('min(c)', 'least_corrected', 7)}, {_R('max(c)', 'most_corrected', 7)}, count(*) filter (c = 0) as corrected_to_zero, count(*) filter (c = 1) as corrected_to_one, count(*) filter (abs(c - o) <= 1e-8 + 1e-5 * abs(o)) as equal,
  any_value(n) as scans_with_fdr, any_value(several) as scans_with_several_fdrs, count(distinct ScanNum) as scans, {_R('avg(c - o)', 'mean_shift', 7)}, {_R('max(abs(c - o))', 'largest_shift', 7)} from r group by grp""",
}
