"""Queries on partition observations and the comparison of full and binned FDR."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.fixtures import fixture, oracle
from spectraloom.functions.scalars import interval_name
from spectraloom.operators import collect, compare
from spectraloom.plans.psm_queries import _C
from spectraloom.session import materialize, table

DIGITS = 9


#: Added before rounding: means of short decimals may end in 5, and then the last bit of a sum would decide.
NUDGE = 3.3e-14


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree; -0.0 becomes 0.0."""
    return df.select(*[(F.round(F.col(c) + F.lit(NUDGE), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _rows(spark, sf_dir):
    return collect.with_cores(fixture(spark, sf_dir, "fx_partition_obs"))


def partition_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.observations(_rows(spark, sf_dir)).select("RunFolder", "ScanNum", "CorePeptide", "Peptide", "Protein", "PartitionFDR", "PartitionExactPeptideForms", "PartitionExactPeptideFormCount", "PartitionProteinMappingCount")


def partition_fdr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(collect.fdr_summary(collect.observations(_rows(spark, sf_dir)), ["ScanNum", "CorePeptide"]))


def partition_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.conflicts(_rows(spark, sf_dir))


def core_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(collect.core_summary(collect.observations(_rows(spark, sf_dir))))


def core_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation that lends each scan and peptide its metadata."""
    return collect.representatives(collect.observations(_rows(spark, sf_dir)), ["ScanNum", "CorePeptide"]).select("ScanNum", "CorePeptide", "RunFolder", "Peptide", "Protein", "SpecEValue", "PartitionFDR", "MSGFScore")


def compare_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = compare.base_summary(fixture(spark, sf_dir, "fx_base"))
    binned = collect.fdr_summary(collect.observations(_rows(spark, sf_dir)), ["ScanNum", "CorePeptide"])
    wide = compare.with_pass_columns(compare.compare(base, binned), [0.05])
    return rounded(wide.select("ScanNum", "CorePeptide", "ComparisonStatus", "InBase", "InBinning", "BaseFDR", "BinnedFDRMedian", "DeltaBinnedMedianMinusBase", "BasePass_0p05", "BinnedMedianPass_0p05"))


def _wide(spark, sf_dir):
    return table(spark, sf_dir, "fdr_compare_wide")


def threshold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.threshold_report(_wide(spark, sf_dir), [0.01, 0.05, 0.1], ["Median", "Min", "Max"])


def delta_interval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.delta_statistics(_wide(spark, sf_dir), "BaseFDR", "DeltaBinnedMedianMinusBase", compare.EDGES), 6)


def _shared(spark, sf_dir):
    return compare.shared_rows(_wide(spark, sf_dir), "ConditionName")


def fdr_overall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.overall_summary(_shared(spark, sf_dir)))


def delta_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.delta_histogram(_shared(spark, sf_dir)))


def fdr_interval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.interval_summary(_shared(spark, sf_dir)))


def fdr_threshold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.threshold_summary(_shared(spark, sf_dir))


_OBS = f"""cores as (select *, {_C} as CorePeptide, regexp_replace({_C}, '[^A-Z]', '', 'g') as UnmodifiedPeptide from fx_partition_obs),
forms as (select RunFolder, ScanNum, CorePeptide, string_agg(distinct Peptide, ';' order by Peptide) as PartitionExactPeptideForms, count(distinct Peptide)::integer as PartitionExactPeptideFormCount, count(distinct Protein)::integer as PartitionProteinMappingCount from cores group by 1, 2, 3),
obs as (select * from (select * from cores qualify row_number() over (partition by RunFolder, ScanNum, CorePeptide order by SpecEValue, PartitionFDR, Peptide, Protein, MSGFScore) = 1) join forms using (RunFolder, ScanNum, CorePeptide))
"""
_R = lambda x, name, digits=DIGITS: f"round({x} + {NUDGE}::double, {digits}) + 0.0 as {name}"
_SUMMARY = f"""summary as (select ScanNum, CorePeptide, count(*) as RowsAcrossBins, count(distinct RunFolder) as PartitionBinsRepresented, {_R("avg(PartitionFDR)", "BinnedFDRMean")}, {_R("median(PartitionFDR)", "BinnedFDRMedian")},
 {_R("min(PartitionFDR)", "BinnedFDRMin")}, {_R("max(PartitionFDR)", "BinnedFDRMax")}, {_R("stddev_samp(PartitionFDR)", "BinnedFDRStd")}, count(PartitionFDR) as BinnedFDRCount, string_agg(distinct RunFolder, ';' order by RunFolder) as BinnedRunFolders,
 {_R("min(MSGFScore)", "MSGFScoreMin")}, {_R("max(MSGFScore)", "MSGFScoreMax")}, {_R("max(PartitionFDR) - min(PartitionFDR)", "BinnedFDRRange")}, {_R("max(MSGFScore) - min(MSGFScore)", "MSGFScoreRange")} from obs group by 1, 2)
"""


def _case(x: str) -> str:
    edges = compare.EDGES
    return "case " + " ".join(f"when {x} {'>=' if k == 0 else '>'} {a} and {x} <= {b} then '{interval_name(edges, k)}'" for k, (a, b) in enumerate(zip(edges, edges[1:]))) + " end"


_SHARED = """rows as (select ConditionName as Dataset, BaseFDR, BinnedFDRMedian as BinnedFDR, BinnedFDRMedian - BaseFDR as DeltaFDR, UnmodifiedPeptide from fdr_compare_wide
  where ComparisonStatus = 'shared' and BaseFDR is not null and not isnan(BaseFDR) and BinnedFDRMedian is not null and not isnan(BinnedFDRMedian))
"""
_q = lambda c, p: f"quantile_cont({c}, {p})"
QUERIES = {
    "partition_observations": partition_observations, "partition_fdr_summary": partition_fdr_summary, "partition_conflicts": partition_conflicts, "core_summary": core_summary, "core_representatives": core_representatives, "compare_status": compare_status,
    "threshold_report": threshold_report, "delta_interval_stats": delta_interval_stats, "fdr_overall_summary": fdr_overall_summary, "delta_histogram": delta_histogram, "fdr_interval_summary": fdr_interval_summary, "fdr_threshold_summary": fdr_threshold_summary,
}
SQL = {
    "partition_observations": oracle("fx_partition_obs", then=_OBS + "select RunFolder, ScanNum, CorePeptide, Peptide, Protein, PartitionFDR, PartitionExactPeptideForms, PartitionExactPeptideFormCount, PartitionProteinMappingCount from obs"),
    "partition_fdr_summary": oracle("fx_partition_obs", then=_OBS + ", " + _SUMMARY + "select * from summary"),
    "partition_conflicts": oracle("fx_partition_obs", then=_OBS + """ select RunFolder, ScanNum, CorePeptide, count(distinct Peptide) as ExactPeptideForms, count(distinct Protein) as ProteinMappings,
 count(distinct PartitionFDR) as PartitionFDRUnique, min(PartitionFDR) as PartitionFDRMin, max(PartitionFDR) as PartitionFDRMax, count(distinct SpecEValue) as SpecEValueUnique, min(SpecEValue) as SpecEValueMin, max(SpecEValue) as SpecEValueMax
 from cores group by 1, 2, 3 having count(distinct PartitionFDR) > 1 or count(distinct SpecEValue) > 1"""),
    "core_summary": oracle("fx_partition_obs", then=_OBS + ", " + _SUMMARY + """, split as (select ScanNum, CorePeptide, unnest(string_split(PartitionExactPeptideForms, ';')) as form from obs),
 f as (select ScanNum, CorePeptide, string_agg(distinct form, ';' order by form) as BinnedPeptideForms, count(distinct form)::integer as BinnedPeptideFormCount from split group by 1, 2),
 e as (select ScanNum, CorePeptide, min(UnmodifiedPeptide) as UnmodifiedPeptide, count(distinct Protein) as BinnedProteinCount, string_agg(distinct Protein, ';' order by Protein) as BinnedProteins,
   max(PartitionExactPeptideFormCount) as MaxExactFormsWithinPartition, count(*) filter (PartitionExactPeptideFormCount > 1) as PartitionsWithMultipleExactForms from obs group by 1, 2)
 select * from summary join e using (ScanNum, CorePeptide) join f using (ScanNum, CorePeptide)"""),
    "core_representatives": oracle("fx_partition_obs", then=_OBS + "select ScanNum, CorePeptide, RunFolder, Peptide, Protein, SpecEValue, PartitionFDR, MSGFScore from obs qualify row_number() over (partition by ScanNum, CorePeptide order by SpecEValue nulls last, PartitionFDR nulls last, RunFolder) = 1"),
    "compare_status": oracle("fx_partition_obs", "fx_base", then=_OBS + f""", base as (select ScanNum, {_C} as CorePeptide, median(FDR) as b from fx_base group by 1, 2), bin as (select ScanNum, CorePeptide, median(PartitionFDR) as m from obs group by 1, 2)
 select coalesce(base.ScanNum, bin.ScanNum) as ScanNum, coalesce(base.CorePeptide, bin.CorePeptide) as CorePeptide,
  case when b is not null and m is not null then 'shared' when b is not null then 'base_only' else 'binning_only' end as ComparisonStatus, b is not null as InBase, m is not null as InBinning,
  {_R("b", "BaseFDR")}, {_R("m", "BinnedFDRMedian")}, {_R("m - b", "DeltaBinnedMedianMinusBase")}, coalesce(b <= 0.05, false) as BasePass_0p05, coalesce(m <= 0.05, false) as BinnedMedianPass_0p05
 from base full join bin on base.ScanNum = bin.ScanNum and base.CorePeptide = bin.CorePeptide"""),
    "threshold_report": """with t as (select unnest([0.01, 0.05, 0.1]::double[]) as Threshold), s as (select unnest(['median', 'min', 'max']) as BinnedStatistic), sc as (select unnest(['all', 'shared']) as Scope),
x as (select Threshold, BinnedStatistic, Scope, UnmodifiedPeptide, coalesce(BaseFDR <= Threshold and not isnan(BaseFDR), false) as b,
  coalesce(case BinnedStatistic when 'median' then BinnedFDRMedian when 'min' then BinnedFDRMin else BinnedFDRMax end <= Threshold, false) as p
  from fdr_compare_wide, t, s, sc where Scope = 'all' or ComparisonStatus = 'shared')
select Threshold, BinnedStatistic, Scope, count(*) as TotalKeys, count(*) filter (b) as BasePassKeys, count(*) filter (p) as BinnedPassKeys, count(*) filter (b and p) as PassBothKeys,
 count(*) filter (b and not p) as BasePass_BinnedFailKeys, count(*) filter (not b and p) as BaseFail_BinnedPassKeys, count(distinct UnmodifiedPeptide) as UniquePeptides_Total,
 count(distinct UnmodifiedPeptide) filter (b) as UniquePeptides_BasePass, count(distinct UnmodifiedPeptide) filter (p) as UniquePeptides_BinnedPass, count(distinct UnmodifiedPeptide) filter (b and p) as UniquePeptides_PassBoth,
 count(distinct UnmodifiedPeptide) filter (b and not p) as UniquePeptides_BasePass_BinnedFail, count(distinct UnmodifiedPeptide) filter (not b and p) as UniquePeptides_BaseFail_BinnedPass
from x group by all""",
    "fdr_overall_summary": f"with {_SHARED} select Dataset, count(*) as N, {_R('avg(BaseFDR)', 'BaseFDRMean')}, {_R('median(BaseFDR)', 'BaseFDRMedian')}, {_R('avg(BinnedFDR)', 'BinnedFDRMean')}, {_R('median(BinnedFDR)', 'BinnedFDRMedian')}, {_R('avg(DeltaFDR)', 'DeltaFDRMean')}, {_R('median(DeltaFDR)', 'DeltaFDRMedian')}, "
    + ", ".join(_R(_q("DeltaFDR", p), f"DeltaFDRQ{p[2:]}") for p in ("0.05", "0.25", "0.75", "0.95"))
    + f", count(*) filter (DeltaFDR < 0) as ImprovedCount, count(*) filter (abs(DeltaFDR) <= 1e-15) as UnchangedCount, count(*) filter (DeltaFDR > 0) as WorsenedCount, {_R('avg((DeltaFDR < 0)::int)', 'ImprovedFraction')}, {_R('avg((DeltaFDR > 0)::int)', 'WorsenedFraction')}, count(distinct UnmodifiedPeptide) as UniquePeptides from rows group by Dataset",
    "delta_histogram": f"with {_SHARED}, b as (select Dataset, least(floor((DeltaFDR + 1) / 0.05::double), 39)::integer as Bucket, count(*) as N from rows group by 1, 2) select Dataset, Bucket, {_R('Bucket * 0.05::double - 1', 'Low')}, {_R('(Bucket + 1) * 0.05::double - 1', 'High')}, N from b",
    "fdr_interval_summary": f"with {_SHARED}, labelled as (select *, {_case('BaseFDR')} as BaseFDRInterval from rows), intervals as (select * from (values "
    + ", ".join(f"('{interval_name(compare.EDGES, k)}', {a}::double, {b}::double, {(a + b) / 2}::double)" for k, (a, b) in enumerate(zip(compare.EDGES, compare.EDGES[1:])))
    + f") v(BaseFDRInterval, l, r, m)), datasets as (select distinct Dataset from rows) select d.Dataset, i.BaseFDRInterval, {_R('any_value(l)', 'IntervalLeft')}, {_R('any_value(r)', 'IntervalRight')}, {_R('any_value(m)', 'IntervalMidpoint')}, count(DeltaFDR) as N, {_R('avg(DeltaFDR)', 'DeltaFDRMean')}, {_R('median(DeltaFDR)', 'DeltaFDRMedian')}, {_R(_q('DeltaFDR', 0.25), 'DeltaFDRQ25')}, {_R(_q('DeltaFDR', 0.75), 'DeltaFDRQ75')}, {_R('avg((DeltaFDR < 0)::int)', 'ImprovedFraction')}, {_R('avg((DeltaFDR > 0)::int)', 'WorsenedFraction')} from datasets d cross join intervals i left join labelled x on x.Dataset is not distinct from d.Dataset and x.BaseFDRInterval = i.BaseFDRInterval group by 1, 2",
    "fdr_threshold_summary": f"""with {_SHARED}, x as (select *, unnest([0.01, 0.05]::double[]) as Threshold from rows), y as (select *, BaseFDR <= Threshold as b, BinnedFDR <= Threshold as p from x)
select Dataset, Threshold, count(*) as N, count(*) filter (b) as BasePassCount, count(*) filter (p) as PartitionPassCount, count(*) filter (p) - count(*) filter (b) as NetPassChange, count(*) filter (not b and p) as GainedPassCount,
 count(*) filter (b and not p) as LostPassCount, count(*) filter (b and p) as PassBothCount, count(distinct UnmodifiedPeptide) filter (not b and p) as GainedUniquePeptides, count(distinct UnmodifiedPeptide) filter (b and not p) as LostUniquePeptides from y group by 1, 2""",
    "delta_interval_stats": f"""with x as (select {_case("BaseFDR")} as Interval, case when not isnan(DeltaBinnedMedianMinusBase) then DeltaBinnedMedianMinusBase end as d, UnmodifiedPeptide from fdr_compare_wide where not isnan(BaseFDR)),
m as (select Interval, count(d) as n, avg(d) as mu from x group by 1), c as (select x.Interval, any_value(n) as n, avg((d - mu)^2) as m2, avg((d - mu)^3) as m3, avg((d - mu)^4) as m4 from x join m using (Interval) group by 1),
k as (select Interval, n, m3 / m2^1.5 as g1, m4 / m2^2 - 3 as g2 from c),
z as (select *, g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) as y, 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) as b2, (g2 + 3 - 3.0 * (n - 1) / (n + 1)) / sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) * (n + 1) * (n + 3) * (n + 5))) as xx,
  6.0 * (n * n - 5 * n + 2) / ((n + 7.0) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3))) as beta from k where n >= 20),
z2 as (select *, sqrt(2 * (b2 - 1)) - 1 as w2, 6 + 8 / beta * (2 / beta + sqrt(1 + 4 / (beta * beta))) as a from z),
z3 as (select *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) as z1, (1 - 2 / a) / (1 + xx * sqrt(2 / (a - 4))) as ratio from z2),
z4 as (select Interval, z1 * z1 + pow((1 - 2 / (9 * a) - sign(ratio) * pow(abs(ratio), 1.0 / 3)) / sqrt(2 / (9 * a)), 2) as k2 from z3)
select x.Interval, count(*) as N_ScanPeptideKeys, count(distinct UnmodifiedPeptide) as N_UniquePeptides, {_R("avg(d)", "DeltaMean", 6)}, {_R("coalesce(stddev_samp(d), 0)", "DeltaStd", 6)}, {_R("min(d)", "DeltaMin", 6)}, {_R("max(d)", "DeltaMax", 6)},
 {_R("skewness(d)", "Skew", 6)}, {_R("kurtosis(d)", "ExcessKurtosis", 6)}, {_R("count(*) filter (d < 0) / count(d)", "FractionNegative", 6)}, {_R("count(*) filter (d > 0) / count(d)", "FractionPositive", 6)}, {_R("count(*) filter (d = 0) / count(d)", "FractionZero", 6)},
 case when count(d) < 8 then 'not_run_n_lt_8' when count(d) < 20 then 'not_run_shapiro' else 'DAgostinoK2' end as NormalityTest, {_R("any_value(k2)", "NormalityStatistic", 6)}, {_R("any_value(exp(-k2 / 2))", "NormalityPValue", 6)},
 {", ".join(_R(_q("d", p), name, 6) for name, p in (("DeltaMedian", 0.5), ("DeltaQ01", 0.01), ("DeltaQ05", 0.05), ("DeltaQ25", 0.25), ("DeltaQ75", 0.75), ("DeltaQ95", 0.95), ("DeltaQ99", 0.99)))}
from x left join z4 on z4.Interval = x.Interval where x.Interval is not null group by x.Interval having count(d) > 0""",
}
