"""Queries on digestion, bins, protein mapping, filters and culling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.fixtures import fixture, oracle
from spectraloom.functions import scalars as S
from spectraloom.operators import bins, cull, digest, psm
from spectraloom.operators.fdr import best_per_scan, monotone_fdr
from spectraloom.plans.fdr_queries import _BEST, _FDR, TIES
from spectraloom.session import materialize, table

GROUPS = 9


def _edges(spark, sf_dir):
    return digest.digest_edges(fixture(spark, sf_dir, "fx_protein"), "protein_id", "seq")


def digest_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.digest_map(_edges(spark, sf_dir))


def digest_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.removed(digest_map(spark, sf_dir))


def digest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = materialize(digest_map(spark, sf_dir), "digest")
    return digest.digest_stats(mapped, digest.removed(mapped))


def _residues(spark, sf_dir):
    return table(spark, sf_dir, "target_peptides").select(S.peptide_core("t1").alias("Peptide")).filter("Peptide <> ''").distinct()


def tda_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target peptides whose reverse is a target peptide too."""
    return digest.reversed_pairs(_residues(spark, sf_dir))


def bin_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.group_assignments(digest_map(spark, sf_dir), GROUPS)


def pair_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = bins.pair_assignments(bin_assign(spark, sf_dir), GROUPS)
    return pairs.groupBy("PairGroupA", "PairGroupB").agg(F.count(F.lit(1)).alias("peptides"), F.min("Peptide").alias("first"), F.max("Peptide").alias("last"))


def bin_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.bin_summary(bin_assign(spark, sf_dir), GROUPS)


def core_peptide_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal forms of every reported peptide."""
    rows = table(spark, sf_dir, "psm_syn").select("Peptide").filter("Peptide is not null").distinct()
    parts = S.flanked_parts("Peptide")
    return rows.select("Peptide", S.core_peptide("Peptide").alias("core"), S.unmodified_peptide("Peptide").alias("unmodified"), S.peptide_core("Peptide").alias("upper_core"), S.canonical_peptide("Peptide").alias("canonical"), parts["n_flank"].alias("n_flank"), parts["c_flank"].alias("c_flank"))


def decoy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the two decoy rules: the field begins with the prefix; any identifier in it does."""
    rows = table(spark, sf_dir, "psm_syn")
    return rows.groupBy("Charge").agg(F.count(F.lit(1)).alias("rows"), F.count_if(S.is_decoy("Protein")).alias("leading"), F.count_if(S.has_decoy("Protein")).alias("any_token"))


def _best(spark, sf_dir):
    return best_per_scan(fixture(spark, sf_dir, "fx_psm_raw"), ["Run", "ScanNum"], "ParentIonIntensity", TIES)


def syn_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = psm.append_syn(_best(spark, sf_dir), fixture(spark, sf_dir, "fx_syn"), "Scan", ties=["Protein", *TIES])
    return merged.select("Run", "ScanNum", "Peptide", "Protein", "QValue", "SpecEValue", "IsDecoy", "Appended")


def _map_edges(spark, sf_dir):
    """Every peptide with the proteins that SYN has for it; peptides that it has with decoys only are not in the map."""
    rows = fixture(spark, sf_dir, "fx_syn")
    return rows.select(S.canonical_peptide("Peptide").alias("Peptide"), "Protein").filter(~S.is_decoy("Protein")).distinct()


def _parents(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_psm_raw").filter(~S.is_decoy("Protein"))
    return rows.groupBy("Protein").agg(F.max(S.canonical_peptide("Peptide")).alias("ParentPeptide"))


def map_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = psm.expand_by_map(_best(spark, sf_dir), _map_edges(spark, sf_dir))
    return out.select("Run", "ScanNum", "Peptide", "OriginalProtein", "Protein", "Mapped")


def map_expand_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = psm.expand_by_map(_best(spark, sf_dir), _map_edges(spark, sf_dir), _parents(spark, sf_dir))
    return out.select("Run", "ScanNum", "Peptide", "OriginalProtein", "Protein", "Mapped")


def expansion_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return psm.expansion_audit(map_expand_fallback(spark, sf_dir), ["Run", "ScanNum", "Peptide", "OriginalProtein"])


def _scored(spark, sf_dir):
    return monotone_fdr(_best(spark, sf_dir), ["Run"], "SpecEValue", ["ScanNum", *TIES], counted=fixture(spark, sf_dir, "fx_psm_raw"))


def _filtered(**options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = psm.filtered_targets(_scored(spark, sf_dir), **options)
        return out.select("Run", "ScanNum", "Peptide", "PeptideFlanked", "Protein", F.round("FDR", 9).alias("FDR"), "ParentIonIntensity").distinct()

    return query


def filter_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict filter: FDR, MSMSScore and QValue at once. Scores are a hundred thousandth of the fixture's, and zeros are poor ones, so that some reach it."""
    best = _best(spark, sf_dir).withColumn("SpecEValue", F.when(F.col("SpecEValue") > 0, F.col("SpecEValue")).otherwise(F.lit(0.00005)) / 100_000)
    scored = monotone_fdr(best, ["Run"], "SpecEValue", ["ScanNum", *TIES], counted=fixture(spark, sf_dir, "fx_psm_raw"))
    out = psm.filtered_targets(scored, "stringent")
    return out.select("Run", "ScanNum", "Peptide", "PeptideFlanked", "Protein", F.round("FDR", 9).alias("FDR"), "ParentIonIntensity").distinct()


def filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return psm.filter_stats(psm.metric_filter(_scored(spark, sf_dir), "FDR", 0.2))


def _cull_inputs(spark, sf_dir):
    sic = fixture(spark, sf_dir, "fx_partition_obs").filter("cast(SpecEValue * 1000000 as int) % 2 = 0")
    syn = fixture(spark, sf_dir, "fx_partition_obs").filter("cast(SpecEValue * 1000000 as int) % 2 = 1")
    keys = cull.reference_keys(fixture(spark, sf_dir, "fx_base"))
    return sic, syn, keys


CULL_TIES = ["Peptide", "Protein", "PartitionFDR", "SpecEValue", "MSGFScore"]


def _culled(spark, sf_dir):
    sic, syn, keys = _cull_inputs(spark, sf_dir)
    return cull.cull(sic, syn, keys, ["RunFolder"], CULL_TIES)


def cull_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    sic, _, keys = _cull_inputs(spark, sf_dir)
    return cull.supported(sic, keys).select("RunFolder", "ScanNum", "CorePeptide", "Protein", "PartitionFDR", "SpecEValue")


def cull_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _culled(spark, sf_dir).select("RunFolder", "ScanNum", "Peptide", "Protein", "SpecEValue", "SourceLayer")


def cull_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    sic, syn, keys = _cull_inputs(spark, sf_dir)
    return cull.scan_categories(sic, syn, keys, materialize(_culled(spark, sf_dir), "culled"), ["RunFolder"])


def recovery_by_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, syn, keys = _cull_inputs(spark, sf_dir)
    return cull.recovery_by_scan(keys, _culled(spark, sf_dir), syn, "RunFolder")


def recovery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cull.recovery_summary(materialize(recovery_by_scan(spark, sf_dir), "recovery"))


def cull_file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sic, syn, _ = _cull_inputs(spark, sf_dir)
    return cull.file_summary(sic, syn, _culled(spark, sf_dir), "RunFolder")


def cull_file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counter of the culling per partition; a tenth partition is expected, but has no input."""
    sic, syn, keys = _cull_inputs(spark, sf_dir)
    folders = spark.range(1, 11).select(F.concat(F.lit("exp_group_"), "id").alias("RunFolder"))
    return cull.file_report(sic, syn, keys, materialize(_culled(spark, sf_dir), "culled"), "RunFolder", folders).withColumn("RowFDR", F.round("RowFDR", 9))


def digest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.digest_report(fixture(spark, sf_dir, "fx_protein"), "protein_id", "seq")


def reference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cull.reference_summary(fixture(spark, sf_dir, "fx_base"))


_DIGEST = """cut as (select protein_id, unnest(string_split(rtrim(regexp_replace(regexp_replace(seq, '([KR])', '\\1~', 'g'), '~([^ACDEFGHIKLMNQRSTVWY])', '\\1', 'g'), '~'), '~')) as Peptide from fx_protein),
edges as (select distinct Peptide, protein_id as Protein from cut where length(Peptide) between 6 and 50),
mapped as (select Peptide, count(*) as ProteinCount, string_agg(Protein, ';' order by Protein) as Proteins from edges group by Peptide)"""
_REMOVED = """, clean as (select * from mapped where not regexp_matches(Peptide, '[^ACDEFGHIKLMNPQRSTVWY]')),
removed as (select *, 'noncanonical' as Reason, '' as Partner from mapped where regexp_matches(Peptide, '[^ACDEFGHIKLMNPQRSTVWY]')
  union all select a.*, 'tda_overlap', b.Peptide from clean a join clean b on b.Peptide = reverse(a.Peptide))"""
_ASSIGN = ", assigned as (select Peptide, cast(ntile(9) over (order by md5(concat('1|', Peptide)), Peptide) as integer) as \"Group\" from mapped)"
_CORE = "(case when length(trim({0})) - length(replace(trim({0}), '.', '')) >= 2 then trim(regexp_extract(trim({0}), '^[^.]*\\.(.*)\\.[^.]*$', 1)) else trim({0}) end)"
_C = _CORE.format("Peptide")
_KEY = f"regexp_replace({_C}, '[^A-Za-z]', '', 'g')"
_MAP = f""", known as (select distinct {_KEY} as k, Protein as mapped from fx_syn where not starts_with(Protein, 'XXX_')),
parents as (select Protein as parent, max({_KEY}) as pp from fx_psm_raw where not starts_with(Protein, 'XXX_') group by Protein),
direct as (select b.*, k.mapped from best b left join known k on {_KEY.replace("Peptide", "b.Peptide")} = k.k),
lookup as (select distinct parent, mapped from parents join known on pp = k),
rest as (select d.* exclude (mapped), l.mapped from direct d left join lookup l on l.parent = d.Protein and not starts_with(d.Protein, 'XXX_') where d.mapped is null)"""
_OUT = "select Run, ScanNum, Peptide, Protein as OriginalProtein, coalesce(mapped, Protein) as Protein, {0} as Mapped from {1}"
_FALLBACK = f"{_OUT.format(chr(39) + 'direct' + chr(39), 'direct where mapped is not null')} union all {_OUT.format('case when mapped is null then ' + chr(39) + 'none' + chr(39) + ' else ' + chr(39) + 'fallback' + chr(39) + ' end', 'rest')}"


def _filter_sql(where: str, best: str = _BEST) -> str:
    core = "regexp_replace(case when regexp_matches(upper(trim(Peptide)), '^[A-Z\\-]\\.(.+)\\.[A-Z\\-]$') then regexp_extract(upper(trim(Peptide)), '^[A-Z\\-]\\.(.+)\\.[A-Z\\-]$', 1) else upper(trim(Peptide)) end, '[^A-Z]', '', 'g')"
    text = best + ", " + _FDR.format(source="best") + f", final as (select *, -log10(case when SpecEValue = 0 then 1 else SpecEValue end) as MSMSScore from scored) select distinct Run, ScanNum, {core} as Peptide, Peptide as PeptideFlanked, Protein, round(FDR, 9) as FDR, ParentIonIntensity from final where {where} and not contains(lower(Protein), 'contaminant') and not IsDecoy and ParentIonIntensity >= 5000"
    return oracle("fx_psm_raw", then=text)


_CULL = f"""obs as (select *, {_C} as CorePeptide, cast(trunc(SpecEValue * 1000000) as integer) % 2 as layer from fx_partition_obs),
keys as (select distinct ScanNum, {_C} as CorePeptide from fx_base),
sic as (select * from obs where layer = 0), syn as (select * from obs where layer = 1),
a as (select * from sic semi join keys using (ScanNum, CorePeptide)),
b0 as (select * from syn semi join keys using (ScanNum, CorePeptide)),
b as (select * from b0 anti join a using (RunFolder, ScanNum) qualify row_number() over (partition by RunFolder, ScanNum order by CorePeptide, SpecEValue, MSGFScore desc, Peptide, Protein, PartitionFDR) = 1),
both_layers as (select *, 'SIC' as SourceLayer from a union all select *, 'SYN' from b),
culled as (select * from both_layers qualify row_number() over (partition by RunFolder, ScanNum order by SourceLayer, CorePeptide, Peptide, Protein, PartitionFDR, SpecEValue, MSGFScore) = 1)
"""
_RECOVERY = """, got as (select ScanNum, count(distinct RunFolder) as n, count(distinct case when SourceLayer = 'SIC' then RunFolder end) as s, count(distinct case when SourceLayer = 'SYN' then RunFolder end) as y from culled group by ScanNum),
seen as (select ScanNum, count(distinct RunFolder) as o from b0 group by ScanNum),
recovery as (select k.ScanNum, coalesce(n, 0) as Recovered, coalesce(s, 0) as RecoveredSIC, coalesce(y, 0) as AddedSYN, coalesce(o, 0) as ObservedSYN
  from (select distinct ScanNum from keys) k left join got on got.ScanNum = k.ScanNum left join seen on seen.ScanNum = k.ScanNum)
"""

QUERIES = {
    "digest_map": digest_map, "digest_removed": digest_removed, "digest_stats": digest_stats, "tda_overlap": tda_overlap,
    "bin_assign": bin_assign, "pair_bins": pair_bins, "bin_summary": bin_summary, "core_peptide_forms": core_peptide_forms, "decoy_rules": decoy_rules,
    "syn_merge": syn_merge, "map_expand": map_expand, "map_expand_fallback": map_expand_fallback, "expansion_audit": expansion_audit,
    "filter_fdr": _filtered(metric="FDR", threshold=0.2), "filter_score": _filtered(metric="MSMSScore", threshold=5.0),
    "filter_strict": filter_strict, "filter_stringent": _filtered(metric="FDR", threshold=0.3, metric2="QValue", threshold2=0.03), "filter_two_stage": _filtered(metric="MSMSScore", threshold=5.0, metric2="FDR", threshold2=0.2), "filter_stats": filter_stats,
    "cull_semi": cull_semi, "cull_with_fallback": cull_with_fallback, "cull_categories": cull_categories,
    "recovery_by_scan": recovery_by_scan, "recovery_summary": recovery_summary, "cull_file_summary": cull_file_summary, "cull_file_report": cull_file_report, "digest_report": digest_report, "reference_summary": reference_summary,
}
SQL = {
    "digest_map": oracle("fx_protein", then=_DIGEST + " select Peptide, ProteinCount, Proteins from mapped"),
    "digest_removed": oracle("fx_protein", then=_DIGEST + _REMOVED + " select * from removed"),
    "digest_stats": oracle("fx_protein", then=_DIGEST + _REMOVED + """ select count(*) as peptides, count(*) filter (ProteinCount > 1) as shared_peptides, sum(ProteinCount)::bigint as edges,
 count(*) filter (Reason = 'noncanonical') as noncanonical, count(*) filter (Reason = 'tda_overlap') as tda_overlap, count(*) filter (Reason is null) as kept,
 round(count(*) filter (Reason = 'tda_overlap') / count(*) filter (Reason is distinct from 'noncanonical'), 10) as overlap_fraction
 from mapped m left join (select distinct Peptide as gone, Reason from removed) r on r.gone = m.Peptide"""),
    "tda_overlap": """with p as (select distinct regexp_replace(case when regexp_matches(upper(trim(t1)), '^[A-Z\\-]\\.(.+)\\.[A-Z\\-]$') then regexp_extract(upper(trim(t1)), '^[A-Z\\-]\\.(.+)\\.[A-Z\\-]$', 1) else upper(trim(t1)) end, '[^A-Z]', '', 'g') as Peptide from target_peptides)
select a.Peptide, b.Peptide as Partner from p a join p b on b.Peptide = reverse(a.Peptide) where a.Peptide <> ''""",
    "bin_assign": oracle("fx_protein", then=_DIGEST + _ASSIGN + ' select Peptide, "Group" from assigned'),
    "pair_bins": oracle("fx_protein", then=_DIGEST + _ASSIGN + """, g as (select unnest(range(1, 10))::integer as g)
 select x.g as PairGroupA, y.g as PairGroupB, count(*) as peptides, min(Peptide) as first, max(Peptide) as last from g x join g y on x.g < y.g join assigned a on a."Group" in (x.g, y.g) group by 1, 2"""),
    "bin_summary": oracle("fx_protein", then=_DIGEST + _ASSIGN + """ select count(*) as groups, sum(n)::bigint as peptides, min(n) as smallest, max(n) as largest, 36::bigint as expected_pairs from (select count(*) as n from assigned group by "Group")"""),
    "core_peptide_forms": f"""select distinct Peptide, {_C} as core, regexp_replace({_C}, '[^A-Z]', '', 'g') as unmodified,
 regexp_replace(case when regexp_matches(upper(trim(Peptide)), '^[A-Z\\-]\\.(.+)\\.[A-Z\\-]$') then regexp_extract(upper(trim(Peptide)), '^[A-Z\\-]\\.(.+)\\.[A-Z\\-]$', 1) else upper(trim(Peptide)) end, '[^A-Z]', '', 'g') as upper_core,
 regexp_replace({_C}, '[^A-Za-z]', '', 'g') as canonical,
 case when len(string_split(trim(Peptide), '.')) = 3 and string_split(trim(Peptide), '.')[1] not in ('-', '') then string_split(trim(Peptide), '.')[1] end as n_flank,
 case when len(string_split(trim(Peptide), '.')) = 3 and string_split(trim(Peptide), '.')[3] not in ('-', '') then string_split(trim(Peptide), '.')[3] end as c_flank
 from psm_syn where Peptide is not null""",
    "decoy_rules": r"""select Charge, count(*) as rows, count(*) filter (starts_with(Protein, 'XXX_')) as leading,
 count(*) filter (len(list_filter(regexp_split_to_array(Protein, '[;,\s]+'), lambda p: starts_with(p, 'XXX_'))) > 0) as any_token from psm_syn group by Charge""",
    "syn_merge": oracle("fx_psm_raw", "fx_syn", then=_BEST + """, fresh as (select distinct Run, Scan as ScanNum, Peptide, Protein from fx_syn),
 added as (select * from fresh anti join best using (Run, ScanNum, Peptide, Protein)),
 template as (select * from best qualify row_number() over (partition by Run, ScanNum, Peptide order by QValue nulls last, Protein, Ord, Ord2, Ord3) = 1)
 select Run, ScanNum, Peptide, Protein, QValue, SpecEValue, starts_with(Protein, 'XXX_') as IsDecoy, false as Appended from best
 union all select a.Run, a.ScanNum, a.Peptide, a.Protein, t.QValue, t.SpecEValue, starts_with(a.Protein, 'XXX_'), true from added a join template t using (Run, ScanNum, Peptide)"""),
    "map_expand": oracle("fx_psm_raw", "fx_syn", then=_BEST + _MAP + " " + _OUT.format("case when mapped is null then 'none' else 'direct' end", "direct")),
    "map_expand_fallback": oracle("fx_psm_raw", "fx_syn", then=_BEST + _MAP + " " + _FALLBACK),
    "expansion_audit": oracle("fx_psm_raw", "fx_syn", then=_BEST + _MAP + f""", everything as ({_FALLBACK}), n as (select count(*) as n, max(Mapped) as how from everything group by Run, ScanNum, Peptide, OriginalProtein)
 select count(*) as rows_in, sum(n)::bigint as rows_out, count(*) filter (how = 'direct') as direct, count(*) filter (how = 'fallback') as fallback, count(*) filter (how = 'none') as unmapped, sum(n - 1)::bigint as extra_rows, round(avg(n), 9) as fan_out from n"""),
    "filter_fdr": _filter_sql("FDR <= 0.2"), "filter_score": _filter_sql("MSMSScore >= 5"), "filter_stringent": _filter_sql("FDR <= 0.3 and QValue <= 0.03"), "filter_strict": _filter_sql("FDR <= 0.01 and MSMSScore >= 10 and QValue <= 0.05", _BEST.replace("best as (select *", "best as (select * replace (case when SpecEValue > 0 then SpecEValue else 0.00005::double end / 100000 as SpecEValue)")), "filter_two_stage": _filter_sql("MSMSScore >= 5 and FDR <= 0.2"),
    "filter_stats": oracle("fx_psm_raw", then=_BEST + ", " + _FDR.format(source="best") + """, kept as (select * from scored where FDR <= 0.2),
 p as (select bool_and(IsDecoy) as d from kept group by Peptide), q as (select bool_and(IsDecoy) as d from kept group by Protein)
 select (select count(*) from p) as peptides, (select round(100.0 * count(*) filter (d) / greatest(1, count(*)), 4) from p) as peptide_decoy_percent,
        (select count(*) from q) as proteins, (select round(100.0 * count(*) filter (d) / greatest(1, count(*)), 4) from q) as protein_decoy_percent"""),
    "cull_semi": oracle("fx_partition_obs", "fx_base", then=_CULL + "select RunFolder, ScanNum, CorePeptide, Protein, PartitionFDR, SpecEValue from a"),
    "cull_with_fallback": oracle("fx_partition_obs", "fx_base", then=_CULL + "select RunFolder, ScanNum, Peptide, Protein, SpecEValue, SourceLayer from culled"),
    "cull_categories": oracle("fx_partition_obs", "fx_base", then=_CULL + """, scans as (select distinct RunFolder, ScanNum from obs)
 select s.RunFolder, s.ScanNum, case when c.SourceLayer = 'SIC' then 'recovered_by_sic' when c.SourceLayer = 'SYN' and i.ScanNum is null then 'recovered_by_syn_absent_from_sic'
   when c.SourceLayer = 'SYN' then 'recovered_by_syn' when k.ScanNum is not null then 'alternative_only' else 'not_in_reference' end as Category
 from scans s left join culled c on c.RunFolder = s.RunFolder and c.ScanNum = s.ScanNum left join (select distinct RunFolder, ScanNum from sic) i on i.RunFolder = s.RunFolder and i.ScanNum = s.ScanNum
 left join (select distinct ScanNum from keys) k on k.ScanNum = s.ScanNum"""),
    "recovery_by_scan": oracle("fx_partition_obs", "fx_base", then=_CULL + _RECOVERY + "select * from recovery"),
    "recovery_summary": oracle("fx_partition_obs", "fx_base", then=_CULL + _RECOVERY + """, h as (select layer, k, count(*) as n from (select unnest(['a', 's', 'y', 'o']) as layer, unnest([Recovered, RecoveredSIC, AddedSYN, ObservedSYN]) as k from recovery) group by 1, 2)
 select count(*) as total, count(*) filter (Recovered > 0) as recovered, count(*) filter (RecoveredSIC > 0) as recovered_sic, count(*) filter (AddedSYN > 0) as recovered_syn,
  count(*) filter (ObservedSYN > 0) as observed_syn, (select string_agg(concat(k, ':', n), ';' order by k) from h where layer = 'a') as histogram, (select string_agg(concat(k, ':', n), ';' order by k) from h where layer = 's') as recovered_sic_histogram,
  (select string_agg(concat(k, ':', n), ';' order by k) from h where layer = 'y') as recovered_syn_histogram, (select string_agg(concat(k, ':', n), ';' order by k) from h where layer = 'o') as observed_syn_histogram, count(*) filter (Recovered = 0) as unrecovered, round(count(*) filter (Recovered > 0) / count(*), 9) as fraction from recovery"""),
    "cull_file_summary": oracle("fx_partition_obs", "fx_base", then=_CULL + """, x as (select RunFolder, count(*) as sic_rows, count(distinct ScanNum) as sic_scans from sic group by 1), y as (select RunFolder, count(*) as syn_rows, count(distinct ScanNum) as syn_scans from syn group by 1),
 z as (select RunFolder, count(*) as kept_rows, count(*) filter (SourceLayer = 'SIC') as kept_sic, count(*) filter (SourceLayer = 'SYN') as kept_syn, count(distinct CorePeptide) as kept_peptides, count(distinct Protein) as kept_proteins from culled group by 1)
 select * from x full join y using (RunFolder) full join z using (RunFolder)"""),
    "cull_file_report": oracle("fx_partition_obs", "fx_base", then=_CULL + """, refs as (select distinct ScanNum from keys), folders as (select concat('exp_group_', i) as RunFolder from range(1, 11) r(i)),
 x as (select RunFolder, count(*) as InputRows, count(distinct ScanNum) filter (CorePeptide <> '') as GroupUniqueScans, count(distinct ScanNum) filter (CorePeptide <> '' and ScanNum not in (select ScanNum from refs)) as GroupScansNotInReference from sic group by 1),
 y as (select RunFolder, count(*) as SICRowsKept, count(distinct ScanNum) as SICRecoveredScans from a group by 1), z as (select RunFolder, count(*) as SYNMatchingRowsAvailable, count(distinct ScanNum) as SYNMatchingScansAvailable from b0 group by 1),
 o as (select RunFolder, count(*) as OutputRows, count(*) filter (SourceLayer = 'SYN') as SYNFallbackRowsAdded, count(distinct ScanNum) filter (SourceLayer = 'SYN') as SYNFallbackScans, count(distinct ScanNum) as RecoveredScans, count(*) filter (starts_with(Protein, 'XXX_')) as DecoyRows, count(*) filter (not starts_with(Protein, 'XXX_')) as TargetRows from culled group by 1),
 q as (select RunFolder, count(distinct ScanNum) as AlternativeOnlyScans from (select RunFolder, ScanNum from sic semi join refs using (ScanNum)) anti join culled using (RunFolder, ScanNum) group by 1)
 select RunFolder, coalesce(InputRows, 0) as InputRows, coalesce(SICRowsKept, 0) as SICRowsKept, coalesce(SYNFallbackRowsAdded, 0) as SYNFallbackRowsAdded, coalesce(OutputRows, 0) as OutputRows, coalesce(TargetRows, 0) as TargetRows, coalesce(DecoyRows, 0) as DecoyRows, coalesce(GroupUniqueScans, 0) as GroupUniqueScans, coalesce(SICRecoveredScans, 0) as SICRecoveredScans, coalesce(SYNFallbackScans, 0) as SYNFallbackScans,
  coalesce(RecoveredScans, 0) as RecoveredScans, coalesce(AlternativeOnlyScans, 0) as AlternativeOnlyScans, coalesce(GroupScansNotInReference, 0) as GroupScansNotInReference, coalesce(SYNMatchingRowsAvailable, 0) as SYNMatchingRowsAvailable, coalesce(SYNMatchingScansAvailable, 0) as SYNMatchingScansAvailable, round(DecoyRows / OutputRows, 9) as RowFDR
 from folders left join x using (RunFolder) left join y using (RunFolder) left join z using (RunFolder) left join o using (RunFolder) left join q using (RunFolder)"""),
    "digest_report": oracle("fx_protein", then=_DIGEST + """, long as (select Peptide, count(*) as n from cut where length(Peptide) between 6 and 50 group by 1), c as (select *, not regexp_matches(Peptide, '[^ACDEFGHIKLMNPQRSTVWY]') as clean from long), r as (select x.*, y.Peptide is not null as met from c x left join (select Peptide from c where clean) y on y.Peptide = reverse(x.Peptide))
 select (select count(*) from fx_protein) as proteins_read, (select count(*) from fx_protein where regexp_matches(upper(seq), '[^ACDEFGHIKLMNPQRSTVWY]')) as proteins_with_noncanonical_residues, coalesce(sum(n), 0)::bigint as peptides_generated_pre_dedup, count(*) filter (clean) as unique_canonical_peptides_output_pre_tda,
  coalesce(sum(n) filter (not clean), 0)::bigint as noncanonical_peptides_removed_total, count(*) filter (not clean) as noncanonical_peptides_removed_unique, count(*) filter (clean and met and Peptide <= reverse(Peptide)) as tda_overlap_pairs, count(*) filter (clean and met) as tda_overlap_removed_unique,
  count(*) filter (clean and met and Peptide = reverse(Peptide)) as tda_overlap_palindromes, round(count(*) filter (clean and met) / count(*) filter (clean), 10) as tda_overlap_removed_fraction, round(100 * count(*) filter (clean and met) / count(*) filter (clean), 10) as tda_overlap_removed_percent, 1 as tda_overlap_removal_enabled,
  count(*) filter (clean and not met) as unique_canonical_peptides_output_post_tda from r"""),
    "reference_summary": oracle("fx_base", then=f"select ScanNum, {_C} as CorePeptide, string_agg(distinct Peptide, ';' order by Peptide) as Peptides, string_agg(distinct Protein, ';' order by Protein) as Proteins, bool_or(starts_with(Protein, 'XXX_')) as AnyDecoy from fx_base group by 1, 2"),
}
