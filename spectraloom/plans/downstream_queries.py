"""Queries on crosstabs, annotation, coverage, rollups, conflicts, quality control and collation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.fixtures import fixture, oracle
from spectraloom.functions import scalars as S
from spectraloom.operators import collate, conflicts, crosstab, digest, qc
from spectraloom.plans.compare_queries import _R, rounded
from spectraloom.plans.psm_queries import _DIGEST, _residues
from spectraloom.session import materialize, table

SAMPLES = ["S0", "S1", "S2", "S3"]
THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def _crosstab(how):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return crosstab.crosstab(crosstab.reduced(fixture(spark, sf_dir, "fx_crosstab_long"), how), SAMPLES)

    return query


def dominant_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "fx_psm_raw").withColumn("PeptideFlanked", F.replace("Peptide", F.lit("*"), F.lit("")))
    return crosstab.dominant(rows.withColumn("Core", S.core_peptide("Peptide")), "Core")


def _info(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_crosstab_long").groupBy("Protein").agg(F.min("Cluster").alias("Cluster"), F.lit("g").alias("Gene"), F.lit("f").alias("Function"))


def _annotated(spark, sf_dir):
    return materialize(crosstab.annotated(_crosstab("sum")(spark, sf_dir), _info(spark, sf_dir)), "annotated")


def uniqueness_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotated(spark, sf_dir).select("PeptideFlanked", "Protein", "Cluster", "Unique", "Shared", F.col("Unique to Cluster").alias("UniqueToCluster"))


def header_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstab.header_info(table(spark, sf_dir, "protein_fasta"), "protein_id", "header")


def _sampled(spark, sf_dir):
    """Digested peptides with the flanks of their first place in their protein, spread over four samples by hash, with an intensity."""
    proteins = fixture(spark, sf_dir, "fx_protein").select(F.col("protein_id").alias("Protein"), "seq")
    edges = digest.digest_edges(proteins, "Protein", "seq").join(proteins, "Protein")
    letter = F.substring(F.md5(F.concat("Peptide", F.lit("|"), "Protein")), 1, 1)
    first = F.position(F.col("Peptide"), F.col("seq"))
    flank = lambda at: F.coalesce(F.nullif(F.when(at > 0, F.substr("seq", at, F.lit(1))), F.lit("")), F.lit("-"))
    flanked = F.concat(flank(first - 1), F.lit("."), "Peptide", F.lit("."), flank(first + F.length("Peptide")))
    return edges.select(F.concat(F.lit("S"), (F.conv(letter, 16, 10).cast("int") % 4).cast("string")).alias("sample"), flanked.alias("PeptideFlanked"), "Protein", (F.length("Peptide") * 1000 + F.ascii("Peptide")).cast("double").alias("Intensity"))


def _coverage(spark, sf_dir):
    return crosstab.coverage(_sampled(spark, sf_dir), fixture(spark, sf_dir, "fx_protein").select(F.col("protein_id").alias("Protein"), "seq"))


def _enough(scope):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Coverage of proteins with four peptides or more."""
        return rounded(crosstab.with_enough_peptides(_coverage(spark, sf_dir), _sampled(spark, sf_dir), 4, scope))

    return query


def _known(spark, sf_dir, unique_to_cluster=False):
    """The crosstab of the digested peptides, annotated from the proteins' headers."""
    wide = crosstab.crosstab(crosstab.reduced(_sampled(spark, sf_dir), "max"), SAMPLES)
    return materialize(crosstab.annotated(wide, header_annotation(spark, sf_dir), unique_to_cluster), "known")


def _flags(unique_to_cluster):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _known(spark, sf_dir, unique_to_cluster).select("PeptideFlanked", "Protein", "Cluster", "Gene", "Function", "Unique", "Shared", F.col("Unique to Cluster").alias("UniqueToCluster"), *SAMPLES)

    return query


def _annotated_rollup(entity, how, mode="all_matches", covered=False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _known(spark, sf_dir)
        rolled = crosstab.rollup(rows, entity, SAMPLES, how, mode)
        if covered:
            rolled = crosstab.covered_only(rolled, rows, entity, crosstab.with_enough_peptides(_coverage(spark, sf_dir), _sampled(spark, sf_dir), 4, "global"))
        return rounded(crosstab.with_annotations(rolled, rows, entity, mode).withColumnRenamed("Unique to Cluster", "UniqueToCluster"), 7 if how == "mean" else 4)

    return query


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_coverage(spark, sf_dir))


def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(crosstab.coverage_matrix(_coverage(spark, sf_dir), SAMPLES))


def coverage_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(crosstab.heatmap_rows(coverage_matrix(spark, sf_dir), SAMPLES))


def _rollup(entity, how, mode="all_matches"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(crosstab.rollup(_annotated(spark, sf_dir), entity, SAMPLES, how, mode).drop("FlankedPeptides"), 7 if how == "mean" else 4)

    return query


def rrollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(crosstab.rrollup(_annotated(spark, sf_dir), "Protein", SAMPLES).drop("FlankedPeptides"), 4)


def rrollup_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(crosstab.rrollup(_annotated(spark, sf_dir), "Protein", SAMPLES, summary="mean").drop("FlankedPeptides"), 4)


def rrollup_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zeros taken for missing values."""
    rows = _annotated(spark, sf_dir)
    return rounded(crosstab.rrollup(rows.withColumns({s: F.nullif(s, F.lit(0.0)) for s in SAMPLES}), "Protein", SAMPLES).drop("FlankedPeptides"), 4)


def rrollup_grubbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(crosstab.rrollup(_annotated(spark, sf_dir), "Protein", SAMPLES, alpha=0.05).drop("FlankedPeptides"), 4)


def kmer_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's report, with the limits of its SQL; all_conflicts has them all."""
    return conflicts.kmer_conflicts(_residues(spark, sf_dir), max_candidates=500, max_conflicts=25)


def all_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.kmer_conflicts(_residues(spark, sf_dir))


def conflict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.conflict_stats(table(spark, sf_dir, "conflicts").filter("t1 is not null and t2 is not null"))


def conflict_cull_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.cull_series(_residues(spark, sf_dir), table(spark, sf_dir, "conflicts").filter("t1 is not null and t2 is not null"), THRESHOLDS)


def removal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.removal_counts(table(spark, sf_dir, "conflicts"), THRESHOLDS)


def greedy_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.greedy_prune(table(spark, sf_dir, "conflicts").filter("jaccard >= 0.5 and lcs_frac >= 0.5"))


def native_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.cluster_sequences(table(spark, sf_dir, "protein_fasta"), "protein_id", "seq")


def _decoys(spark, sf_dir):
    rows = table(spark, sf_dir, "target_peptides").select(S.letters_only(F.upper("d1")).alias("Peptide"))
    return rows.filter("Peptide <> ''").distinct()


def qc_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.overlap(_residues(spark, sf_dir), _decoys(spark, sf_dir))


def qc_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = materialize(_residues(spark, sf_dir), "targets"), materialize(_decoys(spark, sf_dir), "decoys")
    by_length = qc.kolmogorov_smirnov(a, b, F.length("Peptide")).select(F.lit("length").alias("measure"), "ks")
    by_mass = qc.kolmogorov_smirnov(a, b, F.round(S.peptide_mass("Peptide"), 6)).select(F.lit("mass").alias("measure"), "ks")
    return rounded(by_length.unionByName(by_mass))


def qc_jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = materialize(_residues(spark, sf_dir), "targets"), materialize(_decoys(spark, sf_dir), "decoys")
    one = lambda size, name: qc.jensen_shannon(a, b, size).select(F.lit(name).alias("measure"), "jsd")
    return rounded(one(1, "residue").unionByName(one(2, "dipeptide")))


def qc_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.mass_collisions(_residues(spark, sf_dir), _decoys(spark, sf_dir))


def protein_count_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The protein fields reported at each charge: the first hundred by name, and how many more."""
    return collate.capped_list(table(spark, sf_dir, "psm_syn"), ["Charge"], "Protein", "Proteins")


def removal_gain_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "fx_removal")
    return collate.set_changes(rows.withColumn("peptide_id", F.col("peptide_id").cast("string")), "peptide_id", "in_baseline", "in_variant").unionByName(collate.set_changes(rows, "protein_id", "in_baseline", "in_variant"))


def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collate.entity_counts(table(spark, sf_dir, "psm_syn"), ["Charge"], ["ScanNum", "Peptide", "Protein"])


def filter_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct peptides and scans that pass 0.05 before and after binning, per condition."""
    rows = table(spark, sf_dir, "fdr_compare_wide")
    columns = ["CorePeptide", "ScanNum"]
    count = lambda c: collate.entity_counts(rows.filter(F.coalesce(S.number(c) <= 0.05, F.lit(False))), ["ConditionName"], columns)
    return collate.gains(count("BaseFDR"), count("BinnedFDRMedian"), ["ConditionName"], columns)


_WIDE = """reduced as (select sample, PeptideFlanked, Protein, {0}(Intensity) as Intensity from fx_crosstab_long where sample is not null and PeptideFlanked is not null and Protein is not null group by 1, 2, 3),
wide as (select PeptideFlanked, Protein, """ + ", ".join(f"round(coalesce(max(Intensity) filter (sample = '{s}'), 0), 6) as {s}" for s in SAMPLES) + " from reduced group by 1, 2)"
_FLAGS = """, info as (select Protein, min(Cluster) as Cluster from fx_crosstab_long group by 1), flags as (select PeptideFlanked, count(distinct Protein) = 1 as u, count(distinct Cluster) = 1 as uc from wide join info using (Protein) group by 1),
ann as (select w.*, Cluster, u as "Unique", not u as Shared, uc as UniqueToCluster from wide w join info using (Protein) join flags using (PeptideFlanked))"""
_W = _WIDE.format("sum") + _FLAGS
_FACTS = 'bool_or("Unique") as HasUnique, bool_or(not "Unique") as HasShared, count(distinct PeptideFlanked) as PeptideNumber'


def _roll(entity, fold, where=""):
    return oracle("fx_crosstab_long", then=_W + f" select {entity}, " + ", ".join(_R(f"{fold}({s})", s, 7 if fold == "avg" else 4) for s in SAMPLES) + f", {_FACTS} from ann {where} group by {entity}")


def _rr(value: str = "{0}") -> str:
    """The peptides with their factor; ``value`` reads a sample."""
    own = [value.format(s) for s in SAMPLES]
    return _W + f""", vec as (select * replace ({", ".join(f"{v} as {s}" for v, s in zip(own, SAMPLES))}) from ann), vec2 as (select *, [{", ".join(SAMPLES)}] as v, {" + ".join(f"coalesce({s}, 0)" for s in SAMPLES)} as total, {" + ".join(f"({s} is null)::int" for s in SAMPLES)} as missing from vec),
ref as (select Protein, v as ref, PeptideFlanked as refname from vec2 qualify row_number() over (partition by Protein order by missing, total desc, PeptideFlanked) = 1),
fac as (select vec2.*, case when refname = PeptideFlanked then 1.0 else nullif(list_median(list_transform(list_filter(range(1, 5), lambda i: coalesce(v[i] <> 0 and ref[i] is not null, false)), lambda i: ref[i] / v[i])), 0) end as f from vec2 join ref using (Protein))"""


#: Groups of the fixture are smaller: four or so peptides of a protein per step of scale.
_GRUBBS_SIZES = 120
_GRUBBS = """, long as (select Protein, PeptideFlanked, unnest({names}) as sample, unnest([{values}]) as x from fac), st as (select Protein, sample, count(x) as n, avg(x) as m, stddev_samp(x) as sd from long group by 1, 2),
lim as (select * from (values {limits}) v(n, lim)), z as (select l.*, abs(x - m) / sd as z, lim from long l join st using (Protein, sample) join lim using (n) where x is not null and sd > 0),
worst as (select Protein, sample, PeptideFlanked from z qualify row_number() over (partition by Protein, sample order by z desc, PeptideFlanked) = 1 and z > lim), kept as (select * from long anti join worst using (Protein, sample, PeptideFlanked))"""


def _grubbs_sql() -> str:
    limits = ", ".join(f"({n}, {crosstab.grubbs_limit(n, 0.05)}::double)" for n in range(3, _GRUBBS_SIZES + 1))
    text = _rr() + _GRUBBS.format(names=SAMPLES, values=", ".join(f"{s} * f" for s in SAMPLES), limits=limits)
    medians = ", ".join(_R(f"median(x) filter (sample = '{s}')", s, 4) for s in SAMPLES)
    return oracle("fx_crosstab_long", then=text + f", r as (select Protein, {medians} from kept group by 1), facts as (select Protein, {_FACTS} from fac group by 1) select r.*, HasUnique, HasShared, PeptideNumber from r join facts using (Protein)")


#: The digested peptides, annotated.
_KNOWN = """, placed as (select Protein, Peptide, seq, strpos(seq, Peptide) as pl from edges e join fx_protein p on p.protein_id = e.Protein),
s as (select concat('S', cast(('0x' || substr(md5(concat(Peptide, '|', Protein)), 1, 1)) as integer) % 4) as sample, Peptide, case when pl > 1 then substr(seq, pl - 1, 1) else '-' end as nf, coalesce(nullif(substr(seq, pl + length(Peptide), 1), ''), '-') as cf, Protein, (length(Peptide) * 1000 + ascii(Peptide))::double as Intensity from placed),
sampled as (select *, concat(nf, '.', Peptide, '.', cf) as PeptideFlanked from s),
wide as (select PeptideFlanked, Protein, """ + ", ".join(f"round(coalesce(max(Intensity) filter (sample = '{s}'), 0), 6) as {s}" for s in SAMPLES) + r""" from sampled group by 1, 2),
hi as (select protein_id as Protein, regexp_replace(coalesce(header, ''), '^\S+\s*', '') as info from protein_fasta),
info as (select Protein, nullif(regexp_extract(info, 'Cluster=(\S+)', 1), '') as Cluster, coalesce(nullif(regexp_extract(regexp_extract(info, '(OS.*)$', 1), '(?i)\b(?:GN|Gene)=(\S+)', 1), ''), 'Unknown') as Gene, coalesce(nullif(trim(regexp_replace(string_split(regexp_replace(info, '(?i)\bCluster=\S+', ' ', 'g'), 'OS')[1], '\s+', ' ', 'g')), ''), 'Unknown') as Function from hi),
flags as (select PeptideFlanked, count(distinct Protein) = 1 as u, count(distinct Cluster) + max((Cluster is null)::int) = 1 as uc from wide left join info using (Protein) group by 1),
ann as (select w.*, Cluster, Gene, Function, u as "Unique", not u as Shared, uc as UniqueToCluster from wide w left join info using (Protein) join flags using (PeptideFlanked))"""


def _known_roll(entity: str, fold: str, where: str = "", extra: str = "") -> str:
    carried = ", ".join(f"min(nullif({c}, '')) as {c}" for c in ("Cluster", "Gene", "Function")) if entity == "Protein" else "concat('Cluster ', coalesce(try_cast(Cluster as bigint)::varchar, Cluster)) as Protein, '' as Gene, '' as Function"
    return oracle("fx_protein", then=_DIGEST + _KNOWN + extra + f" select {entity}, " + ", ".join(_R(f"{fold}({s})", s, 7 if fold == "avg" else 4) for s in SAMPLES) + f", {_FACTS}, string_agg(distinct PeptideFlanked, ';' order by PeptideFlanked) as FlankedPeptides, {carried}, bool_or(UniqueToCluster) as UniqueToCluster from ann where {entity} is not null {where} group by {entity}")


_T = """target as (select distinct regexp_replace(case when regexp_matches(upper(trim(t1)), '^[A-Z\\-]\\.(.+)\\.[A-Z\\-]$') then regexp_extract(upper(trim(t1)), '^[A-Z\\-]\\.(.+)\\.[A-Z\\-]$', 1) else upper(trim(t1)) end, '[^A-Z]', '', 'g') as Peptide from target_peptides),
decoy as (select distinct regexp_replace(upper(d1), '[^A-Z]', '', 'g') as Peptide from target_peptides where d1 is not null),
t as (select Peptide from target where Peptide <> ''), d as (select Peptide from decoy where Peptide <> '')"""
_MASS = "case when not regexp_matches(Peptide, '[^ACDEFGHIKLMNPQRSTVWY]') then 18.01056 + " + " + ".join(f"{m} * (length(Peptide) - length(replace(Peptide, '{r}', '')))" for r, m in S.RESIDUE_MASS.items()) + " end"
_KMERS = """, f as (select distinct Peptide, substr(Peptide, p, 3) as w from (select Peptide, unnest(range(1, greatest(length(Peptide) - 1, 1))) as p from t)),
ok as (select * from f where not regexp_matches(w, '[^ACDEFGHIKLMNPQRSTVWY]')), sz as (select Peptide, count(*) as n from ok group by 1),
sh as (select a.Peptide as t1, b.Peptide as t2, count(*) as s from ok a join ok b on reverse(a.w) = b.w where a.Peptide <> b.Peptide group by 1, 2 having count(*) >= 3 qualify row_number() over (partition by a.Peptide order by count(*) desc, length(b.Peptide), b.Peptide) <= 500),
jc as (select t1, t2, s, s / (x.n + y.n - s) as j from sh join sz x on x.Peptide = t1 join sz y on y.Peptide = t2 where s / (x.n + y.n - s) >= 0.5),
lc as (select *, (select max(case when contains(t2, substr(reverse(t1), i, n)) then n else 0 end) from (select unnest(range(1, length(t1) + 1)) as i), (select unnest(range(1, 101)) as n) where i + n <= length(t1) + 1) / least(length(t1), length(t2)) as l from jc)
select t1, reverse(t1) as d1, t2, reverse(t2) as d2, round(j, 6) as jaccard, round(l, 6) as lcs_frac, s::integer as shared_kmers from lc where l >= 0.5 qualify row_number() over (partition by t1 order by j desc, l desc, s desc, length(t2), t2) <= 25"""
_ALL_KMERS = """, f as (select distinct Peptide, substr(Peptide, p, 3) as w from (select Peptide, unnest(range(1, greatest(length(Peptide) - 1, 1))) as p from t)),
ok as (select * from f where not regexp_matches(w, '[^ACDEFGHIKLMNPQRSTVWY]')), sz as (select Peptide, count(*) as n from ok group by 1),
sh as (select a.Peptide as t1, b.Peptide as t2, count(*) as s from ok a join ok b on reverse(a.w) = b.w where a.Peptide <> b.Peptide group by 1, 2 having count(*) >= 3),
jc as (select t1, t2, s, s / (x.n + y.n - s) as j from sh join sz x on x.Peptide = t1 join sz y on y.Peptide = t2 where s / (x.n + y.n - s) >= 0.5),
lc as (select *, (select max(case when contains(t2, substr(reverse(t1), i, n)) then n else 0 end) from (select unnest(range(1, length(t1) + 1)) as i), (select unnest(range(1, greatest(length(t1), 1) + 1)) as n) where i + n <= length(t1) + 1) / least(length(t1), length(t2)) as l from jc)
select t1, reverse(t1) as d1, t2, reverse(t2) as d2, round(j, 6) as jaccard, round(l, 6) as lcs_frac, s::integer as shared_kmers from lc where l >= 0.5"""
_EDGES = f"""e as (select * from conflicts where t1 is not null and t2 is not null), th as (select unnest({THRESHOLDS}::double[]) as threshold), q as (select threshold, t1, t2 from e, th where jaccard >= threshold and lcs_frac >= threshold),
gone as (select threshold, p as Peptide, count(*) as edges from (select threshold, unnest([t1, t2]) as p from q) group by 1, 2)"""
_COVER = _KNOWN + """, hit as (select s.sample, s.Protein, s.Peptide, nf, cf, p.seq, unnest(range(1, greatest(length(p.seq) - length(s.Peptide) + 2, 1))) as i from s join fx_protein p on p.protein_id = s.Protein),
pos as (select distinct sample, Protein, unnest(range(i, i + length(Peptide))) as x from hit where substr(seq, i, length(Peptide)) = Peptide and (nf = '-' or i > 1 and substr(seq, i - 1, 1) = nf) and (cf = '-' or substr(seq, i + length(Peptide), 1) = cf)), cov as (select sample, Protein, count(*) as c from pos group by 1, 2),
covered as (select s.sample, s.Protein, count(distinct s.Peptide) as num_pep, 100.0 * coalesce(any_value(c), 0) / any_value(length(p.seq)) as Coverage from s join fx_protein p on p.protein_id = s.Protein left join cov on cov.sample = s.sample and cov.Protein = s.Protein group by 1, 2)"""
_MATRIX = ", m as (select Protein, " + ", ".join(_R(f"coalesce(max(Coverage) filter (sample = '{s}'), 0)", s) for s in SAMPLES) + " from covered group by 1)"

_ENOUGH = ", enough as (select Protein from sampled group by 1 having count(distinct PeptideFlanked) >= 4)"
#: One removal per step, as the rule says it: the peptide with most conflicts left, then the least name.
_PRUNE = """e0 as (select t1 as a, t2 as b from conflicts where jaccard >= 0.5 and lcs_frac >= 0.5 and t1 is not null and t2 is not null and t1 <> t2),
e as (select a, b from e0 union select b, a from e0),
walk as (select 0 as step, [''] as gone, '' as Peptide, 0::bigint as degree
 union all select step + 1, list_append(gone, top.p), top.p, top.n from (select step, gone, (select min({'n': -n, 'p': a}) from (select a, count(*) as n from e where not list_contains(gone, a) and not list_contains(gone, b) group by a)) as m from walk) w, lateral (select m.p as p, -m.n as n) top where m is not null)
select step::bigint as step, Peptide, degree from walk where step > 0"""
QUERIES = {
    "crosstab_sum": _crosstab("sum"), "crosstab_max": _crosstab("max"), "dominant_core": dominant_core, "uniqueness_flags": uniqueness_flags, "header_annotation": header_annotation,
    "coverage": coverage, "coverage_sample_min": _enough("per_sample"), "coverage_global_min": _enough("global"), "digest_annotated": _flags(False), "unique_to_cluster": _flags(True),
    "protein_rollup_annotated": _annotated_rollup("Protein", "sum"), "protein_rollup_unique_only": _annotated_rollup("Protein", "median", "unique_only"), "known_requires_unique": _annotated_rollup("Protein", "sum", "requires_unique"), "protein_count_lists": protein_count_lists, "cluster_rollup_mean": _annotated_rollup("Cluster", "mean"),
    "rollup_covered": _annotated_rollup("Protein", "sum", covered=True), "cluster_rollup_covered": _annotated_rollup("Cluster", "sum", covered=True), "coverage_matrix": coverage_matrix, "coverage_heatmap": coverage_heatmap,
    "protein_rollup_sum": _rollup("Protein", "sum"), "protein_rollup_mean": _rollup("Protein", "mean"), "protein_rollup_median": _rollup("Protein", "median"), "protein_rollup_requires_unique": _rollup("Protein", "sum", "requires_unique"),
    "cluster_rollup_sum": _rollup("Cluster", "sum"), "cluster_rollup_median": _rollup("Cluster", "median"), "rrollup": rrollup, "rrollup_mean": rrollup_mean, "rrollup_nulls": rrollup_nulls, "rrollup_grubbs": rrollup_grubbs,
    "kmer_conflicts": kmer_conflicts, "all_conflicts": all_conflicts, "conflict_stats": conflict_stats, "conflict_cull_series": conflict_cull_series, "removal_counts": removal_counts, "greedy_prune": greedy_prune, "native_cluster": native_cluster,
    "qc_overlap": qc_overlap, "qc_ks": qc_ks, "qc_jsd": qc_jsd, "qc_mass": qc_mass, "removal_gain_loss": removal_gain_loss, "entity_counts": entity_counts, "filter_gains": filter_gains,
}
SQL = {
    "crosstab_sum": oracle("fx_crosstab_long", then=_WIDE.format("sum") + " select * from wide"),
    "crosstab_max": oracle("fx_crosstab_long", then=_WIDE.format("max") + " select * from wide"),
    "dominant_core": oracle("fx_psm_raw", then="c as (select replace(Peptide, '*', '') as PeptideFlanked, Protein, trim(regexp_extract(Peptide, '^[^.]*\\.(.*)\\.[^.]*$', 1)) as Core, count(*) as n from fx_psm_raw group by 1, 2, 3) select PeptideFlanked, Protein, Core from c qualify row_number() over (partition by PeptideFlanked, Protein order by n desc, Core) = 1"),
    "uniqueness_flags": oracle("fx_crosstab_long", then=_W + ' select PeptideFlanked, Protein, Cluster, "Unique", Shared, UniqueToCluster from ann'),
    "header_annotation": r"""with i as (select protein_id as Protein, regexp_replace(coalesce(header, ''), '^\S+\s*', '') as info from protein_fasta),
 j as (select *, regexp_extract(info, '(OS.*)$', 1) as tail, trim(regexp_replace(string_split(regexp_replace(info, '(?i)\bCluster=\S+', ' ', 'g'), 'OS')[1], '\s+', ' ', 'g')) as fn from i)
 select Protein, nullif(regexp_extract(info, 'Cluster=(\S+)', 1), '') as Cluster, coalesce(nullif(regexp_extract(tail, '(?i)\b(?:GN|Gene)=(\S+)', 1), ''), 'Unknown') as Gene, coalesce(nullif(fn, ''), 'Unknown') as Function from j""",
    "coverage": oracle("fx_protein", then=_DIGEST + _COVER + f" select sample, Protein, num_pep, {_R('Coverage', 'Coverage')} from covered"),
    "coverage_matrix": oracle("fx_protein", then=_DIGEST + _COVER + _MATRIX + " select * from m"),
    "coverage_heatmap": oracle("fx_protein", then=_DIGEST + _COVER + _MATRIX + " select * from m order by greatest(S0, S1, S2, S3) desc, Protein limit 100"),
    "protein_rollup_sum": _roll("Protein", "sum"), "protein_rollup_mean": _roll("Protein", "avg"), "protein_rollup_median": _roll("Protein", "median"),
    "protein_rollup_requires_unique": _roll("Protein", "sum", 'where Protein in (select Protein from ann where "Unique")'),
    "cluster_rollup_sum": _roll("Cluster", "sum"), "cluster_rollup_median": _roll("Cluster", "median"),
    "coverage_sample_min": oracle("fx_protein", then=_DIGEST + _COVER + f" select sample, Protein, num_pep, {_R('Coverage', 'Coverage')} from covered where num_pep >= 4"),
    "coverage_global_min": oracle("fx_protein", then=_DIGEST + _COVER + f" select sample, Protein, num_pep, {_R('Coverage', 'Coverage')} from covered where Protein in (select Protein from sampled group by 1 having count(distinct PeptideFlanked) >= 4)"),
    "digest_annotated": oracle("fx_protein", then=_DIGEST + _KNOWN + ' select PeptideFlanked, Protein, Cluster, Gene, Function, "Unique", Shared, UniqueToCluster, S0, S1, S2, S3 from ann'),
    "unique_to_cluster": oracle("fx_protein", then=_DIGEST + _KNOWN + ' select PeptideFlanked, Protein, Cluster, Gene, Function, "Unique", Shared, UniqueToCluster, S0, S1, S2, S3 from ann where UniqueToCluster'),
    "protein_rollup_annotated": _known_roll("Protein", "sum"), "protein_rollup_unique_only": _known_roll("Protein", "median", 'and "Unique"'), "known_requires_unique": _known_roll("Protein", "sum", 'and Protein in (select Protein from ann where "Unique")'),
    "protein_count_lists": """with v as (select distinct Charge, Protein from psm_syn where Protein <> ''), r as (select *, row_number() over (partition by Charge order by Protein) as at_, count(*) over (partition by Charge) as n from v)
 select Charge, concat(string_agg(Protein, ';' order by Protein) filter (at_ <= 100), case when any_value(n) > 100 then concat(';...(+', any_value(n) - 100, ' more)') else '' end) as Proteins from r group by Charge""", "cluster_rollup_mean": _known_roll("Cluster", "avg"),
    "rollup_covered": _known_roll("Protein", "sum", "and Protein in (select Protein from enough)", _ENOUGH), "cluster_rollup_covered": _known_roll("Cluster", "sum", "and Cluster in (select Cluster from ann where Protein in (select Protein from enough))", _ENOUGH),
    "rrollup_mean": oracle("fx_crosstab_long", then=_rr() + " select Protein, " + ", ".join(_R(f"avg({s} * f)", s, 4) for s in SAMPLES) + f", {_FACTS} from fac group by Protein"),
    "rrollup_nulls": oracle("fx_crosstab_long", then=_rr("nullif({0}, 0)") + " select Protein, " + ", ".join(_R(f"median({s} * f)", s, 4) for s in SAMPLES) + f", {_FACTS} from fac group by Protein"),
    "rrollup_grubbs": _grubbs_sql(),
    "greedy_prune": "with recursive " + _PRUNE,
    "rrollup": oracle("fx_crosstab_long", then=_rr() + " select Protein, " + ", ".join(_R(f"median({s} * f)", s, 4) for s in SAMPLES) + f", {_FACTS} from fac group by Protein"),
    "kmer_conflicts": "with " + _T + _KMERS,
    "all_conflicts": "with " + _T + _ALL_KMERS,
    "conflict_stats": "with g as (select t1, count(*) as n from conflicts where t1 is not null and t2 is not null group by 1) select coalesce(sum(n), 0)::bigint as edges, count(*) as t1_with_conflicts, max(n) as max_out_degree from g",
    "conflict_cull_series": "with " + _T + ", " + _EDGES + """, s as (select threshold, count(*) as database, count(edges) as removed, count(*) - count(edges) as kept from t cross join th left join gone using (threshold, Peptide) group by 1)
 select s.*, (select count(*) from q where q.threshold = s.threshold) as qualifying_edges, (select count(*) from q where q.threshold = s.threshold and t1 not in (select Peptide from gone g where g.threshold = s.threshold) and t2 not in (select Peptide from gone g where g.threshold = s.threshold)) as remaining_edges,
 round(removed / database, 6) as removed_fraction from s""",
    "removal_counts": "with " + _EDGES.replace("where t1 is not null and t2 is not null", "") + " select * from gone where Peptide is not null",
    "qc_overlap": "with " + _T + ", s as (select Peptide, max(x) as x, max(y) as y from (select Peptide, 1 as x, 0 as y from t union all select Peptide, 0, 1 from d) group by 1), c as (select sum(x)::bigint as targets, sum(y)::bigint as decoys, count(*) filter (x = 1 and y = 1) as overlap, count(*) filter (x = 1 and Peptide = reverse(Peptide)) as palindromes from s) select *, round(overlap / targets, 9) as overlap_of_targets, round(overlap / decoys, 9) as overlap_of_decoys from c",
    "qc_ks": "with " + _T + f""", v as (select 'length' as measure, 1 as x, length(Peptide)::double as v from t union all select 'length', 0, length(Peptide) from d union all select 'mass', 1, round({_MASS}, 6) from t union all select 'mass', 0, round({_MASS}, 6) from d),
 c as (select measure, v, sum(x) as x, sum(1 - x) as y from v where v is not null group by 1, 2), k as (select measure, sum(x) over w / sum(x) over (partition by measure) as fx, sum(y) over w / sum(y) over (partition by measure) as fy from c window w as (partition by measure order by v))
 select measure, {_R('max(abs(fx - fy))', 'ks')} from k group by 1""",
    "qc_jsd": "with " + _T + f""", g as (select 'residue' as measure, side, substr(Peptide, i, 1) as piece from (select 't' as side, Peptide, unnest(range(1, length(Peptide) + 1)) as i from t union all select 'd', Peptide, unnest(range(1, length(Peptide) + 1)) from d)
  union all select 'dipeptide', side, substr(Peptide, i, 2) from (select 't' as side, Peptide, unnest(range(1, length(Peptide))) as i from t union all select 'd', Peptide, unnest(range(1, length(Peptide))) from d)),
 c as (select measure, piece, count(*) filter (side = 't') as a, count(*) filter (side = 'd') as b from g group by 1, 2), f as (select measure, a / sum(a) over (partition by measure) as p, b / sum(b) over (partition by measure) as q from c)
 select measure, {_R('greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2 + 1e-12)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2 + 1e-12)) else 0 end) / 2)', 'jsd')} from f group by 1""",
    "qc_mass": "with " + _T + f""", a as (select round({_MASS}, 9) as m from t), b as (select distinct round({_MASS}, 9) as m from d), k as (select median(m) * 1e-5 as tol from a where m is not null),
 h as (select count(*) as hits from a, k where exists (select 1 from b where b.m between a.m - tol - 1e-12 and a.m + tol + 1e-12)) select (select count(m) from a) as targets, hits, round(tol, 9) as tolerance, round(hits / (select count(m) from a), 9) as fraction from h, k""",
    "removal_gain_loss": oracle("fx_removal", then="""x as (select 'peptide_id' as entity, cast(peptide_id as varchar) as id, in_baseline, in_variant from fx_removal union all select 'protein_id', protein_id, in_baseline, in_variant from fx_removal),
 s as (select entity, id, bool_or(in_baseline) as b, bool_or(in_variant) as a from x group by 1, 2) select entity, count(*) filter (b) as baseline, count(*) filter (a) as variant, count(*) filter (a and not b) as gained, count(*) filter (b and not a) as lost, count(*) filter (a) - count(*) filter (b) as net from s group by 1"""),
    "entity_counts": "select Charge, count(distinct ScanNum) as ScanNum, count(distinct nullif(nullif(trim(Peptide), ''), 'nan')) as Peptide, count(distinct nullif(nullif(trim(Protein, ' '), ''), 'nan')) as Protein from psm_syn group by 1",
    "filter_gains": """with a as (select ConditionName, count(distinct CorePeptide) as p, count(distinct ScanNum) as s from fdr_compare_wide where BaseFDR <= 0.05 and not isnan(BaseFDR) group by 1),
 b as (select ConditionName, count(distinct CorePeptide) as p, count(distinct ScanNum) as s from fdr_compare_wide where BinnedFDRMedian <= 0.05 and not isnan(BinnedFDRMedian) group by 1)
 select coalesce(a.ConditionName, b.ConditionName) as ConditionName, coalesce(a.p, 0) as BaselineCorePeptide, coalesce(a.s, 0) as BaselineScanNum, coalesce(b.p, 0) as CorrectedCorePeptide, coalesce(b.s, 0) as CorrectedScanNum, coalesce(b.p, 0) - coalesce(a.p, 0) as CorePeptideGain, coalesce(b.s, 0) - coalesce(a.s, 0) as ScanNumGain from a full join b on a.ConditionName is not distinct from b.ConditionName""",
}
