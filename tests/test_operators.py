import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.functions import scalars as S
from spectraloom.operators import bins, collate, compare, conflicts, correction, crosstab, cull, digest, ordered, psm, qc
from spectraloom.operators.fdr import best_per_scan, entity_fdr, monotone_fdr
from spectraloom.operators.quantile import exact_percentiles
from spectraloom.plans import pipelines


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first().v


def test_leading_decoys(spark):
    flags = "DDTDTTDT"
    rows = spark.createDataFrame([(1, k, ("XXX_" if f == "D" else "") + "p", float(k)) for k, f in enumerate(flags)], "run int, n int, Protein string, s double")
    for limit in (None, 2):
        got = [r.FDR for r in monotone_fdr(rows, ["run"], "s", ["n"], max_group_rows=limit).orderBy("n").collect()]
        assert got == [None, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0] or got[:2] == [None, None]
        decoys = targets = 0
        ratios = []
        for f in flags:
            decoys, targets = decoys + (f == "D"), targets + (f == "T")
            ratios.append(min(1.0, decoys / targets) if targets else None)
        assert got == [None if r is None else min(x for x in ratios[k:]) for k, r in enumerate(ratios)]


@pytest.mark.parametrize("large", [False, True])
def test_running_over_slices(spark, monkeypatch, large):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 50)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.random()]), n, rng.randrange(5)) for n in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, n int, x int")
    got = ordered.running(df, ["g"], ["v", "n"], {"total": F.col("x")}, large)
    got = ordered.least_from_here(got, ["g"], ["v", "n"], "x", "least", large)
    want = {}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        for k, r in enumerate(own):
            want[r[2]] = (sum(q[3] for q in own[: k + 1]), min(q[3] for q in own[k:]))
    assert {r.n: (r.total, r.least) for r in got.collect()} == want


@pytest.mark.parametrize("large", [False, True])
def test_neighbours_over_slices(spark, large):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, rng.random()]), n, rng.choice([None, None, None, n])) for n in range(400)] + [("c", 1.0, 400, None)]
    df = spark.createDataFrame(rows, "g string, v double, n int, x int")
    got = ordered.following(df, ["g"], ["v", "n"], {"after": "n", "x2": "x"}, large, 40)
    got = ordered.latest(got, ["g"], ["v", "n"], "x", "last", large, 40)
    want = {}
    for g in ("a", "b", "c", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        for k, r in enumerate(own):
            beside = own[k + 1] if k + 1 < len(own) else (None,) * 4
            want[r[2]] = (beside[2], beside[3], next((q[3] for q in reversed(own[: k + 1]) if q[3] is not None), None))
    assert {r.n: (r.after, r.x2, r["last"]) for r in got.collect()} == want


def test_exact_percentiles(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(["a", "b", None][k % 3], float(np.round(rng.normal(), 1)) if k % 7 else None) for k in range(400)] + [("c", 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for limit in (1000, 5):
        monkeypatch.setattr(ordered, "MAX_GROUP_ROWS", limit)
        monkeypatch.setattr(ordered, "SLICE_ROWS", 20)
        got = {r.g: (r.a, r.b, r.c) for r in exact_percentiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 1.0}).collect()}
        want = {g: tuple(np.quantile([v for h, v in rows if h == g and v is not None], [0.1, 0.5, 1.0])) for g in ("a", "b", "c", None)}
        assert set(got) == set(want) and all(np.allclose(got[g], want[g]) for g in want)
    assert exact_percentiles(df.limit(0), ["g"], "v", {"a": 0.1}).count() == 0


def test_scalars(spark):
    lit = F.lit
    assert one(spark, S.core_peptide(lit("A.HPAPPM*R.-"))) == "HPAPPM*R" and one(spark, S.unmodified_peptide(lit("A.HPAPPM*R.-"))) == "HPAPPMR"
    assert one(spark, S.peptide_core(lit(" k.pep*t.r "))) == "PEPT" and one(spark, S.canonical_peptide(lit("K.pEp*.R"))) == "pEp"
    assert one(spark, S.core_peptide(lit("A.B"))) == "A.B" and one(spark, S.core_peptide(lit(None).cast("string"))) is None
    assert [v for v in one(spark, S.trypsin(lit("MKRPAKXGRGGK")))] == ["MK", "RPAKXGR", "GGK"]
    assert one(spark, S.positions_of(lit("AA"), lit("AAAA"))) == [1, 2, 3] and one(spark, S.positions_of(lit("B"), lit("A"))) == []
    assert one(spark, S.lcs_length(lit("ABCDEF"), lit("ZBCDXX"))) == 3 and one(spark, S.lcs_length(lit(""), lit("A"))) == 0
    assert one(spark, S.minus_log10(lit(0.0))) == 0.0 and abs(one(spark, S.minus_log10(lit(1e-3))) - 3) < 1e-12
    assert one(spark, S.peptide_mass(lit("GX"))) is None and abs(one(spark, S.peptide_mass(lit("GG"))) - (2 * 57.02146 + 18.01056)) < 1e-9
    assert one(spark, S.has_decoy(lit("p;XXX_q"))) and not one(spark, S.is_decoy(lit("p;XXX_q"))) and not one(spark, S.is_decoy(lit(None).cast("string")))
    assert one(spark, S.function_of(lit("a thing Cluster=0001 OS=Org"))) == "a thing" and one(spark, S.gene_of(lit("OS=x"))) == "Unknown"
    assert one(spark, S.joined_capped(F.array(*[lit(c) for c in "cab"]), 2)) == "a;b;...(+1 more)"
    edges = [0.0, 0.01, 0.05, 1.0]
    assert [one(spark, S.interval_label(lit(v), edges)) for v in (0.0, 0.01, 0.010001, 1.0, 1.1)] == ["[0, 0.01]", "[0, 0.01]", "(0.01, 0.05]", "(0.05, 1]", None]
    assert one(spark, S.number(lit("nan"))) is None and one(spark, S.number(lit("1e3"))) == 1000.0 and one(spark, S.clip01(lit(None).cast("double"))) is None
    assert 0 <= one(spark, S.hash_fraction(lit(7), lit("PEP"))) <= 1 and one(spark, S.boolish(lit(" Yes ")))
    assert one(spark, S.accession_keys(lit("sp|P1|A_B.2 words here"))["uniprot"]) == "P1"


def test_best_and_entities(spark):
    rows = spark.createDataFrame([("r", 1, 1, 5.0, 0.1, "p"), ("r", 1, 2, 5.0, 0.2, "q"), ("r", 2, 3, None, 0.3, "XXX_p"), ("r", 3, 4, 1.0, None, "XXX_s")], "Run string, ScanNum int, n int, ParentIonIntensity double, SpecEValue double, Protein string")
    assert [r.n for r in best_per_scan(rows, ["Run", "ScanNum"], "ParentIonIntensity", ["n"]).orderBy("n").collect()] == [1, 4]
    assert entity_fdr(rows, "Protein", "SpecEValue", ["n"]).first().fdr_percent == 50.0


def test_bins(spark):
    peptides = spark.createDataFrame([(f"P{n}",) for n in range(8)], "Peptide string")
    assigned = bins.group_assignments(peptides, 3)
    assert sorted(r["count"] for r in assigned.groupBy("Group").count().collect()) == [2, 3, 3]
    assert sorted((r.PairGroupA, r.PairGroupB) for r in bins.pair_assignments(assigned, 3).select("PairGroupA", "PairGroupB").distinct().collect()) == [(1, 2), (1, 3), (2, 3)]


def test_digest_removal(spark):
    mapped = spark.createDataFrame([("ABC", 1, "p"), ("ACD", 1, "p"), ("DCA", 2, "p;q"), ("AA", 1, "p"), ("ACE", 1, "p")], "Peptide string, ProteinCount long, Proteins string")
    gone = digest.removed(mapped)
    assert sorted((r.Peptide, r.Reason, r.Partner) for r in gone.collect()) == [("AA", "tda_overlap", "AA"), ("ABC", "noncanonical", ""), ("ACD", "tda_overlap", "DCA"), ("DCA", "tda_overlap", "ACD")]
    assert [r.Peptide for r in digest.cleaned(mapped, gone).collect()] == ["ACE"]


def test_filters(spark):
    rows = spark.createDataFrame([("K.PEP.R", "p", 0.01, 9000.0), ("K.PEP.R", "p", 0.01, None), ("K.PEP.R", "XXX_p", 0.0, 9000.0), ("K.PEP.R", "a contaminant", 0.0, 9000.0), ("K.PEP.R", "p", None, 9000.0), ("K.PEP.R", "p", 0.02, 9000.0)], "Peptide string, Protein string, FDR double, ParentIonIntensity double")
    assert [(r.Peptide, r.PeptideFlanked, r.FDR) for r in psm.filtered_targets(rows).collect()] == [("PEP", "K.PEP.R", 0.01)]
    assert psm.metric_filter(rows, "MSMSScore").count() == 6
    with pytest.raises(ValueError):
        psm.metric_filter(rows, "Nothing")


def test_cull_keeps_reference_only(spark):
    make = lambda rows: spark.createDataFrame(rows, "RunFolder string, ScanNum int, Peptide string, Protein string, SpecEValue double")
    keys = cull.reference_keys(spark.createDataFrame([(1, "K.AA.R"), (2, "K.BB.R")], "ScanNum int, Peptide string"))
    sic = make([("g", 1, "R.AA.K", "p", 1.0), ("g", 2, "K.CC.R", "p", 1.0)])
    syn = make([("g", 2, "-.BB.-", "p", 2.0), ("g", 2, "K.BB.R", "q", 1.0), ("g", 1, "K.AA.R", "z", 0.1), ("g", 3, "K.BB.R", "p", 1.0)])
    culled = cull.cull(sic, syn, keys, ["RunFolder"], ["Peptide", "Protein"])
    assert sorted((r.ScanNum, r.Protein, r.SourceLayer) for r in culled.collect()) == [(1, "p", "SIC"), (2, "q", "SYN")]
    assert {(r.ScanNum): r.Category for r in cull.scan_categories(sic, syn, keys, culled, ["RunFolder"]).collect()} == {1: "recovered_by_sic", 2: "recovered_by_syn", 3: "not_in_reference"}


def test_isotonic():
    fit = correction.isotonic(np.array([0.02, 0.05, 0.03, 0.3, 0.25, 0.9]), np.array([1.0, 10, 20, 5, 5, 1]))
    assert np.allclose(fit, [0.02, 11 / 300, 11 / 300, 0.275, 0.275, 0.9]) and len(correction.isotonic(np.zeros(0), np.zeros(0))) == 0


@pytest.mark.parametrize("noise", [0.0, 0.05, 2.0])
def test_isotonic_in_slices(spark, noise):
    random = np.random.default_rng(5)
    rows = [(g, float(x), float(noise * d), int(n)) for g, size in (("a", 900), (None, 60), ("b", 1)) for x, d, n in zip(np.sort(random.choice(10_000, size, False)) / 10_000, random.normal(size=size), random.integers(0, 40, size))]
    points = spark.createDataFrame(rows, "grp string, fdr_anchor double, delta_anchor double, n_train bigint")
    key = lambda r: (r.grp or "", r.fdr_anchor)
    whole, sliced = (sorted(correction.monotone_anchors(points, max_fit=m).collect(), key=key) for m in (1_000_000, 100))
    assert [key(r) for r in whole] == [key(r) for r in sliced] and len(whole) == 961
    assert np.allclose([r.corrected for r in whole], [r.corrected for r in sliced], atol=1e-9)
    curve = correction.monotone_anchors(points)
    probes = spark.createDataFrame([(g, k / 50) for g in ("a", "b", "z", None) for k in range(51)], "grp string, x double")
    for of in (lambda m: correction.reversals(curve, m), lambda m: correction.apply_curve(probes, curve, "x", max_rows=m)):
        assert sorted(map(str, of(50).collect())) == sorted(map(str, of(1_000_000).collect()))


def test_quantile_bins_against_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.beta(0.5, 2, 900), 3)
    train = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 0.3)], "grp string, ClassicFDR double")
    got = {}
    for r in correction.quantile_bins(train, 20).collect():
        got.setdefault((r.grp, r.segment), []).append((r.low, r.high))
    for k, (low, high, asked) in enumerate(correction.SEGMENTS, 1):
        own = values[(values >= low) & ((values < high) | (k == len(correction.SEGMENTS)) & (values == high))]
        n = max(1, min(asked, len(own) // 20))
        edges = np.quantile(own, np.linspace(0, 1, n + 1)) if n > 1 else np.array([low, high])
        edges[0], edges[-1] = low, high
        edges = np.unique(edges)
        assert np.allclose(sorted(got["a", k]), list(zip(edges[:-1], edges[1:])))
        assert got["b", k] == [(low, high)]


def test_merge_sparse(spark):
    make = lambda rows: spark.createDataFrame([("a", s, b, float(b), float(b + 1), n) for s, b, n in rows], "grp string, segment int, bin int, low double, high double, n long")
    got = correction.merge_sparse(make([(1, 1, 3), (1, 2, 2), (1, 3, 9), (1, 4, 1), (2, 1, 1), (2, 2, 1)]), 5).orderBy("segment", "bin").collect()
    assert [(r.segment, r.bin, r.low, r.high, r.n, r.merged) for r in got] == [(1, 1, 1.0, 3.0, 5, 2), (1, 2, 3.0, 5.0, 10, 2), (2, 1, 1.0, 3.0, 2, 2)]


def test_rolling_windows_end_with_the_segment(spark):
    levels = spark.createDataFrame([("a", n / 1000, 1, 0.0, 0.0, 0.0, 0.0) for n in range(500, 525)], "grp string, ClassicFDR double, rows int, mean_delta double, mean_partitioned double, median_delta double, median_partitioned double")
    got = [(r.start, r.n_train) for r in correction.rolling_windows(levels, 10, 4).orderBy("start").collect()]
    assert got == [(0, 10), (4, 10), (8, 10), (12, 10), (15, 10)]
    assert [(r.start, r.n_train) for r in correction.rolling_windows(levels.limit(7), 10, 4).collect()] == [(0, 7)]


def test_moments(spark):
    rows = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 9.0, 20.0)], "v double")
    skew, kurt = compare.bias_corrected(F.skewness("v"), F.kurtosis("v"), F.count("v"))
    got = rows.agg(skew.alias("s"), kurt.alias("k")).first()
    assert abs(got.s - 1.4901199697) < 1e-9 and abs(got.k - 1.8954319322) < 1e-9


def test_grubbs(spark):
    # Published two-sided critical values at 5 %.
    for n, limit in ((3, 1.155), (5, 1.715), (10, 2.290), (30, 2.908)):
        assert abs(crosstab.grubbs_limit(n, 0.05) - limit) < 2e-3
    rows = spark.createDataFrame([("a", str(n), v) for n, v in enumerate([1.0, 1.1, 0.9, 1.0, 9.0])] + [("b", str(n), v) for n, v in enumerate([1.0, 2.0, 3.0])] + [("c", "0", 5.0), ("d", "0", None)], "g string, name string, x double")
    kept = crosstab.without_outlier(rows, ["g"], "name", "x", 0.05)
    assert {r.g: r["count"] for r in kept.groupBy("g").count().collect()} == {"a": 4, "b": 3, "c": 1, "d": 1}


def test_rrollup_scales_to_the_reference(spark):
    rows = spark.createDataFrame([("P", "a", 10.0, 20.0, True), ("P", "b", 1.0, 2.0, False), ("P", "c", 0.0, 0.0, False), ("Q", "d", 3.0, 0.0, True)], "Protein string, PeptideFlanked string, S1 double, S2 double, Unique boolean")
    got = {r.Protein: (r.S1, r.S2, r.PeptideNumber) for r in crosstab.rrollup(rows, "Protein", ["S1", "S2"]).collect()}
    assert got == {"P": (10.0, 20.0, 3), "Q": (3.0, 0.0, 1)}
    assert {r.Protein for r in crosstab.rollup(rows, "Protein", ["S1"], mode="unique_only").collect()} == {"P", "Q"}
    assert crosstab.by_mode(rows.filter("PeptideFlanked <> 'a'"), "requires_unique", "Protein").count() == 1


def greedy(edges, short=False):
    graph, plan = {}, []
    for a, b in edges:
        if a != b:
            graph.setdefault(a, set()).add(b)
            graph.setdefault(b, set()).add(a)
    while any(graph.values()):
        p = min((v for v in graph if graph[v]), key=lambda v: (-len(graph[v]), len(v) if short else 0, v))
        plan.append((p, len(graph[p])))
        for q in graph.pop(p):
            graph[q].discard(p)
    return plan


@pytest.mark.parametrize("short", [False, True])
def test_greedy_prune_follows_the_rule(spark, short):
    rng = random.Random(9)
    names = ["".join(rng.choice("ABC") for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(90)]
    got = conflicts.greedy_prune(spark.createDataFrame(edges + [(None, "A")], "t1 string, t2 string"), short).orderBy("step").collect()
    assert [(r.Peptide, r.degree) for r in got] == greedy(edges, short)
    assert conflicts.greedy_prune(spark.createDataFrame([], "t1 string, t2 string")).count() == 0


def test_first_fit_clusters_follow_the_scan(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)]
    near = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    want, heads = {}, []
    for v in range(60):
        head = next((h for h in heads if (v, h) in near and h != v), None)
        want[v] = v if head is None else head
        heads += [v] if head is None else []
    got = conflicts.first_fit_clusters(spark.range(60).select("id", F.col("id").alias("rank")), spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.representative for r in got.collect()} == want


def test_header_clusters(spark):
    proteins = spark.createDataFrame([("sp|P1|A words",), ("q.1 words",), ("z",)], "header string")
    members = spark.createDataFrame([("P1", "0001"), ("q", "0002")], "seq_id string, cluster string")
    assert {r.header: r.Cluster for r in conflicts.header_clusters(proteins, "header", members).collect()} == {"sp|P1|A words": "0001", "q.1 words": "0002", "z": "Unassigned"}


def test_quality_control(spark):
    make = lambda *p: spark.createDataFrame([(x,) for x in p], "Peptide string")
    assert qc.kolmogorov_smirnov(make("A", "AA", "AAA"), make("A", "AAAA"), F.length("Peptide")).first().ks == pytest.approx(0.5)
    assert qc.jensen_shannon(make("AC"), make("AC"), 1).first().jsd == pytest.approx(0, abs=1e-9)
    assert qc.jensen_shannon(make("AA"), make("CC"), 1).first().jsd == pytest.approx(1, abs=1e-9)
    hits = qc.mass_collisions(make("GG", "WW", "X"), make("GG")).first()
    assert (hits.targets, hits.hits, hits.fraction) == (2, 1, 0.5)
    both = qc.overlap(make("AB", "CC"), make("BA", "AB", "CC")).first()
    assert (both.targets, both.decoys, both.overlap, both.palindromes) == (2, 3, 2, 1)


def test_all_conflicts(spark, monkeypatch):
    def words(x):
        return {x[i : i + 3] for i in range(len(x) - 2)}

    def substring(a, b):
        return max((n for n in range(1, len(a) + 1) for i in range(len(a) - n + 1) if a[i : i + n] in b), default=0)

    rng = random.Random(5)
    core = "ACDEFGHIKLMNPQ"
    # A family of like peptides, in which the reversed core meets far more than 25 others, and unlike ones.
    peptides = {core[::-1]} | {core[:i] + a + core[i + 1 :] for i in (0, 1, 12, 13) for a in "RSTVWYAC"} | {"".join(rng.choice("ACDE") for _ in range(rng.randrange(2, 14))) for _ in range(80)}
    want = {}
    for a in peptides:
        for b in peptides - {a}:
            x, y = words(a[::-1]), words(b)
            j, n = len(x & y) / max(1, len(x | y)), substring(a[::-1], b) / min(len(a), len(b))
            if len(x & y) >= 3 and j >= 0.5 and n >= 0.5:
                want[a, b] = (round(j, 6), round(n, 6), len(x & y))
    frame = spark.createDataFrame([(p,) for p in sorted(peptides)], "Peptide string")
    for limit in (12, 4):
        monkeypatch.setattr(conflicts, "PIECE", limit)
        got = {(r.t1, r.t2): (r.jaccard, r.lcs_frac, r.shared_kmers) for r in conflicts.kmer_conflicts(frame).collect()}
        assert got == want and sum(a == core[::-1] for a, _ in got) > 25
    report = conflicts.kmer_conflicts(frame, max_conflicts=25)
    assert report.filter(F.col("t1") == core[::-1]).count() == 25


def test_removal_series_feeds_on_all_conflicts(spark, tmp_path):
    core = "ACDEFGHIKLMNPQ"
    like = [core[:i] + a + core[i + 1 :] for i in (0, 13) for a in "FGHIKLMNRSTVWY"]
    frame = spark.createDataFrame([(p,) for p in sorted({core[::-1], *like})], "Peptide string")
    series = {r.threshold: r for r in pipelines.removal_series(frame, str(tmp_path / "out"), [0.6]).collect()}
    # The core conflicts with each of the 28 others, and each of them with it.
    assert series[0.6].qualifying_edges == 56 and series[0.6].kept == 0 and series[0.6].remaining_edges == 0


def test_gains_keep_the_null_key(spark):
    side = lambda rows: spark.createDataFrame(rows, "g string, n long")
    got = collate.gains(side([(None, 3), ("a", 1)]), side([(None, 5), ("b", 2)]), ["g"], ["n"])
    assert {tuple(r) for r in got.collect()} == {(None, 3, 5, 2), ("a", 1, 0, -1), ("b", 0, 2, 2)}
