import pytest
from pyspark.sql import functions as F

from spectraloom.operators import bins, correction, cull
from spectraloom.plans import pipelines
from spectraloom.operators.collate import recovery_faults, seeded_sample
from spectraloom.sources import discovery, fasta, names, tables
from spectraloom.streaming import fdr_stream


def test_read_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("noise\n>p1 first > x OS=Org GN=g1 Cluster=0003\nAC\nDE\n\n>p2\n\n>p1 again\r\nKK\r\n")
    (tmp_path / "b.fasta").write_text(">q1\n" + "A" * 170 + "\n")
    rows = fasta.read_fasta(spark, str(tmp_path / "*.fasta"))
    assert sorted((r.id, r.header, r.seq) for r in rows.collect()) == [("p1", "p1 again", "KK"), ("p1", "p1 first > x OS=Org GN=g1 Cluster=0003", "ACDE"), ("p2", "p2", ""), ("q1", "q1", "A" * 170)]
    assert {r.id: r.seq for r in fasta.sequences_by_id(rows).collect()}["p1"] == "ACDEKK"
    assert {r.key: r.seq for r in fasta.lookup_keys(rows).collect()}["p1"] == "ACDE"
    assert {r.id: r.cluster for r in fasta.protein_info(rows).collect()} == {"p1": None, "p2": None, "q1": None}
    assert fasta.count_entries(spark, str(tmp_path / "*.fasta")) == 4
    fasta.write_fasta(rows.filter("id = 'q1'"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == [">q1", "A" * 80, "A" * 80, "A" * 10]
    assert [r.Peptide for r in fasta.read_peptides(spark, str(tmp_path / "a.fasta"), 3, 5).collect()] == ["ACDE"]


def test_read_clusters(spark, tmp_path):
    (tmp_path / "x.clstr").write_text(">Cluster 0\n0\t9aa, >p1... *\n1\t9aa, >p2... at 97%\n>Cluster 1\n0\t7aa, >q|1... *\n")
    assert {r.seq_id: r.cluster for r in fasta.read_clusters(spark, str(tmp_path / "x.clstr")).collect()} == {"p1": "0001", "p2": "0001", "q|1": "0002"}


def test_tables(spark, tmp_path):
    (tmp_path / "s_syn.txt").write_text("Scan\tPeptide\tProtein\tMSGFDB_SpecEValue\tQValue\n7\tK.AC*D.R\tXXX_p;q\t1e-5\tNA\n8\tnan\tp\tx\t0.1\n")
    rows = tables.read_syn(spark, str(tmp_path / "s_syn.txt")).orderBy("ScanNum").collect()
    assert [(r.ScanNum, r.Peptide, r.CorePeptide, r.IsDecoy, r.SpecEValue, r.QValue) for r in rows] == [(7, "K.AC*D.R", "AC*D", True, 1e-5, None), (8, None, None, False, None, 0.1)]
    with pytest.raises(ValueError):
        tables.with_aliases(spark.createDataFrame([(1,)], "x int"), ["ScanNum"])
    for name in ("run_group_2", "run_pair_1_10"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "t.tsv").write_text("ScanNum\tPartitionFDR\n1\t0.5\n")
    got = tables.read_partitions(spark, str(tmp_path / "run_*")).orderBy("RunFolder").collect()
    assert [(r.RunFolder, r.PartitionType, r.Group, r.PairGroupA, r.PairGroupB) for r in got] == [("run_group_2", "group", 2, None, None), ("run_pair_1_10", "pair", None, 1, 10)]
    tables.write_tsv(spark.createDataFrame([("Total", "5"), ("Other", "2.0")], "Metric string, Value string"), str(tmp_path / "report"), one_file=True)
    assert tables.read_metrics(spark, str(tmp_path / "report"), {"total": ["Total"], "Other": []}) == {"total": 5, "Other": 2}
    with pytest.raises(ValueError):
        tables.read_metrics(spark, str(tmp_path / "report"), {"Gone": []})
    tables.write_tsv(spark.range(10_001).selectExpr("concat('m', id) as Metric", "'1' as Value"), str(tmp_path / "long"), one_file=True)
    with pytest.raises(ValueError):
        tables.read_metrics(spark, str(tmp_path / "long"), {"m1": []})


def test_formula_round_trip(spark, tmp_path):
    curve = spark.createDataFrame([(0.0, 0.1, 0.1, "b"), (0.5, 0.2, 0.2, "o"), (1.0, 0.9, 0.9, "b")], "fdr_anchor double, raw_corrected double, corrected double, role string")
    tables.write_formula(curve, str(tmp_path / "f"), "soil")
    read = tables.read_formula(spark, str(tmp_path / "f"))
    values = spark.createDataFrame([("soil", v) for v in (0.0, 0.25, 0.5, 0.75, 1.0, None)] + [("none", 0.5)], "grp string, v double")
    got = {(r.grp, r.v): r.CorrectedFDR for r in correction.apply_curve(values, read, "v").collect()}
    want = {0.0: 0.1, 0.25: 0.15, 0.5: 0.2, 0.75: 0.55, 1.0: 0.9}
    assert all(abs(got["soil", v] - w) < 1e-12 for v, w in want.items()) and got["soil", None] is None and got["none", 0.5] is None
    tables.write_formula(curve.filter("fdr_anchor < 1"), str(tmp_path / "bad"), "soil")
    with pytest.raises(ValueError):
        tables.read_formula(spark, str(tmp_path / "bad"))


def test_stream_scores_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    header = "Scan\tPrecursorMZ\tDelM_PPM\tPeptide\tProtein\tMSGFScore\tMSGFDB_SpecEValue\tEValue\tQValue\tPepQValue\tElutionTime\tParentIonIntensity\tPeakArea\tStatMomentsArea\n"
    row = "{0}\t1\t-2\tK.PEP.R\t{1}\t9\t{2}\t1\t0\t0\t1\t{3}\t1\t1\n"
    (folder / "a.txt").write_text(header + row.format(1, "XXX_p", 1e-9, 10) + row.format(1, "p", 1e-8, 20) + row.format(2, "XXX_q", 1e-7, 5) + row.format(3, "q", 1e-6, 5))
    run = lambda: fdr_stream.start(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    run()
    (folder / "b.txt").write_text(header + row.format(1, "p", 1e-9, 10))
    run()
    got = {(r.SourceFile, r.ScanNum): (r.Protein, r.FDR) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a.txt", 1): ("p", 0.0), ("a.txt", 2): ("XXX_q", 0.5), ("a.txt", 3): ("q", 0.5), ("b.txt", 1): ("p", 0.0)}


def test_names_and_sizes():
    assert bins.parse_size("1.2M") == 1_200_000 and bins.size_label(600_000) == "600k"
    # The published size series of three databases.
    published = {12_302_081: (10, 21, 41, 82, 164), 20_788_421: (17, 35, 69, 139, 277), 13_267_887: (11, 22, 44, 88, 177)}
    for total, counts in published.items():
        assert tuple(bins.nearest_group_count(total, bins.parse_size(s)) for s in ("1.2M", "600k", "300k", "150k", "75k")) == counts
    assert names.run_parts("Soil_top_3") == ("Soil_top", 3) and names.run_parts("Soil") is None
    assert names.match_stem("Soil-1", ["soil_1", "soil_12"]) == "soil_1" and names.match_stem("soil", ["soil_1", "soil_2"]) is None
    assert sorted(["S10", "S9"], key=names.natural) == ["S9", "S10"]


def test_pipelines(spark, tmp_path):
    (tmp_path / "p.fasta").write_text("".join(f">p{n} enzyme OS=Org GN=g{n} Cluster=000{n % 3}\n{'MKAAAAAAGHK' * 2}{'ACDEFGHILMNPQSTVWY'[n % 18:]}K\n" for n in range(30)))
    pipelines.prepare_databases(spark, str(tmp_path / "p.fasta"), str(tmp_path / "db"), groups=3, targets=["10"])
    assert spark.read.parquet(str(tmp_path / "db/main/pairs")).select("PairGroupA", "PairGroupB").distinct().count() == 3
    proteins = fasta.read_fasta(spark, str(tmp_path / "p.fasta"))
    scored = spark.createDataFrame([(s, n, "K.AAAAAAGHK.M", f"p{n}", 9000.0 + n, 1e-12, 0.0, 0.001, 12.0, False) for n in range(6) for s in ("S1", "S2")], "Sample string, ScanNum long, Peptide string, Protein string, ParentIonIntensity double, SpecEValue double, QValue double, FDR double, MSMSScore double, IsDecoy boolean")
    pipelines.downstream(scored, proteins, "Sample", str(tmp_path / "down"))
    rows = tables.read_tsv(spark, str(tmp_path / "down/protein_crosstab_annotated"))
    assert rows.count() == 6 and {"S1", "S2"} <= set(rows.columns)
    cover = tables.read_tsv(spark, str(tmp_path / "down/grouped_coverage")).agg(F.min(F.col("S1").cast("double"))).first()[0]
    assert cover > 10
    series = pipelines.removal_series(spark.createDataFrame([("ACDEFGHIK",), ("KIHGFEDCA",), ("LLLLMMMM",)], "Peptide string"), str(tmp_path / "removal"))
    assert {r.threshold: r.removed for r in series.collect()}[1.0] == 2


def test_rollups_hold_covered_proteins_with_annotations(spark, tmp_path):
    proteins = spark.createDataFrame([("p1", "p1 enzyme OS=Org GN=g1 Cluster=0001", "MKAAAAAAGHKMCCCCCCGHK"), ("p2", "p2 enzyme OS=Org GN=g2 Cluster=0002", "MKAAAAAAGHK"), ("p3", "p3 lost OS=Org GN=g3 Cluster=0003", None)], "id string, header string, seq string")
    row = lambda s, n, peptide, protein: (s, n, peptide, protein, 9000.0, 1e-12, 0.0, 0.001, 12.0, False)
    # p1 has two peptides, but one in each sample; p3 has no sequence.
    scored = [row("S1", 1, "K.AAAAAAGHK.M", "p1"), row("S2", 2, "K.MCCCCCCGHK.-", "p1"), row("S1", 3, "K.AAAAAAGHK.-", "p2"), row("S1", 4, "K.LLLLLLGHK.-", "p3")]
    frame = spark.createDataFrame(scored, "Sample string, ScanNum long, Peptide string, Protein string, ParentIonIntensity double, SpecEValue double, QValue double, FDR double, MSMSScore double, IsDecoy boolean")
    for out, options, want in (("all", {}, {"p1", "p2"}), ("global", {"least_peptides": 2, "scope": "global"}, {"p1"}), ("own", {"least_peptides": 2}, set())):
        pipelines.downstream(frame, proteins, "Sample", str(tmp_path / out), **options)
        if want:
            rolled = {r.Protein: r for r in tables.read_tsv(spark, str(tmp_path / out / "protein_crosstab_annotated")).collect()}
            clusters = {r.Protein for r in tables.read_tsv(spark, str(tmp_path / out / "clustered_crosstab_annotated")).collect()}
            assert set(rolled) == want and clusters == {f"Cluster {p[1]}" for p in want}
            assert (rolled["p1"].Gene, rolled["p1"].Function, int(rolled["p1"].Cluster)) == ("g1", "enzyme", 1)


def test_recovery_distributions(spark):
    by_scan = spark.createDataFrame([(1, 2, 1, 1, 3), (2, 0, 0, 0, 1), (3, 2, 2, 0, 2)], "ScanNum long, Recovered long, RecoveredSIC long, AddedSYN long, ObservedSYN long")
    got = {(r.layer, r.partitions): r.scans for r in cull.recovery_distributions(by_scan).collect()}
    assert got == {("Recovered", 2): 2, ("Recovered", 0): 1, ("RecoveredSIC", 1): 1, ("RecoveredSIC", 0): 1, ("RecoveredSIC", 2): 1, ("AddedSYN", 1): 1, ("AddedSYN", 0): 2, ("ObservedSYN", 3): 1, ("ObservedSYN", 1): 1, ("ObservedSYN", 2): 1}


def test_derive_formula_holds_rows_out(spark):
    wide = spark.createDataFrame([("a", n, f"PEP{n}", n / 400, n / 500) for n in range(400)], "g string, ScanNum long, CorePeptide string, BaseFDR double, BinnedFDRMedian double")
    rows = lambda share: pipelines.derive_formula(wide, "g", window=1000, held_out=share).agg(F.sum("n_train")).first()[0]
    train = correction.training_rows(wide, "g")
    assert rows(0.0) == 400 and rows(0.3) == train.filter(~correction.test_flag(0.3)).count() < 400


def test_discovery(spark, tmp_path):
    for name in ("Soil_2", "Soil_10", "notes", "._Soil_3"):
        (tmp_path / name).mkdir()
    assert [(r["name"], r.replicate) for r in discovery.numbered_runs(spark, str(tmp_path)).collect()] == [("Soil_2", 2), ("Soil_10", 10)]
    assert discovery.only_one(str(tmp_path), "no*").name == "notes"
    with pytest.raises(ValueError):
        discovery.only_one(str(tmp_path), "Soil_*")
    with pytest.raises(ValueError):
        discovery.size_series(str(tmp_path), "_10")
    assert discovery.pair_samples(spark, ["a-1", "zz"], ["A_1", "b"]).collect() == [("a-1", "A_1"), ("zz", None)]
    with pytest.raises(ValueError):
        discovery.pair_samples(spark, ["a-1", "a_1"], ["A 1"])


def test_sample_and_faults(spark):
    rows = spark.range(100)
    first = [r.id for r in seeded_sample(rows, ["id"], 10).collect()]
    assert first == [r.id for r in seeded_sample(rows.repartition(7), ["id"], 10).collect()] and len(set(first)) == 10
    make = lambda *v: spark.createDataFrame([v], "total long, recovered long, unrecovered long, recovered_sic long, recovered_syn long, fraction double")
    assert recovery_faults(make(10, 9, 1, 8, 2, 0.9)).count() == 0
    assert recovery_faults(make(10, 9, 2, 8, 0, 0.5)).first().faults == ["sum", "layers", "fraction"]
