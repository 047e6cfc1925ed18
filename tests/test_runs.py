"""Whole runs over small tables, and rules that the oracle cannot see."""

import random

import pytest
from pyspark.sql import functions as F

from spectraloom import session
from spectraloom.operators import collate, conflicts, correction, crosstab, cull, digest
from spectraloom.operators.quantile import exact_percentiles, percentiles_of
from spectraloom.plans import pipelines
from spectraloom.sources import fasta, tables

SCORED = "Sample string, ScanNum long, Peptide string, Protein string, ParentIonIntensity double, SpecEValue double, QValue double, FDR double, MSMSScore double, IsDecoy boolean"
PROTEINS = [(f"p{n}", f"p{n} enzyme {n} OS=Org GN=g{n} Cluster=000{n % 3}", "MKAAAAAAGHKMCCCCCCGHK" + "ACDEFGHILMNPQSTVWY"[n:] + "K") for n in range(6)]


def scored(spark, samples=("S1", "S2")):
    rows = [(s, n, "K.AAAAAAGHK.M", f"p{n % 6}", 9000.0 + n, 1e-12, 0.0, n / 1000, 12.0, False) for n in range(12) for s in samples]
    return spark.createDataFrame(rows, SCORED)


def wide(spark, names):
    rows = [(g, n, f"PEP{n}", n / 400, min(1.0, n / 500 + k * 0.01)) for k, g in enumerate(names) for n in range(400)]
    return spark.createDataFrame(rows, "g string, ScanNum long, CorePeptide string, BaseFDR double, BinnedFDRMedian double")


def read(spark, path):
    return tables.read_tsv(spark, str(path))


def test_corrected_run(spark, tmp_path):
    proteins = spark.createDataFrame(PROTEINS, "id string, header string, seq string")
    rows = scored(spark).withColumn("g", F.lit("soil"))
    pipelines.corrected_run(wide(spark, ["soil", "sea"]), rows, proteins, "g", "Sample", str(tmp_path / "run"), held_out=0.25, rollup="rrollup", summary="mean", alpha=0.05)
    out = tmp_path / "run"
    assert {r.DatasetSplit for r in read(spark, out / "formula/validation_overall").collect()} == {"train", "test"}
    sizes = {r.grp: (int(r.train_rows), int(r.test_rows)) for r in read(spark, out / "formula/formula_metadata").collect()}
    assert set(sizes) == {"soil", "sea"} and all(a + b == 400 and b > 0 for a, b in sizes.values())
    curve = tables.read_formula(spark, str(out / "formula/correction_formula/condition=sea"))
    assert curve.count() > 2 and {r.grp for r in curve.collect()} == {"sea"}
    assert read(spark, out / "formula/prediction_sample").count() == 800
    gains = read(spark, out / "correction/gains_and_losses").collect()
    assert {r.Scope for r in gains} == {"file", "ALL_FILES"}
    assert read(spark, out / "downstream/protein_crosstab_annotated").count() == 6


def test_matched_run_and_status(spark, tmp_path):
    proteins = spark.createDataFrame(PROTEINS, "id string, header string, seq string")
    curves = pipelines.derive_formula(wide(spark, ["s_1", "s_2"]), "g")
    rows = scored(spark, ["S1", "S2"])
    pairs = pipelines.matched_run(rows, curves, proteins, "Sample", str(tmp_path / "m"))
    assert {r.sample: r.formula for r in pairs.collect()} == {"S1": "s_1", "S2": "s_2"}
    fixed = {(r.Sample, int(r.ScanNum)): float(r.CorrectedFDR) for r in read(spark, tmp_path / "m/correction/corrected_scans").collect()}
    assert all(abs(fixed["S2", n] - fixed["S1", n] - 0.01) < 0.005 for n in range(2, 12))
    runs = {"design_10": lambda: None, "design_2": lambda: pipelines.matched_run(scored(spark, ["zz"]), curves, proteins, "Sample", str(tmp_path / "n")), "old_1": lambda: None}
    status = pipelines.all_runs(spark, runs, str(tmp_path / "all"), include="design|old", exclude="^old")
    assert [(r.Design, r.Status) for r in status.collect()] == [("design_2", "failed"), ("design_10", "done"), ("old_1", "skipped")]
    assert "no formula for zz" in status.filter("Status = 'failed'").first().Error
    assert read(spark, tmp_path / "all/status").count() == 3


def test_clustered_database(spark, tmp_path):
    core = "".join(random.Random(1).choice("ACDEFGHILMNPQSTVWY") for _ in range(300))
    records = {"a1": core + "K", "a2": core + "KGG", "b": "".join(random.Random(2).choice("ACDEFGHILMNPQSTVWY") for _ in range(200)) + "K"}
    (tmp_path / "p.fasta").write_text("".join(f">{n} x\n{s[:6]}K{s}\n" for n, s in records.items()))
    pipelines.prepare_databases(spark, str(tmp_path / "p.fasta"), str(tmp_path / "db"), groups=2, cluster=True)
    found = {r.id: r.Cluster for r in read(spark, tmp_path / "db/clusters").collect()}
    assert found["a1"] == found["a2"] != found["b"] and set(found.values()) == {"0001", "0002"}
    back = fasta.read_fasta(spark, str(tmp_path / "db/clustered_fasta/*"))
    assert {r.id: fasta_cluster(r.header) for r in back.collect()} == found
    assert int(read(spark, tmp_path / "db/digest_report").first().proteins_read) == 3
    in_bins = fasta.read_fasta(spark, str(tmp_path / "db/main/group_fasta/*/*")).select("seq").distinct().count()
    assert in_bins == spark.read.parquet(str(tmp_path / "db/main/groups")).count() > 0


def fasta_cluster(header):
    return header.rsplit("Cluster=", 1)[1]


def test_binning_run(spark, tmp_path):
    rng = random.Random(5)
    reference = spark.createDataFrame([(n, f"K.PEP{'ACDE'[n % 4]}.R", f"sp|P{n % 7}|X", n / 100, n % 11 == 0) for n in range(60)], "ScanNum long, Peptide string, Protein string, FDR double, IsDecoy boolean")
    def rows(share):
        return [(f"run_group_{g}", n, f"K.PEP{'ACDE'[n % 4 if rng.random() < 0.8 else 0]}.R", f"{'XXX_' if n % 9 == 0 else ''}sp|P{n % 7}|X", rng.random() / 1e6, rng.random(), 5000.0 + n, rng.random(), float(n)) for g in (1, 2) for n in range(80) if rng.random() < share]
    schema = "RunFolder string, ScanNum long, Peptide string, Protein string, SpecEValue double, QValue double, ParentIonIntensity double, PepQValue double, MSGFScore double"
    sic, syn = spark.createDataFrame(rows(0.5), schema), spark.createDataFrame(rows(0.7), schema)
    out = pipelines.binning_run(reference, sic, syn, str(tmp_path / "b"), strict=False)
    assert {r.ComparisonStatus for r in out.select("ComparisonStatus").distinct().collect()} <= {"shared", "base_only", "binning_only"}
    report = {r.RunFolder: r for r in read(spark, tmp_path / "b/culling_by_file").collect()}
    assert set(report) == {"run_group_1", "run_group_2"}
    audit = read(spark, tmp_path / "b/scan_audit")
    for folder, r in report.items():
        own = audit.filter(F.col("RunFolder") == folder)
        assert int(r.RecoveredScans) == own.filter("Category like 'recovered%'").count() == int(r.OutputRows) == int(r.TargetRows) + int(r.DecoyRows)
    summary = read(spark, tmp_path / "b/recovery_summary").first()
    assert int(summary.unrecovered) == read(spark, tmp_path / "b/unrecovered_scans").count()
    assert read(spark, tmp_path / "b/manifest").count() == 8


def test_rrollup_with_missing_values(spark):
    rows = [("p", "a", 10.0, 20.0, 30.0, True), ("p", "b", 100.0, None, None, True), ("p", "c", 1.0, 2.0, 3.0, False), ("q", "d", None, None, None, True), ("r", "e", 5.0, None, 1.0, True)]
    df = spark.createDataFrame(rows, "Protein string, PeptideFlanked string, S1 double, S2 double, S3 double, Unique boolean")
    for summary in ("median", "mean"):
        got = {r.Protein: (r.S1, r.S2, r.S3) for r in crosstab.rrollup(df, "Protein", ["S1", "S2", "S3"], summary=summary).collect()}
        assert got == {"p": (10.0, 20.0, 30.0), "q": (None, None, None), "r": (5.0, None, 1.0)}
    with pytest.raises(ValueError):
        crosstab.rrollup(df, "Protein", ["S1"], summary="mode")


def test_capped_list(spark):
    rows = [(None if n % 3 == 0 else "k", f"v{n:03d}") for n in range(20)] + [("k", None), ("k", ""), ("k", "v001"), ("none", None)]
    df = spark.createDataFrame(rows, "key string, v string")
    own = lambda k: sorted(v for g, v in set(rows) if g == k and v)
    got = {r.key: r.out for r in collate.capped_list(df, ["key"], "v", "out", cap=4).collect()}
    assert got == {k: ";".join(own(k)[:4]) + f";...(+{len(own(k)) - 4} more)" for k in ("k", None)}
    assert {r.key: r.out for r in collate.capped_list(df, ["key"], "v", "out", cap=None).collect()} == {k: ";".join(own(k)) for k in ("k", None)}


def test_clusters_match_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randrange(20, 60))) for _ in range(8)]
    rows = []
    for n in range(60):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            s[rng.randrange(len(s))] = rng.choice("ACDE")
        rows.append((f"s{n:02d}", "".join(s[: rng.randrange(15, 61)])))
    rows += [("short", "ACD"), ("none", None), ("empty", "")]
    words = {i: {s[k : k + 5] for k in range(len(s) - 4)} for i, s in rows if s}
    want, heads = {}, []
    for i, s in sorted(((i, s) for i, s in rows if s), key=lambda r: (-len(r[1]), r[0])):
        alike = [h for h in heads if words[i] and words[h] and len(words[i] & words[h]) >= 0.95**5 * min(len(words[i]), len(words[h])) - 1e-9]
        want[i] = alike[0] if alike else i
        if not alike:
            heads.append(i)
    got = {r.id: r.representative for r in conflicts.cluster_sequences(spark.createDataFrame(rows, "id string, seq string"), "id", "seq").collect()}
    assert got == want


def test_curve_in_crowded_cells(spark, monkeypatch):
    rng = random.Random(3)
    anchors = sorted({0.0, 1.0, *(rng.random() / 2000 for _ in range(200)), *(rng.random() for _ in range(20))})
    y = sorted(rng.random() for _ in anchors)
    curve = spark.createDataFrame([(g, a, b) for g in ("a", None) for a, b in zip(anchors, y)], "grp string, fdr_anchor double, corrected double")
    values = [*(rng.random() / 2000 for _ in range(100)), *anchors[::7], 0.0, 1.0, 0.5]
    rows = spark.createDataFrame([(g, v) for g in ("a", None, "other") for v in [*values, None]], "grp string, v double")
    import numpy as np

    for most in (1, 8, 1000):
        monkeypatch.setattr(correction, "CELL_STRETCHES", most)
        got = correction.apply_curve(rows, curve, "v").collect()
        assert len(got) == 3 * (len(values) + 1)
        for r in got:
            assert r.CorrectedFDR is None if r.grp == "other" or r.v is None else abs(r.CorrectedFDR - np.interp(r.v, anchors, y)) < 1e-9


def test_percentiles_of_agree(spark):
    df = spark.createDataFrame([(k % 3, float(k * k % 17), None if k % 4 else float(k)) for k in range(60)] + [(9, None, None)], "g int, x double, y double")
    both = {r.g: (r.a, r.b, r.c) for r in percentiles_of(df, ["g"], {"x": {"a": 0.25, "b": 0.5}, "y": {"c": 0.5}}).collect()}
    x = {r.g: (r.a, r.b) for r in exact_percentiles(df, ["g"], "x", {"a": 0.25, "b": 0.5}).collect()}
    y = {r.g: r.c for r in exact_percentiles(df, ["g"], "y", {"c": 0.5}).collect()}
    assert both == {g: (*x[g], y.get(g)) for g in x}


def test_reports_of_empty_inputs(spark):
    none = spark.createDataFrame([], "id string, seq string")
    report = digest.digest_report(none, "id", "seq").first()
    assert report.proteins_read == 0 and report.tda_overlap_removed_fraction == 0.0
    rows = spark.createDataFrame([], "RunFolder string, ScanNum long, Peptide string, Protein string")
    culled = rows.withColumn("SourceLayer", F.lit("SIC"))
    keys = cull.reference_keys(rows)
    expected = spark.createDataFrame([("run_group_1",)], "RunFolder string")
    got = cull.file_report(rows, rows, keys, culled, "RunFolder", expected).collect()
    assert [(r.RunFolder, r.InputRows, r.RowFDR) for r in got] == [("run_group_1", 0, None)]
    off = digest.digest_report(spark.createDataFrame([("a", "ACDEFGK"), ("b", "KGFEDCA")], "id string, seq string"), "id", "seq", remove_overlaps=False).first()
    assert off.tda_overlap_pairs == 0 and off.tda_overlap_removal_enabled == 0


def test_stages_are_dropped(spark):
    kept = session.materialize(spark.range(5))
    assert kept.count() == 5 and "stages-" in kept.inputFiles()[0]
    session.drop_stages(spark)
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0]).count()
    assert session.materialize(spark.range(3)).count() == 3


def test_scratch_folder_must_be_shared():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.shared_dir(Session())
