import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionquill import sinks
from ionquill.operators import proteome, quantification, rescoring
from ionquill.operators import statistics as S
from ionquill.operators.spectra import Settings
from ionquill.plans import epitopes, rescore
from ionquill.sources import spectra as sources
from ionquill.sources import tables
from ionquill.streaming import arrivals
from tests.test_spectra import ion_mz


@pytest.fixture(scope="module")
def world(spark):
    """PSMs, half of them decoys with spectra of nothing, their spectra and predictions."""
    rnd = random.Random(5)
    psms, scans, preds = [], [], []
    for k in range(240):
        peptide = "".join(rnd.choice("ADEFGKLMNPQRSTVWY") for _ in range(rnd.randint(8, 12)))
        target = k % 2 == 0
        ions = [f"{s}{i}" for s in "yb" for i in range(1, len(peptide))]
        inten = [rnd.random() for _ in ions]
        length = float(np.linalg.norm(inten))
        irt = rnd.uniform(0, 100)
        good = target and k % 10 != 0
        mzs = [ion_mz(peptide, None, i) for i in ions] if good else [rnd.uniform(100, 1500) for _ in ions]
        source = f"run{k % 2 + k % 3}"
        psms.append((source, k, peptide, 1 if target else -1, "P", None, 2, 0.01 * rnd.random(), rnd.gauss(3 if good else 2, 1), 0.5, 2.0 * irt + 5 + rnd.gauss(0, 0.1 if good else 40)))
        scans.append((source, k, mzs, [x * rnd.uniform(0.8, 1.2) for x in inten]))
        preds.append((peptide, 2, peptide, 30.0, irt, ions, [x / length for x in inten]))
    p = spark.createDataFrame(psms, "source string, scan long, peptide string, Label int, proteins string, ptm_seq string, charge int, massDiff double, engineScore double, deltaScore double, retentionTime double")
    p = p.withColumns({"missedCleavages": F.lit(0), "fromChimera": F.lit(0)})
    s = spark.createDataFrame(scans, "source string, scan long, mzs array<double>, intensities array<double>")
    r = spark.createDataFrame(preds, "peptide string, charge int, modified_sequence string, collisionEnergy double, iRT double, ions array<string>, intensities array<double>")
    return p, s, r


def test_core_plan(spark, world):
    p, s, r = world
    options = rescore.default_options(rounds=1, fdr=0.05)
    features, columns = rescore.feature_table(p, s, r, options)
    features = features.persist()
    assert features.count() == 240 and {"deltaRT", "spectralAngle", "scannr", "fracKR"} <= set(features.columns)
    assert features.select("scannr").distinct().count() == 240
    scored = rescore.assignments(features, columns, options).persist()
    counts = rescore.report(scored).collect()
    assert counts[-1]["cut"] == 0.1 and counts[-1]["n"] >= 80
    worst = scored.where("Label = 1 and qValue < 0.05").agg(F.max("postErrProb")).first()[0]
    assert 0 <= worst <= 1
    by_score = scored.orderBy(F.desc("score")).select("qValue").collect()
    assert all(a["qValue"] <= b["qValue"] + 1e-12 for a, b in zip(by_score, by_score[1:]))
    assert rescore.peptide_level(scored).count() <= 240
    angles = rescore.spectral_angles(p, s, r, options)
    good = angles.where("Label = 1 and scan % 10 <> 0").agg(F.min("spectralAngle")).first()[0]
    assert good > 0.7
    table = sinks.rescorer_input(features, columns, options.match.masses)
    assert table.columns[:3] == ["specID", "Label", "scannr"] and table.first()["peptide"].startswith("-.")


def test_calibration(spark, world):
    p, s, r = world
    near = r.withColumn("collisionEnergy", F.explode(F.array(*[F.lit(float(e)) for e in range(20, 41)])))
    blurred = near.withColumn("intensities", F.transform("intensities", lambda x, i: x + F.abs(F.col("collisionEnergy") - 27) * (i % 3) * 0.05))
    got = rescore.calibrate(p.where("scan < 120"), s, blurred, rescore.default_options()).collect()
    fit = [x for x in got if x["meanScore"] > 0.1]
    assert fit and all(abs(x["collisionEnergy"] - 27) <= 1 for x in fit)


def test_q_values_equal_the_plain_ones(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([rnd.random(), 0.5, 0.25]), rnd.random() < 0.6) for k in range(300)]
    got = {r["k"]: r["q"] for r in S.q_values(spark.createDataFrame(rows, "k long, s double, t boolean"), "s", F.col("t"), "q").collect()}

    def ratio(cut):
        t, d = sum(x[2] for x in rows if x[1] >= cut), sum(not x[2] for x in rows if x[1] >= cut)
        return min(1.0, d / t) if t else 1.0

    assert all(got[k] == pytest.approx(min(ratio(x[1]) for x in rows if x[1] <= s)) for k, s, _ in rows)


def test_p_values():
    # t tables: 2.228 at 10 degrees of freedom is 5 %, 12.706 at 1, 1.96 at very many
    assert S.t_p_value(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert S.t_p_value(12.7062, 1) == pytest.approx(0.05, abs=1e-6)
    assert S.t_p_value(1.959964, 1e7) == pytest.approx(0.05, abs=1e-5)
    assert S.fisher_p(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert S.fisher_p(8, 2, 1, 5) == pytest.approx(0.0349650350)


def test_error_probabilities_fall_with_score(spark):
    rnd = random.Random(4)
    rows = [(1 if k % 2 else -1, rnd.gauss(2 if k % 2 and k % 3 else 0, 1)) for k in range(2000)]
    out = rescoring.error_probabilities(spark.createDataFrame(rows, "Label int, score double"), bins=50).orderBy("score").collect()
    assert all(a["postErrProb"] >= b["postErrProb"] - 1e-12 for a, b in zip(out, out[1:]))
    assert out[0]["postErrProb"] > 0.8 and out[-1]["postErrProb"] < 0.2


def test_proteome_mapping_equals_containment(spark):
    rnd = random.Random(6)
    proteins = [(f"P{k}", "".join(rnd.choice("ACDIL") for _ in range(120))) for k in range(12)]
    peptides = [s[i : i + 8].replace("I", "L") for _, s in proteins[:8] for i in (3, 50)] + ["ACDAC", "ACDACDACDA", "LLLLLLLL", "AAA"]
    pt = spark.createDataFrame([(p,) for p in peptides], "peptide string")
    pr = spark.createDataFrame(proteins, "name string, sequence string")
    fold = lambda s: s.replace("I", "L")
    want = {(p, n, fold(s).index(fold(p)) + 1) for p in peptides for n, s in proteins if fold(p) in fold(s)}
    assert {(r["peptide"], r["protein"], r["position"]) for r in proteome.mapped(pt, pr).collect()} == want
    back = {(r["peptide"], r["protein"]) for r in proteome.mapped(pt, pr, reverse=True).collect()}
    assert back == {(p, n) for p in peptides for n, s in proteins if fold(p) in fold(s[::-1])}
    decoys = proteome.with_decoys(pr).where("name = 'rev_P0'").first()
    assert decoys["sequence"] == proteins[0][1][::-1]


def test_candidates(spark):
    host = spark.createDataFrame([("H", "AAAAACCCCCDDDDD"), ("HB", "KKKKKLLLLL")], "name string, sequence string")
    path = spark.createDataFrame([("V", "EEEEEFFFFFGGGGG"), ("VB", "KKKKKLLLLL")], "name string, sequence string")
    rows = [("inf1", "EEEEEFF"), ("inf2", "EEEEEFF"), ("inf1", "FFGGGGG"), ("ctrl", "FFGGGGG"), ("inf1", "KKKKLLL"), ("inf1", "AAAACCC"), ("inf1", "WWWWWWW")]
    scored = spark.createDataFrame([(s, k, p, p, 1, 5.0, 0.001, 0.0123) for k, (s, p) in enumerate(rows)] + [("inf1", 90, "EEEEFFF", "x", 1, 1.0, 0.5, 0.5), ("inf1", 91, "EEFFFF", "x", -1, 1.0, 0.0, 0.0)], "source string, scan long, peptide string, modifiedSequence string, Label int, score double, qValue double, postErrProb double")
    out = epitopes.candidates(scored, host, path, ("ctrl",))
    (c,) = out["candidates"].collect()
    assert (c["peptide"], c["nFiles"], c["sources"], c["confidence"]) == ("EEEEEFF", 2, ["inf1", "inf2"], 98.77)
    assert {r["peptide"] for r in out["excluded"].collect()} == {"KKKKLLL", "FFGGGGG"} and {r["peptide"] for r in out["host"].collect()} == {"AAAACCC"}
    assert {r["side"] for r in epitopes.engines_compared(scored, scored.where("scan > 5")).collect()} == {"both", "left_only"}


def test_quantities(spark):
    rnd = random.Random(7)
    files = [(f"f{k}.raw", f"s{k // 2}", k >= 4) for k in range(8)]
    report = [(f"PEP{p}", f, "0" if p == 1 else "0.9", 1000.0 * (p + 1) * (4 if inf and p == 0 else 1) * rnd.uniform(0.95, 1.05), 10.0) for p in range(20) for f, _, inf in files]
    table = spark.createDataFrame(report + [("PEP0", "f0.raw", "0.9", 1.0, 0.5)], "PeptideSequence string, FileName string, IsotopeDotProduct string, TotalAreaMs1 double, TotalBackgroundMs1 double")
    samples = spark.createDataFrame([(f[:-4], s, i) for f, s, i in files], "source string, sample string, isInfected boolean")
    out = epitopes.quantified(table, samples)
    assert out["quantities"].count() == 160
    up = out["comparison"].where("regulation = 'Upregulated'").collect()
    assert [r["peptide"] for r in up] == ["PEP0"] and up[0]["foldChange"] == pytest.approx(2, abs=0.2)
    wide = quantification.wide(out["quantities"], ["norm"], ["f0", "f1"])
    assert wide.columns == ["peptide", "f0_norm", "f1_norm"] and wide.count() == 20
    assert quantification.n_valid(out["quantities"]).where("peptide = 'PEP3'").first()["nValid"] == 8


def test_spliced_validation(spark):
    one = spark.range(1)
    got = one.select(epitopes.oxidation_placements(F.lit("MAMM"), F.lit(2)).alias("x")).first()["x"]
    assert sorted(got) == ["0.0022.0", "0.2002.0", "0.2020.0"]
    spliced = spark.createDataFrame([("a", 1, 2, "DCAAAAM", "0.0000002.0", 5.0), ("a", 2, 2, "KKKKKKK", None, 1.0)], "source string, scan long, charge int, peptide string, ptm_seq string, reScore double")
    proteins = spark.createDataFrame([("GGGACDAAAMGGG",)], "sequence string")
    comp = epitopes.isobaric_competitors(spliced, proteins, 7, 7)
    assert {(r["peptide"], r["ptm_seq"]) for r in comp.collect()} == {("ACDAAAM", "0.0000002.0")}
    rivals = comp.withColumn("compScore", F.lit(6.0))
    assert [r["scan"] for r in epitopes.validated(spliced, rivals).collect()] == [2]
    scored = spark.createDataFrame([("a", 1, "ACDIK", 0.5), ("a", 2, "ACDIK", 0.5), ("a", 3, "ACDIK", 0.5), ("a", 4, "ACDIK", 0.5)], "source string, scan long, peptide string, spectralAngle double")
    cont = spark.createDataFrame([("a", 1, "WWWWW", 0.9), ("a", 2, "ACDLK", 0.9), ("a", 3, "WWWWW", 0.1)], "source string, scan long, peptide string, spectralAngle double")
    assert sorted(r["scan"] for r in epitopes.without_contaminants(scored, cont).collect()) == [2, 3, 4]


def test_sinks(spark, world, tmp_path):
    p, s, r = world
    few = spark.createDataFrame([("a", 1, "AMK", "0.020.0", 2), ("a", 2, "AMK", "0.020.0", 2), ("b", 3, "ACK", None, 3)], "source string, scan long, peptide string, ptm_seq string, charge int")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(sinks.predictor_input(few, 30)) == [("ACK", 3, 30), ("AM(ox)K", 2, 30)]
    assert len(key(sinks.predictor_input(few, [20, 21]))) == 4 and key(sinks.predictor_input(few, {"a": 25.0})) == [("AM(ox)K", 2, 25.0)]
    sinks.write_predictor_input(few, str(tmp_path / "in"), 30)
    sinks.write_predictor_input(few, str(tmp_path / "in"), 31, append=True)
    assert spark.read.csv(str(tmp_path / "in"), header=True).count() == 4
    assert {(x["peptide"], x["modifications"]) for x in sinks.preprec(few, {2: "Oxidation"}).collect()} == {("AMK", "2|Oxidation"), ("ACK", "-")}
    assert key(sinks.binding_batches(few, 1).select("peptide", "batch")) == [("ACK", 0), ("AMK", 1)]
    lib = r.limit(5).withColumn("modified_sequence", F.concat(F.lit("AM(ox)"), "peptide")).withColumn("peptide", F.concat(F.lit("AM"), "peptide"))
    sinks.write_msp(lib, str(tmp_path / "msp"))
    back = {x["modified_sequence"]: x for x in sources.read_msp(spark, str(tmp_path / "msp")).collect()}
    for x in lib.collect():
        assert back[x["modified_sequence"]]["ions"] == x["ions"] and back[x["modified_sequence"]]["intensities"] == pytest.approx(x["intensities"])
        assert back[x["modified_sequence"]]["iRT"] == x["iRT"]
    fasta = spark.createDataFrame([("P1", "ACDEF")], "name string, sequence string")
    sinks.write_fasta(fasta, str(tmp_path / "fa"))
    assert {(x["name"], x["sequence"]) for x in tables.read_fasta(spark, str(tmp_path / "fa")).collect()} == {("P1", "ACDEF"), ("rev_P1", "FEDCA")}
    sinks.write_features(few, str(tmp_path / "features"))
    assert spark.read.parquet(str(tmp_path / "features")).where("source = 'a'").count() == 2


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    mgf = "BEGIN IONS\nTITLE=t scan={0}\nSCANS={0}\nPEPMASS=5\n1 1\nEND IONS\n"
    go = lambda: arrivals.appended(spark, str(tmp_path / "in"), sources.read_mgf, str(tmp_path / "out"), str(tmp_path / "cp"), "*.mgf").awaitTermination()
    (tmp_path / "in" / "a.mgf").write_text(mgf.format(1))
    go()
    (tmp_path / "in" / "b.mgf").write_text(mgf.format(2))
    (tmp_path / "in" / "c.txt").write_text("no")
    go()
    assert sorted((r["source"], r["scan"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("b", 2)]


def test_match_settings_in_ppm():
    assert Settings({}, 20, "ppm").tolerance(500.0) == pytest.approx(0.01)
