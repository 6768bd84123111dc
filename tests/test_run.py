import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionquill import config, run
from ionquill.functions.registered import register
from ionquill.operators import columns as C
from tests.test_spectra import ion_mz

BASE = {"experimentTitle": "t", "outputFolder": "o", "searchEngine": "psms", "scansFolder": "s", "scansFormat": "mgf"}


def test_settings(tmp_path):
    got = config.from_dict(BASE | {"searchResults": "x.csv", "nCores": 3, "excludeFeatures": ["a"]})
    assert got.search_results == ("x.csv",) and got.false_discovery_rate == 0.01 and got.exclude_features == ("a",)
    assert config.snake("dropUnknownPTMs") == "drop_unknown_ptms"
    for bad in ({"mzUnits": "km"}, {"scansFormat": "raw"}, {"falseDiscoveryRate": 2}, {"oddKey": 1}):
        with pytest.raises(ValueError, match="."):
            config.from_dict(BASE | bad)
    with pytest.raises(ValueError, match="missing"):
        config.from_dict({"experimentTitle": "t"})
    with pytest.raises(AttributeError):
        got.nothing  # noqa: B018
    path = tmp_path / "c.yml"
    path.write_text("\n".join(f"{k}: {v}" for k, v in BASE.items()) + "\nepitopeLengthCutOff: 12\naccessionFormat: invitroSPI\n")
    assert config.load(str(path)).epitope_length_cut_off == 12 and config.load(str(path)).accession_keys == ("nonspliced", "spliced")


def test_core_from_files(spark, tmp_path):
    rnd = random.Random(3)
    (tmp_path / "scans").mkdir()
    psms, mgf, msp, fasta = ["source,scan,peptide,modifiedSequence,charge,Score,Label,proteins"], [], [], []
    for k in range(60):
        peptide = "".join(rnd.choice("ADEFGLNPQSTVWYK") for _ in range(9))
        good = k % 2 == 0
        psms.append(f"run,{k},{peptide},{peptide},2,{rnd.gauss(3 if good else 2, 1)},{1 if good else -1},P{k}")
        ions = [f"{s}{i}" for s in "yb" for i in range(1, 9)]
        inten = [rnd.uniform(0.1, 1) for _ in ions]
        peaks = "\n".join(f"{ion_mz(peptide, None, i) if good else rnd.uniform(100, 1200):.5f} {x:.4f}" for i, x in zip(ions, inten))
        mgf.append(f"BEGIN IONS\nTITLE=x scan={k}\nPEPMASS=500\nCHARGE=2+\nRTINSECONDS={k}\n{peaks}\nEND IONS\n")
        msp.append(f"Name: {peptide}/2\nMW: 0.0\nComment: Collision_energy=30.0 Mods=0 ModString={peptide}///2 iRT={k / 2}\nNum peaks: {len(ions)}\n" + "".join(f'0.0\t{x}\t"{i}/0.0ppm"\n' for i, x in zip(ions, inten)))
        fasta.append(f">{'H' if k % 4 else 'V'}{k}\nGG{peptide}GG\n")
    (tmp_path / "psms.csv").write_text("\n".join(psms))
    (tmp_path / "scans" / "run.mgf").write_text("".join(mgf))
    (tmp_path / "pred.msp").write_text("".join(msp))
    for name, mark in (("host", "H"), ("path", "V")):
        (tmp_path / f"{name}.fasta").write_text("".join(x for x in fasta if x[1] == mark))
    settings = config.from_dict(BASE | {
        "outputFolder": str(tmp_path / "out"), "scansFolder": str(tmp_path / "scans"), "searchResults": str(tmp_path / "psms.csv"), "predictedSpectra": str(tmp_path / "pred.msp"),
        "spectralAngleDfs": str(tmp_path / "psms.csv"), "hostProteome": str(tmp_path / "host.fasta"), "pathogenProteome": str(tmp_path / "path.fasta"), "falseDiscoveryRate": 0.1,
        "includeFeatures": ["spectralAngle", "engineScore", "matchedCoverage"],
    })
    run.execute(spark, settings, "prepare")
    assert spark.read.csv(str(tmp_path / "out/predictorInput"), header=True).count() == 60 * 21
    run.execute(spark, settings, "rescore")
    final = spark.read.parquet(str(tmp_path / "out/finalPsmAssignments"))
    assert final.count() == 30 and final.agg(F.max("qValue")).first()[0] < 0.2
    run.execute(spark, settings, "extractCandidates")
    kept = spark.read.parquet(str(tmp_path / "out/candidates"))
    assert kept.count() <= 15 and spark.read.parquet(str(tmp_path / "out/host")).count() <= 15
    run.execute(spark, settings, "spectralAngle")
    assert spark.read.parquet(str(tmp_path / "out/spectralAngles")).where("Label = 1").agg(F.min("spectralAngle")).first()[0] > 0.9
    with pytest.raises(ValueError, match="outside"):
        run.execute(spark, settings, "predictSpectra")


def test_sql_functions(spark):
    assert "spectral_angle" in register(spark)
    row = spark.sql("SELECT spectral_angle(array(1D, 0D, 1D), array(0D, 1D, 1D)) a, spectral_angle(array(0D), array(1D)) z, fragment_mz(1000D, 2, 18D) m, fold_il('AIL') f, nearest_peak(array(1D, 5D), 4D) p, bind_level(1D) b, confidence(0.0123D) c").first()
    assert row["a"] == pytest.approx(1 / 3) and row["z"] == 0 and row["f"] == "ALL" and tuple(row["p"]) == (1.0, 1) and row["b"] == "<=WB" and row["c"] == 98.77
    assert row["m"] == pytest.approx((1000 + 2 * 1.007276466622 - 18) / 2)


def test_columns(spark):
    t = spark.createDataFrame([(1.0, None, 3.0, "a"), (None, None, None, "b")], "x double, y double, z double, s string")
    got = t.select(*[C.across(["x", "y", "z"], w).alias(w) for w in ("min", "max", "sum", "count", "mean")], C.replaced(F.col("s"), {"a": "q"}).alias("s")).collect()
    assert tuple(got[0]) == (1.0, 3.0, 4.0, 2, 2.0, "q") and tuple(got[1]) == (None, None, 0.0, 0, None, "b")
    one = spark.range(1)
    numbered, marked = C.modification_strings(F.array(*map(F.lit, [1, 2, 3, 1, 2, 21, 0])))
    # positions are those of the residue after, one more than the place from 1
    assert tuple(one.select(numbered, marked).first()) == ("3/3,C,Carbamidomethyl/6,C,Carbamidomethyl/7,M,Oxidation", "Carbamidomethyl@C3; Carbamidomethyl@C6; Oxidation@M7")
    m = spark.createDataFrame([(1, 0.9, 5.0), (1, 0.1, 5.0), (-1, 0.9, 9.0)], "l int, a double, s double")
    assert [r[0] for r in m.select(C.metric(F.col("l"), F.col("a"), F.col("s"), 0.5, 1.0)).collect()] == [1, -1, 0]
    s = C.spectrum_index(spark.createDataFrame([("a", 7), ("a", 3), ("b", 9)], "source string, scan long"))
    assert {(r["source"], r["scan"], r["index"]) for r in s.collect()} == {("a", 3, 0), ("a", 7, 1), ("b", 9, 0)}
    assert C.filled_strings(t, ["s"]).count() == 2


def test_small_models(spark):
    rnd = random.Random(4)
    rows = [(p := "".join(rnd.choice("ACDEFGHIK") for _ in range(rnd.randint(7, 12))), 3.0 * p.count("F") - 2.0 * p.count("D") + 50) for _ in range(200)]
    t = C.fitted_times(spark.createDataFrame(rows, "peptide string, retentionTime double"))
    assert t.agg(F.max(F.abs(F.col("predictedRT") - F.col("retentionTime")))).first()[0] < 0.5
    known = spark.createDataFrame([(float(k), k % 7, 2.0 * k + 3 + (500 if k == 9 else 0)) for k in range(60)], "psmScore double, n int, engineScore double")
    out = C.score_regression(known, known.select("psmScore", "n").where("psmScore = 40"), ["psmScore", "n"]).first()
    assert out["engineScore"] == pytest.approx(83, abs=1)
    points = np.array([0.0, 0.1, 5.0, 5.2])
    merges = C.hierarchy(np.abs(points[:, None] - points))
    assert [{a, b} for a, b, _ in merges] == [{0, 1}, {2, 3}, {4, 5}] and merges[-1][2] == pytest.approx(5.05)
