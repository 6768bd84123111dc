import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionquill.constants import ION_OFFSET, PROTON, RESIDUE_MASS
from ionquill.operators import spectra as X

SETTINGS = X.Settings({1: 15.994915, 2: 57.021464})


def ion_mz(peptide, code, ion):
    m = X._ION.match(ion)
    body = [int(c) for c in (code or f"0.{'0' * len(peptide)}.0").split(".")[1]]
    each = [RESIDUE_MASS[r] + SETTINGS.masses.get(d, 0) for r, d in zip(peptide, body)]
    k, z = int(m[2]), int(m[3] or 1)
    own = sum(each[:k]) if m[1] == "b" else sum(each[-k:])
    return (own + ION_OFFSET[m[1]] + z * PROTON) / z


def psm(rnd, exact=False):
    peptide = "".join(rnd.choice("ACDEFGHKLMNPQRSTVWY") for _ in range(rnd.randint(7, 14)))
    code = None if rnd.random() < 0.5 else "0." + "".join(rnd.choice("0012") for _ in peptide) + ".0"
    ions = [f"{s}{k}{z}" for s in "yb" for z in ("", "^2") for k in range(1, len(peptide)) if rnd.random() < 0.6]
    predicted = np.array([rnd.random() for _ in ions])
    predicted /= np.linalg.norm(predicted)
    mzs = [ion_mz(peptide, code, i) + (0 if exact else rnd.gauss(0, 0.015)) for i in ions if exact or rnd.random() < 0.7]
    inten = predicted.tolist() if exact else [rnd.random() for _ in mzs]
    mzs += [] if exact else [rnd.uniform(100, 900) for _ in range(20)]
    inten += [] if exact else [rnd.random() for _ in range(20)]
    return peptide, code, rnd.choice([2, 3]), np.array(mzs), np.array(inten), ions, predicted


def plain_match(peptide, code, charge, mzs, inten, ions):
    out = []
    for ion in ions:
        z = int(X._ION.match(ion)[3] or 1)
        target = ion_mz(peptide, code, ion)
        k = min(range(len(mzs)), key=lambda i: (abs(mzs[i] - target), i))
        out.append(inten[k] if abs(mzs[k] - target) < 0.02 * z and z < min(4, charge + 1) else 0.0)
    return out


def test_literals():
    mzs = np.array([114.22, 261.33, 389.42])
    assert X.nearest_peaks(mzs, np.argsort(mzs), np.array([261.32])).tolist() == [1]
    assert X.angle(np.array([1.0, 0, 1]), np.array([0, 1.0, 1])) == pytest.approx(1 / 3)
    errors = np.array([0.01, 0.0, -0.01])
    assert np.abs(errors).mean() == pytest.approx(2 / 300) and errors.var(ddof=1) == pytest.approx(1e-4)
    kept = X._Kept(4, np.array(["y", "b", "b"]), np.array([1, 1, 3]))
    every = np.ones(3, bool)
    assert X.Match.sites(kept, every) == pytest.approx(2 / 3) and X.Match.sites(kept, every, "b") == pytest.approx(2 / 3) and X.Match.sites(kept, every, "y") == pytest.approx(1 / 3)


@pytest.mark.parametrize("seed", range(30))
def test_matching_is_the_plain_one(seed):
    p = psm(random.Random(seed))
    m = X.Match(*p, SETTINGS)
    assert m.matched.tolist() == plain_match(*p[:6])
    f = X.features(m, p[3], p[4], p[0], SETTINGS)
    assert set(f) == set(X.FULL)
    assert all(math.isfinite(v) for v in f.values())
    assert 0 <= f["spectralAngle"] <= 1 and all(0 <= f[c] <= 1 for c in f if "Coverage" in c)
    assert f["minTypeSpectralAngle"] >= 0 and -1 <= f["spearmanR"] <= 1


def test_exact_spectrum_scores_one():
    rnd = random.Random(3)
    while True:
        p = psm(rnd, exact=True)
        if len(p[3]) > 5 and np.abs(np.subtract.outer(p[3], p[3]) + np.eye(len(p[3]))).min() > 0.1 and not any("^2" in i for i in p[5]) or rnd.random() < 0.002:
            break
    f = X.features(X.Match(*p, SETTINGS), p[3], p[4], p[0], SETTINGS)
    assert f["spectralAngle"] == pytest.approx(1.0, abs=1e-3) and f["nNotMatchableDivFrags"] == 0 and f["nMajorPredNotFoundDivFrags"] == 0


def test_filter_sharing_and_precursor():
    mzs = np.array([ion_mz("ACDK", None, "b2"), ion_mz("ACDK", None, "y1"), (sum(RESIDUE_MASS[r] for r in "ACDK") + 18.0105647 + 2 * PROTON) / 2])
    m = X.Match("ACDK", None, 2, mzs, np.array([10.0, 1.0, 5.0]), ["b2", "y1", "b3"], np.array([0.005, 0.8, 0.6]), SETTINGS)
    f = X.features(m, mzs, np.array([10.0, 1.0, 5.0]), "ACDK", SETTINGS)
    assert m.precursor == 5.0 and len(m.unassigned) == 0
    # b2 is dropped as another ion's peak; what is left is y1 alone
    assert f["spectralAngle"] == pytest.approx(X.angle(np.array([1.0, 0]), np.array([0.8, 0.6])))
    assert f["nMatchedIonsDivFrags"] == pytest.approx(1 / 3) and f["matchedCoverage"] == pytest.approx(2 / 3) and f["predCoverage"] == pytest.approx(1 / 3)
    two = X.Match("GGGG", None, 2, np.array([ion_mz("GGGG", None, "b2")]), np.array([3.0]), ["b2", "b4^2"], np.array([0.6, 0.8]), SETTINGS)
    assert two.matched.tolist() == [3.0, 0.0]
    none = X.features(X.Match("ACDK", None, 2, np.zeros(0), np.zeros(0), ["b2"], np.array([1.0]), SETTINGS), np.zeros(0), np.zeros(0), "ACDK", SETTINGS)
    assert none["spectralAngle"] == 0 and none["medianFragmentMzError"] == 0.02


def test_tables(spark):
    rnd = random.Random(8)
    rows = [psm(rnd) for _ in range(40)]
    data = [(k, p, c, z, m.tolist(), i.tolist(), ions, pr.tolist()) for k, (p, c, z, m, i, ions, pr) in enumerate(rows)] + [(99, "ACDK", None, 2, None, None, None, None), (98, "ACXK", None, 2, [1.0], [1.0], ["b1"], [1.0])]
    t = spark.createDataFrame(data, "scan long, peptide string, ptm_seq string, charge int, mzs array<double>, intensities array<double>, ions array<string>, predicted array<double>")
    got = {r["scan"]: r for r in X.spectral_features(t, SETTINGS, delta_model=lambda x: x[:, 1] - x[:, 2]).collect()}
    assert set(got) == set(range(40))
    for k, p in enumerate(rows):
        want = X.features(X.Match(*p, SETTINGS), p[3], p[4], p[0], SETTINGS)
        assert all(got[k][c] == pytest.approx(v) for c, v in want.items())
        assert -3 < got[k]["prositDeltaMedian"] < 4
    native = X.matched_native(t.where("scan < 10"), SETTINGS.masses, 0.02).collect()
    for r in native:
        p = rows[r["scan"]]
        allowed = [int(X._ION.match(i)[3] or 1) <= 3 for i in p[5]]
        assert [x for x, a in zip(r["matched"], allowed) if a] == pytest.approx([x for x, a in zip(plain_match(*p[:6]), allowed) if a])
    assert X.angles(t.where("scan < 5"), SETTINGS.masses, 0.02).select(F.min("spectralAngle") >= 0).first()[0]


def test_delta_values():
    assert X.delta_features(np.zeros(0)) == dict.fromkeys(X.DELTA, -1.0)
    d = X.delta_features(np.array([-0.2, -0.07, 0.1, 0.3]))
    assert d["nDeltasAboveThreshold"] == 0.75 and d["nDeltasAboveThresholdA"] == 0.5 and d["prositDeltaMedian"] == pytest.approx(0.015)


def test_sanitise(spark):
    one = spark.range(1)
    arr = lambda *x: F.array(*map(F.lit, x))
    got = one.select(X.sanitised(arr(-0.5, 2.0, 1.0, 4.0), F.lit(3), F.lit(2), arr(1, 2, 2, 3), arr(1, 1, 3, 1)).alias("x")).first()["x"]
    assert got == [0.0, 1.0, -1.0, -1.0]
    assert one.select(X.not_matched(arr(1.0, 2.0, 3.0), arr(2.0)).alias("x")).first()["x"] == [1.0, 3.0]
