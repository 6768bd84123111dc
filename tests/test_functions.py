import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionquill.constants import C_TERMINUS, N_TERMINUS, PROTON, RESIDUE_MASS
from ionquill.functions import arrays as A
from ionquill.functions import peptides as P

SEQ, CODE, MASSES = "ACDEFGHIKMN", "0.02000000010.0", {1: 15.994915, 2: 57.021464}


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs]).cast("array<double>")


def test_vectors(value):
    assert value(A.spectral_angle(arr(1, 0, 1), arr(0, 1, 1))) == pytest.approx(1 / 3)
    assert value(A.spectral_angle(arr(0, 0), arr(1, 1))) == 0
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=9).round(1), rng.normal(size=9).round(1)
    assert value(A.pearson(arr(*a), arr(*b))) == pytest.approx(np.corrcoef(a, b)[0, 1])
    rank = lambda x: [(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x]
    assert value(A.spearman(arr(*a), arr(*b))) == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])
    assert value(A.pearson(arr(1, 1), arr(1, 2))) is None
    assert value(A.sample_variance(arr(0.01, 0.0, -0.01))) == pytest.approx(1e-4)
    for q in (0, 0.25, 0.5, 0.9, 1):
        assert value(A.quantile(arr(*a), q)) == pytest.approx(np.quantile(a, q))
    assert value(A.quantile(arr(), 0.5)) is None
    assert value(A.median_absolute_error(arr(*a), arr(*b))) == pytest.approx(np.median(abs(a - b)))
    got = value(A.nearest(arr(114.22, 261.33, 389.42), F.lit(261.32)))
    assert got["distance"] == pytest.approx(0.01) and got["index"] == 1
    assert value(A.unit(arr(3, 4))) == [0.6, 0.8]


def test_masses(value):
    modified = [RESIDUE_MASS[r] + MASSES.get(int(m), 0) for r, m in zip(SEQ, CODE.split(".")[1])]
    s, c = F.lit(SEQ), F.lit(CODE)
    assert value(P.prefix_masses(s, c, MASSES)) == pytest.approx(np.cumsum(modified)[:-1])
    assert value(P.prefix_masses(s, c, MASSES, True)) == pytest.approx(np.cumsum(modified[::-1])[:-1])
    assert value(P.peptide_mass(s, c, MASSES)) == pytest.approx(sum(modified) + N_TERMINUS + C_TERMINUS)
    assert value(P.peptide_mass(s, c, MASSES)) - N_TERMINUS - C_TERMINUS == pytest.approx(1318.543443)
    assert value(P.prefix_masses(s, c, MASSES))[-1] == pytest.approx(1204.500516)
    b, y = value(P.ion_masses(s, c, MASSES, "b")), value(P.ion_masses(s, c, MASSES, "y"))
    whole = value(P.peptide_mass(s, c, MASSES))
    assert all(b[k] + y[len(y) - 1 - k] == pytest.approx(whole, abs=1e-6) for k in range(len(b)))
    assert value(P.mz(F.lit(1000.0), 2, 18.0)) == pytest.approx((1000 + 2 * PROTON - 18) / 2)
    assert value(P.prefix_masses(F.lit("A"), F.lit(None).cast("string"), {})) == []


def test_ions(value):
    names = F.array(*map(F.lit, ["y1", "b1", "b3"]))
    n = F.lit(4)
    assert value(P.coverage(names, n)) == pytest.approx(2 / 3)
    assert value(P.coverage(names, n, "b")) == pytest.approx(2 / 3) and value(P.coverage(names, n, "y")) == pytest.approx(1 / 3)
    assert tuple(value(P.ion_parts(F.lit("y10^2")))) == ("y", 10, 2) and tuple(value(P.ion_parts(F.lit("b3")))) == ("b", 3, 1)


def test_modified_sequences(value):
    assert value(P.mass_tagged(F.lit(SEQ), F.lit(CODE), MASSES)) == "AC[+57.0]DEFGHIKM[+16.0]N"
    assert value(P.mass_tagged(F.lit("MAK"), F.lit("3.200.0"), {2: 15.994915, 3: 42.010565})) == "M[+58.0]AK"
    assert value(P.mass_tagged(F.lit("MAK"), F.lit(None).cast("string"), {})) == "MAK"
    assert value(P.code_from_tags(F.lit("AC[+57.0]DEFGHIKM[+16.0]N"), MASSES)) == CODE
    assert value(P.code_from_tags(F.lit("ACD"), MASSES)) is None
    assert value(P.predictor_sequence(F.lit(SEQ), F.lit(CODE), "1")) == "ACDEFGHIKM(ox)N"
    assert value(P.code_from_names(F.lit("_(ac)M(ox)PEP_"), {"ac": 3, "ox": 2})) == "3.2000.0"
    assert value(P.code_from_names(F.lit("_M(Oxidation (M))PC_"), {"Oxidation (M)": 2})) == "0.200.0"
    assert value(P.code_from_names(F.lit("_MPEP_"), {"ox": 2})) is None
    assert value(P.with_fixed(F.lit("ACDC"), F.lit(None).cast("string"), "C", 1)) == "0.0101.0"
    assert value(P.with_fixed(F.lit("AD"), F.lit(None).cast("string"), "C", 1)) is None
    assert value(P.with_fixed(F.lit("AD"), F.lit("0.02.0"), "N-term", 4)) == "4.02.0"
    assert value(P.named_modifications(F.lit("3.020.0"), {2: "Oxidation", 3: "Acetyl"})) == "0|Acetyl|2|Oxidation"
    assert value(P.named_modifications(F.lit("0.000.0"), {2: "Oxidation"})) == "-"
    assert value(P.encoded(F.lit("ACDEFGHIKM(ox)N"))) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 21, 12] + [0] * 19
    assert value(P.charge_one_hot(F.lit(3))) == [0, 0, 1, 0, 0, 0]


def test_features_and_filters(value):
    assert value(P.swapped(F.lit("AACD"))) == ["ACAD", "AADC"] and value(P.swapped(F.lit("A"))) == []
    assert value(P.n_repeated(F.lit("AACCD"))) == 2 and value(P.n_repeated(F.lit("A"))) == 0
    assert value(P.fraction_unique(F.lit("AACD"))) == 0.75 and value(P.fraction_cysteine(F.lit("AACD"))) == 0.25
    assert value(P.fraction_basic(F.lit("AKRD"))) == pytest.approx(2 / 3)
    assert value(P.n_variable(F.lit("3.020.0"), "23")) == 2 and value(P.n_variable(F.lit(None).cast("string"), "2")) == 0
    for seq, charge, fine in (("ACDEF", 2, True), ("ACDE", 2, False), ("ACDEU", 2, False), ("ACDEF", 7, False), (None, 2, False)):
        assert value(P.predictable(F.lit(seq).cast("string"), F.lit(charge))) is fine
    assert value(P.fold_il(F.lit("IL"))) == "LL"
    got = value(P.split_psm_id(P.psm_id(F.lit("my_file_1"), F.lit(77), F.lit("AC[+57.0]K"))))
    assert tuple(got) == ("my_file_1", 77, "AC[+57.0]K")
    assert value(P.without_suffix(F.lit("a.raw.mzML"))) == "a.raw"
    assert value(P.has_digit(F.lit(None).cast("string"), "5")) is False and value(P.has_digit(F.lit("0.050.0"), "5")) is True
    assert math.isclose(value(A.total(arr())), 0)
