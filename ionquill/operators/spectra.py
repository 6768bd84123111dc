"""Comparison of observed and predicted spectra, PSM by PSM.

``spectral_features`` gives about thirty features in Arrow batches, where peaks
are found by binary search. ``matched_native`` is the matching alone as native
expressions, for queries that need no more than the angle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionquill.constants import AMMONIA, C_TERMINUS, ION_OFFSET, MAX_FRAGMENT_CHARGE, N_TERMINUS, OBSERVED_MAJOR, PREDICTED_MAJOR, PROTON, RESIDUE_MASS, WATER
from ionquill.functions import arrays as A
from ionquill.functions import peptides as P

# Names of the features, in the order of the feature table.
MINIMAL = [
    "spectralAngle", "predCoverage", "matchedCoverage", "minMatchedCoverage", "maxMatchedCoverage", "yIsDominantIonSeries", "bIsDominantIonSeries", "spearmanR", "pearsonR",
    "nMajorNotMatchableDivFrags", "nMinorNotMatchableDivFrags", "maxTypeSpectralAngle", "minTypeSpectralAngle", "spearmanMajorIons", "spearmanMinorIons", "nMajorPredNotFoundDivFrags",
    "medianAbsoluteError", "nMajorMatchedDivFrags", "nMinorMatchedDivFrags", "nMatchedIonsDivFrags", "nLossIonsDivFrags", "medianFragmentMzError", "fragmentMzErrorVariance",
]
FULL = [*MINIMAL, "spectrumDensity", "nNotMatchableDivFrags", "precursorIntensity", "fracMatchedKR", "possibleKrFragsDivTotal", "predNotFoundCoverage"]
DELTA = ["nDeltasAboveThreshold", "nDeltasAboveThresholdA", "nDeltasAboveZero", "prositDeltaMedian", "prositDeltaQuartile1", "prositDeltaQuartile3", "minPrositDelta", "maxPrositDelta"]
FLAGS = {"yIsDominantIonSeries", "bIsDominantIonSeries"}
_ION = re.compile(r"([a-z])(\d+)(?:\^(\d+))?")


@dataclass(frozen=True)
class Settings:
    """``accuracy`` in dalton or ppm; ``loss_charge`` "precursor" or "fragment" is the charge that neutral losses are looked for at."""

    masses: dict[int, float]
    accuracy: float = 0.02
    units: str = "Da"
    loss_charge: str = "precursor"
    oxidation: str = "2"

    def tolerance(self, mz: np.ndarray | float) -> np.ndarray | float:
        return mz * self.accuracy * 1e-6 if self.units == "ppm" else self.accuracy + 0 * mz


def angle(a: np.ndarray, b: np.ndarray) -> float:
    n = math.sqrt(float(a @ a) * float(b @ b))
    return 1 - 2 * math.acos(max(-1.0, min(1.0, float(a @ b) / n))) / math.pi if n > 0 else 0.0


def ranks(x: np.ndarray) -> np.ndarray:
    """From 1; ties share their mean."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    first = np.r_[True, s[1:] != s[:-1]]
    start = np.flatnonzero(first)
    size = np.diff(np.r_[start, len(s)])
    out = np.empty(len(x))
    out[order] = np.repeat(start + (size + 1) / 2, size)
    return out


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson's; nan where an array is constant or too short."""
    if len(a) < 2:
        return math.nan
    a, b = a - a.mean(), b - b.mean()
    n = math.sqrt(float(a @ a) * float(b @ b))
    return float(a @ b) / n if n > 0 else math.nan


def _or(x: float, default: float) -> float:
    return default if math.isnan(x) else x


def nearest_peaks(mzs: np.ndarray, order: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Index of the peak nearest to each target; of two as near the one that comes first in the spectrum."""
    s = mzs[order]
    right = np.clip(np.searchsorted(s, target), 0, len(s) - 1)
    left = np.maximum(right - 1, 0)
    dl, dr = np.abs(s[left] - target), np.abs(s[right] - target)
    take_left = (dl < dr) | ((dl == dr) & (order[left] < order[right]))
    pick = np.where(take_left, left, right)
    # equal m/z values: the first of them
    pick = np.searchsorted(s, s[pick])
    return order[pick]


class Match:
    """Predicted ions of one PSM met with its observed peaks."""

    def __init__(self, peptide: str, code: str | None, charge: int, mzs: np.ndarray, observed: np.ndarray, ions: list[str], predicted: np.ndarray, settings: Settings):
        self.n, self.charge = len(peptide), charge
        head, body, tail = (code or f"0.{'0' * self.n}.0").split(".")
        mass = lambda d: settings.masses.get(int(d), 0.0)
        each = np.array([RESIDUE_MASS[r] + mass(d) for r, d in zip(peptide, body, strict=True)])
        ends = mass(head), mass(tail)
        self.mass = float(each.sum()) + ends[0] + ends[1] + N_TERMINUS + C_TERMINUS
        sums = {"b": np.cumsum(each) + ends[0] + ION_OFFSET["b"], "y": np.cumsum(each[::-1]) + ends[1] + ION_OFFSET["y"]}
        parts = [_ION.match(i) for i in ions]
        self.series = np.array([m[1] for m in parts])
        self.position = np.array([int(m[2]) for m in parts])
        z = np.array([int(m[3] or 1) for m in parts])
        self.ions, self.predicted = list(ions), predicted.astype(float)
        known = np.isin(self.series, ("b", "y")) & (self.position < self.n) & (self.position > 0) & (z < min(MAX_FRAGMENT_CHARGE + 1, charge + 1))
        neutral = np.array([sums[s][p - 1] if k else 0.0 for s, p, k in zip(self.series, self.position, known, strict=True)])
        self.inds = np.full(len(ions), -1)
        self.matched = np.zeros(len(ions))
        self.errors = np.zeros(0)
        self.n_losses = 0
        self.precursor = 0.0
        used = np.zeros(len(mzs), bool)
        if len(mzs):
            order = np.argsort(mzs, kind="stable")
            if len(ions):
                target = (neutral + z * PROTON) / z
                near = nearest_peaks(mzs, order, target)
                width = settings.tolerance(target) * z
                hit = known & (np.abs(mzs[near] - target) < width)
                self.inds[hit], self.matched[hit] = near[hit], observed[near[hit]]
                by_series = np.lexsort((self.position[hit], z[hit], self.series[hit] == "b"))
                self.errors = (mzs[near] - target)[hit][by_series]
                used[near[hit]] = True
                for loss in (AMMONIA, WATER):
                    zl = np.full(len(z), charge) if settings.loss_charge == "precursor" else z
                    at = (neutral + zl * PROTON - loss) / zl
                    self.n_losses += int((hit & (np.abs(mzs[nearest_peaks(mzs, order, at)] - at) < width)).sum())
            whole = (self.mass + charge * PROTON) / charge
            k = nearest_peaks(mzs, order, np.array([whole]))[0]
            if abs(mzs[k] - whole) < settings.tolerance(whole) * charge:
                self.precursor = float(observed[k])
                used[k] = True
        self.unassigned = observed[~used]

    def sites(self, keep: np.ndarray, series: str | None = None) -> float:
        keep = keep & (self.series == series) if series else keep
        where = np.where(self.series == "y", self.n - self.position, self.position)[keep]
        return len(set(where.tolist())) / (self.n - 1)


def features(m: Match, mzs: np.ndarray, observed: np.ndarray, peptide: str, settings: Settings) -> dict[str, float]:
    """All features of one PSM; ``FULL`` lists them."""
    bonds = m.n - 1
    found = m.matched > 0
    length = float(np.linalg.norm(m.matched))
    normed = m.matched / length if length else m.matched.copy()
    # a tiny prediction that was seen ten times as strong is another ion's peak
    keep = ~((m.predicted <= 0.01) & (normed >= 10 * m.predicted))
    out: dict[str, float] = {
        "predCoverage": m.sites(keep), "matchedCoverage": m.sites(found),
    }
    b_pred, y_pred, b_seen, y_seen = m.sites(keep, "b"), m.sites(keep, "y"), m.sites(found, "b"), m.sites(found, "y")
    out["yIsDominantIonSeries"], out["bIsDominantIonSeries"] = int(y_pred > b_pred), int(b_pred > y_pred)
    low, high = (b_seen, y_seen) if y_pred > b_pred else (y_seen, b_seen) if b_pred > y_pred else sorted((b_seen, y_seen))
    out["minMatchedCoverage"], out["maxMatchedCoverage"] = low, high
    raw, pred, series, inds, position = m.matched[keep], m.predicted[keep], m.series[keep], m.inds[keep], m.position[keep]
    x = normed[keep].copy()
    if not keep.all():
        length = float(np.linalg.norm(x))
        x = x / length if length else x
    # ions on one peak share it in proportion to their predictions
    for k in np.unique(inds[inds >= 0]):
        same = inds == k
        if same.sum() > 1:
            x[same] *= pred[same] / pred[same].sum()
    seen = raw > 0
    n_seen = int(seen.sum())
    out["spectralAngle"] = angle(x, pred)
    out["spearmanR"] = _or(correlation(ranks(x), ranks(pred)), 0.0) if n_seen else 0.0
    out["pearsonR"] = _or(correlation(x, pred), -1.0) if n_seen else 0.0
    total = float(np.linalg.norm(observed))
    out["nMajorNotMatchableDivFrags"] = float((m.unassigned > OBSERVED_MAJOR * total).sum()) / bonds
    out["nMinorNotMatchableDivFrags"] = out["nNotMatchableDivFrags"] = len(m.unassigned) / bonds
    of = {s: angle(x[series == s], pred[series == s]) if n_seen else 0.0 for s in "by"}
    first, second = ("b", "y") if out["bIsDominantIonSeries"] else ("y", "b") if out["yIsDominantIonSeries"] else sorted("by", key=lambda s: -of[s])
    out["maxTypeSpectralAngle"], out["minTypeSpectralAngle"] = of[first], of[second]
    major = pred >= PREDICTED_MAJOR
    n_major = int((x[major] > 0).sum()) if length else 0
    n_minor = n_seen - n_major if length else 0
    for name, own, n in (("spearmanMajorIons", major, n_major), ("spearmanMinorIons", ~major, n_minor)):
        out[name] = _or(correlation(ranks(x[own]), ranks(pred[own])), 0.0) if n > 0 else 0.0
    out["nMajorPredNotFoundDivFrags"] = (int(major.sum()) - n_major) / bonds
    out["medianAbsoluteError"] = float(np.median(np.abs(x - pred))) if len(x) else 0.0
    out["nMajorMatchedDivFrags"], out["nMinorMatchedDivFrags"], out["nMatchedIonsDivFrags"] = n_major / bonds, n_minor / bonds, n_seen / bonds
    out["nLossIonsDivFrags"] = m.n_losses / bonds
    default = min(settings.accuracy, 0.04)
    # a mean of absolute errors, under the name that downstream tables expect
    out["medianFragmentMzError"] = float(np.abs(m.errors).mean()) if len(m.errors) else default
    out["fragmentMzErrorVariance"] = float(m.errors.var(ddof=1)) if len(m.errors) > 1 else default
    reach = float(mzs.max() - mzs.min()) if len(mzs) else 0.0
    out["spectrumDensity"] = len(mzs) / reach if reach > 0 else 1.0
    out["precursorIntensity"] = m.precursor / (length + m.precursor) if m.precursor else 0.0
    out["predNotFoundCoverage"] = Match.sites(_Kept(m.n, series, position), ~seen)
    out |= _basic_residues(peptide, raw, series, position)
    return out


class _Kept:
    def __init__(self, n: int, series: np.ndarray, position: np.ndarray):
        self.n, self.series, self.position = n, series, position


def _basic_residues(peptide: str, matched: np.ndarray, series: np.ndarray, position: np.ndarray) -> dict[str, float]:
    """Share of the ions that hold a lysine or arginine that were matched, and of fragments that could."""
    n = len(peptide)
    at = [k for k, r in enumerate(peptide) if r in "KR"]
    if not at:
        return {"fracMatchedKR": 0.0, "possibleKrFragsDivTotal": 0.0}
    b_from, y_from = n - (at[0] + 2), n - (n - 1 - at[-1] + 2)
    own = np.where(series == "b", position > b_from, position > y_from)
    seen = matched > 0
    part = seen[own].mean() if own.any() else seen.mean() if len(seen) else 0.0
    return {"fracMatchedKR": float(part), "possibleKrFragsDivTotal": (b_from + y_from) / (n - 1)}


# Inputs of the delta model, in its order.
DELTA_INPUTS = [
    "spectralAngle", "blosumC", "blosumN", "nTermDist", "cTermDist", "charge", "cNeighbourBlosum", "nNeighbourBlosum", "yErrsAtLoc", "bErrsAtLoc", "collisionEnergy",
    "bPrositIntesAtC", "yPrositIntesAtN", "yPrositIntesAtLoc", "bPrositIntesAtLoc", "yMatchedIntesAtN", "bMatchedIntesAtC", "yMatchedIntesAtLoc", "bMatchedIntesAtLoc",
    "cOxidation", "nOxidation", "flipYNewIntensity", "flipBNewIntensity", "matchedCoverage",
]


def delta_inputs(m: Match, peptide: str, code: str | None, energy: float, mzs: np.ndarray, observed: np.ndarray, known: dict[str, float], settings: Settings) -> np.ndarray:
    """A row of ``DELTA_INPUTS`` for each bond between different residues: what swapping the two would change."""
    from ionquill.constants import RESIDUE_PROPERTIES

    n, blosum = len(peptide), [RESIDUE_PROPERTIES[r][3] for r in peptide]
    body = (code or f"0.{'0' * n}.0").split(".")[1]
    length = float(np.linalg.norm(m.matched))
    normed = m.matched / length if length else m.matched
    at = lambda values, series, site: float(values[(m.series == series) & (m.position == (n - site if series == "y" else site))].sum()) if 0 < site < n else 0.0
    mass = lambda k: RESIDUE_MASS[peptide[k]] + settings.masses.get(int(body[k]), 0.0)
    rows = []
    order = np.argsort(mzs, kind="stable")
    head, tail = (settings.masses.get(int((code or "0..0").split(".")[k]), 0.0) for k in (0, 2))

    def swapped(site: int, series: str) -> float:
        own = [*range(site - 1), site] if series == "b" else [*range(site + 1, n), site - 1]
        target = sum(mass(k) for k in own) + (head if series == "b" else tail) + ION_OFFSET[series] + PROTON
        if not len(mzs):
            return 0.0
        k = nearest_peaks(mzs, order, np.array([target]))[0]
        return float(observed[k]) if abs(mzs[k] - target) < settings.tolerance(target) else 0.0

    for site in (k for k in range(1, n) if peptide[k - 1] != peptide[k]):
        rows.append({
            "spectralAngle": known["spectralAngle"], "matchedCoverage": known["matchedCoverage"], "charge": m.charge, "collisionEnergy": energy,
            "blosumN": blosum[site - 1], "blosumC": blosum[site], "nTermDist": site, "cTermDist": n - site,
            "cNeighbourBlosum": blosum[site + 1] if site <= n - 3 else -5.0, "nNeighbourBlosum": blosum[site - 2] if site >= 2 else -5.0,
            "yErrsAtLoc": at(np.abs(normed - m.predicted), "y", site), "bErrsAtLoc": at(np.abs(normed - m.predicted), "b", site),
            "bPrositIntesAtC": at(m.predicted, "b", site + 1), "yPrositIntesAtN": at(m.predicted, "y", site - 1), "yPrositIntesAtLoc": at(m.predicted, "y", site),
            "bPrositIntesAtLoc": at(m.predicted, "b", site), "yMatchedIntesAtN": at(normed, "y", site - 1), "bMatchedIntesAtC": at(normed, "b", site + 1),
            "yMatchedIntesAtLoc": at(normed, "y", site), "bMatchedIntesAtLoc": at(normed, "b", site),
            "cOxidation": float(body[site] == settings.oxidation), "nOxidation": float(body[site - 1] == settings.oxidation),
            "flipYNewIntensity": swapped(site, "y"), "flipBNewIntensity": swapped(site, "b"),
        })
    return np.array([[r[c] for c in DELTA_INPUTS] for r in rows]).reshape(-1, len(DELTA_INPUTS))


def delta_features(deltas: np.ndarray) -> dict[str, float]:
    """Shares above -0.1, -0.05 and 0, and quantiles; -1 for a peptide without any site."""
    if not len(deltas):
        return dict.fromkeys(DELTA, -1.0)
    q = np.quantile(deltas, [0.5, 0.25, 0.75, 0, 1]).tolist()
    return dict(zip(DELTA, [*(float((deltas > c).mean()) for c in (-0.1, -0.05, 0.0)), *q], strict=True))


def spectral_features(psms: DataFrame, settings: Settings, minimal: bool = False, delta_model: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Adds the features to PSMs joined with their spectrum and prediction.

    Needs ``peptide``, ``ptm_seq``, ``charge``, ``mzs``, ``intensities``, ``ions``,
    ``predicted``. Spectra and predictions are dropped. Rows without spectrum,
    prediction or charge, or with residues of unknown mass, are left out.
    ``delta_model`` maps rows of ``DELTA_INPUTS`` to deltas and adds ``DELTA``.
    """
    names = [*(MINIMAL if minimal else FULL), *(DELTA if delta_model else [])]
    fit = psms.where(F.col("mzs").isNotNull() & F.col("ions").isNotNull() & F.col("charge").isNotNull() & F.col("peptide").rlike(f"^[{''.join(RESIDUE_MASS)}]{{2,}}$"))
    kept = [c for c in psms.columns if c not in ("mzs", "intensities", "ions", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c).to_pylist() for c in ("peptide", "ptm_seq", "charge", "mzs", "intensities", "ions", "predicted")}
            energies = batch.column("collisionEnergy").to_pylist() if "collisionEnergy" in batch.schema.names else [0.0] * batch.num_rows
            rows = []
            for peptide, code, charge, mzs, inten, ions, predicted, energy in zip(*column.values(), energies, strict=True):
                mzs, inten = np.array(mzs, float), np.array(inten, float)
                m = Match(peptide, code, charge, mzs, inten, ions, np.array(predicted, float), settings)
                own = features(m, mzs, inten, peptide, settings)
                if delta_model:
                    inputs = delta_inputs(m, peptide, code, energy or 0.0, mzs, inten, own, settings)
                    own |= delta_features(delta_model(inputs) if len(inputs) else np.zeros(0))
                rows.append(own)
            new = [pa.array([r[c] for r in rows], pa.int64() if c in FLAGS else pa.float64()) for c in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, *names])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in psms.select(*kept).schema] + [f"{c} {'long' if c in FLAGS else 'double'}" for c in names]
    return fit.mapInArrow(run, ", ".join(kinds))


def matched_native(psms: DataFrame, masses: dict[int, float], accuracy: float, units: str = "Da") -> DataFrame:
    """Adds ``matched``: for each predicted ion the intensity of its nearest peak within tolerance, 0 without one; native expressions only."""
    sums = {s: P.ion_masses(F.col("peptide"), F.col("ptm_seq"), masses, s) for s in "by"}
    held = psms.withColumns({"__b": sums["b"], "__y": sums["y"]})

    def intensity(ion: Column) -> Column:
        def of(p: Column) -> Column:
            own = F.when(p["series"] == "y", F.get(F.col("__y"), p["position"] - 1)).when(p["series"] == "b", F.get(F.col("__b"), p["position"] - 1))
            target = P.mz(own, p["charge"])
            width = (target * accuracy * 1e-6 if units == "ppm" else F.lit(accuracy)) * p["charge"]
            return A.once(A.nearest(F.col("mzs"), target), lambda near: F.when(near["distance"] < width, F.get(F.col("intensities"), near["index"])).otherwise(0.0))

        return F.coalesce(A.once(P.ion_parts(ion), of), F.lit(0.0))

    return held.withColumn("matched", F.transform("ions", intensity)).drop("__b", "__y")


def angles(psms: DataFrame, masses: dict[int, float], accuracy: float, units: str = "Da") -> DataFrame:
    """Adds ``spectralAngle`` of matched and predicted intensities alone."""
    return matched_native(psms, masses, accuracy, units).withColumn("spectralAngle", A.spectral_angle(F.col("matched"), F.col("predicted"))).drop("matched")


def sanitised(intensities: Column, length: Column, charge: Column, position: Column, ion_charge: Column) -> Column:
    """A predictor's raw output: impossible ions -1, negatives 0, scaled to a largest value of 1."""
    clipped = F.transform(intensities, lambda x: F.greatest(x, F.lit(0.0)))
    masked = F.zip_with(F.arrays_zip(position.alias("p"), ion_charge.alias("z")), clipped, lambda k, x: F.when((k["p"] >= length) | (k["z"] > charge), -1.0).otherwise(x))
    return A.once(F.array_max(masked), lambda top: F.transform(masked, lambda x: F.when((x > 0) & (top > 0), x / top).otherwise(x)))


def not_matched(mzs: Column, *groups: Column) -> Column:
    """Peaks whose m/z is in none of the groups."""
    taken = F.concat(*groups)
    return F.filter(mzs, lambda x: ~F.array_contains(taken, x))
