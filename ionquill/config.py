"""Settings of a run, from a flat YAML file of known keys."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

# Keys of the settings file that this engine acts on, with their defaults.
DEFAULTS: dict[str, Any] = {
    "experimentTitle": None, "outputFolder": None, "searchEngine": None, "scansFolder": None, "scansFormat": None, "searchResults": None,
    "accessionFormat": None, "accessionKeys": None, "additionalPsms": None, "alleles": None, "baPredictionLimit": 15, "calibratePerFile": True, "collisionEnergy": None,
    "combinedScansFile": False, "contaminantData": None, "controlFlags": None, "deltaMethod": "ignore", "distillerLog": None, "dropUnknown": False, "dropUnknownPTMs": True,
    "engineScoreCut": None, "enzyme": None, "epitopeCandidateCutOff": 0.1, "epitopeCutLevel": "psm", "epitopeLengthCutOff": 15, "excludeFeatures": (),
    "falseDiscoveryRate": 0.01, "filterCysteine": True, "fixedModifications": None, "hostOnlyResults": None, "hostProteome": None, "includeFeatures": None,
    "inferProteins": False, "mapContaminants": "standard", "ms1Accuracy": 5, "mzAccuracy": 0.02, "mzUnits": "Da", "pathogenProteome": None, "proteinDecoyKey": "rev_",
    "proteome": None, "quantCutOff": 0.01, "reduce": False, "remapToProteome": False, "replaceIL": False, "rescoreMethod": "percolator", "resultsExport": "psm",
    "reuseInput": False, "rtFitLoc": None, "scanTitleFormat": None, "skylineIdpCutOff": 0.5, "skylineRatioCutOff": 0.8, "sourceFileName": None, "spectralAngleDfs": None,
    "spectralPredictor": "prosit", "technicalReplicates": None, "useAccessionStrata": False, "useBindingAffinity": None, "useIrtDelta": True, "useMinimalFeatures": False,
}
#: Keys of this engine alone: tables that outside predictors and tools have made.
OWN = {"predictedSpectra": None, "bindingPredictions": None, "quantReport": None, "samples": None, "splicedPsms": None}
# Keys that steer outside tools; they are accepted and have no effect here.
OUTSIDE = frozenset(
    "accessionFlags deNovoFilterResults forceReload fraggerMemory fraggerMods fraggerDbSplits fraggerPath fraggerParams fraggerUseContams ms2pipModel mzRange nCores "
    "netMHCpan panDocker plotSpectraSourceSplit rescoreCommand silentExecution skylineConfig skylineReportTemplate skylineRunner skylinePrecursorCountFilter".split()
)
REQUIRED = ("experimentTitle", "outputFolder", "searchEngine", "scansFolder", "scansFormat")


def snake(name: str) -> str:
    """``dropUnknownPTMs`` as ``drop_unknown_ptms``."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


@dataclass(frozen=True)
class Settings:
    """One run's choices, by the file's names in snake case: ``settings.mz_accuracy``."""

    values: tuple[tuple[str, Any], ...]

    def __getattr__(self, name: str) -> Any:
        held = dict(object.__getattribute__(self, "values"))
        if name in held:
            return held[name]
        raise AttributeError(name)


def _tuples(value: Any) -> Any:
    return tuple(_tuples(x) for x in value) if isinstance(value, (list, tuple)) else value


def from_dict(given: dict[str, Any]) -> Settings:
    """Settings from the file's keys; unknown keys, missing required ones and impossible values are errors."""
    known = DEFAULTS | OWN
    unknown = sorted(set(given) - set(known) - OUTSIDE)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    missing = [k for k in REQUIRED if given.get(k) is None]
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    own = {k: given.get(k, default) for k, default in known.items()}
    if isinstance(own["searchResults"], str):
        own["searchResults"] = [own["searchResults"]]
    allowed = {"mzUnits": ("Da", "ppm"), "scansFormat": ("mgf", "mzML"), "epitopeCutLevel": ("psm", "peptide"), "resultsExport": ("psm", "peptide")}
    for key, choices in allowed.items():
        if own[key] not in choices:
            raise ValueError(f"{key} is one of {', '.join(choices)}")
    if not 0 < own["falseDiscoveryRate"] < 1:
        raise ValueError("falseDiscoveryRate lies between 0 and 1")
    if own["accessionFormat"] == "invitroSPI" and own["accessionKeys"] is None:
        own["accessionKeys"] = ["nonspliced", "spliced"]
    return Settings(tuple((snake(k), _tuples(v)) for k, v in own.items()))


def load(path: str) -> Settings:
    """Settings from a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as text:
        given = yaml.safe_load(text)
    if not isinstance(given, dict):
        raise ValueError("the settings file holds no keys")
    return from_dict(given)


