"""Command line: runs one pipeline with the settings of a YAML file.

    python -m ionquill.run --config settings.yml --pipeline core

Steps read and write Parquet tables in the output folder, so each can be run
again alone. What outside predictors make is named in the settings:
``predictedSpectra`` (MSP files), ``bindingPredictions``, ``quantReport``.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionquill import sinks
from ionquill.config import Settings, load
from ionquill.constants import STANDARD_MODIFICATIONS
from ionquill.functions.registered import register
from ionquill.operators.spectra import Settings as Match
from ionquill.plans import epitopes, rescore
from ionquill.sources.searches import MODIFICATION_ID, read_psms, read_search
from ionquill.sources.spectra import read_mgf, read_mzml, read_msp, scans_for
from ionquill.sources.tables import best_binding, read_binding, read_distiller_log, read_fasta, read_skyline


class Run:
    """One run: its session, its settings, and its tables by name."""

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings = spark, settings

    def path(self, name: str) -> str:
        return os.path.join(self.settings.output_folder, name)

    def save(self, name: str, table: DataFrame) -> DataFrame:
        table.write.mode("overwrite").parquet(self.path(name))
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def options(self) -> rescore.Options:
        s = self.settings
        return rescore.Options(
            Match(STANDARD_MODIFICATIONS, s.mz_accuracy, s.mz_units), unknown="3456789" if s.drop_unknown_ptms else "", without_cysteine=False,
            minimal=s.use_minimal_features, fdr=s.false_discovery_rate, excluded=tuple(s.exclude_features or ()),
        )

    def psms(self) -> DataFrame:
        s = self.settings
        fixed = {name.rpartition("(")[2].rstrip(")"): MODIFICATION_ID[name] for name in (s.fixed_modifications or ()) if name in MODIFICATION_ID}
        extra = read_psms(self.spark, list(s.additional_psms) if isinstance(s.additional_psms, tuple) else s.additional_psms) if s.additional_psms else None
        engine = {"msfragger": "msfragger", "MSFragger": "msfragger"}.get(s.search_engine, s.search_engine)
        titles = {}
        if engine == "mascot":
            log = read_distiller_log(self.spark, s.distiller_log) if s.distiller_log else None
            titles = {"style": s.scan_title_format, "sources": log, "source": s.source_file_name, "reduce": s.reduce}
        return read_search(self.spark, engine, list(s.search_results), list(s.accession_keys) if s.accession_keys else None, fixed or None, extra, **titles)

    def scans(self, psms: DataFrame) -> DataFrame:
        s = self.settings
        if s.scans_format == "mgf":
            every = read_mgf(self.spark, os.path.join(s.scans_folder, "*.mgf"), combined=bool(s.combined_scans_file))
        else:
            every = read_mzml(self.spark, os.path.join(s.scans_folder, "*.mzML"))
        return scans_for(psms, every)

    def predictions(self) -> DataFrame:
        if not self.settings.predicted_spectra:
            raise ValueError("predictedSpectra names the MSP files of an outside predictor")
        return read_msp(self.spark, self.settings.predicted_spectra)

    def binding(self) -> DataFrame | None:
        named = self.settings.binding_predictions
        return read_binding(self.spark, named) if named else None


def format_search(run: Run) -> None:
    run.save("psms", run.psms())


def prepare(run: Run) -> None:
    """Inputs of the spectrum and binding predictors."""
    psms = run.table("psms")
    energy = run.settings.collision_energy
    energies = list(range(20, 41)) if energy is None else list(energy) if isinstance(energy, tuple) else energy
    sinks.write_predictor_input(psms, run.path("predictorInput"), energies)
    sinks.write_preprec(psms, run.path("preprec"), {2: "Oxidation", 1: "Carbamidomethyl"})


def pan_prepare(run: Run) -> None:
    sinks.write_binding_batches(run.table("psms").where(F.length("peptide") <= run.settings.ba_prediction_limit), run.path("bindingInput"))


def calibrate(run: Run) -> None:
    psms = run.table("psms")
    run.save("collisionEnergyStats", rescore.calibrate(psms, run.scans(psms), run.predictions(), run.options(), run.settings.calibrate_per_file))


def feature_generation(run: Run) -> None:
    psms = run.table("psms")
    features, columns = rescore.feature_table(psms, run.scans(psms), run.predictions(), run.options(), run.binding() if run.settings.use_binding_affinity else None)
    run.save("features", features)
    run.save("featureColumns", run.spark.createDataFrame([(c,) for c in columns], "name string"))


def columns_of(run: Run) -> list[str]:
    own = [r["name"] for r in run.table("featureColumns").collect()]
    wanted = run.settings.include_features
    return [c for c in own if wanted is None or c in wanted]


def feature_selection(run: Run) -> None:
    sinks.write_rescorer_input(run.table("features"), run.path("finalInput"), columns_of(run), STANDARD_MODIFICATIONS)


def final_rescoring(run: Run) -> None:
    proteome = run.settings.proteome
    proteins = read_fasta(run.spark, proteome) if proteome and run.settings.remap_to_proteome else None
    scored = run.save("allPsms", rescore.assignments(run.table("features"), columns_of(run), run.options(), proteins))
    targets = scored.where(F.col("Label") == 1)
    run.save("finalPsmAssignments", targets)
    run.save("finalPeptideAssignments", rescore.peptide_level(scored).where(F.col("Label") == 1))
    sinks.write_ssl(targets, run.path("ssl"), run.settings.quant_cut_off)


def generate_report(run: Run) -> None:
    run.save("fdrCurve", rescore.report(run.table("allPsms")))
    run.save("baseline", rescore.compared_with_baseline(run.table("features"), columns_of(run), run.options()))


def spectral_angle(run: Run) -> None:
    named = run.settings.spectral_angle_dfs
    psms = read_psms(run.spark, list(named) if isinstance(named, tuple) else named)
    run.save("spectralAngles", rescore.spectral_angles(psms, run.scans(psms), run.predictions(), run.options(), run.binding()))


def quantify(run: Run) -> None:
    s = run.settings
    samples = run.spark.read.csv(s.samples, header=True, schema="source string, sample string, isInfected boolean")
    for name, table in epitopes.quantified(read_skyline(run.spark, s.quant_report), samples).items():
        run.save(name, table)


def extract_candidates(run: Run) -> None:
    s = run.settings
    fasta = lambda p: read_fasta(run.spark, p)
    level = "finalPeptideAssignments" if s.epitope_cut_level == "peptide" else "finalPsmAssignments"
    comparison = run.table("comparison") if s.quant_report else None
    binding = run.binding()
    out = epitopes.candidates(
        run.table(level), fasta(s.host_proteome), fasta(s.pathogen_proteome), tuple(s.control_flags or ()), pep=s.epitope_candidate_cut_off, longest=s.epitope_length_cut_off,
        comparison=comparison, binding=best_binding(binding) if binding is not None else None,
    )
    for name, table in out.items():
        run.save(name, table)


def validate(run: Run) -> None:
    """Spliced PSMs that beat the best isobaric part of the proteome for their spectrum, by spectral angle."""
    s = run.settings
    spliced = read_psms(run.spark, s.spliced_psms)
    scans, predictions, options = run.scans(spliced), run.predictions(), run.options()
    rivals = epitopes.isobaric_competitors(spliced, read_fasta(run.spark, s.proteome))
    scored = lambda p: rescore.spectral_angles(p.withColumn("retentionTime", F.lit(None).cast("double")), scans, predictions, options)
    blank = {"Label": F.lit(1), "massDiff": F.lit(0.0), "engineScore": F.lit(0.0)}
    own = scored(spliced).withColumn("reScore", F.col("spectralAngle"))
    run.save("validated", epitopes.validated(own, scored(rivals.withColumns(blank)).withColumn("compScore", F.col("spectralAngle"))))


Step = Callable[[Run], None]
STEPS: dict[str, list[Step]] = {
    "format": [format_search],
    "prepare": [format_search, prepare],
    "spectralPrepare": [format_search, prepare],
    "panPrepare": [format_search, pan_prepare],
    "calibrate": [format_search, calibrate],
    "featureGeneration": [feature_generation],
    "featureSelection": [feature_selection],
    "featureSelection+": [feature_selection, final_rescoring, generate_report],
    "finalRescoring": [final_rescoring],
    "rescore": [format_search, feature_generation, feature_selection, final_rescoring],
    "generateReport": [generate_report],
    "core": [format_search, feature_generation, feature_selection, final_rescoring, generate_report],
    "calibrate+core": [format_search, calibrate, feature_generation, feature_selection, final_rescoring, generate_report],
    "spectralAngle": [spectral_angle],
    "quantify": [quantify],
    "extractCandidates": [extract_candidates],
    "validate": [validate],
}
#: Pipelines that only call outside tools or draw; their results are sources here.
OUTSIDE = ("convert", "downloadExample", "fragger", "plotIsobars", "plotSpectra", "predictBinding", "predictSpectra")


def execute(spark: SparkSession, settings: Settings, pipeline: str) -> None:
    """Runs the steps of a pipeline, one after another."""
    if pipeline in OUTSIDE:
        raise ValueError(f"{pipeline} is an outside tool's work; give its results in the settings")
    register(spark)
    run = Run(spark, settings)
    for step in STEPS[pipeline]:
        step(run)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Rescoring and analytics of peptide spectrum matches on Spark")
    parser.add_argument("--config", "--config_file", required=True, help="settings file (YAML)")
    parser.add_argument("--pipeline", required=True, choices=[*STEPS, *OUTSIDE])
    given = parser.parse_args(arguments)
    execute(SparkSession.builder.appName("ionquill").getOrCreate(), load(given.config), given.pipeline)


if __name__ == "__main__":
    main()
