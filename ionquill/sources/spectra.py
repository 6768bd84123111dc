"""Readers of spectra and spectral libraries: MGF, mzML, MSP."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionquill.functions.arrays import norm, once
from ionquill.functions.peptides import without_suffix
from ionquill.operators.relational import top_one


def file_stem(column: str = "_metadata.file_name") -> Column:
    return F.regexp_replace(F.col(column), r"\.[^.]*$", "")


def _field(block: Column, name: str) -> Column:
    """Value of a ``NAME=value`` line; null where there is none."""
    return F.nullif(F.regexp_extract(block, rf"(?im)^{name}=[ \t]*([^\r\n]*?)[ \t]*\r?$", 1), F.lit(""))


def _numbers(lines: Column, place: int) -> Column:
    return F.transform(lines, lambda x: F.get(F.split(x, r"[ \t]+"), F.lit(place)).try_cast("double"))


def read_mgf(spark: SparkSession, path: str | list[str], title_format: str | None = None, sources: list[str] | None = None, combined: bool = False) -> DataFrame:
    """One row for each ``BEGIN IONS`` block.

    Columns ``source``, ``scan``, ``mzs``, ``intensities``, ``charge``,
    ``retentionTime``, ``ms1Intensity``. The scan is the SCANS line or what
    follows ``scan=`` in the title; with ``title_format`` "mascotDistiller" scan
    and file number come from the title, and ``sources`` names the files. With
    ``combined`` the title names the source. Of repeated scans the first by
    number of peaks stays.
    """
    blocks = spark.read.option("lineSep", "END IONS").text(path).select(F.col("value").alias("b"), file_stem().alias("file")).where(F.contains("b", F.lit("BEGIN IONS")))
    b = F.col("b")
    peaks = F.filter(F.transform(F.split(b, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[0-9.+\-]"))
    title, pepmass = F.coalesce(_field(b, "TITLE"), F.lit("")), F.split(_field(b, "PEPMASS"), r"[ \t]+")
    if title_format in (None, "distiller"):
        scan = F.coalesce(_field(b, "SCANS").try_cast("long"), F.regexp_extract(title, r"scan=(\d+)", 1).try_cast("long"), F.regexp_extract(title, r"^(\d+)", 1).try_cast("long"))
        source = F.regexp_extract(title, r'File:"?(.*?)\.raw', 1) if combined else F.col("file")
    else:
        scan = F.regexp_extract(title, r" Scan (\d+)", 1).try_cast("long")
        number = F.regexp_extract(title, r" from file \[(\d+)\]", 1).try_cast("int")
        source = F.get(F.array(*map(F.lit, sources or [])), number)
    rows = blocks.select(
        source.alias("source"), scan.alias("scan"), _numbers(peaks, 0).alias("mzs"), _numbers(peaks, 1).alias("intensities"),
        F.regexp_extract(F.coalesce(_field(b, "CHARGE"), F.lit("")), r"(\d+)", 1).try_cast("int").alias("charge"),
        _field(b, "RTINSECONDS").try_cast("double").alias("retentionTime"), F.coalesce(F.get(pepmass, F.lit(1)).try_cast("double"), F.lit(-1.0)).alias("ms1Intensity"),
    )
    return top_one(rows, ["source", "scan"], F.desc(F.size("mzs")), F.desc("ms1Intensity"), F.asc("mzs"))


def _decoded(text: str, double: bool, packed: bool) -> np.ndarray:
    raw = base64.b64decode(text or "")
    return np.frombuffer(zlib.decompress(raw) if packed and raw else raw, "<f8" if double else "<f4").astype(np.float64)


def read_mzml(spark: SparkSession, path: str | list[str], level: int | None = 2) -> DataFrame:
    """One row for each spectrum; columns as ``read_mgf`` gives them, and ``msLevel`` and ``precursor``.

    Element texts are found with the parser's own regular expressions; only the
    packed arrays are decoded in Arrow batches. ``level`` keeps one MS level.
    """
    blocks = spark.read.option("lineSep", "</spectrum>").text(path).select("value", file_stem().alias("source"))
    x = F.regexp_extract("value", r"(?s)(<spectrum\s.*)$", 1)
    blocks = blocks.withColumn("x", x).where("x <> ''")

    def param(accession: str, what: str = "value") -> Column:
        tag = F.regexp_extract(F.col("x"), rf'(?s)(<cvParam[^>]*accession="{accession}"[^>]*>)', 1)
        return F.nullif(F.regexp_extract(tag, rf'\b{what}="([^"]*)"', 1), F.lit(""))

    arrays = F.regexp_extract_all(F.col("x"), F.lit(r"(?s)(<binaryDataArray\b.*?</binaryDataArray>)"), F.lit(1))
    minutes = param("MS:1000016", "unitName") == "minute"
    rt = param("MS:1000016").try_cast("double")
    parts = blocks.select(
        "source", F.regexp_extract("x", r'\bid="[^"]*scan=(\d+)', 1).try_cast("long").alias("scan"),
        F.coalesce(param("MS:1000511").try_cast("int"), F.lit(2)).alias("msLevel"), param("MS:1000041").try_cast("int").alias("charge"),
        F.when(minutes, rt * 60).otherwise(rt).alias("retentionTime"), param("MS:1000042").try_cast("double").alias("ms1Intensity"),
        param("MS:1000744").try_cast("double").alias("precursor"), F.regexp_extract("x", r'spectrumRef="[^"]*scan=(\d+)', 1).try_cast("long").alias("precursorScan"), arrays.alias("arrays"),
    )
    if level is not None:
        parts = parts.where(F.col("msLevel") == level)
    names = [c for c in parts.columns if c != "arrays"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        binary = re.compile(r"<binary>(.*?)</binary>", re.S)
        for batch in batches:
            mzs, intensities = [], []
            for tags in batch.column("arrays").to_pylist():
                own = {}
                for tag in tags or []:
                    text = binary.search(tag)
                    kind = "m" if "MS:1000514" in tag else "i" if "MS:1000515" in tag else None
                    if kind:
                        own[kind] = _decoded(text[1].strip() if text else "", "MS:1000523" in tag, "MS:1000574" in tag)
                mzs.append(own.get("m", np.zeros(0)))
                intensities.append(own.get("i", np.zeros(0)))
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(mzs, kind), pa.array(intensities, kind)], names=[*names, "mzs", "intensities"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.select(*names).schema)
    return parts.mapInArrow(run, kinds + ", mzs array<double>, intensities array<double>")


def spread_retention_times(ms2: DataFrame, ms1: DataFrame, seconds: float = 60.0, width: float = 0.01) -> DataFrame:
    """Replaces each spectrum's time by the intensity-weighted mean time of its precursor's peaks in MS1 scans nearby.

    ``ms2`` has ``source``, ``scan``, ``precursor``, ``retentionTime``; ``ms1`` has
    spectra. Peaks count within ``seconds`` and ``width`` of the precursor; where
    there are none the time stays. Peaks of one time and mass are added up first,
    and spectra of one time and precursor are asked for once, so repeated values
    aren't expanded into pairs; pairs grow with the distinct values that lie within
    both widths of each other. Both conditions are binned, so the join is an equi-join.
    """
    peaks = ms1.select("source", F.col("retentionTime").alias("t"), F.explode(F.arrays_zip("mzs", "intensities")).alias("p")).select("source", "t", F.col("p.mzs").alias("m"), F.col("p.intensities").alias("i"))
    peaks = peaks.groupBy("source", "t", "m").agg(F.sum("i").alias("i"))
    cell = lambda t, m: (F.floor(t / seconds), F.floor(m / width))
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    t_bin, m_bin = cell(F.col("retentionTime"), F.col("precursor"))
    point = ["source", "precursor", "retentionTime"]
    rows = ms2.select(*point, "scan")
    asked = rows.select(*point).distinct().select("*", F.explode(near).alias("d")).select("*", (t_bin + F.col("d.a")).alias("tb"), (m_bin + F.col("d.b")).alias("mb"))
    t_own, m_own = cell(F.col("t"), F.col("m"))
    met = asked.join(peaks.select("*", t_own.alias("tb"), m_own.alias("mb")), ["source", "tb", "mb"])
    met = met.where((F.abs(F.col("t") - F.col("retentionTime")) < seconds) & (F.abs(F.col("m") - F.col("precursor")) < width))
    sums = met.groupBy(*point).agg(F.sum(F.col("t") * F.col("i")).alias("ti"), F.sum("i").alias("i"))
    means = rows.join(sums, point).groupBy("source", "scan").agg((F.sum("ti") / F.nullif(F.sum("i"), F.lit(0.0))).alias("__rt"))
    return ms2.join(means, ["source", "scan"], "left").withColumn("retentionTime", F.coalesce("__rt", "retentionTime")).drop("__rt")


def read_msp(spark: SparkSession, path: str | list[str], oxidation: str = "(ox)") -> DataFrame:
    """One row for each predicted spectrum of an MSP library.

    Columns ``peptide``, ``charge``, ``modified_sequence`` (oxidised residues
    followed by ``oxidation``), ``collisionEnergy``, ``iRT``, ``ions`` and
    ``intensities``. Peaks without intensity are dropped; intensities have unit
    length. Comments of both predictors' dialects are read: ``ModString`` names
    the residue after the modified one, counted from 1; a comment without it
    gives places counted from 0.
    """
    blocks = spark.read.option("lineSep", "Name: ").text(path).select(F.col("value").alias("b")).where(F.contains("b", F.lit("Num peaks")))
    b = F.col("b")
    peptide, charge = F.regexp_extract(b, r"^([A-Z]+)/(\d+)", 1), F.regexp_extract(b, r"^([A-Z]+)/(\d+)", 2).cast("int")
    comment = F.regexp_extract(b, r"(?m)^Comment:[ \t]*([^\r\n]*)", 1)
    mods = F.regexp_extract(comment, r"ModString=[A-Z]+//([^/]*)/", 1)
    at_prosit = F.transform(F.regexp_extract_all(mods, F.lit(r"Oxidation@M(\d+)"), F.lit(1)), lambda x: x.cast("int") - 1)
    numbered = F.regexp_extract(comment, r"(?:^|\s)Mods=\d+/(\S+)", 1)
    at_numbered = F.transform(F.regexp_extract_all(numbered, F.lit(r"(\d+),[A-Z],Oxidation"), F.lit(1)), lambda x: x.cast("int") + 1)
    places = F.when(F.contains(comment, F.lit("ModString=")), at_prosit).otherwise(at_numbered)
    letters = F.filter(F.split(peptide, ""), lambda x: x != "")
    marked = F.array_join(F.transform(letters, lambda r, i: F.when(F.array_contains(places, i + 1), F.concat(r, F.lit(oxidation))).otherwise(r)), "")
    lines = F.filter(F.split(b, r"\r?\n"), lambda x: x.rlike(r"^[0-9.eE+\-]+\s+[0-9.eE+\-]+\s+\""))
    ion = lambda x: F.regexp_extract(x, r'"([a-z]\d+(?:\^\d+)?)', 1)
    peaks = F.transform(lines, lambda x: F.struct(ion(x).alias("ion"), F.get(F.split(x, r"\s+"), F.lit(1)).try_cast("double").alias("inte")))
    kept = F.filter(peaks, lambda p: (p["inte"] > 0) & (p["ion"] != ""))
    rows = blocks.select(
        peptide.alias("peptide"), charge.alias("charge"), marked.alias("modified_sequence"),
        F.regexp_extract(comment, r"Collision_energy=([0-9.]+)", 1).try_cast("double").alias("collisionEnergy"),
        F.regexp_extract(comment, r"iRT=(-?[0-9.eE+\-]+)", 1).try_cast("double").alias("iRT"), kept.alias("k"),
    )
    raw = F.transform("k", lambda p: p["inte"])
    unit = once(norm(raw), lambda n: F.transform(raw, lambda x: x / n))
    return rows.select("peptide", "charge", "modified_sequence", "collisionEnergy", "iRT", F.transform("k", lambda p: p["ion"]).alias("ions"), unit.alias("intensities"))


def scans_for(psms: DataFrame, spectra: DataFrame) -> DataFrame:
    """Spectra that any PSM refers to, by source and scan."""
    wanted = psms.select(without_suffix(F.col("source")).alias("source"), "scan").distinct()
    return spectra.join(wanted, ["source", "scan"], "left_semi")
