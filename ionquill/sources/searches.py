"""Readers of search results. Each gives the canonical PSM columns.

``source``, ``scan``, ``peptide``, ``Label`` (1 target, -1 decoy), ``proteins``,
``ptm_seq``, ``sequenceLength``, ``missedCleavages``, ``charge``, ``massDiff``,
``retentionTime``, ``engineScore``, ``deltaScore``, ``fromChimera``,
``avgResidueMass``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionquill.constants import MODIFICATION_MASS, PROTON, RESIDUE_MASS, STANDARD_MODIFICATIONS
from ionquill.functions import peptides as P
from ionquill.functions.arrays import lookup, mean, total
from ionquill.operators.proteome import accession_group, decoy_label
from ionquill.operators.relational import second_best_gap, top_one, union_aligned

COLUMNS = {
    "source": "string", "scan": "long", "peptide": "string", "Label": "int", "proteins": "string", "ptm_seq": "string", "sequenceLength": "int",
    "missedCleavages": "int", "charge": "int", "massDiff": "double", "retentionTime": "double", "engineScore": "double", "deltaScore": "double",
    "fromChimera": "int", "avgResidueMass": "double",
}

# Ids of the modifications that engines name.
MODIFICATION_ID = {
    "Carbamidomethyl (C)": 1, "Carbamidomethylation": 1, "Oxidation (M)": 2, "Acetyl (Protein N-term)": 3, "Acetylation (N-term)": 3,
    "Acetyl (N-term)": 3, "Acetylation (Protein N-term)": 3, "Deamidation (NQ)": 4, "Deamidation (N)": 4, "Deamidation (Q)": 4,
    "Deamidated (N)": 4, "Deamidated (NQ)": 4, "Cysteinylation": 5, "Phospho (S)": 6, "Phospho (T)": 6, "Phospho (Y)": 6, "Phospho (STY)": 6,
}
# Ids by the text in brackets, of engines that write masses or short names there.
SHORT_NAMES = {"ox": 2, "ac": 3, "ph": 6, "de": 4, **MODIFICATION_ID}
MASS_MARKS = {"+57.02": 1, "+15.99": 2, "+42.01": 3, "+.98": 4, "+0.98": 4, "+119.00": 5, "+79.97": 6}


def canonical(df: DataFrame, **columns: Column) -> DataFrame:
    """The canonical columns, from ``columns`` or from ``df``; typed nulls where neither has one. Unpredictable peptides go."""
    held = set(df.columns)
    pick = lambda n: columns[n] if n in columns else F.col(f"`{n}`") if n in held else F.lit(None)
    out = df.select(*[pick(n).try_cast(t).alias(n) for n, t in COLUMNS.items()])
    return out.where(P.predictable(F.col("peptide"), F.col("charge")))


def _csv(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, quote='"', escape='"')


def _scan_number(column: Column) -> Column:
    return F.element_at(F.split(column, ":"), -1).try_cast("long")


def read_maxquant(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``msms.txt``: decoys are marked ``+`` in Reverse; several rows of a scan make it chimeric."""
    m = _csv(spark, path, "\t")
    reverse, n = F.coalesce(F.col("Reverse"), F.lit("")) == "+", F.col("Length").cast("int")
    m = m.withColumns({
        "scanNumber": F.col("Scan number").try_cast("long"),
        "rows": F.count("Sequence").over(Window.partitionBy("Raw file", "Scan number")),
    })
    return canonical(
        m, source=F.col("Raw file"), scan=F.col("scanNumber"), peptide=F.col("Sequence"), Label=F.when(reverse, -1).otherwise(1),
        proteins=F.when(reverse, "reverseSeq").otherwise(F.coalesce(F.nullif("Proteins", F.lit("")), F.lit("unknown"))),
        ptm_seq=P.code_from_names(F.col("Modified sequence"), SHORT_NAMES), sequenceLength=n, missedCleavages=F.col("Missed cleavages"), charge=F.col("Charge"),
        massDiff=F.col("`Simple mass error [ppm]`"), retentionTime=F.col("Retention time"), engineScore=F.col("Score"), deltaScore=F.col("Delta score"),
        fromChimera=(F.col("rows") > 1).cast("int"), avgResidueMass=F.col("Mass").cast("double") / n,
    )


def marked_peptide(text: Column) -> tuple[Column, Column]:
    """Bare sequence and code of a sequence with marks in brackets; a leading mark is the N-terminus's."""
    bare = F.regexp_replace(text, r"\((?:[^()]|\([^()]*\))*\)", "")
    return bare, P.code_from_names(text, MASS_MARKS | SHORT_NAMES)


def read_peaks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """PEAKS DB results of either column set; names of modifications come from the AScore column where it has them."""
    p = _csv(spark, path)
    p = p.withColumnsRenamed({k: v for k, v in {"z": "Z", "-10LgP": "-10lgP"}.items() if k in p.columns})
    bare, code = marked_peptide(F.col("Peptide"))
    n, accession = F.length(bare), F.coalesce("Accession", F.lit("unknown"))
    chimera = F.when(F.col("from Chimera") == "Yes", 1).otherwise(0) if "from Chimera" in p.columns else F.lit(0)
    return canonical(
        p, source=P.without_suffix(F.col("Source File")), scan=_scan_number(F.col("Scan")), peptide=bare, Label=F.when(accession.rlike("DECOY|rev"), -1).otherwise(1),
        proteins=accession, ptm_seq=code, sequenceLength=n, missedCleavages=F.lit(0), charge=F.col("Z"), massDiff=F.col("ppm"), retentionTime=F.col("RT"),
        engineScore=F.col("`-10lgP`"), deltaScore=F.lit(0.0), fromChimera=chimera, avgResidueMass=F.col("Mass").cast("double") / n,
    )


def read_peaks_de_novo(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """PEAKS de novo results: the score is the mean of the residues' confidences, the delta score their least."""
    p = _csv(spark, path)
    bare, code = marked_peptide(F.col("Peptide"))
    z, mass = F.col("z").cast("int"), F.col("Mass").cast("double")
    local = F.transform(F.split(F.col("`local confidence (%)`"), " +"), lambda x: x.cast("double"))
    return canonical(
        p, source=P.without_suffix(F.col("Source File")), scan=_scan_number(F.col("Scan")), peptide=bare, Label=F.lit(1), proteins=F.lit("deNovo"), ptm_seq=code,
        sequenceLength=F.length(bare), missedCleavages=F.lit(0), charge=z, massDiff=F.col("`m/z`").cast("double") * z - (mass + z * PROTON), retentionTime=F.col("RT"),
        engineScore=mean(local), deltaScore=F.array_min(local), fromChimera=F.lit(0), avgResidueMass=mass / F.length(bare),
    )


def read_psms(spark: SparkSession, path: str | list[str], masses: dict[int, float] = STANDARD_MODIFICATIONS) -> DataFrame:
    """A plain PSM table: source, scan, peptide, modifiedSequence, charge, and whichever other columns it has."""
    p = _csv(spark, path)
    held = lambda n, default: F.col(n) if n in p.columns else F.lit(default)
    return canonical(
        p, Label=held("Label", 1), proteins=held("proteins", "unknown"), engineScore=held("Score", 0.0), deltaScore=held("deltaScore", 0.0), massDiff=held("massDiff", 0.0),
        missedCleavages=held("missedCleavages", 0), fromChimera=held("fromChimera", 0), sequenceLength=F.length("peptide"), ptm_seq=P.code_from_tags(F.col("modifiedSequence"), masses),
    )


def read_ssl(spark: SparkSession, path: str | list[str], masses: dict[int, float] = STANDARD_MODIFICATIONS) -> DataFrame:
    """Skyline's SSL: tab-separated file, scan, charge, sequence."""
    s = _csv(spark, path, "\t")
    bare = F.regexp_replace("sequence", "[^A-Z]", "")
    return canonical(s, source=P.without_suffix(F.col("file")), peptide=bare, ptm_seq=P.code_from_tags(F.col("sequence"), masses), Label=F.lit(1), proteins=F.lit("unknown"), sequenceLength=F.length(bare), engineScore=F.lit(0.0), deltaScore=F.lit(0.0))


def read_pepxml(spark: SparkSession, path: str | list[str], masses: dict[int, float] | None = None, decoy: str = "rev_") -> DataFrame:
    """pepXML spectrum queries: a row for each distinct peptide of a spectrum; delta is the score less the second best.

    Modification masses in brackets are whole residue masses, ``n[...]`` that of
    the N-terminus.
    """
    masses = masses or STANDARD_MODIFICATIONS
    tags = spark.read.option("lineSep", "</spectrum_query>").text(path).select("value").where(F.contains("value", F.lit("<spectrum_query")))
    query = F.regexp_extract("value", r"(?s)(<spectrum_query\b.*)$", 1)
    hits = F.regexp_extract_all(query, F.lit(r"(?s)(<search_hit\b.*?</search_hit>)"), F.lit(1))
    attribute = lambda x, n: F.nullif(F.regexp_extract(x, rf'\b{n}="([^"]*)"', 1), F.lit(""))
    head = F.regexp_extract(query, r"(?s)(<spectrum_query\b[^>]*>)", 1)
    rows = tags.select(
        attribute(head, "spectrum").alias("spectrum"), attribute(head, "assumed_charge").cast("int").alias("charge"),
        attribute(head, "retention_time_sec").try_cast("double").alias("retentionTime"), F.explode(hits).alias("h"),
    )
    h = F.col("h")
    score = F.regexp_extract(h, r'<search_score\s+name="hyperscore"\s+value="([^"]*)"', 1).try_cast("double")
    marked = F.coalesce(attribute(h, "modified_peptide"), attribute(h, "peptide"))
    parts = F.split("spectrum", r"\.")
    others = F.regexp_extract_all(h, F.lit(r'\bprotein="([^"]*)"'), F.lit(1))
    rows = rows.select(
        F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 3), ".").alias("source"), F.get(parts, F.size(parts) - 2).try_cast("long").alias("scan"), "charge", "retentionTime",
        attribute(h, "peptide").alias("peptide"), marked.alias("marked"), F.array_join(others, ";").alias("proteins"), attribute(h, "massdiff").try_cast("double").alias("massDiff"),
        attribute(h, "calc_neutral_pep_mass").try_cast("double").alias("mass"), attribute(h, "num_missed_cleavages").try_cast("int").alias("missedCleavages"), score.alias("engineScore"),
    )
    one = top_one(rows, ["source", "scan", "peptide"], F.desc("engineScore"), F.asc("marked"))
    gap = second_best_gap(one, ["source", "scan"], "engineScore", "deltaScore")
    several = F.count(F.lit(1)).over(Window.partitionBy("source", "scan")) > 1
    gap = gap.withColumn("chimera", several.cast("int"))
    return canonical(
        gap, Label=decoy_label(F.col("proteins"), decoy), ptm_seq=code_from_residue_masses(F.col("marked"), masses), sequenceLength=F.length("peptide"),
        fromChimera=F.col("chimera"), avgResidueMass=F.col("mass") / F.length("peptide"),
    )


def code_from_residue_masses(marked: Column, masses: dict[int, float], tolerance: float = 1.01) -> Column:
    """Code of a sequence whose marks are masses of whole modified residues, such as ``n[43]PEPM[147]``."""
    start = F.regexp_extract(marked, r"^n\[([0-9.]+)\]", 1).try_cast("double") - 1.007825
    tokens = F.regexp_extract_all(F.regexp_replace(marked, r"^n\[[0-9.]+\]", ""), F.lit(r"[A-Z](?:\[[0-9.]+\])?"), F.lit(0))

    def nearest_id(added: Column) -> Column:
        near = [F.struct(F.abs(added - m).alias("d"), F.lit(str(k)).alias("k")) for k, m in masses.items() if k]
        return F.coalesce(F.array_min(F.filter(F.array(*near), lambda x: x["d"] <= tolerance))["k"], F.lit("0"))

    added = lambda t: F.regexp_extract(t, r"\[([0-9.]+)\]", 1).try_cast("double") - lookup(RESIDUE_MASS, F.substring(t, F.lit(1), F.lit(1)))
    body = F.array_join(F.transform(tokens, lambda t: F.when(F.contains(t, F.lit("[")), nearest_id(added(t))).otherwise("0")), "")
    return F.when(F.contains(marked, F.lit("[")), F.concat(F.coalesce(F.when(start.isNotNull(), nearest_id(start)), F.lit("0")), F.lit("."), body, F.lit(".0")))


def read_mztab(spark: SparkSession, path: str | list[str], spectra: DataFrame | None = None) -> DataFrame:
    """De novo mzTab: PSM lines by their header; spectra are joined by their place in the file.

    ``spectra`` has ``source``, ``index`` (from 0), ``scan``, ``charge``,
    ``retentionTime``; without it the index stands for the scan.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"))
    heads = lines.where(F.startswith("value", F.lit("PSH\t"))).select("f", F.split("value", "\t").alias("names"))
    run_file = F.regexp_extract("value", r"^MTD\tms_run\[1\]-location\t.*?([^/\\]+)\.[^.]+$", 1)
    runs = lines.where(F.contains("value", F.lit("ms_run[1]-location"))).select("f", run_file.alias("source"))
    cells = lines.where(F.startswith("value", F.lit("PSM\t"))).select("f", F.split("value", "\t").alias("cells"))
    rows = cells.join(heads, "f").join(runs, "f").withColumn("m", F.map_from_arrays("names", "cells"))
    at = lambda n: F.try_element_at("m", F.lit(n))
    aa = F.transform(F.split(at("opt_ms_run[1]_aa_scores"), ","), lambda x: x.try_cast("double"))
    rows = rows.select(
        "source", F.regexp_extract(at("spectra_ref"), r"index=(\d+)", 1).try_cast("long").alias("index"), at("sequence").alias("sequence"), at("search_engine_score[1]").try_cast("double").alias("engineScore"),
        (at("exp_mass_to_charge").try_cast("double") - at("calc_mass_to_charge").try_cast("double")).alias("massDiff"), F.array_min(aa).alias("deltaScore"), at("charge").try_cast("double").cast("int").alias("charge"),
    )
    if spectra is not None:
        rows = rows.drop("charge").join(spectra.select("source", "index", "scan", "charge", "retentionTime"), ["source", "index"])
    else:
        rows = rows.withColumn("scan", F.col("index"))
    bare = P.fold_il(F.regexp_replace("sequence", "[^A-Za-z]", ""))
    # signed masses follow their residue; before the first they belong to the N-terminus
    tokens = F.regexp_extract_all(F.col("sequence"), F.lit(r"[A-Z]?(?:[+-][0-9.]+)*"), F.lit(0))
    digit = lambda t: F.coalesce(lookup({f"{m:+.3f}": k for k, m in STANDARD_MODIFICATIONS.items() if k}, F.regexp_extract(t, r"([+-][0-9.]+)", 1), "int"), F.lit(0)).cast("string")
    own = F.filter(tokens, lambda t: t != "")
    body = F.array_join(F.transform(F.filter(own, lambda t: t.rlike("^[A-Z]")), digit), "")
    first = F.coalesce(F.get(F.transform(F.filter(own, lambda t: ~t.rlike("^[A-Z]")), digit), F.lit(0)), F.lit("0"))
    code = F.when(F.col("sequence").rlike("[+-]"), F.concat(first, F.lit("."), body, F.lit(".0")))
    mass = total(P.residue_masses(bare, code, STANDARD_MODIFICATIONS)) / F.length(bare)
    return canonical(rows, peptide=bare, Label=F.lit(1), proteins=F.lit("deNovo"), ptm_seq=code, sequenceLength=F.length(bare), missedCleavages=F.lit(0), fromChimera=F.lit(0), avgResidueMass=mass)


def scan_title(title: Column, style: str | None = None, sources: list[str] | None = None, source: str | None = None) -> dict[str, Column]:
    """Source, scan and retention time that a scan title holds, in the default, ``mascotDistiller`` or ``distiller`` style."""
    none = F.lit(None)
    if style is None:
        scan = F.regexp_extract(title, r"=~?(\d+)~?$", 1).try_cast("long")
        named = F.regexp_extract(title, r"File:~?\"?([^~,\"]*)", 1)
        return {"scan": scan, "source": F.regexp_replace(F.lit(source) if source else named, r"\.(raw|mgf)$", ""), "retentionTime": none.cast("double")}
    rt = F.regexp_extract(title, r"\(rt=([0-9.]+)\)", 1).try_cast("double")
    scan = F.regexp_extract(title, r" Scan (\d+)", 1).try_cast("long")
    if style == "mascotDistiller":
        number = F.regexp_extract(title, r" from file \[(\d+)\]", 1).try_cast("int")
        return {"scan": scan, "source": F.get(F.array(*map(F.lit, sources or [])), number), "retentionTime": rt}
    if style == "distiller":
        return {"scan": scan, "source": F.lit(source), "retentionTime": rt}
    raise ValueError(f"unknown scan title style {style!r}")


def read_mascot(spark: SparkSession, path: str | list[str], style: str | None = None, sources: list[str] | None = None, source: str | None = None, reduce: bool = False) -> DataFrame:
    """Mascot's sectioned CSV: the hits table is what follows the ``prot_hit_num`` header, up to the ``Queries`` section.

    Modification positions are digits as they come. ``reduce`` keeps the best
    hit of each scan.
    """
    files = spark.read.text(path, wholetext=True).select("value")
    section = F.regexp_extract("value", r"(?s)(prot_hit_num.*?)(?:\r?\n\"?Queries|\z)", 1)
    lines = files.select(F.split(section, r"\r?\n").alias("l"))
    # the header goes into each line's struct, so that no row carries the whole file along
    each = F.transform(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))), lambda x: F.struct(F.get("l", F.lit(0)).alias("head"), x.alias("line")))
    rows = lines.select(F.explode(each).alias("r")).select("r.head", "r.line").where(F.col("line") != "")
    cell = r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'
    cells = lambda c: F.transform(F.regexp_extract_all(c, F.lit(cell), F.lit(1)), lambda x: F.replace(F.regexp_replace(x, r'^"|"$', ""), F.lit('""'), F.lit('"')))
    n = F.least(F.size(cells(F.col("head"))), F.size(cells(F.col("line"))))
    named = rows.select(F.map_from_entries(F.filter(F.arrays_zip(F.slice(cells(F.col("head")), F.lit(1), n).alias("k"), F.slice(cells(F.col("line")), F.lit(1), n).alias("v")), lambda x: x["k"] != "")).alias("m"))
    at = lambda k: F.nullif(F.try_element_at("m", F.lit(k)), F.lit(""))
    title = scan_title(at("pep_scan_title"), style, sources, source)
    mass, sequence = at("pep_exp_mr").try_cast("double"), at("pep_seq")
    decoy = F.coalesce(at("prot_desc").rlike("Reversed|[Rr]andom"), F.lit(False))
    out = canonical(
        named.where(at("pep_seq").isNotNull()), **title, peptide=sequence, Label=F.when(decoy, -1).otherwise(1), proteins=at("prot_acc"), ptm_seq=at("pep_var_mod_pos"), sequenceLength=F.length(sequence),
        missedCleavages=at("pep_miss"), charge=F.regexp_extract(at("pep_exp_z"), r"(\d+)", 1), massDiff=mass - at("pep_calc_mr").try_cast("double"), engineScore=at("pep_score"), deltaScore=F.lit(0.0), fromChimera=F.lit(0), avgResidueMass=mass / F.length(sequence),
    )
    return top_one(out, ["source", "scan"], F.desc("engineScore"), F.desc("Label"), F.asc("peptide"), F.asc("proteins")) if reduce else out


def modification_table(spark: SparkSession, names: DataFrame, column: str = "name") -> DataFrame:
    """Distinct modification names with their ids and masses; unknown names get id 9 and mass 0."""
    n = names.select(F.trim(column).alias("Name")).where((F.col("Name") != "") & (F.col("Name") != "Unmodified")).distinct()
    return n.select("Name", F.coalesce(lookup(MODIFICATION_ID, F.col("Name"), "int"), F.lit(9)).alias("Identifier"), F.coalesce(lookup(MODIFICATION_MASS, F.col("Name")), F.lit(0.0)).alias("Delta"), F.lit(True).alias("isVar"))


#: Reader of each search engine.
READERS: dict[str, Callable[..., DataFrame]] = {
    "maxquant": read_maxquant, "mascot": read_mascot, "peaks": read_peaks, "peaksDeNovo": read_peaks_de_novo, "msfragger": read_pepxml,
    "casanovo": read_mztab, "psms": read_psms, "ssl": read_ssl,
}
SEPARATORS = {"maxquant": ";", "peaks": ":", "mascot": ";"}


def read_search(spark: SparkSession, engine: str, path: str | list[str], hierarchy: list[str] | None = None, fixed: dict[str, int] | None = None, extra: DataFrame | None = None, **options) -> DataFrame:
    """PSMs of any engine: I written as L once for each PSM, accession groups, fixed modifications, extra rows.

    ``fixed`` gives residues (or ``N-term``) the id of a fixed modification.
    """
    if engine not in READERS:
        raise ValueError(f"unknown search engine {engine!r}; known: {', '.join(READERS)}")
    out = READERS[engine](spark, path, **options).withColumn("peptide", P.fold_il(F.col("peptide")))
    out = top_one(out, ["source", "scan", "peptide", "ptm_seq"], F.desc("engineScore"), F.desc("Label"), F.asc("proteins"))
    for targets, digit in (fixed or {}).items():
        out = out.withColumn("ptm_seq", P.with_fixed(F.col("peptide"), F.col("ptm_seq"), targets, digit))
    if extra is not None:
        out = union_aligned(out, extra)
    if hierarchy:
        out = out.withColumn("accessionGroup", accession_group(F.col("proteins"), hierarchy, SEPARATORS.get(engine, ";")))
    return out
