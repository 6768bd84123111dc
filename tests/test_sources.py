import base64
import struct
import zlib

import pytest

from ionquill.sources import searches as S
from ionquill.sources import spectra as X
from ionquill.sources import tables as T


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    return write


MGF = """# made up
BEGIN IONS
TITLE=file.77.77.2 File:"other.raw", scan=77
PEPMASS=441.2 1000.5
CHARGE=2+
RTINSECONDS=12.5
100.1 5
200.25\t7.5 1+
END IONS

BEGIN IONS
TITLE=whatever
SCANS=78
PEPMASS=500.0
50.5 1e3
END IONS
BEGIN IONS
TITLE=again
SCANS=78
PEPMASS=500.0
END IONS
"""


def test_mgf(spark, put):
    rows = {r["scan"]: r for r in X.read_mgf(spark, put("run1.mgf", MGF)).collect()}
    assert set(rows) == {77, 78}
    r = rows[77]
    assert (r["source"], r["mzs"], r["intensities"], r["charge"], r["retentionTime"], r["ms1Intensity"]) == ("run1", [100.1, 200.25], [5.0, 7.5], 2, 12.5, 1000.5)
    assert (rows[78]["mzs"], rows[78]["charge"], rows[78]["ms1Intensity"]) == ([50.5], None, -1.0)
    assert X.read_mgf(spark, put("run2.mgf", MGF), combined=True).where("scan = 77").first()["source"] == "other"
    titled = "BEGIN IONS\nTITLE=1: Scan 9 (rt=3.5) from file [1]\n10 1\nEND IONS\n"
    assert tuple(X.read_mgf(spark, put("d.mgf", titled), "mascotDistiller", ["a", "b"]).select("source", "scan").first()) == ("b", 9)
    wanted = spark.createDataFrame([("run1.raw", 77)], "source string, scan long")
    assert X.scans_for(wanted, X.read_mgf(spark, put("run1.mgf", MGF))).count() == 1


def test_mzml(spark, put):
    def array(values, code, kind, packed):
        raw = struct.pack(f"<{len(values)}{code}", *values)
        text = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
        return f'<binaryDataArray><cvParam accession="{"MS:1000523" if code == "d" else "MS:1000521"}"/><cvParam accession="{"MS:1000574" if packed else "MS:1000576"}"/><cvParam accession="{kind}"/><binary>{text}</binary></binaryDataArray>'

    def spectrum(scan, level, extra=""):
        return f'<spectrum index="0" id="controllerType=0 scan={scan}"><cvParam accession="MS:1000511" name="ms level" value="{level}"/><scan><cvParam accession="MS:1000016" value="2.5" unitName="minute"/></scan>{extra}<binaryDataArrayList>{array([100.5, 200.25], "d", "MS:1000514", True)}{array([1.5, 2.5], "f", "MS:1000515", False)}</binaryDataArrayList></spectrum>'

    ion = '<precursor spectrumRef="x scan=1"><selectedIon><cvParam accession="MS:1000744" value="100.5"/><cvParam accession="MS:1000041" value="3"/><cvParam accession="MS:1000042" value="900"/></selectedIon></precursor>'
    path = put("run.mzML", f'<?xml version="1.0"?><mzML><run><spectrumList count="2">{spectrum(1, 1)}\n{spectrum(2, 2, ion)}</spectrumList></run></mzML>')
    (r,) = X.read_mzml(spark, path).collect()
    assert (r["source"], r["scan"], r["charge"], r["retentionTime"], r["ms1Intensity"], r["precursor"], r["precursorScan"]) == ("run", 2, 3, 150.0, 900.0, 100.5, 1)
    assert (r["mzs"], r["intensities"]) == ([100.5, 200.25], [1.5, 2.5])
    every = X.read_mzml(spark, path, None)
    assert every.count() == 2
    moved = X.spread_retention_times(every.where("msLevel = 2").withColumn("retentionTime", X.F.lit(120.0)), every.where("msLevel = 1")).first()
    assert moved["retentionTime"] == 150.0


def test_msp(spark, put):
    text = (
        "Name: AMK/2\nMW: 0.0\nComment: Parent=0.0 Collision_energy=33.0 Mods=1/2,M,Oxidation ModString=AMK//Oxidation@M3/2 iRT=-7.5\nNum peaks: 3\n0.0\t3.0\t\"y1/0.0ppm\"\n0.0\t4.0\t\"b2^2)/0.0ppm\"\n0.0\t0.0\t\"b1/0.0ppm\"\n"
        "Name: PEPMK/3\nMW: 1.0\nComment: Mods=1/3,M,Oxidation Parent=1.0 MS2PIP_ID=\"peptide_0\"\nNum peaks: 1\n72.04\t18\t\"b1\"\n"
    )
    a, b = sorted(X.read_msp(spark, put("p.msp", text)).collect(), key=lambda r: r["peptide"])
    assert (a["modified_sequence"], a["charge"], a["collisionEnergy"], a["iRT"], a["ions"]) == ("AM(ox)K", 2, 33.0, -7.5, ["y1", "b2^2"])
    assert a["intensities"] == pytest.approx([0.6, 0.8])
    assert (b["modified_sequence"], b["charge"], b["ions"], b["intensities"], b["iRT"]) == ("PEPM(ox)K", 3, ["b1"], [1.0], None)


def test_maxquant(spark, put):
    head = "Raw file\tScan number\tSequence\tModified sequence\tModifications\tProteins\tCharge\tReverse\tDelta score\tLength\tMass\tMissed cleavages\tSimple mass error [ppm]\tScore\tRetention time\n"
    rows = "f\t5\tMPEPTIDE\t_(ac)M(ox)PEPTIDE_\tx\tP1\t2\t\t3.5\t8\t900\t0\t1.5\t80\t20.5\nf\t5\tACDEFGHI\t_ACDEFGHI_\tUnmodified\t\t2\t+\t1\t8\t800\t1\t-1\t10\t21\nf\t6\tACDU\t_ACDU_\tx\t\t2\t\t1\t4\t1\t0\t0\t1\t1\n"
    got = S.read_maxquant(spark, put("msms.txt", head + rows)).orderBy("Label").collect()
    assert [(r["peptide"], r["Label"], r["proteins"], r["ptm_seq"], r["fromChimera"], r["avgResidueMass"]) for r in got] == [
        ("ACDEFGHI", -1, "reverseSeq", None, 1, 100.0), ("MPEPTIDE", 1, "P1", "3.20000000.0", 1, 112.5)]
    assert got[1].asDict().keys() == S.COLUMNS.keys()


def test_peaks(spark, put):
    ten = 'Accession,AScore,Z,from Chimera,Length,Mass,m/z,Peptide,ppm,PTM,RT,Scan,-10lgP,Source File\nP1,,2,Yes,6,600,301,M(+15.99)PEPTK,1.5,Oxidation (M),10,F1:77,55.5,a.raw\n#DECOY#P2,,3,No,5,500,200,ACDEF,0,,11,12,20,b.mgf\n'
    got = S.read_peaks(spark, put("ten.csv", ten)).orderBy("scan").collect()
    assert [(r["source"], r["scan"], r["Label"], r["ptm_seq"], r["fromChimera"], r["engineScore"]) for r in got] == [("b", 12, -1, None, 0, 20.0), ("a", 77, 1, "0.200000.0", 1, 55.5)]
    eleven = ten.replace(",Z,from Chimera,", ",z,").replace("-10lgP", "-10LgP").replace(",2,Yes,", ",2,").replace(",3,No,", ",3,")
    assert [r["engineScore"] for r in S.read_peaks(spark, put("eleven.csv", eleven)).orderBy("scan").collect()] == [20.0, 55.5]
    novo = "z,local confidence (%),Mass,m/z,Peptide,RT,Scan,Denovo score,Source File\n2,90 80 70 60 50,500,251.0,AC(+57.02)DEF,3,F2:9,70,c.raw\n"
    r = S.read_peaks_de_novo(spark, put("novo.csv", novo)).first()
    assert (r["engineScore"], r["deltaScore"], r["ptm_seq"], r["proteins"]) == (70.0, 50.0, "0.01000.0", "deNovo")
    assert r["massDiff"] == pytest.approx(251.0 * 2 - (500 + 2 * 1.007276466622))


def test_pepxml(spark, put):
    def hit(pep, mod, protein, score, rank):
        m = f'<modification_info modified_peptide="{mod}"/>' if mod else ""
        return f'<search_hit peptide="{pep}" massdiff="0.01" calc_neutral_pep_mass="800" num_missed_cleavages="1" protein="{protein}" hit_rank="{rank}">{m}<search_score name="hyperscore" value="{score}"/></search_hit>'

    query = lambda name, hits: f'<spectrum_query start_scan="7" assumed_charge="2" spectrum="{name}" retention_time_sec="33.5"><search_result>{hits}</search_result></spectrum_query>'
    text = "<msms_pipeline_analysis>" + query("my.file.00007.00007.2", hit("MPEPTIDE", "n[43]M[147]PEPTIDE", "P1", 30, 1) + hit("MPEPTIDE", "", "P1", 20, 2) + hit("ACDEFGH", "", "rev_P2", 12, 3)) + query("my.file.00008.00008.3", hit("ACDEFGK", "", "P3", 9, 1)) + "</msms_pipeline_analysis>"
    got = S.read_pepxml(spark, put("a.pepXML", text)).orderBy("scan", "Label").collect()
    assert [(r["source"], r["scan"], r["peptide"], r["Label"], r["deltaScore"], r["ptm_seq"], r["fromChimera"]) for r in got] == [
        ("my.file", 7, "ACDEFGH", -1, 0.0, None, 1), ("my.file", 7, "MPEPTIDE", 1, 18.0, "3.20000000.0", 1), ("my.file", 8, "ACDEFGK", 1, 9.0, None, 0)]


def test_mztab_psms_ssl(spark, put):
    text = "MTD\tms_run[1]-location\tfile:///x/run9.mgf\nMTD\tother\tx\nPSH\tsequence\tsearch_engine_score[1]\tcharge\texp_mass_to_charge\tcalc_mass_to_charge\topt_ms_run[1]_aa_scores\tspectra_ref\nPSM\t+42.011AM+15.995IK\t0.9\t2.0\t300.5\t300.25\t0.9,0.5,0.8,0.7\tms_run[1]:index=4\nPSM\tPEPTIK\t0.8\t2.0\t300.5\t300.25\t0.9,0.5,0.8\tms_run[1]:index=5\n"
    path = put("c.mztab", text)
    r = {x["peptide"]: x for x in S.read_mztab(spark, path).collect()}
    assert r["PEPTLK"]["scan"] == 5 and r["PEPTLK"]["source"] == "run9" and r["PEPTLK"]["deltaScore"] == 0.5 and r["PEPTLK"]["ptm_seq"] is None
    spectra = spark.createDataFrame([("run9", 5, 1005, 3, 12.0)], "source string, index long, scan long, charge int, retentionTime double")
    assert tuple(S.read_mztab(spark, path, spectra).select("scan", "charge", "retentionTime").first()) == (1005, 3, 12.0)
    r = S.read_psms(spark, put("p.csv", "source,scan,peptide,modifiedSequence,charge,Score\na,1,ACDMK,AC[+57.0]DM[+16.0]K,2,5.5\n")).first()
    assert (r["ptm_seq"], r["engineScore"], r["Label"], r["proteins"]) == ("0.01020.0", 5.5, 1, "unknown")
    r = S.read_ssl(spark, put("s.ssl", "file\tscan\tcharge\tsequence\tmodifications\na.mzML\t3\t2\tAC[+57.0]DEK\tx\n")).first()
    assert (r["source"], r["scan"], r["peptide"], r["ptm_seq"]) == ("a", 3, "ACDEK", "0.01000.0")


def test_mascot(spark, put):
    text = 'Header\n"x",1\n\nVariable modifications\nIdentifier,Name,Delta\n\nprot_hit_num,prot_acc,prot_desc,pep_query,pep_exp_z,pep_exp_mr,pep_calc_mr,pep_miss,pep_score,pep_seq,pep_var_mod_pos,pep_scan_title\n1,P1,"a, ""quoted"" one",5,2,800.5,800.25,0,40,ACDEFK,0.000000.0,"File:""run1.raw"", scan=12"\n2,P2,Reversed x,6,2,801,800,1,20,GHIKLK,,"File:""run1.raw"", scan=12"\nQueries\nquery_number,StringTitle\n5,x\n'
    got = S.read_mascot(spark, put("m.csv", text)).orderBy("Label").collect()
    assert [(r["source"], r["scan"], r["peptide"], r["Label"], r["massDiff"], r["ptm_seq"]) for r in got] == [("run1", 12, "GHIKLK", -1, 1.0, None), ("run1", 12, "ACDEFK", 1, 0.25, "0.000000.0")]
    assert [r["peptide"] for r in S.read_mascot(spark, put("m.csv", text), reduce=True).collect()] == ["ACDEFK"]
    one = spark.createDataFrame([("4: Scan 99 (rt=5.5) from file [0]",)], "t string")
    styles = {s: tuple(one.select(*[c.alias(n) for n, c in S.scan_title(S.F.col("t"), s, ["q"], "z").items()]).select("source", "scan", "retentionTime").first()) for s in ("mascotDistiller", "distiller")}
    assert styles == {"mascotDistiller": ("q", 99, 5.5), "distiller": ("z", 99, 5.5)}


def test_dispatcher(spark, put):
    path = put("p.csv", "source,scan,peptide,modifiedSequence,charge,proteins\na,1,ACDIK,ACDIK,2,host_1;path_2\na,2,AADIK,AADIK,2,deNovo\n")
    extra = spark.createDataFrame([("b", "7", "GGGGG", 9.0)], "source string, scan string, peptide string, more double")
    got = S.read_search(spark, "psms", path, ["path", "host"], {"C": 1}, extra).orderBy("source", "scan").collect()
    assert [(r["peptide"], r["ptm_seq"], r["accessionGroup"]) for r in got] == [("ACDLK", "0.01000.0", 0), ("AADLK", None, 2), ("GGGGG", None, None)]
    with pytest.raises(ValueError, match="unknown search engine"):
        S.read_search(spark, "nobody", path)
    names = spark.createDataFrame([("Oxidation (M)",), ("Odd",), ("Unmodified",)], "name string")
    assert {(r["Name"], r["Identifier"], r["Delta"]) for r in S.modification_table(spark, names).collect()} == {("Oxidation (M)", 2, 15.994915), ("Odd", 9, 0.0)}


def test_side_tables(spark, put):
    got = T.read_fasta(spark, put("p.fasta", ">sp|P1|A some protein\nACDI\nEFG*\n\n>P2\nKKK\n")).orderBy("name").collect()
    assert [(r["name"], r["description"], r["sequence"]) for r in got] == [("P2", "P2", "KKK"), ("sp|P1|A", "sp|P1|A some protein", "ACDLEFG")]
    line = " 1 {} {} {} 0 0 0 0 0 {} PEPLIST 0.5 {} 0.4 {} {}\n"
    text = "# head\n-----\n Pos MHC Peptide\n-----\n" + line.format("HLA-A", "ACDEF", "ACDEF", "ACDEF", 1.0, 0.4, 20.5) + line.format("HLA-B", "ACDEF", "ACDEF", "ACDEF", 1.0, 1.5, 300) + "-----\nProtein x\n"
    b = T.read_binding(spark, put("b.txt", text))
    assert [(r["MHC"], r["BindLevel"], r["Aff(nM)"]) for r in b.orderBy("MHC").collect()] == [("HLA-A", "<=SB", 20.5), ("HLA-B", "<=WB", 300.0)]
    assert tuple(T.best_binding(b).first()) == ("ACDEF", "HLA-A", 0.4, 20.5, "<=SB")
    assert tuple(T.binding_per_allele(b, ["HLA-A", "HLA-B"]).first()) == ("ACDEF", 20.5, 300.0)
    paths = {a: put(f"{a}.csv", f"peptide,ic50\nAAA,{x}\n" + ("BBB,1\n" if a == "x" else "")) for a, x in (("x", 5), ("y", 3))}
    assert [tuple(r) for r in T.read_ic50(spark, paths).collect()] == [("AAA", 3.0)]
    sky = T.read_skyline(spark, put("s.csv", "PeptideSequence,PrecursorCharge,FileName,IsotopeDotProduct,TotalAreaMs1,TotalBackgroundMs1\nAAA,2,f.raw,#N/A,10,2\n")).first()
    assert (sky["IsotopeDotProduct"], sky["TotalAreaMs1"]) == (None, 10.0)
    r = T.read_rescored(spark, put("t.psms", "PSMId\tscore\tq-value\tposterior_error_prob\tpeptide\tproteinIds\na_1_K\t1.5\t0.01\t0.02\t-.ACDK.-\tP1\n")).first()
    assert tuple(r) == ("a_1_K", 1.5, 0.01, 0.02, "ACDK", "P1")
    assert T.read_distiller_log(spark, put("d.log", 'opened C:\\x\\a.raw\nopened "b.raw"\nC:\\x\\a.raw done\n')) == ["a", "b"]
    w = T.read_weights(spark, put("w.tsv", "# notes\nf1\tf2\n0.1\t0.2\n1\t2\nf1\tf2\n0.3\t0.4\n3\t4\n"), 2)
    assert sorted(map(tuple, w.collect())) == [(0, "f1", 0.1), (0, "f2", 0.2), (1, "f1", 0.3), (1, "f2", 0.4)]
