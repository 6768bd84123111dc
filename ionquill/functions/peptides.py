"""Expressions over peptide sequences and modification codes.

A modification code is ``N.body.C``: one digit for the N-terminus, one for each
residue and one for the C-terminus, 0 where there is none; null means that the
peptide has no modification at all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionquill.constants import C_TERMINUS, ION_OFFSET, MAX_CHARGE, N_TERMINUS, PREDICTOR_ALPHABET, PROTON, RESIDUE_MASS
from ionquill.functions.arrays import lookup, once, running_sum, total

Masses = dict[int, float]


def fold_il(sequence: Column) -> Column:
    """Isoleucine written as leucine: the two can't be told apart by mass."""
    return F.translate(sequence, "I", "L")


def residues(sequence: Column) -> Column:
    return F.filter(F.split(sequence, ""), lambda x: x != "")


def code_digits(code: Column, sequence: Column) -> Column:
    """Modification id of each residue, as strings."""
    body = F.coalesce(F.split_part(code, F.lit("."), F.lit(2)), F.repeat(F.lit("0"), F.length(sequence)))
    return F.filter(F.split(body, ""), lambda x: x != "")


def _digit_mass(masses: Masses, digit: Column) -> Column:
    return F.coalesce(lookup({str(k): v for k, v in masses.items()} or {"0": 0.0}, digit), F.lit(0.0))


def terminus_mass(code: Column, masses: Masses, which: str) -> Column:
    digit = F.coalesce(F.split_part(code, F.lit("."), F.lit(1 if which == "N" else 3)), F.lit("0"))
    return _digit_mass(masses, digit)


def residue_masses(sequence: Column, code: Column, masses: Masses) -> Column:
    return F.zip_with(residues(sequence), code_digits(code, sequence), lambda r, m: lookup(RESIDUE_MASS, r) + _digit_mass(masses, m))


def prefix_masses(sequence: Column, code: Column, masses: Masses, reverse: bool = False) -> Column:
    """Mass of the first 1, 2, ... n - 1 residues, or of the last ones, with the modification of that terminus."""
    each = residue_masses(sequence, code, masses)
    each = F.reverse(each) if reverse else each
    start = terminus_mass(code, masses, "C" if reverse else "N")
    sums = running_sum(F.slice(each, F.lit(1), F.greatest(F.length(sequence) - 1, F.lit(0))))
    return F.when(F.length(sequence) > 1, F.transform(sums, lambda x: x + start)).otherwise(F.array().cast("array<double>"))


def peptide_mass(sequence: Column, code: Column, masses: Masses) -> Column:
    """Neutral mass of the whole peptide."""
    ends = terminus_mass(code, masses, "N") + terminus_mass(code, masses, "C")
    return total(residue_masses(sequence, code, masses)) + ends + N_TERMINUS + C_TERMINUS


def ion_masses(sequence: Column, code: Column, masses: Masses, series: str) -> Column:
    """Neutral masses of the ions of a series: a, b or y."""
    return F.transform(prefix_masses(sequence, code, masses, series == "y"), lambda x: x + ION_OFFSET[series])


def mz(mass: Column, charge: Column | int, loss: float = 0.0) -> Column:
    charge = F.lit(charge) if isinstance(charge, int) else charge
    return (mass + charge * PROTON - loss) / charge


def ion_parts(name: Column) -> Column:
    """Struct of ``series``, ``position`` and ``charge`` of a name like ``y10^2``."""
    at = lambda k: F.regexp_extract(name, r"^([a-z])(\d+)(?:\^(\d+))?", k)
    return F.struct(at(1).alias("series"), at(2).try_cast("int").alias("position"), F.coalesce(at(3).try_cast("int"), F.lit(1)).alias("charge"))


def cleavage_site(name: Column, length: Column) -> Column:
    """Number of residues before the bond that an ion's break lies at."""
    return once(ion_parts(name), lambda p: F.when(p["series"] == "y", length - p["position"]).otherwise(p["position"]))


def coverage(names: Column, length: Column, series: str | None = None) -> Column:
    """Distinct cleavage sites of the ions, or of one series of them, over all bonds."""
    own = F.filter(names, lambda n: F.startswith(n, F.lit(series))) if series else names
    return F.size(F.array_distinct(F.transform(own, lambda n: cleavage_site(n, length)))) / (length - 1)


# Modified sequences


def predictor_sequence(sequence: Column, code: Column, oxidation: str = "2", mark: str = "(ox)") -> Column:
    """The sequence with ``mark`` after every residue whose modification is the oxidation."""
    marked = F.zip_with(residues(sequence), code_digits(code, sequence), lambda r, m: F.when(m == oxidation, F.concat(r, F.lit(mark))).otherwise(r))
    return F.array_join(marked, "")


def mass_tagged(sequence: Column, code: Column, masses: Masses) -> Column:
    """Mass tags to one decimal, as in ``AC[+57.0]DM[+16.0]``; the N-terminus's goes with the first residue's, the C-terminus's with the last's."""
    digits, n = code_digits(code, sequence), F.length(sequence)
    first, last = terminus_mass(code, masses, "N"), terminus_mass(code, masses, "C")
    ends = F.split_part(F.coalesce(code, F.lit("0.0.0")), F.lit("."), F.lit(1)), F.split_part(F.coalesce(code, F.lit("0.0.0")), F.lit("."), F.lit(3))
    added = F.transform(digits, lambda m, i: _digit_mass(masses, m) + F.when(i == 0, first).otherwise(0.0) + F.when(i == n - 1, last).otherwise(0.0))
    held = F.transform(digits, lambda m, i: (m != "0") | ((i == 0) & (ends[0] != "0")) | ((i == n - 1) & (ends[1] != "0")))
    tags = F.zip_with(added, held, lambda x, h: F.when(h, F.format_string("[%+.1f]", x)).otherwise(""))
    return F.array_join(F.zip_with(residues(sequence), tags, lambda r, t: F.concat(r, t)), "")


def code_from_tags(tagged: Column, masses: Masses, tolerance: float = 0.06) -> Column:
    """Modification code of a mass-tagged sequence, by the nearest mass within ``tolerance``; null without tags."""
    known = [(k, v) for k, v in masses.items() if k]
    tokens = F.regexp_extract_all(tagged, F.lit(r"[A-Z](?:\[[+-]?[0-9.]+\])?"), F.lit(0))

    def digit(token: Column) -> Column:
        value = F.regexp_extract(token, r"\[([+-]?[0-9.]+)\]", 1).try_cast("double")
        near = [F.when(F.abs(value - m) <= tolerance, F.struct(F.abs(value - m).alias("d"), F.lit(str(k)).alias("k"))) for k, m in known]
        best = F.array_min(F.filter(F.array(*near), lambda x: x.isNotNull())) if near else None
        return F.coalesce(best["k"], F.lit("0")) if near else F.lit("0")

    body = F.array_join(F.transform(tokens, digit), "")
    return F.when(F.contains(tagged, F.lit("[")), F.concat(F.lit("0."), body, F.lit(".0")))


def code_from_names(marked: Column, ids: dict[str, int]) -> Column:
    """Code of a sequence with marks in brackets, such as ``_(ac)M(ox)PEP_``; ``ids`` by the text in the brackets.

    A mark before the first residue belongs to the N-terminus. Null without marks.
    """
    text = F.regexp_replace(marked, "_", "")
    mark = r"\((?:[^()]|\([^()]*\))*\)"
    ident = lambda name: F.coalesce(lookup(ids, name, "int"), F.lit(0)).cast("string")
    inside = lambda x, skip: F.substring(x, F.lit(skip), F.length(x) - skip)
    start = F.regexp_extract(text, f"^{mark}", 0)
    tokens = F.regexp_extract_all(F.regexp_replace(text, f"^{mark}", ""), F.lit(f"[A-Z](?:{mark})?"), F.lit(0))
    body = F.array_join(F.transform(tokens, lambda t: F.when(F.length(t) > 1, ident(inside(t, 3))).otherwise("0")), "")
    first = F.when(start != "", ident(inside(start, 2))).otherwise("0")
    return F.when(F.contains(text, F.lit("(")), F.concat(first, F.lit("."), body, F.lit(".0")))


def with_fixed(sequence: Column, code: Column, targets: str, digit: int) -> Column:
    """The code with ``digit`` at every residue among ``targets``, or at the N-terminus for ``N-term``."""
    base = F.coalesce(code, F.concat(F.lit("0."), F.repeat(F.lit("0"), F.length(sequence)), F.lit(".0")))
    n, body, c = (F.split_part(base, F.lit("."), F.lit(k)) for k in (1, 2, 3))
    if targets == "N-term":
        return F.concat(F.lit(str(digit)), F.lit("."), body, F.lit("."), c)
    digits = F.zip_with(residues(sequence), F.filter(F.split(body, ""), lambda x: x != ""), lambda r, m: F.when(F.contains(F.lit(targets), r), str(digit)).otherwise(m))
    hit = sequence.rlike(f"[{targets}]")
    return F.when(hit, F.concat(n, F.lit("."), F.array_join(digits, ""), F.lit("."), c)).otherwise(code)


def named_modifications(code: Column, names: dict[int, str]) -> Column:
    """``position|name`` of every modification, joined by ``|``; position 0 is the N-terminus, -1 the C-terminus; ``-`` for none."""
    table = {str(k): v for k, v in names.items()}
    name = lambda d: lookup(table, d, "string")
    digits = F.filter(F.split(F.split_part(code, F.lit("."), F.lit(2)), ""), lambda x: x != "")
    inner = F.transform(digits, lambda d, i: F.concat((i + 1).cast("string"), F.lit("|"), name(d)))
    first = F.concat(F.lit("0|"), name(F.split_part(code, F.lit("."), F.lit(1))))
    last = F.concat(F.lit("-1|"), name(F.split_part(code, F.lit("."), F.lit(3))))
    held = F.filter(F.concat(F.array(first), inner, F.array(last)), lambda x: x.isNotNull())
    return F.when(F.size(held) > 0, F.array_join(held, "|")).otherwise("-")


def encoded(modified: Column, width: int = 30) -> Column:
    """Integers of the predictor's alphabet, padded with zeros to ``width``."""
    tokens = F.regexp_extract_all(modified, F.lit(r"M\(ox\)|[A-Z]"), F.lit(0))
    codes = F.transform(tokens, lambda t: lookup(PREDICTOR_ALPHABET, t, "int"))
    return F.slice(F.concat(codes, F.array_repeat(F.lit(0), width)), 1, width)


def charge_one_hot(charge: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(MAX_CHARGE)), lambda k: (k == charge).cast("int"))


def swapped(sequence: Column) -> Column:
    """All sequences with one pair of different neighbours exchanged, in order of position."""
    n = F.length(sequence)
    at = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & (F.substring(sequence, i, F.lit(1)) != F.substring(sequence, i + 1, F.lit(1))))
    swap = lambda i: F.concat(F.substring(sequence, F.lit(1), i - 1), F.substring(sequence, i + 1, F.lit(1)), F.substring(sequence, i, F.lit(1)), F.substring(sequence, i + 2, n))
    return F.transform(at, swap)


# Counts and filters


def n_variable(code: Column, ids: str) -> Column:
    """Characters of the code that are ids of variable modifications."""
    return F.when(code.isNull() | F.lit(not ids), 0).otherwise(F.regexp_count(code, F.lit(f"[{ids or 'x'}]")))


def n_repeated(sequence: Column) -> Column:
    """Residues that equal the one before them."""
    r = residues(sequence)
    pairs = F.zip_with(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), lambda a, b: a == b)
    return F.size(F.filter(pairs, lambda x: x))


def fraction_unique(sequence: Column) -> Column:
    return F.size(F.array_distinct(residues(sequence))) / F.length(sequence)


def fraction_cysteine(sequence: Column) -> Column:
    return F.regexp_count(sequence, F.lit("C")) / F.length(sequence)


def fraction_basic(sequence: Column) -> Column:
    """Lysines and arginines over the number of bonds."""
    return F.regexp_count(sequence, F.lit("[KR]")) / (F.length(sequence) - 1)


def predictable(sequence: Column, charge: Column) -> Column:
    """Whether the spectrum predictor takes a peptide: 5 to 30 residues, no selenocysteine, charge below 7."""
    fine = ~F.contains(sequence, F.lit("U")) & F.length(sequence).between(5, 30) & (charge < MAX_CHARGE + 1)
    return F.coalesce(fine, F.lit(False))


def has_digit(code: Column, ids: str) -> Column:
    """Whether a code holds one of the ids; null codes don't."""
    return F.coalesce(code.rlike(f"[{ids}]"), F.lit(False)) if ids else F.lit(False)


def psm_id(source: Column, scan: Column, modified: Column) -> Column:
    return F.concat_ws("_", source, scan.cast("string"), modified)


def split_psm_id(ident: Column) -> Column:
    """Struct of source, scan and modified sequence; counted from the right, since sources may hold underscores."""
    parts = F.split(ident, "_")
    n = F.size(parts)
    return F.struct(
        F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), "_").alias("source"),
        F.get(parts, n - 2).try_cast("long").alias("scan"),
        F.get(parts, n - 1).alias("modifiedSequence"),
    )


def without_suffix(source: Column) -> Column:
    return F.regexp_replace(source, r"\.(mzML|raw|mgf)$", "")
