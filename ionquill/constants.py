"""Masses, property scales and limits of the peptide model."""

from __future__ import annotations

# Monoisotopic masses in dalton.
PROTON = 1.007276466622
HYDROGEN = 1.007825035
CARBON = 12.0
OXYGEN = 15.99491463
NITROGEN = 14.003074

N_TERMINUS = HYDROGEN
C_TERMINUS = OXYGEN + HYDROGEN
WATER = 2 * HYDROGEN + OXYGEN
AMMONIA = NITROGEN + 3 * HYDROGEN

RESIDUE_MASS = {
    "A": 71.037114, "R": 156.101111, "N": 114.042927, "D": 115.026943, "C": 103.009185, "E": 129.042593, "Q": 128.058578, "G": 57.021464,
    "H": 137.058912, "I": 113.084064, "L": 113.084064, "K": 128.094963, "M": 131.040485, "F": 147.068414, "P": 97.052764, "S": 87.032028,
    "T": 101.047679, "W": 186.079313, "Y": 163.06332, "V": 99.068414,
}

# Mass added by a modification, by the names that search engines give it.
MODIFICATION_MASS = {
    "Cysteinylation": 119.004099,
    "Deamidated (N)": 0.984016, "Deamidated (NQ)": 0.984016, "Deamidation (NQ)": 0.984016, "Deamidation (N)": 0.984016, "Deamidation (Q)": 0.984016,
    "Oxidation (M)": 15.994915,
    "Acetyl (N-term)": 42.010565, "Acetylation (N-term)": 42.010565, "Acetyl (Protein N-term)": 42.010565,
    "Phospho (S)": 79.966331, "Phospho (T)": 79.966331, "Phospho (Y)": 79.966331, "Phospho (ST)": 79.966331, "Phospho (STY)": 79.966331,
    "Phosphorylation (STY)": 79.966331,
    "Carbamidomethyl (C)": 57.021464, "Carbamidomethylation": 57.021464,
    "Carbamylation": 43.005814, "NH3 loss": -17.026549, "Carbamylation and NH3 loss": 25.980265, "unknown": 0.0,
}

# Modification masses of the standard one-digit ids.
STANDARD_MODIFICATIONS = {0: 0.0, 1: 57.021464, 2: 15.994915, 3: 42.010565, 4: 0.984016, 5: 119.004099, 6: 43.005814, 7: -17.026549, 8: 25.980265}

# Polarity, hydrophobicity, pKa and BLOSUM6.1 index of each residue.
RESIDUE_PROPERTIES = {
    "A": (0.0, 1.8, 2.35, 0.19), "C": (0.0, 2.5, 1.92, -1.05), "D": (1.0, -3.5, 1.99, 0.01), "E": (1.0, -3.5, 2.10, -0.08), "F": (0.0, -2.8, 2.20, 0.29),
    "G": (0.0, -0.4, 2.35, 1.19), "H": (1.0, -3.2, 1.80, -0.79), "I": (0.0, 4.5, 2.32, 0.28), "K": (1.0, -3.9, 2.16, 0.1), "L": (0.0, 3.8, 2.33, 0.34),
    "M": (0.0, 1.9, 2.13, 0.37), "N": (1.0, -3.5, 2.14, 0.83), "P": (0.0, -1.6, 1.95, -2.02), "Q": (1.0, -3.5, 2.17, -0.08), "R": (1.0, -4.5, 1.82, 0.2),
    "S": (1.0, -0.8, 2.19, 0.54), "T": (1.0, -0.7, 2.09, 0.38), "V": (0.0, 4.2, 2.29, 0.16), "W": (0.0, -0.9, 2.46, 0.24), "Y": (1.0, -1.3, 2.20, -0.48),
}

# Alphabet of the spectrum predictor; residues in order, then oxidised methionine.
PREDICTOR_ALPHABET = {token: k + 1 for k, token in enumerate([*"ACDEFGHIKLMNPQRSTVWY", "M(ox)"])}

MIN_LENGTH, MAX_LENGTH = 7, 30
MAX_CHARGE, MAX_FRAGMENT_CHARGE = 6, 3
PREDICTED_MAJOR = OBSERVED_MAJOR = 0.1

#: What an ion of each series weighs beyond the residues on its side and their terminus.
ION_OFFSET = {"a": N_TERMINUS - (CARBON + HYDROGEN + OXYGEN), "b": N_TERMINUS - HYDROGEN, "y": C_TERMINUS + HYDROGEN}
