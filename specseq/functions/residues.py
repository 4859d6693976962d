"""Residues, masses and peptide strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Monoisotopic residue masses in Dalton (I stands for I and L), and small molecules.
RESIDUES = {
    "A": 71.03711, "C": 103.00919, "D": 115.02694, "E": 129.04259, "F": 147.06841, "G": 57.02146, "H": 137.05891, "I": 113.08406, "K": 128.09496, "M": 131.04049,
    "N": 114.04293, "P": 97.05276, "Q": 128.05858, "R": 156.10111, "S": 87.03203, "T": 101.04768, "V": 99.06841, "W": 186.07931, "Y": 163.06333,
}
# The proton and water.
PROTON, WATER = 1.00727638, 18.0105647
# The standard genetic code by codons in the order of TCAG.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


# Classes of a site by the residues at its sides; the first line that fits names the class, P-P, G-G and all else are OTHER_SITE.
SITE_CLASSES = [
    ("after", "P", 0), ("before", "P", 1), ("after", "G", 2), ("before", "G", 3), ("after", "RK", 4), ("before", "H", 5), ("after", "H", 6), ("before", "DE", 7),
    ("after", "DE", 8), ("before", "JV", 9), ("after", "JV", 10), ("before", "ST", 11), ("after", "ST", 12), ("before", "N", 13), ("after", "N", 14),
]
OTHER_SITE = 15


def residue_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RESIDUES.items()), "sym string, mono double")


def normalised(sequence: Column) -> Column:
    """Upper case, L as I, U as C, Z as Q, B as N; other characters than residues are dropped."""
    return F.regexp_replace(F.translate(F.upper(sequence), "LUZB", "ICQN"), f"[^{''.join(RESIDUES)}]", "")


def stripped(sequence: Column, keep: str = "") -> Column:
    """A sequence without modification symbols: residues, L and the characters in keep."""
    return F.regexp_replace(sequence, f"[^{''.join(RESIDUES)}L{keep}]", "")


def residue_mass(letter: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv]), letter)


def letters(sequence: Column) -> Column:
    return F.filter(F.split(sequence, ""), lambda c: c != "")


def ladder(sequence: Column) -> Column:
    """Prefix masses of a residue string, without 0 and the whole."""
    masses = F.transform(letters(sequence), residue_mass)
    sums = F.aggregate(masses, F.array().cast("array<double>"), lambda t, m: F.concat(t, F.array(F.coalesce(F.try_element_at(t, F.lit(-1)), F.lit(0.0)) + m)))
    return F.slice(sums, 1, F.greatest(F.size(masses) - 1, F.lit(0)))


def prefix_masses(sequence: Column) -> Column:
    """Masses of all prefixes, from 0 to the whole; null from the first letter on that is no residue."""
    return F.aggregate(F.transform(letters(sequence), residue_mass), F.array(F.lit(0.0)), lambda t, m: F.concat(t, F.array(F.element_at(t, -1) + m)))


def amino_class(before: Column, after: Column) -> Column:
    """Class of a site from the residues at its sides, by SITE_CLASSES."""
    case = F.when((before == after) & before.isin("P", "G"), OTHER_SITE)
    for side, residues, number in SITE_CLASSES:
        case = case.when((before if side == "before" else after).isin(*residues), number)
    return case.otherwise(OTHER_SITE)


def cleavage_rule(before: Column, after: Column, rules: list[tuple[str, str]]) -> Column:
    """Number (from 0) of the first (before, after) pair of patterns that fits, -1 if none."""
    case = None
    for i, (b, a) in enumerate(rules):
        fits = before.rlike(f"^(?:{b})$") & after.rlike(f"^(?:{a})$")
        case = F.when(fits, i) if case is None else case.when(fits, i)
    return case.otherwise(-1)


def reverse_complement(dna: Column) -> Column:
    return F.reverse(F.translate(dna, "ACGTN", "TGCAN"))


def translated(dna: Column, frame: int) -> Column:
    """Residues of the codons from frame (0 to 2) on; X for a codon with other letters than ACGT; codons that are cut off are dropped."""
    codons = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
    code = F.create_map(*[F.lit(x) for kv in zip(codons, CODE, strict=True) for x in kv])
    n = F.floor((F.length(dna) - frame) / 3).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(starts, lambda i: F.coalesce(F.element_at(code, F.substring(dna, i * 3 + frame + 1, F.lit(3))), F.lit("X"))), "")


def fasta(name: Column, sequence: Column, width: int = 60) -> Column:
    """A FASTA record with lines of ``width`` residues."""
    return F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n"))
