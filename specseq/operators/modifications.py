"""Residues with modifications, anywhere or at an end, and all strings of them under a mass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.residues import residue_table
from .evidence import bucket
from .graphs import _kept
from .programs import modified_residues
from .ranges import range_join

#: The letter of a modified residue, and the places where residues may be modified.
MODIFIED, PLACES = "X", ("Anywhere", "N-term", "C-term")


def located_residues(modifications: DataFrame, step: float = 0.0025, tolerance: float = 0.02, least: float = 43.0) -> DataFrame:
    """place, sym, mass, mod: plain residues anywhere, and what modifications (mod, site, place, mass) make of residues.

    A site is a residue, or N-term or C-term for any residue at that end. A modified residue has the letter X, weighs more
    than ``least`` and isn't within the tolerance of a plain one. At the ends plain residues alone are modified. Of modifications of equal mass at a place the first by name is kept.
    """
    spark = modifications.sparkSession
    plain = residue_table(spark)
    reach = int(-(-tolerance // step))
    at_end = (F.col("place") != "Anywhere") | F.col("site").isin("N-term", "C-term")
    anywhere = modified_residues(modifications.where(~at_end).select("mod", "site", "mass"), step, tolerance, least).select(F.lit("Anywhere").alias("place"), "mod", "mass")
    ends = modifications.where(at_end).select(F.when(F.col("site").isin("N-term", "C-term"), F.col("site")).otherwise(F.col("place")).alias("place"), "mod", "site", "mass")
    met = ends.join(F.broadcast(plain), (F.col("site") == F.col("sym")) | F.col("site").isin("N-term", "C-term"))  # nineteen residues
    heavy = met.select("place", "mod", F.round(F.col("mono") + F.col("mass"), 8).alias("mass"))
    close = F.broadcast(plain.select(bucket(F.col("mono"), step).alias("_plain")))
    heavy = heavy.where(F.col("mass") > least).join(close, F.abs(bucket(F.col("mass"), step) - F.col("_plain")) <= reach, "left_anti")
    named = anywhere.unionByName(heavy).groupBy("place", "mass").agg(F.min("mod").alias("mod"))
    return plain.select(F.lit("Anywhere").alias("place"), "sym", F.col("mono").alias("mass"), F.lit("").alias("mod")).unionByName(named.select("place", F.lit(MODIFIED).alias("sym"), "mass", "mod"))


def blind_mod_strings(located: DataFrame, most_mass: float, most_mods: int | None = None) -> DataFrame:
    """place, seq, mods (masses of the modified residues in order), mass: all strings of located_residues() under most_mass, of any length, with at most most_mods modified residues if that is given.

    A string at the N-term may begin with a residue modified there, one at the C-term end with one; all other letters
    are those that stand anywhere. Strings grow by a letter a round, level by level, until none is under the mass; each level is one table in the shared folder.
    """
    least = located.agg(F.min("mass")).first()[0]
    if least is not None and least <= 0:
        raise ValueError("masses must be positive")
    letter = F.struct("sym", F.col("mass").alias("mono"), (F.col("mod") != "").cast("int").alias("n"))
    everyone = _kept(located.where("place = 'Anywhere' and mass < %r" % most_mass).agg(F.collect_list(letter).alias("_all")))  # one row
    first = located.join(located.sparkSession.createDataFrame([(x,) for x in PLACES], "_of string"), (F.col("place") == "Anywhere") | (F.col("place") == F.col("_of")))
    mods = F.when(F.col("mod") != "", F.array("mass")).otherwise(F.array().cast("array<double>"))
    level = _kept(first.where(F.col("mass") < most_mass).select(F.col("_of").alias("place"), F.col("sym").alias("seq"), mods.alias("mods"), "mass"))
    if most_mods is not None:
        level = level.where(F.size("mods") <= most_mods)
    found = level
    while not level.isEmpty():
        fits = lambda x: (F.col("mass") + x["mono"] < most_mass) & (F.lit(True) if most_mods is None else F.size("mods") + x["n"] <= most_mods)
        # Strings at the C-term grow to the front.
        text = lambda x: F.when(F.col("place") == "C-term", F.concat(x["sym"], "seq")).otherwise(F.concat("seq", x["sym"]))
        own = lambda x: F.when(x["n"] > 0, F.array(x["mono"])).otherwise(F.array().cast("array<double>"))
        both = lambda x: F.when(F.col("place") == "C-term", F.concat(own(x), "mods")).otherwise(F.concat("mods", own(x)))
        longer = F.transform(F.filter("_all", fits), lambda x: F.struct(text(x).alias("seq"), both(x).alias("mods"), (F.col("mass") + x["mono"]).alias("mass")))
        level = _kept(level.crossJoin(F.broadcast(everyone)).select("place", F.inline(longer)))
        found = found.unionByName(level)
    return found


def explained(rows: DataFrame, mass: str, strings: DataFrame, tolerance: float) -> DataFrame:
    """rows with each string (place, seq, mods, string_mass) whose mass is within the tolerance of theirs."""
    named = strings.withColumnRenamed("mass", "string_mass")
    return range_join(rows, named, mass, "string_mass", tolerance, F.abs(F.col(mass) - F.col("string_mass")) < tolerance)
