"""Search of references by seeds: an index of k-letter strings, candidates by seeds in common, regions by chains, extension by flanking residues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.residues import letters, residue_mass
from .graphs import _kept
from .sequences import tag_runs, windows

#: References of a seed beyond which it is hot, and the parts that a hot seed's references are dealt to.
HOT_SEED, SALTS = 2048, 32


def seeds(rows: DataFrame, key: str, sequence: str, k: int) -> DataFrame:
    """key, place (from 0), seed: every string of k letters of each sequence; none of null or of a shorter one."""
    return windows(rows, key, sequence, k, "place", "seed")


def seed_matches(queries: DataFrame, query: str, query_sequence: str, references: DataFrame, reference: str, reference_sequence: str, k: int) -> DataFrame:
    """query, reference, i, j: all places at which a query and a reference have a string of k letters in common.

    References' seeds that no query has are dropped before they are shuffled. The references of a hot seed are dealt to
    several parts, and the queries that have it go to each.
    """
    asked = _kept(seeds(queries, query, query_sequence, k).select(F.col(query), F.col("place").alias("i"), "seed"))
    index = seeds(references, reference, reference_sequence, k).select(F.col(reference), F.col("place").alias("j"), "seed")
    index = _kept(index.join(asked.select("seed").distinct(), "seed", "left_semi"))
    hot = _kept(index.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SEED).select("seed", F.lit(True).alias("_hot")))  # as many as a share of the index
    salted = index.join(hot, "seed", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(reference, "j"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    everywhere = asked.join(hot, "seed", "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return everywhere.join(salted, ["seed", "_salt"]).select(query, reference, "i", "j")


def chained(matches: DataFrame, query: str, reference: str, k: int, drift: int) -> DataFrame:
    """query, reference, score, a_start, a_end, b_start, b_end: the chain of each pair's matches.

    Matches that follow each other at once make a run. The longest run (then the one first in the query, then on the least
    diagonal) is the anchor; the chain has all runs whose diagonals are at most ``drift`` from it. Its score
    is the number of the query's letters that it covers.
    """
    pair = F.struct(F.col(query).alias("q"), F.col(reference).alias("r")).alias("pair")
    runs = _kept(tag_runs(matches.select(pair, "i", "j"), "pair").select("pair", "diagonal", F.col("start").alias("i"), (F.col("length") + k - 1).alias("n")))
    anchor = runs.groupBy("pair").agg(F.min(F.struct((-F.col("n")).alias("n"), "i", "diagonal")).alias("a"))
    chain = runs.join(anchor, "pair").where(F.abs(F.col("diagonal") - F.col("a.diagonal")) <= drift)
    ends = chain.groupBy("pair").agg(F.min("i").alias("a_start"), F.max(F.col("i") + F.col("n")).alias("a_end"), F.min(F.col("i") - F.col("diagonal")).alias("b_start"), F.max(F.col("i") - F.col("diagonal") + F.col("n")).alias("b_end"))
    # Letters covered: runs in order of their starts, each adding what lies beyond those before it.
    order = Window.partitionBy("pair").orderBy("i", "n").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(F.col("i") + F.col("n")).over(order), F.lit(0))
    fresh = chain.select("pair", F.greatest(F.col("i") + F.col("n") - F.greatest(before, F.col("i")), F.lit(0)).alias("fresh"))
    scores = fresh.groupBy("pair").agg(F.sum("fresh").alias("score"))
    return scores.join(ends, "pair").select(F.col("pair.q").alias(query), F.col("pair.r").alias(reference), "score", "a_start", "a_end", "b_start", "b_end")


def best_reference(chains: DataFrame, query: str, reference: str) -> DataFrame:
    """The chain of highest score of each query, the least reference of equally good ones, with ``references``, how many have that score."""
    best = chains.groupBy(query).agg(F.max("score").alias("score"))
    top = chains.join(best, [query, "score"])
    return top.groupBy(query).agg(F.min(F.struct(reference, "score", "a_start", "a_end", "b_start", "b_end")).alias("_c"), F.count("*").alias("references")).select(query, "_c.*", "references")


def _flank(text: Column, most: Column) -> Column:
    """How many of the first letters of a text weigh less than ``most`` together."""
    start = F.struct(F.lit(0.0).alias("m"), F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(s: Column, c: Column) -> Column:
        mass = s["m"] + F.coalesce(residue_mass(c), F.lit(0.0))
        on = s["on"] & (mass < most)
        return F.struct(mass.alias("m"), F.when(on, s["n"] + 1).otherwise(s["n"]).alias("n"), on.alias("on"))

    return F.aggregate(letters(text), start, step, lambda s: s["n"])


def extended(best: DataFrame, queries: DataFrame, query: str, query_sequence: str, references: DataFrame, reference: str, reference_sequence: str, spare: float, reach: int) -> DataFrame:
    """best_reference()'s rows with left and right, how many residues before and behind the region belong to it, and region, the extended one.

    Where the query has letters before (behind) its chain, flanking residues are added as long as they weigh less together than
    those letters and ``spare``; ``reach`` is more than as many as can. A flank ends with the reference.
    """
    total = lambda s: F.aggregate(letters(s), F.lit(0.0), lambda t, c: t + F.coalesce(residue_mass(c), F.lit(0.0)))
    rows = best.join(queries.select(query, F.col(query_sequence).alias("_q")), query).join(references.select(reference, F.col(reference_sequence).alias("_r")), reference)
    rows = rows.withColumns({
        "_before": total(F.substr("_q", F.lit(1), F.col("a_start"))), "_behind": total(F.substr("_q", F.col("a_end") + 1, F.length("_q"))),
        "_front": F.reverse(F.substr("_r", F.greatest(F.col("b_start") - reach, F.lit(0)) + 1, F.least(F.col("b_start"), F.lit(reach)))), "_back": F.substr("_r", F.col("b_end") + 1, F.lit(reach)),
    })
    sized = rows.withColumns({"left": F.when(F.col("_before") > 0, _flank(F.col("_front"), F.col("_before") + spare)).otherwise(0), "right": F.when(F.col("_behind") > 0, _flank(F.col("_back"), F.col("_behind") + spare)).otherwise(0)})
    region = F.substr("_r", F.col("b_start") - F.col("left") + 1, F.col("b_end") - F.col("b_start") + F.col("left") + F.col("right"))
    return sized.select(*best.columns, "left", "right", region.alias("region"))


def with_flanks(rows: DataFrame, sequence: str, start: str, end: str) -> DataFrame:
    """rows with ``flanked``: the residue before a region, the region and the residue behind it, with dots between, - at an end of the sequence."""
    s = F.concat(F.lit("-"), F.col(sequence), F.lit("-"))
    part = lambda i, n: F.substr(s, i + 1, n)
    return rows.withColumn("flanked", F.concat_ws(".", part(F.col(start), F.lit(1)), part(F.col(start) + 1, F.col(end) - F.col(start)), part(F.col(end) + 1, F.lit(1))))


def agreement(found: DataFrame, stated: DataFrame, key: str, common) -> DataFrame:
    """found (key, peptide, references) beside stated (key, db_peptide, db_reference): agrees, whether the stated reference is among those found, and ``common`` of both peptides. Keys without a stated peptide are left out."""
    both = found.join(stated.where("db_peptide is not null"), key)
    return both.select(key, "peptide", "db_peptide", F.array_contains("references", F.col("db_reference")).alias("agrees"), common(F.col("peptide"), F.col("db_peptide")).alias("shared"))
