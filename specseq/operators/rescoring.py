"""Scores of given peptides against their spectra: node scores under a network of tables with all their parents, priors at both ends, confidence of each residue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.residues import amino_class, letters, residue_mass
from .evidence import relative_place
from .scores import conditional_table, node_score

#: The letter of a residue that is not known.
UNKNOWN = "X"


def peptide_nodes(peptides: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """scan, place (from 1), prm, total, before, after, site, rel: the inner places of each scan's peptide (scan, sequence, total, and mods: masses of its unknown residues in order, or null), with the columns also of the peptide.

    A peptide with another letter than residues and X, or with an X without a mass, has no places.
    """
    rows = peptides.select("scan", "total", *also, letters(F.col("sequence")).alias("_x"), F.coalesce("mods", F.array().cast("array<double>")).alias("_m"))
    # The n-th X weighs the n-th mass; without an X no places are counted.
    seen = F.transform("_x", lambda c, i: F.size(F.filter(F.slice("_x", 1, i + 1), lambda y: y == UNKNOWN)))
    weighed = F.transform(F.arrays_zip(F.col("_x").alias("c"), seen.alias("n")), lambda z: F.when(z["c"] == UNKNOWN, F.get(F.col("_m"), z["n"] - 1)).otherwise(residue_mass(z["c"])))
    mass = F.when(F.array_contains("_x", UNKNOWN), weighed).otherwise(F.transform("_x", residue_mass))
    known = rows.withColumn("_w", mass).where((F.size("_x") > 1) & ~F.exists("_w", lambda m: m.isNull()))
    sums = F.aggregate("_w", F.array(F.lit(0.0)), lambda t, m: F.concat(t, F.array(F.element_at(t, -1) + m)))
    inner = F.size("_x") - 1
    # Zipped, not looked up place by place: within a lambda the sums would be made anew for each place.
    places = F.arrays_zip(F.sequence(F.lit(1), inner).alias("place"), F.slice(sums, 2, inner).alias("prm"), F.slice("_x", 1, inner).alias("before"), F.slice("_x", 2, inner).alias("after"))
    nodes = known.select("scan", "total", *also, F.inline(places))
    return nodes.select("scan", *also, "place", "prm", "total", "before", "after", amino_class(F.col("before"), F.col("after")).alias("site"), relative_place(F.col("prm"), F.col("total")).alias("rel"))


def trained_network(nodes: DataFrame, network: dict[str, list[str]]) -> dict[str, DataFrame]:
    """For each attribute of the network its table of chances under its parents."""
    return {attribute: conditional_table(nodes, attribute, parents) for attribute, parents in network.items()}


def network_chance(nodes: DataFrame, network: dict[str, list[str]], tables: dict[str, DataFrame], name: str, prefix: str = "") -> DataFrame:
    """nodes with ``name``: the product over the attributes of their chances under their parents; 1 for a node for which a table has no entry. Attributes are the columns of their names behind the prefix. Tables are as small as the bins that they are over."""
    for i, (attribute, parents) in enumerate(network.items()):
        columns = [*parents, attribute]
        table = tables[attribute].select(*[F.col(c).alias(prefix + c) for c in columns], F.col("p").alias(f"_p{i}"))
        nodes = nodes.join(F.broadcast(table), [prefix + c for c in columns], "left")
    product = reduce(lambda a, b: a * b, [F.col(f"_p{i}") for i in range(len(network))], F.lit(1.0))
    return nodes.withColumn(name, F.coalesce(product, F.lit(1.0))).drop(*[f"_p{i}" for i in range(len(network))])


def scored_nodes(nodes: DataFrame, likelihood: dict[str, list[str]], prior: dict[str, list[str]], tables: dict[str, DataFrame]) -> DataFrame:
    """nodes (with noise, and the attributes of both networks) with s, the node's score; nodes that noise can't give are left out."""
    both = network_chance(network_chance(nodes, likelihood, tables, "_lik"), prior, tables, "_pri")
    return both.where("noise > 0").withColumn("s", node_score(F.col("_lik"), F.col("_pri"), F.col("noise"))).drop("_lik", "_pri")


def end_priors(peptides: DataFrame) -> DataFrame:
    """letter, first, last: logarithms of how often peptides begin and end with a letter, one added to each letter that occurs at an end."""
    ends = peptides.where(F.length("sequence") > 0).select(F.substring("sequence", 1, 1).alias("first"), F.substring("sequence", -1, 1).alias("last"))
    each = ends.select(F.explode(F.array(F.struct(F.col("first").alias("letter"), F.lit(1).alias("f"), F.lit(0).alias("l")), F.struct(F.col("last").alias("letter"), F.lit(0).alias("f"), F.lit(1).alias("l")))).alias("x")).select("x.*")
    counts = each.groupBy("letter").agg(F.sum("f").alias("f"), F.sum("l").alias("l"))
    totals = counts.agg((F.sum("f") + F.count("*")).alias("nf"), (F.sum("l") + F.count("*")).alias("nl"))
    return counts.crossJoin(F.broadcast(totals)).select("letter", F.log((F.col("f") + 1) / F.col("nf")).alias("first"), F.log((F.col("l") + 1) / F.col("nl")).alias("last"))


def peptide_scores(scored: DataFrame, peptides: DataFrame, priors: DataFrame, penalty: float) -> DataFrame:
    """scan, nodes, score: a peptide's node scores, the priors of its first and last letters, less ``penalty`` for each unknown residue. Peptides without places have no row."""
    sums = scored.groupBy("scan").agg(F.count("*").alias("nodes"), F.sum("s").alias("_s"))
    unknown = F.length("sequence") - F.length(F.translate("sequence", UNKNOWN, ""))
    rows = peptides.select("scan", F.substring("sequence", 1, 1).alias("_first"), F.substring("sequence", -1, 1).alias("_last"), (penalty * unknown).alias("_less"))
    first, last = priors.select(F.col("letter").alias("_first"), F.col("first").alias("_pf")), priors.select(F.col("letter").alias("_last"), F.col("last").alias("_pl"))
    met = sums.join(rows, "scan").join(F.broadcast(first), "_first", "left").join(F.broadcast(last), "_last", "left")  # a row a letter
    return met.select("scan", "nodes", (F.col("_s") + F.coalesce("_pf", F.lit(0.0)) + F.coalesce("_pl", F.lit(0.0)) - F.col("_less")).alias("score"))


def with_left(nodes: DataFrame, attributes: list[str]) -> DataFrame:
    """nodes with left_ columns of the attributes and of noise of the node before, null without one, and ``last``, whether no node follows; nodes that noise can't give don't count as either."""
    w = Window.partitionBy("scan")
    before = w.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    there = F.when(F.col("noise") > 0, F.struct(*attributes, "noise"))
    near = nodes.withColumn("_left", F.last(there, ignorenulls=True).over(before)).withColumn("last", F.col("place") == F.max(F.when(F.col("noise") > 0, F.col("place"))).over(w))
    return near.withColumns({f"left_{a}": F.col(f"_left.{a}") for a in (*attributes, "noise")}).drop("_left")


def left_scored(scored: DataFrame, likelihood: dict[str, list[str]], prior: dict[str, list[str]], tables: dict[str, DataFrame]) -> DataFrame:
    """scored_nodes() of with_left() with ``left``: whether the node before scores above 0 (1 or 0), null without one. Its attributes have come along, so no scan is put together again."""
    both = network_chance(network_chance(scored, likelihood, tables, "_lik", "left_"), prior, tables, "_pri", "left_")
    return both.withColumn("left", (node_score(F.col("_lik"), F.col("_pri"), F.col("left_noise")) > 0).cast("int")).drop("_lik", "_pri")


def residue_confidence(scored: DataFrame) -> DataFrame:
    """scan, residue (place from 0), letter, confidence: half for each side whose node scores above 0 or is an end of the peptide. ``left`` and ``last`` are taken as given if scored has them (with_left(), left_scored())."""
    good = (F.col("s") > 0).cast("int")
    if "left" not in scored.columns:
        w = Window.partitionBy("scan")
        scored = scored.withColumns({"left": F.lag(good).over(w.orderBy("place")), "last": F.col("place") == F.max("place").over(w)})
    row = lambda residue, letter, sure: F.struct(residue.cast("int").alias("residue"), letter.alias("letter"), sure.alias("confidence"))
    own = row(F.col("place") - 1, F.col("before"), 0.5 * F.when(F.col("place") == 1, 1).otherwise(F.coalesce("left", F.lit(0))) + 0.5 * good)
    end = row(F.col("place"), F.col("after"), 0.5 * good + 0.5)
    return scored.select("scan", F.inline(F.when(F.col("last"), F.array(own, end)).otherwise(F.array(own))))
