"""Features of a peptide's match to its scans: fragments that peaks show, their offsets, evidence of nodes, paired and forbidden masses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.residues import PROTON
from .evidence import CARBON_MONOXIDE, ion_mass
from .ranges import range_join


def _rungs(ladders: DataFrame) -> DataFrame:
    """scan and _rungs, its places in order: what stands for a scan is one row, so its fragments pass no shuffle."""
    return ladders.where("place is not null").groupBy("scan").agg(F.sort_array(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), F.col("prm").cast("double").alias("prm"), F.col("total").cast("double").alias("total")))).alias("_rungs"))


def _ion_array(ions: list[str]) -> Column:
    """All fragments of _rungs, as an array of place, other, ion and mass."""
    one = lambda place, other, ion, mass: F.struct(place.alias("place"), other.alias("other"), F.lit(ion).alias("ion"), mass.alias("mass"))
    single = F.flatten(F.transform("_rungs", lambda x: F.array(*[one(x["place"], x["place"], i, ion_mass(i, x["prm"], x["total"])) for i in ions])))
    inner = F.flatten(F.transform("_rungs", lambda x: F.transform(F.filter("_rungs", lambda y: x["place"] < y["place"]), lambda y: one(x["place"], y["place"], "internal", y["prm"] - x["prm"] + PROTON))))
    before = F.concat(F.array(F.struct(F.lit(-1).alias("place"), F.lit(0.0).alias("prm"))), F.transform("_rungs", lambda x: F.struct(x["place"].alias("place"), x["prm"].alias("prm"))))
    after = F.concat(F.transform("_rungs", lambda x: x["prm"]), F.array(F.array_max(F.transform("_rungs", lambda x: x["total"]))))
    steps = F.zip_with(before, after, lambda x, y: one(x["place"], x["place"], "imm", y - x["prm"] - CARBON_MONOXIDE + PROTON))
    return F.concat(single, inner, steps) if ions else F.concat(inner, steps)


def fragment_ions(ladders: DataFrame, ions: list[str]) -> DataFrame:
    """scan, place, other, ion, mass: ions of each place (scan, place, prm, total; one ladder a scan, places from 0), fragments between two places ("internal"), and single residues less CO ("imm").

    other is the second place of an internal fragment, else equal to place. The first and the last residue of a ladder lie before its first place and
    behind its last, so place is -1 for the first.
    """
    return _rungs(ladders).select("scan", F.inline(_ion_array(ions)))


def _spots(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy("scan").agg(F.collect_list(F.struct("mz", "peak", "intensity")).alias("_spots"))  # a scan's peaks


def _nearest(tolerance: float) -> Column:
    """Of _spots the peak, offset and intensity nearest to mass, of equally near ones the lowest; null if none is less than ``tolerance`` off."""
    near = F.filter("_spots", lambda s: F.abs(s["mz"] - F.col("mass")) < tolerance)
    best = F.array_min(F.transform(near, lambda s: F.struct(F.abs(s["mz"] - F.col("mass")).alias("d"), s["mz"].alias("mz"), s["peak"].alias("peak"), s["intensity"].alias("intensity"))))
    return F.when(best.isNotNull(), F.struct(best["peak"].alias("peak"), (best["mz"] - F.col("mass")).alias("offset"), best["intensity"].alias("intensity")))


def annotated(ions: DataFrame, peaks: DataFrame, tolerance: float) -> DataFrame:
    """ions with peak, offset (of the peak's mz) and intensity: the nearest peak of the scan (scan, peak, mz, intensity) that is less than ``tolerance`` off, the lowest of equally near ones. Ions without such a peak have no row."""
    near = ions.select("scan", "place", "other", "ion", "mass").distinct().join(_spots(peaks), "scan").withColumn("_x", _nearest(tolerance))
    return near.where("_x is not null").select("scan", "place", "other", "ion", "mass", "_x.*")


#: Cells of the table of ions by peaks that is compared at once.
CELLS = 1 << 20
SHOWN = "array<struct<place: int, other: int, ion: string, mass: double, offset: double, spot: int>>"


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _found(ions: list[str], tolerance: float):
    def found(place: pa.Array, prm: pa.Array, total: pa.Array, mz: pa.Array) -> pa.Array:
        """For each scan its fragments (as in fragment_ions()) with the nearest of its peaks, which come sorted by mz, then peak."""
        count, n = pc.list_value_length(place).to_numpy(zero_copy_only=False), len(place)
        owner, p, x, whole = np.repeat(np.arange(n), count), _flat(place).astype(int), _flat(prm).astype(float), _flat(total).astype(float)
        order = np.lexsort((p, owner))
        p, x, whole = p[order], x[order], whole[order]
        end = np.cumsum(count)
        later = end[owner] - 1 - np.arange(len(p))
        one = np.repeat(np.arange(len(p)), later)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(later) - later, later)
        one, two = one[p[one] < p[two]], two[p[one] < p[two]]
        names = [*ions, "internal", "imm"]
        parts = [(owner, p, p, k, ion_mass(ion, x, whole)) for k, ion in enumerate(ions)]
        parts.append((owner[one], p[one], p[two], len(ions), x[two] - x[one] + PROTON))
        # Single residues: from the start or a place to the next place or the end.
        some = np.nonzero(count)[0]
        most = np.fmax.reduceat(whole, end[some] - count[some]) if len(some) else np.zeros(0)
        before = np.insert(x, end[some] - count[some], 0.0)
        starts = np.insert(p, end[some] - count[some], -1)
        parts.append((np.repeat(some, count[some] + 1), starts, starts, len(ions) + 1, np.insert(x, end[some], most) - before - CARBON_MONOXIDE + PROTON))
        owner = np.concatenate([q[0] for q in parts])
        by = np.argsort(owner, kind="stable")
        owner = owner[by]
        place, other, mass = (np.concatenate([q[i] for q in parts])[by] for i in (1, 2, 4))
        kind = np.concatenate([np.full(len(q[0]), q[3], np.int32) for q in parts])[by]

        peaks = pc.list_value_length(mz).to_numpy(zero_copy_only=False)
        spots, first = _flat(mz).astype(float), np.cumsum(peaks) - peaks
        nearest, width = np.full(len(owner), -1), int(peaks.max(initial=0))
        step = max(CELLS // max(width, 1), 1)
        for at in range(0, len(owner) if width else 0, step):
            of = owner[at : at + step]
            cell = first[of][:, None] + np.arange(width)
            gap = np.abs(spots[np.minimum(cell, len(spots) - 1)] - mass[at : at + step, None])
            gap = np.where((np.arange(width) < peaks[of][:, None]) & (gap < tolerance), gap, np.inf)
            best = gap.argmin(axis=1)  # the first of equally near ones
            nearest[at : at + step] = np.where(np.isfinite(gap[np.arange(len(of)), best]), best, -1)
        kept = np.nonzero(nearest >= 0)[0]
        owner, nearest, mass = owner[kept], nearest[kept], mass[kept]
        columns = [pa.array(place[kept], pa.int32()), pa.array(other[kept], pa.int32()), pa.DictionaryArray.from_arrays(kind[kept], names).cast(pa.string()), pa.array(mass), pa.array(spots[first[owner] + nearest] - mass), pa.array(nearest, pa.int32())]
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["place", "other", "ion", "mass", "offset", "spot"]))

    return found


def shown_fragments(ladders: DataFrame, peaks: DataFrame, ions: list[str], tolerance: float) -> DataFrame:
    """annotated() of fragment_ions(). A scan's ladder, whose places differ, meets its peaks before its fragments are rows, so these are neither shuffled nor sorted."""
    whole = _rungs(ladders).join(_spots(peaks).withColumn("_spots", F.sort_array("_spots")), "scan")
    found = F.arrow_udf(_found(ions, tolerance), SHOWN)("_rungs.place", "_rungs.prm", "_rungs.total", F.transform("_spots", lambda s: s["mz"].cast("double")))
    rows = whole.select("scan", "_spots", F.inline(found))
    spot = F.get("_spots", F.col("spot"))
    return rows.select("scan", "place", "other", "ion", "mass", spot["peak"].alias("peak"), "offset", spot["intensity"].alias("intensity"))


def ion_counts(shown: DataFrame) -> DataFrame:
    """scan, ion, n: annotations by kind of ion, and as "only neut" the places that lack b or y but show it less water."""
    plain = shown.groupBy("scan", "ion").agg(F.count("*").alias("n"))
    has = lambda ion: F.coalesce(F.bool_or(F.col("ion") == ion), F.lit(False))
    places = shown.where(F.col("ion").isin("b", "y", "b-H2O", "y-H2O")).groupBy("scan", "place").agg(((~has("b") & has("b-H2O")) | (~has("y") & has("y-H2O"))).alias("_only"))
    return plain.unionByName(places.where("_only").groupBy("scan").agg(F.count("*").alias("n")).withColumn("ion", F.lit("only neut")))


def annotation_stats(shown: DataFrame, peaks: DataFrame, paired: DataFrame, missing: float, tops: tuple[int, int] = (25, 50)) -> DataFrame:
    """A row for each scan that has peaks: explained (share of intensity), for each n of tops top_n and paired_n (annotated peaks of the n strongest, and those that paired places explain), and mean, max and max_rel of the offsets of b and y.

    paired has scan and place. An internal fragment is paired if both places are. max_rel is the greatest step between the offsets of
    places that follow each other among those shown. Without an offset, mean and max are ``missing``; with fewer than two, so is max_rel.
    """
    n, m = tops
    # All meet by scan alone, with what else they have in common in arrays: rows dealt by scan need no further shuffle.
    pairs = paired.groupBy("scan").agg(F.collect_set("place").alias("_pairs"))
    flags = shown.join(pairs, "scan", "left").withColumn("_both", F.array_contains("_pairs", F.col("place")) & F.array_contains("_pairs", F.col("other")))
    w = Window.partitionBy("scan", "ion").orderBy("place")
    moved = flags.withColumn("_step", F.when(F.col("ion").isin("b", "y"), F.abs(F.col("offset") - F.lag("offset").over(w))))
    of = lambda ion, c: F.when(F.col("ion") == ion, c)
    sums = [x for i in ("b", "y") for x in (F.avg(of(i, F.col("offset"))).alias(f"mean_{i}"), F.max(of(i, F.abs("offset"))).alias(f"max_{i}"), F.max(of(i, F.col("_step"))).alias(f"max_rel_{i}"))]
    by_scan = moved.groupBy("scan").agg(F.collect_set("peak").alias("_all"), F.collect_set(F.when(F.col("_both"), F.col("peak"))).alias("_two"), *sums)
    order = F.row_number().over(Window.partitionBy("scan").orderBy(F.desc("intensity"), "peak"))
    has = lambda c: F.coalesce(F.array_contains(c, F.col("peak")), F.lit(False))
    names = [f"{x}_{i}" for i in ("b", "y") for x in ("mean", "max", "max_rel")]
    spots = peaks.withColumn("_rank", order).join(by_scan, "scan", "left").withColumns({"_seen": has("_all"), "_pair": has("_two")})
    count = lambda flag, k: F.count_if(F.col(flag) & (F.col("_rank") <= k))
    return spots.groupBy("scan").agg(
        (F.coalesce(F.sum(F.when(F.col("_seen"), F.col("intensity"))), F.lit(0.0)) / F.sum("intensity")).alias("explained"),
        *[count("_seen", k).alias(f"top_{k}") for k in (n, m)], *[count("_pair", k).alias(f"paired_{k}") for k in (n, m)], *[F.coalesce(F.first(c), F.lit(missing)).alias(c) for c in names],
    )


def scan_scores(nodes: DataFrame) -> DataFrame:
    """cluster, scan, score, negative, least: sum of the node scores (cluster, scan, place, score), number below 0, least one."""
    return nodes.groupBy("cluster", "scan").agg(F.sum("score").alias("score"), F.count_if(F.col("score") < 0).alias("negative"), F.min("score").alias("least"))


def cluster_scores(nodes: DataFrame) -> DataFrame:
    """cluster, total, least_node, least_path, most_path, all_, majority, none_: path scores over a cluster's scans, the least summed score of a place, and the places with a positive score in all scans, in at least half of them, and in none."""
    scans = nodes.groupBy("cluster").agg(F.count_distinct("scan").alias("_n"))
    places = nodes.groupBy("cluster", "place").agg(F.sum("score").alias("_s"), F.count_if(F.col("score") > 0).alias("_pos")).join(scans, "cluster")
    kinds = places.groupBy("cluster").agg(
        F.min("_s").alias("least_node"), F.count_if(F.col("_pos") == F.col("_n")).alias("all_"), F.count_if(2 * F.col("_pos") >= F.col("_n")).alias("majority"), F.count_if(F.col("_pos") == 0).alias("none_")
    )
    paths = scan_scores(nodes).groupBy("cluster").agg(F.sum("score").alias("total"), F.min("score").alias("least_path"), F.max("score").alias("most_path"))
    return paths.join(kinds, "cluster").select("cluster", "total", "least_node", "least_path", "most_path", "all_", "majority", "none_")


def paired_places(paired: DataFrame, ladders: DataFrame, tolerance: float) -> DataFrame:
    """pair, place, kind, light, heavy: paired masses (pair, mass, kind, light and heavy: whether most scans of that side show it) at the nearest place (pair, place, prm) less than ``tolerance`` off, the lowest of equally near ones."""
    named = paired.withColumn("_id", F.struct("mass", "kind", "light", "heavy"))
    near = range_join(named, ladders.select("pair", "place", "prm"), "mass", "prm", tolerance, F.abs(F.col("mass") - F.col("prm")) < tolerance, ("pair",))
    return near.groupBy("pair", "_id").agg(F.min(F.struct(F.abs(F.col("mass") - F.col("prm")), "prm", "place"))["place"].alias("place")).select("pair", "place", "_id.kind", "_id.light", "_id.heavy")


def paired_counts(places: DataFrame) -> DataFrame:
    """pair, kind, n, n_light, n_heavy of the rows of paired_places()."""
    return places.groupBy("pair", "kind").agg(F.count("*").alias("n"), F.count_if("light").alias("n_light"), F.count_if("heavy").alias("n_heavy"))


def forbidden_pairs(ladder: Column, mass: Column, ppm: float, steps: int = 5) -> Column:
    """Half the number (rounded down) of masses of a ladder whose complement to ``mass`` (that of the charged precursor) is at most ``steps`` buckets from one of its masses. A bucket is 2 * ppm of the mass divided by ``steps``; 0 for a mass of 0 and for an empty ladder."""
    width = mass * (2e-6 * ppm / steps)
    own = lambda x: F.rint(x / F.nullif(width, F.lit(0.0)))
    met = F.filter(ladder, lambda x: F.exists(ladder, lambda y: F.abs(own(mass - PROTON - x) - own(y)) <= steps))
    return F.floor(F.coalesce(F.size(met), F.lit(0)) / 2)


def training_labels(results: DataFrame, truth: DataFrame, key: str, precision: str) -> DataFrame:
    """results whose key is in truth (key, precision), with label: 1 where the precision is 1 or more, else -1."""
    return results.join(truth.select(key, F.when(F.col(precision) < 1, -1).otherwise(1).alias("label")), key)
