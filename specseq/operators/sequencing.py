"""From peaks to sequences: nodes of a spectrum graph, edges labelled by residues, near-optimal paths, ambiguous edges."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.residues import RESIDUES
from .evidence import fragment_deltas
from .ranges import range_join
from .sequences import mass_lookup


def spectrum_graph_nodes(peaks: DataFrame, totals: DataFrame, tolerance: float) -> DataFrame:
    """scan, place (from 0 by mass), mass, score: what a scan's peaks mean as b and y ions, and both ends.

    Masses whose sorted neighbours are less than ``tolerance`` apart are one node, with their mean as mass and their summed share of the
    scan's intensity, in per cent, as score. Nodes leave room for a residue at both ends, which score 0. A scan without peaks has no nodes.
    """
    deltas = fragment_deltas(peaks, totals).join(totals, "scan")
    edge = min(RESIDUES.values()) - 1
    w = Window.partitionBy("scan")
    share = deltas.withColumn("share", 200 * F.col("intensity") / F.sum("intensity").over(w)).where((F.col("mass") > edge) & (F.col("mass") < F.col("total") - edge))  # each peak counts twice in the sum
    order = w.orderBy("mass", "peak", "ion")
    new = F.coalesce(F.col("mass") - F.lag("mass").over(order) >= tolerance, F.lit(True)).cast("int")
    runs = share.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inner = runs.groupBy("scan", "_run").agg(F.avg("mass").alias("mass"), F.sum("share").alias("score")).select("scan", "mass", "score")
    ends = deltas.groupBy("scan").agg(F.first("total").alias("total")).select("scan", F.explode(F.array(F.lit(0.0), F.col("total").cast("double"))).alias("mass"), F.lit(0.0).alias("score"))
    return inner.unionByName(ends).withColumn("place", F.row_number().over(w.orderBy("mass")) - 1).select("scan", "place", "mass", "score")


def labelled_edges(nodes: DataFrame, residues: DataFrame, tolerance: float, low: float, high: float) -> DataFrame:
    """scan, a, b, gap, label: pairs of a scan's nodes at most ``high`` apart whose gap is one residue's mass within the tolerance, or - where several residues fit or none does and the gap is over ``low``."""
    left = nodes.select("scan", F.col("place").alias("a"), F.col("mass").alias("_x"))
    right = nodes.select("scan", F.col("place").alias("b"), F.col("mass").alias("_y"))
    gap = F.col("_y") - F.col("_x")
    pairs = range_join(left, right, "_x", "_y", high, (gap > 0) & (gap < high), ("scan",)).withColumn("gap", gap)
    fits = F.filter("_all", lambda r: F.abs(r["mono"] - F.col("gap")) < tolerance)
    everyone = residues.agg(F.collect_list(F.struct("sym", "mono")).alias("_all"))  # one row
    named = pairs.crossJoin(F.broadcast(everyone)).withColumn("_fits", fits)
    label = F.when(F.size("_fits") == 1, F.col("_fits")[0]["sym"]).when((F.size("_fits") > 1) | (F.col("gap") > low), "-")
    return named.withColumn("label", label).where("label is not null").select("scan", "a", "b", "gap", "label")


def near_best(size: int, edges: list[tuple[int, int, str]], score: Sequence[float], penalty: float, alpha: float) -> list[tuple[float, list[int], list[str]]]:
    """(score, nodes, labels) of all paths from node 0 to the last whose score is at least alpha times the best (1.01 times a negative one), best first. Edges go to greater numbers; one labelled - costs ``penalty``."""
    before: list[list[tuple[int, str]]] = [[] for _ in range(size)]
    for a, b, label in edges:
        before[b].append((a, label))
    cost = lambda label: penalty if label == "-" else 0.0
    score = [float(x) for x in score]
    best = [-math.inf] * size
    best[:1] = score[:1]
    for b in range(1, size):
        best[b] = max((best[a] - cost(label) for a, label in before[b]), default=-math.inf) + score[b]
    if size < 2 or not math.isfinite(best[-1]):
        return []
    bound = (alpha if best[-1] > 0 else 1.01) * best[-1] - 1e-9
    found, stack = [], [(size - 1, 0.0, [size - 1], [])]
    while stack:
        node, gained, path, labels = stack.pop()
        if node == 0:
            found.append((gained + score[0], path, labels))
            continue
        for a, label in before[node]:
            rest = gained + score[node] - cost(label)
            if rest + best[a] >= bound:
                stack.append((a, rest, [a, *path], [label, *labels]))
    return sorted(found, key=lambda f: (-f[0], f[1], f[2]))


def sequence_paths(nodes: DataFrame, edges: DataFrame, penalty: float, alpha: float) -> DataFrame:
    """scan, rank (from 0), score, masses and labels of every near-optimal path of each scan's graph; a scan without a path has no row."""

    graphs = nodes.groupBy("scan").agg(F.array_sort(F.collect_list(F.struct("place", "mass", "score"))).alias("n"))  # a scan's peaks
    links = edges.groupBy(F.col("scan").alias("_of")).agg(F.collect_list(F.struct("a", "b", "label")).alias("e"))
    # Plain columns of arrays: a dictionary for each node and edge would be most of a small graph's time.
    columns = [F.col(c).alias(c.replace(".", "_")) for c in ("n.mass", "n.score", "e.a", "e.b", "e.label")]
    rows = graphs.join(links, F.col("scan") == F.col("_of")).select(F.col("scan").cast("long"), *columns)

    def run(batches):
        for batch in batches:
            out = []
            for scan, mass, weights, a, b, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                paths = near_best(len(mass), list(zip(a, b, names)), weights, penalty, alpha)
                out += [(scan, i, score, [mass[k] for k in path], labels) for i, (score, path, labels) in enumerate(paths)]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.string())]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["scan", "rank", "score", "masses", "labels"])

    return rows.mapInArrow(run, "scan long, rank long, score double, masses array<double>, labels array<string>")


def ambiguous_edges(paths: DataFrame) -> DataFrame:
    """scan, rank, place, low, high: the edges of paths that no residue explains."""
    places = F.filter(F.transform("labels", lambda x, i: F.struct(x.alias("label"), i.alias("place"), F.get(F.col("masses"), i).alias("low"), F.get(F.col("masses"), i + 1).alias("high"))), lambda e: e["label"] == "-")
    return paths.select("scan", "rank", F.inline(places)).drop("label")


def resolved_edges(edges: DataFrame, strings: DataFrame, tolerance: float) -> DataFrame:
    """ambiguous_edges() with each residue string (seq, seq_mass) that explains the gap within the tolerance."""
    return mass_lookup(edges.withColumn("gap", F.col("high") - F.col("low")), "gap", strings, tolerance)
