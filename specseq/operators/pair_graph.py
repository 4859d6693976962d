"""Spectrum graphs whose scores hang on pairs of edges, and the search of subgraphs for edges that no residue explains.

A node's part in a path's score depends on the labels of the edge into it and of the
edge from it, so the dynamic program's state is an edge: the best score of the paths from
the start that end with it, and of those to the end that begin with it. Both together
say of each edge, before any path is walked, whether a near-optimal path uses it.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.residues import OTHER_SITE, RESIDUES, SITE_CLASSES, amino_class
from .evidence import graph_nodes
from .ranges import range_join

#: Paths that one batch of rows holds.
SLICE = 4096
#: The sign for an edge that no single residue explains.
OPEN = "-"


def site_scores(pairs: DataFrame) -> DataFrame:
    """class and site_score of all classes of sites: twice the logarithm of how much more often than evenly pairs of neighbours (before, after) are of the class, with one pair added to each."""
    classes = [number for *_, number in SITE_CLASSES] + [OTHER_SITE]
    everyone = pairs.sparkSession.createDataFrame([(c,) for c in classes], "class int")
    counts = pairs.select(amino_class(F.col("before"), F.col("after")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    total = pairs.agg(F.count("*").alias("total"))
    share = (F.coalesce("n", F.lit(0)) + 1) * float(len(classes)) / (F.col("total") + len(classes))
    return everyone.join(counts, "class", "left").crossJoin(F.broadcast(total)).select("class", F.round(2 * F.log(share), 6).alias("site_score"))


def mass_error_penalty(error: Column, total: Column, spread: float, most: float) -> Column:
    """0 for errors of less than ``spread`` parts per million of the total, then rising towards ``most``."""
    ppm = F.abs(error) / total * 1e6
    return F.when(ppm < spread, 0.0).otherwise(most - most * spread / ((most - 1) * ppm + (2 - most) * spread))


def open_edge_penalty(gap: Column, fixed: float, growing: float, least_gap: float) -> Column:
    """What an edge without a residue costs: a fixed part, and one in proportion to its length."""
    return fixed + growing / least_gap * gap


def edge_costs(edges: DataFrame, totals: DataFrame, residues: DataFrame, tolerance: float, spread: float, most: float, fixed: float, growing: float, least_gap: float) -> DataFrame:
    """labelled_edges() with ``cost``: by the distance to the nearest residue's mass (``most`` where none is within the tolerance), and by the gap for an open edge. totals has scan and total."""
    everyone = residues.agg(F.collect_list("mono").alias("_all"))  # one row
    error = F.array_min(F.transform("_all", lambda m: F.abs(m - F.col("gap"))))
    by_mass = F.when(error < tolerance, mass_error_penalty(error, F.col("total"), spread, most)).otherwise(most)
    by_gap = F.when(F.col("label") == OPEN, open_edge_penalty(F.col("gap"), fixed, growing, least_gap)).otherwise(0.0)
    return edges.join(totals.select("scan", "total"), "scan").crossJoin(F.broadcast(everyone)).withColumn("cost", by_mass + by_gap).drop("_all", "total")


class PairGraph:
    """A graph of nodes 0 to the last with scored pairs of edges (a, b, label, cost), which go to greater nodes.

    A path's score: for each inner node its score and the site score of the labels at its sides, less the edges' costs.
    """

    _classes: dict[tuple[str, str], int] = {}

    def __init__(self, score: Sequence[float], edges: list[tuple[int, int, str, float]], site: dict[int, float]):
        self.score, self.size = [float(x) for x in score], len(score)
        self.edges = sorted(edges)
        self.cost = [e[3] for e in self.edges]
        self.into, self.out = [[] for _ in score], [[] for _ in score]
        for i, (a, b, *_) in enumerate(self.edges):
            self.out[a].append(i)
            self.into[b].append(i)
        self.site = site

    def _class(self, before: str, after: str) -> int:
        """The class of a site, by the rules that amino_class() has."""
        found = self._classes.get((before, after))
        if found is None:
            found = OTHER_SITE
            if not (before == after and before in ("P", "G")):
                for side, residues, number in SITE_CLASSES:
                    if (before if side == "before" else after) in residues:
                        found = number
                        break
            self._classes[before, after] = found
        return found

    def pairs(self, node: int) -> list[list[float]]:
        """Scores of the pairs at a node: edges into it by edges from it."""
        own, after = self.score[node], [self.edges[i][2] for i in self.out[node]]
        return [[own + self.site.get(self._class(self.edges[i][2], y), 0.0) for y in after] for i in self.into[node]]

    def solve(self) -> float:
        """Fills left (best score of a path that ends with each edge, its cost included) and right (of what follows the edge); the best whole score, -inf without a path."""
        n = len(self.edges)
        left, right, cost, self.at = [-math.inf] * n, [-math.inf] * n, self.cost, {}
        for i in self.out[0]:
            left[i] = -cost[i]
        for node in range(1, self.size - 1):
            into, out = self.into[node], self.out[node]
            if into and out:
                at = self.at[node] = self.pairs(node)
                for k, i in enumerate(out):
                    left[i] = max(left[j] + row[k] for j, row in zip(into, at)) - cost[i]
        for i in self.into[self.size - 1]:
            right[i] = 0.0
        for node in range(self.size - 2, 0, -1):
            if node in self.at:
                rest = [right[i] - cost[i] for i in self.out[node]]
                for j, row in zip(self.into[node], self.at[node]):
                    right[j] = max(x + y for x, y in zip(row, rest))
        self.left, self.right = np.array(left), np.array(right)
        ends = self.into[self.size - 1]
        return max(left[i] for i in ends) if ends else -math.inf

    def near(self, best: float, alpha: float) -> float:
        """The least score of a near-optimal path: alpha times the best, 1.01 times a negative one."""
        return (alpha if best > 0 else 1.01) * best - 1e-9

    def kept(self, bound: float) -> list[int]:
        """The edges of which some path reaches the bound."""
        return np.nonzero(self.left + self.right >= bound)[0].tolist()

    def paths(self, bound: float):
        """(score, edges) of all paths that reach the bound, one after another; no more than one is held, beside what is open on the way to it."""
        stack = [(i, 0.0, (i,)) for i in self.into[self.size - 1] if self.left[i] >= bound]
        while stack:
            edge, gained, path = stack.pop()
            node = self.edges[edge][0]
            if node == 0:
                yield gained - self.cost[edge], path
                continue
            k = self.out[node].index(edge)
            for j, before in enumerate(self.into[node]):
                rest = gained - self.cost[edge] + self.at[node][j][k]
                if self.left[before] + rest >= bound:
                    stack.append((before, rest, (before, *path)))


def _graphs(nodes: DataFrame, edges: DataFrame, sites: DataFrame) -> DataFrame:
    """A row a scan with its nodes, edges and the table of site scores (sixteen rows)."""
    of_scan = nodes.groupBy("scan").agg(F.array_sort(F.collect_list(F.struct("place", "mass", "score"))).alias("nodes"))  # a scan's peaks
    links = edges.groupBy(F.col("scan").alias("_of")).agg(F.collect_list(F.struct("a", "b", "label", "cost")).alias("edges"))
    table = sites.agg(F.map_from_entries(F.collect_list(F.struct("class", "site_score"))).alias("sites"))
    # Plain columns of arrays: a dictionary for each node and edge would be most of a small graph's time.
    columns = [F.col(c).alias(c.replace(".", "_")) for c in ("nodes.mass", "nodes.score", "edges.a", "edges.b", "edges.label", "edges.cost")]
    return of_scan.join(links, F.col("scan") == F.col("_of")).crossJoin(F.broadcast(table)).select(F.col("scan").cast("long"), *columns, "sites")


def _solved(batches):
    """scan, masses and the solved PairGraph with its best score, for each scan that has a path."""
    for batch in batches:
        site = dict(batch.column("sites")[0].as_py()) if batch.num_rows else {}  # one table for all
        for scan, masses, score, *edges in zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True):
            graph = PairGraph(score, list(zip(*edges)), site)
            best = graph.solve() if graph.size > 1 else -math.inf
            if math.isfinite(best):
                yield scan, masses, graph, best


def _batches(rows, schema: pa.Schema):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == SLICE:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)


def pair_scored_paths(nodes: DataFrame, edges: DataFrame, sites: DataFrame, alpha: float) -> DataFrame:
    """scan, score, best, masses and labels of every path whose score is at least alpha times the scan's best.

    nodes: scan, place (from 0 by mass), mass, score; edges: scan, a, b, label, cost; sites: class, site_score. A scan without a path has no row.
    """
    schema = pa.schema([("scan", pa.int64()), ("score", pa.float64()), ("best", pa.float64()), ("masses", pa.list_(pa.float64())), ("labels", pa.list_(pa.string()))])

    def run(batches):
        def rows():
            for scan, masses, graph, best in _solved(batches):
                for score, path in graph.paths(graph.near(best, alpha)):
                    yield scan, float(score), best, [masses[0], *(masses[graph.edges[i][1]] for i in path)], [graph.edges[i][2] for i in path]

        yield from _batches(rows(), schema)

    return _graphs(nodes, edges, sites).mapInArrow(run, "scan long, score double, best double, masses array<double>, labels array<string>")


def kept_edges(nodes: DataFrame, edges: DataFrame, sites: DataFrame, alpha: float) -> DataFrame:
    """scan, a, b, low, high, label, through (the best score of a path through the edge) and best: the edges of the near-optimal subgraph."""
    schema = pa.schema([("scan", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("label", pa.string()), ("through", pa.float64()), ("best", pa.float64())])

    def run(batches):
        def rows():
            for scan, masses, graph, best in _solved(batches):
                for i in graph.kept(graph.near(best, alpha)):
                    a, b, label, _ = graph.edges[i]
                    yield scan, a, b, masses[a], masses[b], label, float(graph.left[i] + graph.right[i]), best

        yield from _batches(rows(), schema)

    return _graphs(nodes, edges, sites).mapInArrow(run, "scan long, a long, b long, low double, high double, label string, through double, best double")


def strongest(nodes: DataFrame, most: int) -> DataFrame:
    """Both ends of each scan's graph and its ``most`` best-scored inner nodes, numbered anew by mass."""
    ends = Window.partitionBy("scan")
    marked = nodes.withColumn("_end", (F.col("place") == 0) | (F.col("place") == F.max("place").over(ends)))
    kept = marked.withColumn("_turn", F.row_number().over(Window.partitionBy("scan", "_end").orderBy(F.desc("score"), "mass"))).where(F.col("_end") | (F.col("_turn") <= most))
    return kept.withColumn("place", F.row_number().over(ends.orderBy("mass")) - 1).select("scan", "place", "mass", "score")


def paired_graph_nodes(deltas: DataFrame, most: int, tolerance: float) -> DataFrame:
    """scan (the light one), place, mass, score: the graph of a pair of spectra, from its ``most`` best ranked deltas (light, mass, tier, n, rank, total; a light scan has one pair).

    Deltas whose sorted neighbours are less than ``tolerance`` apart are one node, with their mean as mass. A node's score is what its evidence
    counts: 4 for an ion of tier 0 down to 1 for one of tier 3. Both ends score 0.
    """
    w = Window.partitionBy("scan")
    order = w.orderBy("mass", "rank")
    best = graph_nodes(deltas, most).select(F.col("light").alias("scan"), "mass", "rank", "total", ((4 - F.col("tier")) * F.col("n")).cast("double").alias("score"))
    new = F.coalesce(F.col("mass") - F.lag("mass").over(order) >= tolerance, F.lit(True)).cast("int")
    runs = best.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inner = runs.groupBy("scan", "_run").agg(F.avg("mass").alias("mass"), F.sum("score").alias("score")).drop("_run")
    ends = best.groupBy("scan").agg(F.first("total").alias("total")).select("scan", F.explode(F.array(F.lit(0.0), F.col("total").cast("double"))).alias("mass"), F.lit(0.0).alias("score"))
    return inner.unionByName(ends).withColumn("place", F.row_number().over(w.orderBy("mass")) - 1).select("scan", "place", "mass", "score")


class _Search:
    """The search of one scan's subgraphs: strongest(), labelled_edges() and edge_costs() for the few nodes of a graph, in plain numbers."""

    def __init__(self, residues: list[tuple[float, str]], site: dict[int, float], tolerance: float, low: float, high: float, cut: float, most: int, penalties: dict):
        self.residues, self.site = sorted(residues), site
        self.masses = [m for m, _ in self.residues]
        self.tolerance, self.low, self.high, self.cut, self.most, self.penalties = tolerance, low, high, cut, most, penalties

    def labelled(self, gap: float) -> tuple[str | None, float]:
        """The label of a gap, None where it is no edge, and its distance to the nearest residue's mass."""
        at = bisect_left(self.masses, gap)
        error = min(abs(m - gap) for m in self.masses[max(at - 1, 0) : at + 1])
        reach = self.tolerance + 1e-6
        near = self.residues[bisect_left(self.masses, gap - reach) : bisect_right(self.masses, gap + reach)]
        fits = [sym for m, sym in near if abs(m - gap) < self.tolerance]
        return (fits[0] if len(fits) == 1 else OPEN if fits or gap > self.low else None), error

    def cost(self, label: str, gap: float, error: float, total: float) -> float:
        spread, most = self.penalties["spread"], self.penalties["most"]
        value = most
        if error < self.tolerance:
            ppm = error / total * 1e6
            value = 0.0 if ppm < spread else most - most * spread / ((most - 1) * ppm + (2 - most) * spread)
        return value + (self.penalties["fixed"] + self.penalties["growing"] / self.penalties["least_gap"] * gap if label == OPEN else 0.0)

    def kept(self, ends, inner, total: float, width: float, share: float) -> list[tuple[float, float, str]]:
        """low, high and label of the near-optimal edges of the graph of two ends and the ``most`` best inner nodes (mass, score)."""
        nodes = [ends[0], *sorted(sorted(inner, key=lambda n: (-n[1], n[0]))[: self.most]), ends[1]]
        edges = []
        for a, (x, _) in enumerate(nodes):
            for b in range(a + 1, len(nodes)):
                gap = nodes[b][0] - x
                if 0 < gap < self.high:
                    label, error = self.labelled(gap)
                    if label is not None and (label != OPEN or gap < width - 1):
                        edges.append((a, b, label, self.cost(label, gap, error, total)))
        if not edges:
            return []
        graph = PairGraph([s for _, s in nodes], edges, self.site)
        best = graph.solve()
        return [(nodes[graph.edges[i][0]][0], nodes[graph.edges[i][1]][0], graph.edges[i][2]) for i in graph.kept(graph.near(best, share))] if math.isfinite(best) else []

    def rows(self, nodes: list[tuple[float, float]], total: float, alpha: float, sub_alpha: float):
        """depth, interval_low, interval_high, low, high, label, state of all edges of a scan (nodes sorted by mass)."""
        if len(nodes) < 2:
            return
        top, inner = nodes[-1][0], nodes[1:-1]
        masses = [m for m, _ in inner]
        found = [(0, 0.0, top, *e) for e in self.kept((nodes[0], nodes[-1]), inner, total, top + 2 * self.high, alpha)]
        done: dict[tuple[float, float], bool] = {}
        fresh, depth = found, 0
        while todo := {(low, high) for *_, low, high, label in fresh if label == OPEN and high - low >= self.cut and (low, high) not in done}:
            depth += 1
            fresh = []
            for low, high in todo:
                within = inner[bisect_right(masses, low) : bisect_left(masses, high)]
                got = self.kept(((low, 0.0), (high, 0.0)), within, total, high - low, sub_alpha)
                done[low, high] = bool(got)
                fresh += [(depth, low, high, *e) for e in got]
            found = found + fresh
        for *row, low, high, label in found:
            yield *row, low, high, label, "residue" if label != OPEN else "split" if done.get((low, high)) else "open"


def subgraph_edges(nodes: DataFrame, totals: DataFrame, residues: DataFrame, sites: DataFrame, *, tolerance: float, low: float, high: float, cut: float, most: int, alpha: float, sub_alpha: float, penalties: dict) -> DataFrame:
    """scan, depth, interval_low, interval_high, low, high, label, state of the edges that the search goes through.

    The first graph of a scan has its ``most`` best nodes; its edges on near-optimal paths (alpha) are kept. Each
    open edge of at least ``cut`` is then searched: the ``most`` best nodes within it and its ends are a graph of
    their own, whose edges are shorter than the interval by more than 1, and whose near-optimal part (sub_alpha) is
    kept. Open edges of that part are searched in their turn, until none is left. state: residue for a labelled edge,
    split for an open one that a subgraph replaces, open for one that is too short or has no path within it. An
    interval that several graphs share is searched once, at its least depth. A scan's search needs no other scan, so it is done where its nodes are.
    """
    whole = nodes.groupBy("scan").agg(F.sort_array(F.collect_list(F.struct("place", "mass", "score"))).alias("_n"))  # a scan's peaks
    rows = whole.join(totals.where("total is not null").select("scan", F.col("total").cast("double").alias("_total")), "scan").select(F.col("scan").cast("long"), "_total", F.col("_n.mass").alias("_mass"), F.col("_n.score").alias("_score"))
    letters = [(float(x.mono), x.sym) for x in residues.select("mono", "sym").collect()]  # a row a residue
    site = {x["class"]: x.site_score for x in sites.select("class", "site_score").collect()}  # sixteen rows
    kinds = {"scan": pa.int64(), "depth": pa.int32(), "interval_low": pa.float64(), "interval_high": pa.float64(), "low": pa.float64(), "high": pa.float64(), "label": pa.string(), "state": pa.string()}

    def run(batches):
        search = _Search(letters, site, tolerance, low, high, cut, most, penalties)
        for batch in batches:
            out = []
            for scan, total, mass, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(scan, *x) for x in search.rows(list(zip(mass, score)), total, alpha, sub_alpha)]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return rows.mapInArrow(run, "scan long, depth int, interval_low double, interval_high double, low double, high double, label string, state string")


def spelled(paths: DataFrame, ambiguous: str = "X") -> DataFrame:
    """paths with ``sequence``, the labels one after another, the ambiguous letter for an open edge, and ``open``, the intervals (low, high) that those stand for."""
    edges = F.transform("labels", lambda x, i: F.struct(x.alias("label"), F.get(F.col("masses"), i).alias("low"), F.get(F.col("masses"), i + 1).alias("high")))
    gaps = F.transform(F.filter(edges, lambda e: e["label"] == OPEN), lambda e: F.struct(e["low"], e["high"]))
    return paths.withColumns({"sequence": F.translate(F.array_join("labels", ""), OPEN, ambiguous), "open": gaps})


def edge_modifications(edges: DataFrame, located: DataFrame, tolerance: float) -> DataFrame:
    """edges (scan, low, high, total) with mod and mod_mass: the modified residue (place, sym, mass, mod) whose mass is nearest to the gap and less than the tolerance off, of equally near ones the lightest, then the first by name.

    An edge from 0 may be one at the N-term, one to the total one at the C-term; others are modified where residues are anywhere. Edges that none explains have no row.
    """
    heavy = located.where("mod <> ''").select(F.col("place").alias("_place"), F.col("mass").alias("mod_mass"), "mod")
    rows = edges.withColumn("_gap", F.col("high") - F.col("low"))
    there = (F.col("_place") == "Anywhere") | ((F.col("_place") == "N-term") & (F.col("low") == 0)) | ((F.col("_place") == "C-term") & (F.col("high") == F.col("total")))
    near = range_join(rows, heavy, "_gap", "mod_mass", tolerance, there & (F.abs(F.col("_gap") - F.col("mod_mass")) < tolerance))
    best = F.min(F.struct(F.abs(F.col("_gap") - F.col("mod_mass")).alias("d"), "mod_mass", "mod"))
    return near.groupBy("scan", "low", "high", "total").agg(best.alias("_b")).select("scan", "low", "high", "total", "_b.mod", "_b.mod_mass")
