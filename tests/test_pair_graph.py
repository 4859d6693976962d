"""Graphs with scored pairs of edges and the search of subgraphs, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from specseq.functions.residues import RESIDUES
from specseq.operators import pair_graph as pg

SITE = {k: ((k * 7) % 5 - 2) * 0.5 for k in range(16)}


def all_paths(n, edges, score):
    """(score, edges) of every path, by walking all of them."""
    out, stack = [], [(0, ())]
    graph = pg.PairGraph(np.zeros(n), [], SITE)
    while stack:
        node, path = stack.pop()
        if node == n - 1 and path:
            total = -sum(edges[i][3] for i in path)
            total += sum(score[edges[i][1]] + SITE[graph._class(edges[i][2], edges[j][2])] for i, j in zip(path, path[1:]))
            out.append((total, path))
        stack += [(e[1], (*path, i)) for i, e in enumerate(edges) if e[0] == node]
    return out


def some_graph(rng):
    n = rng.randint(2, 9)
    edges = sorted((a, b, rng.choice("PGKRHDEVSTNAC-"), round(rng.random() * 4, 3)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5)
    return n, edges, np.array([0.0, *(round(rng.uniform(-3, 9), 3) for _ in range(n - 2)), 0.0])


def test_paths_and_edges_equal_brute_force():
    rng, negative = random.Random(8), 0
    for _ in range(400):
        n, edges, score = some_graph(rng)
        want = all_paths(n, edges, score)
        graph = pg.PairGraph(score, edges, SITE)
        assert graph.edges == edges
        best = graph.solve()
        if not want:
            assert best == -np.inf
            continue
        assert best == pytest.approx(max(s for s, _ in want))
        negative += best < 0
        bound = graph.near(best, 0.7)
        near = {p: s for s, p in want if s >= bound}
        got = {p: s for s, p in graph.paths(bound)}
        assert got.keys() == near.keys() and all(got[p] == pytest.approx(near[p]) for p in got)
        through = {i: max((s for s, p in want if i in p), default=-np.inf) for i in range(len(edges))}
        assert set(graph.kept(bound)) == {i for i, s in through.items() if s >= bound}
        assert all((graph.left + graph.right)[i] == pytest.approx(s) or s == -np.inf for i, s in through.items())
    assert negative


def test_a_graph_with_very_many_paths_is_walked_lazily():
    n = 40
    edges = [(a, b, "A", 0.0) for a in range(n) for b in range(a + 1, min(a + 4, n))]
    graph = pg.PairGraph(np.zeros(n), edges, {k: 0.0 for k in range(16)})
    paths = graph.paths(graph.near(graph.solve(), 0.9))
    assert len([next(paths) for _ in range(5000)]) == 5000


def test_penalties(spark):
    row = spark.range(1).select(
        pg.mass_error_penalty(F.lit(0.002), F.lit(1000.0), 5.0, 15.0).alias("small"), pg.mass_error_penalty(F.lit(-0.005), F.lit(1000.0), 5.0, 15.0).alias("edge"),
        pg.mass_error_penalty(F.lit(0.01), F.lit(1000.0), 5.0, 15.0).alias("double"), pg.open_edge_penalty(F.lit(150.0), 4.0, 3.0, 300.0).alias("open"),
    ).first()
    assert row.small == 0 and row.edge == pytest.approx(0) and row.double == pytest.approx(14) and row.open == pytest.approx(5.5)


PENALTIES = {"spread": 400.0, "most": 12.0, "fixed": 2.0, "growing": 1.0, "least_gap": 100.0}
SEARCH = {"tolerance": 0.2, "low": 100.0, "high": 900.0, "cut": 150.0, "most": 3, "alpha": 0.8, "sub_alpha": 0.3}


def brute_search(scan, inner, total, site, s=SEARCH, p=PENALTIES):
    """Rows of subgraph_edges() for one scan, by recursion over intervals, breadth first as a shared interval counts at its least depth."""

    def label_and_cost(gap):
        fits = [r for r, m in RESIDUES.items() if abs(m - gap) < s["tolerance"]]
        label = fits[0] if len(fits) == 1 else "-" if fits or gap > s["low"] else None
        error = min(abs(m - gap) for m in RESIDUES.values())
        ppm = error / total * 1e6
        cost = p["most"] if error >= s["tolerance"] else 0 if ppm < p["spread"] else p["most"] - p["most"] * p["spread"] / ((p["most"] - 1) * ppm + (2 - p["most"]) * p["spread"])
        return label, cost + (p["fixed"] + p["growing"] / p["least_gap"] * gap if label == "-" else 0)

    def kept(low, high, width, alpha):
        chosen = sorted([(m, x) for m, x in inner if low < m < high], key=lambda n: (-n[1], n[0]))[: s["most"]]
        nodes = [(low, 0.0), *sorted(chosen), (high, 0.0)]
        edges = []
        for a in range(len(nodes)):
            for b in range(a + 1, len(nodes)):
                gap = nodes[b][0] - nodes[a][0]
                if not 0 < gap < s["high"]:
                    continue
                label, cost = label_and_cost(gap)
                if label and (label != "-" or gap < width - 1):
                    edges.append((a, b, label, cost))
        graph = pg.PairGraph(np.array([x for _, x in nodes]), edges, site)
        best = graph.solve()
        return [] if best == -np.inf else [(nodes[e[0]][0], nodes[e[1]][0], e[2]) for e in (graph.edges[i] for i in graph.kept(graph.near(best, alpha)))]

    found = [(0, 0.0, total, *e) for e in kept(0.0, total, total + 2 * s["high"], s["alpha"])]
    split, seen, todo, depth = set(), set(), [(x[3], x[4]) for x in found if x[5] == "-"], 0
    while todo:
        depth += 1
        more = []
        for low, high in sorted(set(todo)):
            if high - low >= s["cut"] and (low, high) not in seen:
                seen.add((low, high))
                part = kept(low, high, high - low, s["sub_alpha"])
                if part:
                    split.add((low, high))
                found += [(depth, low, high, *e) for e in part]
                more += [(e[0], e[1]) for e in part if e[2] == "-"]
        todo = more
    return sorted((scan, d, a, b, x, y, label, "residue" if label != "-" else "split" if (x, y) in split else "open") for d, a, b, x, y, label in found)


def test_subgraph_search_equals_recursion(spark):
    rng, rows, want, depths = random.Random(4), [], [], set()
    sites = spark.createDataFrame(list(SITE.items()), "class int, site_score double")
    for scan in range(12):
        masses, at = [], 0.0
        for _ in range(rng.randint(4, 9)):
            at = round(at + rng.choice(list(RESIDUES.values())), 5)
            masses.append(at)
        total = masses.pop()
        masses += [round(rng.uniform(60, total - 60), 3) for _ in range(4)]
        inner = sorted((m, float(rng.randint(1, 40))) for m in set(masses))
        rows += [(scan, k, m, x) for k, (m, x) in enumerate([(0.0, 0.0), *inner, (total, 0.0)])]
        part = brute_search(scan, inner, total, SITE)
        want += part
        depths |= {r[1] for r in part}
    nodes = spark.createDataFrame(rows, "scan long, place int, mass double, score double")
    totals = nodes.groupBy("scan").agg(F.max("mass").alias("total"))
    residues = spark.createDataFrame(list(RESIDUES.items()), "sym string, mono double")
    got = pg.subgraph_edges(nodes, totals, residues, sites, **SEARCH, penalties=PENALTIES)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert max(depths) >= 2 and {r[7] for r in want} == {"residue", "split", "open"}


def test_nothing_to_search(spark):
    nodes = spark.createDataFrame([], "scan long, place int, mass double, score double")
    sites, residues = spark.createDataFrame(list(SITE.items()), "class int, site_score double"), spark.createDataFrame(list(RESIDUES.items()), "sym string, mono double")
    edges = spark.createDataFrame([], "scan long, a long, b long, label string, cost double")
    assert pg.pair_scored_paths(nodes, edges, sites, 0.9).collect() == [] and pg.kept_edges(nodes, edges, sites, 0.9).collect() == []
    assert pg.subgraph_edges(nodes, nodes.selectExpr("scan", "mass total"), residues, sites, **SEARCH, penalties=PENALTIES).collect() == []


def test_spelling_and_modified_edges(spark):
    paths = spark.createDataFrame([(1, [0.0, 57.0, 200.0, 300.0], ["G", "-", "V"]), (2, [0.0, 57.0], ["G"])], "scan long, masses array<double>, labels array<string>")
    got = {r.scan: (r.sequence, [tuple(x) for x in r.open]) for r in pg.spelled(paths).collect()}
    assert got == {1: ("GXV", [(57.0, 200.0)]), 2: ("G", [])}
    located = spark.createDataFrame([("Anywhere", "A", 71.0, ""), ("Anywhere", "X", 143.0, "b"), ("Anywhere", "X", 143.0, "a"), ("N-term", "X", 90.0, "cap"), ("C-term", "X", 90.1, "tail")], "place string, sym string, mass double, mod string")
    edges = spark.createDataFrame([(1, 57.0, 200.0, 300.0), (1, 0.0, 90.04, 300.0), (1, 210.0, 300.0, 300.0), (1, 20.0, 110.0, 300.0), (1, 0.0, 71.0, 300.0)], "scan long, low double, high double, total double")
    found = {(r.low, r.high): (r.mod, r.mod_mass) for r in pg.edge_modifications(edges, located, 0.2).collect()}
    assert found == {(57.0, 200.0): ("a", 143.0), (0.0, 90.04): ("cap", 90.0), (210.0, 300.0): ("tail", 90.1)}


def test_graphs_are_handed_over_as_plain_arrays(spark):
    nodes = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 60.0, 2.0), (1, 2, 120.0, 0.0)], "scan long, place int, mass double, score double")
    edges = spark.createDataFrame([(1, 0, 1, "G", 0.0), (1, 1, 2, "A", 1.0)], "scan long, a int, b int, label string, cost double")
    sites = spark.createDataFrame([(k, 0.0) for k in range(16)], "class int, site_score double")
    assert not any("struct" in kind for _, kind in pg._graphs(nodes, edges, sites).dtypes)
    [path] = pg.pair_scored_paths(nodes, edges, sites, 0.9).collect()
    assert (path.score, path.masses, path.labels) == (1.0, [0.0, 60.0, 120.0], ["G", "A"])
