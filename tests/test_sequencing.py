"""Peptides back from their made-up spectra, and paths against all paths."""

import itertools
import random

import numpy as np
import pytest

from specseq.functions.residues import PROTON, RESIDUES, WATER, residue_table
from specseq.operators import sequences, sequencing


def spectra(spark, n=12, seed=3):
    """Seeded peptides: b and y ions of all places but one, log-normal intensities, uniform noise."""
    rng = random.Random(seed)
    peaks, totals, truth = [], [], {}
    for scan in range(n):
        peptide = "".join(rng.choice("ACDEFGHIKMNPRSTVWY") for _ in range(rng.randint(6, 10)))
        masses = np.cumsum([RESIDUES[c] for c in peptide])
        total = float(masses[-1])
        skipped = rng.randrange(1, len(peptide) - 2)
        for i, m in enumerate(masses[:-1].tolist()):
            if i != skipped:
                peaks += [(scan, 2 * i, m + PROTON, 50 * rng.lognormvariate(0, 0.3)), (scan, 2 * i + 1, total - m + WATER + PROTON, 50 * rng.lognormvariate(0, 0.3))]
        peaks += [(scan, 100 + k, rng.uniform(60, total), rng.uniform(0, 4)) for k in range(8)]
        totals.append((scan, total))
        truth[scan] = (peptide, [0.0, *masses.tolist()], skipped)
    return spark.createDataFrame(peaks, "scan long, peak long, mz double, intensity double"), spark.createDataFrame(totals, "scan long, total double"), truth


def test_peptides_come_back(spark):
    peaks, totals, truth = spectra(spark)
    nodes = sequencing.spectrum_graph_nodes(peaks, totals, 0.02)
    edges = sequencing.labelled_edges(nodes, residue_table(spark), 0.02, 110.0, 400.0)
    paths = sequencing.sequence_paths(nodes, edges, 20.0, 0.95).cache()
    best = {r.scan: r for r in paths.where("rank = 0").collect()}
    right = found = 0
    for scan, (_, ladder, skipped) in truth.items():
        want = [m for i, m in enumerate(ladder) if i != skipped + 1]
        got = best[scan].masses
        found += len(got)
        right += sum(any(abs(m - w) < 0.05 for w in want) for m in got)
    assert right >= 0.9 * found
    resolved = sequencing.resolved_edges(sequencing.ambiguous_edges(paths.where("rank = 0")), sequences.residue_strings(residue_table(spark), 400.0), 0.02)
    strings = {}
    for r in resolved.collect():
        strings.setdefault(r.scan, set()).add(r.seq)
    hits = sum(any(peptide[s : s + 2] in strings.get(scan, ()) for s in (skipped,)) for scan, (peptide, _, skipped) in truth.items())
    assert hits >= 0.7 * len(truth)


def test_nothing_gives_nothing(spark):
    peaks, totals, _ = spectra(spark, 2)
    nodes = sequencing.spectrum_graph_nodes(peaks.limit(0), totals, 0.02)
    edges = sequencing.labelled_edges(nodes, residue_table(spark), 0.02, 110.0, 400.0)
    assert nodes.count() == 0 and edges.count() == 0 and sequencing.sequence_paths(nodes, edges, 5.0, 0.9).count() == 0
    far = sequencing.labelled_edges(sequencing.spectrum_graph_nodes(peaks, totals, 0.02), residue_table(spark), 1e-9, 1e9, 60.0)
    assert sequencing.sequence_paths(sequencing.spectrum_graph_nodes(peaks, totals, 0.02), far, 5.0, 0.9).count() == 0


def test_near_best_against_all_paths():
    rng = random.Random(6)
    for _ in range(80):
        n = rng.randint(1, 7)
        score = np.array([0.0, *[rng.uniform(-2, 4) for _ in range(n)], 0.0])
        edges = [(a, b, rng.choice("AG-")) for a, b in itertools.combinations(range(n + 2), 2) if rng.random() < 0.5]
        cost = {(a, b): (1.5 if x == "-" else 0.0) for a, b, x in edges}
        every = []
        for k in range(n + 1):
            for inner in itertools.combinations(range(1, n + 1), k):
                p = [0, *inner, n + 1]
                if all(e in cost for e in itertools.pairwise(p)):
                    every.append((sum(score[p]) - sum(cost[e] for e in itertools.pairwise(p)), p))
        got = sequencing.near_best(n + 2, edges, score, 1.5, 0.8)
        if not every:
            assert got == []
            continue
        top = max(s for s, _ in every)
        want = sorted((round(s, 6), p) for s, p in every if s >= (0.8 if top > 0 else 1.01) * top - 1e-9)
        assert sorted((round(s, 6), p) for s, p, _ in got) == want and got[0][0] == pytest.approx(top)


def test_near_best_counts_in_plain_numbers():
    found = sequencing.near_best(3, [(0, 1, "G"), (1, 2, "-")], [0.0, 5.0, 0.0], 1.5, 0.8)
    assert found == [(3.5, [0, 1, 2], ["G", "-"])] and type(found[0][0]) is float
