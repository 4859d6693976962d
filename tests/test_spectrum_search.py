"""Isotopes, shifted alignments, modifications, pairs of like answers, and searches on graphs, against hand-worked cases and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from specseq.functions.residues import RESIDUES
from specseq.operators import graph_search as gs
from specseq.operators import isotopes, modifications, programs, shifts

STEP, PROTON = isotopes.STEP, isotopes.PROTON


# isotopes
def envelope_of(mono, charge, tall, n=5):
    """Peaks of one envelope, as m/z and intensity: shares of heavy carbons by the mass."""
    carbons = int((mono * charge - PROTON * charge) / 111 * 5.1)
    return [(mono + k * STEP / charge, tall * r) for k, r in enumerate(isotopes.isotope_ratios(carbons)[:n])]


def test_ratios_and_scores():
    assert isotopes.isotope_ratios(1)[:3] == pytest.approx((0.9893, 0.0107, 0)) and isotopes.isotope_ratios(0) == isotopes.isotope_ratios(1)
    assert sum(isotopes.isotope_ratios(400, 60)) == pytest.approx(1) and isotopes.isotope_ratios(900) == isotopes.isotope_ratios(400)
    assert [isotopes.middle(x) for x in ([], [3], [1, 3], [5, 1, 3], [4, 1, 2, 3], [6, 5, 4, 3, 2, 1])] == [0, 3, 2, 3, 3.5, 4.5]
    x, y = np.array([0.5, 0.3, 0.2]), np.array([0.4, 0.4, 0.0])
    assert isotopes.chi_square(x, y) == pytest.approx(0.01 / 0.4 + 0.01 / 0.4) and isotopes.chi_square(x, 0 * y) == -1
    assert isotopes.slope_score(x, x) == pytest.approx(1)
    assert isotopes.slope_score(x, y) == pytest.approx((1 - abs(0.32 / 0.38 - 1)) * 0.32**2 / (0.38 * 0.32))


@pytest.mark.parametrize("charge", [1, 2, 3])
def test_an_envelope_becomes_one_mass(charge):
    mono = 500.27
    mz, tall = map(np.array, zip(*envelope_of(mono, charge, 1000.0, 3 if charge == 1 else 5)))  # those within the window
    got = isotopes.peeled(mz, tall, 5000.0, 3)
    singly = mono * charge - (charge - 1) * PROTON
    assert got[-1][0] == pytest.approx(singly) and got[-1][2] == "mono" and got[-1][1] == pytest.approx(tall.sum())
    assert len(got) == 1


def test_a_spectrum_of_several_envelopes_with_noise():
    peaks = [*envelope_of(300.15, 1, 900.0, 3), *envelope_of(420.7, 2, 800.0, 4), *envelope_of(700.4, 3, 700.0), (250.0, 40.0), (810.123, 30.0), (905.5, 20.0)]
    mz, tall = map(np.array, zip(*peaks))
    got = isotopes.peeled(mz, tall, 3000.0, 3)
    mono = {round(m, 4): i for m, i, kind in got if kind == "mono"}
    assert mono.keys() == {300.15, round(2 * 420.7 - PROTON, 4), round(3 * 700.4 - 2 * PROTON, 4)}
    assert mono[300.15] == pytest.approx(sum(i for _, i in envelope_of(300.15, 1, 900.0, 3)))
    assert {(m, i) for m, i, kind in got if kind == "noise"} >= {(250.0, 40.0), (810.123, 30.0), (905.5, 20.0)}
    assert sum(i for _, i, _ in got) == pytest.approx(tall.sum())
    assert {kind for *_, kind in isotopes.peeled(mz, tall, 3000.0, 3, noise=False)} == {"mono"}
    # Masses above the precursor's aren't believed.
    low = isotopes.peeled(mz, tall, 1000.0, 3)
    assert {round(m, 4) for m, _, kind in low if kind == "mono"} >= {300.15, round(2 * 420.7 - PROTON, 4)} and all(m <= 1000 for m, _, kind in low if kind == "mono")
    assert sum(i for _, i, _ in low) == pytest.approx(tall.sum())


def test_a_mass_seen_at_two_charges_is_averaged():
    one = 601.3
    two = (one + PROTON) / 2
    peaks = [*envelope_of(one, 1, 900.0, 3), *envelope_of(two, 2, 600.0, 4)]
    mz, tall = map(np.array, zip(*peaks))
    got = [x for x in isotopes.peeled(mz, tall, 3000.0, 3) if x[2] == "mono"]
    assert len(got) == 1 and got[0][0] == pytest.approx(one) and got[0][1] == pytest.approx(tall.sum() / 2)


def test_failures_end_it():
    mz, tall = np.arange(20) * 37.0 + 100, np.arange(20, 0, -1) * 10.0
    got = isotopes.peeled(mz, tall, 3000.0, 3)
    assert sorted(m for m, *_ in got) == mz.tolist() and all(kind == "noise" for *_, kind in got)
    assert len(isotopes.peeled(mz, tall, 3000.0, 3, noise=False)) == 0


def test_charges_without_a_neighbour_are_not_looked_into(monkeypatch):
    asked = []
    whole = isotopes.envelope
    monkeypatch.setattr(isotopes, "envelope", lambda *a: asked.append(a[3]) or whole(*a))
    mz, tall = map(np.array, zip(*envelope_of(420.7, 2, 800.0, 4)))
    got = isotopes.peeled(np.append(mz, 450.0), np.append(tall, 5.0), 3000.0, 3)
    assert {round(m, 4) for m, _, kind in got if kind == "mono"} == {round(2 * 420.7 - PROTON, 4)} and (450.0, 5.0, "noise") in got
    assert set(asked) <= {1, 2}  # isotopes two places off are neighbours at charge 1


def test_deisotoping_frames(spark):
    rows = [(1, float(m), float(i)) for m, i in envelope_of(420.7, 2, 800.0)] + [(2, 100.0, 5.0), (2, None, 5.0), (3, 50.0, 1.0)]
    peaks = spark.createDataFrame(rows, "scan long, mz double, intensity double")
    totals = spark.createDataFrame([(1, 2000.0), (2, 2000.0), (3, None), (4, 100.0)], "scan long, total double")
    got = {(r.scan, round(r.mz, 3), r.kind) for r in isotopes.deisotope_envelopes(peaks, totals).collect()}
    assert got == {(1, round(2 * 420.7 - PROTON, 3), "mono"), (2, 100.0, "noise")}
    assert isotopes.deisotope_envelopes(peaks.where("false"), totals).collect() == []
    charges = spark.createDataFrame([(1, 430.0, None), (2, 50.0, None), (3, 60.0, 4)], "scan long, total double, charge int")
    assert sorted(tuple(r) for r in isotopes.charge_guesses(peaks, charges).collect()) == [(1, 1), (2, 2), (2, 3), (3, 4)]


# alignments with shifts
def slow_layers(a, b, most, tolerance):
    """Most matches that end with each cell, by comparing all cells."""
    offset = b[None, :] - a[:, None]
    best = np.ones((most + 1, len(a), len(b)), int)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        for k in range(most + 1):
            for p, q in itertools.product(range(i), range(j)):
                if abs(offset[i, j] - offset[p, q]) < tolerance:
                    best[k, i, j] = max(best[k, i, j], best[k, p, q] + 1)
                if k:
                    best[k, i, j] = max(best[k, i, j], best[k - 1, p, q] + 1)
    return best


def test_shifted_paths_equal_brute_force(spark):
    rng, rows = random.Random(6), []
    for n in range(40):
        a = sorted(rng.uniform(0, 60) for _ in range(rng.randint(0, 8)))
        b = sorted([x + rng.choice([0, 0, 16]) + rng.uniform(-0.3, 0.3) for x in a if rng.random() < 0.8] + [rng.uniform(0, 60) for _ in range(rng.randint(0, 3))])
        rows.append((n, n + 100, a, b))
    rows += [(90, 190, None, [1.0]), (91, 191, [5.0, 5.0, 7.0], [5.0, 5.0, 7.0])]
    pairs = spark.createDataFrame(rows, "light long, heavy long, a array<double>, b array<double>")
    for most in (0, 1, 2):
        found = {}
        for r in shifts.shifted_paths(pairs, most, 0.5).collect():
            found.setdefault(r.light, []).append((r.step, r.light_mass, r.heavy_mass, r["shift"]))
        for light, _, a, b in rows:
            if not (a and b):
                assert light not in found
                continue
            x, y = np.array(a), np.array(b)
            path = sorted(found[light])
            want = slow_layers(x, y, most, 0.5)
            assert np.array_equal(shifts.layers(x, y, most, 0.5)[0], want)
            assert len(path) == want[most].max() and [s for s, *_ in path] == list(range(len(path)))
            assert path[0][3] == 0 and path[-1][3] <= most
            for (_, p, q, k), (_, r, s, m) in zip(path, path[1:]):
                assert p <= r and q <= s and m - k in (0, 1) and (m > k or abs((s - r) - (q - p)) < 0.5 + 1e-9)


def test_few_cells_take_the_path_of_many(monkeypatch):
    rng, asked = np.random.default_rng(4), []
    cases = [(np.sort(rng.integers(0, 30, n) / 2.0), np.sort(rng.integers(0, 30, m) / 2.0)) for n in range(1, 8) for m in range(1, 9) for _ in range(4)]
    few = [shifts.few_cells_path(a.tolist(), b.tolist(), k, 0.5) for a, b in cases for k in range(3)]
    monkeypatch.setattr(shifts, "FEW_CELLS", 0)
    assert few == [shifts.shifted_path(a, b, k, 0.5) for a, b in cases for k in range(3)]
    monkeypatch.setattr(shifts, "FEW_CELLS", 64)
    monkeypatch.setattr(shifts, "layers", lambda *a: asked.append(a))
    assert shifts.shifted_path(np.arange(4.0), np.arange(4.0), 1, 0.5) == [(i, i, 0) for i in range(4)] and not asked


# strings with modifications
def test_strings_with_modifications(spark):
    mods = [("oxide", "M", "Anywhere", 15.9949), ("light", "G", "Anywhere", -20.0), ("same", "G", "Anywhere", 14.01565), ("cap", "N-term", "Anywhere", 42.01057), ("tail", "K", "C-term", 0.984), ("tail2", "K", "C-term", 0.984), ("odd", "S", "N-term", 79.96633)]
    frame = spark.createDataFrame(mods, "mod string, site string, place string, mass double")
    located = modifications.located_residues(frame).collect()
    plain = {(r.place, r.sym): r.mass for r in located if not r["mod"]}
    assert plain == {("Anywhere", k): v for k, v in RESIDUES.items()}
    heavy = {(r.place, round(r.mass, 4)): r["mod"] for r in located if r["mod"]}
    assert heavy[("Anywhere", round(RESIDUES["M"] + 15.9949, 4))] == "oxide" and ("Anywhere", round(RESIDUES["G"] + 14.01565, 4)) not in heavy  # a G with it weighs as an A
    assert heavy[("C-term", round(RESIDUES["K"] + 0.984, 4))] == "tail" and heavy[("N-term", round(RESIDUES["W"] + 42.01057, 4))] == "cap"
    assert not any(m < 43 for _, m in heavy)

    most = 260.0
    got = sorted((r.place, r.seq, tuple(r.mods), round(r.mass, 6)) for r in modifications.blind_mod_strings(modifications.located_residues(frame), most).collect())
    letters = [(r.sym, r.mass, bool(r["mod"]), r.place) for r in located]
    anywhere, want = [x for x in letters if x[3] == "Anywhere"], []
    for place in modifications.PLACES:
        level = [[x] for x in letters if x[3] in ("Anywhere", place) and x[1] < most]
        while level:
            for s in level:
                s = s[::-1] if place == "C-term" else s
                want.append((place, "".join(x[0] for x in s), tuple(x[1] for x in s if x[2]), round(sum(x[1] for x in s), 6)))
            level = [[*s, x] for s in level for x in anywhere if sum(y[1] for y in s) + x[1] < most]
    assert sorted(want) == got and max(len(s) for _, s, *_ in got) == 4
    few = modifications.blind_mod_strings(modifications.located_residues(frame), most, 1)
    assert few.where("size(mods) > 1").isEmpty() and few.count() == sum(len(m) <= 1 for _, _, m, _ in want)


# results of programs
def test_pairs_at_the_edge_of_the_tolerance(spark):
    """The greater mass sets the tolerance, whichever key is the smaller."""
    near, far = 1000.0, 1000.0 * (1 + 100e-6 / (1 - 100e-6)) - 1e-6  # within 100 ppm of the greater, not of the smaller
    assert far - near > 100e-6 * near
    for rows in ([(1, near, "x"), (2, far, "x")], [(1, far, "x"), (2, near, "x")]):
        frame = spark.createDataFrame(rows, "scan long, mass double, answer string")
        assert [tuple(r) for r in programs.same_answer_pairs(frame, "scan", "mass", "answer", 0.0, 100.0).collect()] == [(1, 2)]
        assert {tuple(r) for r in programs.answer_clusters(frame, "scan", "mass", "answer", 100.0).collect()} == {(1, 1), (2, 1)}


def test_pairs_by_sequences(spark):
    rows = [(1, 1000.0, "A^GK*"), (2, 1010.0, "A^GK"), (3, 1010.0, "AGK"), (4, 1000.0, "AGK*"), (5, 1010.0, "A^G"), (6, 1000.0, ""), (7, 1010.0, None), (8, 1010.0, "A^^GR")]
    frame = spark.createDataFrame(rows, "scan long, mass double, seq string")
    got = sorted(tuple(r) for r in programs.same_sequence_pairs(frame, "scan", "mass", "seq", 10.0, 50.0, "^").collect())
    # 1 begins with A^, so only what begins with A^^ follows it.
    assert got == [(1, 8), (4, 2), (4, 8)]
    assert sorted(tuple(r) for r in programs.same_sequence_pairs(frame, "scan", "mass", "seq", 10.0, 50.0).collect()) == [(1, 2), (1, 8), (4, 2), (4, 3), (4, 8)]


# graphs
def some_edges(rng, n, m):
    return [(rng.randrange(n), rng.randrange(n), float(rng.choice([0, 1, 2, 2, 3, 5, 8]))) for _ in range(m)]


@pytest.mark.parametrize("seed", [1, 2])
def test_searches_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = some_edges(rng, 14, 22) + [(20, 21, 1.0), (21, 20, 4.0), (22, 22, 1.0)]
    frame = spark.createDataFrame(edges, "src long, dst long, weight double")
    nodes = {x for a, b, _ in edges for x in (a, b)}

    reach = {a: {a} for a in nodes}
    for _ in nodes:
        for a, b, _ in edges:
            for k in nodes:
                if a in reach[k]:
                    reach[k].add(b)
    want = {a: min(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}
    got = gs.strong_components(frame).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(nodes)

    once = sorted({(min(a, b), max(a, b)): min(w for x, y, w in edges if {x, y} == {a, b}) for a, b, _ in edges if a != b}.items(), key=lambda e: (e[1], e[0]))
    label, forest = {a: a for a in nodes}, []
    for (a, b), w in once:
        if label[a] != label[b]:
            forest.append((a, b, w))
            label = {k: label[a] if v == label[b] else v for k, v in label.items()}
    assert sorted(tuple(r) for r in gs.spanning_forest(frame).collect()) == sorted(forest)

    used, matching = set(), []
    for (a, b), w in once:
        if not used & {a, b}:
            used |= {a, b}
            matching.append((a, b, w))
    assert sorted(tuple(r) for r in gs.maximal_matching(frame).collect()) == sorted(matching)

    taken = []
    for a in sorted(nodes, key=lambda x: (x * 5 % 7, x)):
        if not any({a, b} in ({x, y} for x, y, _ in edges) for b in taken if b != a):
            taken.append(a)
    assert sorted(r.node for r in gs.independent_set(frame, F.col("node") * 5 % 7).collect()) == sorted(taken)
    free = [r.node for r in gs.independent_set(frame).collect()]
    assert not any(a != b and a in free and b in free for a, b, _ in edges) and all(x in free or any({x, y} == {a, b} for a, b, _ in edges for y in free if y != x) for x in nodes)

    start = min(nodes)
    for width in (0.5, 4.0, 1e9):
        paths = gs.weighted_paths(frame, spark.createDataFrame([(start,)], "node long"), width)
        distance = {start: 0.0}
        for _ in nodes:
            for a, b, w in edges:
                if a in distance:
                    distance[b] = min(distance.get(b, 1e9), distance[a] + w)
        rows = {r.node: r for r in paths.collect()}
        assert {k: r.distance for k, r in rows.items()} == distance
        for k, r in rows.items():
            assert (r.previous is None) == (k == start)
            if k != start:
                assert any(a == r.previous and b == k and distance[a] + w == distance[k] for a, b, w in edges)


def brute_cores(edges):
    near = {}
    for a, b, _ in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    core = {}
    for k in range(len(near) + 1):
        left = set(near)
        while any(len(near[x] & left) < k for x in left):
            left = {x for x in left if len(near[x] & left) >= k}
        core |= dict.fromkeys(left, k)
    return core


@pytest.mark.parametrize("seed", [3, 4])
def test_measures_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = some_edges(rng, 12, 20) + [(30, 31, 1.0), (31, 32, 1.0), (32, 33, 1.0), (40, 40, 1.0), (50, 51, 1.0), (51, 52, 1.0), (52, 50, 2.0)]
    frame = spark.createDataFrame(edges, "src long, dst long, weight double")
    assert {r.node: r.core for r in gs.core_numbers(frame).collect()} == brute_cores(edges) and gs.core_numbers(frame).count() == len(brute_cores(edges))
    cover = {r.node for r in gs.vertex_cover(frame).collect()}
    assert all(a in cover or b in cover for a, b, _ in edges if a != b)
    strong = {r.node: r.component for r in gs.strong_components(frame).collect()}
    leaving = {strong[a] for a, b, _ in edges if strong[a] != strong[b]}
    assert {(r.node, r.component) for r in gs.attracting_components(frame).collect()} == {(n, c) for n, c in strong.items() if c not in leaving}
    once = {(a, b) for a, b, _ in edges}
    h = gs.flow_hierarchy(frame).first()
    assert h.edges == len(once) and h.hierarchy == pytest.approx(sum(strong[a] != strong[b] for a, b in once) / len(once))
    assert not gs.is_acyclic(frame) and gs.is_acyclic(frame.where("src < dst")) and gs.is_acyclic(frame.where("false"))
    rows = {r.node: r for r in gs.two_colouring(frame).collect()}
    assert rows.keys() == set(strong)
    for a, b, _ in edges:
        assert rows[a].component == rows[b].component and (rows[a].colour != rows[b].colour or not rows[a].bipartite)
    assert rows[33].bipartite and [rows[i].colour for i in (30, 31, 32, 33)] == [0, 1, 0, 1] and not rows[40].bipartite and not rows[50].bipartite
    nodes = sorted({x for a, b, _ in edges if a != b for x in (a, b)})
    at = {n: i for i, n in enumerate(nodes)}
    m = np.eye(len(nodes))
    for a, b, _ in edges:
        if a != b:
            m[at[a], at[b]] = m[at[b], at[a]] = 1
    v = np.ones(len(nodes))
    for _ in range(4):
        v = m @ v / np.linalg.norm(m @ v)
    assert {r.node: r.centrality for r in gs.eigenvector_centrality(frame, 4).collect()} == pytest.approx(dict(zip(nodes, v)))


def test_colours_take_no_round_a_step(spark):
    """A path of 300 steps, an even and an odd circle, a loop by itself and one in a pair, and nodes that leave no bit free; no table is broadcast."""
    last = (1 << 63) - 1
    for up in (-1000, last - 1000):
        edges = [(i + 1, i) for i in range(300)] + [(400 + i, 400 + (i + 1) % 6) for i in range(6)] + [(500 + i, 500 + (i + 1) % 5) for i in range(5)] + [(600, 600), (700, 700), (701, 700)]
        frame = spark.createDataFrame([(a + up, b + up) for a, b in edges] + [(up, None), (None, up)], "src long, dst long")
        started = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
        got = gs.two_colouring(frame)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - started < 150
        want = {i + up: (up, i % 2, True) for i in range(301)} | {400 + i + up: (400 + up, i % 2, True) for i in range(6)}
        want |= {500 + i + up: (500 + up, None, False) for i in range(5)} | {600 + up: (600 + up, None, False)} | {i + up: (700 + up, None, False) for i in (700, 701)}
        assert {r.node: (r.component, r.colour, r.bipartite) for r in got.collect()} == want


def test_paths_are_followed_back(spark):
    frame = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 0.5), (9, 1, 1.0)], "src long, dst long, weight double")
    paths = gs.weighted_paths(frame, spark.createDataFrame([(1,)], "node long"), 1.0)
    goals = spark.createDataFrame([(4,), (9,), (1,)], "node long")
    assert sorted(tuple(r) for r in gs.path_to(paths, goals).collect()) == [(1, 0, 1), (4, 0, 4), (4, 1, 3), (4, 2, 2), (4, 3, 1)]
    with pytest.raises(ValueError):
        gs.weighted_paths(frame.withColumn("weight", F.lit(-1.0)), goals, 1.0)


def test_empty_graphs(spark):
    none = spark.createDataFrame([], "src long, dst long, weight double")
    assert gs.strong_components(none).collect() == [] and gs.spanning_forest(none).collect() == [] and gs.independent_set(none).collect() == [] and gs.maximal_matching(none).collect() == []
    assert gs.weighted_paths(none, spark.createDataFrame([(1,)], "node long"), 1.0).collect() == [(1, 0.0, None)]
