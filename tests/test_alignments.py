"""Alignments, chains of tags and features against slow models and planted cases."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from specseq.functions.residues import PROTON, RESIDUES
from specseq.operators import alignments, features

MODS = "mod string, site string, position string, mass double"


def every_alignment(a, b):
    if not a and not b:
        yield "", ""
    if a:
        yield from ((x + a[-1], y + "-") for x, y in every_alignment(a[:-1], b))
    if b:
        yield from ((x + "-", y + b[-1]) for x, y in every_alignment(a, b[:-1]))
    if a and b:
        yield from ((x + a[-1], y + b[-1]) for x, y in every_alignment(a[:-1], b[:-1]))


def worth(top, bottom, match, mismatch, opening, extending, table):
    score = 0.0
    for x, y in zip(top, bottom):
        if "-" not in (x, y):
            score += table.get((x, y), match if x == y else mismatch)
    for row in (top, bottom):
        score += sum(opening + extending * len(list(g)) for dash, g in itertools.groupby(row, lambda c: c == "-") if dash)
    return score


def test_affine_alignments_are_best(spark):
    rng = np.random.default_rng(5)
    pairs = [(i, *("".join(rng.choice(list("ABC"), rng.integers(0, 5))) for _ in "ab")) for i in range(60)] + [(90, None, "A"), (91, "A", None), (92, "", ""), (93, "AB" * 40, "BA" * 30)]
    rows = spark.createDataFrame(pairs, "k long, a string, b string")
    table = {("A", "B"): 0.5}
    for cells in (1, 4_000_000):
        got = {r.k: r for r in alignments.affine_alignments(rows, "a", "b", 2.0, -1.0, -1.5, -0.5, table, cells).collect()}
        assert len(got) == len(pairs)
        for k, a, b in pairs:
            g = got[k]
            if a is None or b is None:
                assert (g.score, g.a_row, g.b_row) == (None, None, None)
                continue
            assert g.a_row.replace("-", "") == a and g.b_row.replace("-", "") == b and len(g.a_row) == len(g.b_row)
            assert abs(worth(g.a_row, g.b_row, 2.0, -1.0, -1.5, -0.5, table) - g.score) < 1e-9
            if len(a) + len(b) < 10:
                assert abs(max(worth(*x, 2.0, -1.0, -1.5, -0.5, table) for x in every_alignment(a, b)) - g.score) < 1e-9


def test_differing_regions(spark):
    rows = spark.createDataFrame([(1, "AC-DEF", "ACGDXF"), (2, "AC", "AC"), (3, "--A", "CCA"), (4, None, None)], "k long, a_row string, b_row string")
    got = sorted(tuple(r) for r in alignments.differing_regions(rows, "k").select("k", "start", "end", "a_from", "a_to", "b_from", "b_to").collect())
    assert got == [(1, 2, 3, 2, 2, 2, 3), (1, 4, 5, 3, 4, 4, 5), (3, 0, 2, 0, 0, 0, 2)]


def chains(spark, pairs, mods=(), **how):
    rows = spark.createDataFrame(pairs, "k long, a string, b string")
    known = spark.createDataFrame(list(mods), MODS)
    return {r.k: r for r in alignments.tag_alignments(rows, "k", "a", "b", known, F.array_repeat(F.lit(1.0), F.length("a") + 1), **how).collect()}


def test_planted_changes_are_named(spark):
    shift = RESIDUES["W"] - RESIDUES["S"]
    mods = [("swap", "S", "Anywhere", shift), ("head", "N-term", "N-term", RESIDUES["G"]), ("never", "P", "C-term", shift)]
    pairs = [
        (1, "PEPTIDEK", "AAPEPTIDEKAA"),  # the whole as one tag within the reference
        (2, "PEPWIDEK", "PEPSIDEK"),  # a modified residue
        (3, "PEPNIDEK", "PEPGGIDEK"),  # N weighs as much as GG
        (4, "PEPWIDEK", "PEPYIDEK"),  # a shift that nothing explains
        (5, "PEPFFFIDEK", "PEPIDEK"),  # inserted residues
        (6, "AAAA", "CCCC"), (7, None, "PEP"), (8, "", ""), (9, "GAPEPT", "APEPT"),
    ]
    got = chains(spark, pairs, mods)
    changes = {k: [(s.change, s.mods, s.a_part, s.b_part) for s in r.steps] for k, r in got.items()}
    assert set(got) == {1, 2, 3, 4, 5, 9}
    assert (got[1].b_from, got[1].b_to) == (2, 10) and [c[0] for c in changes[1]] == ["none", "none"]
    assert changes[2][1] == ("modified", ["swap"], "W", "S") and abs(got[2].steps[1].shift - shift) < 1e-9
    assert changes[3][1] == ("isobaric", None, "N", "GG")
    assert changes[4][0][:3] == ("insertion", None, "PEPW")  # as each place of it is worth 1
    dear = chains(spark, [pairs[3]], mods, penalties={**alignments.PENALTIES, "insertion": -9.0})[4].steps[1]
    assert (dear.change, dear.a_part, dear.b_part) == ("undefined", "W", "Y")
    assert changes[5][1] == ("insertion", None, "FFF", "")
    assert changes[9][0][0] == "insertion"  # nothing of the reference is left before the tag
    assert chains(spark, [(1, "A", "A")]) == {}


def test_chains_equal_all_chains(spark):
    rng = np.random.default_rng(8)
    pairs = [(i, *("".join(rng.choice(list("GASP"), rng.integers(4, 10))) for _ in "ab")) for i in range(25)]
    rows, none = spark.createDataFrame(pairs, "k long, a string, b string"), spark.createDataFrame([], MODS)
    tags = {}
    for r in alignments.shared_tags(rows, "k", "a", "b", 2).collect():
        tags.setdefault(r.k, []).append(r)
    got = chains(spark, pairs)
    assert none.count() == 0 and set(got) == set(tags)
    total = lambda s: sum(RESIDUES[c] for c in s)

    def cost(x, y):
        if not x and not y:
            return 0.0
        if not y:
            return -2.0 + max(len(x) - 1, 0)
        return 0.0 if not x else -0.5 if abs(total(x) - total(y)) < 0.02 else -3.0

    for k, a, b in pairs:
        best = -np.inf
        for n in range(1, len(tags.get(k, ())) + 1):
            for chain in itertools.combinations(tags.get(k, ()), n):
                if all(p.a_end <= q.a_start and p.b_end <= q.b_start for p, q in itertools.pairwise(chain)):
                    own = sum(min(t.a_end, len(a) - 1) - max(t.a_start, 1) + 1 for t in chain) + sum(cost(a[p.a_end : q.a_start], b[p.b_end : q.b_start]) for p, q in itertools.pairwise(chain))
                    head = max(cost(a[: chain[0].a_start], b[i : chain[0].b_start]) for i in range(chain[0].b_start + 1))
                    tail = max(cost(a[chain[-1].a_end :], b[chain[-1].b_end : i]) for i in range(chain[-1].b_end, len(b) + 1))
                    best = max(best, own + head + tail)
        assert k not in tags or abs(got[k].score - best) < 1e-9


def test_greedy_and_marked(spark):
    rows = spark.createDataFrame([(1, "PEPTIDEKWPEP", "PEPTIDEXPEP"), (2, "AAA", "CCC")], "k long, a string, b string")
    greedy = alignments.greedy_tags(alignments.shared_tags(rows, "k", "a", "b", 3), "k")
    assert sorted((r.a_start, r.a_end, r.b_start, r.b_end) for r in greedy.collect()) == [(0, 7, 0, 7), (9, 12, 8, 11)]
    got = {r.k: (r.a, r.b) for r in alignments.marked(rows, greedy, "k", "a", "b").collect()}
    assert got == {1: ("*PEPTIDE*KW*PEP*", "*PEPTIDE*X*PEP*"), 2: ("AAA", "CCC")}


def test_features_of_a_made_up_match(spark):
    masses = np.cumsum([RESIDUES[c] for c in "SAMPLE".replace("L", "I")])
    ladder = spark.createDataFrame([(1, i, float(m), float(masses[-1])) for i, m in enumerate(masses[:-1])], "scan long, place int, prm double, total double")
    peaks = spark.createDataFrame([(1, i, float(m) + PROTON + 0.01 * i, 10.0) for i, m in enumerate(masses[:-1])] + [(1, 50, 5000.0, 50.0)], "scan long, peak long, mz double, intensity double")
    shown = features.annotated(features.fragment_ions(ladder, ["b", "y"]), peaks, 0.1)
    counts = {(r.scan, r.ion): r.n for r in features.ion_counts(shown).collect()}
    assert counts[1, "b"] == 5
    stats = features.annotation_stats(shown, peaks, ladder.where("place < 2"), 9.0, (1, 3)).first()
    assert abs(stats.explained - 0.5) < 1e-9 and (stats.top_1, stats.top_3) == (0, 2) and stats.paired_3 == 2
    assert abs(stats.mean_b - 0.02) < 1e-6 and abs(stats.max_b - 0.04) < 1e-6 and abs(stats.max_rel_b - 0.01) < 1e-6
    nothing = features.annotation_stats(shown.limit(0), peaks, ladder.limit(0), 9.0).first()
    assert nothing.explained == 0.0 and nothing.mean_b == nothing.max_rel_y == 9.0 and nothing.top_25 == 0
    assert features.annotated(features.fragment_ions(ladder.limit(0), ["b"]), peaks, 0.1).count() == 0
    forbidden = spark.range(1).select(features.forbidden_pairs(F.array(F.lit(100.0), F.lit(300.0), F.lit(777.0)), F.lit(400.0 + PROTON), 5.0), features.forbidden_pairs(F.array().cast("array<double>"), F.lit(0.0), 5.0)).first()
    assert tuple(forbidden) == (1, 0)
