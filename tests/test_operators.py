"""Operators on small tables whose results were worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from specseq.functions import residues
from specseq.operators import compare, graphs, ranges, scores, sequences, spectra


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_gap_clusters(spark):
    df = spark.createDataFrame([(1, 1000.0), (2, 1000.004), (3, 1000.010), (4, 1500.0)], "k int, m double")
    assert rows(ranges.gap_clusters(df, "k", "m", 5.0).select("k", "cluster_id")) == [(1, 1), (2, 1), (3, 2), (4, 3)]
    assert rows(ranges.gap_clusters(df.where("k = 1"), "k", "m", 5.0).select("k", "cluster_id")) == [(1, 1)]
    assert rows(ranges.gap_clusters(df.limit(0), "k", "m", 5.0)) == []


def test_clusters_reach_over_buckets(spark):
    df = spark.createDataFrame([(1, 999.999), (2, 1000.001), (3, 2500.0)], "k int, m double")
    assert rows(ranges.gap_clusters(df, "k", "m", 5.0).select("k", "cluster_id")) == [(1, 1), (2, 1), (3, 2)]


def test_delta_pairs(spark):
    df = spark.createDataFrame([(1, 1000.0), (2, 1006.0377), (3, 1006.1), (4, None)], "k int, m double")
    assert [(r.light, r.heavy) for r in ranges.delta_pairs(df, "k", "m", 6.03766, 0.005).collect()] == [(1, 2)]
    assert [(r.light, r.heavy) for r in ranges.delta_pairs_ppm(df, "k", "m", 6.03766, 5.0).collect()] == [(1, 2)]
    assert rows(ranges.unpaired(df, "k", "m", 6.03766, 0.005).select("k")) == [(3,), (4,)]


@pytest.mark.parametrize("ppm", [5.0, 400.0, 20000.0])
def test_ppm_pairs_equal_all_pairs(spark, ppm):
    rng = random.Random(ppm)
    values = [(i, rng.choice([rng.uniform(0, 50), rng.uniform(50, 5000)])) for i in range(150)]
    got = {(r.light, r.heavy) for r in ranges.delta_pairs_ppm(spark.createDataFrame(values, "k int, m double"), "k", "m", 6.0, ppm).collect()}
    want = {(i, j) for i, a in values for j, b in values if a > 0 and b > 0 and abs(b - a - 6.0) < ppm * 1e-6 * b}
    assert got == want


def test_merge_and_bins(spark):
    peaks = spark.createDataFrame([(1, 1, 100.0, 10.0), (2, 1, 100.004, 30.0)], "scan int, peak int, mz double, intensity double").withColumn("g", F.lit(1))
    [m] = spectra.merge_spectra(peaks, "g", 0.02).collect()
    assert (round(m.mz, 6), m.intensity, m.n_spec) == (100.002, 40.0, 2)
    four = spark.createDataFrame([(1, i, 1.0, x) for i, x in enumerate([50.0, 40.0, 9.0, 1.0])], "scan int, peak int, mz double, intensity double")
    assert [r.bin for r in spectra.log_tic_bin(four, 5).orderBy("peak").collect()] == [4, 4, 3, 2]


def test_ladder_and_translation(spark):
    df = spark.createDataFrame([("GAG", "ATGAAATAGC"), ("", "AT"), (None, None)], "s string, d string")
    got = df.select(residues.ladder(F.col("s")).alias("l"), residues.translated(F.col("d"), 0).alias("t")).collect()
    assert [round(x, 5) for x in got[0].l] == [57.02146, 128.05857] and got[0].t == "MK*"
    assert got[1].l == [] and got[1].t == ""


def test_sweeps(spark):
    df = spark.createDataFrame([(3.0, True), (2.0, True), (0.0, False)], "s double, t boolean")
    swept = compare.sweep(df, "s", "t", 4)
    assert [(r.tp, r.fp) for r in swept.orderBy("cutoff_no").collect()] == [(2, 1), (2, 0), (2, 0), (1, 0)]
    assert math.isclose(compare.fdr(swept).orderBy("cutoff_no").first().fdr, 1 / 3)
    assert compare.roc(swept).orderBy(F.desc("cutoff_no")).first().precision == 1.0


def test_min_max_and_node_score(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    assert [r.scaled for r in scores.min_max(df, "x").orderBy("x").collect()] == [-1.0, 0.0, 1.0]
    assert math.isclose(df.select(scores.node_score(F.lit(0.5), F.lit(0.5), F.lit(0.5)).alias("s")).first().s, 3 * math.log(0.5))


def test_runs_and_pairs(spark):
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, True, False, True])], "k int, i int, f boolean")
    assert rows(sequences.flag_runs(df, "k", ["i"], "f")) == [(1, 0, 2), (1, 3, 4)]
    near = spark.createDataFrame([(1, i, v) for i, v in [(0, 1.0), (1, 1.1), (2, 1.2), (3, 1.3), (4, 9.0), (6, 9.0), (7, 9.0), (8, 9.0)]], "g int, i int, v double")
    assert rows(sequences.consecutive_pairs(near, "g", "i", "v", 10000.0)) == [(1, 0, 1), (1, 2, 3), (1, 6, 7)]
    assert rows(sequences.consecutive_pairs(near.limit(0), "g", "i", "v", 10000.0)) == []


def test_site_classes(spark):
    """All 400 pairs of residues (J is among the classes, I isn't)."""
    want = {}
    for b in "ACDEFGHJKMNPQRSTVWYI":
        for a in "ACDEFGHJKMNPQRSTVWYI":
            hits = [n for n, hit in enumerate([a == "P", b == "P", a == "G", b == "G", a in "RK", b == "H", a == "H", b in "DE", a in "DE", b in "JV", a in "JV", b in "ST", a in "ST", b == "N", a == "N"]) if hit]
            want[b, a] = 15 if a + b in ("PP", "GG") else min(hits, default=15)
    df = spark.createDataFrame(list(want), "b string, a string")
    assert {(r.b, r.a): r.c for r in df.select("b", "a", residues.amino_class(F.col("b"), F.col("a")).alias("c")).collect()} == want
    assert (want["P", "P"], want["A", "P"], want["G", "P"], want["P", "G"], want["A", "K"], want["K", "A"], want["S", "D"], want["A", "N"]) == (15, 0, 0, 1, 4, 15, 8, 14)


def test_residue_strings_of_any_length(spark):
    want, level = {}, {"": 0.0}
    while level:
        level = {s + c: m + x for s, m in level.items() for c, x in residues.RESIDUES.items() if m + x < 400}
        want |= level
    got = dict(rows(sequences.residue_strings(residues.residue_table(spark), 400.0)))
    assert len(want) == 23956 and max(map(len, want)) == 7 and got == pytest.approx(want)
    assert len(rows(sequences.residue_strings(residues.residue_table(spark), 400.0, 2))) == 380
    assert rows(sequences.residue_strings(residues.residue_table(spark).limit(0), 400.0)) == []


def test_small_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (8, 9), (8, 9)], "src long, dst long")
    assert rows(graphs.triangles(e)) == [(1, 1), (2, 1), (3, 1)]
    assert rows(graphs.components(e)) == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)]
    assert rows(graphs.k_core(e, 2)) == [(1,), (2,), (3,)]
    assert rows(graphs.longest_paths(e)) == [(1, 0), (2, 1), (3, 2), (4, 3), (8, 0), (9, 1)]
    with pytest.raises(ValueError):
        graphs.longest_paths(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))
    assert graphs.components(e.limit(0)).count() == 0


def test_tolerance_joins_are_hash_joins(spark):
    df = spark.range(1000).selectExpr("id k", "cast(id as double) m")
    plan = ranges.delta_pairs(df, "k", "m", 10.0, 0.5)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
