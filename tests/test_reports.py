"""Files of results, written and read back; scores of given peptides; training rows."""

import math

import pytest
from pyspark.sql import functions as F

from specseq.functions.residues import RESIDUES
from specseq.operators import rescoring, training
from specseq.sources import formats, reports


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A\"B", [1, 2], 0.5), (2, None, None, None)], "k long, s string, l array<int>, x double")
    reports.write_table(rows, str(tmp_path / "t"), {"k": "Scan", "l": "List", "s": "Text", "x": "Score"})
    got = reports.read_table(spark, str(tmp_path / "t"))
    assert got.columns == ["Scan", "List", "Text", "Score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([("1", "[1, 2]", "A\"B", "0.5"), ("2", None, None, None)], key=repr)
    hits = spark.createDataFrame([("q", ["r"], 5, 0.1, 1, 9, 8, 9, 0, 0, 9)], "qid string, references array<string>, score int, e_value double, q_start int, q_end int, identical int, positive int, q_gaps int, s_gaps int, length int")
    peptides = spark.createDataFrame([("q", "A*", "A", "[]"), ("z", "B", "B", "[]")], "qid string, peptide string, plain string, ambiguous string")
    reports.write_table(reports.blast_table(hits, peptides), str(tmp_path / "b"), reports.ALIGNMENT)
    back = reports.read_table(spark, str(tmp_path / "b")).collect()
    assert len(back) == 1 and back[0]["References"] == "[r]" and back[0]["Alignment Length"] == "9"
    fasta = reports.fasta_lines(spark.createDataFrame([(1, "AG", 0), (2, "AG", 2), (3, "None", 0), (4, None, 0)], "k long, s string, n int"), "k", "s", "n")
    assert [r.value for r in fasta.collect()] == [">1\nAG"]


def test_counts_of_a_sweep_and_histograms(spark):
    sweep = spark.createDataFrame([(0.0, 1.0), (1.5, 0.5), (3.0, 0.1), (9.0, 0.0)], "cut double, fdr double")
    scores = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 2.0, 3.0, -1.0)], "score double")
    got = {r.cut: (r.results, r.all_results) for r in reports.sweep_counts(sweep, "cut", scores, scores.unionByName(scores)).collect()}
    assert got == {0.0: (5, 10), 1.5: (3, 6), 3.0: (1, 2), 9.0: (0, 0)}
    assert {r.all_results for r in reports.sweep_counts(sweep, "cut", scores).collect()} == {None}
    rows = spark.createDataFrame([("a", x) for x in (0.0, 0.1, 0.3, 0.99, 1.0, 1.2, None)] + [("b", None)], "g string, x double")
    h = {(r.g, r.bin): r["count"] for r in reports.histogram(rows, "x", ["g"]).collect()}
    assert len(h) == 20 and h["a", 0.0] == 1 and h["a", 0.1] == 1 and h["a", 0.3] == 1 and h["a", 0.9] == 2 and sum(n for (g, _), n in h.items() if g == "b") == 0
    stats = spark.createDataFrame([("p", 0.5, 1.0), ("p", 1.0, None), ("q", None, None)], "program string, accuracy double, precision double")
    assert {tuple(r) for r in reports.category_table(stats).collect()} == {("p", 2, 0.75, 1.0), ("q", 1, None, None)}
    tested = spark.createDataFrame([(i, 0) for i in range(10)] + [(10, 0)], "light long, heavy long")
    true = spark.createDataFrame([(5, 0), (50, 0), (-9, 0)], "light long, heavy long")
    d = {r.bin: (r.low, r.n_tested, r.n_true) for r in reports.pair_distribution(true, tested, 5).collect()}
    assert d == {0: (0, 2, 1), 1: (2, 2, 0), 2: (4, 2, 1), 3: (6, 2, 0), 4: (8, 3, 1)}
    assert reports.pair_distribution(true, tested.where("false"), 5).collect() == []


def test_models_and_logs(spark, tmp_path):
    model = spark.createDataFrame([(1.0, 0.25, -0.5, [(-0.5, [1.0, 0.0]), (0.5, [0.125, -2.0])])], "c double, gamma double, bias double, support array<struct<coef: double, sv: array<double>>>")
    lines = [r.value for r in reports.svm_model_lines(model).orderBy("line").collect()]
    assert lines[-3:] == ["SV", "0.5 1:0.125 2:-2.0", "-0.5 1:1.0"] and "rho 0.5" in lines and "nr_sv 1 1" in lines
    (tmp_path / "m").write_text("\n".join(lines) + "\n")
    back = reports.read_svm_model(spark, str(tmp_path / "m"), 2).first()
    assert back.gamma == 0.25 and back.bias == -0.5 and [(s.coef, s.sv) for s in back.support] == [(0.5, [0.125, -2.0]), (-0.5, [1.0, 0.0])]
    (tmp_path / "r").write_text("1,a,b,c,d,0.98 0.02\n2,a,b,c,d,0.97 0.03\nbroken\n")
    assert {r.carbons: r.ratios for r in reports.read_ratios(spark, str(tmp_path / "r")).collect()} == {1: [0.98, 0.02], 2: [0.97, 0.03]}
    (tmp_path / "l").write_text("start\nscans [1, 2] [3] shared peaks ratio 0.4\n\nScore: 12.5  Seq: AGK\nScore: -3  Seq: PP\nother\nscans [7] shared peaks ratio 0.1\n")
    got = reports.read_sequencing_log(spark, str(tmp_path / "l")).orderBy("place").collect()
    assert [(r.scans, r.place, r.peptide, r.score) for r in got] == [(["[1, 2]", "[3]"], 0, "AGK", 12.5), (["[1, 2]", "[3]"], 1, "PP", -3.0)]


def test_maps_and_sections():
    own = reports.sequence_map("own", ["A", "I"], {}, {"#": "oxidation"}, {"oxidation": "*"}, native=True)
    other = reports.sequence_map("other", ["A", "I"], {"X": "I"}, {"#": "oxidation", "^": "label"}, {"oxidation": "static"})
    assert own == {"letters": {"-": "X", "A": "A", "I": "I"}, "signs": {"*": "#"}, "static": {}}
    assert other == {"letters": {"L": "I", "A": "A", "I": "I", "X": "I"}, "signs": {}, "static": {"oxidation": "#"}}
    p = formats.read_parameters("[Columns]\nscore = PScore x\n[Models]\nlight = a.cfg a.model\n[Cluster Configuration]\nmodel = svm.model\n[Static Mods]\nk = C 57.0\n")
    assert p.columns == {"score": "PScore"} and p.models == {"light": ("a.cfg", "a.model")} and p.clusters == {"model": "svm.model"} and p.others == {"Static Mods": {"k": ("C", "57.0")}}


def test_peptide_nodes_and_scores(spark):
    rows = spark.createDataFrame([(1, "AGX", [100.0], 300.0), (2, "A", None, 90.0), (3, "AX", None, 90.0), (4, "AbG", None, 90.0), (5, "", None, 1.0), (6, None, None, 1.0), (7, "XGX", [50.0, 60.0], 200.0)], "scan long, sequence string, mods array<double>, total double")
    got = {(r.scan, r.place): (round(r.prm, 5), r.before, r.after) for r in rescoring.peptide_nodes(rows).collect()}
    a, g = RESIDUES["A"], RESIDUES["G"]
    assert got == {(1, 1): (a, "A", "G"), (1, 2): (round(a + g, 5), "G", "X"), (7, 1): (50.0, "X", "G"), (7, 2): (round(50 + g, 5), "G", "X")}
    nodes = spark.createDataFrame([(1, 1, "A", "G", 1, 0, 0.1), (1, 2, "G", "K", 2, 0, 0.9), (2, 1, "A", "P", 1, 3, 0.5), (2, 2, "P", "K", 1, 3, 0.0)], "scan long, place int, before string, after string, y int, site int, noise double")
    network = {"y": ["site"]}
    tables = rescoring.trained_network(nodes, network)
    chance = {(r.scan, r.place): r.c for r in rescoring.network_chance(nodes, network, tables, "c").collect()}
    assert chance == {(1, 1): 0.5, (1, 2): 0.5, (2, 1): 0.75, (2, 2): 0.75}
    unknown = nodes.withColumn("site", F.lit(9))
    assert {r.c for r in rescoring.network_chance(unknown, network, tables, "c").collect()} == {1.0}
    scored = rescoring.scored_nodes(nodes, network, {}, tables)
    s = {(r.scan, r.place): r.s for r in scored.collect()}
    assert s == {(1, 1): pytest.approx(math.log(5)), (1, 2): pytest.approx(3 * math.log(0.5 / 0.9)), (2, 1): pytest.approx(math.log(1.5))}
    peptides = spark.createDataFrame([(1, "AGK"), (2, "APX")], "scan long, sequence string")
    priors = {r.letter: (r.first, r.last) for r in rescoring.end_priors(peptides).collect()}
    assert priors["A"] == pytest.approx((math.log(3 / 5), math.log(1 / 5))) and priors["K"] == pytest.approx((math.log(1 / 5), math.log(2 / 5)))
    scores = {r.scan: (r.nodes, r.score) for r in rescoring.peptide_scores(scored, peptides, rescoring.end_priors(peptides), 20.0).collect()}
    assert scores[1] == (2, pytest.approx(math.log(5) + 3 * math.log(0.5 / 0.9) + math.log(3 / 5) + math.log(2 / 5))) and scores[2][1] == pytest.approx(math.log(1.5) + math.log(3 / 5) + math.log(2 / 5) - 20)
    sure = {(r.scan, r.residue): (r.letter, r.confidence) for r in rescoring.residue_confidence(scored).collect()}
    assert sure == {(1, 0): ("A", 1.0), (1, 1): ("G", 0.5), (1, 2): ("K", 0.5), (2, 0): ("A", 1.0), (2, 1): ("P", 1.0)}


def test_training_rows(spark):
    scans = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, 7, "a"), (4, 7, None), (5, 8, "a")], "scan long, c long, answer string")
    assert sorted(tuple(r) for r in training.cluster_training_pairs(scans, "scan", "c", "answer").collect()) == [(1, 2, -1), (1, 3, 1), (2, 3, -1)]
    pairs = spark.createDataFrame([(7, 8), (8, 7), (7, 99)], "light long, heavy long")
    got = training.pair_training_pairs(pairs, scans.withColumnRenamed("c", "cluster"), "answer")
    assert sorted(tuple(r) for r in got.collect()) == [(7, 8, "a", "a", 2, 1, 1), (7, 8, "b", "a", 1, 1, -1), (8, 7, "a", "a", 1, 2, 1), (8, 7, "a", "b", 1, 1, -1)]
    rows = spark.createDataFrame([(1, "A", 5.0), (2, "A", 1.0), (3, "A", 2.0), (4, "A", 2.0)], "scan long, program string, score double")
    engine = spark.createDataFrame([(1, 1.0), (2, 9.0), (3, 2.4)], "scan long, score double")
    assert [tuple(r) for r in training.score_agreement(rows, engine).collect()] == [("A", 1, 1, 1, 1)]
    none = scans.limit(0)
    r = training.pair_confusion(none, "c", "answer", "scan").first()
    assert (r.tp, r.fp, r.fn, r.tn, r.sensitivity, r.precision) == (0, 0, 0, 0, 100, 100)
    looked = spark.createDataFrame([(1, 1, "x", "t"), (2, 1, "x", "t"), (3, 1, "y", "t"), (4, 1, "x", "u"), (5, 2, "x", "t")], "scan long, m long, p string, t string")
    r = training.pair_confusion(looked, "m", "p", "t").first()
    # Looked at: six pairs of 1 to 4; taken 12, 14, 24; true 12, 13, 23, and never looked at 15, 25, 35.
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 2, 5, 1) and r.precision == pytest.approx(100 / 3) and r.sensitivity == pytest.approx(100 / 6)
    table, names = training.feature_rows([("a", spark.createDataFrame([(1, 2, 3.0)], "k long, x int, y double")), ("b", spark.createDataFrame([(2, True)], "k long, z boolean"))], "k")
    assert names == ["a.x", "a.y", "b.z"] and {r.k: r.features for r in table.collect()} == {1: [2.0, 3.0, 0.0], 2: [0.0, 0.0, 1.0]}
