"""File formats, and kernels against slow models."""

import base64
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from specseq.operators import kernels
from specseq.sources import formats


def test_dta(spark, tmp_path):
    (tmp_path / "run.0012.0012.2.dta").write_text("1000.5\t2\n100.1\t5\n99.5 7\nbad line\n\n")
    (tmp_path / "run.0013.0013.1.dta").write_text("")
    got = {r.scan: r for r in formats.read_dta(spark, str(tmp_path)).collect()}
    assert got[12].prec_mh == 1000.5 and got[12].charge == 2 and [tuple(p) for p in got[12].peaks] == [(100.1, 5.0), (99.5, 7.0)]
    assert 13 not in got or got[13].peaks == []
    text = formats.read_dta(spark, str(tmp_path)).where("scan = 12").select(formats.dta_text(2).alias("t")).first().t
    assert text == "1000.5\t1\n99.5\t7.0\n100.1\t5.0"
    assert formats.read_dta(spark, str(tmp_path)).where("scan = 12").select(formats.dta_text().alias("t")).first().t is None


def test_stream_of_scans(spark, tmp_path):
    from specseq.streaming.scans import new_scans

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "run.0001.0001.1.dta").write_text("5\t1\n1 2\n")
    (folder / "again.0001.0001.1.dta").write_text("6\t1\n1 2\n")
    (folder / "run.0002.0002.1.dta").write_text("7\t1\n1 2\n")
    query = new_scans(spark, str(folder)).writeStream.format("memory").queryName("scans").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.scan for r in spark.table("scans").collect()) == [1, 2]


def test_mzxml(spark, tmp_path):
    data = base64.b64encode(np.array([100.5, 7.25, 200.25, 3.5], ">f4").tobytes()).decode()
    scan = '<scan num="{}" msLevel="{}"><precursorMz precursorCharge="2">500.5</precursorMz><peaks precision="32">{}</peaks></scan>'
    (tmp_path / "a.mzXML").write_text("<msRun>" + scan.format(1, 1, data) + scan.format(2, 2, data) + "</msRun>")
    [r] = formats.read_mzxml(spark, str(tmp_path)).collect()
    assert r.scan == 2 and abs(r.prec_mh - (1001 - formats.PROTON)) < 1e-9 and [tuple(p) for p in r.peaks] == [(100.5, 7.25), (200.25, 3.5)]


def test_fasta_and_blast(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">a b\nMKV\nLL\n>" + "n" * 70 + "\nGG\n")
    got = {r.name: r.sequence for r in formats.read_fasta(spark, str(tmp_path / "x.fasta")).collect()}
    assert got == {"a b": "MKVLL", "n" * 63 + "...": "GG"}
    line = "\t".join(["q1", "{}", "{}", "1", "9", "{}"] + ["0"] * 16)
    (tmp_path / "b.tsv").write_text("\n".join([line.format("r1", 0.5, 50), line.format("r2", 0.1, 50), line.format("r3", 0.01, 40)]))
    [hit] = formats.best_hits(formats.read_blast(spark, str(tmp_path / "b.tsv"))).collect()
    assert hit.references == ["r1", "r2"] and hit.E == 0.1


def test_parameters_and_libsvm(spark):
    p = formats.read_parameters("[Parameters]\nalpha = 0.8\n[Pair Configurations]\nx = 0 0 6.03766 0 # *\n[Enzyme]\nspecificity = K|R;.* D;P\n")
    assert p.alpha == 0.8 and p.maxedge == 500 and p.pairs[0].n_mod == 6.03766 and p.enzyme == (("K", ".*"), ("R", ".*"), ("D", "P"))
    p = formats.read_parameters("[Some Parameters]\nppmstd = 7 ppm\n[Pair Configurations]\nx = 0 0 6 0 None * m.model\n[Models]\nm = a.cfg a.model\n[Diff Mods]\n# = oxidation M 15.9949\n* = silac K 8\n")
    assert p.ppmstd == 7 and p.pairs[0].n_symbol == "" and p.pairs[0].c_symbol == "*" and p.pairs[0].model == "m.model" and p.models == {"m": ("a.cfg", "a.model")} and p.others["Diff Mods"]["*"] == ("silac", "K", "8")
    row = spark.range(1).select(formats.libsvm_line(F.lit(1), [F.lit(2.5), F.lit(None).cast("double"), F.lit(3)], F.lit("c")).alias("l")).first()
    assert row.l == "1 1:2.5 3:3 # c"


def test_tables_matrices_and_ranges(spark, tmp_path):
    (tmp_path / "r.csv").write_text("made by x\nScanF,Peptide,Score\n1,AK,0.5\n2,\"A,G\",1\n")
    assert [tuple(r) for r in formats.read_scans(spark, str(tmp_path / "r.csv"), ["Score", "Peptide"], skip=1).collect()] == [("0.5", "AK"), ("1", "A,G")]
    (tmp_path / "s.csv").write_text("a b\tc\n1\t2\n")
    assert [tuple(r) for r in formats.read_scans(spark, str(tmp_path / "s.csv"), sep="\t").collect()] == [("1", "2")]
    assert formats.line_counts(spark, str(tmp_path / "s.csv")).first().lines == 2
    (tmp_path / "m.txt").write_text("# note\n   A  R\nA  4 -1\nR -1  5\n")
    assert {(r.a, r.b): r.score for r in formats.read_scoring_matrix(spark, str(tmp_path / "m.txt")).collect()} == {("A", "A"): 4, ("A", "R"): -1, ("R", "A"): -1, ("R", "R"): 5}
    (tmp_path / "x.svm").write_text("1 1:2.5 3:-1 # c\n\n-1 3:4\n2\n")
    rows = formats.read_libsvm(spark, str(tmp_path / "x.svm"))
    assert [(r.label, r.features) for r in rows.collect()] == [(1.0, {1: 2.5, 3: -1.0}), (-1.0, {3: 4.0}), (2.0, {})]
    formats.range_lines(formats.feature_ranges(rows)).write.text(str(tmp_path / "ranges"))
    assert sorted(tuple(r) for r in formats.read_ranges(spark, str(tmp_path / "ranges")).collect()) == [(1, 2.5, 2.5), (3, -1.0, 4.0)]


def test_linkage_by_pieces_is_linkage_of_the_group(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.choice([rng.uniform(0, 40), rng.uniform(0, 4000)])) for g in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "g long, k long, v double")
    got = {(r.g, r.k): (r.single, r.complete) for r in kernels.linkage_clusters(df, "g", "k", "v", 20.0).collect()}
    average = {(r.g, r.k): r.cluster for r in kernels.agglomerative_clusters(df, "g", "k", "v", 100.0, 0.8).collect()}
    for g in range(3):
        own = sorted((v, k) for h, k, v in rows if h == g)
        values = np.array([v for v, _ in own])
        want = list(zip(kernels.linkage_1d(values, 20.0, False).tolist(), kernels.linkage_1d(values, 20.0, True).tolist(), strict=True))
        assert [got[g, k] for _, k in own] == want
        assert [average[g, k] for _, k in own] == kernels.average_linkage(1 - np.abs(values[:, None] - values) / 100.0, 0.8).tolist()
    assert kernels.linkage_clusters(df.limit(0), "g", "k", "v", 20.0).count() == 0


def test_average_linkage_and_1d():
    s = np.array([[1, 0.9, 0.1], [0.9, 1, 0.3], [0.1, 0.3, 1]])
    assert kernels.average_linkage(s, 0.5).tolist() == [0, 0, 1]
    assert kernels.average_linkage(s, 0.2).tolist() == [0, 0, 0]
    v = np.array([1.0, 1.015, 1.03, 5.0])
    assert kernels.linkage_1d(v, 0.02, True).tolist() == [0, 0, 1, 2] and kernels.linkage_1d(v, 0.02, False).tolist() == [0, 0, 0, 1]


def slow_affine(a, b, opening=-2.0, extending=-0.5):
    from functools import lru_cache

    @lru_cache(None)
    def go(i, j, gap):
        if i == len(a) and j == len(b):
            return 0.0
        out = [-1e18]
        if i < len(a) and j < len(b):
            out.append((1.0 if a[i] == b[j] else -1.0) + go(i + 1, j + 1, 0))
        if i < len(a):
            out.append((extending if gap == 1 else opening) + go(i + 1, j, 1))
        if j < len(b):
            out.append((extending if gap == 2 else opening) + go(i, j + 1, 2))
        return max(out)

    return go(0, 0, 0)


def test_alignments():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ("".join(rng.choice("AGP") for _ in range(rng.randint(0, 7))) for _ in range(2))
        assert kernels.affine_score(a, b) == pytest.approx(slow_affine(a, b))
        subs = [a[i:j] for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b]
        assert len(kernels.longest_common(a, b)) == max(map(len, subs), default=0)


def all_paths(mass, low, high):
    n = len(mass)
    for k in range(n - 1):
        for inner in itertools.combinations(range(1, n - 1), k):
            p = [0, *inner, n - 1]
            if all(low <= mass[b] - mass[a] <= high for a, b in itertools.pairwise(p)):
                yield p


def test_paths_against_all_paths():
    rng = random.Random(8)
    for _ in range(60):
        inner = sorted(rng.uniform(1, 19) for _ in range(rng.randint(1, 7)))
        mass = np.array([0.0, *inner, 20.0])
        score = np.array([0.0, *[rng.randint(1, 9) for _ in inner], 0.0])
        every = [(score[p].sum(), p) for p in all_paths(mass, 1.0, 9.0)]
        got = kernels.best_paths(mass, score, 1.0, 9.0, 0.8, most=1000)
        best = max((s for s, _ in every), default=None)
        assert sorted(p for _, p in got) == sorted(p for s, p in every if s >= 0.8 * best - 1e-9) if every else got == []
        clash = lambda p: any(abs(mass[a] + mass[b] - 20.0) < 0.5 for i, a in enumerate(p[1:-1]) for b in p[1:-1][i:])
        fair = [s for s, p in every if not clash(p)]
        value, path = kernels.antisymmetric_path(mass, score, 1.0, 9.0, 0.5)
        if fair:
            assert value == pytest.approx(max(fair)) and not clash(path)
        else:
            assert path == []


def test_fold(spark):
    df = spark.createDataFrame([(1, 1, 100.0, 5), (1, 2, 100.05, 9), (1, 3, 106.1, 1), (1, 4, 300.0, 2)], "g long, k long, m double, s long")
    got = kernels.unique_fold(df, "g", ["k"], "m", "s", 0.1, 6.03766).orderBy("k").collect()
    assert [(r.k, r.n) for r in got] == [(2, 3), (4, 1)]


def test_spectrum_paths_are_all_there(spark):
    peaks = [(7, 10.0 * k, 1000.0 if k == 5 else 1.0) for k in range(1, 10)]
    mass = np.array([0.0, *[m for _, m, _ in peaks], 100.0])
    score = np.array([0.0, *[i for _, _, i in peaks], 0.0])
    every = [score[p].sum() for p in all_paths(mass, 1.0, 200.0)]
    want = sorted(s for s in every if s >= 0.9 * max(every))
    got = kernels.spectrum_paths(spark.createDataFrame(peaks, "scan long, mz double, intensity double"), 1.0, 200.0, 0.9, 0.5).where("kind = 'near'").collect()
    assert len(want) == 256 and sorted(r.score for r in got) == want and {r.path_no for r in got} == set(range(256))
