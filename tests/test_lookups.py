"""Peaks looked up within one join by scan, against all pairs."""

import random

from specseq.operators import evidence, rescoring


def test_peaks_are_looked_up_by_scan(spark):
    rng = random.Random(7)
    ions = [(rng.randrange(4), i, "b", rng.uniform(0, 100)) for i in range(60)]
    peaks = [(rng.randrange(3), rng.uniform(0, 100), rng.randrange(1, 5)) for _ in range(20)]
    found = evidence.looked_up(spark.createDataFrame(ions, "scan long, node long, ion string, mass double"), spark.createDataFrame(peaks, "scan long, mz double, bin long"), 10.0)
    got = {r.node: r.bin for r in found.collect()}
    for scan, node, _, mass in ions:
        assert got[node] == max((b for s, mz, b in peaks if s == scan and abs(round(mass / 2) - round(mz / 2)) <= 5), default=0)
    assert "_bucket" not in found._jdf.queryExecution().executedPlan().toString()


def test_unknown_residues_take_their_masses(spark):
    rows = [(1, "GXAX", 400.0, [10.0, 20.0]), (2, "GAS", 300.0, None), (3, "GX", 100.0, None)]
    got = rescoring.peptide_nodes(spark.createDataFrame(rows, "scan long, sequence string, total double, mods array<double>")).collect()
    assert [(r.scan, r.place, r.before, r.after) for r in sorted(got)] == [(1, 1, "G", "X"), (1, 2, "X", "A"), (1, 3, "A", "X"), (2, 1, "G", "A"), (2, 2, "A", "S")]
    one = {r.place: r.prm for r in got if r.scan == 1}
    assert abs(one[2] - one[1] - 10.0) < 1e-9
