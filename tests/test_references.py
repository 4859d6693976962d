"""References by seeds, against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from specseq.functions.residues import RESIDUES
from specseq.operators import references as refs
from specseq.operators import sequences


def brute(queries, records, k, drift):
    """Score and ends of each pair's chain."""
    out = {}
    for q, a in queries:
        for r, b in records:
            cells = {(i, j) for i in range(len(a or "") - k + 1) for j in range(len(b or "") - k + 1) if a[i : i + k] == b[j : j + k]}
            runs = []
            for i, j in cells:
                if (i - 1, j - 1) not in cells:
                    n = 1
                    while (i + n, j + n) in cells:
                        n += 1
                    runs.append((-(n + k - 1), i, i - j))
            if runs:
                anchor = min(runs)
                chain = [(i, -n, d) for n, i, d in runs if abs(d - anchor[2]) <= drift]
                covered = {p for i, n, _ in chain for p in range(i, i + n)}
                out[q, r] = (len(covered), min(i for i, *_ in chain), max(i + n for i, n, _ in chain), min(i - d for i, _, d in chain), max(i - d + n for i, n, d in chain))
    return out


@pytest.mark.parametrize("hot", [10**6, 3])
def test_best_references_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(refs, "HOT_SEED", hot)  # with 3 nearly every seed is dealt to several parts
    monkeypatch.setattr(sequences, "LONG_PIECE", 14)
    monkeypatch.setattr(sequences, "SHORT_PIECE", 5)
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("AGP") for _ in range(n))
    records = [(r, say(rng.randint(0, 40))) for r in range(12)] + [(50, None), (51, "AG"), (52, "AGPAGPAGPAGP"), (53, "AGPAGPAGPAGP")]
    queries = [(q, (records[q % 12][1] or "")[2:14] + say(4)) for q in range(8)] + [(20, None), (21, ""), (22, "AGPAGPAGP"), (23, "WWWWWW")]
    qq, rr = spark.createDataFrame(queries, "q long, a string"), spark.createDataFrame([(r, b, 1) for r, b in records], "r long, b string, i int")
    matches = refs.seed_matches(qq, "q", "a", rr, "r", "b", 4)
    want = brute(queries, records, 4, 2)
    got = refs.chained(matches, "q", "r", 4, 2)
    assert {(x.q, x.r): (x.score, x.a_start, x.a_end, x.b_start, x.b_end) for x in got.collect()} == want
    best = {x.q: (x.r, x.score, x.references) for x in refs.best_reference(got, "q", "r").collect()}
    groups = defaultdict(list)
    for (q, r), v in want.items():
        groups[q].append((-v[0], r))
    assert best == {q: (min(v)[1], -min(v)[0], sum(s == min(v)[0] for s, _ in v)) for q, v in groups.items()}

    mass = lambda s: sum(RESIDUES[c] for c in s)
    text, spare = dict(records), 150.0
    for x in refs.extended(refs.best_reference(got, "q", "r"), qq, "q", "a", rr, "r", "b", spare, 60).collect():
        a, b = dict(queries)[x.q], text[x.r]

        def flank(s, limit):
            n = 0
            while n < len(s) and mass(s[: n + 1]) < limit:
                n += 1
            return n

        left = flank(b[: x.b_start][::-1], mass(a[: x.a_start]) + spare) if x.a_start else 0
        right = flank(b[x.b_end :], mass(a[x.a_end :]) + spare) if x.a_end < len(a) else 0
        assert (x.left, x.right, x.region) == (left, right, b[x.b_start - left : x.b_end + right])


def test_flanks_and_agreement(spark):
    rows = spark.createDataFrame([("PEPTIDE", 0, 3), ("PEPTIDE", 2, 7), ("PEPTIDE", 0, 7)], "s string, a int, b int")
    assert [r.flanked for r in refs.with_flanks(rows, "s", "a", "b").collect()] == ["-.PEP.T", "E.PTIDE.-", "-.PEPTIDE.-"]
    found = spark.createDataFrame([(1, "AG", ["x", "y"]), (2, "AG", ["x"]), (3, "AG", [])], "k long, peptide string, references array<string>")
    stated = spark.createDataFrame([(1, "AGG", "y"), (2, "AGG", "y"), (3, None, "y")], "k long, db_peptide string, db_reference string")
    got = refs.agreement(found, stated, "k", lambda a, b: F.least(F.length(a), F.length(b)))
    assert sorted((r.k, r.agrees, r.shared) for r in got.collect()) == [(1, True, 2), (2, False, 2)]
    assert refs.seeds(rows.where("false"), "a", "s", 3).collect() == []
