"""Work whose rows, tasks or shuffles must not grow faster than what it returns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from specseq.llm import near_vectors
from specseq.operators import features, isotopes, ranges, rescoring, training
from specseq.plans import catalogue, result_queries

FOLDER = "/root/testdata/sf0.001"


def test_pairs_of_a_cluster_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(training, "TASK_PAIRS", 100)
    scans = spark.createDataFrame([(k, 7, k % 3 if k else None) for k in range(61)], "scan long, c long, answer long")
    got = training.cluster_training_pairs(scans, "scan", "c", "answer")
    assert sorted(tuple(r) for r in got.collect()) == [(a, b, 1 if a % 3 == b % 3 else -1) for a in range(1, 61) for b in range(a + 1, 61)]
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 900


def test_gaps_are_counted_without_pairs(spark, monkeypatch, tmp_path):
    rng = random.Random(4)
    # Halves of a bucket, copies, values between two buckets of the join, and what can't be compared.
    values = [rng.choice([rng.randrange(-4000, 4000) * 0.5, rng.randrange(-80, 80) * 25.0, 1100.0, 1099.99, round(rng.uniform(-999, 9999), 2)]) for _ in range(300)] + [None, float("nan"), float("inf")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "s_suppkey long, s_acctbal double")
    want: dict[int, int] = {}
    for i, x in enumerate(values[:300]):
        for y in values[i + 1 : 300]:
            if (m := round(abs(x - y) / 50)) <= 21:
                want[m] = want.get(m, 0) + 1
    for piece in (7, 50_000):
        monkeypatch.setattr(ranges, "PIECE_VALUES", piece)
        assert {r.m: r.pairs for r in ranges.gap_counts(rows, "s_acctbal", 50.0, 21).collect()} == want
    assert ranges.gap_counts(rows.where("s_acctbal is null"), "s_acctbal", 50.0, 21).collect() == []
    # Before, each pair was a row of the join.
    rows.write.parquet(str(tmp_path / "supplier.parquet"))
    found = result_queries.QUERIES["mass_delta_frequency"](spark, str(tmp_path))
    found.collect()
    assert most_rows(found) < 2000


def most_rows(df):
    """The greatest number of rows that a node of a query's plan gave, of those that count them. The query has been run."""
    plan, found = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            plan.append(node.plan())
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            found.append(metric.get().value())
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return max(found)


def dealt_by(df):
    """The columns by which each shuffle of a query's plan deals."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [re.sub(r"#\d+L?", "", x).rsplit(", ", 1)[0] for x in re.findall(r"(?<!Reused)Exchange hashpartitioning\(([^)]*)\)", plan)]


@pytest.mark.parametrize("name", ["psm_feature_rows", "training_lines"])
def test_fragments_pass_no_shuffle(spark, name):
    """Rows of a scan, of which fragments are many, were dealt by place, peak and bucket as well."""
    keys = dealt_by(catalogue.QUERIES[name](spark, FOLDER))
    assert keys and set(keys) == {"scan"} and len(keys) < 7


def test_shown_fragments_are_the_annotated_ions(spark, monkeypatch):
    rng = random.Random(6)
    places = {s: sorted(rng.sample(range(9), rng.randrange(1, 7))) for s in range(12)}
    ladder = [(s, p, float(rng.randrange(0, 40)), 60.0) for s, ps in places.items() for p in ps] + [(50, 0, 5.0, 9.0), (51, 0, None, 9.0), (51, 1, 4.0, None)]
    rng.shuffle(ladder)
    peaks = [(s, k, rng.randrange(0, 130) / 2, rng.randrange(1, 9) * 1.0) for s in [*range(10), 51, 60] for k in range(rng.randrange(1, 9))] + [(3, 99, None, 1.0)]
    ladders, spots = spark.createDataFrame(ladder, "scan long, place int, prm double, total double"), spark.createDataFrame(peaks, "scan long, peak long, mz double, intensity double")
    ions = ["b", "b-H2O", "y"]
    # By hand: every ion beside every peak of its scan.
    want = set()
    for i in features.fragment_ions(ladders, ions).collect():
        near = [(abs(z - i.mass), z, k, x) for s, k, z, x in peaks if s == i.scan and z is not None and i.mass is not None and abs(z - i.mass) < 2.0]
        if near:
            _, z, k, x = min(near)
            want.add((i.scan, i.place, i.other, i.ion, i.mass, k, z - i.mass, x))
    for cells in (3, 1 << 20):
        monkeypatch.setattr(features, "CELLS", cells)
        assert {tuple(r) for r in features.shown_fragments(ladders, spots, ions, 2.0).collect()} == want and len(want) > 30
    assert {tuple(r) for r in features.annotated(features.fragment_ions(ladders, ions), spots, 2.0).collect()} == want
    assert features.shown_fragments(ladders.limit(0), spots, ions, 2.0).collect() == [] and features.shown_fragments(ladders, spots.limit(0), ions, 2.0).collect() == []


def test_nodes_of_peptides_are_dealt_by_scan(spark):
    """Nodes were dealt by scan and node to meet their own parts, and by scan again to meet the node before."""
    from specseq.plans import training_queries

    nodes, tables, _ = training_queries._trained(spark, FOLDER, left=True)
    scored = rescoring.left_scored(rescoring.scored_nodes(nodes, training_queries.LIKELIHOOD, training_queries.PRIOR, tables), training_queries.LIKELIHOOD, training_queries.PRIOR, tables)
    found = rescoring.residue_confidence(scored)
    assert not any("scan" in k for k in dealt_by(found))
    # By the nodes' order alone.
    plain = scored.select("scan", "place", "before", "after", "s")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rescoring.residue_confidence(plain).collect())) and not found.isEmpty()


def test_the_node_before_counts_only_with_noise(spark):
    rows = [(1, 1, 5, 0.5), (1, 2, 6, 0.0), (1, 3, 7, 0.5), (1, 4, 8, None), (2, 1, 9, 0.0)]
    found = rescoring.with_left(spark.createDataFrame(rows, "scan long, place int, site int, noise double"), ["site"])
    got = {(r.scan, r.place): (r.left_site, r.last) for r in found.collect()}
    assert got == {(1, 1): (None, False), (1, 2): (5, False), (1, 3): (5, True), (1, 4): (7, False), (2, 1): (None, None)}


def test_subgraphs_are_searched_where_their_nodes_are(spark):
    """Each round of the search shuffled all nodes and wrote its edges anew."""
    found = catalogue.QUERIES["subgraph_edges"](spark, FOLDER)
    assert set(dealt_by(found)) <= {"scan", "o_orderkey", "l_orderkey"} and len(dealt_by(found)) < 10 and "graph-" not in "".join(found.inputFiles())


def test_chi_squares_only_where_scores_contend(monkeypatch):
    """Each of the envelopes tried had two of them computed, whether its score was near the best or not."""
    asked = []
    plain = isotopes.chi_square
    monkeypatch.setattr(isotopes, "chi_square", lambda *a: asked.append(a) or plain(*a))
    ratios = isotopes.isotope_ratios(40)
    masses = [500.0 + k * isotopes.STEP for k in range(-isotopes.REACH, 5)]
    found = [0.0] * isotopes.REACH + [1000 * x for x in ratios[:5]]
    assert isotopes.monoisotopic(masses, found, ratios)[0] == 500.0 and len(asked) <= 4
    # One more peak in front, with a score within a fifth of the best: now they decide.
    found[isotopes.REACH - 1] = 30.0
    assert isotopes.monoisotopic(masses, found, ratios)[0] in masses


def test_cells_are_written_once(spark, monkeypatch):
    """All vectors with their guests were written a second time, in one table."""
    names, plain = [], near_vectors.written
    monkeypatch.setattr(near_vectors, "written", lambda df, name: names.append((name, "unit" in df.columns and "angle" in df.columns)) or plain(df, name))
    rows = spark.createDataFrame([(i, [1.0, i % 3 * 1.0, 0.5], 1) for i in range(12)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(rows).collect()}
    assert got == {i: (7 if i % 3 else 3, 1 if i % 3 else 0) for i in range(12)}
    assert [n for n, whole in names if whole] == ["assigned", "blocks"]
