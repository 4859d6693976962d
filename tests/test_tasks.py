"""What one task holds doesn't grow with the table: rows are dealt into partitions by their number."""

from specseq.operators import graphs
from specseq.plans import catalogue
from specseq.sources import tables as t

FOLDER = "/root/testdata/sf0.01"


def shuffles(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]


def test_noise_model_deals_lines_once_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(t.dealt, "__kwdefaults__", {"of": None, "per": 7000})
    found = shuffles(catalogue.QUERIES["noise_model"](spark, FOLDER))
    assert len(found) == 1 and ", 9)" in found[0]  # 60,000 lines
    assert t.tasks(spark.range(0)) == 1 and t.tasks(spark.range(10), 3) == 4


def test_merged_peaks_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(t.dealt, "__kwdefaults__", {"of": None, "per": 7000})
    found = shuffles(catalogue.QUERIES["merge_spectra"](spark, FOLDER))
    assert any("o_custkey" in line and ", 9)" in line for line in found) and not any("bucket" in line for line in found)


def test_projected_pairs_are_dealt_by_number(spark):
    edges = spark.createDataFrame([(a, a * b % 7) for a in range(12) for b in range(5)], "src long, dst long")
    dealt = graphs.projection(edges, 5)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, graphs.projection(edges).collect()))
    found = shuffles(graphs.projection(edges, 5))
    assert found and all(", 5)" in line for line in found) and len([x for x in found if "a#" in x and "b#" in x]) == 1


def test_evidence_is_dealt_once_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(t, "TASK_ROWS", 20_000)
    found = shuffles(catalogue.QUERIES["evidence_tiers"](spark, FOLDER))
    both = [x for x in found if "light#" in x and "heavy#" in x]
    assert both and all("REPARTITION_BY_NUM" in x for x in both) and not any("part#" in x or "tier#" in x or "side#" in x for x in found)


def test_matches_of_sequences_are_dealt_by_parts(spark):
    found = shuffles(catalogue.QUERIES["tag_runs"](spark, FOLDER))
    assert not any("diagonal" in line for line in found)
