"""Queries on graphs with scored pairs of edges, on the parts of orders with masses scaled to those of peptides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import residues as r
from ..operators import evidence, pair_graph, sequences, sequencing
from ..sources import tables as t
from .evidence_queries import EVIDENCE, TOTALS, _evidence
from .result_queries import LETTERS, MASS, SEQ, _sequences
from .sequencing_queries import EDGES, NODES, _graph
from .spectra_queries import PAIRS, PEAKS

QUERIES, SQL = {}, {}
PENALTIES = {"spread": 400.0, "most": 12.0, "fixed": 4.0, "growing": 3.0, "least_gap": 110.0}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def class_sql(before: str, after: str) -> str:
    """A site's class in SQL, by the same fixed table."""
    lines = " ".join(f"when {before if side == 'before' else after} in ({', '.join(repr(c) for c in residues)}) then {number}" for side, residues, number in r.SITE_CLASSES)
    return f"case when {before} = {after} and {before} in ('P', 'G') then {r.OTHER_SITE} {lines} else {r.OTHER_SITE} end"


SITES = f"""adj as (select {class_sql('x.sym', 'y.sym')} as class from l x join l y on y.p_partkey = x.p_partkey and y.pos = x.pos + 1),
cn as (select class, count(*) n from adj group by 1), sites as (select k as class, round(2 * ln((coalesce(n, 0) + 1) * 16.0::double / ((select count(*) from adj) + 16)), 6) site_score from range(0, 16) u(k) left join cn on class = k)"""
COSTS = """er as (select e.*, total, (select min(abs(mono - gap)) from m) error from edges e join st using (scan)),
pp as (select *, error / total * 1e6 ppm from er),
ce as (select scan, a, b, gap, label, case when error >= 0.5 then 12 when ppm < 400 then 0 else 12 - 12 * 400 / (11 * ppm - 10 * 400) end + case when label = '-' then 4 + 3 / 110.0::double * gap else 0 end as cost from pp)"""
WALK = f"""walk as (
  select scan, b place, label, 0 - cost score, label labels, [a, b] places from ce where a = 0
  union all
  select w.scan, e.b, e.label, w.score + n.score + site_score - cost, labels || e.label, list_append(places, e.b)
  from walk w join ce e on e.scan = w.scan and e.a = w.place join nodes n on n.scan = e.scan and n.place = e.a join sites on sites.class = {class_sql('w.label', 'e.label')}
), ends as (select scan, max(place) place from nodes group by 1), whole as (select w.scan, w.score, labels, places from walk w join ends using (scan, place)), top as (select scan, max(score) best from whole group by 1),
near as (select whole.*, best from whole join top using (scan) where score >= case when best > 0 then 0.9 else 1.01 end * best - 1e-9)"""
GRAPH = f"{PEAKS}, {MASS}, {NODES}, {EDGES}, {SEQ}, {LETTERS}, {SITES}, {COSTS}, {WALK}"


def _sites(spark, d):
    return pair_graph.site_scores(sequences.adjacent(_sequences(spark, d), "p_partkey", "seq"))


def _scored(spark, d):
    nodes, edges = _graph(spark, d)
    totals = t.totals(spark, d).withColumn("total", F.col("total") / 500)
    return nodes, pair_graph.edge_costs(edges, totals, r.residue_table(spark), 0.5, **PENALTIES), _sites(spark, d)


@query(f"with {SEQ}, {LETTERS}, {SITES} select class::integer as class, site_score from sites")
def site_scores(spark, d):
    """How much more often than evenly the neighbours in part names are of each class of sites."""
    return _sites(spark, d)


@query(f"with recursive {GRAPH} select scan, count(*) paths, round(any_value(best), 3) best, count(distinct labels) answers from near group by 1")
def pair_scored_paths(spark, d):
    """Near-optimal paths of each order's graph by the scores of pairs of edges."""
    paths = pair_graph.pair_scored_paths(*_scored(spark, d), 0.9)
    return paths.groupBy("scan").agg(F.count("*").alias("paths"), F.round(F.first("best"), 3).alias("best"), F.countDistinct(F.array_join("labels", "")).alias("answers"))


@query(f"with recursive {GRAPH}, st2 as (select scan, places[i] a, places[i + 1] b, score, best from near, unnest(range(1, len(places))) u(i)) select scan, a::bigint a, b::bigint b, round(max(score), 3) through from st2 group by 1, 2, 3")
def kept_edges(spark, d):
    """Edges of each order's near-optimal subgraph, with the best score of a path through them."""
    return pair_graph.kept_edges(*_scored(spark, d), 0.9).select("scan", "a", "b", F.round("through", 3).alias("through"))


def subgraph_edges(spark, d):
    """Edges that no residue explains, searched in graphs of their own until none is left."""
    nodes, _ = _graph(spark, d)
    totals = t.totals(spark, d).withColumn("total", F.col("total") / 500)
    found = pair_graph.subgraph_edges(nodes, totals, r.residue_table(spark), _sites(spark, d), tolerance=0.5, low=110.0, high=700.0, cut=150.0, most=2, alpha=0.9, sub_alpha=0.3, penalties=PENALTIES)
    return found.select("scan", "depth", *[F.round(c, 4).alias(c) for c in ("interval_low", "interval_high", "low", "high")], "label", "state")


QUERIES["subgraph_edges"] = subgraph_edges


PAIRED = f"""g as (select light scan, mass / 400 mass, tier, n, total / 400 total, row_number() over (partition by light, heavy order by tier, n desc, intensity desc, mass) - 1 rank from every join totals on scan = light),
fit as (select *, (4 - tier) * n::double score from g where rank < 8 and mass > 56.02146 and mass < total - 56.02146),
runs as (select *, sum(opens) over (partition by scan order by mass, rank rows unbounded preceding) run from (select *, case when coalesce(mass - lag(mass) over (partition by scan order by mass, rank) >= 0.5, true) then 1 else 0 end opens from fit)),
un as (select scan, avg(mass) mass, sum(score) score from runs group by scan, run union all select scan, 0, 0 from fit group by scan union all select scan, any_value(total), 0 from fit group by scan),
nodes as (select *, row_number() over (partition by scan order by mass) - 1 place from un), st as (select scan, total / 400 total from totals)"""


@query(f"with recursive {PEAKS}, {PAIRS}, {TOTALS}, {EVIDENCE}, {MASS}, {PAIRED}, {EDGES}, {SEQ}, {LETTERS}, {SITES}, {COSTS}, {WALK} select scan, count(*) paths, round(any_value(best), 3) best, count(distinct labels) answers from near group by 1")
def paired_paths(spark, d):
    """Near-optimal paths of pairs of orders, whose nodes are what both show together."""
    every, totals = _evidence(spark, d)
    deltas = evidence.ranked(every, ["light", "heavy"]).join(totals, "light").withColumns({"mass": F.col("mass") / 400, "total": F.col("total") / 400})
    nodes = pair_graph.paired_graph_nodes(deltas, 8, 0.5)
    edges = sequencing.labelled_edges(nodes, r.residue_table(spark), 0.5, 110.0, 250.0)
    costs = pair_graph.edge_costs(edges, totals.select(F.col("light").alias("scan"), (F.col("total") / 400).alias("total")), r.residue_table(spark), 0.5, **PENALTIES)
    paths = pair_graph.pair_scored_paths(nodes, costs, _sites(spark, d), 0.9)
    return paths.groupBy("scan").agg(F.count("*").alias("paths"), F.round(F.first("best"), 3).alias("best"), F.countDistinct(F.array_join("labels", "")).alias("answers"))


@query(f"with recursive {GRAPH} select scan, round(score, 3) score, replace(labels, '-', 'X') as sequence, length(labels) - length(replace(labels, '-', '')) as open_edges from near")
def spelled_paths(spark, d):
    """Those paths as sequences, X for each edge that no residue explains."""
    paths = pair_graph.spelled(pair_graph.pair_scored_paths(*_scored(spark, d), 0.9))
    return paths.select("scan", F.round("score", 3).alias("score"), "sequence", F.size("open").cast("long").alias("open_edges"))
