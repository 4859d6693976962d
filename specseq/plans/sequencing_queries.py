"""Queries from peaks to sequences, on the parts of orders with masses scaled to those of peptides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import residues as r
from ..operators import sequencing, sequences
from ..sources import tables as t
from .result_queries import MASS
from .spectra_queries import PEAKS

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NODES = f"""sp as (select scan, peak, mz / 200 mz, intensity from peaks), st as (select o_orderkey scan, o_totalprice / 500 total from orders),
dl as (select scan, peak, ion, total, 200 * intensity / sum(intensity) over (partition by scan) share, case when ion = 'b' then mz - {r.PROTON} else total + {r.WATER} + {r.PROTON} - mz end mass from (select sp.*, total, ion, intensity from sp join st using (scan), (values ('b'), ('y')) v(ion))),
fit as (select * from dl where mass > 56.02146 and mass < total - 56.02146),
runs as (select *, sum(opens) over (partition by scan order by mass, peak, ion rows unbounded preceding) run from (select *, case when coalesce(mass - lag(mass) over (partition by scan order by mass, peak, ion) >= 0.5, true) then 1 else 0 end opens from fit)),
un as (select scan, avg(mass) mass, sum(share) score from runs group by scan, run union all select scan, 0, 0 from dl group by scan union all select scan, any_value(total), 0 from dl group by scan),
nodes as (select *, row_number() over (partition by scan order by mass) - 1 place from un)"""
EDGES = "pr as (select a.scan, a.place a, b.place b, b.mass - a.mass gap from nodes a join nodes b on a.scan = b.scan and b.mass > a.mass and b.mass - a.mass < 250), edges as (select scan, a, b, gap, case when count(sym) = 1 then any_value(sym) else '-' end as label from pr left join m on abs(mono - gap) < 0.5 group by 1, 2, 3, 4 having count(sym) > 0 or gap > 110)"


def _graph(spark, d):
    peaks = t.peaks(spark, d).withColumn("mz", F.col("mz") / 200)
    totals = t.totals(spark, d).withColumn("total", F.col("total") / 500)
    nodes = sequencing.spectrum_graph_nodes(peaks, totals, 0.5)
    return nodes, sequencing.labelled_edges(nodes, r.residue_table(spark), 0.5, 110.0, 250.0)


@query(f"with {PEAKS}, {NODES} select scan, place::integer place, round(mass, 4) mass, round(score, 4) score from nodes")
def spectrum_graph_nodes(spark, d):
    return _graph(spark, d)[0].select("scan", "place", F.round("mass", 4).alias("mass"), F.round("score", 4).alias("score"))


@query(f"with {PEAKS}, {MASS}, {NODES}, {EDGES} select scan, a::integer a, b::integer b, label from edges")
def spectrum_graph_edges(spark, d):
    return _graph(spark, d)[1].select("scan", "a", "b", "label")


PATHS = """walk as (select scan, place, score, '' labels from nodes where place = 0 union all select e.scan, e.b, w.score + n.score - case when label = '-' then 20 else 0 end, labels || label from walk w join edges e on e.scan = w.scan and e.a = w.place join nodes n on n.scan = e.scan and n.place = e.b),
ends as (select scan, max(place) place from nodes group by 1), whole as (select w.scan, w.score, labels from walk w join ends using (scan, place)), top as (select scan, max(score) best from whole group by 1)"""


@query(f"with recursive {PEAKS}, {MASS}, {NODES}, {EDGES}, {PATHS} select scan, count(*) paths, round(max(best), 4) best, count(distinct labels) answers from whole join top using (scan) where score >= case when best > 0 then 0.9 else 1.01 end * best - 1e-9 group by 1")
def sequence_paths(spark, d):
    """Near-optimal paths of each order's graph, and how many different sequences they spell."""
    paths = sequencing.sequence_paths(*_graph(spark, d), 20.0, 0.9)
    return paths.groupBy("scan").agg(F.count("*").alias("paths"), F.round(F.max("score"), 4).alias("best"), F.countDistinct(F.array_join("labels", "")).alias("answers"))


def resolved_edges(spark, d):
    """Residue strings that explain the ambiguous edges of best paths."""
    edges = sequencing.ambiguous_edges(sequencing.sequence_paths(*_graph(spark, d), 20.0, 0.9).where("rank = 0"))
    return sequencing.resolved_edges(edges, sequences.residue_strings(r.residue_table(spark), 250.5), 0.02).select("scan", "place", F.round("gap", 4).alias("gap"), "seq")


QUERIES["resolved_edges"] = resolved_edges
