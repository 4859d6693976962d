"""Queries on further graph measures: parts and suppliers, consecutive parts of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, measures
from ..sources import tables as t
from .graph_queries import BIPARTITE, DEGREE, PARTS, TRIANGLES

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WITH_DEGREES = "wd as (select b.src, b.dst, x.degree d_src, y.degree d_dst from b join g x on x.node = b.src join g y on y.node = b.dst)"
BRANDS = "brand as (select p_partkey node, p_brand block from part)"


@query(f"with {PARTS}, {DEGREE}, {WITH_DEGREES} select src node, round(avg(d_dst), 6) neighbor_degree from wd group by 1")
def neighbor_degree(spark, d):
    return measures.neighbor_degree(t.part_edges(spark, d)).withColumn("neighbor_degree", F.round("neighbor_degree", 6))


@query(f"with {PARTS}, {DEGREE}, {WITH_DEGREES} select d_src degree, round(avg(d_dst), 6) neighbor_degree from wd group by 1")
def degree_connectivity(spark, d):
    return measures.degree_connectivity(t.part_edges(spark, d)).withColumn("neighbor_degree", F.round("neighbor_degree", 6))


@query(f"with {PARTS}, {DEGREE}, {WITH_DEGREES} select d_src degree, d_dst other, count(*) n from wd group by 1, 2")
def degree_mixing(spark, d):
    return measures.degree_mixing(t.part_edges(spark, d))


@query(f"""with {PARTS}, {DEGREE}, {WITH_DEGREES}, k as (select distinct degree from g), c as (select k.degree, (select count(*) from g where g.degree > k.degree) n, (select count(*) from wd where src < dst and d_src > k.degree and d_dst > k.degree) m from k)
select degree, round(2.0 * m / (n * (n - 1)), 9) coefficient from c where n > 1""")
def rich_club(spark, d):
    return measures.rich_club(t.part_edges(spark, d)).withColumn("coefficient", F.round("coefficient", 9))


@query(f"with {PARTS} select node, sum(i)::bigint in_degree, sum(o)::bigint out_degree from (select src node, 0 i, 1 o from e union all select dst, 1, 0 from e) group by 1")
def in_out_degrees(spark, d):
    return measures.in_out_degrees(t.part_edges(spark, d))


@query(f"with {PARTS} select src, dst, round(1.0 / count(*) over (partition by src), 9) weight from e")
def stochastic_edges(spark, d):
    return measures.stochastic(t.part_edges(spark, d)).withColumn("weight", F.round("weight", 9))


def _brands(spark, d):
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("block"))


MIXING = "mix as (select x.block src_block, y.block dst_block, count(*) n from e join brand x on x.node = e.src join brand y on y.node = e.dst group by 1, 2)"


@query(f"with {PARTS}, {BRANDS}, {MIXING} select * from mix")
def block_model(spark, d):
    """Edges between the brands of parts."""
    return measures.block_model(t.part_edges(spark, d), _brands(spark, d))


@query(f"""with {PARTS}, {BRANDS}, {MIXING}, s as (select *, n / sum(n) over () p from mix), a as (select src_block k, sum(p) x from s group by 1), b2 as (select dst_block k, sum(p) y from s group by 1),
c as (select sum(x * y) chance from a join b2 using (k)), tr as (select sum(case when src_block = dst_block then p else 0 end) trace from s) select round((trace - chance) / (1 - chance), 9) assortativity from tr, c""")
def brand_assortativity(spark, d):
    return measures.attribute_assortativity(measures.block_model(t.part_edges(spark, d), _brands(spark, d))).withColumn("assortativity", F.round("assortativity", 9))


@query(f"with {PARTS}, inside as (select p_partkey node from part where p_size <= 5) select distinct dst node from b where src in (select node from inside) and dst not in (select node from inside)")
def node_boundary(spark, d):
    """Neighbours of the small parts."""
    return measures.node_boundary(t.part_edges(spark, d), t.table(spark, d, "part").where("p_size <= 5").select(F.col("p_partkey").alias("node")))


STATUS = "ship as (select distinct l_partkey src, l_suppkey dst from lineitem where l_returnflag = 'A'), back as (select distinct l_partkey src, l_suppkey dst from lineitem where l_returnflag = 'R')"


@query(f"with {STATUS} (select * from ship except select * from back) union all (select * from back except select * from ship)")
def graph_symmetric_difference(spark, d):
    rows = t.table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_returnflag")
    return measures.symmetric_difference(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"))


@query("select p_partkey node from part where p_partkey not in (select l_partkey from lineitem where l_quantity < 10 and l_discount < 0.03)")
def isolates(spark, d):
    """Parts without an edge to a supplier in small lines of little discount."""
    lines = t.table(spark, d, "lineitem").where("l_quantity < 10 and l_discount < 0.03").select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"))
    return measures.isolates(t.table(spark, d, "part").select(F.col("p_partkey").alias("node")), lines)


@query(f'with {PARTS}, {DEGREE}, {WITH_DEGREES} select src as "row", dst as col, round(-1.0 / sqrt(d_src::double * d_dst), 9) as value from wd union all select node, node, 1.0 from g')
def normalized_laplacian(spark, d):
    return measures.laplacian(t.part_edges(spark, d), normalized=True).withColumn("value", F.round("value", 9))


@query(f'with {PARTS}, {DEGREE} select src as "row", dst as col, -1.0::double as value from b union all select node, node, degree::double from g')
def laplacian(spark, d):
    return measures.laplacian(t.part_edges(spark, d))


@query(f"""with {PARTS}, v as (select src node from e union select dst from e), k1 as (select node, 1.0::double x from v), k2 as (select v.node, 0.05 * coalesce(sum(k1.x), 0) + 1 x from v left join e on e.dst = v.node left join k1 on k1.node = e.src group by 1),
k3 as (select v.node, 0.05 * coalesce(sum(k2.x), 0) + 1 x from v left join e on e.dst = v.node left join k2 on k2.node = e.src group by 1) select node, round(x, 9) katz from k3""")
def katz(spark, d):
    return measures.katz(t.part_edges(spark, d), 0.05, 1.0, 3).withColumn("katz", F.round("katz", 9))


@query(f"with {PARTS} select x.src node, count(y.src) reach from e x left join e y on y.src = x.dst group by 1")
def two_steps(spark, d):
    return measures.two_steps(t.part_edges(spark, d))


@query(f"with {PARTS}, {DEGREE} select count(*) n_nodes, count(*) filter (degree % 2 = 1) n_odd from g")
def degree_parity(spark, d):
    return measures.degree_parity(t.part_edges(spark, d))


@query(f"""with {BIPARTITE}, s as (select src node, 0 side, count(*) degree from e group by 1 union all select dst, 1, count(*) from e group by 1)
select node, side, degree, round(degree / case when side = 0 then (select count(*) from s where side = 1) else (select count(*) from s where side = 0) end, 9) centrality from s""")
def bipartite_degrees(spark, d):
    return measures.bipartite_degrees(t.part_supplier_edges(spark, d)).withColumn("centrality", F.round("centrality", 9))


@query(f"with {PARTS} select src || ' ' || dst as value from e")
def edge_lines(spark, d):
    return measures.edge_lines(t.part_edges(spark, d))


@query(f"with {PARTS} select src node, list_sort(list_distinct(list(dst))) neighbors from e group by 1")
def adjacency(spark, d):
    return measures.adjacency(t.part_edges(spark, d))


@query(f"with {PARTS}, {DEGREE}, {TRIANGLES} select round(avg(case when degree > 1 then coalesce(2.0 * triangles / (degree * (degree - 1)), 0) else 0 end), 9) clustering from g left join tn using (node)")
def average_clustering(spark, d):
    """Mean over all nodes; one without two neighbours counts 0."""
    rows = graphs.degrees(t.part_edges(spark, d)).join(graphs.triangles(t.part_edges(spark, d)), "node", "left")
    local = F.when(F.col("degree") > 1, F.coalesce(2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1)), F.lit(0.0))).otherwise(0.0)
    return rows.agg(F.round(F.avg(local), 9).alias("clustering"))
