"""Queries on a graph of parts: for each customer and order status an edge from the part of the cheapest line to that of the dearest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph_search
from ..sources import tables as t

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


DEALS = """ends as (select o_custkey, o_orderstatus, min({'p': l_extendedprice, 'k': l_partkey}) a, max({'p': l_extendedprice, 'k': l_partkey}) b from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
deals as (select a.k src, b.k dst, min(round(b.p - a.p, 2)) weight from ends where a.k <> b.k group by 1, 2)"""
LINKS = f"{DEALS}, links as (select least(src, dst) src, greatest(src, dst) dst, min(weight) weight from deals group by 1, 2), two as (select src, dst, weight from links union all select dst, src, weight from links), nodes as (select distinct src node from two)"


def _deals(spark, d):
    lines = t.table(spark, d, "lineitem").join(t.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = F.struct(F.col("l_extendedprice").alias("p"), F.col("l_partkey").alias("k"))
    ends = lines.groupBy("o_custkey", "o_orderstatus").agg(F.min(line).alias("a"), F.max(line).alias("b"))
    return ends.where("a.k <> b.k").groupBy(F.col("a.k").alias("src"), F.col("b.k").alias("dst")).agg(F.min(F.round(F.col("b.p") - F.col("a.p"), 2)).alias("weight"))


@query(f"with recursive {DEALS}, reach as (select src a, dst b from deals union select r.a, e.dst from reach r join deals e on e.src = r.b), nodes as (select src node from deals union select dst from deals) select node, coalesce(least(node, min(x.b)), node) component from nodes left join reach x on x.a = node and exists (select 1 from reach y where y.a = x.b and y.b = node) group by node")
def strong_components(spark, d):
    return graph_search.strong_components(_deals(spark, d))


@query(f"""with recursive {LINKS}, ix as (select node, row_number() over (order by node) i from nodes), el as (select src, dst, weight, x.i a, y.i b, row_number() over (order by weight, src, dst) n from links join ix x on x.node = src join ix y on y.node = dst),
st as (select 0::bigint n, (select list(i order by i) from ix) labels, false taken union all
  select el.n, case when labels[a] <> labels[b] then list_transform(labels, lambda x: case when x = labels[b] then labels[a] else x end) else labels end, labels[a] <> labels[b] from st join el on el.n = st.n + 1)
select src, dst, weight from st join el using (n) where taken""")
def spanning_forest(spark, d):
    return graph_search.spanning_forest(_deals(spark, d))


PATHS = f"""{LINKS}, walk as (select 0 k, min(node) node, 0.0::double distance from nodes union all
  select k + 1, node, min(distance) from (select k, node, distance from walk union all select k, dst, distance + weight from walk join two on src = node) where k < 150 group by 1, 2),
dist as (select node, distance from walk where k = 150)"""


@query(f"with recursive {PATHS} select d.node, round(d.distance, 4) distance, min(p.node) previous from dist d left join two on dst = d.node left join dist p on p.node = src and p.distance + weight = d.distance and d.distance > 0 group by 1, 2")
def weighted_paths(spark, d):
    """Least sums of weights from the least part, edges in both directions."""
    two = _both(spark, d)
    paths = graph_search.weighted_paths(two, two.agg(F.min("src").alias("node")), 20000.0)
    return paths.select("node", F.round("distance", 4).alias("distance"), "previous")


def _both(spark, d):
    e = _deals(spark, d)
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


@query(f"""with recursive {LINKS}, el as (select node, row_number() over (order by node * 7919 % 10007, node) n from nodes),
near as (select el.n, list(dst) around from el join two on src = node group by 1),
st as (select 0::bigint n, []::bigint[] chosen, false taken union all
  select el.n, case when list_has_any(chosen, around) then chosen else list_append(chosen, node) end, not list_has_any(chosen, around) from st join el on el.n = st.n + 1 join near on near.n = el.n)
select node from st join el using (n) where taken""")
def independent_set(spark, d):
    return graph_search.independent_set(_deals(spark, d), F.col("node") * 7919 % 10007)


@query(f"""with recursive {LINKS}, el as (select src, dst, weight, row_number() over (order by weight, src, dst) n from links),
st as (select 0::bigint n, []::bigint[] used, false taken union all
  select el.n, case when list_has_any(used, [src, dst]) then used else list_concat(used, [src, dst]) end, not list_has_any(used, [src, dst]) from st join el on el.n = st.n + 1)
select src, dst, weight from st join el using (n) where taken""")
def maximal_matching(spark, d):
    return graph_search.maximal_matching(_deals(spark, d))


@query(f"""with recursive {LINKS}, el as (select src, dst, weight, row_number() over (order by weight, src, dst) n from links),
st as (select 0::bigint n, []::bigint[] used, false taken union all
  select el.n, case when list_has_any(used, [src, dst]) then used else list_concat(used, [src, dst]) end, not list_has_any(used, [src, dst]) from st join el on el.n = st.n + 1)
select unnest([src, dst]) node from st join el using (n) where taken""")
def vertex_cover(spark, d):
    return graph_search.vertex_cover(_deals(spark, d))


REACH = f"{DEALS}, reach as (select src a, dst b from deals union select r.a, e.dst from reach r join deals e on e.src = r.b), nodes as (select src node from deals union select dst from deals), strong as (select node, coalesce(least(node, min(x.b)), node) component from nodes left join reach x on x.a = node and exists (select 1 from reach y where y.a = x.b and y.b = node) group by node)"


@query(f"with recursive {REACH} select node, component from strong s where not exists (select 1 from deals join strong x on x.node = src join strong y on y.node = dst where x.component = s.component and y.component <> s.component)")
def attracting_components(spark, d):
    return graph_search.attracting_components(_deals(spark, d))


@query(f"with recursive {REACH} select count(*) edges, round(avg((x.component <> y.component)::int), 9) hierarchy from deals join strong x on x.node = src join strong y on y.node = dst")
def flow_hierarchy(spark, d):
    return graph_search.flow_hierarchy(_deals(spark, d)).withColumn("hierarchy", F.round("hierarchy", 9))


@query(f"""with recursive {LINKS}, lab as (select 0 k, node, node component from nodes union all select k + 1, node, min(component) from (select k, node, component from lab union all select k, dst, component from lab join two on src = node) where k < 100 group by 1, 2),
least_ as (select node, component from lab where k = 100), walk as (select node, 0 colour from least_ where node = component union select dst, 1 - colour from walk join two on src = node), own as (select l.node, l.component, w.colour from least_ l join walk w on w.node = l.node),
odd as (select component from own group by node, component having count(*) > 1)
select node, component, case when component in (select component from odd) then -1 else min(colour) end::int colour, component not in (select component from odd) bipartite from own group by 1, 2""")
def two_colouring(spark, d):
    """Colours of the parts; -1 where a part can't be coloured so."""
    rows = graph_search.two_colouring(_deals(spark, d))
    return rows.withColumn("colour", F.when(F.col("bipartite"), F.col("colour")).otherwise(-1))


ROUNDS = ", ".join(f"r{i} as (select node, c + g c from c{i} join (select src node, sum(c) g from two join c{i} on node = dst group by 1) using (node)), c{i + 1} as (select node, c / sqrt(sum(c * c) over ()) c from r{i})" for i in range(8))


@query(f"with {LINKS}, c0 as (select node, 1.0::double c from nodes), {ROUNDS} select node, round(c, 8) centrality from c8")
def eigenvector_centrality(spark, d):
    return graph_search.eigenvector_centrality(_deals(spark, d), 8).withColumn("centrality", F.round("centrality", 8))


def core_numbers(spark, d):
    """How deep each part lies in the graph."""
    return graph_search.core_numbers(_deals(spark, d))


QUERIES["core_numbers"] = core_numbers
