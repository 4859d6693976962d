"""Queries on graphs: parts and suppliers, consecutive parts of orders, customers of like balance, places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, ranges
from ..sources import tables as t

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BIPARTITE = "e as (select distinct l_partkey src, -1 - l_suppkey dst from lineitem), b as (select src, dst from e union select dst, src from e)"
PARTS = """e as (select distinct src, dst from (select l_partkey src, lead(l_partkey) over (partition by l_orderkey order by l_partkey, l_suppkey) dst from lineitem) where dst > src), b as (select src, dst from e union select dst, src from e)"""
DEGREE = "g as (select src node, count(*) degree from b group by 1)"
TRIANGLES = "tri as (select x.src a, x.dst b, y.dst c from e x join e y on x.dst = y.src join e z on z.src = x.src and z.dst = y.dst), tn as (select node, count(*) triangles from (select unnest([a, b, c]) node from tri) group by 1)"


@query(f"with {BIPARTITE}, {DEGREE} select node, round(degree / (count(*) over () - 1), 9) centrality from g")
def degree_centrality(spark, d):
    return graphs.degree_centrality(t.part_supplier_edges(spark, d)).withColumn("centrality", F.round("centrality", 9))


@query(f"with {BIPARTITE}, {DEGREE} select count(*) n_nodes, (sum(degree) / 2)::bigint n_edges, round(sum(degree) / (count(*) * (count(*) - 1.0::double)), 9) density from g")
def density(spark, d):
    return graphs.density(t.part_supplier_edges(spark, d)).withColumn("density", F.round("density", 9))


@query(f"with {PARTS}, {DEGREE} select degree, count(*) n_nodes from g group by 1")
def degree_histogram(spark, d):
    return graphs.degree_histogram(t.part_edges(spark, d))


@query(f"with {PARTS}, {TRIANGLES} select node, triangles from tn")
def triangles(spark, d):
    return graphs.triangles(t.part_edges(spark, d))


@query(f"with {PARTS}, {DEGREE}, {TRIANGLES} select g.node, round(case when degree < 2 then 0 else 2.0::double * coalesce(triangles, 0) / (degree * (degree - 1)) end, 9) clustering from g left join tn using (node)")
def clustering(spark, d):
    return graphs.clustering(t.part_edges(spark, d)).withColumn("clustering", F.round("clustering", 9))


@query(f"with {PARTS}, {DEGREE}, {TRIANGLES} select round((select sum(triangles) from tn) / (select sum(degree * (degree - 1) / 2) from g), 9)::double transitivity")
def transitivity(spark, d):
    return graphs.transitivity(t.part_edges(spark, d)).withColumn("transitivity", F.round("transitivity", 9))


LIKE = "e as (select x.c_custkey src, y.c_custkey dst from customer x join customer y on abs(x.c_acctbal - y.c_acctbal) < 2 and x.c_custkey < y.c_custkey), b as (select src, dst from e union select dst, src from e)"


@query(f"with recursive {LIKE}, r as (select src node, src other from b union select r.node, b.dst from r join b on b.src = r.other) select node, min(other) as component from r group by 1")
def components(spark, d):
    # Sorted neighbours join the same customers as all pairs do.
    return graphs.components(ranges.chain_links(t.table(spark, d, "customer"), "c_custkey", "c_acctbal", lambda low, high: high - low < 2.0, 1000.0))


_round = lambda i: f"""r{i + 1} as (select v.node, 0.15 / n + 0.85 * (coalesce(got, 0) + lost / n) as rank from v, (select count(*) n from v) c, (select coalesce(sum(rank) filter (node not in (select src from e)), 0) as lost from r{i}) l
  left join (select dst as node, sum(rank / deg) as got from e join r{i} on r{i}.node = e.src join o on o.src = e.src group by 1) s on s.node = v.node)"""  # noqa: E731


@query(f"with {PARTS}, v as (select src node from e union select dst from e), o as (select src, count(*) deg from e group by 1), r0 as (select node, 1.0::double / (select count(*) from v) as rank from v), {', '.join(_round(i) for i in range(3))} select node, round(rank, 9) as rank from r3".replace("from v, (select count(*) n from v) c, (select", "from v cross join (select count(*) n from v) c cross join (select"))
def pagerank(spark, d):
    return graphs.pagerank(t.part_edges(spark, d), 3).withColumn("rank", F.round("rank", 9))


_hits = ", ".join(f"a{i} as (select dst node, sum(hub) / sum(sum(hub)) over () authority from e join h{i} on h{i}.node = e.src group by 1), h{i + 1} as (select src node, sum(authority) / sum(sum(authority)) over () hub from e join a{i} on a{i}.node = e.dst group by 1)" for i in range(2))


@query(f"with {PARTS}, v as (select src node from e union select dst from e), h0 as (select node, 1.0::double hub from v), {_hits} select v.node, round(coalesce(hub, 0), 9) hub, round(coalesce(authority, 0), 9) authority from v left join h2 on h2.node = v.node left join a1 on a1.node = v.node")
def hits(spark, d):
    return graphs.hits(t.part_edges(spark, d), 2).select("node", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))


_core = ", ".join(f"k{i + 1} as materialized (select x.src, x.dst from k{i} x join (select src from k{i} group by 1 having count(*) >= 4) s on s.src = x.src join (select src from k{i} group by 1 having count(*) >= 4) u on u.src = x.dst)" for i in range(25))


@query(f"with {LIKE.replace('< 2 and', '< 10 and')}, k0 as (select * from b), {_core} select distinct src node from k25")
def k_core(spark, d):
    return graphs.k_core(ranges.near_links(t.table(spark, d, "customer"), "c_custkey", "c_acctbal", 10.0, 4), 4)


PLACES = "e as (select c_custkey src, (1000000000 + c_nationkey)::bigint dst from customer union select 1000000000 + n_nationkey, 2000000000 + n_regionkey from nation union select 2000000000 + r_regionkey, 3000000000 from region)"


def _places(spark, d):
    c, n, r = (t.table(spark, d, x) for x in ("customer", "nation", "region"))
    edge = lambda df, a, b: df.select(a.cast("long").alias("src"), b.cast("long").alias("dst"))
    up = edge(c, F.col("c_custkey"), F.lit(1000000000) + F.col("c_nationkey")).unionByName(edge(n, F.lit(1000000000) + F.col("n_nationkey"), F.lit(2000000000).cast("long") + F.col("n_regionkey")))
    return up.unionByName(edge(r, F.lit(2000000000).cast("long") + F.col("r_regionkey"), F.lit(3000000000).cast("long"))).distinct()


@query(f"with recursive {PLACES}, r as (select distinct src node, 0 as depth from e where src < 1000000000 union select e.dst, r.depth + 1 from r join e on e.src = r.node) select node, min(depth)::integer as level from r group by 1")
def bfs_levels(spark, d):
    """Steps from any customer."""
    return graphs.bfs_levels(_places(spark, d), F.col("node") < 1000000000)


@query(f"with {PLACES} select node, not bool_or(is_dst) is_source, not bool_or(not is_dst) is_sink from (select src node, false is_dst from e union all select dst, true from e) group by 1")
def sources_sinks(spark, d):
    return graphs.sources_sinks(_places(spark, d))


@query(f"with recursive {PLACES}, r as (select src node, 0 as depth from e union select dst, 0 from e union select e.dst, r.depth + 1 from r join e on e.src = r.node) select node, max(depth)::integer as length from r group by 1")
def longest_path(spark, d):
    return graphs.longest_paths(_places(spark, d))


@query("with e as (select distinct l_suppkey src, l_partkey dst from lineitem) select x.src a, y.src b, count(*) n_common from e x join e y on x.dst = y.dst and x.src < y.src group by 1, 2")
def bipartite_projection(spark, d):
    lines = t.table(spark, d, "lineitem")
    return graphs.projection(lines.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), t.tasks(lines))


@query(f"with {PARTS} select src, dst from b where src % 10 = 0 and dst % 10 <> 0")
def edge_boundary(spark, d):
    return graphs.boundary(t.part_edges(spark, d), F.col("node") % 10 == 0)


@query(f"with {PARTS}, {DEGREE} select sum(x.degree * y.degree)::bigint s_metric from e join g x on x.node = e.src join g y on y.node = e.dst")
def s_metric(spark, d):
    return graphs.s_metric(t.part_edges(spark, d))


@query(f"with {PARTS}, {DEGREE} select round(corr(x.degree::double, y.degree::double), 6) assortativity from b join g x on x.node = b.src join g y on y.node = b.dst")
def assortativity(spark, d):
    return graphs.assortativity(t.part_edges(spark, d)).withColumn("assortativity", F.round("assortativity", 6))


def _flagged(spark, d, flag):
    return t.table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


FLAG = "(select l_partkey src, l_suppkey dst from lineitem where l_returnflag = '{}')"


@query(f"select * from {FLAG.format('A')} union select * from {FLAG.format('R')}")
def graph_union(spark, d):
    return _flagged(spark, d, "A").union(_flagged(spark, d, "R")).distinct()


@query(f"select * from {FLAG.format('A')} intersect select * from {FLAG.format('R')}")
def graph_intersect(spark, d):
    return _flagged(spark, d, "A").intersect(_flagged(spark, d, "R"))


@query(f"select * from {FLAG.format('A')} except select * from {FLAG.format('R')}")
def graph_difference(spark, d):
    return _flagged(spark, d, "A").subtract(_flagged(spark, d, "R"))


@query(f"with {PARTS} select x.src pred, x.dst node, y.dst succ, ((x.dst - x.src) + (y.dst - y.src))::bigint span from e x join e y on x.dst = y.src")
def triple_scores(spark, d):
    """Every (predecessor, node, successor) with the length of both edges together."""
    e = t.part_edges(spark, d)
    return e.select(F.col("src").alias("pred"), F.col("dst").alias("node")).join(e.select(F.col("src").alias("node"), F.col("dst").alias("succ")), "node").select("pred", "node", "succ", (F.col("succ") - F.col("pred")).alias("span"))


@query(f"with recursive {PLACES}, r as (select distinct src node from e where src not in (select dst from e) union all select e.dst from r join e on e.src = r.node) select node, count(*) paths from r group by 1")
def all_paths(spark, d):
    """Numbers of paths from the sources to each node."""
    return graphs.path_counts(_places(spark, d))


@query(f"with recursive {PLACES}, r as (select distinct src node from e where src < 1000000000 union select e.dst from r join e on e.src = r.node) select node from r where node >= 1000000000")
def path_exists(spark, d):
    """Nations, regions and the root that some customer leads to."""
    return graphs.reachable(_places(spark, d), F.col("node") < 1000000000, F.col("node") >= 1000000000)
