"""Further measures and forms of graphs (src, dst); directed ones say so, others take each edge in either direction once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graphs import both_ways, degrees


def _with_degrees(edges: DataFrame) -> DataFrame:
    """src, dst, d_src, d_dst: each undirected edge in both directions with the degrees of its ends."""
    d = degrees(edges)
    return both_ways(edges).join(d.toDF("src", "d_src"), "src").join(d.toDF("dst", "d_dst"), "dst")


def neighbor_degree(edges: DataFrame) -> DataFrame:
    """node, degree: mean degree of each node's neighbours."""
    return _with_degrees(edges).groupBy(F.col("src").alias("node")).agg(F.avg("d_dst").alias("neighbor_degree"))


def degree_connectivity(edges: DataFrame) -> DataFrame:
    """degree, neighbor_degree: mean degree of the neighbours of all nodes of a degree."""
    return _with_degrees(edges).groupBy(F.col("d_src").alias("degree")).agg(F.avg("d_dst").alias("neighbor_degree"))


def degree_mixing(edges: DataFrame) -> DataFrame:
    """degree, other, n: how often edges join nodes of two degrees, both directions counted."""
    return _with_degrees(edges).groupBy(F.col("d_src").alias("degree"), F.col("d_dst").alias("other")).agg(F.count("*").alias("n"))


def rich_club(edges: DataFrame) -> DataFrame:
    """degree, coefficient: density among the nodes of more than that degree, for each degree up to the second greatest that occurs."""
    nodes = degrees(edges).groupBy("degree").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("m"))
    links = _with_degrees(edges).where("src < dst").groupBy(F.least("d_src", "d_dst").alias("degree")).agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("m"))
    counts = nodes.unionByName(links).groupBy("degree").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    above = Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)  # one row a degree
    upto = counts.select("degree", F.sum("n").over(above).alias("n"), F.sum("m").over(above).alias("m"))
    return upto.where("n > 1").select("degree", (2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("coefficient"))


def in_out_degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree of a directed graph."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def stochastic(edges: DataFrame) -> DataFrame:
    """src, dst, weight: a directed graph with each node's weights summing to 1."""
    return edges.join(edges.groupBy("src").agg(F.count("*").alias("_n")), "src").select("src", "dst", (1.0 / F.col("_n")).alias("weight"))


def block_model(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """src_block, dst_block, n: directed edges between the blocks (node, block) of a partition of the nodes."""
    met = edges.join(blocks.toDF("src", "src_block"), "src").join(blocks.toDF("dst", "dst_block"), "dst")
    return met.groupBy("src_block", "dst_block").agg(F.count("*").alias("n"))


def attribute_assortativity(mixing: DataFrame) -> DataFrame:
    """One row from block_model(): (trace - agreement by chance) / (1 - agreement by chance)."""
    share = mixing.crossJoin(F.broadcast(mixing.agg(F.sum("n").alias("_all")))).withColumn("p", F.col("n") / F.col("_all"))  # one row
    sides = share.select(F.col("src_block").alias("b"), F.col("p").alias("x"), F.lit(0.0).alias("y")).unionByName(share.select(F.col("dst_block").alias("b"), F.lit(0.0).alias("x"), F.col("p").alias("y")))
    chance = sides.groupBy("b").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).agg(F.sum(F.col("x") * F.col("y")).alias("chance"))
    trace = share.agg(F.sum(F.when(F.col("src_block") == F.col("dst_block"), F.col("p")).otherwise(0.0)).alias("trace"))
    return trace.crossJoin(chance).select(F.try_divide(F.col("trace") - F.col("chance"), 1 - F.col("chance")).alias("assortativity"))  # one row each


def node_boundary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node: the nodes outside a set (node) with a neighbour in it."""
    out = both_ways(edges).join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return out.join(nodes, "node", "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """src, dst of the directed edges that just one of the graphs has."""
    marked = a.select("src", "dst").distinct().unionByName(b.select("src", "dst").distinct())
    return marked.groupBy("src", "dst").agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (node) without an edge."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return nodes.join(ends, "node", "left_anti")


def laplacian(edges: DataFrame, normalized: bool = False) -> DataFrame:
    """row, col, value: entries of the Laplacian matrix that aren't 0."""
    off = F.when(F.lit(normalized), -1.0 / F.sqrt(F.col("d_src").cast("double") * F.col("d_dst"))).otherwise(F.lit(-1.0))
    diagonal = degrees(edges).select(F.col("node").alias("row"), F.col("node").alias("col"), (F.lit(1.0) if normalized else F.col("degree").cast("double")).alias("value"))
    return _with_degrees(edges).select(F.col("src").alias("row"), F.col("dst").alias("col"), off.alias("value")).unionByName(diagonal)


def katz(edges: DataFrame, alpha: float, beta: float, rounds: int) -> DataFrame:
    """node, katz: rounds of x = alpha * (sum of x over edges into the node) + beta, from x = 0; not normalised."""
    nodes = in_out_degrees(edges).select("node")
    x = nodes.withColumn("katz", F.lit(float(beta)))
    for _ in range(rounds - 1):
        into = edges.join(x.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("katz").alias("_s"))
        x = nodes.join(into, "node", "left").select("node", (alpha * F.coalesce("_s", F.lit(0.0)) + beta).alias("katz"))
    return x


def two_steps(edges: DataFrame) -> DataFrame:
    """node, reach: walks of two edges from each node of a directed graph, by the out-degrees of its successors."""
    out = edges.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("_n"))
    return edges.join(out, "dst", "left").groupBy(F.col("src").alias("node")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("reach"))


def degree_parity(edges: DataFrame) -> DataFrame:
    """n_nodes, n_odd: a connected graph has an Euler circuit if no node has an odd degree, a path if two have."""
    return degrees(edges).agg(F.count("*").alias("n_nodes"), F.count_if(F.col("degree") % 2 == 1).alias("n_odd"))


def bipartite_degrees(edges: DataFrame) -> DataFrame:
    """node, side, degree, centrality (degree over the size of the other side) of a graph whose edges go from side 0 (src) to side 1 (dst)."""
    once = edges.select("src", "dst").distinct()
    sides = [once.groupBy(F.col(c).alias("node")).agg(F.lit(k).alias("side"), F.count("*").alias("degree")) for k, c in enumerate(("src", "dst"))]
    sizes = sides[0].agg(F.count("*").alias("_n")).crossJoin(sides[1].agg(F.count("*").alias("_m")))  # one row each
    other = F.when(F.col("side") == 0, F.col("_m")).otherwise(F.col("_n"))
    return sides[0].unionByName(sides[1]).crossJoin(F.broadcast(sizes)).select("node", "side", "degree", (F.col("degree") / other).alias("centrality"))


def edge_lines(edges: DataFrame, sep: str = " ") -> DataFrame:
    """value: a line for each edge, to be written as text."""
    return edges.select(F.concat_ws(sep, F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))


def read_edge_lines(spark, path: str, sep: str = " ") -> DataFrame:
    """src, dst of the lines of text files; blank lines and those that start with # are no edges."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    parts = F.split(F.trim("value"), sep)
    return lines.select(parts[0].cast("long").alias("src"), F.get(parts, F.lit(1)).cast("long").alias("dst"))


def adjacency(edges: DataFrame) -> DataFrame:
    """node, neighbors: successors of each node of a directed graph in order; a row's size is the node's out-degree."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("neighbors"))
