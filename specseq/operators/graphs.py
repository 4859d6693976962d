"""Graph measures on edge tables (src, dst). Undirected graphs have each edge once, in either direction."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kept(df: DataFrame) -> DataFrame:
    """df cut from its lineage in the shared folder; in local mode in a folder of our own where none is set, on a cluster that is an error."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="specseq-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once, without loops."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree of an undirected graph."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """node, centrality: degree over the number of other nodes."""
    d = degrees(edges)
    return d.crossJoin(F.broadcast(d.agg(F.count("*").alias("n")))).select("node", F.try_divide(F.col("degree").cast("double"), (F.col("n") - 1).cast("double")).alias("centrality"))


def density(edges: DataFrame) -> DataFrame:
    d = degrees(edges).agg(F.count("*").alias("n"), (F.sum("degree") / 2).cast("long").alias("m"))
    return d.select(F.col("n").alias("n_nodes"), F.col("m").alias("n_edges"), F.try_divide(2.0 * F.col("m"), F.col("n") * (F.col("n") - 1.0)).alias("density"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("n_nodes"))


def oriented(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, from the node of less degree (then number): out-degrees stay under the square root of twice the edges."""
    two, d = both_ways(edges), degrees(edges)
    a, b = d.select(F.col("node").alias("src"), F.col("degree").alias("da")), d.select(F.col("node").alias("dst"), F.col("degree").alias("db"))
    return two.join(a, "src").join(b, "dst").where("da < db or (da = db and src < dst)").select("src", "dst")


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles: triangles that each node is in (nodes without are left out)."""
    o = oriented(edges)
    wedge = o.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(o.select(F.col("src").alias("a"), F.col("dst").alias("c")), "a").where("b <> c")
    closed = wedge.join(o.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    return closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """node, clustering: triangles over possible ones, 0 for degrees under 2."""
    met = degrees(edges).join(triangles(edges), "node", "left")
    return met.select("node", F.coalesce(F.try_divide(2.0 * F.coalesce("triangles", F.lit(0)), F.col("degree") * (F.col("degree") - 1.0)), F.lit(0.0)).alias("clustering"))


def transitivity(edges: DataFrame) -> DataFrame:
    """Three times the triangles over the connected triples."""
    t = triangles(edges).agg(F.coalesce(F.sum("triangles"), F.lit(0)).alias("t"))
    w = degrees(edges).agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("w"))
    return t.crossJoin(F.broadcast(w)).select(F.coalesce(F.try_divide(F.col("t").cast("double"), F.col("w").cast("double")), F.lit(0.0)).alias("transitivity"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of the nodes with an edge to another one.

    Edges point to lesser nodes. In each round a node's greater neighbours are hung on the least of it and its neighbours, then
    its lesser ones and itself on the least of these; when nothing changes, all hang on the least node of their part. Chains shrink
    by a factor each round, so rounds grow with the logarithm of the longest one, and edges never become more than they were.
    Nodes meet by merge joins, so that no round sends a table to the driver for a broadcast.
    """
    live, before = _kept(both_ways(edges).where("src > dst")), None
    while True:
        size = live.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if size == before:
            return live.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(live.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
        before = size
        two = live.unionByName(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = two.groupBy("src").agg(F.min("dst").alias("_m")).select("src", F.least("src", "_m").alias("_m"))
        large = _kept(two.where("dst > src").join(least.hint("merge"), "src").select(F.col("dst").alias("src"), F.col("_m").alias("dst")).distinct())
        lesser = large.groupBy("src").agg(F.min("dst").alias("_m"))
        hung = large.join(lesser.hint("merge"), "src").select(F.col("dst").alias("src"), F.col("_m").alias("dst")).where("src <> dst")
        live = _kept(hung.unionByName(lesser.select("src", F.col("_m").alias("dst"))).distinct())


def pagerank(edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """node, rank after so many rounds over directed edges; nodes without out-edges share theirs with all."""
    e = _kept(edges.select("src", "dst").distinct())
    nodes = _kept(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct())
    n = nodes.count()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"))
    ranks = nodes.join(out, "node", "left").withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        sent = e.join(ranks.select(F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("give")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("give").alias("got"))
        ranks = _kept(ranks.select("node", "out").join(sent, "node", "left").crossJoin(F.broadcast(lost)).select("node", "out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank")))
    return ranks.select("node", "rank")


def hits(edges: DataFrame, rounds: int) -> DataFrame:
    """node, hub, authority after so many rounds over directed edges, each brought to a sum of 1."""
    e = _kept(edges.select("src", "dst").distinct())
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    hub = nodes.select("node", F.lit(1.0).alias("hub"))

    def summed(values: DataFrame, value: str, near: str, far: str, name: str) -> DataFrame:
        raw = e.join(values.select(F.col("node").alias(near), value), near).groupBy(F.col(far).alias("node")).agg(F.sum(value).alias(name))
        return raw.crossJoin(F.broadcast(raw.agg(F.sum(name).alias("_all")))).select("node", (F.col(name) / F.col("_all")).alias(name))

    authority = None
    for _ in range(rounds):
        authority = _kept(summed(hub, "hub", "src", "dst", "authority"))
        hub = _kept(summed(authority, "authority", "dst", "src", "hub"))
    return nodes.join(hub, "node", "left").join(authority, "node", "left").select("node", F.coalesce("hub", F.lit(0.0)).alias("hub"), F.coalesce("authority", F.lit(0.0)).alias("authority"))


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """node: the nodes of the largest part in which all have at least k neighbours."""
    two = _kept(both_ways(edges))
    while True:
        stay = two.groupBy("src").count().where(F.col("count") >= k).select("src")
        fewer = _kept(two.join(stay, "src", "left_semi").join(stay.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst"))
        if fewer.count() == two.count():
            return fewer.select(F.col("src").alias("node")).distinct()
        two = fewer


def bfs_levels(edges: DataFrame, start: Column) -> DataFrame:
    """node, level: steps from the nodes for which ``start`` (over node) holds, along directed edges."""
    e = _kept(edges.select("src", "dst").distinct())
    seen = _kept(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct().where(start).withColumn("level", F.lit(0)))
    front, level = seen, 0
    while not front.isEmpty():
        level += 1
        front = _kept(e.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        seen = _kept(seen.unionByName(front))
    return seen


def projection(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """a, b, n_common: pairs of src nodes of a bipartite graph with the number of dst nodes in common. ``tasks``: how many share the nodes, and then the pairs."""
    e = edges.select("src", "dst").distinct() if tasks is None else edges.select("src", "dst").repartition(tasks, "dst").distinct()
    pairs = e.select(F.col("src").alias("a"), "dst").join(e.select(F.col("src").alias("b"), "dst"), "dst").where("a < b").select("a", "b")
    return (pairs if tasks is None else pairs.repartition(tasks, "a", "b")).groupBy("a", "b").agg(F.count("*").alias("n_common"))


def boundary(edges: DataFrame, inside: Column) -> DataFrame:
    """Edges (src, dst) from a node for which ``inside`` (over node) holds to one for which it doesn't."""
    nodes = both_ways(edges).select(F.col("src").alias("node")).distinct().where(inside)
    return both_ways(edges).join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")


def s_metric(edges: DataFrame) -> DataFrame:
    """Sum over the edges of the product of their ends' degrees."""
    d = degrees(edges)
    a, b = d.select(F.col("node").alias("src"), F.col("degree").alias("da")), d.select(F.col("node").alias("dst"), F.col("degree").alias("db"))
    return both_ways(edges).where("src < dst").join(a, "src").join(b, "dst").agg(F.sum(F.col("da") * F.col("db")).alias("s_metric"))


def assortativity(edges: DataFrame) -> DataFrame:
    """Correlation of the degrees at both ends of the edges."""
    d = degrees(edges)
    a, b = d.select(F.col("node").alias("src"), F.col("degree").alias("da")), d.select(F.col("node").alias("dst"), F.col("degree").alias("db"))
    return both_ways(edges).join(a, "src").join(b, "dst").agg(F.corr(F.col("da").cast("double"), F.col("db").cast("double")).alias("assortativity"))


def sources_sinks(edges: DataFrame) -> DataFrame:
    """node, is_source (no edge into it), is_sink (no edge from it)."""
    out, into = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(into).groupBy("node").agg((F.max("i") == 0).alias("is_source"), (F.max("o") == 0).alias("is_sink"))


def longest_paths(edges: DataFrame) -> DataFrame:
    """node, length: edges on the longest path to each node of an acyclic graph. A graph with a cycle raises ValueError."""
    e = _kept(edges.select("src", "dst").distinct())
    nodes = _kept(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct())
    best, step, front = nodes.withColumn("length", F.lit(0)), 0, nodes
    n = nodes.count()
    while True:
        step += 1
        front = _kept(e.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct())
        if front.isEmpty():
            return best
        if step >= n:
            raise ValueError("the graph has a cycle")
        best = _kept(best.join(front.withColumn("_l", F.lit(step)), "node", "left").select("node", F.coalesce("_l", "length").alias("length")))


def path_counts(edges: DataFrame) -> DataFrame:
    """node, paths: the number of paths that lead from a node without edges into it to each node of an acyclic graph (1 for such a node itself). A graph with a cycle raises ValueError."""
    e = _kept(edges.select("src", "dst").distinct())
    ends = sources_sinks(e)
    n = ends.count()
    front = _kept(ends.where("is_source").select("node", F.lit(1).cast("long").alias("paths")))
    found, step = front, 0
    while True:
        step += 1
        front = _kept(e.join(front.select(F.col("node").alias("src"), "paths"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("paths").alias("paths")))
        if front.isEmpty():
            return found.groupBy("node").agg(F.sum("paths").alias("paths"))
        if step >= n:
            raise ValueError("the graph has a cycle")
        found = _kept(found.unionByName(front))


def reachable(edges: DataFrame, start: Column, goal: Column) -> DataFrame:
    """node: the nodes for which ``goal`` holds that some path from a node for which ``start`` holds leads to."""
    return bfs_levels(edges, start).where(goal).select("node")
