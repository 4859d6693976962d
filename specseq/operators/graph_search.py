"""Strong components, spanning forests, weighted paths, independent sets and matchings on edge tables, in rounds whose state is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graphs import _kept, both_ways, components

#: Nodes from -HALF to HALF - 1 leave a bit of a long free.
HALF = 1 << 62


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of a directed graph (src, dst).

    Nodes without an edge into them or from them are components of their own and are trimmed off. Among the
    others the least node that leads to a node is its colour, spread along edges; what leads back to the colour's
    own node within the colour is its component. These are taken out, and the rest is done again.
    """
    whole = edges.select("src", "dst")
    nodes = _kept(whole.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    live, rest, found = _kept(whole.where("src <> dst").distinct()), nodes, []
    while True:
        while True:  # trim
            stay = live.select(F.col("src").alias("node")).intersect(live.select(F.col("dst").alias("node")))
            stay = _kept(stay)
            trimmed = rest.join(stay, "node", "left_anti")
            if trimmed.isEmpty():
                break
            found.append(_kept(trimmed.select("node", F.col("node").alias("component"))))
            rest, live = stay, _inside(live, stay)
        if rest.isEmpty():
            break
        colour = _kept(rest.select("node", F.col("node").alias("colour")))
        front = colour
        while not front.isEmpty():
            seen = live.join(front.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("seen"))
            fresh = _kept(colour.join(seen, "node", "left").select("node", F.least("colour", F.coalesce("seen", "colour")).alias("colour"), (F.col("seen") < F.col("colour")).alias("new")))
            colour, front = fresh.select("node", "colour"), fresh.where("new").select("node", "colour")
        back = _kept(_of_one_colour(live, colour).select(F.col("dst").alias("near"), F.col("src").alias("node"), "colour"))
        taken = front = _kept(colour.where("node = colour"))
        while not front.isEmpty():
            front = _kept(back.join(front.select(F.col("node").alias("near")), "near").select("node", "colour").distinct().join(taken.select("node"), "node", "left_anti"))
            taken = _kept(taken.unionByName(front))
        found.append(taken.select("node", F.col("colour").alias("component")))
        rest = _kept(rest.join(taken.select("node"), "node", "left_anti"))
        live = _inside(live, rest)
    result = nodes.limit(0).select("node", F.col("node").alias("component"))
    for part in found:
        result = result.unionByName(part)
    return result


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    return _kept(edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))


def _of_one_colour(edges: DataFrame, colour: DataFrame) -> DataFrame:
    a, b = colour.select(F.col("node").alias("src"), "colour"), colour.select(F.col("node").alias("dst"), F.col("colour").alias("_other"))
    return edges.join(a, "src").join(b, "dst").where("colour = _other").select("src", "dst", "colour")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """src, dst, weight: the minimum spanning forest of an undirected graph (src, dst, weight), each edge from its lesser node; of equal weights the lesser edge.

    In each round every part takes its least edge to another part; parts that these join become one, and edges within a part are dropped.
    """
    order = F.struct("weight", "src", "dst")
    ends = edges.where("src <> dst and weight is not null").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight"))
    live = _kept(ends.select(F.col("src").alias("u"), F.col("dst").alias("v"), "src", "dst", "weight"))
    chosen = []
    while not live.isEmpty():
        both = live.select("u", "v", order.alias("e")).unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v"), order.alias("e")))
        least = _kept(both.groupBy("u").agg(F.min(F.struct("e", "v")).alias("x")).select("u", F.col("x.v").alias("to"), "x.e.*"))
        chosen.append(least.select("src", "dst", "weight").distinct())
        # Parts point to one another along their least edges, two of each tree at each other: the lesser of these is the root.
        back = least.select(F.col("u").alias("to"), F.col("to").alias("_back"))
        roots = _kept(least.select("u", "to").join(back, "to", "left").select("u", F.when((F.col("_back") == F.col("u")) & (F.col("u") < F.col("to")), F.col("u")).otherwise(F.col("to")).alias("to")))
        while True:
            jump = roots.select(F.col("u").alias("to"), F.col("to").alias("far"))
            nearer = _kept(roots.join(jump, "to").select("u", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
            roots = nearer.select("u", "to")
            if nearer.where("moved").isEmpty():
                break
        name = lambda x: roots.select(F.col("u").alias(x), F.col("to").alias(f"_{x}"))
        joined = live.join(name("u"), "u").join(name("v"), "v").where("_u <> _v")
        live = _kept(joined.groupBy(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).agg(F.min(order).alias("e")).select("u", "v", "e.src", "e.dst", "e.weight"))
    result = ends.limit(0).select("src", "dst", "weight")
    for part in chosen:
        result = result.unionByName(part)
    return result


def weighted_paths(edges: DataFrame, sources: DataFrame, width: float) -> DataFrame:
    """node, distance, previous: least sums of weights from any of the sources (node) along directed edges (src, dst, weight), and the node before on such a path, the least of equal ones; null at a source.

    Nodes whose distance has changed wait in buckets of ``width``; the edges of the lowest bucket's nodes are relaxed
    in each round. Nodes that no path reaches have no row. A weight under 0 raises ValueError.
    """
    e = _kept(edges.where("weight is not null").groupBy("src", "dst").agg(F.min("weight").cast("double").alias("weight")))
    if not e.where("weight < 0").isEmpty():
        raise ValueError("weights must not be negative")
    best = _kept(sources.select("node").distinct().select("node", F.lit(0.0).alias("distance"), F.lit(None).cast("long").alias("previous"), F.lit(True).alias("open")))
    while True:
        lowest = best.where("open").agg(F.min(F.floor(F.col("distance") / width))).first()[0]
        if lowest is None:
            return best.drop("open")
        now = F.col("open") & (F.floor(F.col("distance") / width) == lowest)
        step = e.join(best.where(now).select(F.col("node").alias("src"), "distance"), "src")
        offers = step.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct((F.col("distance") + F.col("weight")).alias("d"), F.col("src").alias("p"))).alias("offer"))
        nearer = F.col("distance").isNull() | (F.col("offer.d") < F.col("distance"))
        same = (F.col("offer.d") == F.col("distance")) & (F.col("offer.p") < F.col("previous"))
        met = best.withColumn("open", F.col("open") & ~now).join(offers, "node", "full")
        take = F.coalesce(F.col("offer").isNotNull() & (nearer | same), F.lit(False))
        best = _kept(met.select("node", F.when(take, F.col("offer.d")).otherwise(F.col("distance")).alias("distance"), F.when(take, F.col("offer.p")).otherwise(F.col("previous")).alias("previous"), F.when(F.col("offer").isNotNull() & nearer, True).otherwise(F.coalesce("open", F.lit(False))).alias("open")))


def path_to(paths: DataFrame, goals: DataFrame) -> DataFrame:
    """goal, step (from 0, at the goal), node: weighted_paths()' rows followed back from each goal (node) to a source; goals that aren't reached have no row."""
    front = _kept(goals.select("node").distinct().join(paths, "node").select(F.col("node").alias("goal"), F.lit(0).alias("step"), "node", "previous"))
    found, step = front, 0
    while True:
        step += 1
        front = _kept(front.where("previous is not null").select("goal", F.col("previous").alias("node")).join(paths, "node").select("goal", F.lit(step).alias("step"), "node", "previous"))
        if front.isEmpty():
            return found.select("goal", "step", "node")
        found = found.unionByName(front)


def independent_set(edges: DataFrame, priority: Column | None = None) -> DataFrame:
    """node: a maximal set of nodes without an edge between them: the one that taking nodes by rising priority (over node, then by node) gives; by default a hash.

    In each round all nodes before all of their neighbours are taken, and their neighbours leave. Edges from a node to itself don't count.
    """
    rank = F.xxhash64("node") if priority is None else priority
    nodes = _kept(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("rank", F.struct(rank.alias("rank"), "node")))
    two, taken = _kept(both_ways(edges)), []
    live = nodes
    while True:
        lowest = two.join(live.select(F.col("node").alias("dst"), "rank"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("rank").alias("least"))
        new = _kept(live.join(lowest, "node", "left").where("least is null or rank < least").select("node"))
        if new.isEmpty():
            break
        taken.append(new)
        gone = new.unionByName(two.join(new.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"))).distinct()
        live = _kept(live.join(gone, "node", "left_anti"))
        two = _inside(two, live)
    result = nodes.limit(0).select("node")
    for part in taken:
        result = result.unionByName(part)
    return result


def maximal_matching(edges: DataFrame) -> DataFrame:
    """src, dst, weight: a maximal set of edges (src, dst, weight) of which no two meet: the one that taking edges by rising weight, then src and dst, gives.

    In each round all edges before all of those that they meet are taken, and what they meet leaves. Edges count once, from their lesser node.
    """
    once = edges.where("src <> dst and weight is not null").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight"))
    live, taken = _kept(once), []
    empty = live.limit(0)
    order = F.struct("weight", "src", "dst")
    while not live.isEmpty():
        least = live.select(F.explode(F.array("src", "dst")).alias("node"), order.alias("e")).groupBy("node").agg(F.min("e").alias("e"))
        new = _kept(least.groupBy("e").count().where("count = 2").select("e.*").select("src", "dst", "weight"))
        taken.append(new)
        used = _kept(new.select(F.explode(F.array("src", "dst")).alias("node")))
        live = _kept(live.join(used.select(F.col("node").alias("src")), "src", "left_anti").join(used.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "weight"))
    result = empty
    for part in taken:
        result = result.unionByName(part)
    return result


def vertex_cover(edges: DataFrame) -> DataFrame:
    """node: nodes that meet every edge (src, dst, weight) between different nodes: the ends of maximal_matching(), at most twice as many as need be."""
    return maximal_matching(edges).select(F.explode(F.array("src", "dst")).alias("node"))


def attracting_components(edges: DataFrame) -> DataFrame:
    """node, component of the strong components that no edge leaves: where a walk ends up."""
    strong = _kept(strong_components(edges))
    a, b = strong.select(F.col("node").alias("src"), F.col("component").alias("_a")), strong.select(F.col("node").alias("dst"), F.col("component").alias("_b"))
    left = edges.select("src", "dst").join(a, "src").join(b, "dst").where("_a <> _b").select(F.col("_a").alias("component")).distinct()
    return strong.join(left, "component", "left_anti").select("node", "component")


def flow_hierarchy(edges: DataFrame) -> DataFrame:
    """One row: edges (different ones, loops too), and hierarchy, the share of them that are in no cycle; null without an edge."""
    strong = _kept(strong_components(edges))
    a, b = strong.select(F.col("node").alias("src"), F.col("component").alias("_a")), strong.select(F.col("node").alias("dst"), F.col("component").alias("_b"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").agg(F.count("*").alias("edges"), F.avg((F.col("_a") != F.col("_b")).cast("double")).alias("hierarchy"))


def is_acyclic(edges: DataFrame) -> bool:
    """Whether a directed graph has no cycle: nodes without an edge into them are taken off until none is left, or all edges are gone."""
    live = _kept(edges.select("src", "dst").distinct())
    while not live.isEmpty():
        fewer = _kept(live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        if fewer.count() == live.count():
            return False
        live = fewer
    return True


def two_colouring(edges: DataFrame) -> DataFrame:
    """node, component, colour, bipartite: 0 or 1 by the steps from the least node of the component, and whether no edge of the component joins equal colours; if one does, colour is null. A node with an edge to itself makes its component no bipartite one.

    Each node stands on two sides, and an edge leads from either side of one end to the other side of the other. A part of
    that graph that holds both sides of a node has a walk of odd length from it to itself. No round goes over the steps.
    """
    known = _kept(edges.select("src", "dst").where("src is not null and dst is not null"))
    kind = known.schema["src"].dataType
    # One number for a node and its side goes faster through joins than two; nodes that leave no bit for it keep two.
    if isinstance(kind, T.IntegralType) and known.where(f"src not between {-HALF} and {HALF - 1} or dst not between {-HALF} and {HALF - 1}").isEmpty():
        place = lambda x, side: F.shiftleft(F.col(x).cast("long"), 1).bitwiseOR(F.lit(side))
        parts = lambda x: F.struct(F.shiftright(x, 1).cast(kind).alias("node"), F.col(x).bitwiseAND(F.lit(1)).cast("int").alias("side")).alias(x)
    else:
        place, parts = lambda x, side: F.struct(F.col(x).alias("node"), F.lit(side).alias("side")), F.col
    cover = known.select(place("src", 0).alias("src"), place("dst", 1).alias("dst")).unionByName(known.select(place("src", 1).alias("src"), place("dst", 0).alias("dst")))
    sides = components(cover).select(parts("node"), parts("component"))
    side = lambda n: F.max(F.when(F.col("node.side") == n, F.col("component.side")))
    both = sides.groupBy("node.node").agg(F.max("component.node").alias("component"), side(0).alias("_colour"), side(1).alias("_other"))
    # Parts of an even walk only hold the component's least node on one side each.
    bipartite = F.col("_colour") != F.col("_other")
    return both.select("node", "component", F.when(bipartite, F.col("_colour")).alias("colour"), bipartite.alias("bipartite"))


def core_numbers(edges: DataFrame) -> DataFrame:
    """node, core: the greatest k such that the node is in a part of the undirected graph in which all have at least k neighbours.

    In each round the nodes with at most k neighbours left are taken off with core k; if none has, k rises to the least number that there is.
    """
    live, k, found = _kept(both_ways(edges)), 0, []
    empty = live.select(F.col("src").alias("node"), F.lit(0).cast("long").alias("core")).limit(0)
    while not live.isEmpty():
        degree = _kept(live.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")))
        k = max(k, degree.agg(F.min("n")).first()[0])
        gone = _kept(degree.where(F.col("n") <= k).select("node", F.lit(k).cast("long").alias("core")))
        found.append(gone)
        stay = degree.join(gone, "node", "left_anti").select("node")
        left = _inside(live, stay)
        # Nodes that stay without a neighbour leave with this k, as all of theirs did.
        bare = _kept(stay.join(left.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(k).cast("long").alias("core")))
        found.append(bare)
        live = left
    result = empty
    for part in found:
        result = result.unionByName(part)
    return result


def eigenvector_centrality(edges: DataFrame, rounds: int) -> DataFrame:
    """node, centrality of an undirected graph after so many rounds: each node gets its neighbours' and its own, brought to a length of 1."""
    two = _kept(both_ways(edges))
    rows = two.select(F.col("src").alias("node")).distinct().withColumn("centrality", F.lit(1.0))
    for _ in range(rounds):
        given = two.join(rows.select(F.col("node").alias("dst"), F.col("centrality").alias("_c")), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("_c").alias("_got"))
        raw = _kept(rows.join(given, "node").select("node", (F.col("centrality") + F.col("_got")).alias("_raw")))
        size = raw.agg(F.sqrt(F.sum(F.col("_raw") * F.col("_raw"))).alias("_size"))
        rows = _kept(raw.crossJoin(F.broadcast(size)).select("node", (F.col("_raw") / F.col("_size")).alias("centrality")))
    return rows
