"""Near-duplicate groups by an exact Jaccard join of shingle sets with PartEnum signatures.

Two sets link when 100 * intersection >= 80 * union. Sets are banded by size; in a
band linked sets differ in at most k elements. The domain is partitioned in N1
parts of N2 second-level parts each. Of N1 > k // (K2 + 1) partitions, some partition of a linked
pair differs in at most K2 elements, so the pair agrees on all elements in some
N2 - K2 of its second-level parts. Every such subset of parts gives a signature.

Signatures of empty projections are left out. That loses no pair as long as more than
k // (K2 + 1) partitions of a set have elements in more than K2 parts; a set without so
many also sends each of its elements as a signature.

In fact a linked pair has a signature in common for every well-filled partition of either set
that isn't among the k // (K2 + 1) that may differ too much: at least T. So a set may leave
the T - 1 of its large groups that have the most members, as in prefix filters: the
rarest signature that a pair has in common is among neither's T - 1 most frequent ones.
That empties the groups of boilerplate, which pairs of unrelated sets would fill.

Documents with equal sets are one node from the start. Members of a small signature group
are all candidates; in a large one all are paired with the least first. Where links then
leave several components among the sets that large groups hold together, these are
compared block by block on sketches, and only pairs that pass become rows.

A sketch has a bit for each of at least as many parts of the domain as the set has elements,
the parity of its elements there. Sketches differ in no more bits than the sets in elements, so
a pair whose sketches differ in more than the allowed number is no link.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, in_slices, settled, sized, without_ids, written
from .dealing import SCHEMA, bucket_count, deal, dealt, gathered, mixed, runs_of
from .shingles import set_hash, shingle_sets

#: A link needs 100 * intersection >= SIMILAR * union.
SIMILAR = 80
N2, K2 = 3, 1
#: Partitions beyond the least number, per cent.
EXTRA = 20
SUBSETS = list(combinations(range(N2), N2 - K2))
#: Groups of so many members are compared all with all.
SMALL = 6
SALTS = 16
#: Bytes of text that a shingle stands for, about.
SHINGLE_BYTES = 6
#: Nodes in a block, and classes of size in a doubling: linked sets are at most two classes apart.
BLOCK, CLASSES = 512, 6


def bands(largest: int) -> list[tuple[int, int, int]]:
    """(least size, largest size, k) of the smaller sets of each band, up to the largest size that occurs."""
    found, low = [], 1
    while low <= largest:
        high = max(low, low * 3 // 2)
        found.append((low, high, (high + high * 100 // SIMILAR) * (100 - SIMILAR) // (100 + SIMILAR)))
        low = high + 1
    return found


_BANDS = bands(1 << 40)
_LOWS = np.array([b[0] for b in _BANDS])


def families(size: int) -> list[tuple[int, int]]:
    """(band, k) for which a set of this size sends signatures: its own, and those in which it may be the larger set."""
    own = int(np.searchsorted(_LOWS, size, "right")) - 1
    found = [(own, _BANDS[own][2])]
    for i in range(own - 1, -1, -1):
        if _BANDS[i][1] * 100 // SIMILAR < size:
            break
        found.append((i, _BANDS[i][2]))
    return found


def signatures(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of a set of shingles, and for each its band * 2**16 + T (1 at least)."""
    found, spare = [], []
    for band, k in families(len(s)):
        need = k // (K2 + 1)
        n1 = need + 1 + -(-(need + 1) * EXTRA // 100) + 1
        seed = mixed(np.array([band + 1], np.uint64))[0]
        x = mixed(s ^ seed)
        part = ((x >> np.uint64(32)) * np.uint64(n1 * N2) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        starts, _ = runs_of(part[order])
        where = part[order][starts]
        sums = np.zeros(n1 * N2, np.uint64)
        sums[where] = np.add.reduceat(mixed(x[order] + seed), starts)
        filled = np.zeros(n1 * N2, bool)
        filled[where] = True
        sums, filled = sums.reshape(n1, N2), filled.reshape(n1, N2)
        before = len(found)
        for j, subset in enumerate(SUBSETS):
            use = filled[:, subset].any(axis=1)
            place = (np.arange(n1, dtype=np.uint64) * np.uint64(len(SUBSETS)) + np.uint64(j) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            total = np.zeros(n1, np.uint64)
            for p in subset:  # which part an element is in follows from the element
                total += sums[:, p]
            found.append(mixed(total + place + seed)[use])
        common = int((filled.sum(axis=1) > K2).sum()) - need
        if common <= 0:
            found.append(mixed(x + ~seed))
        spare += [np.full(len(f), band * 65536 + min(max(common, 1), 65535)) for f in found[before:]]
    return np.concatenate(found), np.concatenate(spare)


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and node (a hash of the set, null for an empty one) of each row's whole text."""

    def run(batches):
        for batch in in_slices(batches, most_bytes=2 << 20):
            sets = shingle_sets([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "n_shingles", "node"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_shingles long, node long")


def _candidates(docs: DataFrame, shingles: int) -> DataFrame:
    """kind, a, b, n, spare: pairs of documents with n common signatures (kind 0), and members b of large groups a of n documents (kind 1). ``shingles`` of all documents set the number of buckets."""
    buckets = bucket_count(docs.sparkSession, SHINGLE_BYTES * shingles)

    def send(batches):
        for batch in in_slices(batches, most_bytes=8 << 20, most_rows=1 << 16):
            keys, owners, spares, seen = [], [], [], set()
            for part in in_slices([batch], most_bytes=1 << 20):
                for doc, s in zip(part.column(0).to_pylist(), shingle_sets([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    node = set_hash(s)
                    if len(s) and node not in seen and doc is not None:  # of equal sets one is enough: they are one node
                        seen.add(node)
                        got, spare = signatures(s)
                        keys.append(got)
                        owners.append(np.full(len(got), doc))
                        spares.append(spare)
            if keys:
                yield deal(np.concatenate(keys), np.concatenate(owners), np.concatenate(spares), buckets)

    def meet(batches):
        keys, docs, spares = gathered(batches)
        order = np.lexsort((docs, keys))
        keys, docs, spares = keys[order], docs[order], spares[order]
        starts, ends = runs_of(keys)
        sizes = ends - starts
        left, right = [], []
        for g in range(2, SMALL + 1):
            at = starts[sizes == g]
            for i, j in combinations(range(g), 2):
                left.append(docs[at + i])
                right.append(docs[at + j])
        if left:
            l, r = np.concatenate(left), np.concatenate(right)  # noqa: E741
            l, r = l[l != r], r[l != r]  # noqa: E741
            order = np.lexsort((r, l))
            l, r = l[order], r[order]  # noqa: E741
            first = np.nonzero(np.append(True, (l[1:] != l[:-1]) | (r[1:] != r[:-1])))[0] if len(l) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(l)))
            yield from _rows(0, l[first], r[first], n, n)
        large = np.repeat(sizes > SMALL, sizes)
        if large.any():
            yield from _rows(1, keys[large].astype(np.int64), docs[large], np.repeat(sizes, sizes)[large], spares[large])
        del keys, docs, spares, order, left, right, large
        give_back()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return dealt(rows.mapInArrow(send, SCHEMA), buckets).mapInArrow(meet, "kind int, a long, b long, n long, spare long")


def _rows(kind: int, *columns: np.ndarray):
    for at in range(0, len(columns[0]), 50_000):
        part = [pa.array(c[at : at + 50_000].astype(np.int64)) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind), pa.int32()), *part], names=["kind", "a", "b", "n", "spare"])


def components(links: DataFrame) -> DataFrame:
    """node and label (least node reachable) for each node of links (a, b), by alternating large and small stars until nothing changes.

    Nodes with many links are met through joins on counts of one row a node, never gathered.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        large = written(large, "edges")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "edges")
    stars = edges.groupBy("u").agg(F.min("v").alias("label"))
    return stars.select(F.col("u").alias("node"), "label").unionByName(stars.select(F.col("label").alias("node"), "label").distinct())


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of a set's elements by their low bits, as words of 64; folding halves onto each other gives the sketch of half as many parts."""
    bits = 1 << max(6, int(len(s) - 1).bit_length())
    odd = (np.bincount((mixed(s ^ np.uint64(0x6A09E667F3BCC909)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, 8), axis=1, bitorder="little").reshape(-1).view("<i8").astype(np.int64)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty()


def _grown(links: DataFrame, labels: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links and labels with more links, which are written first."""
    more = written(more, "links")
    if more.isEmpty():
        return links, labels
    links = links.unionByName(more)
    return links, written(components(links), "labels")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles and sketch (arrays of long) for wanted (node, doc_id): the set of the one document that stands for a node. Rows that repeat the document repeat it, which does links no harm."""
    ids = sized(wanted.select(F.col("doc_id").alias("_id"), "node"))
    joined = docs.selectExpr("cast(doc_id as long) _id", "cast(text as string) text").join(ids, "_id")

    def run(batches):
        for batch in in_slices(batches, most_bytes=1 << 20):
            sets = shingle_sets([t or "" for t in batch.column(1).to_pylist()])
            keep = [set_hash(s) == node for s, node in zip(sets, batch.column(0).to_pylist(), strict=True)]  # an id may stand for several texts
            sets = [s for s, k in zip(sets, keep, strict=True) if k]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), pa.array([s.astype(np.int64) for s in sets], kind), pa.array([sketch(s) for s in sets], kind)], names=["node", "shingles", "sketch"])

    return joined.select("node", "text").mapInArrow(run, "node long, shingles array<long>, sketch array<long>")


def _met(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """pairs with x and y, the column of a's and b's sets."""
    left, right = sets.select(F.col("node").alias("a"), F.col(column).alias("x")), sets.select(F.col("node").alias("b"), F.col(column).alias("y"))
    # a may be the least of a great many: then its row goes to SALTS parts.
    hot = pairs.groupBy("a").count().where("count > 64").select("a")
    parts = left.join(hot, "a", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).unionByName(left.join(hot, "a", "left_anti").withColumn("salt", F.lit(-1)))
    salted = pairs.join(hot.withColumn("hot", F.lit(True)), "a", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).otherwise(-1)).drop("hot")
    return salted.join(parts, ["a", "salt"]).drop("salt").join(right, "b")


def verified(pairs: DataFrame, sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link: those that sizes (node, size) and sketches allow are compared in full."""
    for x in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("node").alias(x), F.col("size").alias(f"s{x}")), x)
    pairs = pairs.where(f"100 * least(sa, sb) >= {SIMILAR} * greatest(sa, sb)")
    fold = "case when size({0}) > size({1}) then transform(slice({0}, 1, size({1})), (w, i) -> aggregate(sequence(1, cast(size({0}) / size({1}) as int) - 1), w, (t, k) -> t ^ {0}[i + k * size({1})])) else {0} end"
    apart = f"aggregate(zip_with({fold.format('x', 'y')}, {fold.format('y', 'x')}, (p, q) -> bit_count(p ^ q)), 0, (t, n) -> t + n)"
    like = written(_met(pairs, sets, "sketch").where(f"{100 + SIMILAR} * {apart} <= {100 - SIMILAR} * (sa + sb)").select("a", "b"), "pairs")
    both = F.size(F.array_intersect("x", "y"))
    return _met(like, sets, "shingles").where(100 * both >= SIMILAR * (F.size("x") + F.size("y") - both)).select("a", "b")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes have different labels."""
    of = lambda x: F.coalesce(F.col(f"l{x}"), F.col(x))
    for x in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")), x, "left")
    return pairs.where(of("a") != of("b")).select("a", "b")


@settled("groups")
def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links, itself included) of each row of docs.

    Words are runs of non-blank bytes with A-Z lower-cased. A text of fewer than
    five words has one shingle; a null text or one without words has none and
    links with nothing. Repeated rows give rows each, and an id that stands for several
    texts links them by no more than its number. A row without an id joins the
    component of a row with an equal set, and no other; alone it has null. Columns other than doc_id and text are left out.
    """
    sets = written(document_sets(docs), "sets")
    classes = written(sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size")), "classes")
    found = written(_candidates(docs, sets.agg(F.sum("n_shingles")).first()[0] or 0), "candidates")
    of_doc = sets.where("node is not null and doc_id is not null").select("doc_id", "node").distinct()
    a, b = of_doc.select(F.col("doc_id").alias("a"), F.col("node").alias("na")), of_doc.select(F.col("doc_id").alias("b"), F.col("node").alias("nb"))
    large = (
        found.where("kind = 1").select(F.col("a").alias("key"), "b", "n", "spare").join(b, "b").groupBy("key", F.col("nb").alias("node"), (F.col("spare") / 65536).cast("int").alias("band"))
        .agg(F.max("n").alias("n"), F.max(F.col("spare") % 65536).alias("spare"))
        .withColumn("turn", F.row_number().over(Window.partitionBy("node", "band").orderBy(F.desc("n"), "key"))).where("turn >= spare").select("key", "node")
    )
    members = written(large, "members")
    stars = members.join(members.groupBy("key").agg(F.min("node").alias("least")), "key").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"), F.lit(1).cast("long").alias("n"))
    by_doc = found.where("kind = 0").select("a", "b", "n").join(a, "a").join(b, "b").where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "n")
    pairs = written(by_doc.unionByName(stars).groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")

    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(classes, "node").select("node", "doc_id")
    texts = written(_sets_of(docs, written(wanted, "wanted")), "shingles")

    # First each node's likeliest partner, then what is left between components, then within large groups.
    likely = written(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"), "pairs")
    links = written(verified(likely, texts, classes), "links")
    labels = written(components(links), "labels")
    rest = written(_apart(pairs.select("a", "b").join(likely, ["a", "b"], "left_anti"), labels), "pairs")
    links, labels = _grown(links, labels, verified(rest, texts, classes))
    open_ = _labelled(members, labels).groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    open_stars = written(members.join(open_, "key", "left_semi").join(members.groupBy("key").agg(F.min("node").alias("least")), "key").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    if not open_stars.isEmpty():
        within = _within_families(written(components(open_stars), "families"), labels, texts, classes)
        links, labels = _grown(links, labels, verified(written(within, "pairs"), texts, classes))

    named = classes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    salted = named.join(least, "label").select("node", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    of_rows = sets.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    linked = of_rows.where("node is not null").join(salted, ["node", "salt"], "left").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(of_rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is the least of its near_groups() component. Rows without an id stay."""
    return without_ids(docs, near_groups(docs).where("doc_id <> component_id").select("doc_id"))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))


def _within_families(families: DataFrame, labels: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of nodes of different components within a family (node, label: sets that large groups hold together) whose sizes and sketches allow a link.

    Nodes are put in blocks of like size; a pair of blocks is one group of rows,
    and it sends only the pairs that pass.
    """
    named = families.select("node", F.col("label").alias("family")).join(labels, "node", "left").select("node", "family", F.coalesce("label", "node").alias("label"))
    open_ = named.groupBy("family").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("family")
    nodes = named.join(open_, "family", "left_semi").join(classes.select("node", "size"), "node").withColumn("class", F.floor(F.log2("size") * CLASSES).cast("int"))
    many = nodes.groupBy("family", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    nodes = nodes.join(many, ["family", "class"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
    blocks = many.select("family", "class", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    l, r = (blocks.select("family", F.struct("class", "block").alias(x)) for x in ("one", "two"))  # noqa: E741
    meets = l.join(r, "family").where("one <= two and two.class - one.class <= 2").withColumn("meet", F.xxhash64("family", "one", "two"))
    side = lambda k, x: F.struct(F.lit(k).alias("side"), F.col(f"{x}.class").alias("class"), F.col(f"{x}.block").alias("block"))
    own, other = F.array(side(2, "one")), F.array(side(0, "one"), side(1, "two"))
    sides = meets.select("meet", "family", F.inline(F.when(F.col("one") == F.col("two"), own).otherwise(other)))

    def compare(table: pa.Table) -> pa.Table:
        side, node, label, size = (table.column(c).to_numpy() for c in ("side", "node", "label", "size"))
        sketches = [np.array(x, np.int64) for x in table.column("sketch").to_pylist()]
        width = min(map(len, sketches))
        folded = np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in sketches]).view(np.uint64)  # signed numbers' bits are counted by their absolute value
        left, right = (np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]) if (side < 2).all() else (np.arange(len(side)), np.arange(len(side)))
        found = []
        for i in left.tolist():
            others = right[(label[right] != label[i]) & ((side[right] < 2) | (right > i))]
            if len(others):
                apart = np.bitwise_count(folded[others] ^ folded[i]).sum(axis=1, dtype=np.int64)
                others = others[(100 + SIMILAR) * apart <= (100 - SIMILAR) * (size[others] + size[i])]
                found.append(np.stack([np.minimum(node[others], node[i]), np.maximum(node[others], node[i])]))
        out = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(out[0]), "b": pa.array(out[1])})

    rows = nodes.join(sets.select("node", "sketch"), "node").join(sides, ["family", "class", "block"]).select("meet", "side", "node", "label", "size", "sketch")
    return rows.groupBy("meet").applyInArrow(compare, "a long, b long").distinct()
