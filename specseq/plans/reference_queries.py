"""Queries that look for passages in documents by seeds, both as residue strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import residues as r
from ..operators import references
from ..sources import tables as t
from .result_queries import AA, MASS

QUERIES, SQL = {}, {}
K, DRIFT, SPARE, REACH = 16, 4, 250.0, 400


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NORMAL = f"regexp_replace(translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'LUZB', 'ICQN'), '[^{AA}]', '', 'g')"
SEEDS = f"""item as (select item_id, {NORMAL} seq from benchmark), doc as (select doc_id, {NORMAL} seq from documents),
qs as (select item_id, i, substr(seq, i::int + 1, {K}) seed from item, unnest(range(0, greatest(length(seq) - {K - 1}, 0))) u(i)),
rs as (select doc_id, j, substr(seq, j::int + 1, {K}) seed from doc, unnest(range(0, greatest(length(seq) - {K - 1}, 0))) u(j)),
mt as (select item_id, doc_id, i, j from qs join rs using (seed)),
rn as (select item_id, doc_id, i - j d, min(i) i, count(*) + {K - 1} n from (select *, i - row_number() over (partition by item_id, doc_id, i - j order by i) g from mt) group by item_id, doc_id, i - j, g),
an as (select item_id, doc_id, d ad from (select *, row_number() over (partition by item_id, doc_id order by n desc, i, d) k from rn) where k = 1),
ch as (select rn.* from rn join an using (item_id, doc_id) where abs(d - ad) <= {DRIFT}),
cv as (select item_id, doc_id, count(distinct p) score from ch, unnest(range(i, i + n)) u(p) group by 1, 2),
en as (select item_id, doc_id, min(i) a_start, max(i + n) a_end, min(i - d) b_start, max(i - d + n) b_end from ch group by 1, 2),
best as (select *, row_number() over (partition by item_id order by score desc, doc_id) k, count(*) over (partition by item_id, score) refs from cv join en using (item_id, doc_id))"""


def _normal(spark, d):
    seq = r.normalised(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")).alias("seq")  # capitals of other letters differ between systems
    return t.table(spark, d, "benchmark").select("item_id", seq), t.table(spark, d, "documents").select("doc_id", seq)


def _best(spark, d):
    items, docs = _normal(spark, d)
    matches = references.seed_matches(items, "item_id", "seq", docs, "doc_id", "seq", K)
    return references.best_reference(references.chained(matches, "item_id", "doc_id", K, DRIFT), "item_id", "doc_id"), items, docs


@query(f"with {SEEDS} select item_id, doc_id, count(*) seeds, count(distinct i - j) diagonals from mt group by 1, 2")
def seed_candidates(spark, d):
    """Documents that have strings of sixteen residues in common with a passage, by how many."""
    items, docs = _normal(spark, d)
    m = references.seed_matches(items, "item_id", "seq", docs, "doc_id", "seq", K)
    return m.groupBy("item_id", "doc_id").agg(F.count("*").alias("seeds"), F.countDistinct(F.col("i") - F.col("j")).alias("diagonals"))


@query(f"with {SEEDS} select item_id, doc_id, score, a_start, a_end, b_start, b_end, refs as \"references\" from best where k = 1")
def best_reference(spark, d):
    """The document in which a passage is found best."""
    return _best(spark, d)[0].select("item_id", "doc_id", "score", *[F.col(c).cast("long").alias(c) for c in ("a_start", "a_end", "b_start", "b_end")], "references")


FLANKS = f"""{MASS}, top as (select best.*, item.seq q, doc.seq r from best join item using (item_id) join doc using (doc_id) where k = 1),
lim as (select item_id, (select coalesce(sum(mono), 0) from unnest(range(1, a_start + 1)) u(p), m where sym = substr(q, p::int, 1)) before, (select coalesce(sum(mono), 0) from unnest(range(a_end + 1, length(q) + 1)) u(p), m where sym = substr(q, p::int, 1)) behind from top),
fl as (select item_id, p, sum(mono) over (partition by item_id order by p) total from top, unnest(range(1, {REACH} + 1)) u(p), m where b_start - p >= 0 and sym = substr(r, (b_start - p + 1)::int, 1)),
fr as (select item_id, p, sum(mono) over (partition by item_id order by p) total from top, unnest(range(1, {REACH} + 1)) u(p), m where sym = substr(r, (b_end + p)::int, 1)),
nl as (select item_id, count(*) n from fl join lim using (item_id) where before > 0 and total < before + {SPARE} group by 1), nr as (select item_id, count(*) n from fr join lim using (item_id) where behind > 0 and total < behind + {SPARE} group by 1)"""


@query(f"with {SEEDS}, {FLANKS} select item_id, doc_id, coalesce(nl.n, 0) as \"left\", coalesce(nr.n, 0) as \"right\", md5(substr(r, (b_start - coalesce(nl.n, 0) + 1)::int, (b_end - b_start + coalesce(nl.n, 0) + coalesce(nr.n, 0))::int)) region from top left join nl using (item_id) left join nr using (item_id)")
def extended_reference(spark, d):
    """Those regions with the residues beside them that the passage's loose ends may stand for."""
    best, items, docs = _best(spark, d)
    rows = references.extended(best, items, "item_id", "seq", docs, "doc_id", "seq", SPARE, REACH)
    return rows.select("item_id", "doc_id", F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"), F.md5("region").alias("region"))
