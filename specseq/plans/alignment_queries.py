"""Queries on alignments of sequences to references and on features of matches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import residues as r
from ..operators import alignments, features
from ..operators.evidence import CARBON_MONOXIDE
from ..sources import tables as t
from .kernel_queries import _name_pairs
from .result_queries import LETTERS, MASS, SEQ
from .spectra_queries import PEAKS

QUERIES, SQL = {}, {}
H, W = r.PROTON, r.WATER
# Made-up shifts of residues, so that some intervals of the names have an explanation.
SHIFTS = [("methyl", "S", "Anywhere", 14.01565), ("acetyl", "N-term", "N-term", 42.01057), ("amide", "K", "C-term", -0.98402), ("shift", "E", "Anywhere", 57.02146)]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TAGS = f"""with recursive {SEQ}, p as (select x.p_partkey a, x.seq seq_a, y.seq seq_b from s x join s y on y.p_partkey = x.p_partkey + 1),
ia as (select a, i - 1 i, substr(seq_a, i::integer, 2) w from p, unnest(range(1, greatest(len(seq_a), 1))) u(i)), ib as (select a, j - 1 j, substr(seq_b, j::integer, 2) w from p, unnest(range(1, greatest(len(seq_b), 1))) u(j)),
x as (select a, i, i - j diagonal, i - row_number() over (partition by a, i - j order by i) run from ia join ib using (a, w)),
tags as (select a, min(i)::integer a_start, (min(i) + count(*) + 1)::integer a_end, (min(i) - diagonal)::integer b_start, (min(i) - diagonal + count(*) + 1)::integer b_end from x group by a, diagonal, run)"""


@query(f"{TAGS} select a, a_start, a_end, b_start, b_end, (row_number() over (partition by a order by a_start, b_start) - 1)::integer tag from tags")
def shared_tags(spark, d):
    """Strings of two letters or more that the names of parts that follow each other share."""
    return alignments.shared_tags(_name_pairs(spark, d), "a", "seq_a", "seq_b", 2)


@query(f"""{TAGS}, ordered as (select *, row_number() over (partition by a order by a_start - a_end, a_start, b_start) k from tags),
walk as (select a, 1 k, [{{'a0': a_start, 'a1': a_end, 'b0': b_start, 'b1': b_end}}] taken from ordered where k = 1
union all select w.a, w.k + 1, case when len(list_filter(taken, lambda z: (z.a0 < o.a_end and o.a_start < z.a1) or (z.b0 < o.b_end and o.b_start < z.b1))) > 0 then taken else list_append(taken, {{'a0': o.a_start, 'a1': o.a_end, 'b0': o.b_start, 'b1': o.b_end}}) end from walk w join ordered o on o.a = w.a and o.k = w.k + 1),
done as (select a, max_by(taken, k) taken from walk group by a), z as (select a, unnest(taken) z from done)
select a, z.a0 a_start, z.a1 a_end, z.b0 b_start, z.b1 b_end from z""")
def greedy_tags(spark, d):
    return alignments.greedy_tags(shared_tags(spark, d), "a").drop("tag")


SHIFT_ROWS = ", ".join(f"('{m}', '{s}', '{p}', {x}::double)" for m, s, p, x in SHIFTS)
CHAINS = f"""{TAGS}, {MASS}, {LETTERS}, lad as (select p_partkey, pos, sum(mono) over (partition by p_partkey order by pos) mass from l join m using (sym) union all select p_partkey, 0, 0 from s),
sh as (select * from (values {SHIFT_ROWS}) v(mod, site, position, mass)), n as (select a, len(seq_a) na, len(seq_b) nb from p),
tg as (select *, (a_start || '.' || b_start) tag from tags),
iv as (select a, 's' p, tag q, 0 a0, a_start a1, unnest(range(0, b_start + 1)) b0, b_start b1 from tg union all select a, tag, 'e', a_end, na, b_end, unnest(range(b_end, nb + 1)) from tg join n using (a)
union all select x.a, x.tag, y.tag, x.a_end, y.a_start, x.b_end, y.b_start from tg x join tg y on y.a = x.a and x.a_end <= y.a_start and x.b_end <= y.b_start),
ms as (select iv.*, substr(seq_a, (a0 + 1)::integer, (a1 - a0)::integer) pa, substr(seq_b, (b0 + 1)::integer, (b1 - b0)::integer) pb, (w1.mass - w0.mass) - (v1.mass - v0.mass) shift, case when p = 's' then 'N-term' when q = 'e' then 'C-term' else '' end term
from iv join p using (a) join lad w0 on w0.p_partkey = a and w0.pos = a0 join lad w1 on w1.p_partkey = a and w1.pos = a1 join lad v0 on v0.p_partkey = a + 1 and v0.pos = b0 join lad v1 on v1.p_partkey = a + 1 and v1.pos = b1),
ch as (select *, case when pa = '' and pb = '' then 'none' when pb = '' then 'insertion' when pa = '' then 'deletion' when abs(shift) < 0.02 then 'isobaric' when exists (select 1 from sh where abs(sh.mass - shift) < 0.02 and
(site = term or (contains(pb, site) and (position = 'Anywhere' or (position = term and case when term = 'N-term' then pb[1] else pb[-1] end = site))))) then 'modified' else 'undefined' end change from ms),
co as (select *, case change when 'isobaric' then -0.5 when 'modified' then -1 when 'insertion' then -2 + greatest(a1 - a0 - 1, 0) when 'undefined' then -3 else 0 end::double cost from ch),
tw as (select tg.a, tag, (least(a_end, na - 1) - greatest(a_start, 1) + 1)::double worth from tg join n using (a)), ed as (select a, p, q, max(cost) cost from co group by 1, 2, 3),
step as (select ed.a, p, q, cost + coalesce(worth, 0) score from ed left join tw on tw.a = ed.a and tw.tag = ed.q),
reach as (select a, q, score from step where p = 's' union all select r.a, e.q, r.score + e.score from reach r join step e on e.a = r.a and e.p = r.q)"""


def _named(spark):
    return spark.createDataFrame(SHIFTS, "mod string, site string, position string, mass double")


@query(f"{CHAINS} select change, count(*) n, round(sum(shift), 3) shift from ch group by 1")
def interval_changes(spark, d):
    """How the intervals between shared tags are explained."""
    pairs = _name_pairs(spark, d)
    tags = alignments.shared_tags(pairs, "a", "seq_a", "seq_b", 2)
    rows = alignments.explained_intervals(alignments.tag_intervals(pairs, tags, "a", "seq_a", "seq_b"), pairs, "a", "seq_a", "seq_b", _named(spark), 0.02)
    return rows.groupBy("change").agg(F.count("*").alias("n"), F.round(F.sum(F.col("a_mass") - F.col("b_mass")), 3).alias("shift"))


@query(f"{CHAINS} select a, round(max(score), 4) score from reach where q = 'e' group by 1")
def tag_alignment(spark, d):
    """Score of the best chain of shared tags between names, each place of a name worth 1."""
    pairs = _name_pairs(spark, d)
    ones = F.array_repeat(F.lit(1.0), F.length("seq_a") + 1)
    return alignments.tag_alignments(pairs, "a", "seq_a", "seq_b", _named(spark), ones).select("a", F.round("score", 4).alias("score"))


def affine_traceback(spark, d):
    return alignments.affine_alignments(_name_pairs(spark, d), "seq_a", "seq_b").select("a", "score", "a_row", "b_row")


def differing_regions(spark, d):
    return alignments.differing_regions(affine_traceback(spark, d), "a")


QUERIES.update(affine_traceback=affine_traceback, differing_regions=differing_regions)

RUNGS = f"""lad as (select scan, (row_number() over (partition by scan order by mz, peak) - 1)::integer place, mz / 2 prm, total from peaks join (select o_orderkey scan, o_totalprice total from orders) using (scan))"""
IONS = f"""ions as (select scan, place, place other, ion, case ion when 'b' then prm + {H} when 'b-H2O' then prm + {H - W} when 'y' then total - prm + {H + W} else total - prm + {H} end mass from lad, (values ('b'), ('b-H2O'), ('y'), ('y-H2O')) v(ion)
union all select x.scan, x.place, y.place, 'internal', y.prm - x.prm + {H} from lad x join lad y on y.scan = x.scan and y.place > x.place
union all select scan, place, place, 'imm', gap - {CARBON_MONOXIDE} + {H} from (select scan, coalesce(lag(place) over w, -1) place, prm - coalesce(lag(prm) over w, 0) gap from (select scan, place, prm from lad union all select scan, 2147483647, max(total) from lad group by 1) window w as (partition by scan order by place))),
shown as (select scan, place, other, ion, min_by({{'peak': peak, 'offset': mz - mass, 'intensity': intensity}}, [abs(mz - mass), mz, peak]) z from ions join peaks using (scan) where abs(mz - mass) < 200 group by all)"""


def _ladders(spark, d):
    rungs = t.peaks(spark, d).join(t.totals(spark, d), "scan")
    return rungs.select("scan", (F.row_number().over(Window.partitionBy("scan").orderBy("mz", "peak")) - 1).alias("place"), (F.col("mz") / 2).alias("prm"), "total")


def _shown(spark, d):
    return features.shown_fragments(_ladders(spark, d), t.peaks(spark, d), ["b", "b-H2O", "y", "y-H2O"], 200.0)


@query(f"""with {PEAKS}, {RUNGS}, {IONS}, f as (select scan, place, bool_or(ion = 'b') b, bool_or(ion = 'y') y, bool_or(ion = 'b-H2O') bw, bool_or(ion = 'y-H2O') yw from shown where ion in ('b', 'y', 'b-H2O', 'y-H2O') group by 1, 2)
select scan, ion, count(*) n from shown group by 1, 2 union all select scan, 'only neut', count(*) from f where (not b and bw) or (not y and yw) group by 1""")
def fragment_counts(spark, d):
    """Fragments of each order's ladder that its peaks show."""
    return features.ion_counts(_shown(spark, d))


@query(f"""with {PEAKS}, {RUNGS}, {IONS}, pa as (select scan, place from lad where place % 2 = 0),
pk as (select scan, z.peak peak, bool_or(exists (select 1 from pa where pa.scan = shown.scan and pa.place = shown.place) and exists (select 1 from pa where pa.scan = shown.scan and pa.place = shown.other)) paired from shown group by 1, 2),
st as (select scan, coalesce(sum(intensity) filter (pk.peak is not null), 0) / sum(intensity) explained, count(*) filter (pk.peak is not null and rank <= 2) top_2, count(*) filter (pk.peak is not null and rank <= 4) top_4, count(*) filter (paired and rank <= 2) paired_2, count(*) filter (paired and rank <= 4) paired_4
from (select *, row_number() over (partition by scan order by intensity desc, peak) rank from peaks) q left join pk using (scan, peak) group by 1),
mv as (select scan, ion, z.offset o, abs(z.offset - lag(z.offset) over (partition by scan, ion order by place)) step from shown where ion in ('b', 'y')),
ag as (select scan, ion, avg(o) mean, max(abs(o)) most, max(step) rel from mv group by 1, 2)
select st.scan, round(explained, 6) explained, top_2, top_4, paired_2, paired_4, round(coalesce(b.mean, 400), 4) mean_b, round(coalesce(b.most, 400), 4) max_b, round(coalesce(b.rel, 400), 4) max_rel_b, round(coalesce(y.mean, 400), 4) mean_y, round(coalesce(y.most, 400), 4) max_y, round(coalesce(y.rel, 400), 4) max_rel_y
from st left join ag b on b.scan = st.scan and b.ion = 'b' left join ag y on y.scan = st.scan and y.ion = 'y'""")
def annotation_stats(spark, d):
    """Share and rank of the peaks that fragments explain, and the fragments' offsets; every second place counts as paired."""
    paired = _ladders(spark, d).where("place % 2 = 0")
    rows = features.annotation_stats(_shown(spark, d), t.peaks(spark, d), paired, 400.0, (2, 4))
    return rows.select(*[F.round(c, 6 if c == "explained" else 4).alias(c) if kind == "double" else c for c, kind in rows.dtypes])


NODES = "nodes as (select o_custkey as cluster, l_orderkey as scan, l_linenumber as place, l_quantity - 20.0 score from lineitem join orders on o_orderkey = l_orderkey)"


def _nodes(spark, d):
    orders = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("scan"), F.col("o_custkey").alias("cluster"))
    return t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan"), F.col("l_linenumber").alias("place"), (F.col("l_quantity") - 20.0).alias("score")).join(orders, "scan")


@query(f"with {NODES} select cluster, scan, round(sum(score), 4) score, count(*) filter (score < 0) negative, min(score) least from nodes group by 1, 2")
def scan_score_stats(spark, d):
    return features.scan_scores(_nodes(spark, d)).withColumn("score", F.round("score", 4))


@query(f"""with {NODES}, sc as (select cluster, scan, sum(score) score from nodes group by 1, 2), pt as (select cluster, sum(score) total, min(score) least_path, max(score) most_path, count(*) n from sc group by 1),
pl as (select cluster, place, sum(score) s, count(*) filter (score > 0) pos from nodes group by 1, 2)
select cluster, round(any_value(total), 4) total, min(s) least_node, round(any_value(least_path), 4) least_path, round(any_value(most_path), 4) most_path, count(*) filter (pos = n) all_, count(*) filter (2 * pos >= n) majority, count(*) filter (pos = 0) none_ from pl join pt using (cluster) group by 1""")
def cluster_score_stats(spark, d):
    return features.cluster_scores(_nodes(spark, d)).withColumns({c: F.round(c, 4) for c in ("total", "least_path", "most_path")})


@query(f"""with {PEAKS}, {RUNGS}, pm as (select o_orderkey pair, o_totalprice / 8 mass, o_orderstatus kind, o_orderkey % 2 = 0 light, o_orderpriority = '1-URGENT' heavy from orders),
nr as (select pair, kind, light, heavy, arg_min(place, [abs(mass - prm), prm]) place from pm join lad on lad.scan = pm.pair where abs(mass - prm) < 2000 group by 1, 2, 3, 4)
select pair, kind, count(*) n, count(*) filter (light) n_light, count(*) filter (heavy) n_heavy from nr group by 1, 2""")
def paired_place_stats(spark, d):
    orders = t.table(spark, d, "orders")
    paired = orders.select(F.col("o_orderkey").alias("pair"), (F.col("o_totalprice") / 8).alias("mass"), F.col("o_orderstatus").alias("kind"), (F.col("o_orderkey") % 2 == 0).alias("light"), (F.col("o_orderpriority") == "1-URGENT").alias("heavy"))
    return features.paired_counts(features.paired_places(paired, _ladders(spark, d).withColumnRenamed("scan", "pair"), 2000.0))


@query(f"""with {PEAKS}, {RUNGS}, w as (select scan, prm, total, total * {2e-6 * 2e4 / 5} width from lad)
select scan, floor(count(*) filter (hit) / 2)::bigint forbidden from (select x.scan, exists (select 1 from w y where y.scan = x.scan and abs(round_even((x.total - {H} - x.prm) / x.width, 0) - round_even(y.prm / x.width, 0)) <= 5) hit from w x) group by 1""")
def forbidden_pairs(spark, d):
    """Ladder masses whose complement is on the ladder too."""
    ladders = _ladders(spark, d).groupBy("scan").agg(F.collect_list("prm").alias("prms"), F.first("total").alias("total"))
    return ladders.select("scan", features.forbidden_pairs(F.col("prms"), F.col("total"), 2e4).alias("forbidden"))


@query("with tr as (select o_orderkey k, o_totalprice / 100000 p from orders where o_orderstatus = 'F') select l_orderkey k, l_linenumber, case when p < 1 then -1 else 1 end as label from lineitem join tr on k = l_orderkey")
def training_labels(spark, d):
    truth = t.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 100000).alias("p"))
    return features.training_labels(t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber"), truth, "k", "p")
