"""Queries on grouped kernels; what SQL can't express, tests hold against slow models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import residues as r
from ..operators import alignments, kernels
from ..sources import tables as t


def _name_pairs(spark, d):
    s = t.table(spark, d, "part").select("p_partkey", r.normalised(F.col("p_name")).alias("seq"))
    return s.select(F.col("p_partkey").alias("a"), F.col("seq").alias("seq_a"), (F.col("p_partkey") + 1).alias("b")).join(s.select(F.col("p_partkey").alias("b"), F.col("seq").alias("seq_b")), "b")


def agglomerative_clusters(spark, d):
    return kernels.agglomerative_clusters(t.table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice", 100000.0, 0.8)


def linkage_clusters(spark, d):
    return kernels.linkage_clusters(t.table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice", 20000.0)


def affine_align(spark, d):
    return alignments.affine_alignments(_name_pairs(spark, d), "seq_a", "seq_b", 1.0, -1.0, -1.5, -0.5).drop("a_row", "b_row")


def longest_common_substring(spark, d):
    return kernels.pairwise(_name_pairs(spark, d), kernels.longest_common, "seq_a", "seq_b", "common", "string")


def suboptimal_paths(spark, d):
    return kernels.spectrum_paths(t.peaks(spark, d), 2000.0, 60000.0, 0.9, 1000.0)


def unique_clusters_fold(spark, d):
    rows = t.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (F.col("o_orderkey") % 97).alias("score"))
    return kernels.unique_fold(rows, "o_custkey", ["o_orderkey"], "o_totalprice", "score", 20000.0, 100000.0)


_AA = "".join(r.RESIDUES)
SQL = {
    "longest_common_substring": f"""with s as (select p_partkey, regexp_replace(translate(upper(p_name), 'LUZB', 'ICQN'), '[^{_AA}]', '', 'g') seq from part), p as (select x.p_partkey a, x.seq seq_a, y.p_partkey b, y.seq seq_b from s x join s y on y.p_partkey = x.p_partkey + 1),
c as (select a, substr(seq_a, i::integer, k::integer) sub, k, i from p, unnest(range(1, length(seq_a) + 1)) u(i), unnest(range(1, length(seq_a) + 2 - i)) v(k) where contains(seq_b, substr(seq_a, i::integer, k::integer))),
m as (select *, row_number() over (partition by a order by k desc, i) n from c) select p.a, seq_a, p.b, seq_b, coalesce(sub, '') common from p left join m on m.a = p.a and n = 1""",
    "linkage_clusters": """with recursive v as (select o_custkey, o_orderkey, o_totalprice p, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) i from orders),
st as (select o_custkey, o_orderkey, p, i, p lowest, 0::bigint single, 0::bigint complete from v where i = 1 union all select v.o_custkey, v.o_orderkey, v.p, v.i, case when v.p - lowest > 20000 then v.p else lowest end,
  single + case when v.p - st.p < 20000 then 0 else 1 end, complete + case when v.p - lowest > 20000 then 1 else 0 end from st join v on v.o_custkey = st.o_custkey and v.i = st.i + 1) select o_custkey, o_orderkey, single, complete from st""",
    "unique_clusters_fold": """with recursive v as (select *, o_orderkey % 97 score, row_number() over (partition by o_custkey order by o_orderkey) i from orders),
st as (select o_custkey, i, 0 part, o_orderkey kept, o_totalprice mass, score, 1::bigint n from v where i = 1 union all select s.o_custkey, s.i, s.part + s.cut, case when s.takes then s.o_orderkey else s.kept end, case when s.takes then s.o_totalprice else s.mass end, case when s.takes then s.vs else s.score end, case when s.cut = 1 then 1 else s.n + 1 end
  from (select st.o_custkey, st.part, st.kept, st.mass, st.score, st.n, v.i, v.o_orderkey, v.o_totalprice, v.score vs, case when abs(v.o_totalprice - mass) < 20000 or abs(abs(v.o_totalprice - mass) - 100000) < 20000 then 0 else 1 end cut,
    not (abs(v.o_totalprice - mass) < 20000 or abs(abs(v.o_totalprice - mass) - 100000) < 20000) or v.score > st.score takes from st join v on v.o_custkey = st.o_custkey and v.i = st.i + 1) s)
select o_custkey, kept o_orderkey, mass o_totalprice, score, n from (select *, row_number() over (partition by o_custkey, part order by i desc) k from st) where k = 1""",
}
QUERIES = {f.__name__: f for f in (agglomerative_clusters, linkage_clusters, affine_align, longest_common_substring, suboptimal_paths, unique_clusters_fold)}
