"""Queries on scans and peaks. In QUERIES each takes (spark, folder); SQL has the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranges, scores, spectra
from ..sources import tables as t

PEAKS = "peaks as (select l_orderkey scan, l_partkey * 100000 + l_suppkey peak, max(l_extendedprice) mz, sum(l_quantity) intensity from lineitem group by 1, l_partkey, l_suppkey)"
PAIRS = "pairs as (select * from (select o_orderkey light, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) heavy from orders) where heavy is not null)"
QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select a.c_custkey light, b.c_custkey heavy, a.c_acctbal light_mass, b.c_acctbal heavy_mass from customer a join customer b on abs(b.c_acctbal - a.c_acctbal - 100) < 0.5")
def delta_pairs(spark, d):
    return ranges.delta_pairs(t.table(spark, d, "customer"), "c_custkey", "c_acctbal", 100.0, 0.5)


@query("select a.o_orderkey light, b.o_orderkey heavy, a.o_totalprice light_mass, b.o_totalprice heavy_mass from orders a join orders b on b.o_totalprice - a.o_totalprice between 5995 and 6005 and a.o_totalprice > 0 and abs(b.o_totalprice - a.o_totalprice - 6000) < 5 * 1e-6 * b.o_totalprice")
def delta_pairs_ppm(spark, d):
    return ranges.delta_pairs_ppm(t.table(spark, d, "orders"), "o_orderkey", "o_totalprice", 6000.0, 5.0)


CLUSTERS = """c as (select *, sum(new) over (order by o_totalprice, o_orderkey rows unbounded preceding)::bigint cluster_id from
  (select o_orderkey, o_totalprice, case when lag(o_totalprice) over w is null or o_totalprice - lag(o_totalprice) over w >= 50 * 1e-6 * o_totalprice then 1 else 0 end new from orders window w as (order by o_totalprice, o_orderkey)))"""


def _clusters(spark, d):
    return ranges.gap_clusters(t.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 50.0)


@query(f"with {CLUSTERS} select o_orderkey, o_totalprice, cluster_id from c")
def ppm_clusters(spark, d):
    return _clusters(spark, d)


@query(f"with {CLUSTERS} select cluster_id, count(*) n, round(avg(o_totalprice), 4) mass from c group by 1")
def cluster_mean_mass(spark, d):
    return _clusters(spark, d).groupBy("cluster_id").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mass"))


@query("select c_custkey, c_acctbal from customer x where not exists (select 1 from customer y where abs(y.c_acctbal - x.c_acctbal - 100) < 0.5 or abs(x.c_acctbal - y.c_acctbal - 100) < 0.5)")
def unpaired_scans(spark, d):
    return ranges.unpaired(t.table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal", 100.0, 0.5)


@query(f"with {PEAKS} select o_custkey, round_even(mz / 500, 0)::bigint bucket, round(avg(mz), 4) mz, round(avg(intensity) * count(distinct scan), 4) intensity, count(distinct scan) n_spec from peaks join orders on scan = o_orderkey group by 1, 2")
def merge_spectra(spark, d):
    p = t.peaks(spark, d).join(t.table(spark, d, "orders").select(F.col("o_orderkey").alias("scan"), "o_custkey"), "scan")
    return spectra.merge_spectra(t.dealt(p, "o_custkey", of=t.table(spark, d, "lineitem")), "o_custkey", 500.0).withColumns({"mz": F.round("mz", 4), "intensity": F.round("intensity", 4)})


SHARED = f"""{PEAKS}, {PAIRS}, spots as (select scan, round_even(mz / 2000, 0)::bigint bucket, sum(intensity) intensity from peaks group by 1, 2),
sizes as (select scan, count(*) n, sum(intensity) tic from spots group by 1),
both_ as (select light, heavy, count(*) n_shared, sum(a.intensity) il, sum(b.intensity) ih from pairs join spots a on a.scan = light join spots b on b.scan = heavy and a.bucket = b.bucket group by 1, 2),
shared as (select light, heavy, x.n nl, y.n nh, x.tic tl, y.tic th, coalesce(n_shared, 0) ns, coalesce(il, 0) il, coalesce(ih, 0) ih from pairs join sizes x on x.scan = light join sizes y on y.scan = heavy left join both_ using (light, heavy))"""


@query(f"with {SHARED} select light, heavy, nl::bigint n_light, nh::bigint n_heavy, ns::bigint n_shared, round(2.0 * ns / (nl + nh), 6) ratio from shared")
def shared_peak_ratio(spark, d):
    s = spectra.shared_peaks(t.scan_pairs(spark, d), t.peaks(spark, d), 2000.0)
    return s.select("light", "heavy", "n_light", "n_heavy", F.col("n_shared").cast("long").alias("n_shared"), F.round(2.0 * F.col("n_shared") / (F.col("n_light") + F.col("n_heavy")), 6).alias("ratio"))


@query(f"with {SHARED} select light, heavy, round(2.0 * ns / (nl + nh), 6) shared_ratio, round(ns / nl, 6) light_ratio, round(ns / nh, 6) heavy_ratio, round((il + ih) / (tl + th), 6) tic_ratio, round(il / tl, 6) light_tic_ratio, round(ih / th, 6) heavy_tic_ratio from shared")
def pair_features(spark, d):
    f = spectra.pair_features(spectra.shared_peaks(t.scan_pairs(spark, d), t.peaks(spark, d), 2000.0))
    return f.select("light", "heavy", *[F.round(c, 6).alias(c) for c in f.columns[2:]])


@query("select l_returnflag, count(*) filter (l_linestatus = 'F') as f, count(*) filter (l_linestatus = 'O') as o, count(distinct l_orderkey) scans from lineitem group by 1")
def ion_pair_types(spark, d):
    rows = t.table(spark, d, "lineitem")
    wide = rows.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0).select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"))
    return wide.join(rows.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("scans")), "l_returnflag")


TOTALS = "totals as (select o_orderkey scan, o_totalprice total from orders)"


@query(f"with {PEAKS}, {TOTALS} select p.scan, p.peak, p.mz from peaks p join totals t using (scan) where exists (select 1 from peaks q where q.scan = p.scan and q.peak <> p.peak and abs(t.total - p.mz - q.mz) < 2000)")
def symmetric_ions(spark, d):
    return spectra.symmetric(t.peaks(spark, d), t.totals(spark, d), 2000.0)


@query(f"with {PEAKS}, {PAIRS}, {TOTALS} select light, heavy, l.peak light_peak, h.peak heavy_peak from pairs join peaks l on l.scan = light join totals t on t.scan = heavy join peaks h on h.scan = heavy and abs(l.mz - (t.total - h.mz + 500)) < 1000")
def cross_paired_ions(spark, d):
    return spectra.cross_paired(t.scan_pairs(spark, d), t.peaks(spark, d), t.totals(spark, d), 500.0, 1000.0)


@query("""with near as (select c_custkey, c_acctbal, s_suppkey, s_acctbal, row_number() over (partition by c_custkey order by abs(c_acctbal - s_acctbal), s_acctbal, s_suppkey) n
  from customer join supplier on abs(c_acctbal - s_acctbal) <= 50) select c.c_custkey, c.c_acctbal, s_suppkey, s_acctbal from customer c left join near on near.c_custkey = c.c_custkey and n = 1""")
def nearest_peak(spark, d):
    return ranges.nearest(t.table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal", t.table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey", "s_acctbal", 50.0)


def _bin_sql(expression: str) -> str:
    return f"""with {PEAKS}, r as (select *, sum(intensity) over (partition by scan) tic, row_number() over (partition by scan order by intensity, peak) - 1 rank, count(*) over (partition by scan) n from peaks),
  b as (select *, avg(case when rank < ceil(n / 3) then intensity end) over (partition by scan) base from r) select scan, peak, ({expression})::bigint bin from b"""


def _binned(f):
    return lambda spark, d: f(t.peaks(spark, d), 5).select("scan", "peak", "bin")


for _name, _f, _sql in (
    ("tic_log_bin", spectra.log_tic_bin, "greatest(1, 4 + ceil(round(log10(intensity / tic), 9)))"),
    ("tic_linear_bin", spectra.linear_tic_bin, "ceil(round(intensity / tic * 4, 9))"),
    ("rank_percent_bin", spectra.rank_percent_bin, "ceil(round((rank + 1) / n * 4, 9))"),
    ("log_percent_bin", spectra.log_percent_bin, "least(-floor(round(ln((n - rank) / (n + 1)) / ln(power(0.05, -1.0 / 3)), 9)), 4)"),
    ("baseline_bin", spectra.baseline_bin, "least(greatest(1, ceil(round(log10(intensity / base), 9)) + 1), 4)"),
):
    QUERIES[_name], SQL[_name] = _binned(_f), _bin_sql(_sql)


@query(f"""with {PEAKS}, b as (select scan, floor(mz / 10000)::bigint region, greatest(1, 4 + ceil(round(log10(intensity / sum(intensity) over (partition by scan)), 9))) bin from peaks),
c as (select scan, region, least(count(*) filter (bin = 1) * 0.05::double, 1) h1, least(count(*) filter (bin = 2) * 0.05::double, 1) h2, least(count(*) filter (bin = 3) * 0.05::double, 1) h3, least(count(*) filter (bin = 4) * 0.05::double, 1) h4 from b group by 1, 2),
p as (select scan, region, unnest([0, 1, 2, 3, 4]) bin, unnest([(1 - h1) * (1 - h2) * (1 - h3) * (1 - h4), h1 * (1 - h2) * (1 - h3) * (1 - h4), h2 * (1 - h3) * (1 - h4), h3 * (1 - h4), h4]) p from c)
select scan, region, bin::integer bin, round(case when p = 0 then 0.05 else p end, 9)::double p from p""")
def noise_model(spark, d):
    return spectra.noise_model(spectra.log_tic_bin(t.peaks(spark, d), 5), 4, 10000.0, 500.0).withColumn("p", F.round("p", 9))


@query(f"with {PEAKS}, r as (select *, row_number() over (partition by scan order by intensity desc, peak) rank from peaks) select scan, peak, mz, intensity, rank::integer rank from r where rank <= 3")
def topk_peaks(spark, d):
    return spectra.top_peaks(t.peaks(spark, d), 3)


@query(f"""with {PEAKS}, r as (select *, row_number() over (partition by scan order by intensity desc, peak) rank from peaks), top as (select * from r where rank <= 4),
m as (select o_orderkey scan, unnest([o_totalprice / 2, o_totalprice / 4, o_totalprice / 8]) theory from orders)
select scan, round(coalesce(sum(intensity) filter (exists (select 1 from m where m.scan = top.scan and abs(m.theory - top.mz) < 3000)), 0) / sum(intensity), 6) explained from top group by 1""")
def explained_intensity(spark, d):
    masses = t.totals(spark, d).select("scan", F.explode(F.array(*[F.col("total") / n for n in (2, 4, 8)])).alias("theory"))
    return spectra.explained(t.peaks(spark, d), masses, 3000.0, 4).withColumn("explained", F.round("explained", 6))


@query(f"with {PEAKS} select scan, peak, tier::integer tier, row_number() over (partition by scan order by tier, intensity desc, peak)::integer evidence_rank from (select *, case when mz > 80000 then 0 when mz > 40000 then 1 else 2 end tier from peaks)")
def evidence_rank(spark, d):
    tier = F.when(F.col("mz") > 80000, 0).when(F.col("mz") > 40000, 1).otherwise(2)
    return spectra.evidence_rank(t.peaks(spark, d), tier).select("scan", "peak", "tier", "evidence_rank")


@query("""with c as (select l_linestatus, l_returnflag, count(*) n from lineitem group by 1, 2), f as (select a.l_linestatus, b.l_returnflag, coalesce(n, 0) n from (select distinct l_linestatus from c) a cross join (select distinct l_returnflag from c) b left join c using (l_linestatus, l_returnflag))
select l_linestatus, l_returnflag, n::bigint n, round((n + 1) / (sum(n) over w + count(*) over w), 9) p from f window w as (partition by l_linestatus)""")
def cpt_train(spark, d):
    return scores.conditional_table(t.table(spark, d, "lineitem"), "l_returnflag", ["l_linestatus"]).select("l_linestatus", "l_returnflag", "n", F.round("p", 9).alias("p"))


@query("""with s as (select o_orderkey, ln((o_totalprice / 500000) * 0.5 / 0.1) s from orders) select o_orderkey, round(case when s > 0 then s else 3 * s end, 6) score from s""")
def node_score(spark, d):
    return t.table(spark, d, "orders").select("o_orderkey", F.round(scores.node_score(F.col("o_totalprice") / 500000, F.lit(0.5), F.lit(0.1)), 6).alias("score"))


@query(f"with {PEAKS} select scan, peak, (row_number() over (partition by scan order by mz desc, peak) - 1)::integer rank, round(mz - max(mz) over (partition by scan), 4) delta, round(mz / max(mz) over (partition by scan), 6) norm from peaks")
def psm_rank_delta(spark, d):
    r = scores.ranks_and_deltas(t.peaks(spark, d), "scan", "peak", "mz")
    return r.select("scan", "peak", "rank", F.round("delta", 4).alias("delta"), F.round("norm", 6).alias("norm"))


@query("select c_custkey, round(-1 + 2 * (c_acctbal - min(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ()), 6) scaled from customer")
def min_max_scale(spark, d):
    return scores.min_max(t.table(spark, d, "customer"), "c_acctbal").select("c_custkey", F.round("scaled", 6).alias("scaled"))


@query("select vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * (0.03125 * ((i - 1) % 8) - 0.1))) + 0.25, 6) score from embeddings")
def linear_score(spark, d):
    weights = [0.03125 * (i % 8) - 0.1 for i in range(64)]
    return t.table(spark, d, "embeddings").select("vec_id", F.round(scores.linear_score(scores.doubles("embedding"), weights, 0.25), 6).alias("score"))


STUMPS = [(i, 0.01 * i - 0.1, 0.5 ** (i % 4)) for i in range(0, 20, 2)]


@query("select vec_id, round(" + " + ".join(f"case when embedding[{i + 1}]::double > {c} then {w} else 0 end" for i, c, w in STUMPS) + ", 6)::double score from embeddings")
def boost_score(spark, d):
    return t.table(spark, d, "embeddings").select("vec_id", F.round(scores.boost_score(scores.doubles("embedding"), STUMPS), 6).alias("score"))


@query("""with m as (select label, i, avg(embedding[i]::double) v from (select label, embedding, unnest(range(1, 65)) i from embeddings) group by 1, 2), s as (select case when label < 5 then 1.0 else -1.0 end coef, list(v order by i) e from m group by label)
select vec_id, round(sum(coef * exp(-0.5 * list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::double - e[i]::double) * (embedding[i]::double - e[i]::double))))) - 0.1, 6)::double decision from embeddings, s group by vec_id""")
def rbf_svm_score(spark, d):
    e = t.table(spark, d, "embeddings")
    means = e.select("label", F.posexplode(scores.doubles("embedding")).alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    support = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("sv"))  # the model: a mean vector for each label
    support = support.select(F.when(F.col("label") < 5, 1.0).otherwise(-1.0).alias("coef"), "sv")
    rows = e.select("vec_id", scores.doubles("embedding").alias("x"))
    return scores.rbf_decision(rows, "vec_id", "x", support, 0.5, 0.1).withColumn("decision", F.round("decision", 6))


@query("""with c as (select label, list_transform(range(1, 65), lambda i: 0) z from embeddings limit 0), m as (select label, unnest(range(1, 65)) i, embedding from embeddings),
a as (select label, i, avg(embedding[i]::double) v from m group by 1, 2), n as (select label, sqrt(sum(v * v)) norm from a group by 1),
x as (select vec_id, label own, unnest(range(1, 65)) i, embedding from embeddings), y as (select vec_id, own, i, embedding[i]::double v from x), z as (select vec_id, sqrt(sum(v * v)) norm from y group by 1)
select y.vec_id, round(sum(y.v * a.v) / any_value(z.norm * n.norm), 6) cosine from y join a on a.label = y.own and a.i = y.i join n on n.label = y.own join z on z.vec_id = y.vec_id group by 1""")
def cosine_match(spark, d):
    """Each vector against the mean vector of its label."""
    e = t.table(spark, d, "embeddings").select("vec_id", "label", scores.doubles("embedding").alias("x"))
    means = e.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("m"))
    cosine = scores.dot(F.col("x"), F.col("m")) / F.sqrt(scores.dot(F.col("x"), F.col("x")) * scores.dot(F.col("m"), F.col("m")))
    return e.join(means, "label").select("vec_id", F.round(cosine, 6).alias("cosine"))
