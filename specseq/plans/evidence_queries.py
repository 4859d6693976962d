"""Queries on the evidence of peaks: paired ions, deltas and their ranks, nodes and node scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import residues as r
from ..operators import evidence, scores, sequences, spectra
from ..sources import tables as t
from .result_queries import LETTERS, MASS, PRM, SEQ, _sequences
from .spectra_queries import PAIRS, PEAKS, TOTALS

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


H, W = r.PROTON, r.WATER
# The ion types once more, as offsets from a prefix mass (n) or from what is left of the whole (c).
ION_VALUES = """ions as (select * from (values ('b', 'n', 1.00727638), ('b-H2O', 'n', -17.00328832), ('b-NH3', 'n', -16.01927272), ('b-H2O-H2O', 'n', -35.01385302), ('b-H2O-NH3', 'n', -34.02983742), ('a', 'n', -26.98763822),
('a-H2O', 'n', -44.99820292), ('a-NH3', 'n', -44.01418732), ('y', 'c', 19.01784108), ('y-H2O', 'c', 1.00727638), ('y-NH3', 'c', 1.99129198), ('y-H2O-H2O', 'c', -17.00328832), ('y-H2O-NH3', 'c', -16.01927272),
('c', 'n', 18.03382548), ('z', 'c', 2.9991170121), ('c-1', 'n', 17.0260004479), ('z+1', 'c', 4.0069420442), ('c-H2O', 'n', 0.02326078)) v(ion, side, offs))"""


@query(f"with {SEQ}, {MASS}, {LETTERS}, {PRM}, {ION_VALUES}, w as (select p_partkey, max(prm) pm from prm group by 1) select p_partkey, pos::integer pos, ion, round(case when side = 'n' then prm + offs::double else pm - prm + offs::double end, 4) mass from prm join w using (p_partkey), ions where pos < n")
def ion_masses(spark, d):
    """Masses of all ion types at each inner place of a sequence."""
    nodes = sequences.ladder_rows(_sequences(spark, d), "p_partkey", "seq")
    whole = _sequences(spark, d).select("p_partkey", F.aggregate(r.letters(F.col("seq")), F.lit(0.0), lambda s, c: s + r.residue_mass(c)).alias("pm"))
    ions = F.array(*[F.struct(F.lit(i).alias("ion"), F.round(evidence.ion_mass(i, F.col("prm"), F.col("pm")), 4).alias("mass")) for i in evidence.IONS])
    return nodes.join(whole, "p_partkey").select("p_partkey", "pos", F.inline(ions))


@query(f"""with {SEQ}, {MASS}, {LETTERS}, {PRM}, w as (select p_partkey, max(prm) pm, max(pos) n from prm group by 1), ends as (select p_partkey, pos, prm from prm union all select p_partkey, 0, 0 from w),
x as (select p_partkey, pos, prm, pm, a.sym as before, b.sym as after from ends join w using (p_partkey) left join l a using (p_partkey, pos) left join (select p_partkey, pos - 1 pos, sym from l) b using (p_partkey, pos))
select p_partkey, pos::integer pos, least(floor(5 * prm / pm), 4)::integer place, (case when before is null then 0 when after is null then 1 else 2 end)::integer terminus from x""")
def node_attributes(spark, d):
    """Relative place and terminus of all nodes of a sequence, its ends included."""
    x = r.letters(F.col("seq"))
    step = lambda s, c: F.concat(s, F.array(F.element_at(s, -1) + r.residue_mass(c)))
    rows = _sequences(spark, d).where("seq <> ''").select("p_partkey", x.alias("x"), F.aggregate(x, F.array(F.lit(0.0)), step).alias("s"))
    nodes = rows.select("p_partkey", "x", F.element_at("s", -1).alias("pm"), F.posexplode("s").alias("pos", "prm"))
    before, after = F.get("x", F.col("pos") - 1), F.get("x", F.col("pos"))
    return nodes.select("p_partkey", "pos", evidence.relative_place(F.col("prm"), F.col("pm")).alias("place"), evidence.terminus(before, after).alias("terminus"))


PLACED = "placed as (select *, row_number() over (partition by scan order by mz, peak) - 1 place from peaks)"


def _probed(name: str, delta: float) -> str:
    return f"""{name}_l as (select light, heavy, round_even(mz / 2000, 0)::bigint bucket, max(place) light_place from pairs join placed on scan = light group by 1, 2, 3),
{name}_p as (select light, heavy, place heavy_place, turn, round_even((mz - {delta}) / 2000, 0)::bigint + step bucket from pairs join placed on scan = heavy, (values (0, 0), (1, -1), (2, 1)) v(turn, step)),
{name}_t as (select *, row_number() over (partition by light, heavy, heavy_place order by turn) n from {name}_p join {name}_l using (light, heavy, bucket)),
{name} as (select light, heavy, bucket, max(light_place) light_place, min(heavy_place) heavy_place from {name}_t where n = 1 group by 1, 2, 3)"""


@query(f"with {PEAKS}, {PAIRS}, {PLACED}, {_probed('q', 500.0)} select light, heavy, bucket, light_place::integer light_place, heavy_place::integer heavy_place from q")
def paired_ions(spark, d):
    """Peaks of consecutive orders that pair at a shift of 500."""
    return evidence.probed_pairs(t.scan_pairs(spark, d), evidence.placed(t.peaks(spark, d)), 500.0, 2000.0)


@query(f"""with {PEAKS}, {PAIRS}, {PLACED}, {_probed('n', 500.0)}, {_probed('c', 0.0)}, k as (select scan, count(*) n from peaks group by 1), b as (select light, heavy, count(*) n from (select light, heavy from n union all select light, heavy from c) group by 1, 2)
select light, heavy, round(coalesce(b.n, 0) / (x.n + y.n), 6) ratio from pairs join k x on x.scan = light join k y on y.scan = heavy left join b using (light, heavy)""")
def terminal_ion_ratio(spark, d):
    """Pairs of N-terminal (shifted by 500) and C-terminal ions over the peaks of both scans."""
    peaks, pairs = evidence.placed(t.peaks(spark, d)), t.scan_pairs(spark, d)
    both = evidence.probed_pairs(pairs, peaks, 500.0, 2000.0).unionByName(evidence.probed_pairs(pairs, peaks, 0.0, 2000.0)).groupBy("light", "heavy").agg(F.count("*").alias("n"))
    sizes = peaks.groupBy("scan").agg(F.count("*").alias("k"))
    met = pairs.join(sizes.toDF("light", "x"), "light").join(sizes.toDF("heavy", "y"), "heavy").join(both, ["light", "heavy"], "left")
    return met.select("light", "heavy", F.round(F.coalesce("n", F.lit(0)) / (F.col("x") + F.col("y")), 6).alias("ratio"))


@query(f"with {PEAKS}, {TOTALS} select scan, peak, ion, round(case when ion = 'b' then mz - {H} else total + {W} + {H} - mz end, 4) mass, intensity from peaks join totals using (scan), (values ('b'), ('y')) v(ion)")
def fragment_deltas(spark, d):
    """What each peak means as a b and as a y ion."""
    return evidence.fragment_deltas(t.peaks(spark, d), t.totals(spark, d)).withColumn("mass", F.round("mass", 4))


EVIDENCE = f"""spots as (select light, heavy, 'light' side, scan, peak, mz, intensity from pairs join peaks on scan = light union all select light, heavy, 'heavy', scan, peak, mz, intensity from pairs join peaks on scan = heavy),
numbered as (select *, round_even(mz / 2000, 0)::bigint part, row_number() over (partition by light, heavy, side, round_even(mz / 2000, 0) order by peak) k from spots),
ions as (select n.*, case when k = 1 then 'b' else 'y' end ion, total from numbered n join totals t on t.scan = light where k <= 2),
met as (select light, heavy, part, count(*) filter (side = 'light') nl, count(*) filter (side = 'heavy') nh, avg(case when ion = 'b' then mz - {H} - case when side = 'heavy' then 500 else 0 end else total - mz + {H} + {W} end) mass, sum(intensity) intensity, count(*) n from ions group by 1, 2, 3),
tiers as (select light, heavy, part, mass, intensity, n, case when nl = 2 and nh = 2 then 0 when nl = 2 or nh = 2 then 1 else 2 end tier from met where nl > 0 and nh > 0),
lone as (select s.light, s.heavy, case when ion = 'b' then mz - {H} else total + {W} + {H} - mz end mass, intensity, 1 n, 3 tier from numbered s join totals t on t.scan = s.light, (values ('b'), ('y')) v(ion)
  where k > 2 or not exists (select 1 from tiers x where x.light = s.light and x.heavy = s.heavy and x.part = s.part)),
every as (select light, heavy, mass, intensity, n, tier from tiers union all select * from lone)"""


def _evidence(spark, d):
    """Deltas of pairs of orders: peaks of both in a bucket of 2000 are one part, the first of each scan a b and the second a y ion; others mean both."""
    pairs, peaks, totals = t.scan_pairs(spark, d), t.peaks(spark, d), t.totals(spark, d).toDF("light", "total")
    side = lambda s: pairs.join(peaks.withColumnRenamed("scan", s), s).withColumn("side", F.lit(s))
    columns = ["light", "heavy", "side", "peak", "mz", "intensity"]
    spots = side("light").select(columns).unionByName(side("heavy").select(columns)).withColumn("part", evidence.bucket(F.col("mz"), 2000.0)).join(totals, "light")
    spots = t.dealt(spots, "light", "heavy", of=t.table(spark, d, "lineitem"), per=t.TASK_ROWS // 2)  # a peak is in two pairs
    w = evidence.Window.partitionBy("light", "heavy", "side", "part").orderBy("peak")
    spots = spots.withColumn("k", F.row_number().over(w)).withColumns({"ion": F.when(F.col("k") == 1, "b").otherwise("y"), "n": F.lit(1)})
    tiers = evidence.evidence_deltas(spots.where("k <= 2"), 500.0, 0.0)
    sides = evidence.Window.partitionBy("light", "heavy", "part")
    alone = spots.withColumn("_alone", F.min("side").over(sides) == F.max("side").over(sides)).where("k > 2 or _alone")
    mass = F.array(F.col("mz") - H, F.col("total") + (W + H) - F.col("mz"))
    lone = alone.select("light", "heavy", F.explode(mass).alias("mass"), "intensity", F.lit(1).cast("long").alias("n"), F.lit(3).alias("tier"))
    return tiers.unionByName(lone), totals


@query(f"with {PEAKS}, {PAIRS}, {TOTALS}, {EVIDENCE} select light, heavy, tier::integer tier, n::bigint n, round(intensity, 4) intensity, count(*) deltas, round(sum(mass), 2) mass from every group by 1, 2, 3, 4, 5")
def evidence_tiers(spark, d):
    """Deltas of each pair by tier, number of ions and intensity."""
    every, _ = _evidence(spark, d)
    return every.groupBy("light", "heavy", "tier", "n", F.round("intensity", 4).alias("intensity")).agg(F.count("*").alias("deltas"), F.round(F.sum("mass"), 2).alias("mass"))


@query(f"""with {PEAKS}, {PAIRS}, {TOTALS}, {EVIDENCE}, g as (select *, row_number() over (partition by light, heavy order by tier, n desc, intensity desc, mass) - 1 rank from every)
select light, heavy, round(mass, 2) mass, rank::integer rank from g join totals on scan = light where rank < 6 and mass > 56.02146 and mass < total - 56.02146""")
def spectrum_nodes(spark, d):
    """The six best ranked deltas of each pair that fit between its ends."""
    every, totals = _evidence(spark, d)
    return evidence.graph_nodes(evidence.ranked(every, ["light", "heavy"]).join(totals, "light"), 6).select("light", "heavy", F.round("mass", 2).alias("mass"), "rank")


@query(f"""with {PEAKS}, {TOTALS}, {PLACED}, x as (select scan, place, mz mass, round_even(mz / 1000, 0) own, round_even((total + {W} - mz) / 1000, 0) other from placed join totals using (scan))
select scan, mass, (select max_by(y.mass, y.place) from x y where y.scan = x.scan and abs(y.other - x.own) <= 3) partner from x""")
def symmetric_nodes(spark, d):
    """Each peak's mass with that of the last one that is its complement."""
    nodes = evidence.placed(t.peaks(spark, d)).join(t.totals(spark, d), "scan").withColumnRenamed("mz", "mass")
    return evidence.symmetric_nodes(nodes, 3000.0)


LOOKED = f"""nodes as (select scan, peak node, mz / 2 prm, total from peaks join totals using (scan)),
want as (select scan, node, prm, total, ion, case when ion = 'b' then prm + {H} else total - prm + {H + W} end mass from nodes, (values ('b'), ('y')) v(ion)),
binned as (select *, greatest(1, 4 + ceil(round(log10(intensity / sum(intensity) over (partition by scan)), 9)))::bigint bin from peaks),
looked as (select w.scan, node, prm, total, ion, mass, coalesce((select max(bin) from binned b where b.scan = w.scan and abs(round_even(w.mass / 400, 0) - round_even(b.mz / 400, 0)) <= 5), 0) bin from want w)"""


def _looked(spark, d):
    """The bins of the b and y ions of nodes: each peak's half mass is a node."""
    binned = spectra.log_tic_bin(t.peaks(spark, d), 5)
    nodes = t.peaks(spark, d).join(t.totals(spark, d), "scan").select("scan", F.col("peak").alias("node"), (F.col("mz") / 2).alias("prm"), "total")
    mass = F.array(*[F.struct(F.lit(i).alias("ion"), evidence.ion_mass(i, F.col("prm"), F.col("total")).alias("mass")) for i in ("b", "y")])
    return evidence.looked_up(nodes.select("scan", "node", "prm", "total", F.inline(mass)), binned, 2000.0), binned


@query(f"with {PEAKS}, {TOTALS}, {LOOKED} select scan, node, ion, bin::integer bin from looked")
def ion_bins(spark, d):
    return _looked(spark, d)[0].select("scan", "node", "ion", F.col("bin").cast("int").alias("bin"))


NOISE = """c as (select scan, floor(mz / 10000)::bigint region, least(count(*) filter (bin = 1) * 0.2::double, 1) h1, least(count(*) filter (bin = 2) * 0.2::double, 1) h2, least(count(*) filter (bin = 3) * 0.2::double, 1) h3, least(count(*) filter (bin = 4) * 0.2::double, 1) h4 from binned group by 1, 2),
p as (select scan, region, unnest([0, 1, 2, 3, 4]) bin, unnest([(1 - h1) * (1 - h2) * (1 - h3) * (1 - h4), h1 * (1 - h2) * (1 - h3) * (1 - h4), h2 * (1 - h3) * (1 - h4), h3 * (1 - h4), h4]) p from c),
reach as (select scan, ceil(max(mz) / 10000)::bigint regions from peaks group by 1),
chance as (select k.*, case when floor(mass / 10000) < 0 or floor(mass / 10000) >= regions then case when k.bin = 0 then 1 else 0 end when p is not null then case when p = 0 then 0.2 else p end when k.bin = 0 then 1 else 0.2 end::double p
  from looked k join reach using (scan) left join p on p.scan = k.scan and p.region = floor(mass / 10000) and p.bin = k.bin)"""


@query(f"with {PEAKS}, {TOTALS}, {LOOKED}, {NOISE} select scan, node, round(product(p), 9) noise from chance group by 1, 2")
def node_noise(spark, d):
    """Chance that noise alone gives the bins of a node's ions."""
    looked, binned = _looked(spark, d)
    return _noise(spark, d, looked, binned).withColumn("noise", F.round("noise", 9))


def _noise(spark, d, looked, binned):
    reach = t.peaks(spark, d).groupBy("scan").agg(F.ceil(F.max("mz") / 10000.0).cast("long").alias("regions"))
    return evidence.noise_chances(looked, spectra.noise_model(binned, 4, 10000.0, 2000.0), reach, 10000.0, 2000.0)


@query(f"""with {PEAKS}, {TOTALS}, {LOOKED}, {NOISE}, noise as (select scan, node, product(p) noise from chance group by 1, 2),
wide as (select scan, node, max(bin) filter (ion = 'b') b, max(bin) filter (ion = 'y') y, least(floor(5 * max(prm) / max(total)), 4)::integer place from looked group by 1, 2),
lik as (select y, b, (n + 1) / (sum(n) over (partition by y) + count(*) over (partition by y)) lik from (select i.y, j.b, count(w.b) n from (select distinct y from wide) i cross join (select distinct b from wide) j left join wide w on w.y = i.y and w.b = j.b group by 1, 2)),
pri as (select place, count(*) / sum(count(*)) over () pri from wide group by 1),
s as (select scan, node, ln(lik * pri / noise) s from wide join lik using (y, b) join pri using (place) join noise using (scan, node) where noise > 0)
select scan, count(*) nodes, round(sum(case when s > 0 then s else 3 * s end), 4) score from s group by 1""")
def spectrum_scores(spark, d):
    """Node scores summed by scan: likelihood of the b bin under the y bin and prior of the place, trained on the nodes themselves, over noise."""
    looked, binned = _looked(spark, d)
    wide = looked.groupBy("scan", "node").agg(F.max(F.when(F.col("ion") == "b", F.col("bin"))).alias("b"), F.max(F.when(F.col("ion") == "y", F.col("bin"))).alias("y"), evidence.relative_place(F.max("prm"), F.max("total")).alias("place"))
    likelihood = scores.conditional_table(wide, "b", ["y"]).select("y", "b", F.col("p").alias("lik"))
    prior = wide.groupBy("place").agg(F.count("*").alias("k"))
    prior = prior.crossJoin(F.broadcast(prior.agg(F.sum("k").alias("all")))).select("place", (F.col("k") / F.col("all")).alias("pri"))  # PLACES rows
    rows = wide.join(F.broadcast(likelihood), ["y", "b"]).join(F.broadcast(prior), "place").join(_noise(spark, d, looked, binned), ["scan", "node"]).where("noise > 0")  # bins squared, and PLACES rows
    return rows.withColumn("s", scores.node_score(F.col("lik"), F.col("pri"), F.col("noise"))).groupBy("scan").agg(F.count("*").alias("nodes"), F.round(F.sum("s"), 4).alias("score"))
