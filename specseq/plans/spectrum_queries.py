"""Queries on isotopes, shifted alignments and strings with modifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import isotopes, modifications, shifts
from ..sources import tables as t
from .program_queries import MODS
from .result_queries import AA, MASS
from .spectra_queries import PEAKS

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _isotope_peaks(spark, d):
    """Lines' parts as peaks with their isotopes: the charge goes by the part, the shares by the mass."""
    lines = t.peaks(spark, d).withColumn("mz", F.col("mz") / 60 + 100).withColumn("z", (F.col("peak") % 3 + 1).cast("int"))
    carbons = ((F.col("mz") * F.col("z")) / isotopes.RESIDUE_MASS * isotopes.RESIDUE_CARBONS).cast("int")
    share = F.lit(1.0)
    rows = [F.struct(F.col("mz").alias("mz"), F.col("intensity").cast("double").alias("intensity"))]
    for k in range(1, 5):  # each share from the one before: (n - k + 1) / k times the odds of a heavy carbon
        share = share * F.greatest(carbons - k + 1, F.lit(0)) / k * (isotopes.HEAVY / (1 - isotopes.HEAVY))
        rows.append(F.struct((F.col("mz") + k * isotopes.STEP / F.col("z")).alias("mz"), (F.col("intensity") * share).alias("intensity")))
    return lines.select("scan", F.inline(F.array(*rows)))


def deisotope(spark, d):
    """Orders' peaks with isotopes of one to three charges, brought back to single masses."""
    return isotopes.deisotope_envelopes(_isotope_peaks(spark, d), t.totals(spark, d))


def spectral_align_k(spark, d):
    """Most masses of consecutive orders that follow each other with one shift of their offset."""
    paths = shifts.shifted_paths(_mass_pairs(spark, d), 1, 500.0)
    return paths.groupBy("light", "heavy").agg(F.count("*").alias("matches"))


def _mass_pairs(spark, d):
    lists = t.peaks(spark, d).groupBy("scan").agg(F.array_sort(F.collect_list("mz")).alias("m"))  # a scan's peaks
    pairs = t.scan_pairs(spark, d)
    return pairs.join(lists.select(F.col("scan").alias("light"), F.col("m").alias("a")), "light").join(lists.select(F.col("scan").alias("heavy"), F.col("m").alias("b")), "heavy").select("light", "heavy", "a", "b")


def shifted_paths(spark, d):
    """The paths of such alignments with up to two shifts, a row a match."""
    return shifts.shifted_paths(_mass_pairs(spark, d), 2, 500.0)


QUERIES |= {f.__name__: f for f in (deisotope, spectral_align_k, shifted_paths)}


@query(f"with {PEAKS}, s as (select scan, sum(intensity) total_i, sum(case when mz <= o_totalprice / 4 then intensity else 0 end) low from peaks join orders on o_orderkey = scan group by 1), c as (select scan, case when scan % 3 = 0 then 2 end charge, total_i <= 0 or low / total_i >= 0.95 one from s) select scan, unnest(case when charge is not null then [charge] when one then [1] else [2, 3] end)::integer charge from c")
def charge_guesses(spark, d):
    """Charges of orders that state one, and guesses for the others from what lies below a quarter of the total."""
    stated = t.totals(spark, d).select("scan", (F.col("total") / 4).alias("total"), F.when(F.col("scan") % 3 == 0, 2).alias("charge"))
    return isotopes.charge_guesses(t.peaks(spark, d), stated)


LOCATED = f"""{MODS.replace('p_size * 1.25::double - 20 as added', "case p_size % 4 when 0 then 'N-term' when 1 then 'C-term' else 'Anywhere' end place, p_size * 1.25::double - 20 as added")},
ends as (select distinct place, mod, round(mono + added, 8) mass from mods join m on site = sym or site = 'W' where place <> 'Anywhere'),
anyw as (select distinct 'Anywhere' place, mod, round(mono + added, 8) mass from mods join m on site = sym where place = 'Anywhere'),
heavy as (select place, mass from (select * from ends union all select * from anyw) where mass > 43 and not exists (select 1 from m where abs(round_even(mono / 0.0025, 0) - round_even(mass / 0.0025, 0)) <= 8) group by 1, 2),
letters as (select 'Anywhere' place, sym, mono mass, 0 n from m union all select place, 'X', mass, 1 from heavy),
st as (select v.of place, sym seq, n, mass from letters, (values ('Anywhere'), ('N-term'), ('C-term')) v(of) where mass < 230 and (place = 'Anywhere' or place = v.of)
  union all select st.place, case when st.place = 'C-term' then sym || seq else seq || sym end, st.n + l.n, st.mass + l.mass from st, letters l where l.place = 'Anywhere' and st.mass + l.mass < 230)"""


def _strings(spark, d):
    site = F.substr(F.lit(AA), (F.col("p_size") % 19 + 1).cast("int"), F.lit(1))
    place = F.when(F.col("p_size") % 4 == 0, "N-term").when(F.col("p_size") % 4 == 1, "C-term").otherwise("Anywhere")
    mods = t.table(spark, d, "part").select(F.col("p_brand").alias("mod"), site.alias("site"), place.alias("place"), (F.col("p_size") * 1.25 - 20).alias("mass")).distinct()
    # W stands for the whole end, where the place is one.
    mods = mods.withColumn("site", F.when((F.col("site") == "W") & (F.col("place") != "Anywhere"), F.col("place")).otherwise(F.col("site")))
    return modifications.blind_mod_strings(modifications.located_residues(mods), 230.0)


@query(f"with recursive {MASS}, {LOCATED} select place, seq, count(*) n, round(min(mass), 5) lightest from st group by 1, 2")
def blind_mod_strings(spark, d):
    """All strings under 230 Da of residues and of residues with a brand's mass, by the end that they stand at."""
    return _strings(spark, d).groupBy("place", "seq").agg(F.count("*").alias("n"), F.round(F.min("mass"), 5).alias("lightest"))


@query(f"with recursive {MASS}, {LOCATED} select c_custkey, place, count(*) strings, sum(n)::bigint mods from customer join st on abs(c_acctbal - mass) < 0.5 group by 1, 2")
def blind_mod_lookup(spark, d):
    """How many such strings explain a customer's balance, and their modified residues."""
    rows = t.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return modifications.explained(rows, "c_acctbal", _strings(spark, d), 0.5).groupBy("c_custkey", "place").agg(F.count("*").alias("strings"), F.sum(F.size("mods")).alias("mods"))
