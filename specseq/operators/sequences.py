"""Peptide and text sequences in long form: ladders, tags, chunks, k-mers, mass look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.residues import ladder, letters
from .ranges import range_join


def ladder_rows(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """key, pos (from 1), prm: prefix masses of each sequence."""
    return rows.select(key, F.posexplode(ladder(F.col(sequence))).alias("pos", "prm")).withColumn("pos", F.col("pos") + 1)


def ladders_shared(pairs: DataFrame, a: str, b: str, tolerance: float) -> DataFrame:
    """pairs with n_a, n_b, and n_shared: masses of ladder a that ladder b has within the tolerance."""
    near = F.filter(a, lambda x: F.exists(b, lambda y: F.abs(x - y) < tolerance))
    return pairs.withColumns({"n_a": F.size(a), "n_b": F.size(b), "n_shared": F.size(near)})


def adjacent(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """key, pos (from 1), before, after: the residues at both sides of each inner place of a sequence."""
    x = letters(F.col(sequence))
    return rows.select(key, F.posexplode(F.arrays_zip(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))).alias("before"), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))).alias("after"))).alias("pos", "z")).select(key, (F.col("pos") + 1).alias("pos"), "z.before", "z.after")


#: Characters that are cut out of a text at once, and of those again: a substring costs as much as what lies before it in its string.
LONG_PIECE, SHORT_PIECE = 4096, 64


def _pieces(rows: DataFrame, key: str, text: str, at: str, k: int, size: int) -> DataFrame:
    """key, text, at: texts of at least k characters cut to pieces of ``size`` and k - 1 more; at is where a piece starts, counted from the column's value on."""
    parts = rows.where(F.length(text) >= k).select(key, F.col(text).alias("_t"), F.col(at).alias("_at"), F.explode(F.sequence(F.lit(0), F.floor((F.length(text) - k) / size).cast("int"))).alias("_p"))
    return parts.select(key, F.substr("_t", F.col("_p") * size + 1, F.lit(size + k - 1)).alias(text), (F.col("_at") + F.col("_p") * size).alias(at))


def windows(rows: DataFrame, key: str, text: str, k: int, place: str, name: str) -> DataFrame:
    """key, place (from 0), name: every substring of k characters of each text, with repetition; none of null or of a shorter text."""
    whole = rows.select(key, F.col(text).alias("_text"), F.lit(0).alias("_from"))
    cut = _pieces(_pieces(whole, key, "_text", "_from", k, LONG_PIECE), key, "_text", "_from", k, SHORT_PIECE)
    each = F.transform(F.sequence(F.lit(1), F.length("_text") - k + 1), lambda i: F.substr(F.col("_text"), i, F.lit(k)))
    return cut.select(key, "_from", F.posexplode(each).alias("_i", name)).select(key, (F.col("_from") + F.col("_i")).alias(place), name)


def kmers(rows: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key and each substring of k characters with repetition."""
    return windows(rows, key, text, k, "_place", "kmer").drop("_place")


def match_probability(kmer_rows: DataFrame, by: str) -> DataFrame:
    """by, n_kmers, n_distinct, p_match: chance that two draws of the group's k-mers are equal."""
    counts = kmer_rows.groupBy(by, "kmer").agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.sum("n").alias("n_kmers"), F.count("*").alias("n_distinct"), (F.sum(F.col("n").cast("double") * F.col("n")) / F.pow(F.sum("n").cast("double"), F.lit(2.0))).alias("p_match"))


def chunks(rows: DataFrame, key: str, sequence: str, stops: str, size: int, overhang: int, least: int) -> DataFrame:
    """key, part, chunk_no, chunk: sequences split at the characters in stops, then cut to ``size`` with an overlap; short ones are dropped."""
    parts = rows.select(key, F.posexplode(F.split(sequence, f"[{stops}]")).alias("part", "s")).where(F.length("s") >= least)
    step = size - overhang
    last = F.greatest(F.ceil((F.length("s") - overhang) / step).cast("int") - 1, F.lit(0))
    cut = parts.select(key, "part", "s", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return cut.select(key, "part", "chunk_no", F.substring(F.col("s"), F.col("chunk_no") * step + 1, F.lit(size)).alias("chunk")).where(F.length("chunk") >= least)


def residue_strings(residues: DataFrame, most_mass: float, most_length: int | None = None) -> DataFrame:
    """seq, mass: all strings of residues (sym, mono) of less than most_mass, and of up to most_length letters if it is given."""
    least = residues.agg(F.min("mono")).first()[0]
    if least is not None and least <= 0:
        raise ValueError("masses must be positive")
    rounds = int(most_mass // least) if least is not None else 0  # no longer string is under the mass
    everyone = residues.agg(F.collect_list(F.struct("sym", "mono")).alias("_all"))  # one row
    rows = residues.where(F.col("mono") < most_mass).select(F.col("sym").alias("seq"), F.col("mono").alias("mass"), F.lit(True).alias("_new")).crossJoin(F.broadcast(everyone))
    for _ in range((rounds if most_length is None else min(rounds, most_length)) - 1):
        light = F.filter("_all", lambda x: F.col("_new") & (F.col("mass") + x["mono"] < most_mass))
        longer = F.transform(light, lambda x: F.struct(F.concat("seq", x["sym"]).alias("seq"), (F.col("mass") + x["mono"]).alias("mass"), F.lit(True).alias("_new")))
        rows = rows.select("_all", F.inline(F.concat(F.array(F.struct("seq", "mass", F.lit(False).alias("_new"))), longer)))
    return rows.select("seq", "mass")


def mass_lookup(rows: DataFrame, mass: str, strings: DataFrame, tolerance: float) -> DataFrame:
    """rows with each residue string (seq, seq_mass) whose mass is within the tolerance."""
    named = strings.select("seq", F.col("mass").alias("seq_mass"))
    return range_join(rows, named, mass, "seq_mass", tolerance, F.abs(F.col(mass) - F.col("seq_mass")) < tolerance)


def tag_runs(matches: DataFrame, key: str) -> DataFrame:
    """key, diagonal, start, length: runs of matches (i, j) with equal i - j and consecutive i."""
    rows = matches.select(key, "i", (F.col("i") - F.col("j")).alias("diagonal")).distinct()
    run = F.col("i") - F.row_number().over(Window.partitionBy(key, "diagonal").orderBy("i"))
    return rows.withColumn("run", run).groupBy(key, "diagonal", "run").agg(F.min("i").alias("start"), F.count("*").alias("length")).drop("run")


def flag_runs(rows: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """key, run_start, run_end (places from 0, end not included): runs of rows whose flag holds, in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    placed = rows.withColumn("_i", F.row_number().over(w) - 1).where(F.col(flag))
    run = F.col("_i") - F.row_number().over(Window.partitionBy(key).orderBy("_i"))
    return placed.withColumn("_run", run).groupBy(key, "_run").agg(F.min("_i").alias("run_start"), (F.max("_i") + 1).alias("run_end")).drop("_run")


def consecutive_pairs(rows: DataFrame, group: str, number: str, value: str, ppm: float) -> DataFrame:
    """group, first, second: rows whose number follows another's in the group at once and whose values are within 10 * ppm of the second's; each row is in one pair at most, so of a run of close rows the 1st and 2nd, the 3rd and 4th and so on are paired."""
    w = Window.partitionBy(group).orderBy(number)
    follows = (F.col(number) - F.lag(number).over(w) == 1) & (F.abs(F.col(value) - F.lag(value).over(w)) < 1e-5 * ppm * F.col(value))
    placed = rows.withColumns({"_close": F.coalesce(follows, F.lit(False)), "_i": F.row_number().over(w)})
    start = F.max(F.when(~F.col("_close"), F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_start", start).where(F.col("_close") & ((F.col("_i") - F.col("_start")) % 2 == 1)).select(group, (F.col(number) - 1).alias("first"), F.col(number).alias("second"))
