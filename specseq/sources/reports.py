"""Files of results: tables that programs write and read, histograms, classifier models, isotope ratios, logs, symbol maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Columns of a table of alignments, by the names of blast_table()'s (fixed values).
ALIGNMENT = {
    "qid": "QID", "peptide": "Peptide", "plain": "Unmod Peptide", "ambiguous": "Ambig Edges", "references": "References", "score": "Alignment Score", "e_value": "Min E-Value", "q_start": "Query Start", "q_end": "Query End",
    "identical": "Num Identical", "positive": "Num Positive", "q_gaps": "Query Gap Length", "s_gaps": "Subject Gap Length", "length": "Alignment Length",
}


def as_text(column: str, kind: str) -> Column:
    """A value as a cell: lists in brackets, null as None."""
    c = F.col(f"`{column}`")
    cell = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", ", "None"), F.lit("]")) if kind.startswith("array") else c.cast("string")
    return F.coalesce(cell, F.lit("None"))


def write_table(rows: DataFrame, path: str, names: dict[str, str] | None = None) -> None:
    """rows as tab-separated files with a header each, the columns in the order of names, and named so, if that is given. Every task writes its own file."""
    names = names or {c: c for c in rows.columns}
    kinds = dict(rows.dtypes)
    rows.select(*[as_text(c, kinds[c]).alias(n) for c, n in names.items()]).write.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """write_table()'s files: text, None for a null."""
    return spark.read.option("sep", "\t").option("header", True).option("nullValue", "None").option("quote", "").csv(path)


def blast_table(hits: DataFrame, peptides: DataFrame) -> DataFrame:
    """The columns of ALIGNMENT: hits (qid, references and the rest) with their peptides (qid, peptide, plain, ambiguous)."""
    return hits.join(peptides, "qid").select(*ALIGNMENT)


def fasta_lines(rows: DataFrame, key: str, sequence: str, ambiguous: str | None = None, most: int = 1) -> DataFrame:
    """value: a FASTA record for each row whose sequence is known and has at most ``most`` ambiguous edges."""
    kept = rows.where(F.col(sequence).isNotNull() & (F.col(sequence) != "None"))
    if ambiguous:
        kept = kept.where(F.col(ambiguous) <= most)
    return kept.select(F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"), F.col(sequence)).alias("value"))


def sweep_counts(sweep: DataFrame, cutoff: str, scores: DataFrame, everything: DataFrame | None = None) -> DataFrame:
    """sweep with results, how many scores (score) reach its cut-off, and all_results, how many of everything's do (null without).

    Cut-offs are few; each score is counted once, at the highest cut-off that it reaches, and counts add up from the top.
    """
    cuts = sweep.select(F.col(cutoff).cast("double").alias("_c")).distinct()
    everyone = cuts.agg(F.array_sort(F.collect_set("_c")).alias("_all"))  # a sweep's cut-offs

    def reached(rows: DataFrame, name: str) -> DataFrame:
        top = rows.crossJoin(F.broadcast(everyone)).select(F.array_max(F.filter("_all", lambda c: c <= F.col("score"))).alias("_c"))
        counts = cuts.join(top.where("_c is not null").groupBy("_c").agg(F.count("*").alias("n")), "_c", "left")
        return counts.select("_c", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy(F.desc("_c"))).alias(name))  # a row a cut-off

    out = sweep.withColumn("_c", F.col(cutoff).cast("double")).join(reached(scores.select("score"), "results"), "_c")
    if everything is not None:
        out = out.join(reached(everything.select("score"), "all_results"), "_c")
    else:
        out = out.withColumn("all_results", F.lit(None).cast("long"))
    return out.drop("_c")


def histogram(rows: DataFrame, column: str, group: list[str], bins: int = 10, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """group, bin (its lower edge), count of ``bins`` even bins from low to high, the last with its upper edge too; values beyond are left out, and a group's empty bins are there."""
    width = (high - low) / bins
    number = F.least(F.floor(F.round((F.col(column) - low) / width, 9)), F.lit(bins - 1)).cast("int")
    counts = rows.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(*group, number.alias("_b")).agg(F.count("*").alias("count"))
    full = rows.select(*group).distinct().withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return full.join(counts, [*group, "_b"], "left").select(*group, F.round(low + F.col("_b") * width, 9).alias("bin"), F.coalesce("count", F.lit(0)).alias("count"))


def category_table(stats: DataFrame) -> DataFrame:
    """program, scans, accuracy, precision: means of stats (program, accuracy, precision, a row a scan); null where none is known."""
    return stats.groupBy("program").agg(F.count("*").alias("scans"), F.avg("accuracy").alias("accuracy"), F.avg("precision").alias("precision"))


def pair_distribution(true: DataFrame, tested: DataFrame, bins: int = 20) -> DataFrame:
    """bin, low, n_tested, n_true: pairs by the difference of their scans (light, heavy), in even bins over the differences of those that were tested; true ones beyond are in the first or the last."""
    gap = F.col("light") - F.col("heavy")
    ends = tested.agg(F.min(gap).alias("lo"), F.max(gap).alias("hi"))

    def counted(rows: DataFrame, name: str) -> DataFrame:
        place = F.coalesce(F.floor(F.try_divide((gap - F.col("lo")).cast("double") * bins, F.col("hi") - F.col("lo"))), F.lit(0))
        return rows.crossJoin(F.broadcast(ends)).groupBy(F.greatest(F.lit(0), F.least(place, F.lit(bins - 1))).cast("int").alias("bin")).agg(F.count("*").alias(name))

    every = ends.where("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    rows = every.join(counted(tested, "n_tested"), "bin", "left").join(counted(true, "n_true"), "bin", "left")
    return rows.select("bin", F.floor(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("low"), F.coalesce("n_tested", F.lit(0)).alias("n_tested"), F.coalesce("n_true", F.lit(0)).alias("n_true"))


def svm_model_lines(model: DataFrame) -> DataFrame:
    """line (from 0) and value: LibSVM's text of one model (gamma, bias, support with coef and sv), first its head, then a line a support vector, positive ones first."""
    spark = model.sparkSession
    row = model.first()  # one model, as small as its sample
    order = sorted(row.support, key=lambda s: -s.coef)
    positive = sum(s.coef > 0 for s in order)
    head = ["svm_type c_svc", "kernel_type rbf", f"gamma {row.gamma!r}", "nr_class 2", f"total_sv {len(order)}", f"rho {-row.bias!r}", "label 1 -1", f"nr_sv {positive} {len(order) - positive}", "SV"]
    lines = head + [" ".join([repr(s.coef), *(f"{i}:{v!r}" for i, v in enumerate(s.sv, 1) if v)]) for s in order]
    return spark.createDataFrame(list(enumerate(lines)), "line int, value string")


def read_svm_model(spark: SparkSession, path: str, size: int) -> DataFrame:
    """gamma, bias and support (coef, sv with ``size`` places) of a LibSVM model file; what isn't written is 0."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("l"))  # a model is one file
    at = F.array_position("l", "SV")
    word = lambda name: F.split(F.filter(F.slice("l", 1, at.cast("int")), lambda x: F.startswith(x, F.lit(name + " ")))[0], " ")[1].cast("double")
    body = F.filter(F.slice("l", at.cast("int") + 1, F.size("l")), lambda x: F.trim(x) != "")

    def vector(cells: Column) -> Column:
        known = F.map_from_entries(F.transform(F.slice(cells, 2, F.size(cells)), lambda c: F.struct(F.split(c, ":")[0].cast("int").alias("k"), F.split(c, ":")[1].cast("double").alias("v"))))
        return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.coalesce(F.try_element_at(known, i), F.lit(0.0)))

    support = F.transform(F.transform(body, lambda x: F.split(F.trim(x), " ")), lambda cells: F.struct(cells[0].cast("double").alias("coef"), vector(cells).alias("sv")))
    return lines.select(word("gamma").alias("gamma"), (-word("rho")).alias("bias"), support.alias("support"))


def read_ratios(spark: SparkSession, path: str) -> DataFrame:
    """carbons and ratios of a file of isotope ratios: lines of comma-separated fields, the first the number of carbons, the sixth the ratios with blanks between."""
    cells = F.split("value", ",")
    return spark.read.text(path).where(F.size(cells) > 5).select(cells[0].cast("int").alias("carbons"), F.transform(F.split(F.trim(cells[5]), " +"), lambda x: x.cast("double")).alias("ratios"))


def read_sequencing_log(spark: SparkSession, path: str) -> DataFrame:
    """file, entry, scans, place, peptide, score: what a log says of each group of scans; an entry begins with a line that names its scans in brackets and their shared peaks ratio, and its lines of scores follow."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("l"))  # a log is one file
    rows = lines.select("file", F.posexplode("l").alias("at", "value"))
    starts = F.col("value").contains("shared peaks ratio")
    entry = rows.withColumn("entry", F.sum(starts.cast("int")).over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    scans = entry.where(starts).select("file", "entry", F.regexp_extract_all("value", F.lit(r"\[[^\]]*\]"), F.lit(0)).alias("scans"))
    found = entry.where(F.col("value").contains("Score") & ~starts & (F.col("entry") > 0))
    parts = found.select("file", "entry", "at", F.regexp_extract("value", r"Score:?\s*(-?[0-9.]+)", 1).try_cast("double").alias("score"), F.regexp_extract("value", r"Seq:?\s*(\S+)", 1).alias("peptide"))
    place = F.row_number().over(Window.partitionBy("file", "entry").orderBy("at")) - 1
    return parts.withColumn("place", place).join(scans, ["file", "entry"]).select("file", "entry", "scans", "place", "peptide", "score")


def sequence_map(program: str, residues: list[str], aliases: dict[str, str], modifications: dict[str, str], symbols: dict[str, str], native: bool = False) -> dict[str, dict[str, str]]:
    """How a program's letters and signs are read: residues by themselves, L as I (of the engine's own results - as X instead), the program's aliases, and for each kind of modification that it knows the sign used here.

    modifications has the kind of each sign used here, symbols the program's sign of each kind, static for one that isn't written: such a sign is put after its residue.
    """
    letters = {"-": "X"} if native else {"L": "I"}
    letters |= {a: a for a in residues} | aliases
    signs, static = {}, {}
    for sign, kind in modifications.items():
        own = symbols.get(kind)
        if own == "static":
            static[kind] = sign
        elif own is not None:
            signs[own] = sign
    return {"letters": letters, "signs": signs, "static": static}
