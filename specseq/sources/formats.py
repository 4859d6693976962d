"""Files of the domain: .dta spectra, mzXML, FASTA, BLAST tables, LibSVM rows, INI parameters."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.residues import PROTON

PEAKS = T.ArrayType(T.StructType([T.StructField("mz", T.DoubleType()), T.StructField("intensity", T.DoubleType())]))
#: The columns of a BLAST table.
BLAST = (
    "qid string, sid string, E double, N int, Sprime double, S double, alignlen int, nident int, npos int, nmism int, pcident double, pcpos double, "
    "qgaps int, qgaplen int, sgaps int, sgaplen int, qframe int, qstart int, qend int, sframe int, sstart int, send int"
)


def scan_number(path: Column) -> Column:
    """The scan of a .dta path: the fourth part of the name from its end."""
    return F.try_element_at(F.split(F.element_at(F.split(path, "/"), -1), "\\."), F.lit(-4)).try_cast("int")


def read_dta(spark: SparkSession, path: str) -> DataFrame:
    """scan, file, prec_mh, charge, peaks from .dta files; lines that aren't two numbers are left out."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.dta").withColumn("file", F.col("_metadata.file_path"))
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    numbers = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.split(F.trim(x), "[ \t]+"))
    peaks = F.filter(F.transform(numbers, lambda n: F.struct(F.try_element_at(n, F.lit(1)).try_cast("double").alias("mz"), F.try_element_at(n, F.lit(2)).try_cast("double").alias("intensity"))), lambda p: p["mz"].isNotNull() & p["intensity"].isNotNull())
    head = F.split(F.trim(F.try_element_at(lines, F.lit(1))), "[ \t]+")
    return whole.select(scan_number(F.col("file")).alias("scan"), "file", F.try_element_at(head, F.lit(1)).try_cast("double").alias("prec_mh"), F.try_element_at(head, F.lit(2)).try_cast("int").alias("charge"), peaks.alias("peaks"))


def dta_text(least_peaks: int = 10) -> Column:
    """The text of a .dta file from prec_mh and peaks, charge 1, peaks by mz; null under so many peaks."""
    lines = F.transform(F.array_sort("peaks"), lambda p: F.concat_ws("\t", p["mz"].cast("string"), p["intensity"].cast("string")))
    return F.when(F.size("peaks") >= least_peaks, F.concat_ws("\n", F.concat_ws("\t", F.col("prec_mh").cast("string"), F.lit("1")), F.array_join(lines, "\n")))


@F.pandas_udf(PEAKS)
def decoded_peaks(data: pd.Series) -> pd.Series:
    """mz and intensity pairs of big-endian 32-bit floats; an odd rest is left out."""

    def one(b):
        x = np.frombuffer(b or b"", ">f4", count=len(b or b"") // 8 * 2).astype(float).reshape(-1, 2)
        return [{"mz": float(m), "intensity": float(i)} for m, i in x]

    return data.map(one)


def read_mzxml(spark: SparkSession, path: str, level: int = 2) -> DataFrame:
    """scan, prec_mh, charge, peaks of the scans of one msLevel. prec_mh is precursorMz * z less z - 1 protons; mz is rounded to 5 places, intensity to 2."""
    schema = "_num int, _msLevel int, precursorMz struct<_VALUE double, _precursorCharge int>, peaks struct<_VALUE string>"
    rows = spark.read.format("xml").option("rowTag", "scan").schema(schema).load(path).where(F.col("_msLevel") == level)
    z = F.coalesce(F.col("precursorMz._precursorCharge"), F.lit(1))
    refined = F.transform(decoded_peaks(F.unbase64("peaks._VALUE")), lambda p: F.struct(F.round(p["mz"], 5).alias("mz"), F.round(p["intensity"], 2).alias("intensity")))
    return rows.select(F.col("_num").alias("scan"), (F.col("precursorMz._VALUE") * z - (z - 1) * PROTON).alias("prec_mh"), z.alias("charge"), refined.alias("peaks"))


def read_fasta(spark: SparkSession, path: str, longest_name: int = 63) -> DataFrame:
    """name, sequence of the records of FASTA files; longer names are cut as BLAST does. A record is one row, so lines may be many."""
    parts = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    lines = F.split("value", "\r?\n")
    name = F.trim(lines[0])
    return parts.select(F.when(F.length(name) >= longest_name, F.concat(F.substring(name, 1, longest_name), F.lit("..."))).otherwise(name).alias("name"), F.regexp_replace(F.array_join(F.slice(lines, 2, F.size(lines)), ""), "\\s", "").alias("sequence"))


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLAST).option("sep", "\t").option("comment", "#").csv(path)


def best_hits(hits: DataFrame) -> DataFrame:
    """qid, S, references (sorted) and least E of the hits that tie for a query's best alignment score."""
    top = hits.groupBy("qid").agg(F.max("S").alias("S"))
    return hits.join(top, ["qid", "S"]).groupBy("qid", "S").agg(F.array_sort(F.collect_set("sid")).alias("references"), F.min("E").alias("E"))


def libsvm_line(label: Column, features: list[Column], comment: Column | None = None) -> Column:
    """label 1:x 2:y ... and a comment; null features are left out."""
    cells = [F.concat(F.lit(f"{i}:"), f.cast("string")) for i, f in enumerate(features, 1)]
    line = F.concat_ws(" ", label.cast("string"), *cells)
    return line if comment is None else F.concat(line, F.lit(" # "), comment)


@dataclass(frozen=True)
class PairConfiguration:
    name: str
    n_static: float
    c_static: float
    n_mod: float
    c_mod: float
    n_symbol: str = ""
    c_symbol: str = ""
    model: str = ""


@dataclass(frozen=True)
class Parameters:
    """Settings with the defaults of the domain; an INI file overrides them."""

    paircutoff: float = 0.05
    ppmstd: float = 5.0
    ppmsyserror: float = 0.0
    ambigpenalty: float = 20.0
    ppmpenalty: float = 20.0
    minedge: float = 300.0
    maxedge: float = 500.0
    alpha: float = 0.90
    subgraphcut: float = 300.0
    pairs: tuple[PairConfiguration, ...] = ()
    enzyme: tuple[tuple[str, str], ...] = field(default=())
    #: Columns by the role that they play, models as (configuration, model), and settings of the clusters, by name.
    columns: dict[str, str] = field(default_factory=dict)
    models: dict[str, tuple[str, str]] = field(default_factory=dict)
    clusters: dict[str, str] = field(default_factory=dict)
    #: Of each other section (amino acids, static and diff mods) the words of each entry.
    others: dict[str, dict[str, tuple[str, ...]]] = field(default_factory=dict)


def read_parameters(text: str) -> Parameters:
    """Parameters from INI text.

    The section whose name is or ends with Parameters has numbers by name; [Pair Configurations] name = four numbers, two symbols (None, 0 or False for
    none) and a model; [Enzyme] specificity = before;after (| for alternatives, .* for any); [Columns] role = column, [Models] name = configuration model and
    [Cluster Configuration] name = value take the first words. Entries of other sections are split to words.
    """
    ini = configparser.ConfigParser(interpolation=None)
    ini.read_string(text)
    known, pairs, sides, others, columns, models, clusters = {}, [], [], {}, {}, {}, {}
    for name in ini.sections():
        entries = dict(ini[name])
        if name.split()[-1:] == ["Parameters"]:
            known |= {k: float(v.split()[0]) for k, v in entries.items() if k in Parameters.__dataclass_fields__ and k not in ("pairs", "enzyme", "others", "columns", "models", "clusters")}
        elif name == "Pair Configurations":
            for pair, value in entries.items():
                n = value.split()
                symbols = ["" if x in ("None", "0", "False") else x for x in n[4:6]]
                pairs.append(PairConfiguration(pair, *map(float, n[:4]), *symbols, *n[6:7]))
        elif name == "Enzyme" and "specificity" in entries:
            for motif in entries["specificity"].split():
                before, after = motif.split(";")
                sides += [(b, a) for b in before.split("|") for a in after.split("|")]
        elif name == "Columns":
            columns |= {k: v.split()[0] for k, v in entries.items()}
        elif name == "Models":
            models |= {k: (v.split()[0], v.split()[1]) for k, v in entries.items()}
        elif name == "Cluster Configuration":
            clusters |= {k: v.split()[0] for k, v in entries.items()}
        else:
            others[name] = {k: tuple(v.split()) for k, v in entries.items()}
    return Parameters(**known, pairs=tuple(pairs), enzyme=tuple(sides), columns=columns, models=models, clusters=clusters, others=others)


def read_scans(spark: SparkSession, path: str, fields: list[str] | None = None, sep: str = ",", skip: int = 0) -> DataFrame:
    """The columns (or the named ones) of tables of results, as text; the header comes after ``skip`` lines of a file."""
    if not skip:
        rows = spark.read.option("header", True).option("sep", sep).csv(path)
        return rows.select(*[F.col(f"`{c}`") for c in fields]) if fields else rows
    lines = spark.read.text(path, wholetext=True).select(F.slice(F.split("value", "\r?\n"), skip + 1, F.lit(1 << 30)).alias("l"))  # such files are a program's reports, one row each
    header = [c.strip() for c in lines.first().l[0].split(sep)]
    body = lines.select(F.explode(F.slice("l", 2, F.size("l"))).alias("value")).where("value <> ''")
    parsed = body.select(F.from_csv("value", ", ".join(f"`{c}` string" for c in header), {"sep": sep}).alias("r")).select("r.*")
    return parsed.select(*[F.col(f"`{c}`") for c in fields]) if fields else parsed


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """file, lines of text files."""
    return spark.read.text(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("lines"))


def read_scoring_matrix(spark: SparkSession, path: str) -> DataFrame:
    """a, b, score of a substitution matrix: comment lines start with #, the first other line names the columns, the others start with their letter."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", "\r?\n"), lambda l: (F.trim(l) != "") & ~F.startswith(l, F.lit("#"))).alias("l"))  # a matrix is one row
    words = lambda x: F.split(F.trim(x), "\\s+")
    cells = lines.select(words(F.col("l")[0]).alias("names"), F.explode(F.slice("l", 2, F.size("l"))).alias("line")).select("names", words(F.col("line")).alias("w"))
    return cells.select(F.col("w")[0].alias("a"), F.posexplode("names").alias("i", "b"), "w").select("a", "b", F.get("w", F.col("i") + 1).cast("int").alias("score"))


def read_libsvm(spark: SparkSession, path: str) -> DataFrame:
    """label, features (map of number to value) of LibSVM lines; what follows # is left out."""
    words = F.split(F.trim(F.regexp_replace("value", "#.*", "")), "\\s+")
    cells = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda c: F.struct(F.split(c, ":")[0].cast("int").alias("k"), F.split(c, ":")[1].cast("double").alias("v")))
    return spark.read.text(path).where("trim(regexp_replace(value, '#.*', '')) <> ''").select(words[0].cast("double").alias("label"), F.map_from_entries(cells).alias("features"))


def feature_ranges(rows: DataFrame) -> DataFrame:
    """feature, lowest, highest of the features of read_libsvm(): what min-max scaling needs."""
    return rows.select(F.explode("features").alias("feature", "value")).groupBy("feature").agg(F.min("value").alias("lowest"), F.max("value").alias("highest"))


def range_lines(ranges: DataFrame) -> DataFrame:
    """value: ``feature lowest highest`` for each row, to be written as text; read_ranges() reads it back."""
    return ranges.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("feature", "lowest", "highest")]).alias("value"))


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature int, lowest double, highest double").option("sep", " ").csv(path)
