"""Spectra that arrive as files: an extension without a counterpart in the batch operators' model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.formats import scan_number


def new_scans(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """scan, seen, value: the text of each .dta file that comes into the folder, once for each scan within the time for late ones."""
    files = spark.readStream.text(folder, wholetext=True, pathGlobFilter="*.dta")
    rows = files.select(scan_number(F.col("_metadata.file_path")).alias("scan"), F.col("_metadata.file_modification_time").alias("seen"), "value")
    return rows.withWatermark("seen", late).dropDuplicatesWithinWatermark(["scan"])
