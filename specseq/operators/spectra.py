"""Peaks of spectra: merging, sharing, binning, ranking, noise.

peaks has scan, mz and intensity, and whatever else a function names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import range_join


def merge_spectra(peaks: DataFrame, group: str, width: float) -> DataFrame:
    """group, bucket, mz, intensity, n_spec: peaks of all spectra of a group in buckets of rounded mz / width.

    mz is the mean; intensity the mean times the number of spectra that have the bucket.
    """
    merged = peaks.groupBy(group, F.bround(F.col("mz") / width).cast("long").alias("bucket")).agg(F.avg("mz").alias("mz"), F.avg("intensity").alias("mean"), F.countDistinct("scan").alias("n_spec"))
    return merged.select(group, "bucket", "mz", (F.col("mean") * F.col("n_spec")).alias("intensity"), "n_spec")


def shared_peaks(pairs: DataFrame, peaks: DataFrame, width: float) -> DataFrame:
    """pairs (light, heavy) with n_light, n_heavy, the number of light buckets that heavy has too, and the intensity in them."""
    spots = peaks.groupBy("scan", F.bround(F.col("mz") / width).cast("long").alias("bucket")).agg(F.sum("intensity").alias("intensity"))
    sizes = spots.groupBy("scan").agg(F.count("*").alias("n"), F.sum("intensity").alias("tic"))
    light = spots.select(F.col("scan").alias("light"), "bucket", F.col("intensity").alias("i_light"))
    heavy = spots.select(F.col("scan").alias("heavy"), "bucket", F.col("intensity").alias("i_heavy"))
    both = pairs.join(light, "light").join(heavy, ["heavy", "bucket"]).groupBy("light", "heavy").agg(F.count("*").alias("n_shared"), F.sum("i_light").alias("i_light"), F.sum("i_heavy").alias("i_heavy"))
    l, h = (sizes.select(F.col("scan").alias(x), F.col("n").alias(f"n_{x}"), F.col("tic").alias(f"tic_{x}")) for x in ("light", "heavy"))  # noqa: E741
    out = pairs.select("light", "heavy").join(l, "light").join(h, "heavy").join(both, ["light", "heavy"], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_shared", "i_light", "i_heavy")}
    return out.select("light", "heavy", "n_light", "n_heavy", "tic_light", "tic_heavy", zero["n_shared"].alias("n_shared"), zero["i_light"].alias("i_light"), zero["i_heavy"].alias("i_heavy"))


def pair_features(shared: DataFrame) -> DataFrame:
    """Ratios of shared peaks and of intensity in them, for the rows of shared_peaks()."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    c = F.col
    return shared.select(
        "light", "heavy", ratio(2 * c("n_shared"), c("n_light") + c("n_heavy")).alias("shared_ratio"), ratio(c("n_shared"), c("n_light")).alias("light_ratio"), ratio(c("n_shared"), c("n_heavy")).alias("heavy_ratio"),
        ratio(c("i_light") + c("i_heavy"), c("tic_light") + c("tic_heavy")).alias("tic_ratio"), ratio(c("i_light"), c("tic_light")).alias("light_tic_ratio"), ratio(c("i_heavy"), c("tic_heavy")).alias("heavy_tic_ratio"),
    )


def symmetric(peaks: DataFrame, totals: DataFrame, tolerance: float) -> DataFrame:
    """Peaks (scan, peak, mz) whose complement total - mz is another row of the same scan within the tolerance."""
    wanted = peaks.join(totals, "scan").select("scan", "peak", "mz", (F.col("total") - F.col("mz")).alias("mirror"))
    others = peaks.select("scan", F.col("peak").alias("o_peak"), F.col("mz").alias("o_mz"))
    return range_join(wanted, others, "mirror", "o_mz", tolerance, (F.abs(F.col("mirror") - F.col("o_mz")) < tolerance) & (F.col("peak") != F.col("o_peak")), ("scan",), "left_semi").select("scan", "peak", "mz")


def cross_paired(pairs: DataFrame, peaks: DataFrame, totals: DataFrame, delta: float, tolerance: float) -> DataFrame:
    """light, heavy, light_peak, heavy_peak: light peaks that meet the heavy spectrum mirrored at its total and shifted by delta."""
    light = pairs.join(peaks.select(F.col("scan").alias("light"), F.col("peak").alias("light_peak"), F.col("mz").alias("l_mz")), "light")
    heavy = peaks.join(totals, "scan").select(F.col("scan").alias("heavy"), F.col("peak").alias("heavy_peak"), (F.col("total") - F.col("mz") + delta).alias("h_mz"))
    return range_join(light, heavy, "l_mz", "h_mz", tolerance, F.abs(F.col("l_mz") - F.col("h_mz")) < tolerance, ("heavy",)).select("light", "heavy", "light_peak", "heavy_peak")


def log_tic_bin(peaks: DataFrame, bins: int) -> DataFrame:
    """bin = max(1, bins - 1 + ceil(log10(intensity / sum of the scan))), 0 for no intensity."""
    share = F.col("intensity") / F.sum("intensity").over(Window.partitionBy("scan"))
    return peaks.withColumn("bin", F.when(F.col("intensity") > 0, F.greatest(F.lit(1), bins - 1 + F.ceil(F.round(F.log10(share), 9)))).otherwise(0).cast("long"))


def linear_tic_bin(peaks: DataFrame, bins: int) -> DataFrame:
    """bin = ceil(share of the scan's sum * (bins - 1)). Values are rounded to 9 places before they are cut, here and below."""
    share = F.col("intensity") / F.sum("intensity").over(Window.partitionBy("scan"))
    return peaks.withColumn("bin", F.ceil(F.round(share * (bins - 1), 9)).cast("long"))


def _place() -> tuple[Column, Column]:
    """Rank of the intensity from 0 at the least, peak as tie-break, and the number of peaks."""
    w = Window.partitionBy("scan")
    return F.row_number().over(w.orderBy("intensity", "peak")) - 1, F.count("*").over(w)


def rank_percent_bin(peaks: DataFrame, bins: int) -> DataFrame:
    """Bins of equal numbers of peaks: ceil((1 - place / n) * (bins - 1)), place 0 at the most intense."""
    rank, n = _place()
    return peaks.withColumn("bin", F.ceil(F.round((rank + 1) / n * (bins - 1), 9)).cast("long"))


def log_percent_bin(peaks: DataFrame, bins: int) -> DataFrame:
    """Bins by the logarithm of the place from the top, so that a twentieth of the peaks is in the highest."""
    rank, n = _place()
    base = 0.05 ** (-1 / (bins - 2))
    return peaks.withColumn("bin", F.least(-F.floor(F.round(F.log((n - rank) / (n + 1)) / F.log(F.lit(base)), 9)), F.lit(bins - 1)).cast("long"))


def baseline_bin(peaks: DataFrame, bins: int) -> DataFrame:
    """Bins by the fold over the mean of the least intense third: 1 + ceil(log10(fold)), from 1 to bins - 1; 0 for no intensity."""
    rank, n = _place()
    placed = peaks.withColumns({"_rank": rank, "_n": n})
    baseline = F.avg(F.when(F.col("_rank") < F.ceil(F.col("_n") / 3), F.col("intensity"))).over(Window.partitionBy("scan"))
    fold = F.when((F.col("intensity") > 0) & (F.col("_base") > 0), F.ceil(F.round(F.log10(F.col("intensity") / F.col("_base")), 9)) + 1)
    return placed.withColumn("_base", baseline).withColumn("bin", F.coalesce(F.least(F.greatest(F.lit(1), fold), F.lit(bins - 1)), F.lit(0)).cast("long")).drop("_rank", "_n", "_base")


def noise_model(binned: DataFrame, bins: int, window: float, width: float) -> DataFrame:
    """scan, region, bin, p: chance that a random place of a region (of ``window`` mz) has a peak of the bin and none of a higher one.

    c is the number of peaks of a bin in the region, each covering ``width``;
    p(k) = (1 if k = 0 else c_k * width / window) * product over j > k of (1 - c_j * width / window).
    A chance of 0 is given as width / window.
    """
    region = F.floor(F.col("mz") / window).cast("long").alias("region")
    counts = binned.groupBy("scan", region).pivot("bin", list(range(1, bins + 1))).count()
    unit = width / window
    hit = {k: F.least(F.coalesce(F.col(str(k)), F.lit(0)) * unit, F.lit(1.0)) for k in range(1, bins + 1)}
    rows = []
    for k in range(bins + 1):
        p: Column = F.lit(1.0) if k == 0 else hit[k]
        for j in range(k + 1, bins + 1):
            p = p * (1 - hit[j])
        rows.append(F.struct(F.lit(k).alias("bin"), F.when(p == 0, F.lit(unit)).otherwise(p).alias("p")))
    return counts.select("scan", "region", F.inline(F.array(*rows)))


def top_peaks(peaks: DataFrame, k: int) -> DataFrame:
    """The k most intense peaks of each scan, ties by peak."""
    place = F.row_number().over(Window.partitionBy("scan").orderBy(F.desc("intensity"), "peak"))
    return peaks.withColumn("rank", place).where(F.col("rank") <= k)


def explained(peaks: DataFrame, masses: DataFrame, tolerance: float, k: int) -> DataFrame:
    """scan, explained: share of the intensity of each scan's top k peaks that some theoretical mass (scan, theory) explains."""
    top = top_peaks(peaks, k)
    hit = range_join(top, masses, "mz", "theory", tolerance, F.abs(F.col("mz") - F.col("theory")) < tolerance, ("scan",), "left_semi")
    total, got = top.groupBy("scan").agg(F.sum("intensity").alias("total")), hit.groupBy("scan").agg(F.sum("intensity").alias("hit"))
    return total.join(got, "scan", "left").select("scan", (F.coalesce("hit", F.lit(0.0)) / F.col("total")).alias("explained"))


def evidence_rank(peaks: DataFrame, tier: Column) -> DataFrame:
    """Peaks with tier and evidence_rank: by tier from the lowest, then intensity from the highest, then peak."""
    rows = peaks.withColumn("tier", tier)
    return rows.withColumn("evidence_rank", F.row_number().over(Window.partitionBy("scan").orderBy("tier", F.desc("intensity"), "peak")))
