"""Results of several programs: combination, agreement, sweeps of cut-offs, cluster measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_best(rows: DataFrame, key: str, override: list[Column]) -> DataFrame:
    """One row a key: the first by the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*override))).where("_n = 1").drop("_n")


def full_outer(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All keys of both sides with the columns of each, null where a side lacks the key."""
    return left.join(right, key, "full_outer")


def program_pairs(results: DataFrame, scan: str, program: str) -> DataFrame:
    """scan, prog_a, prog_b and both programs' other columns with _a and _b, for programs a < b that have the scan."""
    a = results.select(scan, *[F.col(c).alias("prog_a" if c == program else f"{c}_a") for c in results.columns if c != scan])
    b = results.select(scan, *[F.col(c).alias("prog_b" if c == program else f"{c}_b") for c in results.columns if c != scan])
    return a.join(b, scan).where("prog_a < prog_b")


def agreement(items_a: Column, items_b: Column) -> tuple[Column, Column]:
    """Precision (shared / items of a) and accuracy (shared / items of b)."""
    shared = F.size(F.array_intersect(items_a, items_b))
    share = lambda n: F.coalesce(F.try_divide(shared.cast("double"), n.cast("double")), F.lit(0.0))
    return share(F.size(items_a)), share(F.size(items_b))


def consensus(results: DataFrame, scan: str, program: str, answer: str, score: str) -> DataFrame:
    """scan, answer, score, n_programs: the answer that most programs give, of equal ones that of the highest score, then the least answer."""
    votes = results.groupBy(scan, answer).agg(F.countDistinct(program).alias("n_programs"), F.max(score).alias(score))
    return keep_best(votes, scan, [F.desc("n_programs"), F.desc(score), F.col(answer)])


def sweep(scores: DataFrame, score: str, truth: str, points: int) -> DataFrame:
    """cutoff_no, cutoff, tp, fp, n_true: counts at or above each of evenly spaced cut-offs from the least to the greatest score.

    Rows are put in the step between two cut-offs that they reach, counted there, and
    summed from the top, so no row meets every cut-off.
    """
    ends = scores.agg(F.min(score).cast("double").alias("lo"), F.max(score).cast("double").alias("hi"))
    at = F.col("lo") + F.col("i") * ((F.col("hi") - F.col("lo")) / (points - 1))
    cuts = ends.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "lo", "hi").select("i", at.alias("cutoff"))
    place = F.least(F.greatest(F.floor(F.coalesce(F.try_divide((F.col(score) - F.col("lo")) * (points - 1), F.col("hi") - F.col("lo")), F.lit(points - 1.0))), F.lit(0)), F.lit(points - 1)).cast("int")
    # The division may be off by one step at a cut-off itself: the neighbours are tried.
    counts = (
        scores.crossJoin(F.broadcast(ends)).withColumn("g", place)
        .withColumn("i", F.expr(f"case when g < {points - 1} and {score} >= lo + (g + 1) * ((hi - lo) / {points - 1}) then g + 1 when g > 0 and {score} < lo + g * ((hi - lo) / {points - 1}) then g - 1 else g end"))
        .groupBy("i").agg(F.count_if(F.col(truth)).alias("t"), F.count_if(~F.col(truth)).alias("f"))
    )
    down = Window.orderBy(F.desc("i"))  # as many rows as cut-offs
    everything = Window.partitionBy()
    filled = cuts.join(F.broadcast(counts), "i", "left").select("i", "cutoff", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("f", F.lit(0)).alias("f"))
    return filled.select(F.col("i").alias("cutoff_no"), "cutoff", F.sum("t").over(down).alias("tp"), F.sum("f").over(down).alias("fp"), F.sum("t").over(everything).alias("n_true"))


def roc(swept: DataFrame) -> DataFrame:
    """Sensitivity and precision (1 where nothing is left) at each cut-off."""
    return swept.select("cutoff_no", "cutoff", F.try_divide(F.col("tp").cast("double"), F.col("n_true").cast("double")).alias("sensitivity"), F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(1.0)).alias("precision"))


def fdr(swept: DataFrame) -> DataFrame:
    """Share of false results at each cut-off, 0 where nothing is left."""
    return swept.select("cutoff_no", "cutoff", F.coalesce(F.try_divide(F.col("fp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0)).alias("fdr"))


def pairwise_confusion(rows: DataFrame, test: str, truth: str) -> DataFrame:
    """tp, fp, fn, tn over all pairs of rows, from the sizes of the clusters and of their meets; no pair is made."""
    pairs = lambda n: n * (n - 1) / 2
    meet = rows.groupBy(test, truth).agg(F.count("*").alias("n"))
    tp = meet.agg(F.sum(pairs(F.col("n"))).alias("tp"))
    same_test = meet.groupBy(test).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("test"), F.sum("n").alias("total"))
    same_truth = meet.groupBy(truth).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("truth"))
    one = tp.crossJoin(F.broadcast(same_test)).crossJoin(F.broadcast(same_truth))  # one row each
    whole = lambda c: c.cast("long")
    return one.select(whole(F.col("tp")).alias("tp"), whole(F.col("test") - F.col("tp")).alias("fp"), whole(F.col("truth") - F.col("tp")).alias("fn"), whole(pairs(F.col("total")) - F.col("test") - F.col("truth") + F.col("tp")).alias("tn"))


def best_overlap(rows: DataFrame, test: str, truth: str) -> DataFrame:
    """recall: mean over true clusters of the largest share in one test cluster; precision: the same with roles changed."""
    meet = rows.groupBy(test, truth).agg(F.count("*").alias("n"))

    def mean_share(by: str, name: str) -> DataFrame:
        return meet.groupBy(by).agg((F.max("n") / F.sum("n")).alias("s")).agg(F.avg("s").alias(name))

    return mean_share(truth, "recall").crossJoin(F.broadcast(mean_share(test, "precision")))
