"""Models as expressions: conditional tables, linear, boosting and kernel scores, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def conditional_table(rows: DataFrame, attribute: str, given: list[str], pseudo: float = 1.0) -> DataFrame:
    """given..., attribute, n, p: smoothed chance of each value of attribute under the given columns, over the values that occur at all."""
    counts = rows.groupBy(*given, attribute).agg(F.count("*").alias("n"))
    full = counts.select(*given).distinct().crossJoin(F.broadcast(counts.select(attribute).distinct()))  # an attribute has few values
    filled = full.join(counts, [*given, attribute], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(*given)
    return filled.withColumn("p", (F.col("n") + pseudo) / (F.sum("n").over(w) + pseudo * F.count("*").over(w)))


def node_score(likelihood: Column, prior: Column, noise: Column) -> Column:
    """ln(likelihood * prior / noise), three times as much where it is negative."""
    s = F.log(likelihood * prior / noise)
    return F.when(s > 0, s).otherwise(3 * s)


def ranks_and_deltas(rows: DataFrame, group: str, key: str, score: str) -> DataFrame:
    """rows with rank (from 0, best first, key as tie-break), delta (score less the group's best) and norm (score over the best)."""
    w = Window.partitionBy(group)
    best = F.max(score).over(w)
    return rows.withColumns({"rank": F.row_number().over(w.orderBy(F.desc(score), key)) - 1, "delta": F.col(score) - best, "norm": F.try_divide(F.col(score).cast("double"), best.cast("double"))})


def min_max(rows: DataFrame, column: str, low: float = -1.0, high: float = 1.0, group: str | None = None) -> DataFrame:
    """rows with ``scaled``: column brought to [low, high] by its least and greatest value, null where these are equal."""
    ranges = rows.groupBy(*[group] if group else []).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    met = rows.join(ranges, group) if group else rows.crossJoin(F.broadcast(ranges))  # one row
    return met.withColumn("scaled", low + F.try_divide((high - low) * (F.col(column) - F.col("_lo")), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)


def doubles(vector: str) -> Column:
    return F.transform(vector, lambda v: v.cast("double"))


def linear_score(vector: Column, weights: list[float], bias: float) -> Column:
    return dot(vector, F.array(*[F.lit(float(w)) for w in weights])) + bias


def boost_score(vector: Column, stumps: list[tuple[int, float, float]]) -> Column:
    """Sum of the weights of the stumps (feature from 0, cut, weight) whose feature is above the cut."""
    return sum((F.when(vector[i] > cut, F.lit(float(w))).otherwise(0.0) for i, cut, w in stumps), F.lit(0.0))


def rbf_decision(rows: DataFrame, key: str, vector: str, support: DataFrame, gamma: float, rho: float) -> DataFrame:
    """key, decision: sum of coef * exp(-gamma * |x - sv|^2) over the support vectors (coef, sv) less rho. A model's support vectors are few by its making."""
    gap = F.aggregate(F.zip_with(vector, "sv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
    return rows.crossJoin(F.broadcast(support)).groupBy(key).agg((F.sum(F.col("coef") * F.exp(-gamma * gap)) - rho).alias("decision"))


def best_per_group(rows: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """The row of the greatest score in each group, the smallest tie of equal ones."""
    others = [c for c in rows.columns if c not in (group, score, tie)]
    picked = rows.groupBy(group).agg(F.max_by(F.struct(score, tie, *others), F.struct(score, -F.col(tie))).alias("_row"))
    return picked.select(group, "_row.*").select(*rows.columns)
