"""Quality rules by robust multivariate outliers, in DataFrame and SQL functions only.

Each document has a vector of transformed statistics. A minimum-covariance-
determinant estimate is made for every (language, source), and documents whose
Mahalanobis distance from it is too large are rejected. The vectors are whole
numbers (STEP-ths), so all sums are exact and no result depends on the order in
which partitions are added up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANK, settled, sized, without_ids, written

#: Vectors count in 1024ths.
STEP = 1024
#: The statistics, with the least standard deviation that each is given.
FLOORS = {"x_len": 0.04, "x_sym": 0.5, "x_dup": 0.5, "x_rep": 0.7, "x_cap": 0.5}
X = list(FLOORS)
#: Words of prior weight with which a short text's mean word length is drawn to the corpus's.
PRIOR_WORDS = 50
#: Share of a group's rows that the determinant is minimised over.
SUBSET = 0.75
#: Distances beyond this quantile of chi-squared are outliers.
QUANTILE = 0.9999
#: C-steps; each lowers the determinant, and more than these change little.
C_STEPS = 6
#: Groups of fewer rows take the estimate of their language, and languages of fewer rows that of all rows.
MIN_ROWS = 100
#: Bins of ln(1 + squared distance) per unit, and their number.
BINS, MOST_BIN = 64, 4096


def chi2_cdf(x: float, d: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, y = d / 2, x / 2
    if y > 400:
        return 1.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= y / (a + n)
        total += term
    return total * math.exp(-y + a * math.log(y) - math.lgamma(a)) if y > 0 else 0.0


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 700.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return (low + high) / 2


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text; a null text has no words.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_capitals.
    Five-word windows are compared by 64-bit hashes within their own text.
    Repeated rows give a row each.
    """
    t = "coalesce(cast(text as string), '')"
    blank = BLANK.replace("\\", "\\\\")  # as SQL literals undo one escape
    rows = docs.selectExpr(
        "cast(doc_id as long) doc_id", "cast(lang as string) lang", "cast(source as string) source",
        # let: transform(array(x), name -> ...)[0] computes x once.
        f"""transform(array({t}), t -> transform(array(filter(split(t, '[{blank}]+'), w -> w != '')), words -> named_struct(
              'n_words', cast(size(words) as long),
              'word_chars', cast(length(array_join(words, '')) as long),
              'n_symbols', cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '')) as long),
              'n_capitals', cast(length(t) - length(regexp_replace(t, '\\\\p{{Lu}}+', '')) as long),
              'n_dup_lines', transform(array(filter(split(t, '\\n'), l -> l rlike '[^{blank}]')), lines -> cast(size(lines) - size(array_distinct(lines)) as long))[0],
              'n_repeat_words', case when size(words) < 6 then 0L else
                transform(array(transform(words, w -> xxhash64(w))), h ->
                  transform(array(transform(slice(h, 1, size(h) - 4), (x, i) -> xxhash64(x, h[i + 1], h[i + 2], h[i + 3], h[i + 4]))), g ->
                    case when size(array_distinct(g)) = size(g) then 0L else
                      transform(array(array_sort(transform(g, (x, i) -> named_struct('h', x, 'i', i)))), s ->
                        transform(array(array_sort(transform(filter(s, (x, j) -> (j > 0 and s[greatest(j - 1, 0)].h = x.h) or (j + 1 < size(s) and s[least(j + 1, size(s) - 1)].h = x.h)), x -> x.i))), p ->
                          aggregate(transform(p, (x, j) -> case when j + 1 < size(p) then least(5, p[least(j + 1, size(p) - 1)] - x) else 5 end), 0L, (a, x) -> a + x)
                        )[0]
                      )[0]
                    end
                  )[0]
                )[0]
              end))[0])[0] as s""",
    )
    return rows.select("doc_id", "lang", "source", "s.*")


def vectors(stats: DataFrame) -> DataFrame:
    """Add base_failed and the vector of whole numbers to base_statistics()."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    whole = lambda c: F.rint(c * STEP).cast("long")
    share = lambda name: whole(F.log1p(100 * F.col(name) / n))
    pooled = stats.agg(F.sum("word_chars").alias("all_chars"), F.sum("n_words").alias("all_words"))
    mean = F.coalesce(F.try_divide("all_chars", "all_words"), F.lit(1.0))
    return stats.crossJoin(F.broadcast(pooled)).select(  # pooled is one row
        *stats.columns, failed.alias("base_failed"),
        whole(F.log((F.col("word_chars") + PRIOR_WORDS * mean) / (n + PRIOR_WORDS))).alias("x_len"), share("n_symbols").alias("x_sym"),
        share("n_dup_lines").alias("x_dup"), share("n_repeat_words").alias("x_rep"), whole(F.log1p(100 * F.col("n_capitals") / F.greatest("word_chars", F.lit(1)))).alias("x_cap"),
    )


def _grouped(rows: DataFrame) -> DataFrame:
    """Add ``grp``: the language and source, or what stands in for them where they have too few rows."""
    of_rows = rows.where(~F.col("base_failed"))
    lang, source = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null")), F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    keyed = of_rows.groupBy(lang.alias("l"), source.alias("s")).agg(F.count("*").alias("n"))
    per_lang = Window.partitionBy("l")
    names = keyed.withColumn("n_lang", F.sum("n").over(per_lang)).select(
        "l", "s", F.when(F.col("n") >= MIN_ROWS, F.to_json(F.array("l", "s"))).when(F.col("n_lang") >= MIN_ROWS, F.to_json(F.array("l"))).otherwise("[]").alias("grp")
    )
    return rows.withColumns({"l": lang, "s": source}).join(names, ["l", "s"], "left").drop("l", "s")


def _members(rows: DataFrame) -> DataFrame:
    """Rows as often as an estimate takes them in: for their group's and, where some small group falls back to them, their language's and that of all rows."""
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null"))
    wide = F.array_distinct(F.array("grp", F.to_json(F.array(lang)), F.lit("[]")))
    used = rows.where("grp is not null").select("grp").distinct()
    return rows.where(~F.col("base_failed")).select(F.explode(wide).alias("grp"), *X).join(used, "grp", "left_semi")


def _quantile_bins(binned: DataFrame, keys: list[str], share: float) -> DataFrame:
    """For each key the least bin at or below which ``share`` of its rows lie, from counts by bin."""
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    upto = counts.withColumns({"upto": F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")), "total": F.sum("n").over(Window.partitionBy(*keys))})
    return upto.where(F.col("upto") >= F.ceil(share * F.col("total"))).groupBy(*keys).agg(F.min("bin").alias("cut"))


def _with_inverse(cov: DataFrame) -> DataFrame:
    """From columns c_i_j add w_i_j, the inverse of the Cholesky factor, so that the squared distance is |W (x - m)|^2."""
    d = len(X)
    for i in range(d):
        for j in range(i + 1):
            rest = sum((F.col(f"t_{i}_{k}") * F.col(f"t_{j}_{k}") for k in range(j)), F.lit(0.0))
            cov = cov.withColumn(f"t_{i}_{j}", F.sqrt(F.col(f"c_{i}_{i}") - rest) if i == j else (F.col(f"c_{i}_{j}") - rest) / F.col(f"t_{j}_{j}"))
    for j in range(d):
        for i in range(j, d):
            rest = sum((F.col(f"t_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j, i)), F.lit(0.0))
            cov = cov.withColumn(f"w_{i}_{j}", F.lit(1.0) / F.col(f"t_{i}_{i}") if i == j else -rest / F.col(f"t_{i}_{i}"))
    return cov.select("grp", *[f"m_{i}" for i in range(d)], *[f"w_{i}_{j}" for i in range(d) for j in range(i + 1)])


def _distance() -> Column:
    d = len(X)
    off = [F.col(x) - F.col(f"m_{i}") for i, x in enumerate(X)]
    return sum((F.pow(sum((F.col(f"w_{i}_{j}") * off[j] for j in range(i + 1)), F.lit(0.0)), F.lit(2)) for i in range(d)), F.lit(0.0))


def _estimate(chosen: DataFrame, factor: float) -> DataFrame:
    """Means and floored covariances of each group of rows, from exact whole-number sums."""
    d = len(X)
    sums = chosen.groupBy("grp").agg(
        F.count("*").alias("n"), *[F.sum(x).alias(f"s_{i}") for i, x in enumerate(X)],
        *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q_{i}_{j}") for i in range(d) for j in range(i + 1)],
    )
    floor = [(v * STEP) ** 2 for v in FLOORS.values()]
    means = sums.select("*", *[(F.col(f"s_{i}") / F.col("n")).alias(f"m_{i}") for i in range(d)])
    cov = means.select(
        "grp", *[f"m_{i}" for i in range(d)],
        *[((F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) * factor + (floor[i] if i == j else 0.0)).alias(f"c_{i}_{j}") for i in range(d) for j in range(i + 1)],
    )
    return _with_inverse(cov)


def minimum_covariance_determinant(members: DataFrame) -> DataFrame:
    """One row a ``grp``: means m_i and inverse Cholesky factor w_i_j of the MCD estimate over the rows (grp, *X).

    The start is the median and the median absolute deviation of each statistic,
    as in the deterministic variant; C-steps follow. A step's subset is all rows
    up to the distance bin at which SUBSET of the group is reached, so that ties
    stay together. FLOORS are added to the covariances, as most documents have
    zeros in some statistics. Medians and subsets come from counts by bin; no
    group is gathered. Extra columns are left out; no rows, no estimates.
    """
    d = len(X)
    long = members.select("grp", F.posexplode(F.array(*X)).alias("dim", "x"))
    medians = written(_quantile_bins(long.withColumn("bin", F.col("x")), ["grp", "dim"], 0.5).withColumnRenamed("cut", "med"), "mcd")
    spread = long.join(sized(medians), ["grp", "dim"]).select("grp", "dim", F.abs(F.col("x") - F.col("med")).alias("bin"))
    start = medians.join(_quantile_bins(spread, ["grp", "dim"], 0.5), ["grp", "dim"])
    floor = F.array(*[F.lit((v * STEP) ** 2) for v in FLOORS.values()])
    diagonal = start.groupBy("grp").pivot("dim", list(range(d))).agg(F.first("med").cast("double").alias("m"), F.first(F.pow(F.col("cut") * 1.4826, F.lit(2)) + floor[F.col("dim")]).alias("v"))
    estimate = _with_inverse(
        diagonal.select("grp", *[F.col(f"{i}_m").alias(f"m_{i}") for i in range(d)], *[(F.col(f"{i}_v") if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(d) for j in range(i + 1)])
    )
    factor = SUBSET / chi2_cdf(chi2_quantile(SUBSET, d), d + 2)
    for _ in range(C_STEPS):
        estimate = sized(written(estimate, "mcd"))
        binned = members.join(estimate, "grp").select("grp", *X, F.least(F.floor(F.log1p(_distance()) * BINS), F.lit(MOST_BIN)).cast("int").alias("bin"))
        cuts = sized(written(_quantile_bins(binned.select("grp", "bin"), ["grp"], SUBSET), "mcd"))
        estimate = _estimate(binned.join(cuts, "grp").where("bin <= cut"), factor)
    return written(estimate, "mcd")


@settled("judged")
def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed, distance2 and kept for each row of docs.

    A row that fails the base rules is rejected and enters no estimate. Null
    lang or source form groups of their own. Small groups take the estimate of
    their language or of all rows (MIN_ROWS). Ties and repeated rows are judged
    alike. Columns of docs other than doc_id, text, lang and source are left out.
    """
    rows = written(_grouped(vectors(written(base_statistics(docs), "stats"))), "vectors")
    estimate = minimum_covariance_determinant(_members(rows))
    cut = chi2_quantile(QUANTILE, len(X))
    judged = rows.join(sized(estimate), "grp", "left").withColumn("distance2", F.when(~F.col("base_failed"), _distance()))
    return judged.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= cut)).alias("kept"), "distance2",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns. A doc_id (or null) that stands for several rows is kept if all of them are."""
    return without_ids(docs, judge(docs).where("not kept").select("doc_id"))
