"""Rank statistics that scale: all of them come from counts of distinct values.

The table is aggregated once, by (column, value) or by (value, outcome); these counts are stored, and
the ranks, quantiles, areas and correlations are made of them alone.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.scratch import numbered, running, stored


def value_counts(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """column, v (double), c and further aggregates for each distinct non-null value, in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))
    rows = df.select("*", F.explode(pairs).alias("__x")).where("__x.v is not null")
    return rows.groupBy(F.col("__x.column").alias("column"), F.col("__x.v").alias("v")).agg(F.count("*").alias("c"), *more)


def cumulative(counts: DataFrame, by: list[str] | None = None, reused: bool = False) -> DataFrame:
    """counts (by, v, c, ...) with before (the count of smaller values' rows in the group) and n (of all).

    The running sum sees distinct values, not rows, and is split by ranges of them; the groups (the
    columns or signals that are compared) are few. A result that is reused is stored.
    """
    by = by or []
    rows = running(counts, [*by, "v"], F.col("c"), "__upto")
    group = rows.groupBy(*by).agg(F.sum("c").alias("n"))  # a row for each group, in the order of the rows
    first = F.sum("n").over(Window.orderBy(*by)) - F.col("n") if by else F.lit(0)
    group = F.broadcast(group.withColumn("__first", first))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    group = group.select(*(F.col(c).alias(f"__{c}") for c in by), "n", "__first")
    rows = rows.join(group, functools.reduce(lambda x, y: x & y, same)) if by else rows.join(group)
    rows = rows.withColumn("before", F.col("__upto") - F.col("__first")).drop("__upto", "__first", *(f"__{c}" for c in by))
    return stored(rows) if reused else rows


def mean_rank() -> Column:
    """The average rank of the rows of a value, from cumulative()."""
    return F.col("before") + (F.col("c") + 1) / 2.0


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the average rank of a non-null value among all rows, and `<out>_n`, their number."""
    ranked = cumulative(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c")))
    ranked = ranked.select(F.col("v").alias("__v"), mean_rank().alias(out), F.col("n").alias(f"{out}_n"))
    return df.join(ranked, F.col(value) == F.col("__v"), "left").drop("__v")


def _quantile(counts: DataFrame, q: float, out: str) -> DataFrame:
    """One row: the quantile by linear interpolation, from cumulative()."""
    place = F.lit(q) * (F.col("n") - 1)
    at = lambda x: F.max(F.when((F.col("before") <= x) & (x < F.col("before") + F.col("c")), F.col("v")))
    found = counts.agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"), F.max(place - F.floor(place)).alias("f"))
    return found.select((F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias(out))


def exact_quantile(df: DataFrame, value: str, q: float, out: str) -> DataFrame:
    """One row: the quantile by linear interpolation, from the running counts of distinct values."""
    return _quantile(cumulative(value_counts(df, [value]).drop("column")), q, out)


def _area(sum_of_ranks: Column, k: Column, n: Column) -> Column:
    return F.try_divide(sum_of_ranks - k * (k + 1) / 2.0, k * (n - k))


def auc(df: DataFrame, value: str, flag: str, low_flags: bool = False) -> DataFrame:
    """One row: AUC that flagged rows have larger values (smaller ones with low_flags), and counts.

    Rows with either null don't count; null if a class is empty.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(flag).isNotNull())
    counts = cumulative(rows.groupBy((-F.col(value) if low_flags else F.col(value)).alias("v")).agg(F.count("*").alias("c"), F.count_if(flag).alias("k")))
    k, n = F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))
    return counts.agg(_area(F.sum(F.col("k") * mean_rank()), k, n).alias("auc"), k.alias("n_flagged"), n.alias("n"))


def _rank_correlation(weight: Column, n: Column) -> Column:
    """Of the ranks a and b, whose means are (n + 1) / 2."""
    a, b = F.col("a") - (n + 1) / 2.0, F.col("b") - (n + 1) / 2.0
    return F.try_divide(F.sum(weight * a * b), F.sqrt(F.sum(weight * a * a)) * F.sqrt(F.sum(weight * b * b)))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the correlation of average ranks; null under 3 complete pairs."""
    return spearman_pairs(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), [(x, y)]).select("rho", "n")


def _with_ranks(joint: DataFrame, by: str) -> DataFrame:
    """The stored counts w of (by, x, y) with the average ranks a of x and b of y in their group, and n."""
    sides = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("x").alias("v")), F.struct(F.lit("b").alias("side"), F.col("y").alias("v"))))
    sides = joint.select(by, "w", sides.alias("s")).groupBy(by, F.col("s.side").alias("side"), F.col("s.v").alias("v")).agg(F.sum("w").alias("c"))
    ranked = cumulative(sides, [by, "side"], reused=True)
    of = lambda side, v, *more: ranked.where(F.col("side") == side).select(by, F.col("v").alias(v), mean_rank().alias(side), *more)
    return joint.join(of("a", "x", "n"), [by, "x"]).join(of("b", "y"), [by, "y"])


def spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """x, y, rho and n for each pair of columns; rows in which a column is null don't count in its pairs.

    One pass over df, which counts (pair, x, y)."""
    made = F.array(*(F.struct(F.lit(k).alias("pair"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for k, (x, y) in enumerate(pairs)))
    joint = df.select(F.explode(made).alias("p")).select("p.*").where("x is not null and y is not null")
    rows = _with_ranks(stored(joint.groupBy("pair", "x", "y").agg(F.count("*").alias("w"))), "pair")
    found = rows.groupBy("pair").agg(_rank_correlation(F.col("w"), F.col("n")).alias("rho"), F.max("n").alias("n"))
    every = df.sparkSession.createDataFrame([(k, x, y) for k, (x, y) in enumerate(pairs)], "pair int, x string, y string")
    return every.join(F.broadcast(found), "pair", "left").select("x", "y", F.when(F.col("n") >= 3, F.col("rho")).alias("rho"), F.coalesce("n", F.lit(0)).alias("n"))


def percent_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with average rank / count of the non-null values."""
    return average_ranks(df, value, "__r").withColumn(out, F.col("__r") / F.col("__r_n")).drop("__r", "__r_n")


def rank_average(df: DataFrame, values: list[str], out: str) -> DataFrame:
    """df with the sum of the percent ranks of the columns, which are counted in one pass."""
    return _sum_of_ranks(df, values, cumulative(value_counts(df, values), ["column"], reused=True), out)


def _sum_of_ranks(df: DataFrame, values: list[str], ranked: DataFrame, out: str) -> DataFrame:
    ranked = ranked.select("column", "v", (mean_rank() / F.col("n")).alias("r"))
    for k, c in enumerate(values):
        one = ranked.where(F.col("column") == c).select(F.col("v").alias(f"__v{k}"), F.col("r").alias(f"__r{k}"))
        df = df.join(one, F.col(c).cast("double") == F.col(f"__v{k}"), "left")
    total = functools.reduce(lambda a, b: a + b, (F.col(f"__r{k}") for k in range(len(values))))
    return df.withColumn(out, total).drop(*(f"__{x}{k}" for k in range(len(values)) for x in "vr"))


def signal_comparison(df: DataFrame, signals: list[str], outcome: str, q: float = 0.1, combined: str = "combined") -> DataFrame:
    """signal, auc, rho: how well a low signal flags the worst q of the outcome, and its rank correlation
    with the outcome; the signals and the sum of their percent ranks, as `combined`.

    Rows without the outcome don't count, nor do those without the signal in its row. Two passes over
    df: the counts of each column's values, for the cut and the percent ranks, and the counts of
    (signal, value, outcome), of which all the rest is made.
    """
    rows = df.where(F.col(outcome).isNotNull()).select(*dict.fromkeys([*signals, outcome]))
    ranked = cumulative(value_counts(rows, [*signals, outcome]), ["column"], reused=True)
    cut = _quantile(ranked.where(F.col("column") == outcome), q, "cut")
    rows = _sum_of_ranks(rows, signals, ranked.where(F.col("column") != outcome), combined)
    made = F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("x")) for s in (*signals, combined)))
    joint = rows.select(F.col(outcome).cast("double").alias("y"), F.explode(made).alias("p")).select("p.*", "y").where("x is not null")
    joint = stored(joint.groupBy("signal", "x", "y").agg(F.count("*").alias("w")))
    rows = _with_ranks(joint, "signal").join(F.broadcast(cut))  # one row
    bad = F.when(F.col("y") <= F.col("cut"), F.col("w")).otherwise(F.lit(0))
    k, n = F.sum(bad), F.max("n")
    # a low signal flags: the rank from above is n + 1 less the rank
    area = _area(F.sum(bad * (F.col("n") + 1 - F.col("a"))), k, n)
    return rows.groupBy("signal").agg(area.alias("auc"), F.when(n >= 3, _rank_correlation(F.col("w"), F.col("n"))).alias("rho"))


def worst_quantile(df: DataFrame, value: str, q: float, out: str) -> DataFrame:
    """df with a flag of values up to the exact quantile."""
    cut = exact_quantile(df, value, q, "__cut")
    return df.join(F.broadcast(cut)).withColumn(out, F.col(value) <= F.col("__cut")).drop("__cut")  # one row


def eligible(table: DataFrame, skip: tuple[str, ...] = ("candidate", "n", "ece", "mce", "overconfidence", "mean_plddt", "mean_lddt")) -> list[str]:
    """The columns that may explain a tail: numeric or boolean, no outcome, no left-over of a merge (`_x`, `_y`)."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    return [c for c, t in table.dtypes if (t in kinds or t.startswith("decimal")) and c not in skip and not c.endswith(("_x", "_y"))]


def covariate_scan(table: DataFrame, covariates: list[str], flag: str) -> DataFrame:
    """covariate, n, auc_tail_higher, effect, tail_median, rest_median for each numeric covariate.

    Covariates of under 20 values or under 2 distinct ones are left out. All are counted by (covariate,
    value) in one pass over the table; the medians come from the counts too.
    """
    rows = table.where(F.col(flag).isNotNull())
    counts = cumulative(value_counts(rows, covariates, F.count_if(flag).alias("k")).withColumnRenamed("column", "covariate"), ["covariate"], reused=True)
    k, n = F.sum("k"), F.sum("c")
    found = counts.groupBy("covariate").agg(n.alias("n"), F.count("*").alias("n_distinct"), _area(F.sum(F.col("k") * mean_rank()), k, n).alias("auc_tail_higher"))
    halves = counts.select("covariate", "v", F.explode(F.array(F.struct(F.lit("tail_median").alias("half"), F.col("k").alias("c")), F.struct(F.lit("rest_median").alias("half"), (F.col("c") - F.col("k")).alias("c")))).alias("h"))
    halves = cumulative(halves.select("covariate", "h.half", "v", "h.c").where("c > 0"), ["covariate", "half"])
    place = (F.col("n") - 1) / 2.0
    at = lambda x: F.max(F.when((F.col("before") <= x) & (x < F.col("before") + F.col("c")), F.col("v")))
    medians = halves.groupBy("covariate", "half").agg(((at(F.floor(place)) + at(F.ceil(place))) / 2).alias("m"))
    medians = medians.groupBy("covariate").pivot("half", ["tail_median", "rest_median"]).agg(F.first("m"))
    found = found.where("n >= 20 and n_distinct >= 2").drop("n_distinct").join(medians, "covariate", "left")
    return found.withColumn("effect", F.abs(F.col("auc_tail_higher") - 0.5))


def top_k(table: DataFrame, by: str, key: str, k: int | None, out: str, quantile: float | None = None) -> DataFrame:
    """table (of targets, one row for a key) with a flag of the k rows of largest value; ties by key.

    Without k, as many as the quantile's share of the rows, rounded half to even, and one at least.
    """
    if k is None:
        k = max(1, round(table.count() * float(quantile)))
    top = table.select(by, key).orderBy(F.desc(by), key).limit(k).select(key, F.lit(True).alias("__top"))
    return table.join(top, key, "left").withColumn(out, F.coalesce("__top", F.lit(False))).drop("__top")


def within_bounds(table: DataFrame, above: dict[str, float], below: dict[str, float], out: str, digits: int = 9) -> DataFrame:
    """table with a flag of the rows whose values are above and below the bounds, all of them.

    Values are rounded first: a mean that equals its bound is neither above nor below, in whatever order
    its rows were added up.
    """
    parts = [F.round(c, digits) > F.lit(b) for c, b in above.items()] + [F.round(c, digits) < F.lit(b) for c, b in below.items()]
    return table.withColumn(out, functools.reduce(lambda a, b: a & b, parts))


def tertile(table: DataFrame, value: str, tie: str, out: str) -> DataFrame:
    """table with low, mid or high by rank among the non-null values (ties by `tie`); null if under three.

    It follows the quantile cut of first ranks: with r from 0, low while r is under a third of n - 1.
    """
    known = numbered(table.where(F.col(value).isNotNull()).select(F.col(tie).alias("__t"), F.col(value).alias("__v")), ["__v", "__t"], "__r")
    n = known.agg(F.count("*").alias("__n"))
    r, m = 3 * F.col("__r"), F.col("__n") - 1
    label = F.when(F.col("__n") < 3, None).when(r < m, "low").when(r < 2 * m, "mid").otherwise("high")
    known = known.join(F.broadcast(n)).select("__t", label.alias(out))  # one row
    return table.join(known, F.col(tie) == F.col("__t"), "left").drop("__t")


def significant(scan: DataFrame, p: str = "p_perm", alpha: float = 0.05) -> DataFrame:
    """scan (a row for each covariate) with the bound alpha / tests, the direction, and whether p is under it."""
    n = scan.agg(F.greatest(F.count("*"), F.lit(1)).alias("__n"))
    rows = scan.join(F.broadcast(n))  # one row
    bound = F.lit(alpha) / F.col("__n")
    return rows.withColumn("bonferroni", bound).withColumn("direction", F.when(F.col("auc_tail_higher") > 0.5, "higher").otherwise("lower")).withColumn("significant", F.coalesce(F.col(p) < bound, F.lit(False))).drop("__n")


def residual_correlation(df: DataFrame, y: str, x: str, z: str) -> DataFrame:
    """One row: the correlation of z with what is left of y after a linear fit on x."""
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull() & F.col(z).isNotNull())
    fit = rows.agg(F.regr_slope(y, x).alias("__s"), F.regr_intercept(y, x).alias("__i"))
    rows = rows.join(F.broadcast(fit))  # one row
    return rows.agg(F.corr(F.col(y) - F.col("__s") * F.col(x) - F.col("__i"), F.col(z)).alias("corr_residual"), F.count("*").alias("n"))
