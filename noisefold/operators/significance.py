"""Effect sizes and significance tests over seeds."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effect_size(df: DataFrame, by: list[str], side: Column, value: str) -> DataFrame:
    """Cohen's d with pooled variance between rows where side is true and where it is false: by, n_a, n_b, mean_diff, cohen_d."""
    a, b = F.when(side, F.col(value)), F.when(~side, F.col(value))
    g = df.groupBy(*by).agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    pooled = ((F.col("n_a") - 1) * F.coalesce("va", F.lit(0.0)) + (F.col("n_b") - 1) * F.coalesce("vb", F.lit(0.0))) / F.greatest(F.col("n_a") + F.col("n_b") - 2, F.lit(1))
    return g.select(*by, "n_a", "n_b", (F.col("ma") - F.col("mb")).alias("mean_diff"), ((F.col("ma") - F.col("mb")) / F.sqrt(F.greatest(pooled, F.lit(1e-12)))).alias("cohen_d"))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    safe = lambda v: v if abs(v) > 1e-300 else 1e-300
    c, d = 1.0, 1 / safe(1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / safe(1 + term * d), safe(1 + term / c)
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return f * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def t_pvalue(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if math.isnan(t) or df <= 0:
        return math.nan
    return _beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def paired_t(diffs: list[float]) -> tuple[float, float]:
    n = len(diffs)
    if n < 2:
        return math.nan, math.nan
    mean = sum(diffs) / n
    var = sum((x - mean) ** 2 for x in diffs) / (n - 1)
    if var == 0:
        return (math.nan, math.nan) if mean == 0 else (math.copysign(math.inf, mean), 0.0)
    t = mean / math.sqrt(var / n)
    return t, t_pvalue(t, n - 1)


def welch(df: DataFrame, by: list[str], side: Column, value: str) -> DataFrame:
    """Welch's test of the rows where side is true against those where it is false, for sides that share fewer than two seeds: by, n_a, n_b, mean_diff, t, dof, p_t. One aggregation; nulls don't count. t, dof and p_t are null where a side has fewer than two values or neither varies."""
    a, b = F.when(side, F.col(value)), F.when(~side, F.col(value))
    g = df.groupBy(*by).agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), (F.avg(a) - F.avg(b)).alias("mean_diff"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    ea, eb = F.col("va") / F.col("n_a"), F.col("vb") / F.col("n_b")  # of the means
    defined = (F.col("n_a") > 1) & (F.col("n_b") > 1) & (ea + eb > 0)
    t = F.when(defined, F.col("mean_diff") / F.sqrt(ea + eb))
    dof = F.when(defined, (ea + eb) * (ea + eb) / (ea * ea / (F.col("n_a") - 1) + eb * eb / (F.col("n_b") - 1)))

    @F.pandas_udf("double")
    def p(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([t_pvalue(x, n) for x, n in zip(t, dof)], dtype=float)

    one = g.withColumn("t", t).withColumn("dof", dof)
    return one.select(*by, "n_a", "n_b", "mean_diff", "t", "dof", F.when(F.col("t").isNotNull(), p(F.coalesce("t", F.lit(0.0)), F.coalesce("dof", F.lit(1.0)))).alias("p_t"))


def mann_whitney(x: list[float], y: list[float]) -> tuple[float, float]:
    """U of x and its two-sided p-value: exact for samples where one has at most 8 values and none are tied, else normal with tie and continuity correction."""
    n, m = len(x), len(y)
    if not n or not m:
        return math.nan, math.nan
    both = sorted([(v, 0) for v in x] + [(v, 1) for v in y])
    rank_sum, ties, i = 0.0, 0.0, 0
    while i < n + m:
        j = i
        while j < n + m and both[j][0] == both[i][0]:
            j += 1
        rank_sum += sum(1 for k in range(i, j) if both[k][1] == 0) * (i + j + 1) / 2
        ties += (j - i) ** 3 - (j - i)
        i = j
    u = rank_sum - n * (n + 1) / 2
    return u, rank_pvalue(u, n, m, ties)


def rank_pvalue(u: float, n: int, m: int, ties: float) -> float:
    """Two-sided p-value of U for sides of n and m values; ties is the sum of t^3 - t over groups of t equal values."""
    high = max(u, n * m - u)
    if min(n, m) <= 8 and not ties:
        top = n * m + n * (n + 1) // 2
        ways = [[1] + [0] * top] + [[0] * (top + 1) for _ in range(n)]  # subsets of the ranks so far by size and sum
        for rank in range(1, n + m + 1):
            for size in range(min(rank, n), 0, -1):
                ways[size] = [w + (ways[size - 1][s - rank] if s >= rank else 0) for s, w in enumerate(ways[size])]
        tail = sum(ways[n][math.ceil(high) + n * (n + 1) // 2 :]) / math.comb(n + m, n)
        return min(1.0, 2 * tail)
    var = n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1)))
    if var == 0:
        return 1.0
    z = (high - n * m / 2 - 0.5) / math.sqrt(var)
    return min(1.0, math.erfc(z / math.sqrt(2)))


def paired_seeds(df: DataFrame, by: list[str], a: Column, b: Column, value: str, seed: str = "seed") -> DataFrame:
    """by, seed, value_a, value_b: both sides joined on the seed."""
    left = df.where(a).select(*by, seed, F.col(value).alias("value_a"))
    return left.join(df.where(b).select(*by, seed, F.col(value).alias("value_b")), [*by, seed])


def average_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """rank: each row's average rank of value within by."""
    w = Window.partitionBy(*by)
    return df.withColumn("_r", F.rank().over(w.orderBy(value))).withColumn("rank", F.col("_r") + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0).drop("_r")


def significance(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, mean_diff, t, p_t, u, p_u of paired values. t and U are aggregates (U the rank sum of value_a among both sides' values), p-values follow from them; null where undefined, as for a single pair. The difference of all pairs being the same number is an infinite t, of which only the p-value 0 is given."""
    both = pairs.where("value_a is not null and value_b is not null")
    diff = F.col("value_a") - F.col("value_b")
    paired = both.groupBy(*by).agg(F.count("*").alias("n"), F.avg(diff).alias("mean_diff"), F.var_samp(diff).alias("var"))
    sides = both.select(*by, F.explode(F.array(F.struct(F.col("value_a").alias("v"), F.lit(1).alias("a")), F.struct(F.col("value_b").alias("v"), F.lit(0).alias("a")))).alias("x")).select(*by, "x.*")
    tied = sides.groupBy(*by, "v").agg(F.count("*").alias("m"), F.sum("a").alias("a"))
    below = F.coalesce(F.sum("m").over(Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = tied.withColumn("rank", below + (F.col("m") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("a")).alias("ranks"), F.sum(F.col("m") * F.col("m") * F.col("m") - F.col("m")).cast("double").alias("ties"))

    @F.pandas_udf("double")
    def p_t(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_pvalue(x, m - 1) for x, m in zip(t, n)], dtype=float)

    @F.pandas_udf("double")
    def p_u(u: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([rank_pvalue(x, int(m), int(m), y) for x, m, y in zip(u, n, ties)], dtype=float)

    t = F.when((F.col("n") > 1) & (F.col("var") > 0), F.col("mean_diff") / F.sqrt(F.col("var") / F.col("n")))
    one = paired.join(sums, by).withColumn("t", t).withColumn("u", F.col("ranks") - F.col("n") * (F.col("n") + 1) / 2)
    certain = F.when((F.col("n") > 1) & (F.col("var") == 0) & (F.col("mean_diff") != 0), F.lit(0.0))
    return one.select(*by, "n", "mean_diff", "t", F.coalesce(F.when(F.col("t").isNotNull(), p_t(F.coalesce("t", F.lit(0.0)), "n")), certain).alias("p_t"), "u", p_u("u", "n", "ties").alias("p_u"))
