"""Report queries over results and history relations. Each returns a frame; drawing it is up to the reader."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisefold.functions import vectors
from noisefold.operators import significance


def summary(df: DataFrame, by: Sequence[str], values: Sequence[str], stats: Sequence[str] = ("mean", "std")) -> DataFrame:
    """{value}_{stat} per group: mean, std (sample), count. Null keys drop."""
    make = {"mean": F.avg, "std": F.stddev_samp, "count": F.count}
    kept = df.dropna(subset=list(by)) if by else df
    return kept.groupBy(*by).agg(*(make[s](v).alias(f"{v}_{s}") for v in values for s in stats))


def curve(df: DataFrame, dataset: str, x: str, values: Sequence[str], methods: Sequence[str] | None = None, eps: float | None = None) -> DataFrame:
    """Mean and deviation of values by method and x, for one dataset, some methods, one budget."""
    out = df.where(F.col("dataset") == dataset)
    out = out.where(F.col("method").isin(*methods)) if methods else out
    out = out.where(vectors.close("eps_tot", eps)) if eps is not None else out
    return summary(out, ["method", x], values)


def in_order(df: DataFrame, names: Sequence[str], by: str = "method") -> DataFrame:
    """A row for each name in order (column pos), null where df has none."""
    order = df.sparkSession.createDataFrame(list(enumerate(names)), f"pos int, {by} string")
    return order.join(df, by, "left")


def ablation(df: DataFrame, dataset: str, eps: float, names: Sequence[str], values: Sequence[str] = ("f1",)) -> DataFrame:
    """Mean and deviation by method in the order of names."""
    return in_order(summary(df.where((F.col("dataset") == dataset) & vectors.close("eps_tot", eps)), ["method"], values), names)


def of_runs(results: DataFrame, history: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """History rows with their run's columns."""
    return history.join(results.select("run_id", *columns), "run_id", how)


def running_budget(history: DataFrame, run: Sequence[str] = ("run_id",), order: Sequence[str] = ("iter",)) -> DataFrame:
    """eps_cum: budget spent up to each iteration."""
    w = Window.partitionBy(*run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("eps_cum", F.sum("eps_t").over(w))


def remaining_budget(history: DataFrame, run: Sequence[str] = ("run_id",), order: Sequence[str] = ("iter",)) -> DataFrame:
    """eps_left: budget of each iteration and all after it."""
    w = Window.partitionBy(*run).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return history.withColumn("eps_left", F.sum("eps_t").over(w))


def drift_steps(history: DataFrame, run: Sequence[str] = ("run_id",), order: Sequence[str] = ("iter",)) -> DataFrame:
    """lag_1, lag_2 and whether drift fell by 2 % from one to the other."""
    w = Window.partitionBy(*run).orderBy(*order)
    out = history.withColumn("lag_1", F.lag("drift", 1).over(w)).withColumn("lag_2", F.lag("drift", 2).over(w))
    return out.withColumn("improved", F.col("lag_1") <= F.col("lag_2") * 0.98)


def smoothed(history: DataFrame, value: str, beta: float, run: str = "run_id", order: Sequence[str] = ("iter",)) -> DataFrame:
    """run, ema: the exponential mean m <- beta m + (1 - beta) x after a run's last iteration."""
    rows = history.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("x")))).alias("rows"))
    return rows.select(run, F.aggregate("rows", F.lit(0.0), lambda m, r: m * beta + r["x"] * (1 - beta)).alias("ema"))


def box(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Box-plot numbers: exact quartiles, and the extremes within 1.5 interquartile ranges."""
    q = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q, list(by)).where(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(*by, "q1", "q2", "q3").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def scatter(df: DataFrame, dataset: str, eps: float, value: str = "f1") -> DataFrame:
    """Each seed's value with its method's mean over all."""
    some = df.where((F.col("dataset") == dataset) & vectors.close("eps_tot", eps)).groupBy("method", "seed").agg(F.avg(value).alias(value))
    return some.withColumn("mean", F.avg(value).over(Window.partitionBy("method")))


def collapse_rates(results: DataFrame, history: DataFrame, least: float = 0.01) -> DataFrame:
    """Results with the share of iterations in which a cluster was empty or below least; null without a history."""
    flag = (F.col("non_empty_k") < F.col("k")) | (F.col("min_cluster_ratio") < least)
    rate = history.join(results.select("run_id", "k"), "run_id").groupBy("run_id").agg(F.avg(F.when(flag, 1.0).otherwise(0.0)).alias("collapse_rate"))
    return results.join(rate, "run_id", "left")


def final_collapse(results: DataFrame, thresholds: Mapping[str, float], default: float = 0.55) -> DataFrame:
    """collapse: a cluster is empty at the end or holds more than its dataset's threshold."""
    limits = results.sparkSession.createDataFrame(list(thresholds.items()), "dataset string, _limit double")
    out = results.join(F.broadcast(limits), "dataset", "left")
    bad = (F.col("non_empty_k_final") < F.col("k")) | (F.col("max_cluster_ratio_final") > F.coalesce("_limit", F.lit(default)))
    return out.withColumn("collapse", bad.cast("int")).drop("_limit")


def split_summary(results: DataFrame) -> DataFrame:
    """Runs, F1 and collapse by budget split."""
    return results.groupBy("dataset", "method", "eps_tot", "eps_proxy_ratio").agg(F.count("*").alias("runs"), F.avg("f1").alias("f1_mean"), F.stddev_samp("f1").alias("f1_std"), F.avg("sse_x").alias("sse_mean"), F.avg("collapse").alias("collapse_rate"))


def evaluation(results: DataFrame) -> DataFrame:
    return results.groupBy("dataset", "method", "eps_tot").agg(F.count("*").alias("runs"), F.avg("f1").alias("f1_mean"), F.stddev_samp("f1").alias("f1_std"), F.avg("sse_x").alias("sse_mean"), F.avg("runtime_ms_total").alias("runtime_mean"))


def lead(summary_: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """best: the highest mean F1 of each dataset and budget; leads: whether a method reaches it."""
    best = F.max("f1_mean").over(Window.partitionBy("dataset", "eps_tot"))
    return summary_.withColumn("best", best).withColumn("leads", F.col("f1_mean") >= F.col("best") - tolerance)


def best_config(candidates: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The candidate of highest mean F1, then smallest deviation, then smallest error, then first."""
    rest = [c for c in candidates.columns if c not in by]
    key = F.struct(F.col("f1_mean"), -F.coalesce("f1_std", F.lit(0.0)), -F.col("sse_mean"), -F.col(order))
    return candidates.groupBy(*by).agg(F.max_by(F.struct(*rest), key).alias("_x")).select(*by, "_x.*")


def mean_pm_std(value: str, fmt: str = "%.3f") -> Column:
    """`mean±std`; -- without a mean, nan for a missing deviation."""
    mean, std = F.col(f"{value}_mean"), F.col(f"{value}_std")
    return F.when(mean.isNull(), F.lit("--")).otherwise(F.concat(F.format_string(fmt, mean), F.lit("±"), F.coalesce(F.format_string(fmt, std), F.lit("nan"))))


def nearest_values(df: DataFrame, col: str, wanted: Sequence[float]) -> list[float]:
    """For each wanted value the nearest that occurs (ties to the smaller), without repeats."""
    have = sorted(r[0] for r in df.select(col).distinct().dropna().collect())
    out: list[float] = []
    for w in wanted:
        if have and (near := min(have, key=lambda v: (abs(v - w), v))) not in out:
            out.append(near)
    return out


def main_table(df: DataFrame, wanted: Sequence[float], names: Sequence[str], values: Sequence[str] = ("f1", "sse_x")) -> DataFrame:
    """dataset, eps_tot, method, one text per value, and bold: the method of highest mean F1 at three decimals, the first of equals in the order of names."""
    near = df.select("dataset", "eps_tot").distinct().crossJoin(df.sparkSession.createDataFrame([(float(w),) for w in wanted], "w double"))
    chosen = near.groupBy("dataset", "w").agg(F.min_by("eps_tot", F.struct(F.abs(F.col("eps_tot") - F.col("w")), "eps_tot")).alias("eps_tot")).select("dataset", "eps_tot").distinct()
    s = summary(df.join(chosen, ["dataset", "eps_tot"]), ["dataset", "eps_tot", "method"], values)
    s = s.join(df.sparkSession.createDataFrame(list(enumerate(names)), "pos int, method string"), "method")
    first = F.row_number().over(Window.partitionBy("dataset", "eps_tot").orderBy(F.desc(F.round(F.col(f"{values[0]}_mean"), 3)), "pos"))
    return s.withColumn("bold", first == 1).select("dataset", "eps_tot", "method", *(mean_pm_std(v).alias(f"{v}_text") for v in values), "bold")


def wide_table(df: DataFrame, dataset: str, budgets: Sequence[float], values: Sequence[str] = ("f1", "sse_x")) -> DataFrame:
    """method and one column {value}@{eps} per value and budget, - where there is none."""
    some = df.where(F.col("dataset") == dataset)
    cells = some.groupBy("method").pivot("eps_tot", list(budgets)).agg(*(F.when(F.avg(v).isNotNull(), F.format_string("%.3f", F.avg(v))).alias(v) for v in values))
    return cells.select("method", *(F.coalesce(F.col(f"`{e}_{v}`"), F.lit("-")).alias(f"{v}@{e}") for e in budgets for v in values))


def axis_bounds(summary_: DataFrame, by: Sequence[str], value: str, low: float | None = None, high: float | None = None, pad: float = 0.08) -> DataFrame:
    """by, lo, hi: extremes of mean -+ deviation with a margin, clamped."""
    m, s = F.col(f"{value}_mean"), F.coalesce(F.col(f"{value}_std"), F.lit(0.0))
    b = summary_.groupBy(*by).agg(F.min(m - s).alias("a"), F.max(m + s).alias("b"))
    lo, hi = F.col("a") - pad * (F.col("b") - F.col("a")), F.col("b") + pad * (F.col("b") - F.col("a"))
    return b.select(*by, (F.greatest(lo, F.lit(low)) if low is not None else lo).alias("lo"), (F.least(hi, F.lit(high)) if high is not None else hi).alias("hi"))


def scaled_error(summary_: DataFrame, value: str) -> DataFrame:
    """The value over 1e6 or 1e5 where the largest mean calls for it, and the divisor."""
    top = F.max(F.abs(f"{value}_mean")).over(Window.partitionBy(F.lit(1)))
    by = F.when(top >= 1e6, 1e6).when(top >= 1e5, 1e5).otherwise(1.0)
    return summary_.withColumn("divisor", by).withColumn("shown", F.col(f"{value}_mean") / F.col("divisor"))


def schedule_overlay(schedules: DataFrame) -> DataFrame:
    """name, t (from 1), eps of schedules given as name, schedule arrays."""
    return schedules.select("name", F.posexplode("schedule").alias("t", "eps")).withColumn("t", F.col("t") + 1)


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """primary's rows, values missing there taken from the fallback table."""
    other = fallback.select(*keys, *(F.col(v).alias(f"_{v}") for v in values))
    joined = primary.join(other, list(keys), "left")
    return joined.select(*(c for c in primary.columns if c not in values), *(F.coalesce(F.col(v), F.col(f"_{v}")).alias(v) for v in values))


def significance_table(df: DataFrame, a: str, b: str, value: str = "f1", by: Sequence[str] = ("dataset", "eps_tot")) -> DataFrame:
    """Paired comparison of two methods over seeds: n, mean_diff, t, p_t, u, p_u."""
    one = df.groupBy(*by, "method", "seed").agg(F.avg(value).alias(value))
    return significance.significance(significance.paired_seeds(one, list(by), F.col("method") == a, F.col("method") == b, value), list(by))


def iterations(history: DataFrame) -> DataFrame:
    """The iteration rows of a run log: those with t >= 0, t under the name iter; a log with iter already is as it is."""
    return history.where("t >= 0").withColumnRenamed("t", "iter") if "t" in history.columns else history


def datasets_with(df: DataFrame, names: Sequence[str], by: str = "dataset") -> DataFrame:
    """The values of `by` whose rows have all these methods."""
    found = df.where(F.col("method").isin(*names)).groupBy(by).agg(F.count_distinct("method").alias("n"))
    return found.where(F.col("n") == len(set(names))).select(by)


def number(value: str | Column, fmt: str) -> Column:
    """A number as text by a C format: `%.Nf`, `%.Ne`, or `%.Ng`, which is the fixed form for exponents from -4 to N - 1 and the other beyond, both without zeros at the end. Null and NaN are --. Ties of the last digit round up, as the number's shortest text has them."""
    x = F.col(value) if isinstance(value, str) else value
    if fmt[-1] != "g":
        shown = F.format_string(fmt, x)
    else:
        digits = max(int(fmt[2:-1]), 1)
        parts = F.split(F.format_string(f"%.{digits - 1}e", x), "e")
        exponent = parts[1].cast("int")
        plain = F.coalesce(*(F.when(exponent == e, F.format_string(f"%.{digits - 1 - e}f", x)) for e in range(-4, digits)))
        bare = lambda c: F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, r"\.?0+$", "")).otherwise(c)
        shown = F.coalesce(bare(plain), F.concat(bare(parts[0]), F.lit("e"), parts[1]))
    return F.when(x.isNull() | F.isnan(x), F.lit("--")).otherwise(shown)


# Formats of mean and deviation by metric.
FORMATS = {"sse_x": "%.3e", "f1": "%.3f", "collapse_rate": "%.3f"}


def formatted(summary_: DataFrame, by: Sequence[str], values: Sequence[str], between: str = "±", formats: Mapping[str, str] = FORMATS) -> DataFrame:
    """A summary's means and deviations as texts, by default errors in scientific notation; -- for what is missing."""
    of = lambda v: formats.get(v, "%.3f")
    text = lambda v: F.when(F.col(f"{v}_mean").isNull(), F.lit("--")).otherwise(F.concat(number(f"{v}_mean", of(v)), F.lit(between), number(f"{v}_std", of(v))))
    return summary_.select(*by, *(text(v).alias(v) for v in values))
