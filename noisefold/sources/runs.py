"""Results of earlier runs: directories of run logs, and tables with columns under other names."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noisefold.sources import lines


def find_column(df: DataFrame, options: Sequence[str]) -> str | None:
    """The first option that df has, compared without case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[o.lower()] for o in options if o.lower() in have), None)


# Names under which earlier results have their columns.
ALIASES = {
    "dataset": ("dataset", "data", "ds"),
    "method": ("method", "algo", "algorithm"),
    "eps": ("eps", "eps_tot", "epsilon"),
    "seed": ("seed", "run_seed"),
    "macro_f1": ("macro_f1", "f1", "f1_macro"),
    "sse": ("sse", "sse_x"),
    "runtime": ("runtime", "runtime_sec", "runtime_seconds", "runtime_ms_total"),
}


def with_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """df under the common names; a name without a column is an error. Milliseconds become seconds."""
    found = {name: find_column(df, options) for name, options in aliases.items()}
    if missing := [n for n, c in found.items() if c is None]:
        raise ValueError(f"no column for {missing}")
    unit = lambda n, c: F.col(c) / 1000 if n == "runtime" and c.lower().startswith("runtime_ms") else F.col(c)
    return df.select(*(unit(n, c).alias(n) for n, c in found.items()))


def canonical(method: str | Column) -> Column:
    """A method name's key: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.col(method) if isinstance(method, str) else method), "[^a-z0-9]", "")


def display_names(df: DataFrame, names: Mapping[str, str], method: str = "method") -> DataFrame:
    """df with each method under the name that `names` has for its key (canonical()); others keep theirs. Several keys may have one name."""
    known = df.sparkSession.createDataFrame(list(names.items()), "_key string, _shown string")  # the caller's mapping
    joined = df.withColumn("_key", canonical(method)).join(F.broadcast(known), "_key", "left")
    return joined.withColumn(method, F.coalesce("_shown", method)).select(*df.columns)


def normal_path(path: str) -> str:
    """A path with one separator between its parts and without . and .. where they can be resolved."""
    import posixpath

    return posixpath.normpath(path)


def runtime_seconds(df: DataFrame) -> Column:
    """Seconds from the first of the known runtime columns that exists, even where it is null."""
    for name, factor in (("runtime_sec", 1.0), ("runtime_ms_total", 1e-3), ("runtime_ms", 1e-3), ("runtime", 1.0)):
        if name in df.columns:
            return F.col(name).cast("double") * factor
    return F.lit(None).cast("double")


def final_row(df: DataFrame, by: Sequence[str], order: str, metrics: Sequence[str]) -> DataFrame:
    """Each run's summary row: the last with t < 0, else the last with iter < 0, else the last with all metrics, else the last."""
    negative = lambda c: F.coalesce(F.col(c) < 0, F.lit(False)) if c in df.columns else F.lit(False)
    whole = F.lit(True)
    for m in metrics:
        whole = whole & F.col(m).isNotNull()
    rank = F.when(negative("t"), 3).when(negative("iter"), 2).when(whole, 1).otherwise(0)
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(rank.alias("rank"), F.col(order))).alias("_x")).select(*by, "_x.*")


# Columns that logs may have, the metrics whose presence makes a row whole, and texts that stand for a missing value.
LOG_COLUMNS = "t int, iter int, macro_f1 double, sse double, sse_x double, non_empty_k double, non_empty_k_final double, max_cluster_ratio double, max_cluster_ratio_final double, runtime_sec double, runtime_ms_total double, runtime_ms double, runtime double"
WHOLE = ("macro_f1", "sse", "non_empty_k", "max_cluster_ratio")
MISSING = ("", "nan", "na", "n/a", "null", "none")
LOG_PATH = r"([^/]+)/([^/]+)/eps([0-9.]+)_seed([0-9]+)\.csv$"


def run_logs(spark: SparkSession, glob: str, methods: Mapping[str, str] | None = None, columns: str = LOG_COLUMNS) -> DataFrame:
    """Logs {dataset}/{method}/eps{e}_seed{s}.csv as rows dataset, method, eps, seed (from the path), line, header, and `columns` with their types.

    Each file's own first line names its columns, whatever their order, number and case of the others' are; header has those names. A column that a file lacks, a missing value and one that isn't of the type are null. Lines count from 0 in each file, the header being 0; blank ones are left out. Files whose names aren't of that form are skipped, and with methods (name in the path to name in the result) those of other methods. Values may be quoted but not hold line ends. An empty file has no rows. Files are read in splits: their headers are a row each, joined by path.
    """
    rows = lines.numbered(spark, glob)
    part = lambda n: F.regexp_extract("path", LOG_PATH, n)
    # What a path and a header say is worked out once a file. The path is bound to the line's number, as conditions on the path alone are moved below the numbering's join and run on each line.
    heads = rows.where("line = 0").withColumn("path", F.when(F.col("line") == 0, F.col("path"))).where(F.col("path").rlike(LOG_PATH)).select("path", F.regexp_replace("value", "^\ufeff", "").alias("_head"))
    heads = heads.select("path", "_head", F.url_decode(F.regexp_replace(part(1), r"\+", "%2B")).alias("dataset"), F.url_decode(F.regexp_replace(part(2), r"\+", "%2B")).alias("method"), part(3).try_cast("double").alias("eps"), part(4).try_cast("int").alias("seed")).where("eps is not null and seed is not null")
    if methods is not None:
        names = spark.createDataFrame(list(methods.items()), "method string, _name string")  # the caller's mapping
        heads = heads.join(F.broadcast(names), "method").withColumn("method", F.col("_name")).drop("_name")
    heads = heads.persist()  # a row a file
    width = heads.agg(F.max(F.size(F.split("_head", ",", -1)))).first()[0] or 1
    cells = lambda c: F.from_csv(c, ", ".join(f"_{i} string" for i in range(width)), {"mode": "PERMISSIVE"})
    # A lambda's argument is evaluated once, so a line is parsed once for all its cells.
    listed = lambda c: F.transform(F.array(cells(c)), lambda s: F.array(*(F.trim(s[f"_{i}"]) for i in range(width))))[0]
    fields = [f.split() for f in columns.split(", ")]
    heads = heads.select("path", "dataset", "method", "eps", "seed", F.filter(listed("_head"), lambda x: x.isNotNull()).alias("header"))
    places = heads.select("*", *(F.array_position("header", F.lit(n)).cast("int").alias(f"_at_{n}") for n, _ in fields))
    body = rows.where("line > 0").where(F.trim("value") != "").select("path", "line", listed("value").alias("_cells")).join(places, "path")

    def value(name: str, kind: str) -> Column:
        text = F.try_element_at("_cells", F.when(F.col(f"_at_{name}") > 0, F.col(f"_at_{name}")))
        real = F.when(~F.lower(text).isin(*MISSING), text)
        return (real.try_cast("double").try_cast(kind) if kind in ("int", "long", "bigint") else real.try_cast(kind)).alias(name)

    return body.select("path", "dataset", "method", "eps", "seed", "line", "header", *(value(*f) for f in fields))


def collect_runs(spark: SparkSession, glob: str, methods: Mapping[str, str] | None = None) -> DataFrame:
    """The tidy table of a directory of run logs: dataset, method, eps_tot, seed, macro_f1, sse, non_empty_k, max_cluster_ratio, runtime_sec, a row per file that has any.

    A file's row is its last with t < 0, else its last with iter < 0, else its last in which those of WHOLE that its header names (one at least) are all there, else its last. sse, non_empty_k and max_cluster_ratio are read from sse_x and the _final columns where the header doesn't name them; the time is that of the first of runtime_sec, runtime_ms_total, runtime_ms and runtime that it names.
    """
    logs = run_logs(spark, glob, methods)
    has = lambda c: F.array_contains("header", F.lit(c))
    negative = lambda c: F.coalesce(F.col(c) < 0, F.lit(False))
    whole, some = F.lit(True), F.lit(False)
    for m in WHOLE:
        whole, some = whole & (~has(m) | F.col(m).isNotNull()), some | has(m)
    rank = F.when(negative("t"), 3).when(negative("iter"), 2).when(whole & some, 1).otherwise(0)
    read = lambda a, b: F.when(has(a), F.col(a)).otherwise(F.col(b))
    seconds = F.when(has("runtime_sec"), F.col("runtime_sec")).when(has("runtime_ms_total"), F.col("runtime_ms_total") / 1000).when(has("runtime_ms"), F.col("runtime_ms") / 1000).otherwise(F.col("runtime"))
    kept = F.struct("macro_f1", read("sse", "sse_x").alias("sse"), read("non_empty_k", "non_empty_k_final").alias("non_empty_k"), read("max_cluster_ratio", "max_cluster_ratio_final").alias("max_cluster_ratio"), seconds.alias("runtime_sec"))
    last = logs.groupBy("path", "dataset", "method", "eps", "seed").agg(F.max_by(kept, F.struct(rank, F.col("line"))).alias("_x"))
    return last.select("dataset", "method", F.col("eps").alias("eps_tot"), "seed", "_x.*")


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the last in order. An aggregate, so rows combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_x")).select(*keys, "_x.*")


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_x")).select(*keys, "_x.*")


def append_results(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old and new results as one table, columns by name, of equal keys the newest row."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, "_seq").drop("_seq")


def missing_tasks(tasks: DataFrame, history: DataFrame, keys: Sequence[str] = ("dataset", "method", "eps", "seed")) -> DataFrame:
    """Tasks whose results the history doesn't have."""
    return tasks.join(history.select(*keys).distinct(), list(keys), "left_anti")


def config_hash(config: Mapping) -> str:
    """First 12 hex digits of the SHA-1 of the sorted compact JSON."""
    import hashlib

    return hashlib.sha1(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def read_config(path: str) -> dict:
    """A JSON configuration, or YAML where that library is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(f)
        return json.load(f)
