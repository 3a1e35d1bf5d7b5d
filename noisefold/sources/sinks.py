"""Writers of results."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisefold.sources import runs


def upsert_results(new: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Merge new rows into a Parquet results table: rewritten under a new name, then the names change places, so a failure leaves the old table."""
    spark = new.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + "_new", path + "_old"))
    fs = target.getFileSystem(conf)
    merged = runs.append_results(spark.read.parquet(path), new, keys) if fs.exists(target) else new
    merged.write.mode("overwrite").parquet(path + "_new")
    if fs.exists(target):
        fs.delete(old, True)
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def write_history(history: DataFrame, path: str, run: Mapping[str, object]) -> None:
    """Append a run's history, partitioned by the run's whole key."""
    out = history
    for name, value in run.items():
        out = out.withColumn(name, F.lit(value))
    out.write.mode("append").partitionBy(*run).parquet(path)


def write_run_logs(rows: DataFrame, folder: str, header: str = "header", order: str = "line") -> DataFrame:
    """A log file {dataset}/{method}/eps{e}_seed{s}.csv for each run of rows (dataset, method, eps, seed, `header`, `order`, cells by name), with the columns that the run's header (names joined by commas, the same in all its rows) lists; a row with the path for each. A run is written by one task, which gets it sorted and holds a batch of it at a time; a repeated attempt writes the same file."""
    keys = ["dataset", "method", "eps", "seed"]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        now, f = None, None
        try:
            for pdf in batches:
                for run, part in pdf.groupby(keys, sort=False, dropna=False):
                    dataset, method, eps, seed = run
                    name, names = f"{dataset}/{method}/eps{float(eps)!r}_seed{seed}.csv", part[header].iloc[0].split(",")
                    begins = name != now
                    if begins:
                        if f is not None:
                            f.close()
                            yield pd.DataFrame({"path": [f"{folder}/{now}"]})
                        where.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
                        now, f = name, where.open_output_stream(f"{base}/{name}")
                    f.write(part[names].to_csv(index=False, header=begins).encode())
        finally:
            if f is not None:
                f.close()
        if f is not None:
            yield pd.DataFrame({"path": [f"{folder}/{now}"]})

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(write, "path string")


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; quotes inside values are doubled, as most readers expect."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(value: object, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True)


def latex_rows(df: DataFrame, cells: Sequence[str]) -> DataFrame:
    r"""A table's rows as lines `a & b & c \\`, nulls as --."""
    return df.select(F.concat(F.concat_ws(" & ", *(F.coalesce(F.col(c).cast("string"), F.lit("--")) for c in cells)), F.lit(" \\\\")).alias("line"))


def write_latex(df: DataFrame, cells: Sequence[str], path: str) -> None:
    """A report table (a few dozen rows) as a tabular environment."""
    body = [r["line"] for r in latex_rows(df, cells).collect()]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([f"\\begin{{tabular}}{{{'l' * len(cells)}}}", " & ".join(cells) + " \\\\", *body, "\\end{tabular}", ""]))


def write_markdown(df: DataFrame, path: str) -> None:
    rows = df.collect()
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows), ""]))
