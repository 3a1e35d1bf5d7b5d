"""Text formats of feature matrices: white-space rows and sparse class;value index:value rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noisefold.sources import lines


def whitespace_rows(rows: DataFrame, value: str = "value", into: str = "features") -> DataFrame:
    """Numbers split at white space as an array of doubles; blank lines go."""
    text = F.trim(F.regexp_replace(value, r"\s+", " "))
    return rows.where(text != "").withColumn(into, F.transform(F.split(text, " "), lambda x: x.cast("double"))).drop(value)


def split_matrix(spark: SparkSession, root: str, parts: tuple[str, ...] = ("train", "test"), shape: tuple[int, int] | None = (10299, 561)) -> DataFrame:
    """row_id, features, label of {root}/{part}/X_{part}.txt and y_{part}.txt, parts in order; labels become zero based. A frame of another shape is an error."""
    out = None
    for n, part in enumerate(parts):
        x = whitespace_rows(lines.numbered(spark, f"{root}/{part}/X_{part}.txt").select("line", "value"))
        y = lines.numbered(spark, f"{root}/{part}/y_{part}.txt").select("line", (F.trim("value").cast("int") - 1).alias("label"))
        both = x.join(y, "line").select((F.lit(n) * (1 << 40) + F.col("line")).alias("row_id"), "features", "label")
        out = both if out is None else out.unionByName(both)
    if shape:
        got = out.agg(F.count("*").alias("n"), F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi")).first()
        if (got["n"], got["lo"], got["hi"]) != (shape[0], shape[1], shape[1]):
            raise ValueError(f"expected {shape}, found {tuple(got)}")
    return out


def _dense(index: Column, number: Column, width: int) -> Column:
    """Arrays of `width` doubles with each number at its index (from 1); others are 0. Null indices are left out, null numbers are 0, of repeated indices the last counts."""

    @F.arrow_udf("array<double>")
    def dense(index: pa.Array, number: pa.Array) -> pa.Array:
        rows = len(index)
        out, row = np.zeros((rows, width)), np.repeat(np.arange(rows), pc.list_value_length(index).to_numpy())
        at = pc.fill_null(index.flatten(), 0).to_numpy(zero_copy_only=False)
        out[row[at > 0], at[at > 0] - 1] = number.flatten().to_numpy(zero_copy_only=False)[at > 0]
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(out.ravel()))

    return dense(index, number)


def sparse_rows(rows: DataFrame, width: int = 128, value: str = "value") -> DataFrame:
    """label (zero based), concentration and dense features of lines `class;concentration index:value ...`.

    Blank lines go, tokens without a colon are skipped, missing indices are 0 and of repeated ones the last counts; a line without a semicolon or an index outside 1..width is an error when the row is read.
    """
    text = F.trim(value)
    tokens = F.split(text, r"\s+")
    head = F.split(F.element_at(tokens, 1), ";")
    entry = lambda t: F.struct(F.element_at(F.split(t, ":"), 1).cast("int").alias("i"), F.element_at(F.split(t, ":"), 2).cast("double").alias("x"))
    parsed = F.transform(F.filter(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: F.instr(t, ":") > 0), entry)
    held = rows.where(text != "").withColumn("_parsed", parsed)
    error = lambda what: F.raise_error(F.concat(F.lit(what), text)).cast(T.ArrayType(T.IntegerType()))
    index = F.transform("_parsed", lambda e: e["i"])
    checked = F.when(F.size(head) < 2, error("no class;concentration: ")).when(F.exists(index, lambda i: ~i.between(1, width)), error("index out of range: ")).otherwise(index)
    dense = _dense(checked, F.transform("_parsed", lambda e: F.coalesce(e["x"], F.lit(0.0))), width)
    return held.withColumn("features", dense).drop("_parsed").withColumn("label", F.element_at(head, 1).cast("int") - 1).withColumn("concentration", F.try_element_at(head, F.lit(2)).cast("double")).drop(value)


def sparse_files(spark: SparkSession, glob: str, width: int = 128) -> DataFrame:
    """sparse_rows of many files; batch_id is the file's place in the lexicographic order of names, from 1."""
    from pyspark.sql import Window

    rows = spark.read.text(glob).select("value", F.col("_metadata.file_path").alias("path"))
    files = rows.select("path").distinct().withColumn("batch_id", F.row_number().over(Window.orderBy("path")))
    return sparse_rows(rows.join(F.broadcast(files), "path").drop("path"), width)


def table_cells(rows: DataFrame, least: int = 12, value: str = "value") -> DataFrame:
    """Cells of typeset table rows: lines split at &, at least `least` cells, none that begin with a backslash, second cell a number (eps)."""
    text = F.trim(F.regexp_replace(value, r"\\\\\s*$", ""))
    cells = F.transform(F.split(text, "&"), lambda c: F.trim(c))
    out = rows.where(~F.trim(value).startswith("\\")).withColumn("cells", cells).where(F.size("cells") >= least)
    return out.withColumn("eps", F.expr("try_cast(element_at(cells, 2) AS double)")).where("eps is not null").drop(value)
