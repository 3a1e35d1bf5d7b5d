"""The corpus pipeline: documents to packed training sequences, in five stages.

A decision is about a row's id and text, never about its id alone, so that rows which repeat an id keep what is only theirs. Rows without an id are documents like others; where order matters they come last. Columns that the stages don't know pass through, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisefold.llm import kneserney, packing, simhash, substring, toxicity
from noisefold.llm.common import drop_folder, load, new_folder, ship


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows as one column, beside their id and the hash of their text."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"))


def _rows(keyed: DataFrame, docs: DataFrame) -> DataFrame:
    return keyed.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _same(found: DataFrame):
    return F.col("id").eqNullSafe(found["doc_id"]) & (F.col("th") == found["text_hash"])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents whose perplexity exceeds their language's threshold go, and those without any text, which there is nothing to judge or train by. All rows of an equal id and text go or stay together."""
    ship(spark)
    rejected = kneserney.classify(docs, load(spark, sf_dir, "labels")).where("not kept").select("doc_id", "text_hash").distinct()
    return _rows(_keyed(docs).join(rejected, _same(rejected), "left_anti"), docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that score 0.5 or more go; each row is judged by its own text, and null and empty ones are clean."""
    ship(spark)
    crf = toxicity.fit_on(docs, load(spark, sf_dir, "labels"))
    return docs.where(toxicity.text_score(spark, crf)(F.col("text")) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near copies the first document by id and text hash stays, as one row: of rows with equal id and text, the one with the smallest hash of all columns. Null and empty texts are one group."""
    ship(spark)
    kept = simhash.near_duplicates(docs).where("leads").groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"))
    found = _keyed(docs).join(kept, _same(kept)).select("row", "id", "th", "times")
    once = found.where("times = 1").select("row")
    repeated = found.where("times > 1").groupBy("id", "th").agg(F.min_by("row", F.xxhash64("row.*")).alias("row")).select("row")
    return _rows(once.unionByName(repeated), docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: passages that an earlier document (by id, then text hash) has too are cut out of the text; n_chars, where there is one, follows. A document that is left without a word goes; one that had none before stays."""
    ship(spark)
    return substring.remove_passages(docs, substring.passages(docs), length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the pieces of the packed sequences; a null or empty text is its end token."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("toxicity", clean),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", passages),
    ("packing", pack),
]

# The stages hash, train and align in ways that SQL has no functions for; tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = new_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before:
            drop_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
