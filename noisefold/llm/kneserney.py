"""Operator 7: a quality classifier by an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on trusted texts (label quality = 1) and gives each document its perplexity; a document whose perplexity exceeds a quantile of the trusted documents' in its language is rejected. Units are UTF-16 code units, so an n-gram of up to four is one long, and its context and its suffix are shifts and masks of it.

Counts are gathered in scan order and summed in each task before they are shuffled. Counts, contexts and continuation counts are tables sharded by n-gram; the n-grams that occur are joined to them level by level. Documents are then dealt to blocks by hash of their id, so no block holds a hot source; each block asks for its own distinct n-grams by a join and gets back their log-probabilities only. Nothing of the model is broadcast or collected.

Blocks are of two folds, and each fold's documents are scored by the model of the other fold's trusted texts. So no text is scored by counts that it is part of, and trusted and other documents compare fairly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisefold.llm.common import cut

ORDER = 4
QUANTILE = 0.99
_PAD = "￾"  # before a text; never in one that is valid
_UNITS = 1 << 16


def codes(text: str, order: int = ORDER) -> np.ndarray:
    """The text's n-grams, one for each UTF-16 unit, as integers; the first ones begin with padding."""
    units = np.frombuffer((_PAD * (order - 1) + text).encode("utf-16-le", "surrogatepass"), "<u2").astype(np.int64)
    n = len(units) - order + 1
    out = np.zeros(n, np.int64)
    for k in range(order):
        out = (out << 16) | units[k : k + n]
    return out


def _batches(texts: list[str], chars: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, to; their n-grams; the row of each n-gram. Long texts are a batch of their own."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= chars):
            size += len(texts[to])
            to += 1
        each = [codes(t) if t else np.zeros(0, np.int64) for t in texts[at:to]]
        yield at, to, np.concatenate(each), np.repeat(np.arange(to - at), list(map(len, each)))
        at = to


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, where = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
    return g, np.bincount(where, np.concatenate([x[1] for x in held]), len(g)).astype(np.int64)


def _counted(texts: list[str], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of texts and their counts, each text's n-grams counted `of` times (0 or 1)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for at, to, g, row in _batches(texts):
        u, where = np.unique(g, return_inverse=True)
        held.append((u, np.bincount(where, of[at:to][row], len(u))))
        if len(held) >= 16:
            held = [_merged(held)]
    return _merged(held) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def count_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every n-gram of a task's documents with its count in the trusted ones, by fold."""
    held: list[list] = [[], []]
    for pdf in batches:
        for fold in (0, 1):
            some = pdf[pdf["fold"] == fold]
            if len(some):
                held[fold].append(_counted([t or "" for t in some["_text"]], some["trusted"].to_numpy(float)))
            if len(held[fold]) >= 32:
                held[fold] = [_merged(held[fold])]
                if len(held[fold][0][0]) > 1 << 21:  # a bound on memory, whatever the script
                    yield _rows(fold, *held[fold].pop())
    for fold in (0, 1):
        if held[fold]:
            yield _rows(fold, *_merged(held[fold]))


def _rows(fold: int, g: np.ndarray, c: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"fold": np.full(len(g), fold, np.int32), "g": g, "c": c.astype(np.int64)})


def ask_block(docs: pd.DataFrame) -> pd.DataFrame:
    """The distinct n-grams of a block's documents."""
    texts = [t or "" for t in docs["_text"]]
    g, _ = _counted(texts, np.ones(len(texts)))
    return pd.DataFrame({"block": np.full(len(g), docs["block"].iloc[0], np.int32), "g": g})


def score_block(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    order = np.argsort(known["g"].to_numpy())
    g, logp = known["g"].to_numpy()[order], known["logp"].to_numpy()[order]
    texts = [t or "" for t in docs["_text"]]
    total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for at, to, own, row in _batches(texts):
        if len(own):
            total[at:to] = np.bincount(row, logp[np.searchsorted(g, own)], to - at)
            n[at:to] = np.bincount(row, minlength=to - at)
    with np.errstate(divide="ignore", invalid="ignore"):
        ppl = pd.array(np.where(n > 0, np.exp(-total / n), 0.0), dtype="Float64")
    ppl[n == 0] = pd.NA
    return pd.DataFrame({"_id": docs["_id"].array, "_th": docs["_th"].array, "lang": docs["lang"].array, "n_units": n, "perplexity": ppl})


def log_probabilities(asked: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(m, g, logp) for each distinct asked (m, g), from the counts (m, g, c) of model m's highest-order n-grams."""
    key = lambda n: F.col("g").bitwiseAND(F.lit((1 << 16 * n) - 1)) if n < 4 else F.col("g")
    context = F.shiftrightunsigned("g", 16)
    levels, want = {order: counts}, {order: asked}
    for n in range(order - 1, 0, -1):
        levels[n] = levels[n + 1].groupBy("m", key(n).alias("g")).agg(F.count("*").alias("c"))
        want[n] = want[n + 1].select("m", key(n).alias("g")).distinct()
    p = want[1].withColumn("p", F.lit(1.0 / _UNITS))
    for n in range(1, order + 1):
        if n > 1:
            p = want[n].withColumn("low", key(n - 1)).join(p.withColumnRenamed("g", "low"), ["m", "low"], "left").drop("low")
        n_of = lambda k: F.sum(F.when(F.col("c") == k, 1.0).otherwise(0.0))
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))  # few counts may lack any of these
        up = [F.coalesce(F.least(F.greatest((F.lit(k) - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))), F.lit(0.1)), F.lit(float(k))), F.lit(0.5 * k)).alias(f"d{k}") for k in (1, 2, 3)]
        discount = levels[n].groupBy("m").agg(*(n_of(k).alias(f"n{k}") for k in (1, 2, 3, 4))).select("m", *up)  # a row for each of the two models
        level = levels[n].join(F.broadcast(discount), "m").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))).select("m", "g", "c", "d")
        of = level.groupBy("m", context.alias("h")).agg(F.sum("c").alias("total"), F.sum("d").alias("held"))
        p = p.join(level, ["m", "g"], "left").withColumn("h", context).join(of, ["m", "h"], "left").select("m", "g", (F.coalesce((F.col("c") - F.col("d")) / F.col("total"), F.lit(0.0)) + F.coalesce(F.col("held") / F.col("total"), F.lit(1.0)) * F.col("p")).alias("p"))
    return p.select("m", "g", F.log("p").alias("logp"))


def perplexities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", block_chars: int = 1 << 24, broadcast_ids: int = 4_000_000) -> DataFrame:
    """_id, _th (hash of the text), lang, n_units, perplexity (null for a text without characters): one row per document.

    Counting goes over the texts in scan order; the trusted ids are broadcast if they are at most broadcast_ids (8 bytes each), else joined by a shuffle. Scoring shuffles the texts once, by block, and Spark reuses that exchange for the blocks' questions and their answers.
    """
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    blocks = 2 * max(1, math.ceil(chars / block_chars / 2))
    own, text = F.col(id_col).cast("long"), F.col(text_col)
    block = F.pmod(F.when(own.isNotNull(), F.xxhash64(own)).otherwise(F.xxhash64(text)), F.lit(blocks)).cast("int")
    mine = docs.select(block.alias("block"), own.alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"), F.col(lang_col).cast("string").alias("lang"))
    trusted = labels.where("quality = 1").select(own.alias("_id")).where("_id is not null").distinct()
    if trusted.count() <= broadcast_ids:
        trusted = F.broadcast(trusted)
    flagged = mine.drop("_th").join(trusted.withColumn("trusted", F.lit(True)), "_id", "left").select(F.col("block").bitwiseAND(F.lit(1)).alias("fold"), "_text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    found, _ = cut(flagged.mapInPandas(count_texts, "fold int, g long, c long").groupBy("fold", "g").agg(F.sum("c").alias("c")), "ngrams")
    other = (1 - F.col("fold")).alias("m")
    logp, _ = cut(log_probabilities(found.select(other, "g"), found.where("c > 0").select(F.col("fold").alias("m"), "g", "c")), "model")
    asked = mine.groupBy("block").applyInPandas(ask_block, "block int, g long").withColumn("m", 1 - F.col("block").bitwiseAND(F.lit(1)))
    answers = asked.join(logp, ["m", "g"]).select("block", "g", "logp")
    return mine.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score_block, "_id long, _th long, lang string, n_units long, perplexity double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_units, perplexity, threshold, kept, text_hash: one row per document.

    threshold is the quantile of the trusted documents' perplexities in the document's language, however few they are; in a language (null is one) without any the threshold is null, which flags its documents, and every text is kept: there is nothing to reject it by. kept is false for null and empty texts (perplexity null). Repeated rows and null ids give rows of their own; null labels are ignored; columns of other names don't matter; an empty table gives no rows.
    """
    scored, _ = cut(perplexities(docs, labels, id_col, text_col, lang_col), "perplexities")
    good = labels.where("quality = 1").select(F.col(id_col).cast("long").alias("_id")).where("_id is not null").distinct()
    base = scored.join(good, "_id", "left_semi").where("perplexity is not null").withColumn("lang", F.coalesce("lang", F.lit("")))
    limits = base.groupBy(F.col("lang").alias("_lang")).agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))  # a row for each language
    scored = scored.join(limits, F.coalesce("lang", F.lit("")) == F.col("_lang"), "left")
    kept = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return scored.select(F.col("_id").alias("doc_id"), "lang", "n_units", "perplexity", "threshold", F.coalesce(kept, F.lit(False)).alias("kept"), F.col("_th").alias("text_hash"))
