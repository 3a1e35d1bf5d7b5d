"""Operator 13: source divergence audit.

Which sources of a language use its vocabulary unlike the others, and by which terms: plain relational steps. Terms are exploded from regular-expression matches and counted by (lang, source, term) with map-side combining; groups are crossed with their language's kept vocabulary, so that terms a source lacks count as zeros; smoothed shares are compared by a self-join on language and term, summed and ranked by windows.

One scan of the texts gives everything: each document's terms are exploded together with its distinct ones, for counts and document counts. A language is a hot key by nature, so nothing is joined or sorted by it alone: groups meet the vocabulary under (lang, salt of the term), pairs are made under (lang, term), where each source has one row, and sums and ten best terms are formed before they are shuffled. The number of result rows grows with the square of a language's sources, as the report lists every pair; rows of pairs grow with that times the vocabulary and are summed where they are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from noisefold.llm.common import cut

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS, TOP_TERMS = 10, 10
UNIT = 1_000_000_000
SALTS = 64
_WIDE = T.DecimalType(38, 0)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per (lang, source, term): n occurrences, in docs rows. A row with a null term for groups that have documents without any term."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = docs.select(read(lang_col).alias("lang"), read(source_col).alias("source"), F.regexp_extract_all(F.translate(read(text_col), UPPER, LOWER), F.lit(TERM), F.lit(0)).alias("terms"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("once"), F.col("terms")), F.struct(F.lit(1).alias("once"), F.array_distinct("terms").alias("terms"))))
    rows = own.select("lang", "source", both.alias("b")).select("lang", "source", "b.once", F.explode_outer("b.terms").alias("term"))
    return rows.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)): exact, as the product is a wide decimal and div is integral."""
    wide = lambda c: c.cast(_WIDE)
    return 1 + F.call_function("div", (wide(count + 2) * F.lit(UNIT).cast(T.DecimalType(10, 0))), wide(total + 2 * kept))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most UNIT + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of the parts `pair` (item: another source of the language, every one) and `term` (item: a term that the source uses more than its language, the top_terms of largest value).

    Null texts, languages and sources read as empty strings. A term is kept in a language if min_docs of its rows have it. A source whose documents have no kept term has zeros; in a language without kept terms all pairs have the value 0 and there are no terms. Ties go to the smaller item in UTF-8 order. Rows that repeat a document count again. Texts are read whole; other columns are ignored; an empty table gives no rows.
    """
    counts, _ = cut(term_counts(docs, text_col, lang_col, source_col), "terms", free=False)
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term", "n_lang")
    kept, _ = cut(kept, "kept", free=False)
    langs = kept.groupBy("lang").agg(F.sum("n_lang").alias("total_lang"), F.count("*").alias("v"))
    own = counts.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "n")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups, _ = cut(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("total_lang", F.lit(0)).alias("total_lang"), F.coalesce("v", F.lit(0)).alias("v")), "groups", free=False)

    # Every group with every kept term of its language, and zeros where it has none.
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    zeros = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    zeros = zeros.select("lang", "source", "term", F.lit(0).cast("long").alias("n"), "n_lang", "total", "total_lang", "v")
    found = own.select("lang", "source", "term", "n", *(F.lit(None).cast("long").alias(c) for c in ("n_lang", "total", "total_lang", "v")))
    dense = zeros.unionByName(found).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("n_lang", "total", "total_lang", "v")))
    dense = dense.select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("n_lang"), F.col("total_lang"), F.col("v")).alias("q"))
    dense, _ = cut(dense, "shares", free=False)

    # Each unordered pair once; both orders in the report.
    a = dense.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"))
    b = dense.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"))
    sums = a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(distance(F.col("pa"), F.col("pb"))).alias("value"))
    x = groups.select("lang", F.col("source").alias("a"), F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int").alias("salt"))
    y = salted.select("lang", F.col("source").alias("b"), "salt")
    pairs = x.join(y, ["lang", "salt"]).where("a < b").join(sums, ["lang", "a", "b"], "left").select("lang", "a", "b", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(best))
    terms = dense.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    return pairs.unionByName(terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms))
