"""The registry of the clustering and report queries, and for each that SQL can express the SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisefold.functions import rng, schedules, vectors
from noisefold.operators import alternatives, graphs, kmeans, metrics, noise, prep, reduction, seeding, significance, stats
from noisefold.plans import methods, reports
from noisefold.sources import runs, sinks, storage, synthetic, tables, text
from noisefold.streaming import batches

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Register a query; doubles are rounded to `digits` in it and, by the columns of its SQL that are marked ~, there too."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*((F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))

        _queries[f.__name__] = run
        if sql:
            _sql[f.__name__] = sql.replace("~(", f"rounded{digits}(")
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    """SQL with the rounding written out."""
    import re

    def plain(s: str) -> str:
        while m := re.search(r"rounded(\d)\(", s):
            depth, i = 1, m.end()
            while depth:
                depth += {"(": 1, ")": -1}.get(s[i], 0)
                i += 1
            s = f"{s[: m.start()]}(round({s[m.end() : i - 1]}, {m[1]}) + 0.0){s[i:]}"
        return s

    return {k: plain(v) for k, v in _sql.items()}


# ---- relations in SQL ----

R = """r AS (SELECT event_id AS run_id, (['har', 'gas'])[CAST(user_id % 2 + 1 AS INT)] AS dataset, event_type AS method,
  CAST(([0.5, 0.8, 1.0, 1.5])[CAST(user_id % 4 + 1 AS INT)] AS DOUBLE) AS eps_tot, CAST(event_id % 20 AS INT) AS seed, CAST(([6, 10])[CAST(event_id % 2 + 1 AS INT)] AS INT) AS k,
  CAST(([64, 128, 256])[CAST(event_id % 3 + 1 AS INT)] AS INT) AS d, CAST(([1000, 5000, 10000])[CAST(user_id % 3 + 1 AS INT)] AS INT) AS n,
  CAST(([0.05, 0.1, 0.2])[CAST(event_id % 3 + 1 AS INT)] AS DOUBLE) AS eps_proxy_ratio, value / 500 AS f1, value * 37 AS sse_x, value / 400 AS ari, value / 450 AS nmi, value * 3 + 10 AS runtime_ms_total,
  CAST(CAST(floor(value) AS BIGINT) % 7 AS INT) AS non_empty_k_final, value / 600 + 0.1 AS max_cluster_ratio_final FROM events)"""
H = """h AS (SELECT l_orderkey AS run_id, l_linenumber - 1 AS iter, l_partkey AS tie, l_discount + 0.01 AS eps_t, l_tax + 0.001 AS drift, l_extendedprice / 1000 AS noise_scale_sums,
  CAST(CAST(l_quantity AS BIGINT) % 7 AS INT) AS non_empty_k, l_quantity / 50 AS max_cluster_ratio, l_quantity / 5000 AS min_cluster_ratio FROM lineitem)"""
E = """e AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
el AS (SELECT row_id, label, CAST(unnest(range(len(x))) AS INT) AS dim, unnest(x) AS v FROM e)"""
L = """l AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_quantity AS a, l_extendedprice AS b, l_discount AS c, l_tax AS d,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label FROM lineitem)"""


def _u(*parts: str) -> str:
    """A keyed draw in SQL; parts are SQL expressions of text."""
    return "((CAST('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


def _q(x: object) -> str:
    return f"'{x}'"


def _v(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def _laplace(scale: str, *parts: str) -> str:
    u = f"({_u(*parts)} - 0.5)"
    return f"(-({scale}) * sign({u}) * ln(1 - 2 * abs({u})))"


def _normal(*parts: str) -> str:
    return f"(sqrt(-2 * ln({_u(*parts, _q('a'))})) * cos(2 * pi() * {_u(*parts, _q('b'))}))"


def _r(spark: SparkSession, d: str) -> DataFrame:
    return tables.results_view(spark, d)


def _h(spark: SparkSession, d: str) -> DataFrame:
    return tables.history_view(spark, d)


def _e(spark: SparkSession, d: str) -> DataFrame:
    return tables.embedding_features(spark, d)


def _l(spark: SparkSession, d: str) -> DataFrame:
    return tables.lineitem_features(spark, d)


def _first_rows(df: DataFrame, k: int) -> np.ndarray:
    return np.array([r["features"] for r in df.orderBy("row_id").limit(k).collect()], float)


# ---- sources and sinks ----


@query(f"WITH {E} SELECT row_id, count(*) AS n, ~(sum(v)) AS total FROM el GROUP BY row_id", 4)
def s1_whitespace_rows(spark, d):
    lines = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.concat(F.lit("  "), F.array_join(F.transform("embedding", lambda x: x.cast("string")), "   ")).alias("value"))
    return text.whitespace_rows(lines).select("row_id", F.size("features").cast("long").alias("n"), F.aggregate("features", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS label, ~(l_extendedprice) AS concentration, ~(l_quantity) AS f1, ~(0.0) AS f2, ~(l_discount) AS f5, ~(l_tax) AS f128 FROM lineitem")
def s2_sparse_rows(spark, d):
    l = tables.table(spark, d, "lineitem")  # noqa: E741
    s = lambda c: F.col(c).cast("string")
    lines = l.select("l_orderkey", "l_linenumber", F.concat(s("l_linenumber"), F.lit(";"), s("l_extendedprice"), F.lit(" 5:9 1:"), s("l_quantity"), F.lit(" junk 5:"), s("l_discount"), F.lit("  128:"), s("l_tax")).alias("value"))
    at = lambda i: F.element_at("features", i).alias(f"f{i}")
    return text.sparse_rows(lines).select("l_orderkey", "l_linenumber", "label", "concentration", at(1), at(2), at(5), at(128))


_BLOBS = "b AS (SELECT CAST(range AS BIGINT) AS row_id, CASE WHEN range < 60 THEN 0 WHEN range < 180 THEN 1 ELSE 2 END AS label FROM range(400)), dims AS (SELECT CAST(range AS INT) AS j FROM range(5))"


@query(f"WITH {_BLOBS} SELECT row_id, label, j AS dim, ~({_u(_q(3), _q('centre'), _v('label'), _v('j'))} * 20 - 10 + 0.5 * {_normal(_q(3), _q('point'), _v('row_id'), _v('j'))}) AS x FROM b, dims")
def s3_blobs(spark, d):
    return synthetic.blobs(spark, 400, 5, 3, seed=3, given=[0.15, 0.3, 0.55], deviation=0.5).select("row_id", "label", F.posexplode("features").alias("dim", "x"))


@query(f"WITH b AS (SELECT CAST(range AS BIGINT) AS row_id FROM range(603)), s AS (SELECT row_id, CASE WHEN row_id < 201 THEN 0 WHEN row_id < 402 THEN 1 ELSE 2 END AS label, CAST(ntile(7) OVER (ORDER BY {_u(_q(0), _q('order'), _v('row_id'))}, row_id) - 1 AS INT) AS batch_id FROM b) SELECT batch_id, label, count(*) AS n FROM s GROUP BY ALL")
def s4_stream(spark, d):
    return synthetic.stream(spark, 603, 2, 3, 7).groupBy("batch_id", "label").agg(F.count("*").alias("n"))


@query(f"WITH {H}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN iter < 1 THEN 2 ELSE 1 END DESC, iter DESC, tie DESC, eps_t DESC, drift DESC) AS p FROM h) SELECT run_id, iter, tie, ~(eps_t) AS eps_t, ~(drift) AS drift FROM o WHERE p = 1")
def s7_final_rows(spark, d):
    h = _h(spark, d).select("run_id", (F.col("iter") - 1).alias("iter"), "tie", "eps_t", "drift", F.struct("iter", "tie", "eps_t", "drift").alias("line"))
    return runs.final_row(h, ["run_id"], "line", ["drift"]).select("run_id", (F.col("iter") + 1).alias("iter"), "tie", "eps_t", "drift")


@query(f"WITH {R}, o AS (SELECT dataset, method, eps_tot, seed, avg(f1) AS f1 FROM r GROUP BY ALL) SELECT dataset, method, eps_tot, seed, ~(CASE WHEN seed >= 10 THEN f1 + 1 ELSE f1 END) AS f1 FROM o")
def k1_append_results(spark, d):
    one = _r(spark, d).groupBy("dataset", "method", "eps_tot", "seed").agg(F.avg("f1").alias("f1"))
    return runs.append_results(one, one.where("seed >= 10").withColumn("f1", F.col("f1") + 1), ["dataset", "method", "eps_tot", "seed"])


@query(f"WITH {R} SELECT dataset, method, ~(eps_tot) AS eps, seed, ~(f1) AS macro_f1, ~(sse_x) AS sse, ~(runtime_ms_total / 1000) AS runtime FROM r")
def s8_s9_aliased_runs(spark, d):
    return runs.with_aliases(_r(spark, d).withColumnRenamed("f1", "F1_Macro").withColumnRenamed("dataset", "Data").withColumnRenamed("method", "Algorithm"))


@query("SELECT p_partkey, p_brand AS first, ~(CAST(p_size AS DOUBLE)) AS eps, CAST(13 AS INT) AS n FROM part WHERE p_size % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 3 <> 0")
def s10_table_cells(spark, d):
    p = tables.table(spark, d, "part")
    rule = F.when(F.col("p_partkey") % 5 == 0, "\\midrule ").otherwise("")
    eps = F.when(F.col("p_size") % 7 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    rest = F.when(F.col("p_partkey") % 3 == 0, "1 & 2").otherwise(" & ".join(["0.5"] * 11))
    lines = p.select("p_partkey", F.concat(rule, "p_brand", F.lit(" & "), eps, F.lit(" & "), rest, F.lit(" \\\\")).alias("value"))
    return text.table_cells(lines).select("p_partkey", F.col("cells")[0].alias("first"), "eps", F.size("cells").alias("n"))


@query("SELECT n_name || ' & ' || CAST(n_nationkey AS VARCHAR) || ' & ' || CASE WHEN n_regionkey = 2 THEN '--' ELSE CAST(n_regionkey AS VARCHAR) END || ' \\\\' AS line FROM nation")
def k5_latex_rows(spark, d):
    n = tables.table(spark, d, "nation").withColumn("n_regionkey", F.when(F.col("n_regionkey") != 2, F.col("n_regionkey")))
    return sinks.latex_rows(n, ["n_name", "n_nationkey", "n_regionkey"])


# ---- preparation ----


@query(f"WITH {E}, s AS (SELECT dim, avg(v) AS m, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS sd FROM el GROUP BY dim) SELECT row_id, dim, ~(greatest(-3, least(3, (v - m) / sd))) AS x FROM el JOIN s USING (dim)", 5)
def p1_standardise(spark, d):
    return prep.standardise(_e(spark, d)).select("row_id", F.posexplode("features").alias("dim", "x"))


_NORM = "sqrt(a * a + b * b + c * c + d * d)"


@query(f"WITH {L}, n AS (SELECT *, least(1, 100 / greatest({_NORM}, 1e-12)) AS f FROM l) SELECT row_id, ~(a * f) AS x0, ~(b * f) AS x1, ~(c * f) AS x2, ~(d * f) AS x3 FROM n")
def p2_row_clip(spark, d):
    return prep.row_clip(_l(spark, d), 100.0).select("row_id", *(F.col("features")[i].alias(f"x{i}") for i in range(4)))


@query(f"WITH {L} SELECT row_id, ~(a) AS x0, ~(b) AS x1 FROM l")
def p3_prefix(spark, d):
    return noise.prefix_columns(_l(spark, d), 2).select("row_id", F.col("features")[0].alias("x0"), F.col("features")[1].alias("x1"))


@query(f"WITH {L} SELECT row_id, ~(d) AS x0, ~(a) AS x1, ~(c) AS x2 FROM l")
def p4_gather(spark, d):
    return _l(spark, d).select("row_id", vectors.gather("features", [3, 0, 2]).alias("f")).select("row_id", *(F.col("f")[i].alias(f"x{i}") for i in range(3)))


@query(f"WITH {E}, p AS (SELECT j, row_number() OVER (ORDER BY {_u(_q('pick'), _v('j'))}, j) AS o FROM (SELECT CAST(range AS INT) AS j FROM range(64))), c AS (SELECT j, CAST(row_number() OVER (ORDER BY j) - 1 AS INT) AS pos FROM p WHERE o <= 10) SELECT row_id, pos, ~(v) AS x FROM el JOIN c ON el.dim = c.j")
def p5_random_features(spark, d):
    return prep.select_random(_e(spark, d), 10, "pick")[0].select("row_id", F.posexplode("features").alias("pos", "x"))


@query(f"WITH {E}, s AS (SELECT dim, var_pop(v) AS var FROM el GROUP BY dim) SELECT CAST(row_number() OVER (ORDER BY var DESC, dim DESC) - 1 AS INT) AS pos, dim FROM s QUALIFY pos < 20")
def p6_widest_features(spark, d):
    return spark.createDataFrame(list(enumerate(prep.select_widest(_e(spark, d), 20)[1])), "pos int, dim int")


_PROJ = f"m AS (SELECT i, j, {_normal(_q('p'), _q('projection'), _v('i'), _v('j'))} / sqrt(8) AS w FROM (SELECT CAST(range AS INT) AS i FROM range(64)), (SELECT CAST(range AS INT) AS j FROM range(8)))"


@query(f"WITH {E}, {_PROJ} SELECT row_id, j, ~(sum(v * w)) AS y FROM el JOIN m ON el.dim = m.i GROUP BY row_id, j", 5)
def p8_random_projection(spark, d):
    return noise.times(_e(spark, d), noise.projection(64, 8, "p")).select("row_id", F.posexplode("features").alias("j", "y"))


@query(f"WITH {L}, x AS (SELECT [a, b, c, d] AS v FROM l), p AS (SELECT v, CAST(i.range AS INT) AS i, CAST(j.range AS INT) AS j FROM x, range(4) i, range(4) j) SELECT i, j, ~(covar_pop(v[i + 1], v[j + 1])) AS c FROM p GROUP BY i, j", 3)
def p12_covariance(spark, d):
    _, _, cov = reduction.moments(_l(spark, d))
    return spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(4) for j in range(4)], "i int, j int, c double")


@query(f"WITH {E}, m AS (SELECT dim, avg(v) AS m FROM el GROUP BY dim), c AS (SELECT row_id, dim, v - m AS v FROM el JOIN m USING (dim)), g AS (SELECT a.dim AS i, b.dim AS j, sum(a.v * b.v) / count(*) AS x FROM c a JOIN c b USING (row_id) GROUP BY ALL) SELECT ~(sum(x) FILTER (i = j)) AS trace, ~(sum(x * x)) AS squares FROM g")
def p12_block_spectrum(spark, d):
    """Sums of the eigenvalues and of their squares, which are the covariance's trace and the sum of its squared entries."""
    _, _, values = reduction.block_components(_e(spark, d), 64, 50, 8, 1e-9, "block")
    return spark.createDataFrame([(float(values.sum()), float((values**2).sum()))], "trace double, squares double")


@query(f"WITH {E} SELECT row_id, dim, ~(v) AS x FROM el", 5)
def p12_reconstruction(spark, d):
    """Every row again from all its components."""
    e = _e(spark, d)
    mean, v = reduction.leading(e, 64)
    back = noise.times(noise.times(e, v, "features", mean), v.T, "features", -(mean @ v))
    return back.select("row_id", F.posexplode("features").alias("dim", "x"))


@query()
def p12_pca(spark, d):
    return reduction.pca(_e(spark, d), 8).select("row_id", F.posexplode("features").alias("dim", "x"))


@query()
def p11_noisy_pca(spark, d):
    return reduction.noisy_pca(prep.row_clip(_e(spark, d), 1.0), 8, 50.0, 1.0, "s")[0].select("row_id", F.posexplode("features").alias("dim", "x"))


@query(f"WITH {E}, c AS (SELECT * FROM el WHERE row_id IN (SELECT row_id FROM e ORDER BY row_id LIMIT 8)), k AS (SELECT row_id AS id, dense_rank() OVER (ORDER BY row_id) - 1 AS j, dim, v AS w FROM c), s AS (SELECT row_id, j, sum((v - w) * (v - w)) AS d FROM el JOIN k USING (dim) GROUP BY row_id, j), o AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, j) AS p FROM s) SELECT row_id, CAST(j AS INT) AS cluster FROM o WHERE p = 1")
def p15_assign(spark, d):
    e = _e(spark, d)
    return stats.assign(e, _first_rows(e, 8)).select("row_id", "cluster")


@query(f"WITH {L} SELECT row_id, CAST(dense_rank() OVER (ORDER BY label * 5 - 1) - 1 AS INT) AS label FROM l")
def p16_relabel(spark, d):
    return prep.relabel(_l(spark, d).withColumn("label", F.col("label") * 5 - 1)).select("row_id", "label")


@query("SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS name FROM part")
def p17_canonical(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", runs.canonical("p_type").alias("name"))


@query(f"WITH {R}, s AS (SELECT method, eps_tot, avg(sse_x * 100) AS m FROM r GROUP BY ALL), t AS (SELECT *, max(abs(m)) OVER () AS top FROM s) SELECT method, eps_tot, ~(m) AS sse_x_mean, CASE WHEN top >= 1e6 THEN 1e6 WHEN top >= 1e5 THEN 1e5 ELSE 1.0 END AS divisor, ~(m / CASE WHEN top >= 1e6 THEN 1e6 WHEN top >= 1e5 THEN 1e5 ELSE 1.0 END) AS shown FROM t", 4)
def p21_scaled_error(spark, d):
    return reports.scaled_error(reports.summary(_r(spark, d).withColumn("sse_x", F.col("sse_x") * 100), ["method", "eps_tot"], ["sse_x"], ["mean"]), "sse_x")


@query("SELECT p_partkey, CASE regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') WHEN 'promo' THEN 'Promotion' WHEN 'economy' THEN 'Economy class' WHEN 'standard' THEN 'Promotion' ELSE p_type END AS p_type FROM part")
def p17_display_names(spark, d):
    return runs.display_names(tables.table(spark, d, "part").select("p_partkey", "p_type"), {"promo": "Promotion", "economy": "Economy class", "standard": "Promotion"}, "p_type")


_P19 = ("%.3g", "%.2e", "%.1f", "%.0f")


@query(f"WITH {R}, s AS (SELECT method, seed, avg(sse_x * pow(10, seed - 12)) / 7 AS x FROM r GROUP BY ALL) SELECT method, seed, " + ", ".join(f"printf('{f}', x) AS f{i}" for i, f in enumerate(_P19)) + " FROM s")
def p19_formats(spark, d):
    s = _r(spark, d).groupBy("method", "seed").agg((F.avg(F.col("sse_x") * F.pow(F.lit(10.0), F.col("seed") - 12)) / 7).alias("x"))
    return s.select("method", "seed", *(reports.number("x", f).alias(f"f{i}") for i, f in enumerate(_P19)))


# ---- filters and joins ----


@query(f"WITH {R} SELECT run_id, ~(f1) AS f1 FROM r WHERE abs(eps_tot - 0.8000001) <= 1e-8 + 1e-5 * 0.8000001 AND method IN ('view', 'click') AND dataset NOT IN ('gas2')")
def f4_close(spark, d):
    return _r(spark, d).where(vectors.close("eps_tot", 0.8000001) & F.col("method").isin("view", "click") & ~F.col("dataset").isin("gas2")).select("run_id", "f1")


@query(f"WITH {R}, v AS (SELECT DISTINCT eps_tot FROM r), w AS (SELECT unnest([0.65, 0.6, 1.3, 9.0]) AS w) SELECT DISTINCT arg_min(eps_tot, abs(eps_tot - w) * 1000 + eps_tot / 1000) AS eps_tot FROM v, w GROUP BY w")
def f5_nearest(spark, d):
    return spark.createDataFrame([(x,) for x in reports.nearest_values(_r(spark, d), "eps_tot", [0.65, 0.6, 1.3, 9.0])], "eps_tot double")


@query(f"WITH {R} SELECT run_id, CAST(CASE WHEN non_empty_k_final < k OR max_cluster_ratio_final > CASE dataset WHEN 'har' THEN 0.3 ELSE 0.55 END THEN 1 ELSE 0 END AS INT) AS collapse FROM r")
def f7_final_collapse(spark, d):
    return reports.final_collapse(_r(spark, d), {"har": 0.3}).select("run_id", "collapse")


@query(f"WITH {R}, {H} SELECT r.run_id, r.method, h.iter, h.tie, ~(h.eps_t) AS eps_t FROM r JOIN h USING (run_id)")
def j3_history_of_runs(spark, d):
    return reports.of_runs(_r(spark, d), _h(spark, d), ["method"]).select("run_id", "method", "iter", "tie", "eps_t")


_GRAPH = f"WITH {E} SELECT a.row_id AS a, b.row_id AS b, ~(list_distance(a.x, b.x)) AS distance FROM e a JOIN e b ON a.row_id < b.row_id WHERE list_distance(a.x, b.x) <= 1.2"
_QUANTILES = f"WITH {E}, s AS (SELECT row_id, x FROM e ORDER BY {_u(_q('g'), _v('row_id'))}, row_id LIMIT 2000), p AS (SELECT list_distance(a.x, b.x) AS distance FROM s a JOIN s b ON a.row_id < b.row_id), q AS (SELECT unnest([0.01, 0.02, 0.05]) AS share, unnest(quantile_cont(distance, [0.01, 0.02, 0.05])) AS q FROM p) SELECT CAST(row_number() OVER (ORDER BY share) - 1 AS INT) AS pos, ~(q) AS radius FROM q"


@query(_GRAPH, 5)
def j5_radius_graph(spark, d):
    return alternatives.radius_graph(_e(spark, d), 1.2)


@query(_QUANTILES, 5)
def a24_distance_quantiles(spark, d):
    pairs = alternatives.pair_distances(noise.first_by_draw(_e(spark, d), 2000, "g"))
    return spark.createDataFrame(list(enumerate(alternatives.radius_candidates(pairs, [0.01, 0.02, 0.05]))), "pos int, radius double")


@query(_GRAPH, 5)
def j5_radius_graph_whole(spark, d):
    return j5_radius_graph(spark, d)


@query(_QUANTILES, 5)
def a24_distance_quantiles_2000(spark, d):
    return a24_distance_quantiles(spark, d)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j9_missing_tasks(spark, d):
    return runs.missing_tasks(tables.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), tables.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query(f"WITH {R}, a AS (SELECT method, eps_tot, avg(CASE WHEN seed < 3 THEN f1 END) AS f1 FROM r GROUP BY ALL), b AS (SELECT method, eps_tot, avg(ari) AS f1 FROM r GROUP BY ALL) SELECT a.method, a.eps_tot, ~(coalesce(CASE WHEN a.eps_tot > 0.9 THEN a.f1 END, b.f1)) AS f1 FROM a LEFT JOIN b USING (method, eps_tot)")
def j10_fallback(spark, d):
    r = _r(spark, d)
    a = r.groupBy("method", "eps_tot").agg(F.avg(F.when(F.col("seed") < 3, F.col("f1"))).alias("f1")).withColumn("f1", F.when(F.col("eps_tot") > 0.9, F.col("f1")))
    return reports.with_fallback(a, r.groupBy("method", "eps_tot").agg(F.avg("ari").alias("f1")), ["method", "eps_tot"], ["f1"])


# ---- aggregates and metrics ----


@query(f"WITH {E} SELECT dim, ~(avg(v)) AS mean, ~(var_pop(v)) AS var, ~(stddev_pop(v)) AS sd FROM el GROUP BY dim")
def a1_dimension_stats(spark, d):
    return prep.dimension_stats(_e(spark, d))


@query(f"WITH {E} SELECT dim, ~(greatest(0, least(9 / 6.000001, var_pop(v) * 100 / 6.000001))) AS score FROM el GROUP BY dim")
def a2_feature_scores(spark, d):
    return prep.feature_scores(_e(spark, d).withColumn("features", F.transform("features", lambda x: x * 10)))


@query(f"WITH {L}, t AS (SELECT label AS cluster, count(*) AS n FROM l GROUP BY 1), k AS (SELECT CAST(range AS INT) AS cluster FROM range(5)) SELECT cluster, coalesce(n, 0) AS n, ~(coalesce(n, 0) / (SELECT count(*) FROM l)) AS ratio FROM k LEFT JOIN t USING (cluster)")
def a4_cluster_table(spark, d):
    return stats.cluster_table(_l(spark, d), 5, "label")


@query(f"WITH {E}, t AS (SELECT label % 10 AS c, count(*) AS n FROM e GROUP BY 1), p AS (SELECT n / (SELECT count(*) FROM e) AS p FROM t) SELECT CAST(count(*) AS BIGINT) AS non_empty_k, ~(max(p)) AS max_cluster_ratio, ~(CASE WHEN count(*) < 12 THEN 0 ELSE min(p) END) AS min_cluster_ratio, ~(sum(-p * ln(p))) AS cluster_entropy FROM p")
def a6_diagnostics(spark, d):
    return stats.diagnostics(stats.cluster_table(_e(spark, d).withColumn("cluster", F.col("label") % 10), 12))


@query(f"WITH {E}, c AS (SELECT dense_rank() OVER (ORDER BY row_id) - 1 AS j, dim, v AS w FROM el WHERE row_id IN (SELECT row_id FROM e ORDER BY row_id LIMIT 6)), s AS (SELECT row_id, j, sum((v - w) * (v - w)) AS d FROM el JOIN c USING (dim) GROUP BY ALL), o AS (SELECT row_id, CAST(arg_min(j, d) AS INT) AS j, min(d) AS d FROM s GROUP BY row_id) SELECT j AS cluster, count(*) AS n, ~(sum(d)) AS sse FROM o GROUP BY j", 4)
def a5_a7_cluster_sums(spark, d):
    e = _e(spark, d)
    c = _first_rows(e, 6)
    s = stats.cluster_sums(e, c)
    each = s.q - 2 * (c * s.s).sum(1) + s.n * (c * c).sum(1)
    return spark.createDataFrame([(j, int(s.n[j]), float(each[j])) for j in range(6) if s.n[j]], "cluster int, n long, sse double")


@query(f"WITH {E}, m AS (SELECT label, dim, avg(v) AS m FROM el GROUP BY ALL) SELECT ~(sum((v - m) * (v - m))) AS sse FROM el JOIN m USING (label, dim)", 4)
def a8_sse_own_means(spark, d):
    return spark.createDataFrame([(stats.sums_by(_e(spark, d), "label", 10).sse_own(),)], "sse double")


@query(f"WITH {E} SELECT label AS cluster, dim, ~(avg(v)) AS x FROM el GROUP BY ALL")
def a9_label_means(spark, d):
    means = stats.sums_by(_e(spark, d), "label", 10).means()
    return spark.createDataFrame([(j, i, float(x)) for j, row in enumerate(means) for i, x in enumerate(row) if row.any()], "cluster int, dim int, x double")


@query("SELECT quality AS label, toxic AS cluster, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL")
def a10_contingency(spark, d):
    return metrics.contingency(tables.table(spark, d, "labels"), "quality", "toxic")


_AGREE = """t AS (SELECT count(*) AS t FROM l),
ct AS (SELECT label, k, count(*) AS n FROM l GROUP BY ALL), a AS (SELECT label, sum(n) AS a FROM ct GROUP BY label), b AS (SELECT k, sum(n) AS b FROM ct GROUP BY k),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ct) AS same, (SELECT sum(a * (a - 1) / 2) FROM a) AS la, (SELECT sum(b * (b - 1) / 2) FROM b) AS cb, (SELECT sum(-a / t * ln(a / t)) FROM a, t) AS ha, (SELECT sum(-b / t * ln(b / t)) FROM b, t) AS hb,
  (SELECT sum(n / t * ln(n * t / (CAST(a AS DOUBLE) * b))) FROM ct JOIN a USING (label) JOIN b USING (k), t) AS mi, CAST(t AS DOUBLE) * (t - 1) / 2 AS pairs FROM t)
SELECT ~((same - CAST(la AS DOUBLE) * cb / pairs) / ((la + cb) / 2 - CAST(la AS DOUBLE) * cb / pairs)) AS ari, ~(greatest(mi, 0) / ((ha + hb) / 2)) AS nmi FROM s"""


@query(f"WITH l AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, CASE WHEN year(l_shipdate) > 1999 OR l_returnflag = 'A' THEN 1 ELSE 0 END AS k FROM lineitem), {_AGREE}")
def a13_a14_agreement(spark, d):
    l = tables.table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("label"), F.when((F.year("l_shipdate") > 1999) | (F.col("l_returnflag") == "A"), 1).otherwise(0).alias("cluster"))  # noqa: E741
    return metrics.agreement(metrics.contingency(l))


_FIVE_WAYS = ", ".join(f"q{i}.range AS x{i}" for i in range(5)), ", ".join(f"range(5) q{i}" for i in range(5)), " AND ".join(f"q{i}.range <> q{j}.range" for i in range(5) for j in range(i))
_MACRO_F1 = f"""WITH {E}, c AS (SELECT * FROM el WHERE row_id IN (SELECT row_id FROM e ORDER BY row_id LIMIT 5)), k AS (SELECT dense_rank() OVER (ORDER BY row_id) - 1 AS j, dim, v AS w FROM c), s AS (SELECT row_id, j, sum((v - w) * (v - w)) AS d FROM el JOIN k USING (dim) GROUP BY row_id, j),
o AS (SELECT row_id, j, row_number() OVER (PARTITION BY row_id ORDER BY d, j) AS p FROM s), ct AS MATERIALIZED (SELECT label % 5 AS a, j AS b, count(*) AS n FROM o JOIN e USING (row_id) WHERE p = 1 GROUP BY ALL),
perms AS (SELECT {_FIVE_WAYS[0]} FROM {_FIVE_WAYS[1]} WHERE {_FIVE_WAYS[2]}), scored AS (SELECT x0, x1, x2, x3, x4, sum(coalesce(n, 0)) AS hits FROM perms LEFT JOIN ct ON a = ([x0, x1, x2, x3, x4])[b + 1] GROUP BY ALL),
best AS (SELECT [x0, x1, x2, x3, x4] AS x FROM scored ORDER BY hits DESC, x0, x1, x2, x3, x4 LIMIT 1), named AS (SELECT a, b, n, x[b + 1] AS m FROM ct, best),
f AS (SELECT r.range AS cls, coalesce(sum(n) FILTER (a = r.range AND m = r.range), 0) AS hit, coalesce(sum(n) FILTER (a = r.range), 0) AS truly, coalesce(sum(n) FILTER (m = r.range), 0) AS said FROM range(5) r, named GROUP BY 1)
SELECT CAST(r.range AS INT) AS cluster, CAST(x[r.range + 1] AS INT) AS class, ~((SELECT avg(CASE WHEN truly + said > 0 THEN 2 * hit / (truly + said) ELSE 0 END) FROM f)) AS f1 FROM range(5) r, best"""


@query(_MACRO_F1)
def a11_a12_macro_f1(spark, d):
    e = _e(spark, d).withColumn("label", F.col("label") % 5)
    out = stats.assign(e, _first_rows(e, 5))
    f1, mapping = metrics.macro_f1([tuple(r) for r in metrics.contingency(out).collect()])
    return spark.createDataFrame([(c, m, f1) for c, m in sorted(mapping.items())], "cluster int, class int, f1 double")


@query("""WITH v AS (SELECT c_mktsegment AS seg, c_nationkey % 5 AS grp, c_acctbal AS x FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
s AS (SELECT grp, count(CASE WHEN seg = 'BUILDING' THEN x END) AS n_a, count(CASE WHEN seg <> 'BUILDING' THEN x END) AS n_b, avg(CASE WHEN seg = 'BUILDING' THEN x END) AS ma, avg(CASE WHEN seg <> 'BUILDING' THEN x END) AS mb, var_samp(CASE WHEN seg = 'BUILDING' THEN x END) AS va, var_samp(CASE WHEN seg <> 'BUILDING' THEN x END) AS vb FROM v GROUP BY grp)
SELECT grp, n_a, n_b, ~(ma - mb) AS mean_diff, ~((ma - mb) / sqrt(greatest(((n_a - 1) * coalesce(va, 0) + (n_b - 1) * coalesce(vb, 0)) / greatest(n_a + n_b - 2, 1), 1e-12))) AS cohen_d FROM s""", 4)
def a21_effect_size(spark, d):
    c = tables.table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).withColumn("grp", F.col("c_nationkey") % 5)
    return significance.effect_size(c, ["grp"], F.col("c_mktsegment") == "BUILDING", "c_acctbal")


@query(f"WITH {R} SELECT method, seed, run_id, rank() OVER (PARTITION BY method ORDER BY f1) + (count(*) OVER (PARTITION BY method, f1) - 1) / 2.0 AS rank FROM r")
def a23_average_ranks(spark, d):
    return significance.average_ranks(_r(spark, d), ["method"], "f1").select("method", "seed", "run_id", "rank")


@query(f"WITH {R} SELECT dataset, ~(avg(f1)) AS mean, ~(stddev_pop(f1)) AS std, count(DISTINCT method) AS methods, count(DISTINCT seed) AS seeds FROM r GROUP BY dataset")
def a20_a28_population(spark, d):
    return _r(spark, d).groupBy("dataset").agg(F.avg("f1").alias("mean"), F.stddev_pop("f1").alias("std"), F.count_distinct("method").alias("methods"), F.count_distinct("seed").alias("seeds"))


# ---- windows ----


@query(f"WITH {H} SELECT run_id, iter, tie, ~(sum(eps_t) OVER (PARTITION BY run_id ORDER BY iter, tie, eps_t, drift ROWS UNBOUNDED PRECEDING)) AS eps_cum FROM h")
def w2_running_budget(spark, d):
    return reports.running_budget(_h(spark, d), order=("iter", "tie", "eps_t", "drift")).select("run_id", "iter", "tie", "eps_cum")


@query(f"WITH {H} SELECT run_id, iter, tie, ~(sum(eps_t) OVER (PARTITION BY run_id ORDER BY iter, tie, eps_t, drift ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS eps_left FROM h")
def w3_remaining_budget(spark, d):
    return reports.remaining_budget(_h(spark, d), order=("iter", "tie", "eps_t", "drift")).select("run_id", "iter", "tie", "eps_left")


@query(f"WITH {H}, g AS (SELECT *, lag(drift, 1) OVER w AS lag_1, lag(drift, 2) OVER w AS lag_2 FROM h WINDOW w AS (PARTITION BY run_id ORDER BY iter, tie, eps_t, drift)) SELECT run_id, iter, tie, ~(drift) AS drift, ~(lag_1) AS lag_1, ~(lag_2) AS lag_2, lag_1 <= lag_2 * 0.98 AS improved FROM g")
def w4_drift_steps(spark, d):
    return reports.drift_steps(_h(spark, d), order=("iter", "tie", "eps_t", "drift")).select("run_id", "iter", "tie", "drift", "lag_1", "lag_2", "improved")


_ONE = f"{R}, o AS (SELECT *, row_number() OVER (PARTITION BY dataset, method, eps_tot, seed ORDER BY run_id"


@query(f"WITH {_ONE} DESC) AS p FROM r) SELECT dataset, method, eps_tot, seed, run_id, ~(f1) AS f1 FROM o WHERE p = 1")
def w5_keep_last(spark, d):
    return runs.keep_last(_r(spark, d), ["dataset", "method", "eps_tot", "seed"], "run_id").select("dataset", "method", "eps_tot", "seed", "run_id", "f1")


@query(f"WITH {_ONE}) AS p FROM r) SELECT dataset, method, eps_tot, seed, run_id, ~(f1) AS f1 FROM o WHERE p = 1")
def w6_keep_first(spark, d):
    return runs.keep_first(_r(spark, d), ["dataset", "method", "eps_tot", "seed"], "run_id").select("dataset", "method", "eps_tot", "seed", "run_id", "f1")


@query(f"WITH {H}, g AS (SELECT run_id, drift, row_number() OVER (PARTITION BY run_id ORDER BY iter DESC, tie DESC, drift DESC) AS back FROM h) SELECT run_id, ~(sum(0.2 * drift * pow(0.8, back - 1))) AS ema FROM g GROUP BY run_id")
def w7_smoothed_drift(spark, d):
    return reports.smoothed(_h(spark, d), "drift", 0.8, order=("iter", "tie", "drift"))


@query(f"WITH {R}, a AS (SELECT DISTINCT method FROM r WHERE dataset = 'har' AND seed < 9), b AS (SELECT 'view' AS method UNION SELECT 'other') SELECT method, 'minus' AS op FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT method, 'union' FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT method, 'both' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def u2_method_sets(spark, d):
    a, b = _r(spark, d).where("dataset = 'har' AND seed < 9").select("method").distinct(), spark.createDataFrame([("view",), ("other",)], "method string")
    named = lambda df, op: df.withColumn("op", F.lit(op))
    return named(a.subtract(b), "minus").unionByName(named(a.union(b).distinct(), "union")).unionByName(named(a.intersect(b), "both"))


# ---- noise and clustering ----


@query(f"WITH {E}, t AS (SELECT label AS cluster, count(*) AS n FROM e GROUP BY 1) SELECT cluster, ~(n + {_laplace('1 / 0.5', _q('c'), _q('cnt'), _v('cluster'))}) AS n FROM t")
def c1_noisy_counts(spark, d):
    t = stats.cluster_table(_e(spark, d), 10, "label").where("n > 0")
    return t.select("cluster", (F.col("n") + rng.laplace_col(noise.count_scale(0.5), "c", "cnt", F.col("cluster"))).alias("n"))


def _kmeans_sql(k: int, steps: int, eps: float, seed: str) -> str:
    """Noisy k-means on the embeddings from their first k rows, as chained tables."""
    now = eps / steps
    cnt = now * 0.2
    scale = 2 * 1.0 * 8.0 / (now - cnt)
    out = [f"WITH {E}", "z AS MATERIALIZED (SELECT row_id, dim, v * least(1, 1 / greatest(sqrt(n2), 1e-12)) AS v FROM el JOIN (SELECT row_id, sum(v * v) AS n2 FROM el GROUP BY 1) USING (row_id))"]
    out.append(f"c0 AS MATERIALIZED (SELECT CAST(dense_rank() OVER (ORDER BY row_id) - 1 AS INT) AS j, dim, v AS w FROM z WHERE row_id IN (SELECT row_id FROM e ORDER BY row_id LIMIT {k}))")
    for t in range(steps + 1):
        out.append(f"a{t} AS MATERIALIZED (SELECT row_id, j FROM (SELECT row_id, j, row_number() OVER (PARTITION BY row_id ORDER BY d, j) AS p FROM (SELECT row_id, j, sum((v - w) * (v - w)) AS d FROM z JOIN c{t} USING (dim) GROUP BY ALL)) WHERE p = 1)")
        if t < steps:
            out.append(f"n{t} AS MATERIALIZED (SELECT j, coalesce(n, 0) AS raw, coalesce(n, 0) + {_laplace(f'1 / {cnt!r}', _q(seed), _q(t), _q('cnt'), _v('j'))} AS n FROM (SELECT DISTINCT j FROM c{t}) LEFT JOIN (SELECT j, count(*) AS n FROM a{t} GROUP BY 1) USING (j))")
            out.append(f"c{t + 1} AS MATERIALIZED (SELECT j, dim, (coalesce(s, 0) + {_laplace(repr(scale), _q(seed), _q(t), _q('sum'), _v('j'), _v('dim'))}) / greatest(n, 1) AS w FROM c{t} JOIN n{t} USING (j) LEFT JOIN (SELECT j, dim, sum(v) AS s FROM a{t} JOIN z USING (row_id) GROUP BY ALL) USING (j, dim))")
    rows = []
    for t in range(steps):
        err = lambda a, t=t: f"(SELECT sum((v - w) * (v - w)) FROM {a} JOIN z USING (row_id) JOIN c{t + 1} USING (j, dim))"
        rows.append(f"SELECT {t} AS iter, ~({err(f'a{t}')}) AS sse_z_prev_labels, ~({err(f'a{t + 1}')}) AS sse_z_reassign, ~((SELECT sqrt(sum((p.w - q.w) * (p.w - q.w) * n / (s + 1e-12))) FROM c{t} p JOIN c{t + 1} q USING (j, dim) JOIN n{t} USING (j), (SELECT sum(n) AS s FROM n{t}))) AS drift, ~((SELECT sqrt(sum((p.w - q.w) * (p.w - q.w))) FROM c{t} p JOIN c{t + 1} q USING (j, dim))) AS drift_raw, ~({now!r}) AS eps_used, 'static' AS guard_state, CAST((SELECT count(*) FROM n{t} WHERE raw > 0) AS INT) AS non_empty_k, ~((SELECT max(raw) / sum(raw) FROM n{t})) AS max_cluster_ratio, ~((SELECT min(raw) / sum(raw) FROM n{t})) AS min_cluster_ratio, ~({scale!r}) AS noise_scale_sums")
    return ",\n".join(out) + "\n" + "\nUNION ALL ".join(rows)


@query(_kmeans_sql(5, 3, 500.0, "s0"), 4)
def c4_dp_kmeans_history(spark, d):
    z = prep.row_clip(_e(spark, d), 1.0).persist()
    fit = kmeans.dp_kmeans(z, _first_rows(z, 5), 3, 500.0, 1.0, "s0")
    z.unpersist()
    return fit.history_frame(spark).select("iter", "sse_z_prev_labels", "sse_z_reassign", "drift", "drift_raw", "eps_used", "guard_state", "non_empty_k", "max_cluster_ratio", "min_cluster_ratio", "noise_scale_sums")


def _schedule_rows() -> list[tuple]:
    plans = {"static": schedules.static(1.0, 20), "strong": schedules.strong_contrast(1.0, 20, 0.7, 0.3), "tail": schedules.fixed_tail(1.0, 20)}
    return list(plans.items())


@query("""WITH t AS (SELECT CAST(range AS INT) AS t FROM range(20)) SELECT 'static' AS name, t + 1 AS t, ~(0.05) AS eps FROM t
UNION ALL SELECT 'strong', t + 1, ~(CASE WHEN t < 14 THEN 0.015 ELSE (1 - 14 * 0.015) / 6.0 END) FROM t UNION ALL SELECT 'tail', t + 1, ~((1 + 2 * t / 19.0) / 40.0) FROM t""")
def c5_q32_schedules(spark, d):
    return reports.schedule_overlay(spark.createDataFrame(_schedule_rows(), "name string, schedule array<double>"))


_PLANS = """WITH RECURSIVE p(name, least, most, top, low, recovery) AS (VALUES ('feedback', 0.01, 0.1, 2.0, 0.0, 0.0), ('feedback_v2', 0.01, 0.1, 2.0, -2.0, -0.5), ('feedback_v3', 0.03, 0.15, 3.0, 0.0, 1.0)),
f AS (SELECT name, 0 AS t, CAST(0 AS DOUBLE) AS s FROM p UNION ALL SELECT name, t + 1, 0.8 * s + 0.2 * greatest(low, least(top, 0.3 / (t + 1) / CAST(1.000001 AS DOUBLE) + recovery / 6)) FROM f JOIN p USING (name) WHERE t < 19),
tilt AS (SELECT range AS t, pow((range - 3) / 16 + 1e-6, 3) AS w FROM range(3, 20)),
b AS (SELECT name, t, s, CAST(p.least AS DOUBLE) AS least, CAST(p.most AS DOUBLE) AS most, p.least + (p.most - p.least) * pow(t / 19, CASE name WHEN 'feedback_v2' THEN 2 ELSE 2.5 END) * 1.0 AS ramp, coalesce(w / ((SELECT avg(w) FROM tilt) + 1e-12), 1) AS w FROM f JOIN p USING (name) LEFT JOIN tilt USING (t)),
c AS (SELECT name, t, least, most, CASE name WHEN 'feedback' THEN CASE WHEN t < 3 THEN least ELSE least + (most - least) / (1 + s) END WHEN 'feedback_v3' THEN ramp * w ELSE ramp END AS base,
  CASE name WHEN 'feedback' THEN 1 WHEN 'feedback_v2' THEN greatest(0.7, least(1.3, 1 / (1 + s))) ELSE greatest(1, least(2, 1 + s)) END AS adj FROM b)
SELECT name, CAST(t AS INT) AS t, ~(CASE name WHEN 'feedback' THEN base WHEN 'feedback_v2' THEN CASE WHEN t < 3 THEN least ELSE base * adj END ELSE CASE WHEN t < 3 THEN 0.05 ELSE greatest(least, least(most, base * adj)) END END) AS eps, ~(base) AS base, ~(adj) AS adj FROM c"""


@query(_PLANS)
def c6_c8_feedback_plans(spark, d):
    rows = []
    for name, rule in schedules.RULES.items():
        f = schedules.Feedback(1.0, 20, rule)
        for t in range(20):
            p = f.next()
            f.observe(0.3 / (t + 1), 1.0, 5, 0.4, 6)
            rows.append((name, t, p["eps"], p["base"], p["adj"]))
    return spark.createDataFrame(rows, "name string, t int, eps double, base double, adj double")


def _top_sql(m: int, eps: float) -> str:
    """Rounds of report-noisy-max over the dimension scores."""
    scale = f"(2 * (72.0 / (SELECT count(*) FROM e) / 6.000002)) / {eps / m!r}"
    out = [f"WITH {E}, s AS MATERIALIZED (SELECT dim, greatest(0, least(9 / 6.000001, var_pop(v) / 6.000001)) AS score FROM el GROUP BY dim)"]
    for r in range(m):
        gone = " AND ".join(f"dim NOT IN (SELECT dim FROM t{q})" for q in range(r)) or "true"
        out.append(f"t{r} AS MATERIALIZED (SELECT dim FROM s WHERE {gone} ORDER BY score + {_laplace(scale, _q('top'), _q(r), _v('dim'))} DESC, dim LIMIT 1)")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT {r} AS pos, dim FROM t{r}" for r in range(m))


@query(_top_sql(6, 40.0))
def c15_noisy_top(spark, d):
    return spark.createDataFrame(list(enumerate(prep.select_noisy(_e(spark, d), 6, 40.0, "top")[1])), "pos int, dim int")


@query(f"WITH {E}, {_PROJ}, y AS (SELECT row_id, j, sum(v * w) AS y FROM el JOIN m ON el.dim = m.i GROUP BY ALL) SELECT row_id, j, ~(y + {_laplace('2.5', _q('n'), _v('row_id'), _v('j'))}) AS y FROM y", 5)
def c17_noisy_proxy(spark, d):
    return noise.add_noise(noise.times(_e(spark, d), noise.projection(64, 8, "p")), 2.5, "n").select("row_id", F.posexplode("features").alias("j", "y"))


@query(f"WITH {L} SELECT row_id FROM l ORDER BY {_u(_q('share'), _v('row_id'))}, row_id LIMIT (SELECT greatest(CAST(floor(count(*) * 0.3) AS BIGINT), 1500) FROM lineitem)")
def c18_subsample(spark, d):
    return noise.subsample(_l(spark, d), 0.3, 1500, "share").select("row_id")


@query(f"WITH {L} SELECT row_id, " + ", ".join(f"~(greatest(-100, least(100, {c} + {_laplace('50.0', _q('box'), _v('row_id'), _q(i))}))) AS x{i}" for i, c in enumerate("abcd")) + " FROM l", 5)
def c30_point_noise(spark, d):
    return noise.point_noise_proxy(_l(spark, d), 4.0, 100.0, "box").select("row_id", *(F.col("features")[i].alias(f"x{i}") for i in range(4)))


@query(f"WITH {E}, p AS (SELECT row_id FROM e ORDER BY {_u(_q('init'), _q('rows'), _v('row_id'))}, row_id LIMIT 5) SELECT CAST(row_number() OVER (ORDER BY row_id) - 1 AS INT) AS pos, ~(v) AS first FROM p JOIN el USING (row_id) WHERE dim = 0")
def c19_random_rows(spark, d):
    return spark.createDataFrame([(i, float(c[0])) for i, c in enumerate(seeding.random_rows(_e(spark, d), 5, "init"))], "pos int, first double")


def _pp_sql(k: int) -> str:
    """k-means++ by the largest ln(u) / d^2 in each round."""
    out = [f"WITH {E}", f"p0 AS MATERIALIZED (SELECT row_id FROM e ORDER BY {_u(_q('kpp'), _q('pp'), _q(0), _v('row_id'))}, row_id LIMIT 1)"]
    for t in range(1, k):
        picks = " UNION ALL ".join(f"SELECT row_id AS c FROM p{q}" for q in range(t))
        out.append(f"p{t} AS MATERIALIZED (SELECT row_id FROM (SELECT row_id, min(d) AS d FROM (SELECT a.row_id, b.row_id AS c, sum((a.v - b.v) * (a.v - b.v)) AS d FROM el a JOIN (SELECT * FROM el WHERE row_id IN (SELECT c FROM ({picks}))) b USING (dim) GROUP BY ALL) GROUP BY 1) WHERE d > 0 ORDER BY ln({_u(_q('kpp'), _q('pp'), _q(t), _v('row_id'))}) / d DESC, row_id LIMIT 1)")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT {t} AS pos, ~(v) AS first FROM p{t} JOIN el USING (row_id) WHERE dim = 0" for t in range(k))


@query(_pp_sql(4))
def c20_kmeanspp(spark, d):
    return spark.createDataFrame([(i, float(c[0])) for i, c in enumerate(seeding.kmeanspp(_e(spark, d), 4, "kpp"))], "pos int, first double")


@query("""WITH m(method, sel, pca, ratio) AS (VALUES ('dpk', 0, 0, 0.0), ('dpk_kpp', 0, 0, 0.1), ('dpk_pca', 0, 1, 0.1), ('dpk_full', 1, 1, 0.1), ('dpk_random_features', 0, 0, 0.1)),
b AS (SELECT method, sel, pca, CAST(ratio AS DOUBLE) AS proxy, CASE WHEN sel + pca > 0 THEN 0.05 ELSE 0.0 END AS fs FROM m)
SELECT method, ~(fs) AS eps_fs, ~(0.6 * fs * sel) AS eps_topm, ~((fs - 0.6 * fs * sel) * pca) AS eps_pca, ~(proxy) AS eps_proxy, ~(1 - 0.6 * fs * sel - (fs - 0.6 * fs * sel) * pca - proxy) AS eps_iter FROM b""")
def c25_budget_split(spark, d):
    rows = []
    for name in ("dpk", "dpk_kpp", "dpk_pca", "dpk_full", "dpk_random_features"):
        m = methods.METHODS[name]
        s = methods.budget_split(1.0, m.features == "noisy", m.pca, 0.0 if m.init == "public_random" else 0.1)
        rows.append((name, *s.values()))
    return spark.createDataFrame(rows, "method string, eps_fs double, eps_topm double, eps_pca double, eps_proxy double, eps_iter double")


_QUICK = {"steps": 3, "top_m": 32, "pca_r": 8, "proxy_dim": 4, "restarts": 1, "clip": 1.0}


def _fuzzy_round(name: str, before: str) -> str:
    """The centroids after a round of fuzzy c-means, in SQL."""
    return f"""{name}n AS (SELECT row_id, cluster, 1 / pow(sqrt(sum((v - x) * (v - x))) + 1e-8, 2) AS near FROM el JOIN {before} USING (dim) GROUP BY ALL),
{name}w AS (SELECT row_id, cluster, pow(near / sum(near) OVER (PARTITION BY row_id), 2) AS w FROM {name}n),
{name} AS (SELECT cluster, dim, sum(w * v) / (sum(w) + 1e-9) AS x FROM {name}w JOIN el USING (row_id) GROUP BY ALL)"""


@query(f"WITH {E}, f AS (SELECT row_id, CAST(row_number() OVER (ORDER BY row_id) - 1 AS INT) AS cluster FROM e), c0 AS (SELECT cluster, dim, v AS x FROM f JOIN el USING (row_id) WHERE cluster < 4), {_fuzzy_round('c1', 'c0')}, {_fuzzy_round('c2', 'c1')} SELECT cluster, dim, ~(x) AS x FROM c2")
def c22_fuzzy_means(spark, d):
    e = _e(spark, d)
    c = seeding.fuzzy_means(e, _first_rows(e, 4), rounds=2)
    return spark.createDataFrame([(j, i, float(x)) for j, row in enumerate(c) for i, x in enumerate(row)], "cluster int, dim int, x double")


@query()
def c22_c24_seedings(spark, d):
    e = prep.row_clip(_e(spark, d), 1.0).persist()
    rows, back, _ = noise.proxy(e, 4, 200.0, 1.0, "seed")
    rows = rows.persist()
    out = [(m, i, float(np.linalg.norm(c))) for m in ("public_random", "kpp", "kpp_rr", "layered") for i, c in enumerate(seeding.initial(m, rows, back, 4, 64, 1.0, "seed", restarts=2))]
    out += [("noisy_means", i, float(np.linalg.norm(c))) for i, c in enumerate(seeding.noisy_means(e, 4, 50.0, 1.0, "seed"))]
    for held in (e, rows):
        held.unpersist()
    return spark.createDataFrame(out, "mode string, pos int, length double")


@query()
def c26_run_methods(spark, d):
    return methods.experiment(_e(spark, d), "embeddings", 10, ["dpk", "dpk_full"], [200.0], [0], **_QUICK).drop("runtime_ms_total")


@query()
def c26_grid(spark, d):
    """Every method with two budgets and two seeds."""
    return methods.experiment(_e(spark, d), "embeddings", 10, list(methods.METHODS), [50.0, 200.0], [0, 1], **_QUICK).drop("runtime_ms_total")


_LINKS = f"{E}, k AS (SELECT a.row_id AS a, b.row_id AS b FROM e a JOIN e b ON a.row_id < b.row_id WHERE list_distance(a.x, b.x) <= 1.2)"
_REACH = "SELECT p AS node, p AS other FROM n UNION SELECT r.node, m.b FROM r JOIN m ON m.a = r.other"


@query(f"WITH RECURSIVE {_LINKS}, m AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k), n AS (SELECT DISTINCT a AS p FROM m), r(node, other) AS ({_REACH}) SELECT node, min(other) AS component FROM r GROUP BY node")
def c32_components(spark, d):
    return graphs.components(alternatives.radius_forest(_e(spark, d), 1.2))


def _grows(side: str, eps: str) -> str:
    return f"deg + {_laplace(f'1 / {eps}', _q('d'), _q(side), _v('radius'), _v('row_id'))} >= 4"


@query(f"""WITH RECURSIVE {_LINKS}, g AS (SELECT row_id, count(*) AS deg FROM (SELECT unnest([a, b]) AS row_id FROM k) GROUP BY 1),
f0 AS (SELECT row_id, 1.2 AS radius, coalesce(deg, 0) AS deg FROM e LEFT JOIN g USING (row_id)), f AS (SELECT row_id AS p, {_grows('starts', '0.5')} AS starts, {_grows('grows', '1.0')} AS grows FROM f0),
n AS (SELECT p, starts FROM f WHERE starts OR grows), sides AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k), m AS (SELECT a, b FROM sides JOIN n ON n.p = b WHERE a IN (SELECT p FROM n)),
r(node, other) AS ({_REACH}), c AS (SELECT node AS p, min(other) AS component FROM r GROUP BY node), real AS (SELECT component FROM c JOIN n USING (p) GROUP BY 1 HAVING bool_or(starts)),
inside AS (SELECT p, component FROM c JOIN real USING (component)), beside AS (SELECT a AS p, min(component) AS component FROM sides JOIN inside ON inside.p = b WHERE a NOT IN (SELECT p FROM n) GROUP BY a),
named AS (SELECT p, dense_rank() OVER (ORDER BY component) - 1 AS cluster FROM (SELECT * FROM inside UNION ALL SELECT * FROM beside))
SELECT f.p AS row_id, CAST(coalesce(cluster, -1) AS INT) AS cluster FROM f LEFT JOIN named USING (p)""")
def c32_expansion(spark, d):
    """Density labels of all rows at one radius, with noisy degrees."""
    e, radius = _e(spark, d), F.lit(1.2).alias("radius")
    degrees = alternatives.radius_degrees(e, 1.2).select(radius, "row_id", "n")
    flags = alternatives.noisy_flags(e, degrees, spark.range(1).select(radius), 4, 0.5, 1.0, "d").persist()
    spread = e.join(flags.select("row_id", (F.col("starts") | F.col("grows")).alias("spreads")), "row_id")
    links = alternatives.radius_forest(spread, 1.2, "spreads").select(radius, "a", "b").persist()
    return alternatives.density_labels(flags, links).select("row_id", "cluster")


@query()
def q33_resumed_grid(spark, d):
    """A grid that is asked for in two calls; the second does what is missing."""
    e, folder = _e(spark, d), storage.new_folder(spark, "grid")
    methods.resumed(e, "embeddings", 10, ["dpk"], [50.0, 200.0], [0], folder, **_QUICK)
    return methods.resumed(e, "embeddings", 10, ["dpk", "dpk_kpp"], [50.0, 200.0], [0], folder, **_QUICK).drop("runtime_ms_total")


@query()
def c32_density(spark, d):
    return alternatives.density(_e(spark, d), 10, 50.0, "d")[0].groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def c33_merged_kmeans(spark, d):
    return alternatives.merged_kmeans(prep.row_clip(_e(spark, d), 1.0).persist(), 5, 500.0, 2, 1.0, "m")[0].groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def c34_schedule_search(spark, d):
    schedule, fitness = alternatives.search_schedule(prep.row_clip(_e(spark, d), 1.0), 5, 100.0, 4, 1.0, "ga")
    return spark.createDataFrame([(t, float(e), fitness) for t, e in enumerate(schedule)], "t int, eps double, fitness double")


@query()
def c35_stream_summary(spark, d):
    row = batches.run_batches(_e(spark, d).withColumn("batch_id", (F.col("row_id") % 2).cast("int")), "embeddings", "dpk", 5, 200.0, 0, **_QUICK)
    return spark.createDataFrame([(row["f1"], row["f1_std"], row["sse_x"], row["stream_batches"])], "f1 double, f1_std double, sse_x double, stream_batches int")


# ---- reports ----


def _mean_std(*values: str) -> str:
    return ", ".join(f"~(avg({v})) AS {v}_mean, ~(stddev_samp({v})) AS {v}_std" for v in values)


@query(f"WITH {R} SELECT method, eps_tot, {_mean_std('f1', 'sse_x')} FROM r WHERE dataset = 'har' GROUP BY ALL", 5)
def q1_metric_vs_eps(spark, d):
    return reports.curve(_r(spark, d), "har", "eps_tot", ["f1", "sse_x"])


@query(f"WITH {R} SELECT method, d, {_mean_std('f1')} FROM r WHERE dataset = 'har' AND eps_tot = 1.0 AND method IN ('view', 'click', 'error') GROUP BY ALL")
def q2_metric_vs_dimension(spark, d):
    return reports.curve(_r(spark, d), "har", "d", ["f1"], ["view", "click", "error"], 1.0)


_NAMES = ["view", "absent", "click", "error"]
_ORDER = "o AS (SELECT unnest([0, 1, 2, 3]) AS pos, unnest(['view', 'absent', 'click', 'error']) AS method)"


@query(f"WITH {R}, {_ORDER}, s AS (SELECT method, {_mean_std('f1')} FROM r WHERE dataset = 'gas' AND eps_tot = 0.8 GROUP BY ALL) SELECT CAST(pos AS INT) AS pos, method, f1_mean, f1_std FROM o LEFT JOIN s USING (method)")
def q3_ablation(spark, d):
    return reports.ablation(_r(spark, d), "gas", 0.8, _NAMES)


_RUN = f"{R}, {H}, one AS (SELECT run_id, method FROM r WHERE dataset = 'har' AND seed = 4 ORDER BY run_id LIMIT 20)"


@query(f"WITH {_RUN} SELECT run_id, method, iter, tie, ~(eps_t) AS eps_t, ~(drift) AS drift FROM one JOIN h USING (run_id)")
def q4_budget_curve(spark, d):
    some = _r(spark, d).where("dataset = 'har' AND seed = 4").orderBy("run_id").limit(20)
    return reports.of_runs(some, _h(spark, d), ["method"]).select("run_id", "method", "iter", "tie", "eps_t", "drift")


@query(f"WITH {R}, {H} SELECT method, iter, ~(avg(eps_t)) AS eps_t_mean, ~(stddev_samp(eps_t)) AS eps_t_std, ~(avg(noise_scale_sums)) AS noise_scale_sums_mean, ~(stddev_samp(noise_scale_sums)) AS noise_scale_sums_std FROM r JOIN h USING (run_id) WHERE method IN ('view', 'error') GROUP BY ALL")
def q5_eps_and_noise(spark, d):
    h = reports.of_runs(_r(spark, d).where(F.col("method").isin("view", "error")), _h(spark, d), ["method"])
    return reports.summary(h, ["method", "iter"], ["eps_t", "noise_scale_sums"])


@query(f"WITH {R}, {H} SELECT r.run_id, method, iter, tie, ~(sum(eps_t) OVER (PARTITION BY r.run_id ORDER BY iter, tie, eps_t, drift ROWS UNBOUNDED PRECEDING)) AS eps_cum FROM r JOIN h USING (run_id) WHERE dataset = 'gas'")
def q6_cumulative_budget(spark, d):
    h = reports.of_runs(_r(spark, d).where("dataset = 'gas'"), _h(spark, d), ["method"])
    return reports.running_budget(h, order=("iter", "tie", "eps_t", "drift")).select("run_id", "method", "iter", "tie", "eps_cum")


@query(f"WITH {R} SELECT method, 'n' AS axis, n AS x, {_mean_std('runtime_ms_total')} FROM r GROUP BY ALL UNION ALL SELECT method, 'd', d, {_mean_std('runtime_ms_total')} FROM r GROUP BY ALL")
def q7_runtime(spark, d):
    r = _r(spark, d)
    part = lambda x: reports.summary(r.withColumn("axis", F.lit(x)).withColumn("x", F.col(x)), ["method", "axis", "x"], ["runtime_ms_total"])
    return part("n").unionByName(part("d"))


@query(f"WITH {R}, q AS (SELECT method, quantile_cont(f1, 0.25) AS q1, quantile_cont(f1, 0.5) AS q2, quantile_cont(f1, 0.75) AS q3 FROM r GROUP BY 1) SELECT method, ~(q1) AS q1, ~(q2) AS q2, ~(q3) AS q3, ~(min(f1)) AS low, ~(max(f1)) AS high FROM r JOIN q USING (method) WHERE f1 BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY method, q1, q2, q3")
def q8_robustness(spark, d):
    return reports.box(_r(spark, d), ["method"], "f1")


@query(f"WITH {R} SELECT dataset, method, eps_tot, {_mean_std('non_empty_k_final', 'max_cluster_ratio_final')} FROM r GROUP BY ALL")
def q9_collapse_metrics(spark, d):
    return reports.summary(_r(spark, d), ["dataset", "method", "eps_tot"], ["non_empty_k_final", "max_cluster_ratio_final"])


@query(f"WITH {R}, {_ORDER}, s AS (SELECT method, {_mean_std('f1', 'ari', 'nmi')} FROM r WHERE dataset = 'har' AND eps_tot = 1.0 GROUP BY ALL) SELECT CAST(pos AS INT) AS pos, method, * EXCLUDE (pos, method) FROM o LEFT JOIN s USING (method)")
def q10_feedback_effect(spark, d):
    return reports.ablation(_r(spark, d), "har", 1.0, _NAMES, ["f1", "ari", "nmi"])


@query(f"WITH {R}, s AS (SELECT method, seed, avg(f1) AS f1 FROM r WHERE dataset = 'har' AND eps_tot = 1.0 GROUP BY ALL) SELECT method, seed, ~(f1) AS f1, ~(avg(f1) OVER (PARTITION BY method)) AS mean FROM s")
def q11_seed_scatter(spark, d):
    return reports.scatter(_r(spark, d), "har", 1.0)


@query(f"WITH {R}, {H}, s AS (SELECT method, iter, avg(eps_t) AS m FROM r JOIN h USING (run_id) GROUP BY ALL) SELECT method, iter, ~(m) AS eps_t_mean, ~(m / sum(m) OVER (PARTITION BY method)) AS share FROM s")
def q12_schedule_contrast(spark, d):
    from pyspark.sql import Window

    s = reports.summary(reports.of_runs(_r(spark, d), _h(spark, d), ["method"]), ["method", "iter"], ["eps_t"], ["mean"])
    return s.withColumn("share", F.col("eps_t_mean") / F.sum("eps_t_mean").over(Window.partitionBy("method")))


@query(f"WITH {R} SELECT dataset, method, eps_tot, {_mean_std('f1', 'ari', 'nmi', 'sse_x', 'runtime_ms_total')} FROM r GROUP BY ALL", 5)
def q13_summary(spark, d):
    return reports.summary(_r(spark, d), ["dataset", "method", "eps_tot"], ["f1", "ari", "nmi", "sse_x", "runtime_ms_total"])


@query(f"""WITH {R}, s AS (SELECT dataset, eps_tot, count(*) FILTER (method = 'view') AS n_a, count(*) FILTER (method = 'click') AS n_b, avg(f1) FILTER (method = 'view') AS ma, avg(f1) FILTER (method = 'click') AS mb, var_samp(f1) FILTER (method = 'view') AS va, var_samp(f1) FILTER (method = 'click') AS vb FROM r WHERE method IN ('view', 'click') GROUP BY ALL)
SELECT dataset, eps_tot, n_a, n_b, ~(ma - mb) AS mean_diff, ~((ma - mb) / sqrt(greatest(((n_a - 1) * coalesce(va, 0) + (n_b - 1) * coalesce(vb, 0)) / greatest(n_a + n_b - 2, 1), 1e-12))) AS cohen_d FROM s""")
def q14_effect_size(spark, d):
    return significance.effect_size(_r(spark, d).where(F.col("method").isin("view", "click")), ["dataset", "eps_tot"], F.col("method") == "view", "f1")


@query(f"""WITH {R}, {H}, c AS (SELECT run_id, avg(CASE WHEN non_empty_k < k OR min_cluster_ratio < 0.01 THEN 1.0 ELSE 0.0 END) AS collapse_rate FROM h JOIN (SELECT run_id, k FROM r) USING (run_id) GROUP BY 1)
SELECT dataset, method, {_mean_std('f1', 'collapse_rate')}, count(f1) AS f1_count, count(collapse_rate) AS collapse_rate_count FROM r LEFT JOIN c USING (run_id) GROUP BY ALL""")
def q15_ablation_summary(spark, d):
    return reports.summary(reports.collapse_rates(_r(spark, d), _h(spark, d)), ["dataset", "method"], ["f1", "collapse_rate"], ["mean", "std", "count"])


@query(f"WITH {R}, {H} SELECT method, iter, {_mean_std('drift')}, count(drift) AS drift_count FROM r JOIN h USING (run_id) GROUP BY ALL")
def q16_drift_curve(spark, d):
    return reports.summary(reports.of_runs(_r(spark, d), _h(spark, d), ["method"]), ["method", "iter"], ["drift"], ["mean", "std", "count"])


@query(f"WITH {R}, c AS (SELECT *, CASE WHEN non_empty_k_final < k OR max_cluster_ratio_final > CASE dataset WHEN 'gas' THEN 0.4 ELSE 0.55 END THEN 1 ELSE 0 END AS collapse FROM r) SELECT dataset, method, eps_tot, eps_proxy_ratio, count(*) AS runs, ~(avg(f1)) AS f1_mean, ~(stddev_samp(f1)) AS f1_std, ~(avg(sse_x)) AS sse_mean, ~(avg(collapse)) AS collapse_rate FROM c GROUP BY ALL", 5)
def q17_budget_split_summary(spark, d):
    return reports.split_summary(reports.final_collapse(_r(spark, d), {"gas": 0.4}))


_EVAL = "ev AS (SELECT dataset, method, eps_tot, count(*) AS runs, avg(f1) AS f1_mean, stddev_samp(f1) AS f1_std, avg(sse_x) AS sse_mean, avg(runtime_ms_total) AS runtime_mean FROM r GROUP BY ALL)"


@query(f"WITH {R}, {_EVAL} SELECT dataset, method, eps_tot, runs, ~(f1_mean) AS f1_mean, ~(f1_std) AS f1_std, ~(sse_mean) AS sse_mean, ~(runtime_mean) AS runtime_mean FROM ev", 5)
def q18_evaluation(spark, d):
    return reports.evaluation(_r(spark, d))


@query(f"WITH {R}, {_EVAL} SELECT dataset, method, eps_tot, ~(f1_mean) AS f1_mean, ~(max(f1_mean) OVER w) AS best, f1_mean >= max(f1_mean) OVER w - 1e-12 AS leads FROM ev WINDOW w AS (PARTITION BY dataset, eps_tot)")
def q19_w1_lead(spark, d):
    return reports.lead(reports.evaluation(_r(spark, d))).select("dataset", "method", "eps_tot", "f1_mean", "best", "leads")


@query(f"WITH {R}, {_EVAL}, o AS (SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY f1_mean DESC, coalesce(f1_std, 0), sse_mean, eps_tot) AS p FROM ev) SELECT dataset, method, eps_tot, ~(f1_mean) AS f1_mean, ~(sse_mean) AS sse_mean FROM o WHERE p = 1", 5)
def q20_a26_best_config(spark, d):
    return reports.best_config(reports.evaluation(_r(spark, d)), ["dataset", "method"], "eps_tot").select("dataset", "method", "eps_tot", "f1_mean", "sse_mean")


_SEVEN = ("f1", "nmi", "ari", "sse_x", "non_empty_k_final", "max_cluster_ratio_final", "runtime_ms_total")


@query(f"WITH {R} SELECT dataset, method, eps_tot, {_mean_std(*_SEVEN)} FROM r GROUP BY ALL", 5)
def q21_compare_summary(spark, d):
    return reports.summary(_r(spark, d), ["dataset", "method", "eps_tot"], list(_SEVEN))


@query(f"WITH {R} SELECT dataset, method, eps_tot, printf('%.3f', avg(f1)) || '±' || coalesce(printf('%.3f', stddev_samp(f1)), 'nan') AS f1_text, printf('%.3f', avg(nmi)) || '±' || coalesce(printf('%.3f', stddev_samp(nmi)), 'nan') AS nmi_text FROM r GROUP BY ALL")
def q22_formatted_summary(spark, d):
    s = reports.summary(_r(spark, d), ["dataset", "method", "eps_tot"], ["f1", "nmi"])
    return s.select("dataset", "method", "eps_tot", reports.mean_pm_std("f1").alias("f1_text"), reports.mean_pm_std("nmi").alias("nmi_text"))


@query(f"WITH {R} SELECT dataset, method, eps_tot, {_mean_std('f1', 'runtime_ms_total')} FROM r WHERE eps_tot IN (0.5, 1.5) GROUP BY ALL")
def q23_key_points(spark, d):
    return reports.summary(_r(spark, d).where(F.col("eps_tot").isin(0.5, 1.5)), ["dataset", "method", "eps_tot"], ["f1", "runtime_ms_total"])


_FIVE = ["view", "click", "error", "purchase", "signup"]


@query(f"""WITH {R}, w AS (SELECT unnest([0.55, 0.95]) AS w), ch AS (SELECT DISTINCT dataset, arg_min(eps_tot, abs(eps_tot - w) * 1000 + eps_tot / 1000) AS eps_tot FROM (SELECT DISTINCT dataset, eps_tot FROM r), w GROUP BY dataset, w),
o AS (SELECT unnest([0, 1, 2, 3, 4]) AS pos, unnest(['view', 'click', 'error', 'purchase', 'signup']) AS method),
s AS (SELECT dataset, eps_tot, method, avg(f1) AS m, stddev_samp(f1) AS sd, avg(ari) AS m2, stddev_samp(ari) AS sd2 FROM r JOIN ch USING (dataset, eps_tot) GROUP BY ALL)
SELECT dataset, eps_tot, method, printf('%.3f', m) || '±' || coalesce(printf('%.3f', sd), 'nan') AS f1_text, printf('%.3f', m2) || '±' || coalesce(printf('%.3f', sd2), 'nan') AS ari_text, row_number() OVER (PARTITION BY dataset, eps_tot ORDER BY round(m, 3) DESC, pos) = 1 AS bold FROM s JOIN o USING (method)""")
def q24_v3_main_table(spark, d):
    return reports.main_table(_r(spark, d), [0.55, 0.95], _FIVE, ["f1", "ari"])


_PAIRS = f"{R}, one AS (SELECT dataset, eps_tot, method, seed, avg(f1) AS f1 FROM r GROUP BY ALL), p AS (SELECT a.dataset, a.eps_tot, seed, a.f1 AS value_a, b.f1 AS value_b FROM one a JOIN one b USING (dataset, eps_tot, seed) WHERE a.method = 'view' AND b.method = 'click')"


@query(f"WITH {_PAIRS} SELECT dataset, eps_tot, seed, ~(value_a) AS value_a, ~(value_b) AS value_b FROM p")
def q25_j1_paired_seeds(spark, d):
    one = _r(spark, d).groupBy("dataset", "eps_tot", "method", "seed").agg(F.avg("f1").alias("f1"))
    return significance.paired_seeds(one, ["dataset", "eps_tot"], F.col("method") == "view", F.col("method") == "click", "f1")


@query(f"WITH {_PAIRS} SELECT dataset, eps_tot, count(*) AS n, ~(avg(value_a - value_b)) AS mean_diff, ~(avg(value_a - value_b) / sqrt(var_samp(value_a - value_b) / count(*))) AS t FROM p GROUP BY ALL", 5)
def q25_a22_paired_t(spark, d):
    return reports.significance_table(_r(spark, d), "view", "click").select("dataset", "eps_tot", "n", "mean_diff", "t")


@query(f"WITH {_PAIRS}, s AS (SELECT dataset, eps_tot, value_a AS v, 1 AS a FROM p UNION ALL SELECT dataset, eps_tot, value_b, 0 FROM p), ranked AS (SELECT *, rank() OVER (PARTITION BY dataset, eps_tot ORDER BY v) + (count(*) OVER (PARTITION BY dataset, eps_tot, v) - 1) / 2 AS rank FROM s) SELECT dataset, eps_tot, count(*) FILTER (a = 1) AS n, ~(sum(rank) FILTER (a = 1) - count(*) FILTER (a = 1) * (count(*) FILTER (a = 1) + 1) / 2) AS u FROM ranked GROUP BY ALL", 5)
def q25_a23_rank_sums(spark, d):
    return reports.significance_table(_r(spark, d), "view", "click").select("dataset", "eps_tot", "n", "u")


@query(f"""WITH {R}, g AS (SELECT dataset, eps_tot, count(f1) FILTER (method = 'view') AS n_a, count(f1) FILTER (method = 'click') AS n_b, avg(f1) FILTER (method = 'view') - avg(f1) FILTER (method = 'click') AS mean_diff,
  var_samp(f1) FILTER (method = 'view') / n_a AS ea, var_samp(f1) FILTER (method = 'click') / n_b AS eb FROM r WHERE method IN ('view', 'click') GROUP BY ALL)
SELECT dataset, eps_tot, n_a, n_b, ~(mean_diff) AS mean_diff, ~(mean_diff / sqrt(ea + eb)) AS t, ~((ea + eb) * (ea + eb) / (ea * ea / (n_a - 1) + eb * eb / (n_b - 1))) AS dof FROM g""", 5)
def q25_a22_welch_t(spark, d):
    r = _r(spark, d).where("method in ('view', 'click')")
    return significance.welch(r, ["dataset", "eps_tot"], F.col("method") == "view", "f1").drop("p_t")


@query()
def q25_significance(spark, d):
    return reports.significance_table(_r(spark, d), "view", "click")


@query(f"""WITH {R}, s AS (SELECT method, eps_tot, printf('%.3f', avg(f1)) AS f, printf('%.3f', avg(nmi)) AS g FROM r WHERE dataset = 'har' GROUP BY ALL)
SELECT method, coalesce(max(f) FILTER (eps_tot = 0.5), '-') AS "f1@0.5", coalesce(max(g) FILTER (eps_tot = 0.5), '-') AS "nmi@0.5", coalesce(max(f) FILTER (eps_tot = 0.8), '-') AS "f1@0.8", coalesce(max(g) FILTER (eps_tot = 0.8), '-') AS "nmi@0.8" FROM s GROUP BY method""")
def q26_v2_wide_table(spark, d):
    return reports.wide_table(_r(spark, d), "har", [0.5, 0.8], ["f1", "nmi"])


@query(f"WITH {R} SELECT method, eps_tot, {_mean_std('runtime_ms_total')} FROM r WHERE dataset = 'gas' GROUP BY ALL")
def q27_runtime_vs_eps(spark, d):
    return reports.curve(_r(spark, d), "gas", "eps_tot", ["runtime_ms_total"])


@query(f"WITH {R} SELECT 'k' AS param, CAST(k AS DOUBLE) AS value, method, {_mean_std('f1')} FROM r GROUP BY ALL UNION ALL SELECT 'eps_proxy_ratio', eps_proxy_ratio, method, {_mean_std('f1')} FROM r GROUP BY ALL")
def q28_sensitivity(spark, d):
    r = _r(spark, d)
    part = lambda p: reports.summary(r.withColumn("param", F.lit(p)).withColumn("value", F.col(p).cast("double")), ["param", "value", "method"], ["f1"])
    return part("k").unionByName(part("eps_proxy_ratio"))


@query(f"WITH {R}, {_EVAL}, b AS (SELECT dataset, min(f1_mean - coalesce(f1_std, 0)) AS a, max(f1_mean + coalesce(f1_std, 0)) AS b FROM ev GROUP BY 1) SELECT dataset, ~(greatest(a - 0.08 * (b - a), 0.0)) AS lo, ~(least(b + 0.08 * (b - a), 0.2)) AS hi FROM b")
def q29_axis_bounds(spark, d):
    return reports.axis_bounds(reports.summary(_r(spark, d), ["dataset", "method", "eps_tot"], ["f1"]), ["dataset"], "f1", 0.0, 0.2)


@query(f"WITH {R}, c AS (SELECT dataset, method, eps_tot, max(seed) AS runs_to, {_mean_std('f1')}, count(f1) AS f1_count FROM r GROUP BY ALL) SELECT dataset, method, eps_tot, f1_mean, f1_std, f1_count FROM c")
def q31_ablation_tables(spark, d):
    return reports.summary(_r(spark, d), ["dataset", "method", "eps_tot"], ["f1"], ["mean", "std", "count"])


# Three forms of logs: other columns, in another order.
_FORMS = ("t,macro_f1,sse,non_empty_k,max_cluster_ratio,runtime_sec", "iter,sse_x,runtime_ms_total,macro_f1", "runtime,max_cluster_ratio_final,non_empty_k_final,macro_f1,t")


@query("""WITH l AS (SELECT event_id, (['har', 'gas'])[CAST(user_id % 2 + 1 AS INT)] AS dataset, event_type AS method, CAST(([0.5, 1.0])[CAST(user_id % 2 + 1 AS INT)] AS DOUBLE) AS eps_tot, CAST(event_id % 7 AS INT) AS seed,
  CAST(event_id % 7 % 3 AS INT) AS form, CASE WHEN event_id % 500 < 3 THEN -1 ELSE 1 END AS t, CASE WHEN event_id % 11 > 0 THEN value / 500 END AS f1, value * 37 AS sse, CAST(event_id % 5 AS DOUBLE) AS non_empty, CASE WHEN event_id % 13 > 0 THEN value / 600 END AS ratio, value * 3 AS ms FROM events),
x AS (SELECT *, row_number() OVER (PARTITION BY dataset, method, eps_tot, seed ORDER BY CASE WHEN t < 0 THEN 3 WHEN f1 IS NOT NULL AND (form > 0 OR ratio IS NOT NULL) THEN 1 ELSE 0 END DESC, event_id DESC) AS p FROM l)
SELECT dataset, method, eps_tot, seed, ~(f1) AS macro_f1, ~(CASE WHEN form < 2 THEN sse END) AS sse, ~(CASE WHEN form <> 1 THEN non_empty END) AS non_empty_k, ~(CASE WHEN form <> 1 THEN ratio END) AS max_cluster_ratio, ~(CASE form WHEN 2 THEN ms ELSE ms / 1000 END) AS runtime_sec FROM x WHERE p = 1""")
def q30_run_collection(spark, d):
    """Events as a tree of run logs of three forms, written and collected."""
    u, i, v = F.col("user_id"), F.col("event_id"), F.col("value")
    form = i % 7 % 3
    e = tables.table(spark, d, "events").select(
        F.element_at(F.array(F.lit("har"), F.lit("gas")), (u % 2 + 1).cast("int")).alias("dataset"), F.col("event_type").alias("method"), F.element_at(F.array(F.lit(0.5), F.lit(1.0)), (u % 2 + 1).cast("int")).alias("eps"), (i % 7).cast("int").alias("seed"), i.alias("line"),
        F.when(form == 0, _FORMS[0]).when(form == 1, _FORMS[1]).otherwise(_FORMS[2]).alias("header"), F.when(i % 500 < 3, -1).otherwise(1).alias("t"), F.when(i % 11 > 0, v / 500).alias("macro_f1"), (v * 37).alias("sse"), (i % 5).cast("double").alias("non_empty_k"), F.when(i % 13 > 0, v / 600).alias("max_cluster_ratio"), (v * 3).alias("runtime"),
    ).withColumns({"iter": F.col("t"), "sse_x": F.col("sse"), "non_empty_k_final": F.col("non_empty_k"), "max_cluster_ratio_final": F.col("max_cluster_ratio"), "runtime_sec": F.col("runtime") / 1000, "runtime_ms_total": F.col("runtime")})
    folder = storage.new_folder(spark, "logs")
    sinks.write_run_logs(e, folder).count()
    return runs.collect_runs(spark, f"{folder}/*/*/eps*_seed*.csv")


@query(f"""WITH {R}, t AS (SELECT d.dataset, m.method, e.eps, CAST(s.range AS INT) AS seed FROM (SELECT unnest(['har', 'gas', 'new']) AS dataset) d, (SELECT unnest(['view', 'click', 'fresh']) AS method) m, (SELECT CAST(unnest([0.5, 1.0]) AS DOUBLE) AS eps) e, range(25) s)
SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.dataset = t.dataset AND r.method = t.method AND r.eps_tot = t.eps AND r.seed = t.seed)""")
def q33_resume(spark, d):
    todo = spark.createDataFrame([tuple(t.values()) for t in methods.tasks(["har", "gas", "new"], ["view", "click", "fresh"], [0.5, 1.0], range(25))], "dataset string, method string, eps double, seed int")
    return runs.missing_tasks(todo, _r(spark, d).withColumnRenamed("eps_tot", "eps"))


@query(f"WITH {R}, c AS (SELECT dataset, method, eps_tot, avg(f1) AS a, stddev_samp(f1) AS b, avg(sse_x) AS c, stddev_samp(sse_x) AS d FROM r GROUP BY ALL) SELECT dataset, method, eps_tot, printf('%.3f', a) || '±' || coalesce(printf('%.3f', b), '--') AS f1, printf('%.3e', c) || '±' || coalesce(printf('%.3e', d), '--') AS sse_x FROM c")
def q31_formatted_ablation(spark, d):
    return reports.formatted(reports.summary(_r(spark, d), ["dataset", "method", "eps_tot"], ["f1", "sse_x"]), ["dataset", "method", "eps_tot"], ["f1", "sse_x"])


@query(f"WITH {H} SELECT run_id, iter - 1 AS iter, tie, ~(drift) AS drift FROM h WHERE iter >= 1")
def f8_iteration_rows(spark, d):
    return reports.iterations(_h(spark, d).withColumn("iter", F.col("iter") - 1).withColumnRenamed("iter", "t")).select("run_id", "iter", "tie", "drift")


@query(f"WITH {R} SELECT run_seed, count(*) AS runs FROM (SELECT seed AS run_seed, k, method FROM r) WHERE run_seed IN (SELECT seed FROM r WHERE method IN ('view', 'purchase') GROUP BY seed HAVING count(DISTINCT method) = 2) GROUP BY 1")
def f9_seeds_with_methods(spark, d):
    r = _r(spark, d)
    return r.join(reports.datasets_with(r, ["view", "purchase"], "seed"), "seed").groupBy(F.col("seed").alias("run_seed")).agg(F.count("*").alias("runs"))


@query("SELECT l_orderkey, l_linenumber, ~(greatest(l_discount * 2, 0.05)) AS eps_proxy, ~(2 - greatest(l_discount * 2, 0.05)) AS eps_left FROM lineitem")
def c31_proxy_budgets(spark, d):
    l = tables.table(spark, d, "lineitem")  # noqa: E741
    split = {r["l_discount"]: methods.proxy_budget(2.0, r["l_discount"], 0.05) for r in l.select("l_discount").distinct().collect()}  # eleven ratios
    pairs = spark.createDataFrame([(x, *v) for x, v in split.items()], "l_discount double, eps_proxy double, eps_left double")
    return l.join(pairs, "l_discount").select("l_orderkey", "l_linenumber", "eps_proxy", "eps_left")


def _boosted_sql(k: int, plan: list[float], eps: float, seed: str, above: float, boost: float) -> str:
    """Noisy k-means under a schedule that is rescaled to what is left and raised where a cluster holds too many rows."""
    after = schedules.remaining_after(plan)
    out = [f"WITH {E}", "z AS MATERIALIZED (SELECT row_id, dim, v * least(1, 1 / greatest(sqrt(n2), 1e-12)) AS v FROM el JOIN (SELECT row_id, sum(v * v) AS n2 FROM el GROUP BY 1) USING (row_id))", f"left0 AS (SELECT CAST({eps!r} AS DOUBLE) AS x)"]
    out.append(f"c0 AS MATERIALIZED (SELECT CAST(dense_rank() OVER (ORDER BY row_id) - 1 AS INT) AS j, dim, v AS w FROM z WHERE row_id IN (SELECT row_id FROM e ORDER BY row_id LIMIT {k}))")
    for t, planned in enumerate(plan):
        out.append(f"a{t} AS MATERIALIZED (SELECT row_id, j FROM (SELECT row_id, j, row_number() OVER (PARTITION BY row_id ORDER BY d, j) AS p FROM (SELECT row_id, j, sum((v - w) * (v - w)) AS d FROM z JOIN c{t} USING (dim) GROUP BY ALL)) WHERE p = 1)")
        out.append(f"r{t} AS MATERIALIZED (SELECT j, coalesce(n, 0) AS raw FROM (SELECT DISTINCT j FROM c{t}) LEFT JOIN (SELECT j, count(*) AS n FROM a{t} GROUP BY 1) USING (j))")
        out.append(f"e{t} AS MATERIALIZED (SELECT least(greatest({planned!r} * x / {after[t]!r} * CASE WHEN (SELECT min(raw) = 0 OR max(raw) / sum(raw) > {above} FROM r{t}) THEN {boost} ELSE 1 END, 1e-8), x) AS now, x FROM left{t})")
        out.append(f"left{t + 1} AS MATERIALIZED (SELECT x - now AS x FROM e{t})")
        now = f"(SELECT now FROM e{t})"
        cnt = _laplace(f"1 / ({now} * 0.2)", _q(seed), _q(t), _q("cnt"), _v("j"))
        out.append(f"n{t} AS MATERIALIZED (SELECT j, raw + {cnt} AS n FROM r{t})")
        noisy = _laplace(f"16.0 / ({now} * 0.8)", _q(seed), _q(t), _q("sum"), _v("j"), _v("dim"))
        out.append(f"c{t + 1} AS MATERIALIZED (SELECT j, dim, (coalesce(s, 0) + {noisy}) / greatest(n, 1) AS w FROM c{t} JOIN n{t} USING (j) LEFT JOIN (SELECT j, dim, sum(v) AS s FROM a{t} JOIN z USING (row_id) GROUP BY ALL) USING (j, dim))")
    rows = [f"SELECT {t} AS iter, ~((SELECT now FROM e{t})) AS eps_used, ~({planned!r}) AS eps_base, 'scheduled' AS guard_state, ~((SELECT sum((v - w) * (v - w)) FROM a{t} JOIN z USING (row_id) JOIN c{t + 1} USING (j, dim))) AS sse_z, ~((SELECT max(raw) / sum(raw) FROM r{t})) AS max_cluster_ratio" for t, planned in enumerate(plan)]
    return ",\n".join(out) + "\n" + "\nUNION ALL ".join(rows)


_PLAN = schedules.strong_contrast(500.0, 3, 0.7, 0.7)


@query(_boosted_sql(5, _PLAN, 500.0, "s1", 0.2, 1.3), 4)
def c12_boosted_history(spark, d):
    z = prep.row_clip(_e(spark, d), 1.0).persist()
    fit = kmeans.dp_kmeans(z, _first_rows(z, 5), 3, 500.0, 1.0, "s1", schedule=_PLAN, boost_above=0.2)
    z.unpersist()
    return fit.history_frame(spark).select("iter", "eps_used", "eps_base", "guard_state", "sse_z", "max_cluster_ratio")
