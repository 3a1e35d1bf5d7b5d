"""Runs, sources, sinks and streams end to end."""

import itertools
import os
import random
import threading
import time

import numpy as np
import psutil
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from noisefold import catalog
from noisefold.functions import rng
from noisefold.operators import alternatives, kmeans, metrics, noise, prep, ranks, seeding, stats
from noisefold.plans import grid, methods
from noisefold.sources import lines, runs, sinks, synthetic, tables, text
from noisefold.streaming import batches

QUICK = {"steps": 3, "top_m": 8, "pca_r": 4, "proxy_dim": 3, "restarts": 1, "proxy_least": 50}


@pytest.fixture(scope="module")
def blobs(spark):
    return synthetic.blobs(spark, 300, 20, 3, seed=0).persist()


def test_clusters_found_at_a_large_budget(blobs):
    row, fit, out = methods.run(blobs, "blobs", "dpk_kpp", 3, 1e6, 0, **(QUICK | {"clip": 100.0}))
    assert row["f1"] > 0.99 and row["ari"] > 0.99 and row["non_empty_k_final"] == 3
    assert out.count() == 300


@pytest.mark.parametrize("name", sorted(methods.METHODS))
def test_every_method_spends_at_most_its_budget(blobs, name):
    row, fit, _ = methods.run(blobs, "blobs", name, 3, 5.0, 1, **QUICK)
    assert sum(h["eps_used"] for h in fit.history) <= row["eps_iter"] + 1e-9
    assert row["eps_topm"] + row["eps_pca"] + row["eps_proxy"] + row["eps_iter"] == pytest.approx(5.0)


def test_runs_repeat(blobs, spark):
    a, b = (methods.run(blobs.repartition(n), "blobs", "dpk", 3, 5.0, 1, **QUICK)[1].centroids for n in (1, 5))
    np.testing.assert_allclose(a, b, rtol=1e-9)


def test_statistics_give_the_errors(blobs):
    x = np.array([r["features"] for r in blobs.orderBy("row_id").collect()])
    c = x[:4]
    s = stats.cluster_sums(blobs, c)
    at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert s.n.tolist() == np.bincount(at, minlength=4).tolist()
    assert s.sse(c) == pytest.approx(((x - c[at]) ** 2).sum())
    assert s.sse_own() == pytest.approx(sum(((x[at == j] - x[at == j].mean(0)) ** 2).sum() for j in range(4) if (at == j).any()))


def test_feedback_stops_when_spent(blobs):
    z = prep.row_clip(prep.standardise(blobs), 3.0).persist()
    fit = kmeans.dp_kmeans(z, seeding.random_rows(z, 3, "s"), 20, 1.0, 3.0, "s", mode="feedback_v3")
    assert len(fit.history) < 20 and sum(h["eps_t"] for h in fit.history) == pytest.approx(1.0)


def test_text_matrix(spark, tmp_path):
    for part, rows in (("train", ["  1.0  2 ", "3 4"]), ("test", ["5e0 6"])):
        os.makedirs(tmp_path / part)
        (tmp_path / part / f"X_{part}.txt").write_text("\n".join(rows) + "\n")
        (tmp_path / part / f"y_{part}.txt").write_text("\n".join(["2"] * len(rows)) + "\n")
    got = text.split_matrix(spark, str(tmp_path), shape=(3, 2)).orderBy("row_id").collect()
    assert [r["features"] for r in got] == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]] and {r["label"] for r in got} == {1}
    with pytest.raises(ValueError):
        text.split_matrix(spark, str(tmp_path), shape=(4, 2))


def test_sparse_files(spark, tmp_path):
    for n in (1, 2, 10):
        (tmp_path / f"batch{n}.dat").write_text(f"3;1.5 1:{n} junk 4:2 4:7\n\n")
    got = {r["batch_id"]: r for r in text.sparse_files(spark, f"{tmp_path}/*.dat", 5).collect()}
    assert {b: r["features"][0] for b, r in got.items()} == {1: 1.0, 2: 10.0, 3: 2.0}  # names in lexicographic order
    assert got[1]["features"] == [1.0, 0.0, 0.0, 7.0, 0.0] and got[1]["label"] == 2 and got[1]["concentration"] == 1.5
    for bad in ("3 1:1", "3;1 9:1"):
        with pytest.raises(Exception):
            text.sparse_rows(spark.createDataFrame([(bad,)], "value string"), 5).collect()


def test_table_cells(spark):
    lines = spark.createDataFrame([("a & 0.5 & x \\\\",), ("\\hline",), ("a & b & c \\\\",), ("a & 1",)], "value string")
    got = text.table_cells(lines, 3).collect()
    assert [(r["eps"], r["cells"]) for r in got] == [(0.5, ["a", "0.5", "x"])]


def test_run_logs(spark, tmp_path):
    for m in ("known", "other"):
        os.makedirs(tmp_path / "har" / m)
        (tmp_path / "har" / m / "eps0.5_seed3.csv").write_text("t,eps_t,macro_f1,runtime_ms\n0,0.1,,\n1,0.2,,\n-1,,0.7,1500\n")
    logs = runs.run_logs(spark, f"{tmp_path}/*/*/*.csv", {"known": "K"})
    last = runs.final_row(logs, ["dataset", "method", "eps", "seed"], "line", ["macro_f1"])
    row = last.withColumn("sec", runs.runtime_seconds(last.select("runtime_ms"))).collect()
    assert [(r["dataset"], r["method"], r["eps"], r["seed"], r["macro_f1"], r["sec"]) for r in row] == [("har", "K", 0.5, 3, 0.7, 1.5)]


def test_run_logs_read_columns_by_each_files_header(spark, tmp_path):
    files = {
        "a b/m+1/eps1.0_seed0.csv": "t,macro_f1,sse\n0,0.5,180.0\n1,0.6,170.0\n",
        "a b/m+1/eps1.0_seed1.csv": "sse,t,extra,macro_f1\n180.0,0,x,0.5\n\n170.0,-1,\"y, z\",0.6\n160.0,2,w,0.7\n",
        "d/m/eps2_seed10.csv": "\ufeffiter,sse_x,runtime_ms_total,macro_f1,runtime_sec\r\n0,9,1500,nan,\r\n1,8,1600,0.4,2.5\r\n2,7,1700,,3.5\r\n",
        "d/m/eps0.5_seed2.csv": "runtime,non_empty_k_final,max_cluster_ratio_final\n7,3,oops\n",
        "d/m/eps0.5_seed3.csv": "t,macro_f1\n",
        "d/m/eps0.5_seed4.csv": "",
        "d/m/epsx_seed4.csv": "t,macro_f1\n1,2\n",
        "d/m/eps1.2.3_seed4.csv": "t,macro_f1\n1,2\n",
    }
    for name, body in files.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(body.encode())
    rows = {(r["dataset"], r["method"], r["eps"], r["seed"], r["line"]): r for r in runs.run_logs(spark, f"{tmp_path}/*/*/*.csv").collect()}
    assert len(rows) == 9 and {k[:2] for k in rows} == {("a b", "m+1"), ("d", "m")}
    assert [(rows["a b", "m+1", 1.0, s, at]["macro_f1"], rows["a b", "m+1", 1.0, s, at]["sse"], rows["a b", "m+1", 1.0, s, at]["t"]) for s, at in ((0, 1), (1, 1))] == [(0.5, 180.0, 0)] * 2
    assert rows["a b", "m+1", 1.0, 1, 3]["macro_f1"] == 0.6 and rows["d", "m", 2.0, 10, 1]["macro_f1"] is None and rows["d", "m", 0.5, 2, 1]["max_cluster_ratio_final"] is None
    got = {(r["dataset"], r["eps_tot"], r["seed"]): tuple(r)[4:] for r in runs.collect_runs(spark, f"{tmp_path}/*/*/*.csv", {"m+1": "one", "m": "two"}).collect()}
    assert got == {("a b", 1.0, 0): (0.6, 170.0, None, None, None), ("a b", 1.0, 1): (0.6, 170.0, None, None, None), ("d", 2.0, 10): (0.4, 8.0, None, None, 2.5), ("d", 0.5, 2): (None, None, 3.0, None, 7.0)}


def test_run_logs_parse_a_line_once(spark, tmp_path):
    """Whatever the number of columns: once the headers, once the lines."""
    os.makedirs(tmp_path / "d" / "m")
    (tmp_path / "d" / "m" / "eps1_seed2.csv").write_text("t,iter,macro_f1,sse,non_empty_k\n1,2,0.5,3,4\n")
    logs = runs.run_logs(spark, f"{tmp_path}/*/*/*.csv")
    assert logs._jdf.queryExecution().analyzed().toString().count("from_csv") <= 2
    assert [(r["eps"], r["seed"], r["macro_f1"], r["non_empty_k"]) for r in logs.collect()] == [(1.0, 2, 0.5, 4.0)]


def test_lines_of_split_files(spark, tmp_path):
    r = random.Random(4)
    texts = {f"f{i}.txt": ["".join(r.choice("ab \u00e9") for _ in range(r.randint(0, 60))) for _ in range(n)] for i, n in enumerate((0, 1, 3000, 700))}
    for name, rows in texts.items():
        (tmp_path / name).write_text("\n".join(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        found = lines.numbered(spark, f"{tmp_path}/*.txt")
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 8
        got = {}
        for x in found.collect():
            got.setdefault(os.path.basename(x["path"]), {})[x["line"]] = x["value"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: v if v[-1:] != [""] else v[:-1] for k, v in texts.items() if v}


def test_first_by_draw_is_exact(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") * 7).alias("row_id"))
    want = sorted(((rng.uniform("s", 1, i * 7), i * 7) for i in range(5000)))
    for limit, n in ((10, 11), (10, 2500), (40, 4999), (10, 5000), (10, 6000), (10_000, 30)):
        monkeypatch.setattr(noise, "SORTED", limit)
        assert sorted(r["row_id"] for r in noise.first_by_draw(df, n, "s", 1).collect()) == sorted(i for _, i in want[:n])
    cuts = noise.cuts_by_draw(df, {3: ("s|1", 7), 5: ("t", 4000), 6: ("u", 9999)}, buckets=8)
    assert cuts[3] == want[6] and cuts[5] == sorted((rng.uniform("t", i * 7), i * 7) for i in range(5000))[3999] and set(cuts) == {3, 5}


def test_grid_gives_the_rows_of_single_runs(spark, tiny):
    df = catalog._e(spark, tiny).persist()
    how = QUICK | {"restarts": 2, "proxy_share": 0.6, "proxy_least": 20}
    todo = [("dpk", 50.0, 0), ("dpk_full", 50.0, 1), ("dpk_full", 200.0, 1), ("dpk_pca", 50.0, 0), ("dpk_proxy_rr", 200.0, 1), ("dpk_random_features", 50.0, 0), ("dpk_fb_v2", 200.0, 0), ("dpk_strong", 50.0, 1)]
    for row, (name, eps, seed) in zip(grid.run_all(df, "e", 4, todo, **how), todo):
        one = methods.run(df, "e", name, 4, eps, seed, **how)[0]
        assert row.keys() == one.keys()
        for key, value in one.items():
            if not key.startswith("runtime"):
                assert row[key] == (pytest.approx(value, rel=1e-7, abs=1e-9) if isinstance(value, float) else value), (name, key)
    bare = df.withColumn("label", F.lit(None))
    assert grid.run_all(bare, "e", 4, todo[:1], **how)[0]["ari"] is None and grid.run_all(df, "e", 4, [], **how) == []
    df.unpersist()


def test_radius_graph_in_metric_cells(spark, monkeypatch):
    """All pairs of clustered rows, with hot rings split, and few compared; rows all alike too."""
    monkeypatch.setattr(alternatives, "BLOCK", 50)
    r = np.random.default_rng(1)
    x = r.uniform(-10, 10, (20, 6))[r.integers(0, 20, 900)] + r.normal(0, 0.3, (900, 6))
    x[:150] = x[0]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>").persist()
    got = {(p["a"], p["b"]): p["distance"] for p in alternatives.radius_graph(points, 0.5).collect()}
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert set(got) == set(zip(*(k.tolist() for k in np.nonzero(np.triu(far <= 0.5, 1))))) and all(abs(far[k] - d) < 1e-12 for k, d in got.items())
    cells = alternatives.radius_cells(points, 0.5, alternatives.pivots(points, 900)).groupBy("cell", "ring").agg(F.sum(F.col("home").cast("long")).alias("h"), F.sum((~F.col("home")).cast("long")).alias("v"))
    assert cells.agg(F.sum(F.col("h") * F.col("v"))).first()[0] < 0.2 * 900 * 899 / 2
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(120)], points.schema)
    assert alternatives.radius_graph(same, 0.0).count() == 120 * 119 // 2 and alternatives.radius_graph(points.limit(0), 1.0).count() == 0
    points.unpersist()


def test_ranks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET", 40)
    df = spark.range(1000).select((F.col("id") * 3).alias("row_id"), (F.col("id") % 321 * 5 - 7).cast("int").alias("label"))
    placed, n = ranks.by_draw(df, "p", "s")
    want = sorted((rng.uniform("s", 3 * i), 3 * i) for i in range(1000))
    assert n == 1000 and [r["row_id"] for r in placed.orderBy("p").collect()] == [i for _, i in want]
    odd = df.unionByName(spark.createDataFrame([(-1, None)], df.schema))
    assert {(r["label"], r["p"]) for r in ranks.distinct_values(odd, "label", "p").collect()} == {(i * 5 - 7, i) for i in range(321)}
    assert sorted({r["label"] for r in prep.relabel(odd).collect()}) == list(range(321))
    for n, k in ((10, 3), (2, 5), (12, 4)):
        tiles = [r["t"] for r in spark.range(n).select(ranks.tile(F.col("id"), n, k).alias("t")).collect()]
        assert tiles == [r["t"] for r in spark.range(n).select((F.ntile(k).over(Window.orderBy("id")) - 1).alias("t")).collect()]


def test_alignment_is_the_smallest_best_one():
    r = np.random.default_rng(0)
    for _ in range(150):
        n = int(r.integers(1, 7))
        t = r.integers(0, r.integers(1, 5) + 1, (n, n))
        total = lambda p: sum(t[i, p[i]] for i in range(n))  # noqa: B023, E731
        best = max(map(total, itertools.permutations(range(n))))
        assert tuple(metrics.match(t)) == min(p for p in itertools.permutations(range(n)) if total(p) == best)
    begun = time.perf_counter()
    assert sorted(metrics.match(r.integers(0, 3, (200, 200)))) == list(range(200))
    assert time.perf_counter() - begun < 10  # solving it anew for each tried pair takes minutes


def test_agreement_of_tables(spark):
    for rows in ([(0, 0, 5), (0, 1, 2), (1, 1, 7)], [(0, 0, 4)], [(0, 0, 1), (1, 1, 1)], [(3, -1, 9), (2, 4, 1), (2, -1, 3)]):
        one = metrics.agreement(spark.createDataFrame(rows, "label int, cluster int, n long")).first()
        assert metrics.agreement_of(rows) == pytest.approx((one["ari"], one["nmi"]))


def test_aliases_and_upsert(spark, tmp_path):
    a = spark.createDataFrame([("d", "m", 1.0, 0, 0.5, 9.0, 2000.0)], "Dataset string, algo string, eps_tot double, seed int, f1 double, sse_x double, runtime_ms_total double")
    got = runs.with_aliases(a)
    assert got.first()["runtime"] == 2.0 and got.columns == list(runs.ALIASES)
    keys, path = ["dataset", "method", "eps", "seed"], str(tmp_path / "results")
    sinks.upsert_results(got, path, keys)
    sinks.upsert_results(got.withColumn("macro_f1", F.lit(0.9)).unionByName(got.withColumn("seed", F.lit(1))), path, keys)
    assert {r["seed"]: r["macro_f1"] for r in spark.read.parquet(path).collect()} == {0: 0.9, 1: 0.5}
    sinks.write_latex(got, ["dataset", "macro_f1"], str(tmp_path / "t.tex"))
    sinks.write_markdown(got, str(tmp_path / "t.md"))
    assert "d & 0.5 \\\\" in (tmp_path / "t.tex").read_text() and "| d | m |" in (tmp_path / "t.md").read_text()
    assert len(runs.config_hash({"b": 1, "a": 2})) == 12


def test_history_is_partitioned_by_run(spark, tmp_path, blobs):
    row, fit, _ = methods.run(blobs, "blobs", "dpk", 3, 5.0, 1, **QUICK)
    sinks.write_history(fit.history_frame(spark), str(tmp_path / "h"), {"method": "dpk", "seed": 1})
    got = spark.read.parquet(str(tmp_path / "h"))
    assert got.count() == 3 and {"method", "seed"} <= set(got.columns)
    assert methods.results_frame(spark, [row]).first()["method"] == "dpk"


def test_stream_equals_batches(spark, tmp_path):
    df = synthetic.stream(spark, 120, 4, 3, 2, seed=5).persist()
    for b in (0, 1):
        df.where(F.col("batch_id") == b).drop("batch_id").coalesce(1).write.parquet(str(tmp_path / f"in/b{b}"))
    got = {}
    stream = spark.readStream.schema("row_id long, features array<double>, label int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    batches.cluster_stream(stream, str(tmp_path / "c"), got.__setitem__, "s", "dpk", 3, 5.0, 0, **QUICK).awaitTermination()
    one = batches.run_batches(df, "s", "dpk", 3, 5.0, 0, **QUICK)
    assert len(got) == 2 == one["stream_batches"]
    assert np.mean([r["f1"] for r in got.values()]) == pytest.approx(one["f1"])


def test_tuning(blobs):
    best, tried = methods.tune(blobs, "blobs", "dpk_kpp", 3, [{"steps": 1}, {"steps": 3}], [50.0], [0], **QUICK)
    assert best in ({"steps": 1}, {"steps": 3}) and len(tried) == 2


def test_merged_configuration():
    assert methods.merged({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}, "b": 4}) == {"a": {"x": 1, "y": 3}, "b": 4}
    assert methods.resolve("no such").init == "public_random"
    assert methods.resolve("dpk_fb_v2", {"feedback": {"beta": 0.5}}).feedback == {"recovery": 0.0, "beta": 0.5}


def test_lineitem_reaches_the_scan_pruned(spark, tiny):
    plan = tables.lineitem_features(spark, tiny).where("label = 1")._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan.split("ReadSchema")[1]


def test_radius_joins_where_all_is_near(spark, monkeypatch):
    """Rows that are within a few radii of each other are sent once for each pair of blocks, and batches of links stay small; degrees and forests are those of the graph. The same in cells."""
    monkeypatch.setattr(alternatives, "BLOCK", 100)
    monkeypatch.setattr(alternatives, "CELLS", 1 << 10)
    r = np.random.default_rng(3)
    dense = r.normal(0, 1, (700, 16))
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    dense[:40] = dense[0]
    apart = r.uniform(-50, 50, (30, 3))[r.integers(0, 30, 700)] + r.normal(0, 0.3, (700, 3))
    for x, radius, blocks in ((dense, 0.8, True), (apart, 0.5, False)):
        points = spark.createDataFrame([(i, v.tolist(), bool(i % 3)) for i, v in enumerate(x)], "row_id long, features array<double>, spreads boolean").persist()
        far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        want = set(zip(*(k.tolist() for k in np.nonzero(np.triu(far <= radius, 1)))))
        groups = alternatives._radius_groups(points.select("row_id", "features"), radius)
        assert groups.where("cell is null").isEmpty() != blocks and (not blocks or groups.count() == 700 * 7)
        assert groups.groupBy("cell", "ring", "i", "j", "side").count().agg(F.max("count")).first()[0] < 160
        got = alternatives.radius_graph(points, radius).collect()
        assert len(got) == len(want) and {(p["a"], p["b"]) for p in got} == want and all(p["distance"] == pytest.approx(far[p["a"], p["b"]], abs=1e-12) for p in got)
        degrees = {p["row_id"]: p["n"] for p in alternatives.radius_degrees(points, radius).collect()}
        assert degrees == {i: int(n) for i, n in enumerate((far <= radius).sum(1) - 1) if n}

        def names(links):
            label = list(range(700))
            for _ in range(700):
                before = list(label)
                for a, b in links:
                    label[a] = label[b] = min(label[a], label[b])
                if label == before:
                    return label

        forest = {(p["a"], p["b"]) for p in alternatives.radius_forest(points, radius).collect()}
        assert names(forest) == names(want)
        some = alternatives.radius_forest(points, radius, "spreads").collect()
        beside = [(p["a"], p["b"]) for p in some if (p["a"] % 3 > 0) != (p["b"] % 3 > 0)]
        assert len(beside) == len(set(beside)) and set(beside) == {k for k in want if (k[0] % 3 > 0) != (k[1] % 3 > 0)}
        inner = lambda links: names({k for k in links if k[0] % 3 and k[1] % 3})
        assert inner({(p["a"], p["b"]) for p in some}) == inner(want) and all(p["a"] % 3 or p["b"] % 3 for p in some)
        points.unpersist()


def test_radius_graph_takes_little_memory_where_all_is_near(spark):
    """3,000 rows, as many as the density scan takes, at a radius that a twentieth of the pairs are within: no worker grows by more than 300 MB."""
    x = np.random.default_rng(8).normal(0, 1, (3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = np.sort(np.concatenate([np.sqrt(((x[i + 1 :] - x[i]) ** 2).sum(1)) for i in range(len(x))]))
    radius = float(near[len(near) // 20])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>").persist()
    points.count()

    def held():
        out = {}
        for p in psutil.Process().children(recursive=True):
            try:
                if "python" in p.name():
                    out[p.pid] = p.memory_info().rss
            except psutil.Error:
                pass
        return out

    before, most, done = held(), {}, threading.Event()

    def watch():
        while not done.wait(0.05):
            for pid, rss in held().items():
                most[pid] = max(most.get(pid, 0), rss)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        links = alternatives.radius_graph(points, radius).count()
    finally:
        done.set()
        watcher.join()
        points.unpersist()
    assert links == (near <= radius).sum()
    assert most and max(rss - before.get(pid, 0) for pid, rss in most.items()) < 300e6


def whole_graph(spark, tiny):
    rows = catalog._e(spark, tiny).select("row_id", "features").orderBy("row_id").collect()
    x = np.array([r["features"] for r in rows], float)
    i, j = np.triu_indices(len(x), 1)
    return [r["row_id"] for r in rows], i, j, np.concatenate([np.sqrt(((x[k + 1 :] - x[k]) ** 2).sum(1)) for k in range(len(x))])


def test_radius_graph_is_of_all_rows(spark, tiny):
    ids, i, j, near = whole_graph(spark, tiny)
    got = {(r["a"], r["b"]): r["distance"] for r in catalog.queries()["j5_radius_graph_whole"](spark, tiny).collect()}
    assert set(got) == {(ids[i[k]], ids[j[k]]) for k in np.flatnonzero(near <= 1.2)}
    assert all(got[ids[i[k]], ids[j[k]]] == pytest.approx(near[k], abs=1e-5) for k in np.flatnonzero(near <= 1.2))


def test_distance_quantiles_are_of_all_rows(spark, tiny):
    _, _, _, near = whole_graph(spark, tiny)
    got = [r["radius"] for r in catalog.queries()["a24_distance_quantiles_2000"](spark, tiny).orderBy("pos").collect()]
    assert got == pytest.approx(list(np.quantile(near, [0.01, 0.02, 0.05])), abs=1e-5)


def test_comparison_queries_run_the_whole_operators(spark, tiny, monkeypatch):
    given = {}
    monkeypatch.setattr(catalog.alternatives, "density", lambda df, *a, **how: (given.__setitem__("density", how), (df.withColumn("cluster", F.lit(0)), None, {}))[1])
    monkeypatch.setattr(catalog.alternatives, "search_schedule", lambda *a, **how: (given.__setitem__("search", how), ([1.0], 1.0))[1])
    catalog.queries()["c32_density"](spark, tiny)
    catalog.queries()["c34_schedule_search"](spark, tiny)
    assert given == {"density": {}, "search": {}}


def test_a_killed_grid_goes_on(spark, blobs, tmp_path, monkeypatch):
    """The second group fails: the first stays, and the next call does only what is missing; each run is there once, with the row of an unbroken grid."""
    folder, done, real = str(tmp_path / "grid"), [], grid.run_all

    def failing(df, dataset, k, group, **config):
        if len(done) == 1 and not done[0][1]:
            raise RuntimeError("lost")
        done.append([list(group), False])
        return real(df, dataset, k, group, **config)

    asked = ("blobs", 3, ["dpk", "dpk_kpp"], [5.0], [0, 1])
    monkeypatch.setattr(grid, "run_all", failing)
    with pytest.raises(RuntimeError):
        methods.resumed(blobs, *asked, folder, at_once=2, **QUICK)
    (tmp_path / "grid/group-half").mkdir()  # an attempt that didn't get to its success mark
    done[0][1] = True
    rows = methods.resumed(blobs, *asked, folder, at_once=2, **QUICK).collect()
    assert [len(g) for g, _ in done] == [2, 2] and not set(done[0][0]) & set(done[1][0])
    monkeypatch.setattr(grid, "run_all", real)
    whole = methods.experiment(blobs, *asked, **QUICK).collect()
    key = lambda r: (r["method"], r["seed"])
    assert sorted(map(key, rows)) == sorted(map(key, whole))
    for a, b in zip(sorted(rows, key=key), sorted(whole, key=key)):
        assert a["config_hash"] == b["config_hash"] and a["sse_x"] == pytest.approx(b["sse_x"]) and a["f1"] == pytest.approx(b["f1"])
    methods.resumed(blobs, *asked, folder, **QUICK)
    assert len(done) == 2  # nothing was left to do
    few = methods.resumed(blobs, "blobs", 3, ["dpk"], [5.0], [1], folder, **QUICK)
    assert [key(r) for r in few.collect()] == [("dpk", 1)]  # others of the folder aren't asked for


def test_configurations_and_tables_as_text(spark, tmp_path):
    value = {"b": [1, 2.5], "a": {"x": None}}
    sinks.write_json(value, str(tmp_path / "c.json"))
    assert runs.read_config(str(tmp_path / "c.json")) == value and (tmp_path / "c.json").read_text().index('"a"') < (tmp_path / "c.json").read_text().index('"b"')
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(value))
    assert runs.read_config(str(tmp_path / "c.yaml")) == value


def test_csv_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', 0.5), (2, None, None)], "n int, t string, x double")
    sinks.write_csv(df, str(tmp_path / "t"))
    sinks.write_csv(df, str(tmp_path / "t"))  # replaced, not appended
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "t"), header=True, schema=df.schema, escape='"').collect())) == [(1, 'a,"b"', 0.5), (2, None, None)]
