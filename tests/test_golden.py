"""Values worked out by hand from the documented formulas."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noisefold.functions import rng, schedules
from noisefold.operators import alternatives, graphs, metrics, noise, ranks, reduction, seeding, significance, stats
from noisefold.plans import methods, reports
from noisefold.sources import runs, synthetic

Y, P = [0, 0, 1, 1, 2, 2], [1, 1, 0, 0, 0, 2]


def test_keyed_draw():
    assert int(rng.uniform("seed0", "cnt", 3) * 2**52) == 2394816968289288


def test_metrics(spark):
    df = spark.createDataFrame(list(zip(Y, P)), "label int, cluster int")
    q = metrics.quality(df)
    assert q["f1"] == pytest.approx(0.822222, abs=1e-6)
    assert q["ari"] == pytest.approx(0.444444, abs=1e-6)
    assert q["nmi"] == pytest.approx(0.739667, abs=1e-6)
    d = stats.diagnostics(stats.cluster_table(df, 3)).first()
    assert (d["non_empty_k"], d["max_cluster_ratio"]) == (3, 0.5)
    assert d["cluster_entropy"] == pytest.approx(1.011404, abs=1e-6)


def test_feedback_plans():
    def plan(name, drift=0.0):
        f = schedules.Feedback(1.0, 20, schedules.RULES[name])
        out = []
        for _ in range(20):
            out.append(f.next()["eps"])
            f.drift = drift
        return out

    assert sum(plan("feedback_v3")) == pytest.approx(1.390991, abs=1e-6)
    assert sum(plan("feedback_v3", 3.0)) == pytest.approx(1.582907, abs=1e-6)
    assert sum(plan("feedback_v2")) == pytest.approx(0.814543, abs=1e-6)
    assert sum(plan("feedback")) == pytest.approx(1.73)


def test_schedules():
    s = schedules.strong_contrast(1.0, 20, 0.7, 0.3)
    assert s[:14] == pytest.approx([0.015] * 14) and s[14:] == pytest.approx([0.131667] * 6, abs=1e-6)
    assert schedules.fixed_tail(1.0, 20)[:2] == pytest.approx([0.025, 0.027632], abs=1e-6)


@settings(max_examples=50, deadline=None)
@given(st.floats(0.1, 50), st.integers(1, 40), st.floats(0, 1), st.floats(0.05, 1))
def test_schedules_spend_the_total(total, steps, share, ratio):
    assert sum(schedules.strong_contrast(total, steps, share, ratio)) == pytest.approx(total)
    assert sum(schedules.fixed_tail(total, steps)) == pytest.approx(total, rel=1e-3)


def test_budget_split():
    s = methods.budget_split(1.0, True, True, 0.1)
    assert (s["eps_topm"], s["eps_pca"], s["eps_proxy"], s["eps_iter"]) == pytest.approx((0.03, 0.02, 0.1, 0.85))
    s = methods.budget_split(1.0, True, False, 0.1)
    assert (s["eps_fs"], s["eps_pca"], s["eps_iter"]) == pytest.approx((0.05, 0.0, 0.87))
    assert sum(v for k, v in methods.budget_split(1.0, True, True, 0.99).items() if k != "eps_fs") == pytest.approx(1.0)


def test_noise_scales():
    assert [noise.sum_scale(0.036, 3.0, d) for d in (96, 64, 16)] == pytest.approx([1632.99, 1333.33, 666.67], abs=0.01)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.lists(st.lists(st.integers(0, 9), min_size=n, max_size=n), min_size=n, max_size=n)))
def test_match_is_best_and_smallest(table):
    from itertools import permutations

    t = np.array(table)
    best = max(sum(t[i, p[i]] for i in range(len(t))) for p in permutations(range(len(t))))
    first = min(p for p in permutations(range(len(t))) if sum(t[i, p[i]] for i in range(len(t))) == best)
    assert metrics.match(t) == list(first)


def test_tests_of_significance():
    assert significance.t_pvalue(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert significance.t_pvalue(0.5, 3) == pytest.approx(0.6514480, abs=1e-6)
    assert significance.mann_whitney([1, 2, 3, 4], [5, 6, 7, 8]) == pytest.approx((0.0, 2 / 70))
    assert math.isnan(significance.paired_t([1.0])[1])


def test_laplace_distribution():
    x = noise.rng.laplaces(2.0, (4000,), "dist")
    assert abs(x.mean()) < 0.15 and np.abs(x).mean() == pytest.approx(2.0, abs=0.15)


def test_merge_clusters():
    to, merges = alternatives.merge_clusters(np.array([5, 0, 4, 6]), np.array([[0.0], [9.0], [0.1], [5.0]]), 2)
    assert to == {3: 0, 0: 1, 2: 1} and merges == [(0, 2)]


def test_density_labels(spark):
    """Two dense groups, a point beside one of them, and one apart; all draws are next to exact."""
    points = spark.createDataFrame([(i, [float(i)]) for i in range(9)], "row_id long, features array<double>")
    pairs = [(0, 1), (0, 2), (1, 2), (2, 3), (5, 6), (5, 7), (6, 7)]
    links = spark.createDataFrame([(1.0, a, b) for a, b in pairs], "radius double, a long, b long")
    flags = alternatives.noisy_degrees(points, links, 1.5, 1e6, 1e6, "s")
    label = {r["row_id"]: r["cluster"] for r in alternatives.density_labels(flags, links).collect()}
    assert label == {0: 0, 1: 0, 2: 0, 3: 0, 4: -1, 5: 1, 6: 1, 7: 1, 8: -1}
    grown = flags.withColumn("starts", flags["row_id"] == 0)  # a component needs a point that starts
    assert {r["row_id"] for r in alternatives.density_labels(grown, links).where("cluster = -1").collect()} == {4, 5, 6, 7, 8}


def test_alignment_is_one_to_one():
    """A cluster takes its class even without a common row; -1 is an id like others, and so are large ids."""
    f1, mapping = metrics.macro_f1([(0, 2, 5), (1, 1, 4), (2, 1, 1), (0, 0, 2)])
    assert f1 == pytest.approx(0.5741, abs=1e-4) and mapping == {0: 2, 1: 1, 2: 0}
    assert metrics.macro_f1([(10**9, -1, 3), (5, 7, 2)]) == (1.0, {-1: 10**9, 7: 5})
    f1, mapping = metrics.macro_f1([(0, 0, 3), (1, 1, 3), (1, 2, 1)])
    assert mapping == {0: 0, 1: 1, 2: 2} and f1 == pytest.approx((1 + 6 / 7 + 0) / 3)


def test_control_parameters():
    budget = {"collapse_boost": 1.1, "p": 2.0, "datasets": {"har": {"collapse_threshold": 0.3, "p": 3.0, "guarded_feedback": True, "guard_raise_cap_ratio": 1.4}}}
    own, other = (methods.control_parameters(budget, d, "feedback_v3") for d in ("har", "gas"))
    assert (own["boost"], own["boost_above"], own["rule"], own["guard"]) == (1.1, 0.3, {"power": 3.0}, {"warmup": 3, "cap": 1.4})
    assert (other["boost_above"], other["rule"], other["guard"]) == (0.55, {"power": 2.0}, None)
    assert methods.control_parameters(budget, "har", "feedback")["rule"] == {} and methods.control_parameters({}, "x", "static")["boost"] == 1.3


def test_guard():
    guard = schedules.Guard(warmup=1, improve=0.1, cap=1.5)
    fine, bad = [(1.0, 0.3)], [(0.5, 0.3)]
    assert guard.decide(0, 9.0, 1.0, [], []) == (1.0, "warmup_static")
    assert guard.decide(1, 9.0, 1.0, [5.0], fine) == (1.5, "feedback_raise") and guard.decide(1, 1.2, 1.0, [5.0], fine) == (1.2, "feedback_raise")
    assert guard.decide(2, 9.0, 1.0, [5.0, 4.6], fine) == (1.0, "fallback_static") and guard.decide(2, 9.0, 1.0, [5.0, 4.5], fine)[1] == "feedback_raise"
    assert guard.decide(1, 9.0, 1.0, [5.0], bad) == (1.0, "fallback_static") and guard.decide(1, 0.5, 1.0, [5.0], fine) == (1.0, "fallback_static")


def test_proxy_budget_and_best_of():
    assert methods.proxy_budget(1.0, 0.1) == pytest.approx((0.1, 0.9)) and methods.proxy_budget(1.0, 0.1, 0.3) == pytest.approx((0.3, 0.7))
    with pytest.raises(ValueError):
        methods.proxy_budget(1.0, 0.1, 1.0)
    found = methods.best_of({"har": {"dpk": {"summary": {"f1_mean": 0.4}}, "dpk_x": {"summary": {"f1_mean": 0.5}, "candidate": {"a": 1}}, "other": {"summary": {"f1_mean": 0.9}}}, "gas": {"other": {}}}, "dpk")
    assert found == {"HAR": {"method": "dpk_x", "candidate": {"a": 1}, "summary": {"f1_mean": 0.5}}}


def test_significance_by_aggregates(spark):
    rows = [("x", a, b) for a, b in [(1.0, 2.0), (2.0, 2.0), (4.0, 3.0), (0.5, 2.5), (3.0, 5.0)]] + [("y", 1.0, 0.0), ("z", 2.0, 1.0), ("z", 3.0, 2.0), ("x", None, 1.0)]
    got = {r["g"]: r for r in significance.significance(spark.createDataFrame(rows, "g string, value_a double, value_b double"), ["g"]).collect()}
    x, y = zip(*[(a, b) for g, a, b in rows if g == "x" and a is not None])
    assert (got["x"]["t"], got["x"]["p_t"]) == pytest.approx(significance.paired_t([a - b for a, b in zip(x, y)]))
    assert (got["x"]["u"], got["x"]["p_u"]) == pytest.approx(significance.mann_whitney(list(x), list(y))) and got["x"]["n"] == 5
    assert got["y"]["t"] is None and got["y"]["p_t"] is None and got["z"]["p_t"] == 0.0


def test_welch_of_unpaired_sides(spark):
    a, b = [1.0, 2.0, 4.0, 0.5], [2.5, 5.0, 3.0, 6.0, 4.5, 2.0]
    rows = [("x", True, v) for v in [*a, None]] + [("x", False, v) for v in b] + [("one", True, 1.0), ("one", False, 2.0), ("one", False, 3.0)] + [("flat", s, 1.0) for s in (True, True, False, False)]
    got = {r["g"]: r for r in significance.welch(spark.createDataFrame(rows, "g string, a boolean, v double"), ["g"], F.col("a"), "v").collect()}
    ea, eb = np.var(a, ddof=1) / 4, np.var(b, ddof=1) / 6
    t, dof = (np.mean(a) - np.mean(b)) / math.sqrt(ea + eb), (ea + eb) ** 2 / (ea**2 / 3 + eb**2 / 5)
    x = got["x"]
    assert (x["n_a"], x["n_b"]) == (4, 6) and (x["t"], x["dof"], x["p_t"]) == pytest.approx((t, dof, significance.t_pvalue(t, dof)))
    assert significance.t_pvalue(1.5, 2.0) == pytest.approx(1 - 1.5 / math.sqrt(2 + 1.5**2))  # closed form of two degrees
    assert all(got[g][c] is None for g in ("one", "flat") for c in ("t", "dof", "p_t"))


def test_fuzzy_means_equal_numpy(spark):
    r = np.random.default_rng(3)
    x, c = np.concatenate([r.normal(m, 0.4, (70, 5)) for m in (-2, 0, 3)]), r.normal(0, 1, (3, 5))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id long, features array<double>").repartition(5)
    assert np.abs(seeding.fuzzy_means(df, c, rounds=12) - seeding.fuzzy_rounds(x, c, 12)).max() < 1e-9
    at = seeding.fuzzy_means(df, x[[0, 80]], rounds=1)  # a centroid on a row
    assert np.abs(at - seeding.fuzzy_rounds(x, x[[0, 80]], 1)).max() < 1e-9
    assert not seeding.fuzzy_means(df.limit(0), c, rounds=1).any()


def test_blob_counts():
    assert synthetic.blob_counts(10, 3) == [3, 3, 4]
    with pytest.raises(ValueError):
        synthetic.weights(2, [0.0, 0.0])


def plain_components(edges):
    """Group and node to its smallest reachable node, by sweeps."""
    label = {(g, x): x for g, a, b in edges for x in (a, b)}
    for _ in range(len(label)):
        before = dict(label)
        for g, a, b in edges:
            label[g, a] = label[g, b] = min(label[g, a], label[g, b])
        if label == before:
            break
    return label


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_components_by_joins(spark, shape):
    r = np.random.default_rng(5)
    edges = {
        "random": [(g, int(a), int(b)) for g in (0, 1) for a, b in r.integers(0, 80, (70, 2)) if a != b],
        "chain": [(0, i, i + 1) for i in range(120)] + [(1, 7, 3)],
        "star": [(0, 99, i) for i in range(40)] + [(0, i, 200 + i) for i in range(30, 60)],
        "empty": [],
    }[shape]
    rows = [*edges, *edges[:3], (0, 5, 5), (0, None, 3)]  # repeated links, a self loop and a null
    got = graphs.components(spark.createDataFrame(rows, "g int, a long, b long"), ["g"]).collect()
    assert len(got) == len({(x["g"], x["node"]) for x in got})
    assert {(x["g"], x["node"]): x["component"] for x in got} == plain_components(edges)


def test_density_labels_equal_a_plain_version(spark):
    """500 points, two radii, draws that often change what degrees say."""
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(c, 0.35, (100, 2)) for c in ((0, 0), (2, 0), (0, 2), (3, 3))] + [r.uniform(-2, 5, (100, 2))])
    points = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "row_id long, features array<double>")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    radii = [0.25, 0.4]
    links = spark.createDataFrame([(rad, int(i), int(j)) for rad in radii for i, j in zip(*np.nonzero(np.triu(far <= rad, 1)))], "radius double, a long, b long")
    flags = alternatives.noisy_degrees(points, links, 10, 0.5, 0.2, "s")
    held = {(f["radius"], f["row_id"]): (f["starts"], f["grows"]) for f in flags.collect()}
    got = {(f["radius"], f["row_id"]): f["cluster"] for f in alternatives.density_labels(flags, links).collect()}
    want = {}
    for rad in radii:
        near = [[int(j) for j in np.flatnonzero(far[i] <= rad) if j != i] for i in range(len(x))]
        spreads = [any(held[rad, i]) for i in range(len(x))]
        name, number = {}, 0
        for i in range(len(x)):  # components by smallest point
            if spreads[i] and i not in name:
                todo, seen = [i], {i}
                while todo:
                    new = [j for j in near[todo.pop()] if spreads[j] and j not in seen]
                    seen.update(new)
                    todo += new
                real = any(held[rad, j][0] for j in seen)
                name |= {j: number if real else -1 for j in seen}
                number += real
        for i in range(len(x)):
            beside = [name[j] for j in near[i] if spreads[j] and name[j] >= 0]
            want[rad, i] = name[i] if spreads[i] else min(beside, default=-1)
    assert got == want and {-1, 0, 1} <= set(want.values())


def test_ranks_within_groups(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET", 7)
    rows = [(g, int(v)) for g in range(3) for v in np.random.default_rng(g).permutation(200)[: 20 * (g + 1)]]
    got = {(r["g"], r["v"]): r["place"] for r in ranks.within(spark.createDataFrame(rows, "g int, v long"), "g", "v", "place").collect()}
    assert got == {(g, v): sorted(x for h, x in rows if h == g).index(v) for g, v in rows}


def test_block_components_span_the_exact_ones(spark):
    """Wide rows with a gap after the fifth eigenvalue; and more components than features."""
    r = np.random.default_rng(2)
    basis = np.linalg.qr(r.standard_normal((60, 60)))[0]
    x = r.standard_normal((400, 60)) * np.concatenate([[9, 8, 7, 6, 5], np.full(55, 0.3)]) @ basis.T + 3
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "row_id long, features array<double>").repartition(5)
    mean, v, values = reduction.block_components(df, 5, 50, 3, 1e-9, "s")
    _, exact_mean, cov = reduction.moments(df)
    exact = reduction.components(cov, 5)
    assert np.allclose(mean, exact_mean) and np.allclose(values, np.sort(np.linalg.eigvalsh(cov))[::-1][:5], rtol=1e-9)
    assert np.abs(v @ v.T - exact @ exact.T).max() < 1e-6 and np.abs(v - exact).max() < 1e-6
    assert np.abs(v.T @ v - np.eye(5)).max() < 1e-9
    _, whole, _ = reduction.block_components(df.select("row_id", F.slice("features", 1, 4).alias("features")), 9, 50, 8, 1e-9, "s")
    assert whole.shape == (4, 4)


def test_wide_rows_take_the_block_way(spark, monkeypatch):
    x = np.random.default_rng(1).standard_normal((80, 6)) * [5, 3, 1, 0.5, 0.2, 0.1]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "row_id long, features array<double>")
    exact = {r["row_id"]: r["features"] for r in reduction.pca(df, 2).collect()}
    monkeypatch.setattr(reduction, "WIDE", 5)
    monkeypatch.setattr(reduction, "moments", None)  # the Gram matrix isn't made
    for r in reduction.pca(df, 2).collect():
        assert r["features"] == pytest.approx(exact[r["row_id"]], abs=1e-6)


def test_children_of_schedules():
    """Two children a pair, swapped at one place; only moved ones are brought within the total again."""
    held = alternatives.Population(9, 5, 10.0, 0.5, 6.0, "p")
    before = held.rows.copy()
    held.breed(0, np.arange(9), 2, 1.0, 0.0)
    assert held.rows.shape == (9, 5) and (held.rows[:2] == before[:2]).all()
    for i in range(2, 8, 2):
        a, b = held.rows[i], held.rows[i + 1]
        assert any((np.concatenate([p[:c], q[c:]]) == a).all() and (np.concatenate([q[:c], p[c:]]) == b).all() for p in before for q in before for c in range(1, 5))
    assert np.abs(held.rows[2:].sum(1) - 10).max() > 1e-6  # an unmoved child keeps what it inherits
    held.breed(1, np.arange(9), 2, 1.0, 1.0)
    assert np.allclose(held.rows[2:].sum(1), 10)


def test_number_formats(spark):
    values = [123456.0, 0.00012346, 1.0, 100.0, 999.9, 0.1, 1e-9, -2.6e10, 12.345678, 0.0, 1e15, 9.996]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    for fmt in ("%.3g", "%.2e", "%.3e", "%.1f", "%.0f", "%.3f", "%.1g"):
        got = [r[0] for r in df.select(reports.number("x", fmt)).collect()]
        assert got == [fmt % v for v in values] + ["--", "--"], fmt
    assert spark.range(1).select(reports.number(F.lit(0.00012345), "%.3e")).first()[0] == "1.235e-04"  # a tie in the shortest text, which C rounds by the bits


def test_names_paths_and_rescaled_budgets(spark):
    df = spark.createDataFrame([("A-b (1)", 1), ("ab1", 2), ("other", 3), (None, 4)], "method string, n int")
    got = {r["n"]: r["method"] for r in runs.display_names(df, {"ab1": "AB one"}).collect()}
    assert got == {1: "AB one", 2: "AB one", 3: "other", 4: None} and runs.display_names(df, {"x": "y"}).columns == df.columns
    assert [runs.normal_path(p) for p in ("a//b/./c/../d/", "./x", "")] == ["a/b/d", "x", "."]
    assert schedules.rescaled([1.0, 3.0], 2.0) == pytest.approx([0.5, 1.5]) and schedules.rescaled([], 2.0) == []
