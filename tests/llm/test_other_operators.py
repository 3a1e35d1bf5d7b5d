"""Top-k search, cap filters, WARC and the pipeline against plain versions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from noisefold.llm import capfilter, kneserney, simhash, substring, topk, toxicity, warc

ODD_VECTORS = [None, [], [float("nan"), 1.0, 0.0], [float("inf"), 0.0, 0.0], [0.0, 0.0, 0.0], [None, 1.0, 2.0], [1.0, 2.0]]


def vectors(spark, rows, extra=True):
    data = [(i, v, 1, 2) for i, v in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, weight int, score int")


def test_top_k_equals_all_products(spark, tiny):
    e = spark.read.parquet(f"{tiny}/embeddings.parquet")
    x = {r["vec_id"]: np.floor(1024 * np.array(r["embedding"], float)).astype(int) for r in e.collect()}
    got = {}
    for r in topk.exact_top_k(e, F.col("vec_id") % 50 == 0, block_rows=120, block_queries=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (i for i in x if i % 50 == 0):
        want = sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q)[:10]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]


def test_top_k_of_ties_and_odd_vectors(spark):
    rows = [(100, [1.0, 0.0, 0.0]), (7, [0.5, 0.0, 0.0]), (3, [0.5, 0.0, 0.0]), (5, [0.5, 9.0, 0.0]), (None, [9.0, 0.0, 0.0])]
    rows += [(200 + i, v) for i, v in enumerate(ODD_VECTORS)] + [(100, [1.0, 0.0, 0.0])]
    got = topk.exact_top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0, k=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(100, 1, 3, 524288), (100, 2, 5, 524288), (100, 3, 7, 524288)]
    assert topk.exact_top_k(vectors(spark, []), F.col("vec_id") == 0).count() == 0
    assert topk.exact_top_k(vectors(spark, [(0, [1.0])]), F.col("vec_id") == 0).count() == 0


def test_bounds_stop_the_search():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 8)) * 3
    x = np.floor(1024 * (centres[rng.integers(0, 20, 4000)] + 0.05 * rng.normal(size=(4000, 8)))).astype(np.int64)
    ids, stats = np.arange(4000), []
    table = topk.choose_pivots(x[:500], 24)
    got = topk.search(ids[:40], x[:40], ids, x, table, ids[:500], x[:500], 10, stats)
    best = {q: sorted((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q)[:10] for q in range(40)}
    assert all([(i, -s) for s, i in best[q]] == [(i, s) for p, i, s in got if p == q] for q in range(40))
    assert np.mean(stats) < 0.5 * 4000


def plain_links(ids, x, threshold=0.9):
    n = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / n[:, None] / n[None] >= threshold
    label = np.array(ids)
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return near.sum(1) - 1, label
        label = new


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 32))
    close = np.repeat(base[:30], 6, axis=0) + rng.normal(size=(180, 32)) * np.repeat(rng.uniform(0.02, 0.45, 180)[:, None], 32, 1)
    x = np.concatenate([base, close, base[:5], base[:1] * 3]).astype(np.float32)
    ids = rng.permutation(len(x)) + 10
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    odd = [(900 + i, v) for i, v in enumerate(ODD_VECTORS)] + [(None, [1.0] * 32)]
    for most in (2048, 16):  # whole filters, and filters in blocks
        got = {r["vec_id"]: r for r in capfilter.near_duplicates(vectors(spark, rows + odd), most=most).collect()}
        n, label = plain_links(ids, x.astype(float))
        assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items() if i is not None and i < 900} == {int(i): (int(a), int(b), int(i) == int(b)) for i, a, b in zip(ids, n, label)}
        assert all((got[900 + i]["n_links"], got[900 + i]["component_id"], got[900 + i]["kept"]) == (0, 900 + i, True) for i in range(len(ODD_VECTORS)))
        assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)
    assert capfilter.near_duplicates(vectors(spark, [])).count() == 0
    assert capfilter.near_duplicates(vectors(spark, [(1, None)])).first()["kept"]


@pytest.mark.parametrize("n", [500, 50_000, 2_000_000])
def test_pairs_at_the_threshold_share_filters(n):
    rng = np.random.default_rng(1)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    u = unit(rng.normal(size=(2000, 64)))
    codes = capfilter.fit_codes(unit(rng.normal(size=(1000, 64))), n, 0.9, 512, 5.0)
    side = rng.normal(size=u.shape)
    side = unit(side - (side * u).sum(1, keepdims=True) * u)
    (ra, fa), (rb, fb) = (capfilter.decode_all(codes, v) for v in (u, 0.9 * u + np.sqrt(0.19) * side))
    size = sum(c.size for c in codes)
    assert len(np.unique(np.intersect1d(ra * size + fa, rb * size + fb) // size)) >= 0.995 * 2000


def test_too_few_codes_are_an_error():
    x = np.random.default_rng(1).normal(size=(500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert capfilter.fit_codes(x, 50_000, 0.9, 512, 5.0).recall == 1.0
    with pytest.raises(RuntimeError):
        capfilter.fit_codes(x, 50_000, 0.9, 512, 0.5, most_codes=2)


def test_decoding_lists_every_exceeding_filter():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = capfilter.fit_codes(x, 1000, 0.9, 100, 3.0)[0]
    row, name = code.decode(x)
    edges = np.cumsum([0, *(c.shape[1] for c in code.codes)])
    turned = x @ code.rotation
    scores = np.zeros((50, 1))
    for b, c in enumerate(code.codes):
        scores = (scores[:, :, None] + (turned[:, edges[b] : edges[b + 1]] @ c.T)[:, None, :]).reshape(50, -1)
    want = {(i, j) for i, j in zip(*np.nonzero(scores >= code.alpha * np.sqrt(len(code.codes))))}
    assert set(zip(row.tolist(), name.tolist())) == {(int(i), int(j)) for i, j in want}


# ---- WARC ----

PAGES = [(1, "http://a/", "x" * 100), (2, None, "x" * 100), (3, "u r\nl é", "é" * 60), (4, "http://d/", None), (5, "http://e/", ""), (6, "f", "short"), (7, "g", "short"), (-8, "h", "x" * 100), (None, "i", "x" * 100), (9, "j", "WARC/1.1\r\n\r\n\x1f\x8b\x08" * 30), (10, "k", "y" * 300_000), (2**62 + 1, "l", "é" * 60)]


def pages(spark):
    return spark.createDataFrame([(*p, "first", 3) for p in PAGES], "page_id long, url string, html string, digest string, first int")


@pytest.mark.parametrize("split", [64, 1000, 1 << 22])
def test_archives_read_back(spark, split):
    manifest = warc.write(pages(spark), warc.archive_folder(spark), broadcast_digests=split % 3)  # with and without a broadcast
    got = {r["page_id"]: r for r in warc.read(spark, manifest, with_payload=True, split_bytes=split).collect()}
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        data = (html or "").encode()
        r = got[i]
        first = {"x" * 100: -8, "é" * 60: 3}.get(html) if len(data) >= 100 else None
        revisit = first is not None and i != first
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None)
        assert r["payload"] == (None if revisit else bytearray(data))
    assert warc.read(spark, warc.write(pages(spark).limit(0), warc.archive_folder(spark))).count() == 0


def test_splits_own_each_member_once():
    data = b"".join(warc.member(i, "u", (b"\x1f\x8b\x08 payload %d " % i) * (i % 7), "0", None, False) for i in range(40)) + b"\x1f\x8b\x08broken"
    read = lambda at, k: data[at : at + k]
    whole = list(warc.members(read, len(data), 0, len(data)))
    assert len(whole) == 40
    for step in (17, 100, 333):
        parts = [m for s in range(0, len(data), step) for m in warc.members(read, len(data), s, min(s + step, len(data)), 50)]
        assert parts == whole


@pytest.mark.parametrize("page", [0, 1, -1, 2**63 - 1, -(2**63), None])
def test_record_ids_hold_the_page(page):
    assert warc.page_of(warc.record_id(page)) == page


# ---- pipeline ----


def test_pipeline_decides_as_its_operators(spark, tiny):
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    left = docs
    for (name, stage), keep in zip(corpus_pipeline.STAGES, (
        lambda d: {r["doc_id"] for r in kneserney.classify(d, labels).where("kept").collect()},
        lambda d: {r["doc_id"] for r in toxicity.score(d, toxicity.fit_on(d, labels)).where("score < 0.5").collect()},
        lambda d: {r["component_id"] for r in simhash.near_duplicates(d).collect()},
        None,
    )):
        out = stage(spark, left, tiny).persist()
        assert out.columns == docs.columns
        if keep:
            assert {r["doc_id"] for r in out.collect()} == keep(left) and out.count() == len(keep(left))
        left = out
    assert substring.passages(left).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, left, tiny)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in left.collect()}
    tokens = F.sum("length").alias("n")  # pieces depend on how rows are dealt to tasks, tokens don't
    assert corpus_pipeline.run(spark, tiny).agg(tokens).first() == packed.agg(tokens).first()
