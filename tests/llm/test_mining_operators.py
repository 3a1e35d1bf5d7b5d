"""Reply trees, phrase mining and source divergence against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noisefold.llm import divergence, phrases, queries, slots, trees

# ---- 11: reply trees ----

ODD = ["", "<|im_end|>", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "ends with <", "|>", "a\\nb", "𝒳 < | <<|", "\n\n", "$1 \\1", "<|" * 50]


def plain_paths(rows, branches):
    """rows: (tree, id, parent, score). (tree, leaf) -> ids from the root, for the best branches."""
    by_tree = defaultdict(dict)
    for tree, i, parent, score in rows:
        by_tree[tree][i] = (parent, score or 0.0)
    out = {}
    for tree, nodes in by_tree.items():
        up = {i: p if p in nodes else None for i, (p, _) in nodes.items()}
        found = []
        for leaf in set(nodes) - set(up.values()):
            path, at = [], leaf
            while at is not None and len(path) <= len(nodes):
                path.append(at)
                at = up[at]
            if at is None:
                found.append((-sum(nodes[i][1] for i in path) / len(path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(found)[:branches], 1):
            out[tree, leaf] = rank, path
    return out


def test_paths_of_random_trees(spark):
    r = random.Random(5)
    rows = []
    for tree in [*range(12), None]:
        n = r.choice([1, 2, 9, 40])
        rows += [(tree, i, r.choice([None, *range(i)][-3:] if i else [None]), r.choice([None, 0.5, 1.0, 2.0, 4.0])) for i in range(n)]
    rows += [(90, 0, None, 1.0), (90, 1, 2, 1.0), (90, 2, 3, 1.0), (90, 3, 1, 1.0), (90, 4, 3, 1.0), (90, 5, 0, 1.0), (91, 7, 7, 1.0), (92, 5, 77, 1.0)]  # cycles, a reply below one, a parent that isn't there
    rows += [(93, i, i - 1 if i else None, 1.0) for i in range(700)] + [(94, i, 0 if i else None, float(i % 7)) for i in range(500)]  # a long chain and a hot parent
    for branches in (1, 3):
        got = defaultdict(list)
        for x in trees.paths(spark.createDataFrame(rows, "tree long, id long, parent long, score double"), branches).collect():
            got[x["tree"], x["leaf"]].append((x["pos"], x["id"], x["rank"]))
        found = {}
        for k, v in got.items():
            v.sort()
            assert [x[0] for x in v] == list(range(len(v))) and len({x[2] for x in v}) == 1
            found[k] = v[0][2], [x[1] for x in v]
        assert found == plain_paths(rows, branches)
    assert {k[0] for k in found} >= {90, 92, 93, 94, None} and (90, 4) not in found and not [k for k in found if k[0] == 91]


def test_conversations_read_back_and_masks(spark):
    rows = [(1, 0, None, "system", "be kind", None)] + [(1, i + 1, i, ["user", "assistant"][i % 2], t, 1.0) for i, t in enumerate(ODD)]
    rows += [(1, 50, 3, "assistant", None, 9.0), (1, 50, 3, "assistant", "zz", 9.0), (None, 1, None, "a\nb\\n<|im_end|>", "x", 0.0), (2, None, None, "user", "no id", 1.0), (3, 1, None, None, "y" * 200_000, 1.0)]
    df = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double").withColumns({"leaf": F.lit(1), "t": F.lit("x"), "n": F.lit(2), "pos": F.lit(3), "node": F.lit(4)})
    out = {(x["tree"], x["leaf"]): x for x in trees.conversations(df, 5).select("*", trees.turns_of(F.col("formatted")).alias("turns"), trees.loss_text(F.col("formatted"), F.col("loss")).alias("under")).collect()}
    assert set(out) == {(1, len(ODD)), (1, 50), (None, 1), (3, 1)}
    long_ = out[1, len(ODD)]
    assert [(t["role"], t["text"]) for t in long_["turns"]] == [("system", "be kind")] + [(["user", "assistant"][i % 2], t) for i, t in enumerate(ODD)]
    assert long_["under"] == "".join(ODD[1::2]) and long_["n_turns"] == len(ODD) + 1
    assert long_["formatted"].count("<|im_start|>") == len(ODD) + 1 == long_["formatted"].count("<|im_end|>")
    assert [long_["formatted"][s["begin"] : s["end"]] for s in long_["loss"]] == [re.sub(r"<(\\*)\|", r"<\\\1|", t) for t in ODD[1::2]]
    assert out[1, 50]["turns"][-1]["text"] == "" and out[1, 50]["rank"] == 1  # of the two rows of id 50 the one with the smaller text
    assert out[None, 1]["turns"][0]["role"] == "a\nb\\n<|im_end|>" and out[3, 1]["turns"][0] == ("", "y" * 200_000)
    assert trees.conversations(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<|\\nim_endstar>\n$1", max_size=30))
def test_escape_is_reversible(text):
    there = re.sub(r"<(\\*)\|", r"<\\\1|", text)
    assert "<|" not in there and re.sub(r"<\\(\\*)\|", r"<\1|", there) == text


def test_threads_of_odd_rows(spark):
    rows = [(5, 1, "assistant", "b"), (5, 0, "user", "a"), (5, 1, "assistant", "b"), (5, 1, "assistant", None), (5, None, "system", "s"), (None, 0, "user", "q"), (None, 1, None, "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"tree": F.lit(1), "id": F.lit(2), "score": F.lit(3), "rank": F.lit(4)})
    got = {x["conv_id"]: x for x in trees.digests(trees.threads(df)).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert got[5]["turns_sha256"] == digest([("system", "s"), ("user", "a"), ("assistant", ""), ("assistant", "b"), ("assistant", "b")])
    assert got[5]["loss_sha256"] == hashlib.sha256(b"bb").hexdigest() and got[5]["loss_chars"] == 2 and got[5]["n_turns"] == 5
    assert got[None]["turns_sha256"] == digest([("user", "q"), ("", "r")]) and got[None]["loss_chars"] == 0
    assert trees.digests(trees.threads(df.limit(0))).count() == 0


# ---- 12: phrases ----


@settings(max_examples=25, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400), st.sets(st.integers(0, 2**64 - 1), max_size=50))
def test_shard_is_minimal_and_perfect(keys, others):
    own = np.array(sorted(keys), np.uint64)
    made = slots.Shard.build(own)
    assert sorted(made.slot(own)) == list(range(len(own)))
    rest = np.array(sorted(others - keys), np.uint64)
    assert (made.slot(rest) == -1).all()


def test_table_of_many_shards(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(slots, "SHARD_KEYS", 300)
    keys = slots.mix(np.arange(5000, dtype=np.uint64)).view(np.int64)
    made = slots.build(spark.createDataFrame([(int(k), f"é{k}") for k in keys], "key long, name string"), len(keys), f"file://{tmp_path}", "name")
    table = slots.Table(made, held_keys=700)
    at = table.slots(keys.view(np.uint64))
    assert len(made.files) > 8 and sorted(at) == list(range(5000)) and len(table.held) < 8
    assert (table.keys(at) == keys.view(np.uint64)).all() and table.texts(at[:50]) == [f"é{k}".encode() for k in keys[:50]]
    assert (table.slots(slots.mix(np.arange(5000, 6000, dtype=np.uint64))) == -1).all()
    assert slots.Table(slots.build(spark.createDataFrame([], "key long"), 0, f"file://{tmp_path}")).slots(keys.view(np.uint64)).max() == -1


def test_tree_sum(spark):
    r = np.random.default_rng(1)
    held = r.integers(0, 1 << 50, (3, 70, 8))
    rows = [(b, p, held[b, p].astype("<i8").tobytes()) for b in range(3) for p in range(70)]
    got = {x["block"]: np.frombuffer(x["sums"], "<i8") for x in slots.tree_sum(spark.createDataFrame(rows, "block long, part long, sums binary"), 70, fan=4).collect()}
    assert all((got[b] == held[b].sum(axis=0)).all() for b in range(3))


def test_counts_send_on_and_blocks():
    own, total, sent = slots.Counts(block=16, most=64), Counter(), Counter()
    r = np.random.default_rng(2)
    for _ in range(20):
        at = r.integers(0, 200, 50)
        total.update(at.tolist())
        if own.add(at):
            for b, s in own.rows().itertuples(index=False):
                sent.update({b * 16 + i: int(x) for i, x in enumerate(np.frombuffer(s, "<i8")) if x})
    for b, s in own.rows().itertuples(index=False):
        sent.update({b * 16 + i: int(x) for i, x in enumerate(np.frombuffer(s, "<i8")) if x})
    assert sent == total


def plain_phrases(rows, min_count, max_words, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        kept = [p for p, a in c.items() if len(p) > 1 and a >= min_count]
        best = []
        for p in kept:
            if any(len(q) > len(p) and c[q] >= c[p] and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in kept):
                continue
            score, k = min((1000 * c[p] * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -c[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def phrase_rows(seed, n=160):
    r = random.Random(seed)
    words = ["the", "THE", "of", "é", "日本", "new", "york", "a\x00b", "x y", "ß", "İ", "w" * 300]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ";", "\x0b"]) for _ in range(r.randint(0, 25)))
    rows = [(r.choice(["en", "en", "de", None, "und", ""]), text() + r.choice(["", "new york city hall of ", "the THE the the the the"])) for _ in range(n)]
    return rows + [("en", None), ("en", ""), (None, None), ("xx", "..;"), ("en", "of the of the " * 4000)] + rows[:20]


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"key": F.lit(1), "n": F.lit("x"), "word": F.lit("y"), "block": F.lit(2)})
    return sorted(tuple(x) for x in phrases.mine(df, **kw).collect())


def test_phrases_match_plain_counts(spark):
    rows = phrase_rows(1)
    for kw in ({"min_count": 8, "max_words": 5, "top": 2000}, {"min_count": 300, "max_words": 3, "top": 5}):
        assert mined(spark, rows, **kw) == plain_phrases(rows, *kw.values())


def test_phrases_with_small_bounds(spark, monkeypatch):
    """Many shards, chunks that end inside documents' batches, tallies sent at once and sums sent on: the same rows."""
    monkeypatch.setattr(slots, "SHARD_KEYS", 4)
    monkeypatch.setattr(slots, "HELD_KEYS", 8)
    monkeypatch.setattr(phrases, "_CHUNK", 50)
    monkeypatch.setattr(phrases, "_PENDING", 20)
    rows = phrase_rows(2)
    assert mined(spark, rows, min_count=8) == plain_phrases(rows, 8, 5, 2000)
    assert mined(spark, rows[:30], min_count=10_000) == [] == mined(spark, [], min_count=1)


# ---- 13: divergence ----


def plain_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))) for lang, source, text in rows]
    df, total, own = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        total[lang].update(terms)
        own[lang, source].update(terms)
    kept = {lang: [t for t, n in c.items() if n >= min_docs] for lang, c in df.items()}
    groups = sorted({(lang, source) for lang, source, _ in docs})

    def shares(c, lang):
        n = sum(c[t] for t in kept[lang])
        return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept[lang])) for t in kept[lang]}

    p = {g: shares(own[g], g[0]) for g in groups}
    f = lambda a, b: (a - b) * (a - b) // (a + b)
    out = []
    for lang, source in groups:
        here, q = p[lang, source], shares(total[lang], lang)
        pairs = sorted((-sum(f(here[t], p[lang, s][t]) for t in kept[lang]), s.encode()) for x, s in groups if x == lang and s != source)
        terms = sorted((-f(here[t], q[t]), t.encode()) for t in kept[lang] if own[lang, source][t] and here[t] > q[t])[:top]
        out += [(lang, source, part, item.decode(), -v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def audit_rows(seed):
    r = random.Random(seed)
    words = ["The", "the", "of", "é", "É", "日本", "x", "y1z", "ÀB", "a_b", "q@r", "𝒳", "w" * 40]
    rows = [(r.choice(["en", "en", "en", "de", None, ""]), r.choice(["a", "a", "b", None, "", "Ω", "c"]), " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for _ in range(150)]
    return rows + [("en", "empty", None), ("en", "empty", "123 --"), ("zz", "one", "rare words"), ("zz", "two", ""), ("yy", "alone", ""), ("en", "long", "the of x " * 60_000)] + rows[:10]


def test_audit_matches_plain_counts(spark):
    rows = audit_rows(3)
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit("x"), "n": F.lit(1), "salt": F.lit("y"), "value": F.lit(2), "rank": F.lit(3)})
    for kw in ({"min_docs": 10, "top_terms": 10}, {"min_docs": 1, "top_terms": 3}):
        assert sorted(tuple(x) for x in divergence.audit(df, **kw).collect()) == plain_audit(rows, *kw.values())
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, kept = 4 * 10**17, 9 * 10**17 + 1, 12345
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)


@pytest.mark.parametrize("name", ["op11_trees", "op12_phrases", "op13_divergence"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    folder = "/root/testdata/sf0.01"  # phrases need texts to be frequent in
    df = queries.queries()[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.sql(queries.oracle_sql()[name])
    assert found.columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())
