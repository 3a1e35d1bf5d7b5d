"""Passages against a search of all pairs of documents, very long texts, and fingerprints that share a page."""

import random

import numpy as np
import pytest

from noisefold.llm import kneserney, licenses, simhash, substring, toxicity
from noisefold.llm.common import components


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n)]


def edited(text, share, seed):
    """One word in 1 / share replaced, dropped or followed by another, at places drawn anew."""
    r, out = random.Random(seed), []
    for w in text:
        if r.random() >= share:
            out.append(w)
        else:
            out += r.choice(([], [w, "inserted" + str(r.random())[2:6]], ["replaced" + str(r.random())[2:6]]))
    return out


def best_local(a, b):
    """Start, end and score in a of its best local alignment with b: a word that is equal gives 1, an edit costs 4, so that a similarity of 0.8 breaks even."""
    step = 4 * np.arange(len(b) + 1)

    def end_of(a, b):
        row, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
        for i, w in enumerate(a):
            new = np.concatenate([[0], np.maximum(np.maximum(row[:-1] + np.where(b == w, 1, -4), row[1:] - 4), 0)])
            row = np.maximum.accumulate(new + step) - step
            if row.max() > best:
                best, end = int(row.max()), i + 1
        return end, best

    end, best = end_of(a, b)
    back, _ = end_of(a[:end][::-1], b[::-1])
    return end - back, end, best


def pieces(a, b, first=0):
    """All words of a in pieces of 16 or more that b has at 0.8 or more: the best one, and those on either side of it."""
    start, end, score = best_local(a, b)
    if end - start < 16 or score <= 0:
        return set()
    return set(range(first + start, first + end)) | pieces(a[:start], b, first) | pieces(a[end:], b, first + end)


def runs(covered):
    """Runs of at least 50 words, of which 2 may lie in no piece where two pieces meet."""
    out, at = set(), sorted(covered)
    while at:
        n = next((i for i in range(1, len(at)) if at[i] - at[i - 1] > 3), len(at))
        if at[n - 1] + 1 - at[0] >= 50:
            out |= set(range(at[0], at[n - 1] + 1))
        at = at[n:]
    return out


def edits(a, b):
    """Levenshtein distance of words."""
    row = np.arange(len(b) + 1)
    for i, w in enumerate(a):
        new = np.concatenate([[i + 1], np.minimum(row[:-1] + (b != w), row[1:] + 1)])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def test_passages_hold_what_a_search_of_all_pairs_finds(spark):
    """60 documents, 20 passages in three of them each, with up to a tenth of the words edited. What plain local alignment of all pairs finds is reported, but for ends; what is reported is alike by plain edit distance, and in no document without a copy."""
    texts = []
    for i in range(20):
        shared = words(f"p{i}", 80 + 5 * (i % 4))
        for j in range(3):
            texts.append(words(f"a{i} {j}", 20 + i) + edited(shared, (0.0, 0.04, 0.07, 0.1)[i % 4] * (j > 0), f"{i} {j}") + words(f"b{i} {j}", 25))
    order = list(range(60))
    random.Random(1).shuffle(order)
    texts = [texts[i] for i in order]
    number = {}
    coded = [np.array([number.setdefault(w, len(number)) for w in t]) for t in texts]
    want = {d: found for d in range(60) if (found := runs(set().union(*(pieces(coded[d], coded[c]) for c in range(d)))))}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows, got = substring.passages(docs).collect(), {}
    for r in rows:
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    later = {d for d in range(60) if any(order[c] // 3 == order[d] // 3 for c in range(d))}
    assert set(want) <= set(got) <= later and len(want) >= 36  # the best pieces of two edited copies may be short of 50 words, where all of it is at 0.8
    kept = [len(got[d] & want[d]) / len(want[d]) for d in want]
    assert min(kept) >= 0.9 and np.mean(kept) >= 0.98, sorted(kept)[:5]
    single = [r for r in rows if r["n_fragments"] == 1]
    for r in single:
        a, b = coded[r["doc_id"]][r["start_word"] : r["end_word"]], coded[r["ref_doc_id"]][r["ref_start_word"] : r["ref_end_word"]]
        assert edits(a, b) <= 0.2 * max(len(a), len(b))
    assert len(single) >= 20


LONG = 120_000  # words


@pytest.fixture(scope="module")
def long_words():
    r = random.Random("long")
    some = words("vocabulary", 20_000)
    return [r.choice(some) for _ in range(LONG)]


def test_passages_of_very_long_texts(spark, long_words):
    """At the far end of a long text, and of a long text that follows."""
    shared = words("p", 70)
    rows = [(0, " ".join(long_words + shared)), (1, " ".join(words("c", 30) + shared + words("d", 30))), (2, " ".join(words("e", 90_000) + shared))]
    got = {r["doc_id"]: r for r in substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2} and got[1]["ref_start_word"] == LONG and got[2]["start_word"] == 90_000 and got[2]["n_words"] == 70


def test_notices_in_very_long_texts(spark, long_words):
    rows = [(0, " ".join(long_words) + "\n" + licenses.TEMPLATES["MIT-text"]), (1, " ".join(long_words))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["license"], r["start_word"]) for r in got] == [(0, "MIT-text", LONG)]


def test_scores_of_very_long_texts(spark, long_words):
    """Each is of the whole text: an insult after all else is found, junk of a text's second half counts, and fingerprints are of all shingles."""
    crf = toxicity.fit([f"{a} you idiot {b}" for a, b in zip(words("b", 60), words("c", 60))] + [" ".join(words(f"g{i}", 6)) for i in range(300)], [1] * 60 + [0] * 300)
    text = " ".join(long_words)
    docs = spark.createDataFrame([(0, text + " you idiot", "en"), (1, text, "en")], "doc_id long, text string, lang string")
    spans = {r["doc_id"]: [s["start"] for s in r["spans"]] for r in toxicity.score(docs, crf).collect()}
    assert any(at > len(text) for at in spans[0]) and not any(at > len(text) for at in spans[1])
    got = {r["doc_id"]: int(r["fingerprint"], 16) for r in simhash.near_duplicates(docs).collect()}
    assert got == {0: simhash.fingerprint(text + " you idiot"), 1: simhash.fingerprint(text)}
    assert bin(got[0] ^ got[1]).count("1") <= 4
    half = " ".join(long_words[: LONG // 2])
    rows = [(i, " ".join(words(f"t{i}", 3) + long_words[200 * i : 200 * i + 200]), "en") for i in range(40)] + [(100, half, "en"), (101, half + " " + "}{$%~#^ " * (LONG // 2), "en")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    judged = {r["doc_id"]: r for r in kneserney.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert len(judged) == 42 and judged[101]["perplexity"] > 2 * judged[100]["perplexity"] and not judged[101]["kept"]


@pytest.mark.parametrize("page_rows", [1, 50_000])
def test_fingerprints_of_a_hot_page(spark, page_rows):
    """A third of the fingerprints share their first bits, others lie in pages around: parts of a page give the links of all pairs."""
    r = np.random.default_rng(4)
    near = (np.uint64(0xABC) << np.uint64(52)) | r.integers(0, 2**52, 400, dtype=np.uint64)
    close = np.concatenate([near[:150] ^ (np.uint64(1) << r.integers(0, 64, 150, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 150, dtype=np.uint64)) for _ in range(3)])
    fps = np.unique(np.concatenate([near, close, r.integers(0, 2**64, 300, dtype=np.uint64)]))
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4, 1))
    signed = fps.view(np.int64)
    want = components(spark.createDataFrame([(int(signed[a]), int(signed[b])) for a, b in zip(i, j)], "a long, b long"))
    edges = simhash.trie_self_join(spark.createDataFrame([(int(x),) for x in signed], "fp long"), 4, page_rows)
    assert sorted(map(tuple, components(edges).collect())) == sorted(map(tuple, want.collect()))
