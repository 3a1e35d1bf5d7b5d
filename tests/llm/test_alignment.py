"""Alignments of many chains at once against one after another."""

import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pandas as pd

from noisefold.llm import substring
from noisefold.llm.substring import K


def grow_on(a, b):
    """An end's growth in plain steps."""
    i = j = edits = 0
    while True:
        m = min(len(a) - i, len(b) - j)
        score = np.cumsum(np.where(a[i : i + m] == b[j : j + m], 1, -2))
        n = int(score.argmax()) + 1 if m and score.max() > 0 else 0
        edits += int((a[i : i + n] != b[j : j + n]).sum())
        i, j = i + n, j + n
        for skip, p, q in ((1, 1, 0), (1, 0, 1), (2, 2, 0), (2, 0, 2)):
            need = skip * K
            x, y = a[i + p : i + p + need], b[j + q : j + q + need]
            if len(x) == len(y) == need and (x == y).all():
                i, j, edits = i + p, j + q, edits + skip
                break
        else:
            return i, j, edits


def edited(rng, n):
    """Words, and a copy with words replaced, inserted and dropped."""
    a = rng.integers(0, 1 << 32, n, dtype=np.uint32)
    b = []
    for w in a:
        k = rng.integers(0, 20)
        b += [] if k == 0 else [w, rng.integers(0, 1 << 32)] if k == 1 else [rng.integers(0, 1 << 32)] if k == 2 else [w]
    return a, np.array(b, np.uint32)


def test_ends_grow_together_as_one_by_one():
    rng, n = np.random.default_rng(1), 20_000
    a, b = edited(rng, n)
    at, ref_at = (rng.integers(0, len(t), 6000) for t in (a, b))
    at[:4000] = np.minimum(ref_at[:4000] + rng.integers(-2, 3, 4000), n - 1).clip(0)
    room, ref_room = np.minimum(rng.integers(0, 70, 6000), n - at), np.minimum(rng.integers(0, 70, 6000), len(b) - ref_at)
    for step in (1, -1):
        if step < 0:
            room, ref_room = np.minimum(room, at + 1), np.minimum(ref_room, ref_at + 1)
        began = time.process_time()
        got = substring.grow_ends(a, b, at, ref_at, step, room, ref_room)
        took, began = time.process_time() - began, time.process_time()
        ends = lambda t, p, r: t[p : p + r] if step > 0 else t[p + 1 - r : p + 1][::-1]  # noqa: B023, E731
        want = [grow_on(ends(a, *p), ends(b, *q)) for p, q in zip(zip(at, room), zip(ref_at, ref_room))]
        assert list(zip(*(v.tolist() for v in got))) == want
        assert sum(w[2] for w in want) > 100 and took < (time.process_time() - began) / 2


def test_parts_and_gaps_as_one_by_one():
    rng, a, b, at = np.random.default_rng(2), [], [], []
    x, y, sizes, bounds = [], [], [], []
    for c in range(60):
        p, q = edited(rng, 150)
        if c % 3 == 0:
            q[60:90] = rng.integers(0, 1 << 32, len(q[60:90]))  # below similarity, so parted
        seeds = {q[j : j + K].tobytes(): j for j in range(len(q) - K + 1)}
        found = [(i, seeds[p[i : i + K].tobytes()]) for i in range(len(p) - K + 1) if p[i : i + K].tobytes() in seeds]
        f, rf = sum(map(len, a)), sum(map(len, b))
        x += [f + i for i, _ in found]
        y += [rf + j for _, j in found]
        sizes.append(len(found))
        bounds.append((f, f + len(p), rf, rf + len(q)))
        at.append((found, p, q))
        a.append(p)
        b.append(q)

    def parts(found, p, q):
        edits = 0
        loss = []
        for (i, j), (s, t) in zip(found, found[1:]):
            u, v = p[i:s], q[j:t]
            differ = int((u != v).sum()) if len(u) == len(v) else len(u) + len(v)
            e = differ if len(u) == len(v) and differ < 3 else min(differ, substring.banded_edits(u, v))
            edits += e
            loss.append(0.19999999999999996 * max(len(u), len(v)) - e)
        (i, j), (s, t) = found[0], found[-1]
        left, right = grow_on(p[:i][::-1], q[:j][::-1]), grow_on(p[s + K :], q[t + K :])
        got = (i - left[0], s + K + right[0], j - left[1], t + K + right[1], edits + left[2] + right[2])
        if len(found) == 1 or got[4] <= (1 - 0.8) * max(got[1] - got[0], got[3] - got[2]):
            return [got]
        k = int(np.argmin(loss)) + 1
        return parts(found[:k], p, q) + parts(found[k:], p, q)

    want = sorted((c, s + bounds[c][0], e + bounds[c][0], rs + bounds[c][2], re_ + bounds[c][2], n) for c, v in enumerate(at) for s, e, rs, re_, n in parts(*v))
    got = substring.align_many(np.concatenate(a), np.concatenate(b), np.array(x), np.array(y), np.array(sizes), np.array(bounds), 0.8)
    assert sorted(zip(*(v.tolist() for v in got))) == want and len(want) > 60


def test_words_are_hashed_once_for_all_tasks_of_a_process(monkeypatch):
    calls = []
    real = substring.xxh64_intdigest
    monkeypatch.setattr(substring, "xxh64_intdigest", lambda w: calls.append(w) or real(w))
    monkeypatch.setattr(substring, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    docs = pd.DataFrame({"id": [1], "th": [2], "text": ["some words Words, that nobody has hashed before"]})
    first, second = (list(substring.make_blocks(1 << 18, iter([docs])))[0] for _ in range(2))
    assert first.equals(second) and 0 < len(calls) <= 8


def test_texts_are_split_and_hashed_together_as_one_by_one():
    """At any white space that str.split knows, with words in any case, over slices and forgotten words."""
    spaces = "".join(c for c in map(chr, range(0x110000)) if c.isspace())
    texts = [f"a{s}B,{s}{s}a" for s in spaces] + ["", " ", spaces, " Ärger  ärger. ", "...", "İx ß ſ ςΣ «q»", "x" * 50, *(f"n{i} N{i}! m{i % 7}" for i in range(300))]
    want = [substring.word_hashes(t, substring.WordHashes()).tolist() for t in texts]
    for most in (0, 20, 100_000):
        known = substring.KnownWords(most)
        assert [[h.tolist() for h in substring.many_word_hashes(texts, known)] for _ in range(2)] == [want, want]
        assert len(known.words) == len(known.hashes)


def test_blocks_reuse_the_memory_of_their_arrays():
    """Arrays that come and go by the hundred don't clear their pages anew each time: under a page for each hundred words of a block, of which the seeds are made three times."""
    code = """
import resource
import numpy as np
from noisefold.llm import substring
words = np.random.default_rng(1).integers(0, 1 << 32, 200_000, dtype=np.uint32)
data = substring.Block.data(list(range(400)), list(range(400)), np.split(words, 400))
faults = []
for _ in range(4):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    substring.Block(0, data).seeds(substring.LEVELS)
    faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
print(sum(faults[1:]))
"""
    root = Path(__file__).parents[2]
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) < 2000
