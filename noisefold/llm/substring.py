"""Operator 1: passages that documents share, exactly or nearly, by collinear chaining of k-mer seeds.

Seeds are all four-word k-mers. Of L words at a similarity of 0.8, at least 0.8 L are equal and lie in at most 0.2 L + 1 runs, so 0.2 L - 3 k-mers or more are shared, 7 for 50 words: no such passage is without a seed, wherever its edits stand. A seed's anchor is its first occurrence in document order, and every other occurrence is matched with that one only (of each length: see below), so a passage of a million documents gives a million rows, not their square. A short seed may have its anchor in a smaller document by chance, where nothing else is shared; so pairs of k-mers, which chance seldom shares, and minimizers of _FRAGMENT words are seeds too, with anchors of their own. A pair is two k-mers in a row or with one word between them, hashed alike, so that it outlasts an edit of that word: a replaced, inserted or dropped one. Of pairs those stay whose hash is divisible by _PAIR_SHARE, wherever they stand. Of the pairs that two passages share, one is enough: 50 words of which every fifth is replaced share eight, of which one stays with 0.96, and 80 words share fourteen (0.997). Every equal stretch of 23 words holds a minimizer, whichever documents its shorter seeds are in.

Each document's matches are chained: ordered in both texts, with gap costs, best predecessors found in a Fenwick tree over positions in the other text. A match of K words alone begins no chain; one of eight words or more does. Where a document has fewer matches than a passage must have, none is aligned, and few matches inside a stretch that is chained already add nothing and go. Chains are aligned: extended at both ends, gaps between seeds aligned in a band, parted at the worst gap while they are below `similarity`, and kept at `similarity` or more. What a document shares with several anchors side by side is joined into one passage, and passages of at least min_words words are reported.

How it is spread: documents are dealt by ranges of (id, hash of the text) to blocks of about BLOCK_WORDS words, a row each, whose words are 32-bit hashes. Most seeds stand in one place only, so two rounds keep them from being moved in full. First a block sends its distinct seeds as short sorted hashes, in shards by hash range, and learns with a bit each which of them other blocks may have. Then it sends hash and place of these only, and gets back their anchors. A block sends a seed once, however many of its documents have it, so a seed of a third of all documents is an entry a block. References are fetched by fixed chunks of words, once for each block that asks.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import pickle
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from noisefold.llm.common import cut, drop_folder

K = 4
_FRAGMENT = 16  # words of the shortest piece that may join a passage
LEVELS = ((K, 1), (_FRAGMENT, 8))  # words and window of the seeds: short ones reach edited text, long ones are in no smaller document by chance
_PAIR_SHARE = 3  # one pair of k-mers of so many is a seed
MIN_WORDS = 50
SIMILARITY = 0.8
BLOCK_WORDS = 1 << 18
_SHARD_SEEDS = 1 << 22
_CHUNK = 128  # words of a reference that are fetched together
_MAX_GAP = 40  # words between seeds: equal text has one at every word
_PAD = MIN_WORDS  # words beyond the outer seeds that a chain may grow into
_RUN_STEP = 6  # words between equal seeds of a run, of which MIN_WORDS words then hold _LEAST
_STRETCH_STEP = 20  # words between seeds of a stretch that are chained
_STRETCH_GAP = K + 1  # words from one seed to the next within a stretch: one word between them may differ
_REPEAT = 50  # words within which equal seeds of one document are a run
_CELLS = 1 << 20  # words of ends that grow together
_SPLIT = 1 << 22  # characters of the texts that are split together
_HELD = 32 << 20  # bytes of freed memory that a worker keeps
_TOGETHER = 500  # documents that are aligned together
_LEAST = 7  # k-mers that MIN_WORDS words at SIMILARITY share: 40 equal words in at most 11 runs, of which each loses K - 1


@cache
def hold_memory() -> None:
    """Have this process keep up to _HELD bytes that it freed, and take arrays of that size from them: a block's arrays come and go by the hundred, and to clear their pages each time costs about a quarter of the work. Without such a setting in the C library all stays as it is."""
    with contextlib.suppress(AttributeError, OSError, TypeError):
        mallopt = ctypes.CDLL(None).mallopt
        for which in (-3, -1):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            mallopt(which, _HELD)


_ENDS = ".,;:!?\"'()[]{}<>*#%$&|-_/\\«»“”„’‘…"


class WordHashes(dict):
    """Hash of a word as compared: lower case, without punctuation at its ends."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxh64_intdigest(word.lower().strip(_ENDS) or word)
        return h


class KnownWords:
    """Words and their hashes as WordHashes has them, looked up many at a time; at most `most`, or the last ones asked for."""

    def __init__(self, most: int = 100_000):
        self.most, self.words, self.hashes = most, pa.array([], pa.large_string()), np.zeros(0, np.uint64)

    def of(self, words: pa.Array) -> np.ndarray:
        """Hashes of distinct words."""
        at = pc.index_in(words, value_set=self.words)
        lost = at.is_null()
        new, missing = words.filter(lost), lost.to_numpy(zero_copy_only=False)
        out = np.empty(len(words), np.uint64)
        out[~missing] = self.hashes[at.drop_null().to_numpy()]
        out[missing] = [xxh64_intdigest(w.lower().strip(_ENDS) or w) for w in new.to_numpy(zero_copy_only=False).tolist()]
        if len(self.words) + len(new) > self.most:
            self.words, self.hashes = words, out
        elif len(new):
            self.words, self.hashes = pa.concat_arrays([self.words, new]), np.concatenate([self.hashes, out[missing]])
        return out


_known = KnownWords()  # of this process: most words of a task were in the one before


def word_hashes(text: str, known: WordHashes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def many_word_hashes(texts: list[str], known: KnownWords) -> Iterator[np.ndarray]:
    """word_hashes of each text. Texts are split together, _SPLIT characters at a time, and each distinct word of these is hashed once; Arrow splits at the white space that str.split does."""
    begin = 0
    while begin < len(texts):
        end, size = begin + 1, len(texts[begin])
        while end < len(texts) and size + len(texts[end]) <= _SPLIT:
            size += len(texts[end])
            end += 1
        split = pc.utf8_split_whitespace(pa.array(texts[begin:end], pa.large_string()))
        words, begin = split.flatten().dictionary_encode(), end
        names, at = words.dictionary, words.indices.to_numpy()
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        if (none := pc.index(names, "").as_py()) >= 0:  # what Arrow finds before white space that begins a text and behind that which ends it
            there = at != none
            ends, at = np.concatenate([[0], np.cumsum(there)])[ends], at[there]
        yield from np.split(known.of(names)[at], ends[:-1])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; equal places of the numbers stand together, which compresses."""
    return zstandard.compress(pickle.dumps([(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()) for a in arrays]), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).reshape(-1) for kind, b in pickle.loads(zstandard.decompress(data))]


# ---- seeds ----


def _polynomials(words: np.ndarray, k: int) -> np.ndarray:
    """Of each k words in a row w: the sum of w[j] * base ** (k - 1 - j) mod 2 ** 64, by doubling."""
    base, out, have = 0x9E3779B97F4A7C15, words.astype(np.uint64), 1
    for bit in bin(k)[3:]:
        more = out[:-have] * np.uint64(pow(base, have, 1 << 64))
        more += out[have:]
        out, have = more, 2 * have
        if bit == "1":
            out, have = out[:-1] * np.uint64(base) + words[have:], have + 1
    return out


def minimizers(words: np.ndarray, k: int = K, window: int = 1, doc: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-mers that are smallest in some window of consecutive k-mers; windows are shorter at the ends of a document. doc has the words' documents where there are several. The last bit of a hash tells whether it is of more than K words."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _polynomials(words, k)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h = (h | np.uint64(1)) if k > K else (h & ~np.uint64(1))
    whole = np.ones(n, bool) if doc is None else doc[:n] == doc[k - 1 :]
    if window > 1:
        h[~whole] = np.uint64(2**64 - 1)
        edge = np.full(window - 1, 2**64 - 1, np.uint64)
        low = _sliding(np.concatenate([edge, h, edge]), window, np.minimum)
        whole &= _sliding(low, window, np.maximum) == h
    at = np.flatnonzero(whole)
    return at, h[at]


def pairs(words: np.ndarray, doc: np.ndarray, share: int = _PAIR_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Positions, in order, and hashes of the pairs of k-mers with no word or one between them; one hash of `share` stays, by its value. The last bit is set, as for all that are of more than K words."""
    n = len(words) - K + 1
    if n <= K:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    one = _polynomials(words, K)
    one ^= one >> np.uint64(32)
    pos, found = [], []
    for gap in (0, 1):
        step = K + gap
        h = one[: n - step] * np.uint64(0xD6E8FEB86659FD93) + one[step:]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        at = np.flatnonzero(((h >> np.uint64(1)) % np.uint64(share) == 0) & (doc[: n - step] == doc[step + K - 1 :]))
        pos.append(at)
        found.append(h[at] | np.uint64(1))
    at = np.concatenate(pos)
    order = np.argsort(at, kind="stable")
    return at[order], np.concatenate(found)[order]


def in_order(pos: np.ndarray, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds by hash and then position (each level's come by position). Where a document repeats itself within _REPEAT words, equal ones are a run, and one for every _RUN_STEP words of it stays: what grows from these covers the run."""
    low = np.uint64(len(h).bit_length())  # sorted by the hash's upper bits with the place below them, which is far faster than an argsort
    order = np.sort((h >> low << low) | np.arange(len(h), dtype=np.uint64)) & ((np.uint64(1) << low) - np.uint64(1))
    by, of = pos[order], h[order]
    new = np.ones(len(by), bool)
    again = np.flatnonzero(of[1:] == of[:-1]) + 1
    now, then = by[again], by[again - 1]
    new[again] = (now - then > _REPEAT) | (doc[now] != doc[then])
    if not new.all():
        step = (by - by[np.flatnonzero(new)][np.cumsum(new) - 1]) // _RUN_STEP
        new[1:] |= step[1:] != step[:-1]
        by, of = by[new], of[new]
    return by, of


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each run of w values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


class Block:
    """The documents of a block: ids, text hashes, the first word of each, and the words."""

    def __init__(self, block: int, data: bytes):
        hold_memory()
        self.block = block
        self.known, self.ids, self.texts, self.starts, names, codes = unpack(data)
        self.words = names[codes]

    @staticmethod
    def data(ids: list[int | None], texts: list[int], words: list[np.ndarray]) -> bytes:
        """Words are written as places in the block's own list, the frequent ones first."""
        every = np.concatenate(words)
        by = np.sort(every.astype(np.uint64) << np.uint64(32) | np.arange(len(every), dtype=np.uint64))  # words with their places, which is faster than an argsort
        sorted_ = (by >> np.uint64(32)).astype(np.uint32)
        new = np.ones(len(by), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        names, times = sorted_[new], np.diff(np.append(np.flatnonzero(new), len(by)))
        where = np.empty(len(by), np.int64)
        where[by & np.uint64(0xFFFFFFFF)] = np.cumsum(new) - 1
        order = np.argsort(-times, kind="stable")
        place = np.empty(len(names), np.uint32)
        place[order] = np.arange(len(names))
        starts = np.cumsum([0, *map(len, words)]).astype(np.uint32)
        return pack(np.array([i is not None for i in ids], np.uint8), np.array([i or 0 for i in ids], np.int64), np.array(texts, np.int64), starts, names[order], place[where])

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.starts.astype(np.int64)))

    def seeds(self, levels: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct seeds by hash, their first positions, and all positions with the seed's number."""
        doc, words = self.doc_of(), self.words.astype(np.uint64)
        pos, h = in_order(*map(np.concatenate, zip(*(minimizers(words, k, w, doc) for k, w in levels), pairs(words, doc))), doc)
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        return h[new], pos[new], pos, np.cumsum(new) - 1


def make_blocks(block_words: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over documents sorted by id and text hash: a row per block. Rows with equal id and text are one document; blocks of a task are numbered on."""
    hold_memory()
    known, base, last = _known, TaskContext.get().partitionId() << 32, None
    ids, texts, words, size = [], [], [], 0

    def row() -> pd.DataFrame:
        return pd.DataFrame({"block": [base], "n": [size], "data": [Block.data(ids, texts, words)]})

    for pdf in batches:
        for i, th, all_words in zip(pdf["id"].array, pdf["th"], many_word_hashes(pdf["text"].tolist(), known)):
            i = None if pd.isna(i) else int(i)
            if (i, th) == last:
                continue
            last = (i, th)
            own = (all_words >> np.uint64(32)).astype(np.uint32)
            if not len(own):
                continue
            if size and size + len(own) > block_words:
                yield row()
                base, ids, texts, words, size = base + 1, [], [], [], 0
            ids.append(i)
            texts.append(int(th))
            words.append(own)
            size += len(own)
    if size:
        yield row()


# ---- which seeds occur elsewhere, and where first ----


def _by_shard(h: np.ndarray, bits: int, shards: int) -> Iterator[tuple[int, slice]]:
    edge = np.searchsorted(h, np.arange(1, shards, dtype=np.uint64) << np.uint64(bits - (shards.bit_length() - 1)))
    for s, (a, b) in enumerate(zip([0, *edge], [*edge, len(h)])):
        if b > a:
            yield s, slice(int(a), int(b))


def _deltas(h: np.ndarray) -> np.ndarray:
    d = np.diff(h, prepend=np.uint64(0))
    return d.astype(np.uint32) if len(d) == 0 or d[1:].max(initial=0) < 1 << 32 and d[0] < 1 << 32 else d


def send_hashes(levels, bits: int, shards: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each block's distinct seeds as their first `bits` bits, by shard."""
    for pdf in batches:
        for block, data in zip(pdf["block"], pdf["data"]):
            h = Block(block, data).seeds(levels)[0] >> np.uint64(64 - bits)
            low = np.uint64(bits - (shards.bit_length() - 1))
            rows = [(s, block, pack(_deltas(h[at] - (np.uint64(s) << low)))) for s, at in _by_shard(h, bits, shards)]
            yield pd.DataFrame(rows, columns=["shard", "block", "data"])


def find_shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a shard: for each block a bit for each hash, set where the hash came more than once."""
    held = [np.cumsum(unpack(d)[0].astype(np.uint64)) for d in pdf["data"]]
    every = np.sort(np.concatenate(held))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    rows = []
    for block, h in zip(pdf["block"], held):
        at = np.searchsorted(twice, h)
        at[at == len(twice)] = 0
        bits = twice[at] == h if len(twice) else np.zeros(len(h), bool)
        if bits.any():
            rows.append((pdf["shard"].iloc[0], block, np.packbits(bits).tobytes()))
    return pd.DataFrame(rows, columns=["shard", "block", "data"])


def send_places(levels, bits: int, more_bits: int, shards: int, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """A block's seeds that others may have: longer hash and first position, by shard."""
    block = Block(own["block"].iloc[0], own["data"].iloc[0])
    h, first, _, _ = block.seeds(levels)
    short, keep = h >> np.uint64(64 - bits), np.zeros(len(h), bool)
    bit_of = dict(zip(told["shard"], told["data"]))
    for s, at in _by_shard(short, bits, shards):
        if s in bit_of:
            keep[at] = np.unpackbits(np.frombuffer(bit_of[s], np.uint8), count=at.stop - at.start).astype(bool)
    h, first, short = h[keep] >> np.uint64(64 - more_bits), first[keep], short[keep]
    low = np.uint64(more_bits - (shards.bit_length() - 1))
    rows = [(s, block.block, pack(_deltas(h[at] - (np.uint64(s) << low)), first[at].astype(np.uint32))) for s, at in _by_shard(short, bits, shards)]
    return pd.DataFrame(rows, columns=["shard", "block", "data"])


def find_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a shard: for each block the hashes whose first place is in an earlier block, and that place."""
    pdf = pdf.sort_values("block")
    blocks = pdf["block"].to_numpy()
    held = [unpack(d) for d in pdf["data"]]
    h = np.concatenate([np.cumsum(x[0].astype(np.uint64)) for x in held])
    place, sizes = np.concatenate([x[1] for x in held]), np.array([len(x[1]) for x in held])
    of = np.repeat(np.arange(len(blocks)), sizes)
    order = np.argsort(h, kind="stable")  # blocks stay in order within a hash
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    first = np.empty(len(h), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    rows, ends = [], np.cumsum(sizes)
    for k, (a, b) in enumerate(zip(ends - sizes, ends)):
        away = np.flatnonzero(of[first[a:b]] != k) + a
        if len(away):
            rows.append((pdf["shard"].iloc[0], blocks[k], pack(h[away], blocks[of[first[away]]], place[first[away]])))
    return pd.DataFrame(rows, columns=["shard", "block", "data"])


# ---- chains ----


class Fenwick:
    """Prefix maxima of (value, index) pairs."""

    def __init__(self, n: int):
        self.best = [(-math.inf, -1)] * (n + 1)

    def put(self, i: int, x: tuple[float, int]) -> None:
        i += 1
        best, n = self.best, len(self.best)
        while i < n:
            if x > best[i]:
                best[i] = x
            i += i & -i

    def top(self, i: int) -> tuple[float, int]:
        """Over indices below i."""
        x, best = (-math.inf, -1), self.best
        while i:
            if best[i] > x:
                x = best[i]
            i &= i - 1
        return x


def chains(x: np.ndarray, y: np.ndarray, gap_cost: float = 0.01, max_gap: int = _MAX_GAP) -> list[np.ndarray]:
    """Chains of matches (x, y) that increase in both: indices, each match in one chain at most, best chains first.

    A match scores 1 and a step costs gap_cost for each word it moves in either text. x is sorted. Chains are cut where a step exceeds max_gap. Matches that all lie on one diagonal are a chain as they are.
    """
    if len(x) > 1 and (y - x == y[0] - x[0]).all() and (x[1:] > x[:-1]).all():
        found = [np.arange(len(x))]
    else:
        order = np.lexsort((y, x))
        xs, ys = x[order].tolist(), y[order].tolist()
        ranks = np.unique(y)
        rank = np.searchsorted(ranks, y[order]).tolist()
        tree, score, before = Fenwick(len(ranks)), [0.0] * len(xs), [-1] * len(xs)
        i = 0
        while i < len(xs):
            j = i
            while j < len(xs) and xs[j] == xs[i]:
                value, at = tree.top(rank[j])
                value -= gap_cost * (xs[j] + ys[j])
                score[j] = 1.0
                if at >= 0 and value > 0:
                    score[j], before[j] = 1.0 + value, at
                j += 1
            for m in range(i, j):
                tree.put(rank[m], (score[m] + gap_cost * (xs[m] + ys[m]), m))
            i = j
        used, found = [False] * len(xs), []
        for end in sorted(range(len(xs)), key=lambda m: (-score[m], m)):
            path = []
            while end >= 0 and not used[end]:
                used[end] = True
                path.append(end)
                end = before[end]
            if path:
                found.append(order[path[::-1]])
    out = []
    for c in found:
        if len(c) < 2:
            continue
        at, to = x[c], y[c]
        cuts = np.flatnonzero(np.maximum(at[1:] - at[:-1], to[1:] - to[:-1]) > max_gap + K) + 1
        out += [part for part in np.split(c, cuts) if len(part) > 1] if len(cuts) else [c]
    return out


def _dense(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which matches lie in MIN_WORDS words of their document where _LEAST or more words begin a match."""
    if not len(doc):
        return np.zeros(0, bool)
    key = doc.astype(np.int64) << 32 | pos.astype(np.int64)
    at, where = np.unique(key, return_inverse=True)
    full = np.searchsorted(at, at + MIN_WORDS) - np.arange(len(at)) >= _LEAST  # windows that begin at a match
    upto = np.concatenate([[0], np.cumsum(full)])
    return (upto[np.arange(1, len(at) + 1)] > upto[np.searchsorted(at, at - MIN_WORDS + 1)])[where]


def _near_others(doc: np.ndarray, x: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Which matches have another with the same reference block near enough for a chain."""
    order = np.lexsort((x, ref, doc))
    d, r, at = doc[order], ref[order], x[order]
    near = (d[1:] == d[:-1]) & (r[1:] == r[:-1]) & (np.diff(at) <= _MAX_GAP + K)
    out = np.zeros(len(x), bool)
    out[order[1:][near]] = out[order[:-1][near]] = True
    return out


def _condensed(doc: np.ndarray, x: np.ndarray, ref: np.ndarray, y: np.ndarray, long_seed: np.ndarray) -> np.ndarray:
    """Which matches to chain, in the order of doc, ref, x, y; of equal ones a long seed. A stretch is a run of matches on one diagonal, _STRETCH_GAP words apart at most, and so at SIMILARITY throughout: its ends and one for every _STRETCH_STEP words stay. A shorter one than _FRAGMENT words goes where longer ones cover it: pieces that are long enough are found there anyway."""
    if not len(doc):
        return np.zeros(0, np.int64)
    order = np.lexsort((~long_seed, x, y - x, ref, doc))
    d, r, at, diagonal = doc[order], ref[order], x[order], (y - x)[order]
    line = np.zeros(len(order), bool)
    line[:1] = True
    line[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (diagonal[1:] != diagonal[:-1])
    apart = np.diff(at, prepend=-1)
    once = line | (apart != 0)
    order, at, line, apart = order[once], at[once], line[once], apart[once]
    new = line | (apart > _STRETCH_GAP)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(order)) - 1
    step = (at - at[begin][np.cumsum(new) - 1]) // _STRETCH_STEP
    keep = new.copy()
    keep[1:] |= step[1:] != step[:-1]
    keep[end] = True
    wide = at[end] + K - at[begin] >= _FRAGMENT
    if wide.any():
        edge = np.zeros(int(x.max()) + K + 2, np.int32)
        np.add.at(edge, at[begin[wide]], 1)
        np.add.at(edge, at[end[wide]] + K, -1)
        bare = np.concatenate([[0], np.cumsum(np.cumsum(edge) == 0)])  # words before each that no wide stretch covers
        within = ~wide & (bare[at[end] + K] == bare[at[begin]])
        keep &= ~within[np.cumsum(new) - 1]
    kept = order[keep]
    return kept[np.lexsort((y[kept], x[kept], ref[kept], doc[kept]))]


def _within(mask: np.ndarray, which, *columns: np.ndarray) -> np.ndarray:
    """mask, less the rows of it that `which` of its columns leaves out."""
    out = np.zeros(len(mask), bool)
    out[np.flatnonzero(mask)[which(*(c[mask] for c in columns))]] = True
    return out


def _parts(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n[i] whole numbers from each first[i] on, one after another: (i, number)."""
    of = np.repeat(np.arange(len(n)), n)
    return of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _chunks_of(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunks, from and to, that chains with these outer positions need of their reference."""
    return np.maximum(0, first - _PAD) // _CHUNK, (last + K + _PAD) // _CHUNK + 1


def chain_block(levels, more_bits: int, shards: int, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """A row for each document of a block that has enough matches: its words, its chains (blocks of reference, sizes, positions in both texts), and the chunks of reference that these need. Positions are words of the document, and words of the reference's block."""
    block = Block(own["block"].iloc[0], own["data"].iloc[0])
    h, first, x, num = block.seeds(levels)
    ref, y = np.full(len(h), block.block, np.int64), first.astype(np.int64)
    long_, low = h >> np.uint64(64 - more_bits), np.uint64(more_bits - (shards.bit_length() - 1))
    for s, data in zip(told["shard"], told["data"]):
        name, where, place = unpack(data)
        name += np.uint64(s) << low
        at = np.minimum(np.searchsorted(long_, name), len(long_) - 1)
        hit = long_[at] == name
        ref[at[hit]], y[at[hit]] = where[hit], place[hit]
    doc_of = block.doc_of()
    ref, y, doc = ref[num], y[num], doc_of[x].astype(np.int64)
    inside = ref == block.block
    away = ~inside
    away[inside] = doc_of[y[inside]] != doc[inside]
    away = _within(away, _dense, doc, x)
    away &= (h & np.uint64(1))[num].astype(bool) | _within(away, _near_others, doc, x, ref)
    x, y, ref, doc, long_seed = x[away], y[away], ref[away], doc[away], (h & np.uint64(1))[num][away].astype(bool)
    kept = _condensed(doc, x, ref, y, long_seed)
    x, y, ref, doc, long_seed = x[kept], y[kept], ref[kept], doc[kept], long_seed[kept]
    starts = block.starts.astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1]), [True]])) if len(doc) else np.zeros(1, int)
    found: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        some = found.setdefault(int(doc[a]), [])
        alone = np.ones(b - a, bool)
        for c in chains(x[a:b], y[a:b]) if b - a > 1 else ():
            some.append((int(ref[a]), x[a:b][c], y[a:b][c]))
            alone[c] = False
        some += [(int(ref[a]), x[k : k + 1], y[k : k + 1]) for k in a + np.flatnonzero(alone & long_seed[a:b])]
    rows = []
    for d, got in found.items():
        if not got:
            continue
        refs, sizes, xs, ys = np.array([g[0] for g in got]), np.array([len(g[1]) for g in got], np.int32), np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
        low, high = _chunks_of(np.array([g[2][0] for g in got]), np.array([g[2][-1] for g in got]))
        of, chunk = _parts(low, high - low)
        asked = np.array(sorted(set(zip(refs[of].tolist(), chunk.tolist()))))
        words = block.words[starts[d] : starts[d + 1]]
        rows.append((block.block, block.ids[d] if block.known[d] else None, block.texts[d], pack(words, refs, sizes, (xs - starts[d]).astype(np.int32), ys.astype(np.int32)), asked[:, 0], asked[:, 1]))
    out = pd.DataFrame(rows, columns=["block", "doc", "th", "data", "ask_block", "ask_chunk"])
    out["doc"] = pd.array([None if r[1] is None else int(r[1]) for r in rows], dtype="Int64")
    return out


_CHAINS = "block long, doc long, th long, data binary, ask_block array<long>, ask_chunk array<long>"


_CHUNKS = "ask_block long, ask_chunk long, words binary, starts binary, ids binary, known binary"


def cut_chunks(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The asked chunks of a block: words; first word of each document in them, and the end of the last; their ids."""
    rows = []
    if len(own):
        block = Block(own["block"].iloc[0], own["data"].iloc[0])
        for c in sorted(asked["chunk"]):
            lo, hi = c * _CHUNK, min((c + 1) * _CHUNK, len(block.words))
            if lo < hi:
                a, b = np.searchsorted(block.starts, lo, "right") - 1, np.searchsorted(block.starts, hi, "left")
                rows.append((block.block, c, block.words[lo:hi].tobytes(), block.starts[a : b + 1].tobytes(), block.ids[a:b].tobytes(), block.known[a:b].tobytes()))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _CHUNKS.split(", ")])


class Reference:
    """What is known of a block of reference: chunks in order, and the documents in them."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("ask_chunk")
        self.chunks = pdf["ask_chunk"].to_numpy()
        self.words = np.frombuffer(b"".join(pdf["words"]), np.uint32)
        of = lambda c, kind: [np.frombuffer(x, kind) for x in pdf[c]]
        edges = of("starts", np.uint32)
        starts, ends = (np.concatenate([e[cut_] for e in edges]).astype(np.int64) for cut_ in (slice(None, -1), slice(1, None)))
        self.starts, once = np.unique(starts, return_index=True)
        self.ends, self.ids, self.known = ends[once], np.concatenate(of("ids", np.int64))[once], np.concatenate(of("known", np.uint8))[once]


def banded_edits(a: np.ndarray, b: np.ndarray, band: int = 12) -> int:
    """Edit distance of two short word sequences within a band around the diagonal."""
    if len(a) > len(b):
        a, b = b, a
    extra = len(b) - len(a)
    if not len(a) or extra > 4 * band:
        return len(b)
    lo, hi = -band, extra + band
    big = len(a) + len(b)
    row = {j: j for j in range(0, min(len(b), hi) + 1)}
    bl = b.tolist()
    for i, w in enumerate(a.tolist(), 1):
        new, left = {}, big
        for j in range(max(0, i + lo), min(len(b), i + hi) + 1):
            best = min(row.get(j, big) + 1, left + 1)
            if j:
                best = min(best, row.get(j - 1, big) + (bl[j - 1] != w))
            new[j] = left = best
        row = new
    return row.get(len(b), big)


def grow_ends(a: np.ndarray, b: np.ndarray, at: np.ndarray, ref_at: np.ndarray, step: int, room: np.ndarray, ref_room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far ends grow in both texts, and the edits, for many ends at once: from a[at] and b[ref_at] on, forwards (step 1) or back (-1), over at most `room` and `ref_room` words.

    An end grows over its best-scoring extension (1 an equal word, -2 another), and over one or two words that only one text has where K words or twice as many follow that are equal, again and again.
    """
    i, j, edits = (np.zeros(len(at), np.int64) for _ in range(3))
    wide = np.maximum(room, ref_room)
    order, begin = np.argsort(wide, kind="stable"), 0
    while begin < len(order):
        end = max(begin + 1, int(np.searchsorted(wide[order] * np.arange(1 - begin, len(order) + 1 - begin), _CELLS, "right")))
        some, begin = order[begin:end], end
        width = int(wide[some].max())
        if not width:
            continue
        steps = np.arange(2 * width + 3 * K)
        taken = lambda text, at, room, none: np.where(steps < room[some, None], text[np.clip(at[some, None] + step * steps, 0, len(text) - 1)].astype(np.int64), none)  # noqa: B023, E731
        x, y = taken(a, at, room, -1), taken(b, ref_at, ref_room, -2)  # beyond their ends texts differ
        go, p, q, e = np.arange(len(some)), *(np.zeros(len(some), np.int64) for _ in range(3))
        while len(go):
            from_ = lambda text, at, n: text[go[:, None], at[go, None] + np.arange(n)]  # noqa: B023, E731
            score = np.cumsum(np.where(from_(x, p, width) == from_(y, q, width), 1, -2), axis=1)
            k = score.argmax(1)
            best = score[np.arange(len(go)), k]
            n = np.where(best > 0, k + 1, 0)
            p[go] += n
            q[go] += n
            e[go] += np.where(best > 0, (n - best) // 3, 0)
            moved = np.zeros(len(go), bool)
            for skip in (1, 2):
                for over, ref_over in ((skip, 0), (0, skip)):
                    fits = ~moved & (from_(x, p + over, skip * K) == from_(y, q + ref_over, skip * K)).all(1)
                    p[go[fits]] += over
                    q[go[fits]] += ref_over
                    e[go[fits]] += skip
                    moved |= fits
            go = go[moved]
        i[some], j[some], edits[some] = p, q, e
    return i, j, edits


def gap_edits(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, to_x: np.ndarray, to_y: np.ndarray) -> np.ndarray:
    """Edits between a[x:to_x] and b[y:to_y], for many gaps between seeds at once: words that differ where these are under three, else in a band."""
    across, down = to_x - x, to_y - y
    even = np.flatnonzero(across == down)
    of, left = _parts(x[even], across[even])
    edits = across + down
    edits[even] = np.bincount(of[a[left] != b[left + (y - x)[even][of]]], minlength=len(even))
    for k in np.flatnonzero((across != down) | (edits >= 3)).tolist():
        edits[k] = min(banded_edits(a[x[k] : to_x[k]], b[y[k] : to_y[k]]), edits[k])
    return edits


def align_many(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, sizes: np.ndarray, bounds: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """Alignments of many chains at once: chain, start, end, reference start, reference end, edits. Chains stand in x and y, `sizes` seeds of K words each, as places in the texts a and b; bounds has the first place and the end of the words that each may grow into, in a and then in b.

    A chain below similarity is parted at the gap with most edits for its words, and so are its parts. Gaps are aligned once for all parts.
    """
    hi = np.cumsum(sizes)
    lo, chain = hi - sizes, np.arange(len(sizes))
    inner = np.setdiff1d(np.arange(len(x)), hi - 1, assume_unique=True)  # seeds with another behind them
    edits = np.zeros(len(x), np.int64)
    edits[inner] = gap_edits(a, b, x[inner], y[inner], x[inner + 1], y[inner + 1])
    loss = np.zeros(len(x))
    loss[inner] = (1 - similarity) * np.maximum(x[inner + 1] - x[inner], y[inner + 1] - y[inner]) - edits[inner]
    upto, out = np.concatenate([[0], np.cumsum(edits)]), []
    while len(lo):
        f, t, rf, rt = bounds[chain].T
        (x0, y0), (x1, y1) = (x[lo], y[lo]), (x[hi - 1] + K, y[hi - 1] + K)
        left, ref_left, more = grow_ends(a, b, x0 - 1, y0 - 1, -1, x0 - f, y0 - rf)
        right, ref_right, again = grow_ends(a, b, x1, y1, 1, np.maximum(t - x1, 0), np.maximum(rt - y1, 0))
        found = np.stack([chain, x0 - left, x1 + right, y0 - ref_left, y1 + ref_right, upto[hi - 1] - upto[lo] + more + again])
        ok = (hi - lo == 1) | (found[5] <= (1 - similarity) * np.maximum(found[2] - found[1], found[4] - found[3]))
        out.append(found[:, ok])
        lo, hi, chain = lo[~ok], hi[~ok], chain[~ok]
        at = np.array([s + 1 + int(np.argmin(loss[s : e - 1])) for s, e in zip(lo.tolist(), hi.tolist())], np.int64)
        lo, hi, chain = np.concatenate([lo, at]), np.concatenate([at, hi]), np.concatenate([chain, chain])
    return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64),) * 6


def _aligned(similarity: float, docs: list[tuple], have: dict[int, Reference], first: dict[int, int], b: np.ndarray) -> pd.DataFrame:
    """Aligned pieces of some documents (id, text hash, packed chains), whose references stand one after another in b, from `first` on."""
    held = [unpack(d[2]) for d in docs]
    own = np.cumsum([0, *(len(h[0]) for h in held)])  # where each document begins in a
    a = np.concatenate([h[0] for h in held])
    refs, sizes = (np.concatenate([h[k] for h in held]).astype(np.int64) for k in (1, 2))
    of = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
    x, y = (np.concatenate([h[k] for h in held]).astype(np.int64) for k in (3, 4))
    seed_of = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    low, high = _chunks_of(y[ends - sizes], y[ends - 1])
    d, start, end, shift = (np.zeros(n, np.int64) for n in (len(y), len(y), len(y), len(sizes)))
    for ref in np.unique(refs).tolist():
        known, mine = have[ref], refs == ref
        shift[mine] = first[ref] + (np.searchsorted(known.chunks, low[mine]) - low[mine]) * _CHUNK  # a chain's chunks stand in a row, and all before them are whole
        here = mine[seed_of]
        d[here] = at = np.searchsorted(known.starts, y[here], "right") - 1
        start[here], end[here] = known.starts[at], known.ends[at]
    new = np.flatnonzero(np.concatenate([[True], (seed_of[1:] != seed_of[:-1]) | (d[1:] != d[:-1])]))  # neighbours in a block may share one chain, a part for each
    last = np.append(new[1:], len(y)) - 1
    chain, doc = seed_of[new], of[seed_of[new]]
    move, ref_move = own[doc], shift[chain]
    bounds = np.stack([np.maximum(0, x[new] - _PAD), np.minimum(np.diff(own)[doc], x[last] + K + _PAD), np.maximum(np.maximum(low[chain] * _CHUNK, start[new]), y[new] - _PAD), np.minimum(end[new], y[last] + K + _PAD)], axis=1)
    bounds += np.stack([move, move, ref_move, ref_move], axis=1)
    n, s, e, rs, re_, edits = align_many(a, b, x + own[of[seed_of]], y + shift[seed_of], last - new + 1, bounds, similarity)
    ok = (e - s >= _FRAGMENT) & (edits <= (1 - similarity) * np.maximum(e - s, re_ - rs))
    n, s, e, rs, re_, edits = (v[ok] for v in (n, s, e, rs, re_, edits))
    to = [(have[r].ids[k], have[r].known[k]) for r, k in zip(refs[chain[n]].tolist(), d[new[n]].tolist())]
    ids = [docs[k][0] for k in doc[n].tolist()]
    begin = ref_move[n] + start[new[n]]
    return pd.DataFrame({
        "doc": pd.array(ids, dtype="Int64"), "th": np.array([docs[k][1] for k in doc[n].tolist()], np.int64), "ref": pd.array([int(i) if k else None for i, k in to], dtype="Int64"),
        "start": s - move[n], "end": e - move[n], "ref_start": rs - begin, "ref_end": re_ - begin, "edits": edits,
    })


def align_block(similarity: float, chained: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
    """Aligned pieces of a block's documents, of _FRAGMENT words or more and at similarity or more."""
    hold_memory()
    have = {block: Reference(g) for block, g in chunks.groupby("ask_block")}
    begins = np.cumsum([0, *(len(r.words) for r in have.values())]).tolist()
    first, b = dict(zip(have, begins)), np.concatenate([np.zeros(0, np.uint32), *(r.words for r in have.values())])
    docs = [(None if pd.isna(i) else int(i), th, data) for i, th, data in zip(chained["doc"].array, chained["th"], chained["data"])]
    out = [_aligned(similarity, docs[k : k + _TOGETHER], have, first, b) for k in range(0, len(docs), _TOGETHER)]
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["doc", "th", "ref", "start", "end", "ref_start", "ref_end", "edits"])


def text_hash(text_col: str = "text"):
    """The column that tells apart documents with one id."""
    return F.xxhash64(text_col)


def fragments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: tuple[tuple[int, int], ...] = LEVELS, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc, th, ref, start, end, ref_start, ref_end, edits: aligned pieces that the document (doc, th: id and text hash) shares with ref, the first document with their seeds. Positions count words split at white space; ends are exclusive."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("th"), F.col(text_col).alias("text")).where("text is not null")
    parts = max(1, math.ceil((own.agg(F.sum(F.length("text"))).first()[0] or 0) / (4 * block_words)))
    dealt = own.repartitionByRange(parts, F.col("id").isNull(), "id", "th").sortWithinPartitions(F.col("id").isNull(), "id", "th")
    blocks, blocks_at = cut(dealt.mapInPandas(partial(make_blocks, block_words), "block long, n long, data binary"), "blocks")
    n = max(2, blocks.agg(F.sum("n")).first()[0] or 0)
    bits = min(60, math.ceil(math.log2(n)) + 5)  # a false hit in thirty, which the second round rids of
    more_bits, shards = min(64, bits + 15), 1 << max(5, math.ceil(math.log2(2 * n / _SHARD_SEEDS)))
    blocks = blocks.drop("n")
    shared, shared_at = cut(blocks.mapInPandas(partial(send_hashes, levels, bits, shards), "shard int, block long, data binary").groupBy("shard").applyInPandas(find_shared, "shard int, block long, data binary"), "shared")
    places = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(partial(send_places, levels, bits, more_bits, shards), "shard int, block long, data binary")
    anchors, anchors_at = cut(places.groupBy("shard").applyInPandas(find_anchors, "shard int, block long, data binary"), "anchors")
    drop_folder(spark, shared_at)
    chained, chained_at = cut(blocks.groupBy("block").cogroup(anchors.groupBy("block")).applyInPandas(partial(chain_block, levels, more_bits, shards), _CHAINS), "chains")
    drop_folder(spark, anchors_at)
    asked = spark.read.schema(_CHAINS).parquet(chained_at).select("block", F.explode(F.arrays_zip("ask_block", "ask_chunk")).alias("x")).select("block", "x.ask_block", "x.ask_chunk").distinct()
    wanted = asked.select(F.col("ask_block").alias("block"), F.col("ask_chunk").alias("chunk")).distinct()
    chunks, _ = cut(blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(cut_chunks, _CHUNKS), "chunks")
    drop_folder(spark, blocks_at)
    replies = asked.join(chunks, ["ask_block", "ask_chunk"])
    return chained.select("block", "doc", "th", "data").groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(partial(align_block, similarity), "doc long, th long, ref long, start int, end int, ref_start int, ref_end int, edits int")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY, **how) -> DataFrame:
    """Repeated passages: doc_id, text_hash, start_word, end_word, n_words, ref_doc_id, ref_start_word, ref_end_word, n_fragments, edits.

    A passage is a run of words of which each lies in a piece that an earlier document has too, at similarity or more; its reference is that of its longest piece. Documents are in the order of id and then text hash, those without an id last; rows with equal id and text are one document, which is never compared with itself, and rows with one id and different texts are different documents. Null and empty texts have no passages. Texts are compared whole. Other columns are ignored; an empty table gives no rows.
    """
    f = fragments(docs, id_col, text_col, similarity=similarity, **how)
    w = Window.partitionBy("doc", "th").orderBy("start", "end", "ref", "ref_start")
    f = f.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-9)) + 2).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.col("end") - F.col("start")
    longest = F.max_by(F.struct("ref", "ref_start", "ref_end"), F.struct(size, -F.col("ref"), -F.col("ref_start"))).alias("to")
    merged = f.groupBy("doc", "th", "run").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), longest, F.count("*").alias("n_fragments"), F.sum("edits").alias("edits"))
    return merged.withColumn("n_words", F.col("end_word") - F.col("start_word")).where(F.col("n_words") >= min_words).select(F.col("doc").alias("doc_id"), F.col("th").alias("text_hash"), "start_word", "end_word", "n_words", F.col("to.ref").alias("ref_doc_id"), F.col("to.ref_start").alias("ref_start_word"), F.col("to.ref_end").alias("ref_end_word"), "n_fragments", "edits")


def remove_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs without the passages' words; a document that is left without a word goes. The white space after a removed passage goes with it. Rows are matched by id (null equals null) and text. Columns, whatever their names, and other rows stay as they are."""
    spans = found.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("th")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    own = F.col("row").getField(text_col)
    joined = rows.join(spans, F.col("row").getField(id_col).cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(own) == F.col("th")), "left")

    @F.pandas_udf("string")
    def without(text: pd.Series, spans: pd.Series) -> pd.Series:
        import re

        out = []
        for t, of in zip(text, spans):
            if of is None or t is None:
                out.append(t)
                continue
            place = [m.start() for m in re.finditer(r"\S+", t)] + [len(t)]
            parts, at = [], 0
            for s in sorted((x["start_word"], x["end_word"]) for x in of):
                parts.append(t[at : max(at, place[min(s[0], len(place) - 1)])])
                at = max(at, place[min(s[1], len(place) - 1)])
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    found_none = F.col("spans").isNull()
    kept = joined.select("row", found_none.alias("whole"), F.when(found_none, own).otherwise(without(own, F.col("spans"))).alias("left")).where(F.col("whole") | (F.trim("left") != ""))

    def column(c: str):
        if c == text_col:
            return F.col("left")
        if c == length_col:
            return F.when(F.col("whole"), F.col("row").getField(c)).otherwise(F.length("left")).cast(docs.schema[c].dataType)
        return F.col("row").getField(c)

    return kept.select(*(column(c).alias(c) for c in docs.columns))
