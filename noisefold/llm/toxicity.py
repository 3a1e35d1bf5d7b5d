"""Operator 10: toxic spans by a linear-chain conditional random field, aggregated to document scores.

Tags are T (toxic) and O. A token's emission is a sum of hashed feature weights of its word (the word, its beginnings and endings); transitions join neighbouring tags. Labels mark documents, so the training tokens are labelled from them: in a toxic document, a token is T where its word, a beginning or an ending of it stands in toxic documents far more often than chance allows (a log-likelihood ratio of `evidence`) and next to never in clean ones. The field then weighs all features together, and so tags words it never saw by their parts.

Forward-backward runs over a whole batch as one chain that forgets at each document's start; the odds of T follow a Moebius map per token, so chunks of the chain are composed side by side and texts of any length cost the same per token. A document's score is a logistic function of the highest marginal, fitted on the same sample.

The fit uses a bounded sample: at most `max_docs` labelled rows by hash of their id, `max_chars` characters of whole texts, `max_tokens` tokens. Scoring is one pass over the input without a shuffle.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

WORD = re.compile(r"\w+")
BUCKETS = 1 << 18
SPAN_TYPE = "array<struct<start: int, end: int, probability: double>>"


def parts(word: str) -> list[str]:
    """A lower-case word's features: itself, beginnings of 3 to 6 and endings of 3 to 5 characters."""
    n = len(word)
    return ["w" + word, *("b" + word[:k] for k in range(3, 7) if k <= n), *("e" + word[-k:] for k in range(3, 6) if k <= n)]


def buckets(word: str) -> list[int]:
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts(word)]


def _scan(a, b, c, d, first: float) -> np.ndarray:
    """r[t] = (a[t] + b[t] r[t-1]) / (c[t] + d[t] r[t-1]) from r[-1] = first, all positive; chunks side by side."""
    n = len(a)
    lanes = max(1, int(np.sqrt(n)))
    steps = -(-n // lanes)
    pad = lanes * steps - n
    a, b, c, d = (np.concatenate([x, np.full(pad, v)]).reshape(lanes, steps).T.copy() for x, v in ((a, 0.0), (b, 1.0), (c, 1.0), (d, 0.0)))
    m11, m12, m21, m22 = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for t in range(steps):  # r -> (m12 + m11 r) / (m22 + m21 r)
        m11, m12, m21, m22 = b[t] * m11 + a[t] * m21, b[t] * m12 + a[t] * m22, d[t] * m11 + c[t] * m21, d[t] * m12 + c[t] * m22
        if t % 8 == 7:
            s = m11 + m12 + m21 + m22
            m11, m12, m21, m22 = m11 / s, m12 / s, m21 / s, m22 / s
    r, at = np.empty(lanes), first
    for k in range(lanes):
        r[k] = at
        at = (m12[k] + m11[k] * at) / (m22[k] + m21[k] * at)
    out = np.empty((steps, lanes))
    for t in range(steps):
        r = out[t] = (a[t] + b[t] * r) / (c[t] + d[t] * r)
    return out.T.reshape(-1)[:n]


@dataclass
class Crf:
    weights: np.ndarray  # float32, by bucket
    moves: np.ndarray  # log weights of O->T, T->O, T->T, start T; O->O and start O are 0
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def emission(self, word: str) -> float:
        return float(min(20.0, max(-20.0, self.weights[buckets(word)].sum() + self.bias)))

    def odds(self, emission: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward odds r and backward odds q of T at each token; r * q are the marginal odds."""
        ot, to, tt, first = np.exp(self.moves)
        e = np.exp(emission)
        r = _scan(np.where(starts, first, ot) * e, np.where(starts, 0.0, tt) * e, np.ones(len(e)), np.where(starts, 0.0, to), 1.0)
        nxt, last = np.append(e[1:], 1.0), np.append(starts[1:], True)
        q = _scan(np.where(last, 1.0, to)[::-1], np.where(last, 0.0, tt * nxt)[::-1], np.ones(len(e)), np.where(last, 0.0, ot * nxt)[::-1], 1.0)[::-1]
        return r, q

    def marginals(self, emission: np.ndarray, starts: np.ndarray) -> np.ndarray:
        r, q = self.odds(emission, starts)
        return r * q / (1 + r * q)

    def document_score(self, top: np.ndarray) -> np.ndarray:
        """From the highest marginal of each document (0 for one without tokens)."""
        p = np.clip(top, 1e-9, 1 - 1e-9)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(p / (1 - p)) + self.offset, -40, 40)))


def _seen_before(words: list[str], seen: list[set[int]]) -> bool:
    """Whether a text is an exact or near copy of an earlier one: two of three min-hashes of its word triples were there before."""
    h = np.array([xxh64_intdigest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))], np.uint64)
    keys = [int((h * np.uint64(m)).min()) for m in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    found = sum(k in s for k, s in zip(keys, seen)) >= 2
    for k, s in zip(keys, seen):
        s.add(k)
    return found


def _steps(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of sizes, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def fit(texts: list[str], toxic: list[int], max_tokens: int = 600_000, rounds: int = 80, evidence: float = 10.0) -> Crf:
    """Train on labelled documents. Without both labels the field scores everything as clean."""
    number: dict[str, int] = {}
    docs, y, seen = [], [], [set(), set(), set()]
    for text, v in zip(texts, toxic):
        words = WORD.findall((text or "").lower())
        if words and not _seen_before(words, seen):
            docs.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
            y.append(v)
    y = np.array(y)
    crf = Crf(np.zeros(BUCKETS, np.float32), np.array([-4.0, 0.0, -1.0, -4.0]), -2.0, 1.0, -5.0)
    if not len(y) or y.min() == y.max():
        return crf
    # Documents of each class that have a feature.
    sizes = np.fromiter((len(set(parts(w))) for w in number), np.int64, len(number))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.fromiter((xxh64_intdigest(p) for w in number for p in set(parts(w))), np.uint64, int(ends[-1]))
    names, flat = np.unique(flat, return_inverse=True)
    flat = flat.astype(np.int32)
    counts = np.zeros((2, len(names)), np.int32)
    for d, v in zip(docs, y):
        own = np.unique(d)
        at = np.repeat(ends[own], ends[own + 1] - ends[own]) + _steps(ends[own + 1] - ends[own])
        counts[v, np.unique(flat[at])] += 1
    prior = y.mean()
    n, m = counts[1].astype(float), counts[0].astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = n / (n + m)
        ratio = n * np.log(share / prior) + np.where(m > 0, m * np.log((1 - share) / (1 - prior)), 0.0)
    strong = (share >= 0.98) & (ratio >= evidence)
    marked = np.maximum.reduceat(strong[flat], ends[:-1])
    del counts, n, m, share, ratio, flat, names
    order, used, chosen = np.argsort(-y, kind="stable"), 0, []
    n_toxic = int(y.sum())
    for k in [x for pair in zip(order[:n_toxic], order[n_toxic:]) for x in pair] + list(order[n_toxic + min(n_toxic, len(y) - n_toxic) :]):
        if chosen and used + len(docs[k]) > max_tokens:
            continue
        chosen.append(k)
        used += len(docs[k])
    token = np.concatenate([docs[k] for k in chosen])
    used_words, token = np.unique(token, return_inverse=True)
    lengths = np.array([len(docs[k]) for k in chosen])
    starts = np.zeros(len(token), bool)
    starts[np.cumsum(lengths) - lengths] = True
    tags = (marked[used_words][token] & np.repeat(y[chosen] == 1, lengths)).astype(float)
    spelled = list(number)
    rows = [buckets(spelled[w]) for w in used_words]
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), list(map(len, rows)))
    # Adam on the conditional log-likelihood, all tokens at once.
    theta, moves, bias = np.zeros(BUCKETS), crf.moves.copy(), crf.bias
    first = [np.zeros(BUCKETS + 5), np.zeros(BUCKETS + 5)]
    inside = ~starts
    was = np.append(0, tags[:-1])
    seen_moves = np.array([((1 - was) * tags)[inside].sum(), (was * (1 - tags))[inside].sum(), (was * tags)[inside].sum(), tags[starts].sum()])
    for k in range(1, rounds + 1):
        emission = np.clip(np.bincount(owner, theta[flat], len(rows)) + bias, -20, 20)[token]
        crf.moves = moves
        r, q = crf.odds(emission, starts)
        p = r * q / (1 + r * q)
        ot, to, tt, _ = np.exp(moves)
        before, eq = np.append(1.0, r[:-1])[inside], (np.exp(emission) * q)[inside]
        pair = np.stack([ot * eq, before * to, before * tt * eq])
        pair /= 1.0 + pair.sum(0)
        by_word = np.bincount(token, p - tags, len(rows))
        grad = np.concatenate([np.bincount(flat, by_word[owner], BUCKETS) + 0.05 * theta, [*pair.sum(1), p[starts].sum()] - seen_moves + 0.05 * moves, [(p - tags).sum()]])
        for m, (g, decay) in zip(first, ((grad, 0.9), (grad * grad, 0.99))):
            m *= decay
            m += (1 - decay) * g
        step = 0.2 * (first[0] / (1 - 0.9**k)) / (np.sqrt(first[1] / (1 - 0.99**k)) + 1e-8)
        theta, moves, bias = theta - step[:BUCKETS], np.clip(moves - step[BUCKETS : BUCKETS + 4], -12, 12), bias - step[-1]
    crf.weights, crf.moves, crf.bias = theta.astype(np.float32), moves, float(bias)
    # Logistic calibration of the highest marginal's logit on the sample's documents.
    emission = np.array([crf.emission(spelled[w]) for w in used_words])[token]
    top = np.clip(np.maximum.reduceat(crf.marginals(emission, starts), np.flatnonzero(starts)), 1e-9, 1 - 1e-9)
    x, t = np.log(top / (1 - top)), y[chosen]
    a, b = 0.5, 0.0
    for _ in range(25):
        s = 1 / (1 + np.exp(-(a * x + b)))
        v = s * (1 - s)
        h = np.array([[(v * x * x).sum() + 1.0, (v * x).sum()], [(v * x).sum(), v.sum() + 0.1]])
        a, b = np.array([a, b]) - np.linalg.solve(h, [((s - t) * x).sum() + 1.0 * (a - 0.5), (s - t).sum() + 0.1 * b])
    crf.slope, crf.offset = float(max(a, 0.05)), float(b)
    return crf


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 12_000, max_chars: int = 12_000_000, **how) -> Crf:
    """Fit on labelled rows that aren't held out: at most max_docs rows, first by hash of the id, and of these whole texts up to max_chars in all. Ids or labels that are null are left out; an id labelled more than once counts as toxic if any row says so."""
    chosen = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).where(~is_held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null").join(F.broadcast(chosen), "_id").orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text")).limit(max_docs)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, toxic, used = [], [], 0
        for pdf in batches:
            for text, v in zip(pdf["_text"], pdf["_toxic"]):
                if used + len(text) <= max_chars:  # whole texts only
                    texts.append(text)
                    toxic.append(int(v))
                    used += len(text)
        yield pd.DataFrame({"model": [pickle.dumps(fit(texts, toxic, **how))]})

    # The sample is one partition of at most max_docs rows; one task trains on it, and the driver gets the weights.
    got = rows.select("_text", "_toxic").coalesce(1).mapInPandas(train, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([], [])


def score(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text", span_probability: float = 0.5, keep: int = 150_000) -> DataFrame:
    """doc_id, score (0 to 1), n_tokens and spans: start, end (characters in the text, end exclusive) and probability of each run of tokens whose marginal is at least span_probability.

    Null and empty texts have no tokens and get the score of a marginal near zero. Texts are scored whole. Repeated rows and null ids give rows of their own; other columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(crf)  # one megabyte of weights, whatever the data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf, known = sent.value, {}
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                some = pdf.iloc[at : at + 500]
                yield score_batch(some, crf, known, span_probability)
                if len(known) > keep:
                    known.clear()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id long, score double, n_tokens long, spans {SPAN_TYPE}")


def text_score(spark, crf: Crf, keep: int = 150_000):
    """A column function: the score of each text, as score() gives it. A task has one dictionary of at most about `keep` words."""
    sent = spark.sparkContext.broadcast(crf)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in batches:
            parts = []
            for at in range(0, len(texts), 500):
                parts.append(score_batch(pd.DataFrame({"doc_id": 0, "text": texts.iloc[at : at + 500]}), sent.value, known, 2.0)["score"])
                if len(known) > keep:
                    known.clear()
            yield pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype=float)

    return scored


def score_batch(pdf: pd.DataFrame, crf: Crf, known: dict[str, float], span_probability: float) -> pd.DataFrame:
    texts = [t or "" for t in pdf["text"]]
    tokens = [WORD.findall(t) for t in texts]
    for w in {w for ws in tokens for w in ws}.difference(known):
        known[w] = crf.emission(w.lower())
    lengths = np.array(list(map(len, tokens)), np.int64)
    top, spans = np.zeros(len(texts)), [[] for _ in texts]
    if lengths.sum():
        emission = np.fromiter((known[w] for ws in tokens for w in ws), float, int(lengths.sum()))
        full = np.flatnonzero(lengths)
        begin = (np.cumsum(lengths) - lengths)[full]
        starts = np.zeros(len(emission), bool)
        starts[begin] = True
        p = crf.marginals(emission, starts)
        top[full] = np.maximum.reduceat(p, begin)
        for k, b in zip(full, begin):
            if top[k] >= span_probability:
                own = p[b : b + lengths[k]]
                place = [m.span() for m in WORD.finditer(texts[k])]
                edge = np.diff(np.concatenate([[0], own >= span_probability, [0]]).astype(int))
                spans[k] = [{"start": place[i][0], "end": place[j - 1][1], "probability": float(own[i:j].max())} for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
    return pd.DataFrame({"doc_id": pdf["doc_id"].array, "score": crf.document_score(top), "n_tokens": lengths, "spans": spans})
