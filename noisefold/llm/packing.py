"""Operator 5: cost-balanced packing of documents into token sequences.

A sequence's cost is estimated as linear * tokens + quadratic * (sum of its pieces' squared lengths), since attention stays within a piece. Documents of a group are taken in descending order and assigned to the lowest-cost sequence that has token capacity left for them; a document is cut only where no sequence has room for all of it. What is left of documents over the capacity, which are cut anyway, comes last and fills the sequences up. The sequences of a group hold exactly its tokens: full ones, and for the rest of under `capacity` tokens one for each power of two in it, which need no padding and are filled last.

A group is the next `group_docs` documents (or `group_tokens` tokens) of a task's input, so memory is bounded, there is no shuffle, and every group packs without knowing the others.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
END_ID = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(maxsize=4)
def token_encoder(tokenizer_file: str):
    """text -> uint32 array of ids, equal to the tokenizers library's with add_special_tokens=False.

    tiktoken does the work where the file is a plain byte-level BPE whose ids follow its merges; the special tokens' strings are cut out first, as the library does. Anything else goes to the library itself.
    """
    import public_tokenizers
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file)
    whole.no_truncation()
    whole.no_padding()
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}

    def by_library(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    pre = spec["pre_tokenizer"] or {}
    merged = [vocab[a + b] for a, b in (m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"])]
    plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex") and merged == sorted(merged) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
    if not plain:
        return by_library
    byte_of = {c: b for b, c in byte_symbols().items()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added}
    fast = tiktoken.Encoding("from_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    split = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def encode(text: str) -> np.ndarray:
        try:
            if split is None or not split.search(text):
                return fast.encode_to_numpy(text, disallowed_special=())
            return np.concatenate([np.array([added[x]], np.uint32) if x in added else fast.encode_to_numpy(x, disallowed_special=()) for x in split.split(text) if x])
        except (ValueError, RuntimeError):  # the fast one gives up on some extreme texts
            return by_library(text)

    return encode


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself where printable, else the next of U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def pack_group(lengths: list[int], capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one group; every sequence is full or has a power of two of tokens."""
    pieces, rest, sequence = [], [], 0
    for d, n in enumerate(lengths):  # whole sequences of long documents
        for at in range(0, n - n % capacity, capacity):
            pieces.append((d, at, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, d))
    total = sum(n for n, _ in rest)
    room = np.array([capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length()) if (total % capacity) >> b & 1], np.int64)
    left, cost = room.copy(), np.zeros(len(room))
    full = np.arange(len(room)) < total // capacity
    for n, d in sorted(rest, key=lambda x: (lengths[x[1]] > capacity, -x[0], x[1])):  # what is left of longer documents, which are cut anyway, fills up
        start = lengths[d] - n
        while n:
            # The cheapest sequence that holds all of it; else the cheapest with any room; the small ones when all others are full.
            for able in (full & (left >= n), full & (left > 0), left >= n, left > 0):
                if able.any():
                    break
            k = int(np.where(able, cost, np.inf).argmin())
            part = int(min(n, left[k]))
            pieces.append((d, start, part, sequence + k, int(room[k] - left[k])))
            left[k] -= part
            cost[k] += linear * part + quadratic * part * part
            start, n = start + part, n - part
    return pieces


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, linear: float = 1.0, quadratic: float = 1 / 1024, group_docs: int = 4096, group_tokens: int = 1 << 22) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then end_id. Null and empty texts are the end_id alone. Rows with equal or null doc_id are packed as documents of their own. Texts of any length are encoded whole. Other columns are ignored; an empty table gives no rows. sequence_id is unique over all tasks: (partition << 36) + number within the partition.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = token_encoder(tokenizer_file), np.array([end_id], np.uint32)
        base = TaskContext.get().partitionId() << 36
        ids, held, size = [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal base, ids, held, size
            lengths = [len(x) for x in held]
            pieces = pack_group(lengths, capacity, linear, quadratic)
            out = pd.DataFrame(
                {
                    "doc_id": pd.array([ids[p[0]] for p in pieces], dtype="Int64"),
                    "start": [p[1] for p in pieces],
                    "length": [p[2] for p in pieces],
                    "ids_crc32": [zlib.crc32(held[p[0]][p[1] : p[1] + p[2]]) for p in pieces],
                    "doc_tokens": [lengths[p[0]] for p in pieces],
                    "sequence_id": [base + p[3] for p in pieces],
                    "offset": [p[4] for p in pieces],
                }
            )
            base += 1 + max(p[3] for p in pieces)
            ids, held, size = [], [], 0
            return out

        for pdf in batches:
            for i, text in zip(pdf["doc_id"].array, pdf["text"]):
                ids.append(pd.NA if pd.isna(i) else int(i))
                held.append(np.concatenate([encode(text or ""), end]).astype("<u4"))
                size += len(held[-1])
                if len(held) >= group_docs or size >= group_tokens:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, PIECES)
