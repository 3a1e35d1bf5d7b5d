"""Minimal perfect hash tables over 64-bit keys, built by tasks and read by tasks.

A table is a set of shards by the top bits of a key's mix; each shard is built by one task, holds about SHARD_KEYS keys and is a file in the shared storage. A shard is a cascade of bit arrays (keys that share a bit go on to the next array), whose set bits are counted to give each key its own slot below the number of keys, with no gap. The key itself is stored at its slot, so a key that isn't in the table is told apart with certainty. Only the manifest, a row per shard, passes through the driver. Readers keep at most HELD_KEYS keys in memory and load other shards when they are asked for.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_KEYS = 1 << 18
HELD_KEYS = 1 << 24
_SPACE = 2  # bits for each key of an array
# The finalizer of MurmurHash3.
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray, level: int = 0) -> np.ndarray:
    x = x.astype(np.uint64) ^ np.uint64((level * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    for m in (_M1, _M2):
        x = (x ^ (x >> np.uint64(33))) * m
    return x ^ (x >> np.uint64(33))


def save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """A new file in the shared storage; a repeated attempt of a task writes another one."""
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    held = io.BytesIO()
    np.savez(held, **arrays)
    name = f"{uuid.uuid4().hex}.npz"
    with where.open_output_stream(f"{base}/{name}") as f:
        f.write(held.getvalue())
    return f"{folder}/{name}"


def load(path: str) -> dict[str, np.ndarray]:
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path)
    with where.open_input_stream(at) as f, np.load(io.BytesIO(f.read())) as z:
        return {k: z[k] for k in z.files}


class Shard:
    """slot(keys): each key's place among the shard's, -1 for keys that aren't in it."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, keys: np.ndarray):
        self.sizes, self.bits, self.keys = sizes, bits, keys
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> Shard:
        """keys: distinct uint64."""
        sizes, words, left, level = [], [], keys, 0
        while len(left):
            size = -(-_SPACE * len(left) // 64) * 64
            at = (mix(left, level + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
            level += 1
        own = cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        own.keys = np.empty(len(keys), np.uint64)
        own.keys[own._find(keys)] = keys
        return own

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = (mix(keys[rest], level + 1) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[rest[hit]] = self.before[at[hit] >> 6] + below
            rest = rest[~hit]
        return out

    def slot(self, keys: np.ndarray) -> np.ndarray:
        found = self._find(keys)
        if len(self.keys):
            found[(found >= 0) & (self.keys[found] != keys)] = -1
        return found


@dataclass(frozen=True)
class Manifest:
    """A table's files: shard i holds the slots from starts[i] on. files is None for a shard without keys."""

    bits: int
    files: tuple[str | None, ...]
    starts: tuple[int, ...]  # one more than files

    @property
    def n(self) -> int:
        return self.starts[-1]


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def build(keys: DataFrame, n: int, folder: str, extra: str | None = None) -> Manifest:
    """A table of the distinct longs keys.key, n of them; extra names a string column that is stored with them."""
    bits = max(0, int(n / SHARD_KEYS).bit_length())

    @F.pandas_udf("int")
    def shard(key: pd.Series) -> pd.Series:
        return pd.Series(shard_of(key.to_numpy().view(np.uint64), bits).astype(np.int32))

    def write(group: pd.DataFrame) -> pd.DataFrame:
        own = group["key"].to_numpy().astype(np.int64).view(np.uint64)
        made = Shard.build(own)
        arrays = {"sizes": made.sizes, "bits": made.bits, "keys": made.keys}
        if extra:
            texts = np.empty(len(own), object)
            texts[made.slot(own)] = [x.encode() for x in group[extra]]
            arrays |= {"text": np.frombuffer(b"".join(texts), np.uint8), "ends": np.cumsum([len(x) for x in texts])}
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "n": [len(own)], "file": [save(folder, arrays)]})

    cols = ["key", *([extra] if extra else [])]
    rows = keys.select(*cols).withColumn("shard", shard("key")).groupBy("shard").applyInPandas(write, "shard int, n long, file string").collect()  # a row per SHARD_KEYS keys
    files, sizes = [None] * (1 << bits), np.zeros(1 << bits, np.int64)
    for r in rows:
        files[r["shard"]], sizes[r["shard"]] = r["file"], r["n"]
    return Manifest(bits, tuple(files), tuple(int(x) for x in np.concatenate([[0], np.cumsum(sizes)])))


class Table:
    """A table's shards as they are needed, the last used ones held."""

    def __init__(self, manifest: Manifest, held_keys: int = HELD_KEYS):
        self.manifest, self.room, self.held = manifest, held_keys, OrderedDict()
        self.starts = np.array(manifest.starts, np.int64)

    def shard(self, i: int) -> tuple[Shard, dict[str, np.ndarray]]:
        if i not in self.held:
            a = load(self.manifest.files[i])
            self.held[i] = Shard(a["sizes"], a["bits"], a["keys"]), a
            while len(self.held) > 1 and sum(len(s.keys) for s, _ in self.held.values()) > self.room:
                self.held.popitem(last=False)
        self.held.move_to_end(i)
        return self.held[i]

    def _by_shard(self, shards: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice]]:
        if self.manifest.bits == 0:
            if self.manifest.n:
                yield 0, slice(None)
            return
        order = np.argsort(shards, kind="stable")
        cuts = np.searchsorted(shards[order], np.arange(len(self.manifest.files) + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            yield int(i), order[cuts[i] : cuts[i + 1]]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """uint64 keys -> slots in the whole table, -1 for keys that aren't there."""
        out = np.full(len(keys), -1, np.int64)
        if not len(keys) or not self.manifest.n:
            return out
        for i, at in self._by_shard(shard_of(keys, self.manifest.bits)):
            if self.manifest.files[i] is not None:
                found = self.shard(i)[0].slot(keys[at])
                out[at] = np.where(found >= 0, found + self.starts[i], -1)
        return out

    def keys(self, slots: np.ndarray) -> np.ndarray:
        """The stored keys of slots."""
        out = np.zeros(len(slots), np.uint64)
        for i, at in self._by_shard(np.searchsorted(self.starts, slots, side="right") - 1):
            out[at] = self.shard(i)[0].keys[slots[at] - self.starts[i]]
        return out

    def texts(self, slots: np.ndarray) -> list[bytes]:
        """The stored strings of slots."""
        out = np.empty(len(slots), object)
        for i, at in self._by_shard(np.searchsorted(self.starts, slots, side="right") - 1):
            _, a = self.shard(i)
            blob, ends = a["text"].tobytes(), a["ends"]
            own = slots[at] - self.starts[i]
            out[at] = np.array([blob[(ends[k - 1] if k else 0) : ends[k]] for k in own] + [None], object)[:-1]
        return list(out)


class Counts:
    """Sums by slot, in blocks; add() says when there are enough to send on."""

    def __init__(self, block: int = 1 << 16, most: int = 1 << 24):
        self.block, self.most, self.sums = block, most, {}

    def add(self, slots: np.ndarray) -> bool:
        got = np.bincount(slots // self.block)
        if len(got) == 1:
            self._sum(0, slots)
        else:
            order = np.argsort(slots // self.block, kind="stable")
            for b, own in zip(np.flatnonzero(got), np.split(slots[order], np.cumsum(got[got > 0])[:-1])):
                self._sum(int(b), own)
        return len(self.sums) * self.block > self.most

    def _sum(self, b: int, slots: np.ndarray) -> None:
        here = np.bincount(slots - b * self.block, minlength=self.block)
        self.sums[b] = self.sums[b] + here if b in self.sums else here

    def rows(self) -> pd.DataFrame:
        out = pd.DataFrame({"block": np.array(list(self.sums), np.int64), "sums": [x.astype("<i8").tobytes() for x in self.sums.values()]})
        self.sums = {}
        return out


def tree_sum(parts: DataFrame, tasks: int, fan: int = 16) -> DataFrame:
    """parts: (block, part, sums), part below tasks. Adds the arrays of a block, at most about `fan` of them in one task, level by level."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, "<i8") for x in group["sums"]], axis=0)
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], "part": [int(group["part"].iloc[0])], "sums": [total.astype("<i8").tobytes()]})

    while tasks > 1:
        parts, tasks = parts.withColumn("part", F.floor(F.col("part") / fan).cast("long")), -(-tasks // fan)
        parts = parts.groupBy("block", "part").applyInPandas(add, "block long, part long, sums binary")
    return parts.drop("part")


