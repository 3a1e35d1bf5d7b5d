"""Operator 12: phrase collocation mining.

Candidates are the phrases of 2 to max_words words that occur min_count times or more in their language. They are found level by level: a phrase is looked at only where both phrases that are one word shorter are candidates (Apriori), and is named by the slot of its first words and that of its last word, an exact 64-bit key. Whether it is one is settled by tallies that tasks send on by blocks of hashed keys, a byte each, as they need not exceed min_count. Each level's keys go into a minimal perfect hash with the keys stored in it (slots.py).

The numbers come from one more pass: tasks look every place of the corpus up in the tables, verify the stored keys, bincount the slots into numpy arrays and send blocks of them; the arrays are added as a tree. Every part of a candidate is a candidate or a frequent word itself, so a phrase's cuts are read from the sums by slot.

Texts are read twice (words, then their slots); the later passes read four bytes a word. Tasks hold a bounded number of keys and sums whatever the tables' sizes, and tables are files in the shared storage, never whole in the driver. No step is keyed by language or by a word alone: keys are hashed whole, after each task has added up its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from noisefold.llm import slots
from noisefold.llm.common import cut, drop_folder, new_folder

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = bytes.maketrans(b".,;:!?\n\v\f\r\t", b"\n" * 10 + b" ")
_BREAK, _NOTHING = -1, -2
_CHUNK = 1 << 20  # words of a row of encoded text
_PENDING = 1 << 21  # keys that a task holds before it sends their tallies
_WIDE = T.DecimalType(38, 0)


def _name(lang: str, word: str) -> str:
    return f"{len(lang)}:{lang}{word}"


def _split_name(name: str) -> tuple[str, str]:
    size, rest = name.split(":", 1)
    return rest[: int(size)], rest[int(size) :]


def word_counts(docs: DataFrame) -> DataFrame:
    """docs: (lang, text) without nulls. (lang, word, n) over whole texts."""
    words = F.split(F.translate("text", UPPER, LOWER), r"[\x09-\x0D .,;:!?]+", -1)
    return docs.select("lang", F.explode(words).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))


def _word_table(words: DataFrame, min_count: int, folder: str) -> tuple[slots.Manifest, str]:
    """The frequent words' table and the salt under which no two of them have one hash."""
    often = words.where(F.col("n") >= min_count).select(F.concat(F.length("lang"), F.lit(":"), "lang", "word").alias("name"))
    for salt in ("", "a", "b", "c"):
        keyed = often.select(F.xxhash64(F.concat(F.lit(salt), "name")).alias("key"), "name")
        n, distinct = keyed.agg(F.count("*"), F.countDistinct("key")).first()
        if n == distinct:
            return slots.build(keyed, n, folder, "name"), salt
    raise RuntimeError("words of equal hashes under every salt")


def encode(docs: DataFrame, table: slots.Manifest, salt: str) -> DataFrame:
    """Rows of slots: the texts' words in order, -1 for words that aren't frequent and between pieces and documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        words, known, held, size = slots.Table(table), {}, [], 0
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                own = known.setdefault(lang, {b"": _NOTHING, b"\n": _BREAK})
                tokens = ("\n".join(texts) + "\n").encode().lower().translate(_BREAKS).replace(b"\n", b" \n ").split(b" ")
                new = [t for t in set(tokens) if t not in own]
                names = [_name(lang, t.decode()) for t in new]
                at = words.slots(np.array([xxh64_intdigest((salt + x).encode(), 42) for x in names], np.uint64))
                stored = iter(words.texts(at[at >= 0]))
                for t, x, k in zip(new, names, at):
                    own[t] = int(k) if k >= 0 and next(stored) == x.encode() else _BREAK
                ids = np.fromiter(map(own.__getitem__, tokens), np.int64, len(tokens))
                ids = ids[ids != _NOTHING]
                ids = ids[(ids >= 0) | np.concatenate([[False], ids[:-1] >= 0])]
                held.append(ids.astype("<i4"))
                size += len(ids)
            if sum(map(len, known.values())) > 1 << 21:
                known = {}
            if size > _CHUNK:
                yield pd.DataFrame({"words": [np.concatenate(held).tobytes()]})
                held, size = [], 0
        if size:
            yield pd.DataFrame({"words": [np.concatenate(held).tobytes()]})

    if table.n >= 1 << 31:
        raise ValueError("more frequent words than a slot of 31 bits can name")
    return docs.select("lang", "text").mapInPandas(run, "words binary")


def _key(front: np.ndarray, last: np.ndarray) -> np.ndarray:
    return front.astype(np.uint64) << np.uint64(32) | last.astype(np.uint64)


def _next_keys(words: np.ndarray, front: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where the phrases of size - 1 words here and at the next word both have a slot, and the keys of the phrases of size words there. front: the slots of the shorter ones."""
    at = np.flatnonzero((front[:-1] >= 0) & (front[1:] >= 0))
    return at, _key(front[at], words[at + size - 1])


def ladder(words: np.ndarray, tables: Sequence[slots.Table]) -> list[np.ndarray]:
    """Slots of the phrases of 1, 2, .. words that begin at each place, -1 for none."""
    out = [words]
    for size, table in enumerate(tables, 2):
        at, keys = _next_keys(words, out[-1], size)
        own = np.full(max(len(out[-1]) - 1, 0), -1, np.int64)
        own[at] = table.slots(keys)
        out.append(own)
    return out


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in batch["words"]:
            yield np.frombuffer(x, "<i4").astype(np.int64)


def _added(keys: list[np.ndarray], tallies: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(where, weights=np.concatenate(tallies), minlength=len(distinct)).astype(np.int64)


def candidates(chunks: DataFrame, tables: Sequence[slots.Manifest], min_count: int, block_bits: int) -> DataFrame:
    """The keys of the next level's phrases that occur min_count times or more. tables: those of levels 2 to the last one."""
    size, kind = len(tables) + 2, np.dtype("u1" if min_count < 256 else "<u4")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, keys, tallies = [slots.Table(t) for t in tables], [], []

        def send() -> pd.DataFrame:
            k, n = _added(keys, tallies)
            block = slots.shard_of(k, block_bits)
            order = np.argsort(block, kind="stable")
            k, n = k[order], np.minimum(n[order], min_count).astype(kind)
            ends = np.searchsorted(block[order], np.arange((1 << block_bits) + 1))
            some = np.flatnonzero(np.diff(ends))
            return pd.DataFrame({"block": some.astype(np.int32), "keys": [k[ends[b] : ends[b + 1]].tobytes() for b in some], "tallies": [n[ends[b] : ends[b + 1]].tobytes() for b in some]})

        for words in _chunks(batches):
            k, n = np.unique(_next_keys(words, ladder(words, own)[-1], size)[1], return_counts=True)
            keys.append(k)
            tallies.append(n)
            if sum(map(len, keys)) > _PENDING:
                merged = _added(keys, tallies)
                keys, tallies = [merged[0]], [merged[1]]
                if len(merged[0]) > _PENDING // 2:
                    yield send()
                    keys, tallies = [], []
        if keys:
            yield send()

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        k, n = _added([np.frombuffer(x, np.uint64) for x in group["keys"]], [np.frombuffer(x, kind) for x in group["tallies"]])
        return pd.DataFrame({"key": k[n >= min_count].view(np.int64)})

    return chunks.mapInPandas(tally, "block int, keys binary, tallies binary").groupBy("block").applyInPandas(settle, "key long")


def slot_sums(chunks: DataFrame, tables: Sequence[slots.Manifest], starts: Sequence[int]) -> DataFrame:
    """(block, sums): how often each word and phrase of the tables occurs, by slot; level m's slots begin at starts[m - 1]."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sums, part = [slots.Table(t) for t in tables], slots.Counts(), TaskContext.get().partitionId()
        for words in _chunks(batches):
            full = [sums.add(found[found >= 0] + starts[level]) for level, found in enumerate(ladder(words, own)) if (found >= 0).any()]
            if full and full[-1]:
                yield sums.rows().assign(part=part)
        yield sums.rows().assign(part=part)[["block", "part", "sums"]]

    parts, folder = cut(chunks.mapInPandas(count, "block long, part long, sums binary"), "sums", free=False)
    tasks = (parts.agg(F.max("part")).first()[0] or 0) + 1
    out, _ = cut(slots.tree_sum(parts, tasks), "sums", free=False)
    drop_folder(chunks.sparkSession, folder)
    return out


def _sum_files(sums: DataFrame, folder: str) -> dict[int, str]:
    """Each block of sums as a file; a row for a block passes through the driver."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"block": batch["block"], "file": [slots.save(folder, {"sums": np.frombuffer(x, "<i8")}) for x in batch["sums"]]})

    return {r["block"]: r["file"] for r in sums.mapInPandas(write, "block long, file string").collect()}


class _Sums:
    """Sums by slot, blocks loaded as they are needed."""

    def __init__(self, files: dict[int, str], block: int = 1 << 16, held: int = 128):
        self.files, self.block, self.most, self.held = files, block, held, {}

    def __call__(self, at: np.ndarray) -> np.ndarray:
        out, blocks = np.zeros(len(at), np.int64), at // self.block
        for b in np.unique(blocks):
            if b not in self.held:
                while len(self.held) >= self.most:
                    self.held.pop(next(iter(self.held)))
                self.held[b] = slots.load(self.files[int(b)])["sums"]
            here = blocks == b
            out[here] = self.held[b][at[here] - b * self.block]
        return out


def read_cuts(keys: DataFrame, size: int, word_table: slots.Manifest, tables: Sequence[slots.Manifest], starts: Sequence[int], files: dict[int, str]) -> DataFrame:
    """Of each candidate of `size` words: its slot, those of the two phrases in it that are one word shorter, lang, phrase, a, and of its cuts l and r."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, own, sums = slots.Table(word_table), [slots.Table(t) for t in tables], _Sums(files)
        for batch in batches:
            key = batch["key"].to_numpy().astype(np.int64).view(np.uint64)
            if not len(key):
                continue
            words, k = [], key
            for level in range(size, 1, -1):
                words.insert(0, (k & np.uint64(0xFFFFFFFF)).astype(np.int64))
                front = (k >> np.uint64(32)).astype(np.int64)
                k = own[level - 3].keys(front) if level > 2 else k
            words.insert(0, front)
            part = {(i, 1): w for i, w in enumerate(words)}  # (first word, number of words) -> slots
            for m in range(2, size + 1):
                for i in range(size - m + 1):
                    part[i, m] = own[m - 2].slots(_key(part[i, m - 1], words[i + m - 1]))
            total = lambda i, m: sums(part[i, m] + starts[m - 1])
            distinct = np.unique(np.concatenate(words))
            read = {w: _split_name(x.decode()) for w, x in zip(distinct, names.texts(distinct))}
            yield pd.DataFrame(
                {
                    "slot": part[0, size] + starts[size - 1], "front": part[0, size - 1] + starts[size - 2], "back": part[1, size - 1] + starts[size - 2], "words": np.int32(size),
                    "lang": [read[w][0] for w in words[0]], "phrase": [" ".join(read[w][1] for w in row) for row in zip(*words)], "a": total(0, size),
                    "l": list(np.stack([total(0, m) for m in range(1, size)], axis=1)), "r": list(np.stack([total(m, size - m) for m in range(1, size)], axis=1)),
                }
            )

    return keys.mapInPandas(run, "slot long, front long, back long, words int, lang string, phrase string, a long, l array<long>, r array<long>")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """Each language's first `top` collocations: lang, rank, phrase, a, l, r, n, score.

    A null text is empty, a null language `und`. Rows that repeat a document count again. Words end at white space, pieces at punctuation and line ends; phrases don't pass them or documents. A phrase's score is that of its lowest cut, floor(1000 * a * n / (l * r)), in decimals of 38 digits; ties of cuts go to the shorter first part, ties of phrases to the larger a, then in UTF-8 order. A phrase that always stands inside the same longer one is dropped. Texts of any length are read whole; other columns are ignored; a table without frequent phrases gives no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    folder = new_folder(spark, "tables")
    words, _ = cut(word_counts(own), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    word_table, salt = _word_table(words, min_count, folder)
    chunks, _ = cut(encode(own, word_table, salt), "encoded", free=False)
    n_words = words.agg(F.sum("n")).first()[0] or 0
    block_bits = min(max(4, (n_words >> 20).bit_length()), 20)
    tables, levels = [], []
    for _ in range(2, max_words + 1):
        keys, _ = cut(candidates(chunks, tables, min_count, block_bits), "candidates")
        n = keys.count()
        if n >= 1 << 32:
            raise ValueError("more candidates of a level than a slot of 32 bits can name")
        tables.append(slots.build(keys, n, folder))
        levels.append(keys)
    starts = [int(x) for x in np.cumsum([0, word_table.n, *(t.n for t in tables)])]
    files = _sum_files(slot_sums(chunks, tables, starts), folder)
    found = read_cuts(levels[0], 2, word_table, tables, starts, files)
    for size, keys in enumerate(levels[1:], 3):
        found = found.unionByName(read_cuts(keys, size, word_table, tables, starts, files))
    found, _ = cut(found, "cuts", free=False)

    # An equally frequent longer phrase holds one that is a word longer and as frequent.
    inside = F.explode(F.array(F.when(F.element_at("l", -1) == F.col("a"), F.col("front")), F.when(F.element_at("r", 1) == F.col("a"), F.col("back"))))
    held = found.where("words > 2").select(inside.alias("slot")).where("slot is not null").distinct()
    wide = lambda c: c.cast(_WIDE)
    over = lambda k: F.call_function("div", wide(F.col("a")) * wide(F.col("n")) * F.lit(1000).cast(T.DecimalType(4, 0)), wide(F.element_at("l", k)) * wide(F.element_at("r", k)))
    cuts = F.transform(F.sequence(F.lit(1), F.size("l")), lambda k: F.struct(over(k).alias("score"), k.alias("k"), F.element_at("l", k).alias("l"), F.element_at("r", k).alias("r")))
    rows = found.join(held, "slot", "left_anti").join(totals, "lang").withColumn("cut", F.array_min(cuts))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
