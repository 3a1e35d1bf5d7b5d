"""Operator 4: BPE encoding and decoding by a prefix-sharing traversal of the trie of distinct words.

The last token of a prefix's encoding is fixed by the prefix alone: it is the one vocabulary token t that ends the prefix such that (last token of the rest, t) is what merging that pair's symbols gives back. So one traversal of the trie, depth first, settles the last token of a node from nodes above it, and the encoding of a prefix that many words share is computed once. The end-of-word suffix is one more step below a word's last node.

Words of a batch that the worker hasn't met lately form one trie; their encodings go to a bounded dictionary. Every text is then a join of its words' strings.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisefold.llm.packing import byte_symbols

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class TrieBpe:
    """A word-level BPE read from a tokenizers file with an end-of-word suffix."""

    def __init__(self, tokenizer_file: str, keep: int = 600_000):
        import regex
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ", 1)): k for k, m in enumerate(model["merges"])}
        # By its text without the suffix: tokens inside a word, and tokens that end one.
        self.inner = {t: t for t in self.vocab if not t.endswith(self.end)}
        self.final = {t[: -len(self.end)]: t for t in self.vocab if t.endswith(self.end)}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.reach = [self._reach(self.inner), self._reach(self.final)]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.odd = regex.compile(r"[\x1c-\x1fİΣ]")
        self.far = regex.compile("[\u0378-\U0010ffff]")  # from the first unassigned code point on
        self.symbol = byte_symbols()
        self.library = Tokenizer.from_file(tokenizer_file)
        self.keep = keep
        self.known: dict[str, tuple[int, str, str]] = {}  # chunk -> tokens, ids, token strings; full, it becomes `older`
        self.older: dict[str, tuple[int, str, str]] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    @staticmethod
    def _reach(tokens: dict[str, str]) -> dict[str, int]:
        """The length of the longest token that ends in each two characters."""
        out: dict[str, int] = {}
        for t in tokens:
            out[t[-2:]] = max(out.get(t[-2:], 0), len(t))
        return out

    def _merged(self, parts: list[str]) -> list[str]:
        """Plain BPE of a few symbols."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: (self.ranks.get((parts[k], parts[k + 1]), len(self.ranks)), k))
            pair = (parts[best], parts[best + 1])
            if pair not in self.ranks:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end):
            text = token[: -len(self.end)]
            return [*text[:-1], text[-1] + self.end]
        return list(token)

    def _pair_fits(self, a: str, b: str) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) >= self.keep:
                self.fits.clear()
            got = self.fits[a, b] = self._merged([*self._symbols(a), *self._symbols(b)]) == [a, b]
        return got

    def _last(self, word: str, n: int, states: list[str | None], final: bool) -> str:
        """The last token of word[:n] (final: of the whole word with its end), from the last tokens of shorter prefixes; those not asked for before are settled first."""
        tokens, fits = self.final if final else self.inner, self.fits
        for size in range(min(n, self.reach[final].get(word[max(0, n - 2) : n], 1)), 0, -1):
            token = tokens.get(word[n - size : n])
            if token is not None:
                if size == n:
                    if self._merged(self._symbols(token)) == [token]:
                        return token
                    continue
                before = states[n - size]
                if before is None:
                    before = states[n - size] = self._last(word, n - size, states, False)
                good = fits.get((before, token))
                if good or (good is None and self._pair_fits(before, token)):
                    return token
        raise ValueError(f"no token ends {word[:n]!r}")

    def encode_trie(self, words: set[str]) -> dict[str, list[str]]:
        """Tokens of each distinct word (in byte symbols).

        The sorted words are their trie in depth-first order: going from one to the next climbs to the node of their common prefix, whose states stay, and descends along the rest.
        """
        out: dict[str, list[str]] = {}
        states: list[str | None] = [""]  # by depth: the last token of the path's prefix
        skip, above = len(self.end), ""
        for word in sorted(words):
            n, shared = len(word), 0
            for a, b in zip(above, word):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :]
            states += [None] * (n - len(states))
            if n > 200:  # settle long paths from the top, without recursion
                for d in range(1, n):
                    if states[d] is None:
                        states[d] = self._last(word, d, states, False)
            token = self._last(word, n, states, True)
            tokens, at = [token], n - (len(token) - skip)
            while at:
                token = states[at]
                tokens.append(token)
                at -= len(token)
            out[word] = tokens[::-1]
            above = word
        return out

    def _chunks(self, text: str) -> list[str]:
        """Normalised text in chunks that no word spans: NFC, lower case, split at white space."""
        return self.library.normalizer.normalize_str(text).split(" ") if self.odd.search(text) or self._unknown(text) else unicodedata.normalize("NFC", text).lower().split()

    def _unknown(self, text: str) -> bool:
        """Whether the text has code points without a category in Python's tables: to the library, whose tables are others, they may be letters, digits or marks."""
        return not text.isascii() and self.far.search(text) is not None and any(unicodedata.category(c) == "Cn" for c in set(text))

    def _library_words(self, chunk: str) -> list[str]:
        """Words of a chunk, in byte symbols, as the library's pre-tokenizer parts it."""
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def learn(self, chunks: list[str]) -> None:
        """Put every chunk's encoding into `known`: from `older`, or by a trie of the distinct words of the rest."""
        if len(self.known) + len(chunks) > self.keep:
            self.known, self.older = {}, self.known
        known, older, symbol, split = self.known, self.older, self.symbol, {}
        for chunk in chunks:
            if chunk not in known:
                had = older.get(chunk)
                if had is None:
                    split[chunk] = self._library_words(chunk) if self._unknown(chunk) else ["".join([symbol[b] for b in w.encode()]) for w in self.words.findall(chunk)]
                else:
                    known[chunk] = had
        tokens, vocab = self.encode_trie({w for ws in split.values() for w in ws}), self.vocab
        coded = {w: (" ".join([str(vocab[x]) for x in ts]), " ".join(ts)) for w, ts in tokens.items()}
        for chunk, ws in split.items():
            if len(ws) == 1:
                w = ws[0]
                known[chunk] = (len(tokens[w]), *coded[w])
            else:
                known[chunk] = (sum([len(tokens[w]) for w in ws]), " ".join([coded[w][0] for w in ws]), " ".join([coded[w][1] for w in ws]))

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of tokens, its ids and its tokens, both joined by a space."""
        parts = []
        for text in texts:
            special = self.split_added is not None and self.split_added.search(text)
            parts.append([x if x in self.added else self._chunks(x) for x in self.split_added.split(text)] if special else [self._chunks(text)])
        self.learn(list(dict.fromkeys(c for p in parts for cs in p if not isinstance(cs, str) for c in cs)))
        known, out = self.known, []
        for p in parts:
            got = []
            for cs in p:
                if isinstance(cs, str):
                    got.append((1, str(self.added[cs]), cs))
                else:
                    got += [known[c] for c in cs]
            got = [g for g in got if g[0]]
            out.append((sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])))
        return out


@functools.lru_cache(maxsize=2)
def trie_bpe(tokenizer_file: str) -> TrieBpe:
    return TrieBpe(tokenizer_file)


def encode_texts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", chars_at_once: int = 6_000_000) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (decimal, joined by one space), decoded (the tokens as the tokenizer's decode joins them).

    Null texts count as empty: no tokens, empty strings. Special tokens' strings in a text are those tokens, as the library has it. Repeated rows and null ids give rows of their own; other columns are ignored; an empty table gives no rows.
    """
    return _mapped(docs, tokenizer_file, id_col, text_col, chars_at_once, "doc_id long, n_tokens long, ids string, decoded string", lambda n, ids, decoded: (n, ids, decoded))


def encode_digests(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", chars_at_once: int = 6_000_000) -> DataFrame:
    """encode_texts with the SHA-256 (lowercase hex) of the ids and of the decoded text in their place, so that long texts don't leave the worker."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _mapped(docs, tokenizer_file, id_col, text_col, chars_at_once, ENCODED, lambda n, ids, decoded: (n, sha(ids), sha(decoded)))


def _mapped(docs, tokenizer_file, id_col, text_col, chars_at_once, schema, finish) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = trie_bpe(tokenizer_file)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= chars_at_once):
                    size += len(texts[to])
                    to += 1
                out = pd.DataFrame([finish(*x) for x in bpe.encode(texts[at:to])], columns=names[1:])
                out.insert(0, "doc_id", pdf["doc_id"].iloc[at:to].array)
                yield out
                at = to

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
