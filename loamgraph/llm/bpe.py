"""Encoding of a corpus with a public byte-level tokenizer, by a pair occurrence index.

A batch's distinct words (what the tokenizer's pattern splits off) are laid out as one array of byte symbols. An
index maps each pair of neighbouring symbols to all its positions in the batch; the ranks that occur are applied
in ascending order, each to all its positions at once, and only the lists of the pairs that this makes are
updated. As a new pair always has a higher rank than the merge that made it, this equals merging each word on its
own, lowest rank first. A batch costs as many steps as it has active ranks, however many words it has and however long one is.
Each task keeps the words it has encoded, up to a bound.

Nulls, ties and odd input: null and empty texts have the empty list; texts are encoded whole, whatever their
length and characters; strings that look like special tokens are ordinary text; rows and other columns stay as they
are; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The folder of the public vocabularies, and the pattern that splits text before the merges of the rank files.
FOLDER = os.environ.get("LOAMGRAPH_TOKENIZERS", "/opt/tokenizers")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and symbols a task keeps before it forgets them, and symbols of new words that are merged at once.
KEPT_WORDS, KEPT_SYMBOLS, BATCH_SYMBOLS = 300_000, 4_000_000, 2_000_000


class Encoder:
    """One per task and vocabulary."""

    _own: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte = np.full(256, -1, np.int64)
        for b in range(256):
            self.byte[b] = ranks[bytes([b])]
        # The parts of a token are what merging its bytes by the lower ranks gives: found in ascending order.
        self.size = max(ranks.values()) + 1
        pairs, merged = [], []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                a, b = self._halves(token, ranks, rank)
                pairs.append(a * self.size + b)
                merged.append(rank)
        order = np.argsort(pairs)
        self.pairs, self.merged = np.asarray(pairs, np.int64)[order], np.asarray(merged, np.int64)[order]
        self.split = regex.compile(PATTERN).findall
        self.units: list[list[str]] = []  # the words of the texts last encoded
        self.forget()

    @staticmethod
    def _halves(token: bytes, ranks: dict[bytes, int], below: int) -> tuple[int, int]:
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], below)) < below]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.blocks: list[np.ndarray] = []
        self.bounds: list[np.ndarray] = []
        self.symbols = 0
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that merges each pair, or -1."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (b >= 0), self.merged[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words one after another, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        # A gap of -1 after each word keeps pairs within it.
        at = np.arange(len(raw)) + np.repeat(np.arange(len(words)), lengths)
        symbols = np.full(len(raw) + len(words) + 1, -1, np.int64)
        symbols[at] = raw
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, -1, np.int64)
        rank[at] = self.ranks_of(symbols[at], symbols[at + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(where: np.ndarray) -> None:
            where = where[rank[where] >= 0]
            if len(where):
                own = rank[where]
                order = np.argsort(own, kind="stable")
                where, own = where[order], own[order]
                cuts = np.nonzero(np.diff(own))[0] + 1
                for r, part in zip(own[np.concatenate([[0], cuts])].tolist(), np.split(where, cuts), strict=True):
                    if r not in index:
                        index[r] = []
                        heapq.heappush(heap, r)
                    index[r].append(part)

        note(at)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            where = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            where = where[rank[where] == r]
            if len(where) > 1 and (after[where[:-1]] == where[1:]).any():
                # Runs like aaaa: from the left, each second pair of a run.
                linked = np.concatenate([[False], after[where[:-1]] == where[1:]])
                first = np.maximum.accumulate(np.where(linked, 0, np.arange(len(where))))
                where = where[(np.arange(len(where)) - first) % 2 == 0]
            if not len(where):
                continue
            second = after[where]
            third = after[second]
            symbols[where], symbols[second] = r, -2
            after[where], before[third] = third, where
            rank[second] = -1
            rank[where] = self.ranks_of(symbols[where], symbols[third])
            left = before[where]
            left = left[left >= 0]
            left = left[symbols[left] >= 0]
            rank[left] = self.ranks_of(symbols[left], symbols[after[left]])
            note(np.unique(np.concatenate([where, left])))
        alive = symbols >= 0
        word = np.searchsorted(np.cumsum(lengths + 1) - 1, np.nonzero(alive)[0])
        return symbols[alive].astype(np.int32), np.bincount(word, minlength=len(words))

    def learn(self, words: list[str]) -> None:
        """Encodes the words that aren't known."""
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        while new:
            take, total = 0, 0
            while take < len(new) and (take == 0 or total < BATCH_SYMBOLS):
                total += len(new[take])
                take += 1
            tokens, counts = self.merge([w.encode("utf-8", "replace") for w in new[:take]])
            base = len(self.known)
            self.known.update(zip(new[:take], range(base, base + take), strict=True))
            self.blocks.append(tokens)
            self.bounds.append(counts)
            self.symbols += len(tokens)
            self._flat, new = None, new[take:]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all known words, and where each word's begin."""
        if self._flat is None:
            self.blocks, self.bounds = [np.concatenate(self.blocks or [np.zeros(0, np.int32)])], [np.concatenate(self.bounds or [np.zeros(0, np.int64)])]
            self._flat = self.blocks[0], np.concatenate([[0], np.cumsum(self.bounds[0])])
        return self._flat

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts one after another: tokens, tokens per text; tokens per word, words per text."""
        if len(self.known) > KEPT_WORDS or self.symbols > KEPT_SYMBOLS:
            self.forget()
        self.units = split = [self.split(t) if t else [] for t in texts]
        flat = [w for ws in split for w in ws]
        self.learn(flat)
        tokens, starts = self.table()
        ids = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        per_word = starts[ids + 1] - starts[ids]
        ends = np.cumsum(per_word)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) - np.repeat(ends - per_word, per_word) + np.repeat(starts[ids], per_word)
        words = np.fromiter(map(len, split), np.int64, len(split))
        text_ends = np.concatenate([[0], ends])[np.cumsum(words)]
        return tokens[at], np.diff(np.concatenate([[0], text_ends])), per_word, words


def slices(texts: list[str | None], most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch of at most so many characters, or one text."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if len(texts) > start:
        yield start, len(texts)


def encode_texts(docs: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(key, ids) of every row."""
    path = f"{folder}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for b in batches:
            texts = b["text"].to_pylist()
            for lo, hi in slices(texts):
                tokens, counts, _, _ = encoder.encode(texts[lo:hi])
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(tokens, pa.int32()))
                yield pa.record_batch([b["key"].slice(lo, hi - lo), ids], names=["key", "ids"])

    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"key {dict(own.dtypes)['key']}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(docs: DataFrame, text: str, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, name: str = "tokens") -> DataFrame:
    """The rows without their text, with its number of tokens."""
    path, others = f"{folder}/{vocabulary}.tiktoken", [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for b in batches:
            texts = b[text].to_pylist()
            for lo, hi in slices(texts):
                counts = encoder.encode(texts[lo:hi])[1]
                yield pa.record_batch([*(b[c].slice(lo, hi - lo) for c in others), pa.array(counts, pa.int64())], names=[*others, name])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != text)
    return docs.mapInArrow(run, f"{fields}, `{name}` long")
