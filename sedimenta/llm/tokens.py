"""Encoding of texts with a byte-level BPE vocabulary.

Merging works on many pieces at once. Every merge rank has a bucket of positions in linked lists of symbols, and a
three-level bitmap of the ranks that have waiting positions gives the next rank by find-first-set. Entries are never
removed when a merge makes them obsolete; they are recognised as stale when their turn comes. Cost is linear in the
number of merges, for short pieces as for a single one of millions of bytes.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.worker import kept

VOCABULARY = "byte_bpe_50k.tiktoken"
DEFAULT_FOLDER = "/opt/tokenizers"
MOST_PIECES = 400_000  # pieces whose ids a worker remembers

# The contractions and the white space of the vocabulary's splitting rule.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACE = "\t-\r \x85\xa0  -     　"


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("TOKENIZERS_DIR", DEFAULT_FOLDER), name)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids of a rank file: base64 and number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _class(kinds: str) -> str:
    """Ranges of all characters whose category begins with one of the given ones, as the inside of a character class."""
    ranges: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        if unicodedata.category(chr(code)).startswith(tuple(kinds.split())):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Splitter:
    """The vocabulary's splitting rule.

    `re` has no classes of letters and numbers, but its own differ from them only in numbers that are not digits and in
    four control characters. Texts without those are split with the built-in classes, which is about three times as
    fast as spelling the exact ones out; the others get the exact ones.
    """

    def __init__(self) -> None:
        letter, number = _class("L"), _class("N")
        self.odd = {c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No") or "\x1c" <= c <= "\x1f"}
        self.plain = re.compile(rf" ?[^\W\d_]+| ?\d+|{CONTRACTIONS}| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        self.exact = re.compile(f"{CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall

    def __call__(self, text: str) -> list[str]:
        return self.plain(text) if self.odd.isdisjoint(set(text)) else self.exact(text)


class RankQueue:
    """Positions waiting for their merge, by rank; `first` finds the lowest waiting rank in three steps."""

    def __init__(self, ranks: int):
        self.leaf = [0] * (ranks // 64 + 1)
        self.middle = [0] * (len(self.leaf) // 64 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.leaf[word] |= 1 << (rank & 63)
        self.middle[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def first(self) -> int:
        """The lowest waiting rank, -1 if none."""
        top = self.top
        if not top:
            return -1
        high = (top & -top).bit_length() - 1
        bits = self.middle[high]
        word = high << 6 | (bits & -bits).bit_length() - 1
        bits = self.leaf[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Empties the rank's bucket; its positions in order."""
        word = rank >> 6
        self.leaf[word] &= ~(1 << (rank & 63))
        if not self.leaf[word]:
            self.middle[word >> 6] &= ~(1 << (word & 63))
            if not self.middle[word >> 6]:
                self.top &= ~(1 << (word >> 6))
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return bucket


class Merger:
    """Byte pairs to ranks, and merging of pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece: the lowest rank is merged first, of equal ranks the leftmost."""
        single, pairs = self.single, self.pairs
        symbol: list[int] = []
        after: list[int] = []
        starts = []
        for piece in pieces:
            at = len(symbol)
            starts.append(at)
            symbol.extend(single[b] for b in piece)
            after.extend(range(at + 1, at + len(piece)))
            if piece:
                after.append(-1)
        before = [-1] * len(symbol)
        queue = RankQueue(self.size)
        push, get = queue.push, pairs.get
        for i, j in enumerate(after):
            if j >= 0:
                before[j] = i
                rank = get(symbol[i] << 32 | symbol[j])
                if rank is not None:
                    push(rank, i)
        while (rank := queue.first()) >= 0:
            waiting = queue.take(rank)
            for n, i in enumerate(waiting):
                j = after[i]
                if j < 0 or symbol[i] < 0 or get(symbol[i] << 32 | symbol[j]) != rank:
                    continue  # stale
                symbol[i], symbol[j] = rank, -1
                k = after[i] = after[j]
                after[j] = -1
                lower = False
                if k >= 0:
                    before[k] = i
                    new = get(rank << 32 | symbol[k])
                    if new is not None:
                        push(new, i)
                        lower = new < rank
                h = before[i]
                if h >= 0:
                    new = get(symbol[h] << 32 | rank)
                    if new is not None:
                        push(new, h)
                        lower = lower or new < rank
                if lower:  # a lower rank has to go first
                    for rest in waiting[n + 1 :]:
                        push(rank, rest)
                    break
        out = []
        for start, piece in zip(starts, pieces):
            ids, i = [], start if piece else -1
            while i >= 0:
                ids.append(symbol[i])
                i = after[i]
            out.append(ids)
        return out


class Encoder:
    """Texts to ids, remembering the ids of pieces (up to MOST_PIECES; then it starts afresh)."""

    def __init__(self, path: str):
        self.split = Splitter()
        self.merger = Merger(load_ranks(path))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.int32)
        self.starts = np.zeros(MOST_PIECES * 2, np.int64)
        self.used = 0

    def learn(self, pieces: list[str]) -> None:
        if len(self.number) > MOST_PIECES:
            self.forget()
        known = self.number
        fresh = [p for p in dict.fromkeys(pieces) if p not in known]
        ranks = self.merger.ranks
        raw = [p.encode() for p in fresh]
        whole = [ranks.get(b) for b in raw]
        merged = iter(self.merger.merge([b for b, w in zip(raw, whole) if w is None]))
        ids: list[int] = []
        bounds = []
        for w in whole:
            if w is None:
                ids.extend(next(merged))
            else:
                ids.append(w)
            bounds.append(self.used + len(ids))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(known) + len(fresh) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : self.used + len(ids)] = ids
        first = len(known)
        self.starts[first + 1 : first + 1 + len(fresh)] = bounds
        self.used += len(ids)
        known.update(zip(fresh, range(first, first + len(fresh))))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts; null and empty texts have no ids."""
        counts, numbers = [], []
        for text in texts:
            pieces = self.split(text) if text else []
            counts.append(len(pieces))
            try:
                numbers.append(np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces)))
            except KeyError:
                if len(self.number) > MOST_PIECES:
                    # Forgetting renumbers: what is numbered so far is resolved first.
                    done, rest = self._ids(counts[:-1], numbers), texts[len(counts) - 1 :]
                    self.forget()
                    offsets, ids = self(rest)
                    return np.r_[done[0], done[0][-1] + offsets[1:]], np.r_[done[1], ids]
                self.learn(pieces)
                numbers.append(np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces)))
        return self._ids(counts, numbers)

    def _ids(self, counts: list[int], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        piece = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        start, length = self.starts[piece], self.starts[piece + 1] - self.starts[piece]
        ends = np.cumsum(length)
        at = np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        by_text = np.r_[0, ends][np.r_[0, np.cumsum(counts)].astype(np.int64)]
        return by_text, self.flat[at]


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): one row per row of documents, ids without special tokens.

    Null and empty texts give an empty list; blank texts are encoded as they are; strings of special tokens are
    ordinary text. Each row is independent, so nothing is shuffled and any skew of sources or lengths stays harmless.
    path is the rank file on every executor.
    """
    vocabulary = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(f"encoder {vocabulary}", lambda: Encoder(vocabulary))
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                some = batch.slice(part, 500)
                offsets, ids = encoder(some.column(1).to_pylist())
                yield pa.record_batch([some.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=[key, "ids"])

    return documents.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, ids array<int>")
