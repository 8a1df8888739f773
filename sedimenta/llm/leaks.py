"""Evaluation passages in training text: latent semantic retrieval, then common-subsequence checks.

Texts become sequences of word codes in which scan damage is folded away. A randomised SVD of the TF-IDF matrix of all
passages over all of their words gives a latent space; passages near a passage of a test item there are candidates, the
rare words of the item (its answers: names and figures) screen them, and a longest common subsequence of the words
decides. Items are a query set: they are taken in blocks of a bounded number of words, each against all pages.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sedimenta.llm.worker import kept
from sedimenta.operators.common import staged

PASSAGE = 48  # words of a passage
STRIDE = 12  # words between the starts of an item's passages
HASHES = 1 << 18  # word codes are counted modulo this
FEATURES = 1 << 15  # columns of the matrix; every word has one, by hash, with a sign
SKETCH_ROWS = 256  # rows of the sketched matrix
SKETCH_BLOCKS = 16  # blocks of columns in which partial matrices are added up
ITEM_WORDS = 4 << 20  # words of the items that are searched at a time
PAGES = 2_000  # pages aimed at in one task of the search
WINDOW = 20_000  # words of a page that are compared with an item at a time
MOST_LISTED = 2_000_000  # cells of a table of subsequences that are walked as lists
BATCH = 200  # pages that a task works on at a time
LATENT = 128  # dimensions kept
NEAR = 0.45  # least cosine of a candidate; half of a passage may be another column's
RARE_SHARE = 0.004  # words in fewer passages are an item's rare words
RARE_HELD = 0.2  # share of them that a page has to hold
LEAST_HALF = 0.5  # share of the item's words
LEAST_PASSAGE = 12  # words of a running passage
DENSE = 0.5  # least share of a passage's words that are found undamaged
ANSWERS = 0.5  # least share of the rare words found in the passages for those without any to count by themselves
PART_GAP = 90  # words of the page from a passage to one that goes on from it
SAME_STRETCH = 1.5  # most times that the stretch of one is that of the other
ITEM_GAP = 4  # damaged words inside a passage
DOC_GAP = 45  # words of other columns and adverts inside a passage

# Characters that scans confuse, and the one that stands for each group.
CONFUSED = {"0": "o", "1": "l", "5": "s", "6": "b", "9": "g", "i": "l", "j": "l", "c": "e", "o": "e", "a": "e", "u": "n", "v": "n", "f": "s", "h": "b", "t": "l", "r": "n"}

_BREAK = re.compile("[-=~_¬­‐‑‒–—]{1,2}[ \t]*\r?\n[ \t]*")
_WORD = re.compile(r"[^\W_]+")
_FOLD = str.maketrans(CONFUSED)


def fold(word: str) -> str:
    """A word's shape: confusable letters made equal, double strokes joined."""
    return word.translate(_FOLD).replace("nn", "m").replace("ll", "n")


class Coder:
    """Texts to arrays of word codes, remembering codes of words seen before (up to a bounded number)."""

    MOST = 400_000

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Null, empty and blank texts have no words."""
        if not text:
            return np.zeros(0, np.int32)
        words = _WORD.findall(_BREAK.sub("", text.lower().replace("ſ", "s").replace("ß", "ss")))
        codes = self.codes
        try:
            return np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
        except KeyError:
            if len(codes) > self.MOST:
                codes.clear()
            for word in words:
                if word not in codes:
                    codes[word] = zlib.crc32(fold(word).encode()) & 0x7FFFFFFF
            return np.fromiter(map(codes.__getitem__, words), np.int32, len(words))


def coded(documents: DataFrame, key: str) -> DataFrame:
    """(key, codes) of documents that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept("leak_coder", Coder)
        for batch in batches:
            arrays = [coder(t) for t in batch.column(1).to_pylist()]
            offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
            values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[key, "codes"])

    return documents.select(key, "text").where(F.length("text") > 0).mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, codes array<int>").where(F.size("codes") > 0)


def passages_of(offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, passage, hashed word) of the distinct words of each passage of PASSAGE words; passages are numbered through."""
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = (np.arange(len(codes)) - np.repeat(offsets[:-1], lengths)) // PASSAGE
    # A short rest belongs to the passage before it.
    rest = lengths % PASSAGE
    last = np.where((rest > 0) & (rest < PASSAGE // 4) & (lengths > PASSAGE), lengths // PASSAGE - 1, lengths)
    place = np.minimum(place, np.repeat(last, lengths))
    number = np.cumsum(np.r_[False, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])])
    distinct = np.unique(number.astype(np.int64) * HASHES + codes.astype(np.int64) % HASHES)
    passage, hashed = distinct // HASHES, distinct % HASHES
    owners = np.zeros(int(number[-1]) + 1 if len(number) else 0, np.int64)
    owners[number] = owner
    return owners, passage, hashed


def _lists(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(column)
    offsets = np.asarray(lists.offsets)
    return offsets - offsets[0], np.asarray(lists.values)[offsets[0] : offsets[-1]]


def some_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of BATCH pages, whose arrays stay in the processor's cache; empty ones are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def passage_counts(documents: DataFrame) -> tuple[np.ndarray, int]:
    """Number of passages that hold each hashed word, and of all passages, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, passages = np.zeros(HASHES, np.int64), 0
        for batch in some_pages(batches):
            owners, _, hashed = passages_of(*_lists(batch, "codes"))
            np.add.at(counts, hashed, 1)
            passages += len(owners)
        there = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.r_[there, -1]), pa.array(np.r_[counts[there], passages])], names=["hashed", "n"])

    # At most HASHES + 1 rows reach the driver.
    found = documents.select("codes").mapInArrow(run, "hashed long, n long").groupBy("hashed").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(HASHES, np.int64)
    words = found[found["hashed"] >= 0]
    counts[words["hashed"].to_numpy()] = words["n"].to_numpy()
    return counts, int(found.loc[found["hashed"] < 0, "n"].sum())


def feature_columns() -> tuple[np.ndarray, np.ndarray]:
    """(column, sign) of every hashed word: no word is left out, and words that share a column do not add up."""
    mixed = (np.arange(HASHES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return (mixed % np.uint64(FEATURES)).astype(np.int32), np.where(mixed >> np.uint64(30) & np.uint64(1) == 1, 1, -1).astype(np.float32)


class Weights:
    """TF-IDF weights of all hashed words; words that no passage holds have the greatest one."""

    def __init__(self, counts: np.ndarray, passages: int):
        self.idf = np.log((1 + passages) / (1 + counts)).astype(np.float32)
        self.column, self.sign = feature_columns()

    @classmethod
    def of(cls, idf: np.ndarray) -> Weights:
        """Weights from their plain array, as they travel to workers."""
        made = cls.__new__(cls)
        made.idf = idf
        made.column, made.sign = kept("leak_columns", feature_columns)
        return made

    def rows(self, passage: np.ndarray, hashed: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, column, value) of unit-length rows."""
        value = self.idf[hashed]
        norm = np.sqrt(np.bincount(passage, value * value, minlength=count)).astype(np.float32)
        return passage, self.column[hashed], value * self.sign[hashed] / np.maximum(norm, 1e-9)[passage]


def project(passage: np.ndarray, column: np.ndarray, value: np.ndarray, count: int, basis: np.ndarray) -> np.ndarray:
    """Unit rows times the basis, made unit again."""
    out = np.zeros((count, basis.shape[1]), np.float32)
    starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(passage)]
    # One small product per passage: its few rows of the basis stay in the processor's cache.
    for at, a, b in zip(passage[starts].tolist(), starts.tolist(), ends.tolist()):
        np.dot(value[a:b], basis.take(column[a:b], axis=0), out=out[at])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


def latent_basis(documents: DataFrame, weights: Weights, seed: int = 11) -> np.ndarray:
    """Right singular vectors (features x LATENT) of the TF-IDF matrix of all passages, by one randomised pass.

    Every passage is added with a random sign to one random row of a SKETCH_ROWS x FEATURES matrix (a sparse subspace
    embedding); singular vectors of that sum approximate those of the whole matrix. A task puts out the cells that are
    not zero, at most the matrix; they are added up block by block as they stream in, so that neither a task nor the
    driver, which gets the one matrix, ever holds more than its size, whatever the number of passages.
    """
    shared = documents.sparkSession.sparkContext.broadcast(weights.idf)
    width = FEATURES // SKETCH_BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        weights = Weights.of(shared.value)
        dice = np.random.default_rng([seed, TaskContext.get().partitionId()])
        total = np.zeros((SKETCH_ROWS, FEATURES), np.float32)
        flat = total.reshape(-1)
        for batch in some_pages(batches):
            owners, passage, hashed = passages_of(*_lists(batch, "codes"))
            passage, column, value = weights.rows(passage, hashed, len(owners))
            row = dice.integers(0, SKETCH_ROWS, len(owners))
            sign = dice.choice(np.array([-1, 1], np.float32), len(owners))
            np.add.at(flat, row[passage] * FEATURES + column, value * sign[passage])
        for b in range(SKETCH_BLOCKS):
            part = total[:, b * width : (b + 1) * width].reshape(-1)
            cells = np.flatnonzero(part).astype(np.int32)
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([cells.tobytes()], pa.binary()), pa.array([part[cells].tobytes()], pa.binary())], names=["block", "cells", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                total = totals.setdefault(block, np.zeros(SKETCH_ROWS * width, np.float32))
                total[np.frombuffer(cells.as_buffer(), np.int32)] += np.frombuffer(part.as_buffer(), np.float32)
        yield pa.record_batch([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["block", "part"])

    summed = documents.select("codes").mapInArrow(run, "block int, cells binary, part binary").repartition(SKETCH_BLOCKS, "block").mapInArrow(add, "block int, part binary").collect()
    sketch = np.zeros((SKETCH_ROWS, FEATURES), np.float32)
    for block, part in summed:
        sketch[:, block * width : (block + 1) * width] = np.frombuffer(part, np.float32).reshape(SKETCH_ROWS, width)
    # Eigenvectors of the small Gram matrix give the right singular vectors.
    values, vectors = np.linalg.eigh(sketch @ sketch.T)
    top = np.argsort(-values)[:LATENT]
    top = top[values[top] > 1e-6 * max(values.max(), 1e-12)]
    return (sketch.T @ vectors[:, top] / np.sqrt(values[top])).astype(np.float32)


def supported(equal: np.ndarray) -> np.ndarray:
    """Equal words that stand among other equal words: a direct neighbour and two of four on the diagonal."""
    n, m = equal.shape
    padded = np.zeros((n + 4, m + 4), np.int8)
    padded[2:-2, 2:-2] = equal
    near = padded[1 : n + 1, 1 : m + 1] + padded[3 : n + 3, 3 : m + 3]
    far = padded[:n, :m] + padded[4:, 4:]
    return equal & (near >= 1) & (near + far >= 2)


def passages_held(page: np.ndarray, item: np.ndarray) -> list[list[tuple[int, int]]]:
    """Running passages of the item in the page: lists of (place in item, place in page) of equal words.

    Passages come from a longest common subsequence of supported word matches; up to ITEM_GAP damaged words of the item
    and DOC_GAP foreign words of the page may lie between two matches of a passage. A passage spans LEAST_PASSAGE words
    of the item or more, of which at least DENSE are found.
    """
    if not len(page) or not len(item):
        return []
    # In windows of the page, so that room does not grow with its length; support reaches two words to either side.
    hits = []
    for start in range(0, len(page), WINDOW):
        low, high = max(0, start - 2), min(len(page), start + WINDOW + 2)
        found = supported(item[:, None] == page[None, low:high])[:, start - low : start - low + WINDOW]
        some, there = np.nonzero(found)
        hits.append((some, there + start))
    of_item, of_page = (np.concatenate(h) for h in zip(*hits))
    if not len(of_item):
        return []
    rows, i = np.unique(of_item, return_inverse=True)
    columns, j = np.unique(of_page, return_inverse=True)
    small = np.zeros((len(rows), len(columns)), bool)
    small[i, j] = True
    n, m = small.shape
    best = np.zeros((n + 1, m + 1), np.int16)
    for i in range(n):
        np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + small[i]), out=best[i + 1, 1:])
    i, j, path = n, m, []
    # Plain lists are faster to walk, arrays smaller.
    lines, hits = (best.tolist(), small.tolist()) if best.size < MOST_LISTED else (best, small)
    while i and j:
        here = lines[i][j]
        if hits[i - 1][j - 1] and here == lines[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            path.append((int(rows[i]), int(columns[j])))
        elif lines[i - 1][j] >= lines[i][j - 1]:
            i -= 1
        else:
            j -= 1
    out: list[list[tuple[int, int]]] = []
    for at in reversed(path):
        if out and at[0] - out[-1][-1][0] <= ITEM_GAP and at[1] - out[-1][-1][1] <= DOC_GAP:
            out[-1].append(at)
        else:
            out.append([at])
    return [p for p in out if (span := p[-1][0] - p[0][0] + 1) >= LEAST_PASSAGE and len(p) >= DENSE * span]


def runs_on(passages: list[list[tuple[int, int]]], answered: list[bool]) -> list[bool]:
    """Passages with answers, and those that go on from one of them in the page at about the same stretch.

    The stretch is page words per item word: two columns read as one double it, common phrases elsewhere are spread.
    """
    wide = [(p[-1][1] - p[0][1] + 1) / (p[-1][0] - p[0][0] + 1) for p in passages]
    sure = answered[:]
    near = [b[0][1] - a[-1][1] <= PART_GAP and max(v, w) <= SAME_STRETCH * min(v, w) for a, b, v, w in zip(passages, passages[1:], wide, wide[1:])]
    for i, n in enumerate(near):
        sure[i + 1] |= sure[i] and n
    for i in range(len(near) - 1, -1, -1):
        sure[i] |= sure[i + 1] and near[i]
    return sure


def held_share(page: np.ndarray, item: np.ndarray, rare: np.ndarray | None = None) -> float:
    """Share of the item's words that the page holds in order in running passages; damaged words inside count as held.

    rare has the codes of the item's answers, its rare words. Passages without any of them may be common phrases that
    happen to come in the same order: they count if they go on from a passage with answers (see runs_on), or, where at
    least ANSWERS of the rare words in the passages are found, if nothing stands between their words in the page.
    Damage may hit most answers, so passages that run on from one count however few are found.
    """
    passages = passages_held(page, item)
    answers = set() if rare is None else set(rare.tolist())
    spans = [(p[0][0], p[-1][0]) for p in passages]
    if not answers:
        return sum(last - first + 1 for first, last in spans) / len(item) if passages else 0.0
    asked = [sum(w in answers for w in item[first : last + 1].tolist()) for first, last in spans]
    given = [sum(int(item[i]) in answers for i, _ in p) for p in passages]
    sure = runs_on(passages, [g > 0 for g in given])
    whole = [s or p[-1][1] - p[0][1] <= last - first + ITEM_GAP for s, p, (first, last) in zip(sure, passages, spans)]
    of_whole = sum(a for a, w in zip(asked, whole) if w)
    counted = whole if of_whole < 2 or sum(given) >= ANSWERS * of_whole else sure
    return sum(last - first + 1 for (first, last), c in zip(spans, counted) if c) / len(item) if passages else 0.0


def rare_words(codes: np.ndarray, counts: np.ndarray, passages: int) -> np.ndarray:
    """The item's words in under RARE_SHARE of all passages; its rarest quarter if those are few, as an item may leak often."""
    distinct = np.unique(codes)
    seen = counts[distinct.astype(np.int64) % HASHES]
    few = int((seen < max(3, passages * RARE_SHARE)).sum())
    few = len(distinct) // 4 if few < len(distinct) // 8 else few
    return np.sort(distinct[np.argsort(seen, kind="stable")[:few]])


def answers_held(offsets: np.ndarray, codes: np.ndarray, pages: np.ndarray, rare: list[np.ndarray]) -> np.ndarray:
    """pages x items: how many of each item's rare words a page has."""
    code = np.concatenate(rare)
    item = np.repeat(np.arange(len(rare)), [len(r) for r in rare])
    order = np.argsort(code, kind="stable")
    code, item = code[order], item[order]
    lengths = offsets[pages + 1] - offsets[pages]
    row = np.repeat(np.arange(len(pages)), lengths)
    own = np.concatenate([codes[offsets[p] : offsets[p + 1]] for p in pages])
    first = np.searchsorted(code, own)
    there = first < len(code)
    there[there] = code[first[there]] == own[there]
    distinct = np.unique(row[there].astype(np.int64) << 32 | own[there])
    row, own = distinct >> 32, distinct & 0xFFFFFFFF
    low, high = np.searchsorted(code, own), np.searchsorted(code, own, "right")
    of_row = np.repeat(row, high - low)
    at = np.repeat(low - np.r_[0, np.cumsum(high - low)[:-1]], high - low) + np.arange(len(of_row)) if len(of_row) else np.zeros(0, np.int64)
    return np.bincount(of_row * len(rare) + item[at], minlength=len(pages) * len(rare)).reshape(len(pages), len(rare))


def item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, codes) of the items that have words, in blocks of about ITEM_WORDS words; one block is held at a time."""
    known = staged(coded(items.select("item_id", "text").distinct(), "item_id"), "items")
    words = known.agg(F.sum(F.size("codes"))).first()[0] or 0
    blocks = -(-words // ITEM_WORDS)
    for b in range(blocks):
        some = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else known
        yield [(r[0], np.array(r[1], np.int32)) for r in some.collect()]


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share): pages that hold at least LEAST_HALF of an item's words; see held_share.

    Items are a stated set of queries; every page is compared with all of them in blocks. Items without words leak
    nowhere, pages without words hold nothing, and repeated rows of a page give one row.
    """
    spark = documents.sparkSession
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, share double"
    blocks = item_blocks(items)
    first = next(blocks, None)
    if first is None:
        return spark.createDataFrame([], schema)
    pages = staged(coded(documents, "doc_id"), "codes")
    counts, passages = passage_counts(pages)
    weights = Weights(counts, passages)
    basis = latent_basis(pages, weights)
    # Words take little room but much work: more, smaller tasks than the files would give.
    spread = pages.repartition(max(spark.sparkContext.defaultParallelism, pages.count() // PAGES + 1))
    found = search(spread, first, weights, basis, counts, passages, schema)
    for block in blocks:
        found = found.unionByName(search(spread, block, weights, basis, counts, passages, schema))
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def candidates(offsets: np.ndarray, codes: np.ndarray, weights: Weights, basis: np.ndarray, queries: np.ndarray, of_query: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pages, near) for some pages at a time: whether a passage of the page is near one of each item's."""
    firsts = np.flatnonzero(np.r_[True, of_query[1:] != of_query[:-1]])
    owners, passage, hashed = passages_of(offsets, codes)
    latent = project(*weights.rows(passage, hashed, len(owners)), len(owners), basis)
    page_starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    for a in range(0, len(page_starts), 256):
        some = page_starts[a : a + 256]
        hi = page_starts[a + 256] if a + 256 < len(page_starts) else len(owners)
        near = np.maximum.reduceat(np.maximum.reduceat(latent[some[0] : hi] @ queries.T, some - some[0], axis=0), firsts, axis=1)
        yield owners[some], near >= NEAR


def item_passages(texts: list[tuple], weights: Weights, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(latent vectors of the items' passages, number of the item of each)."""
    starts = [(n, codes[a : a + PASSAGE]) for n, (_, codes) in enumerate(texts) for a in range(0, max(1, len(codes) - PASSAGE + STRIDE), STRIDE)]
    words = [np.unique(c.astype(np.int64) % HASHES) for _, c in starts]
    return project(*weights.rows(np.repeat(np.arange(len(words)), [len(w) for w in words]), np.concatenate(words), len(words)), len(words), basis), np.array([n for n, _ in starts])


def screened(offsets: np.ndarray, codes: np.ndarray, pages: np.ndarray, rare: list[np.ndarray]) -> np.ndarray:
    """pages x items: whether a page has enough of the item's rare words."""
    needed = np.array([max(2, RARE_HELD * len(r)) if len(r) >= 4 else 0 for r in rare])
    return answers_held(offsets, codes, pages, rare) >= needed


def search(pages: DataFrame, texts: list[tuple], weights: Weights, basis: np.ndarray, counts: np.ndarray, passages: int, schema: str) -> DataFrame:
    """Leaks of one block of items in all pages."""
    queries, of_query = item_passages(texts, weights, basis)
    rare = [rare_words(codes, counts, passages) for _, codes in texts]
    shared = pages.sparkSession.sparkContext.broadcast((weights.idf, basis, queries, of_query, texts, rare))
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis, queries, of_query, texts, rare = shared.value
        weights = Weights.of(idf)
        for batch in some_pages(batches):
            out = []
            offsets, codes = _lists(batch, "codes")
            ids = batch.column(0).to_pylist()
            for some, near in candidates(offsets, codes, weights, basis, queries, of_query):
                for p, q in zip(*np.nonzero(near & screened(offsets, codes, some, rare))):
                    page = int(some[p])
                    share = held_share(codes[offsets[page] : offsets[page + 1]], texts[q][1], rare[q])
                    if share >= LEAST_HALF:
                        out.append((ids[page], texts[q][0], share))
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

    return pages.mapInArrow(run, schema)
