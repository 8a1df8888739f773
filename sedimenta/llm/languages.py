"""Languages of documents and of the passages of mixed ones, by language-bitmask n-gram filters.

All languages share one bit-sliced Bloom filter: every slot holds one bit per language, and the bitwise and of an
n-gram's slots gives at once all languages that contain it. Words score per language by the counts of such bits,
corrected for the filter's false positives; the best sequence of languages over a text's words, with a price on every
change, cuts it into passages.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.worker import kept

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "sv", "ru")
# Codes by which a label may name each language.
CODES = {"en": "en eng", "de": "de deu ger", "fr": "fr fra fre", "es": "es spa", "pt": "pt por", "it": "it ita", "nl": "nl nld dut", "sv": "sv swe", "ru": "ru rus"}

SAMPLE = 6_000  # labelled rows, at most, on which the filters are fitted
ROUNDS = 3  # of relabelling the sample's lines
SLOTS = 1 << 21
HASHES = 3
SHARE = 0.12  # of an n-gram's highest rate in any language that makes it a language's own
LEAST_SEEN = 2
WORD_WEIGHT = 3.0  # n-grams that a whole known word counts for
STRENGTH = 4.0  # of a word's score against the price of a change
CHANGE, LINE_CHANGE = 5.0, 3.0  # price of a change inside a line and at its start
LEAST_WORDS = 20  # words of running text that make a page be in a language
OWN = 0.4  # least score of a running word in its passage's language
NEUTRAL = 7  # languages that contain nearly all of a word's n-grams, from which it is a name
MOST_WORDS = 400_000  # word scores that a worker remembers

_BREAK = re.compile("[-=~_¬­‐‑‒–—]{1,2}[ \t]*\r?\n[ \t]*")
_WORD = re.compile(r"[^\W\d_]+|\n")
_INDEX = {code: i for i, name in enumerate(LANGUAGES) for code in CODES[name].split()}
_LABEL = re.compile(r"([a-z]{2,3})(?:[-_].*)?$")


def label_index(label: str | None) -> int:
    """Position in LANGUAGES of the language that a label names, -1 for missing and meaningless labels."""
    found = _LABEL.match("".join((label or "").split()).lower())
    return _INDEX.get(found[1], -1) if found else -1


def split_words(text: str | None) -> list[str]:
    """Lower-case words and line feeds; words broken at line ends are joined, figures are no words."""
    return _WORD.findall(_BREAK.sub("", text.lower())) if text else []


def grams(word: str) -> list[str]:
    """The 3-grams and 4-grams of a word with its ends marked, then the whole word."""
    marked = f"^{word}$"
    return [marked[i : i + n] for n in (3, 4) for i in range(len(marked) - n + 1)] + [f"={word}"]


def slots_of(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    wide = hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [((wide >> np.uint64(s)) % np.uint64(size)).astype(np.int64) for s in (0, 11, 27)[:HASHES]]


class Filters:
    """The bit-sliced filter: slot values are sets of languages as bits."""

    def __init__(self, table: np.ndarray):
        self.table = table
        bits = 1 << np.arange(len(LANGUAGES))
        filled = np.array([np.count_nonzero(table & b) / len(table) for b in bits])
        self.false = (filled**HASHES).astype(np.float32)

    @classmethod
    def build(cls, masks: dict[str, int]) -> Filters:
        table = np.zeros(SLOTS, np.uint16)
        if masks:
            values = np.fromiter(masks.values(), np.uint16, len(masks))
            hashes = np.array([zlib.crc32(g.encode()) for g in masks], np.uint64)
            for at in slots_of(hashes, SLOTS):
                np.bitwise_or.at(table, at, values)
        return cls(table)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """For every n-gram hash the languages that contain it."""
        found = np.full(len(hashes), 0xFFFF, np.uint16)
        for at in slots_of(hashes, len(self.table)):
            found &= self.table[at]
        return found

    def scores(self, words: list[str]) -> np.ndarray:
        """words x languages: corrected share of the n-grams that a language contains, the whole word counting more."""
        pieces = [grams(w) for w in words]
        counts = np.array([len(p) for p in pieces])
        masks = self.masks(np.array([zlib.crc32(g.encode()) for p in pieces for g in p], np.uint64))
        bits = (masks[:, None] >> np.arange(len(LANGUAGES), dtype=np.uint16)) & 1
        ends = np.cumsum(counts)
        weight = np.ones(len(masks), np.float32)
        weight[ends - 1] = WORD_WEIGHT
        starts = np.r_[0, ends[:-1]]
        raw = np.add.reduceat(bits * weight[:, None], starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
        return np.maximum((raw - self.false) / (1 - self.false), 0).astype(np.float32)


def fit_masks(sample: list[tuple[str, int]]) -> dict[str, int]:
    """n-grams to language bits, from (text, labelled language) rows of which many may be wrong or mixed.

    Lines are relabelled by their words' rates, starting from the labels; after ROUNDS the n-grams of each language's
    lines are counted. An n-gram is a language's if its rate there is at least SHARE of its highest rate.
    """
    lines: list[list[str]] = []
    labels: list[int] = []
    for text, label in sample:
        line: list[str] = []
        for word in [*split_words(text), "\n"]:
            if word != "\n":
                line.append(word)
            elif line:
                lines.append(line)
                labels.append(label)
                line = []
    if not lines:
        return {}
    number: dict[str, int] = {}
    flat = np.array([number.setdefault(w, len(number)) for line in lines for w in line])
    owner = np.repeat(np.arange(len(lines)), [len(line) for line in lines])
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    k, now = len(LANGUAGES), np.array(labels)
    for _ in range(ROUNDS):
        counts = np.bincount(flat * k + now[owner], minlength=len(number) * k).reshape(-1, k)
        rates = np.log((counts + 0.05) / (counts.sum(axis=0) + 0.05 * len(number) + 1))
        now = np.add.reduceat(rates[flat], starts, axis=0).argmax(axis=1)
    counts = np.bincount(flat * k + now[owner], minlength=len(number) * k).reshape(-1, k)
    names: dict[str, int] = {}
    pieces = [[names.setdefault(g, len(names)) for g in dict.fromkeys(grams(word))] for word in number]
    word_of = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    gram_of = np.fromiter((g for p in pieces for g in p), np.int64, len(word_of))
    table = np.stack([np.bincount(gram_of, counts[word_of, i], minlength=len(names)) for i in range(k)], axis=1)
    rates = table / np.maximum(counts.sum(axis=0), 1)
    own = (rates >= SHARE * rates.max(axis=1, keepdims=True)) & (table >= LEAST_SEEN)
    packed = (own << np.arange(k)).sum(axis=1)
    return {g: int(m) for g, m in zip(names, packed) if m}


class Tagger:
    """Texts to per-word scores and languages."""

    def __init__(self, filters: Filters):
        self.filters = filters
        self.forget()

    def forget(self) -> None:
        self.number = {"\n": 0}
        self.scores = np.zeros((1 << 16, len(LANGUAGES)), np.float32)

    def numbered(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [split_words(t) for t in texts]
        if len(self.number) > MOST_WORDS:
            self.forget()
        fresh = [w for w in dict.fromkeys(w for words in split for w in words) if w not in self.number]
        if fresh:
            first = len(self.number)
            while first + len(fresh) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[first : first + len(fresh)] = self.filters.scores(fresh)
            self.number.update(zip(fresh, range(first, first + len(fresh))))
        get = self.number.__getitem__
        return [np.fromiter(map(get, words), np.int64, len(words)) for words in split]

    def languages(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(scores, language, line) of the words of each text, by the best sequence over all of its words."""
        tokens = self.numbered(texts)
        out: list = [None] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: len(tokens[i]))
        for a in range(0, len(order), 256):
            some = order[a : a + 256]
            words = [tokens[i][tokens[i] > 0] for i in some]
            lines = [np.cumsum(tokens[i] == 0)[tokens[i] > 0] for i in some]
            longest = max([len(w) for w in words], default=0)
            if not longest:
                for i in some:
                    out[i] = (np.zeros((0, len(LANGUAGES)), np.float32), np.zeros(0, int), np.zeros(0, int))
                continue
            n, k = len(some), len(LANGUAGES)
            index = np.zeros((longest, n), np.int64)
            price = np.full((longest, n), CHANGE, np.float32)
            for c, (w, line) in enumerate(zip(words, lines)):
                index[: len(w), c] = w
                price[1 : len(w), c][line[1:] != line[:-1]] = LINE_CHANGE
            gain = self.scores[index] * STRENGTH
            total = gain[0].copy()
            came = np.zeros((longest, n, k), np.int8)
            stay = np.broadcast_to(np.arange(k, dtype=np.int8), (n, k))
            for t in range(1, longest):
                best = total.argmax(axis=1)
                moved = total[np.arange(n), best] - price[t]
                change = moved[:, None] > total
                came[t] = np.where(change, best[:, None], stay)
                total = np.where(change, moved[:, None], total) + gain[t]
            state = total.argmax(axis=1)
            chosen = np.zeros((longest, n), np.int8)
            for t in range(longest - 1, -1, -1):
                chosen[t] = state
                state = came[t][np.arange(n), state]
            for c, i in enumerate(some):
                out[i] = (self.scores[words[c]], chosen[: len(words[c]), c].astype(int), lines[c])
        return out


def running_words(scores: np.ndarray, language: np.ndarray) -> np.ndarray:
    """Which words are running text of their passage's language: known there, and not in nearly all languages alike."""
    own = scores[np.arange(len(language)), language] if len(language) else np.zeros(0)
    return (own >= OWN) & ((scores >= 0.9).sum(axis=1) < NEUTRAL)


def fit(documents: DataFrame) -> Filters:
    """Filters fitted on at most SAMPLE labelled rows, chosen by a hash of doc_id; rows without a usable label are no part."""
    plain = F.regexp_extract(F.lower(F.regexp_replace("lang", r"\s+", "")), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    labelled = documents.where(plain.isin(list(_INDEX)) & (F.length("text") > 0))
    rows = labelled.count()
    # A threshold on the hash leaves a little more than the sample, so that sorting it brings few rows to the driver.
    share = min(1.0, 1.2 * SAMPLE / max(rows, 1))
    drawn = labelled.select("text", "lang", F.xxhash64("doc_id").alias("h")).where(F.pmod("h", F.lit(1 << 20)) < max(1, int(share * (1 << 20))))
    rows = drawn.orderBy("h", "text").limit(SAMPLE).collect()
    return Filters.build(fit_masks([(r[0], label_index(r[1])) for r in rows]))


PASSAGES = "doc_id {key}, lang_label string, copy long, lang string, first_word int, words int, running int, confidence double"


def tag(documents: DataFrame) -> DataFrame:
    """One row per passage: (doc_id, lang_label, copy, lang, first_word, words, running, confidence).

    A passage is a longest stretch of words in one language; running counts its words of running text and confidence is
    their mean score less the best other language's, from 0 to 1. copy is a hash of the text. Null, empty and blank texts have no passages.
    """
    filters = fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(filters.table)
    name = f"tagger {zlib.crc32(filters.table.tobytes())}"
    key = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = kept(name, lambda: Tagger(Filters(shared.value)))
        for batch in batches:
            for part in range(0, batch.num_rows, 2_000):
                some = batch.slice(part, 2_000)
                columns: list[list] = [[] for _ in range(6)]
                for row, (scores, language, _) in enumerate(tagger.languages(some.column(1).to_pylist())):
                    if not len(language):
                        continue
                    starts = np.flatnonzero(np.r_[True, language[1:] != language[:-1]])
                    running = running_words(scores, language)
                    own = scores[np.arange(len(language)), language]
                    others = scores.copy()
                    others[np.arange(len(language)), language] = 0
                    counted = np.add.reduceat(running, starts)
                    clear = np.add.reduceat((own - others.max(axis=1)) * running, starts) / np.maximum(counted, 1)
                    for column, values in zip(columns, ([row] * len(starts), language[starts].tolist(), starts.tolist(), np.diff(np.r_[starts, len(language)]).tolist(), counted.tolist(), clear.tolist())):
                        column.extend(values)
                at = pa.array(columns[0], pa.int64())
                yield pa.record_batch(
                    [some.column(0).take(at), some.column(2).take(at), some.column(3).take(at), pa.array([LANGUAGES[i] for i in columns[1]], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int32()), pa.array(columns[5], pa.float64())],
                    names=["doc_id", "lang_label", "copy", "lang", "first_word", "words", "running", "confidence"],
                )

    return documents.select("doc_id", "text", "lang", F.xxhash64("text")).mapInArrow(run, PASSAGES.format(key=key))


def page_languages(documents: DataFrame) -> DataFrame:
    """(doc_id, lang_label, copy, lang, running, confidence): the languages in which a page has LEAST_WORDS running words.

    Rows that repeat doc_id, label and text count once; different texts of a doc_id are not added up.
    """
    weight = F.col("confidence") * F.col("running")
    per_page = tag(documents).distinct().groupBy("doc_id", "lang_label", "copy", "lang").agg(F.sum("running").cast("int").alias("running"), (F.sum(weight) / F.greatest(F.sum("running"), F.lit(1))).alias("confidence"))
    return per_page.where(F.col("running") >= LEAST_WORDS)


def mislabelled(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence) of pages whose label is missing, meaningless or wrong, or that are in several languages.

    Repeated rows of a page are judged once, rows of one doc_id with different labels or texts each by its own.
    """
    plain = F.regexp_extract(F.lower(F.regexp_replace("lang_label", r"\s+", "")), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    named = F.create_map(*[F.lit(x) for code, i in _INDEX.items() for x in (code, LANGUAGES[i])])
    pages = page_languages(documents).groupBy("doc_id", "lang_label", "copy").agg(F.collect_set(F.struct("lang", "confidence")).alias("found"))
    label = F.coalesce(F.try_element_at(named, plain), F.lit(""))
    wrong = (F.size(F.array_distinct("found.lang")) > 1) | (F.element_at("found", 1).getField("lang") != label)
    return pages.where(wrong).select("doc_id", F.explode("found").alias("f")).groupBy("doc_id", F.col("f.lang").alias("lang")).agg(F.max("f.confidence").alias("confidence"))
