import random

import numpy as np
import pytest

from sedimenta.llm import leaks
from tests.conftest import rows

FIRST = [a + b for a in ("C", "H", "Br", "T", "Z", "M", "P", "D", "Fl", "Gr", "K", "W", "S", "Qu", "L") for b in ("or", "ask", "un", "arn", "el", "im", "od", "ent")]
NAMES = [a + b + c for a in FIRST for b in ("vet", "and", "il", "ow", "er", "ug", "ith") for c in ("by", "mere", "holm", "stad", "ric", "wick", "ford", "ley")]
VERBS = ("bought", "refused", "inspected", "quarrelled over", "took charge of", "laid a claim to", "praised", "repaired")
THINGS = ("the old stone bridge", "a barrel of salted herring", "the lower meadow", "a silver watch", "the toll house", "the lease of the quarry", "a parcel addressed to the mayor", "the roof of the church")
ENDS = ("before a large company", "in spite of the heavy rain", "during divine service", "at the quarterly meeting", "shortly after midnight", "in the absence of the chairman")


def text(rnd, sentences):
    return " ".join(f"{rnd.choice(NAMES)}, of {rnd.choice(NAMES)} Street, {rnd.choice(VERBS)} {rnd.choice(THINGS)} of {rnd.choice(NAMES)} for {rnd.randrange(900)} pounds {rnd.choice(ENDS)} at {rnd.choice(NAMES)}." for _ in range(sentences))


def damaged(rnd, words):
    out = []
    for w in words:
        if rnd.random() < 0.08 and len(w) > 3:
            i = rnd.randrange(len(w))
            w = w[:i] + rnd.choice("xeo1") + w[i + 1 :]
        out.append(w)
    return out


def lines(words, width=7):
    return [" ".join(words[i : i + width]) for i in range(0, len(words), width)]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    items = {i: text(rnd, 5) for i in range(1, 21)}
    pages, truth = {}, set()
    for page in range(300):
        body = text(rnd, 12).split()
        item = rnd.randrange(1, 21)
        words = items[item].split()
        kind = page % 10
        if kind == 0:  # whole, damaged, upper case
            body[40:40] = [w.upper() for w in damaged(rnd, words)]
        elif kind == 1:  # two parts, an advert between
            body[60:60] = damaged(rnd, words[: len(words) // 2]) + "WANTED a steady girl for kitchen work apply within".split() + words[len(words) // 2 :]
        elif kind == 2:  # a column read in turns with another
            column = lines(damaged(rnd, words[5:]))
            other = lines(body)
            body = " ".join(x for pair in zip(column, other) for x in pair).split()
        elif kind == 3:  # too little
            body[20:20] = words[: int(len(words) * 0.2)]
        elif kind == 4:  # other order
            mixed = words[:]
            rnd.shuffle(mixed)
            body[20:20] = mixed
        if kind < 3:
            truth.add((page, item))
        pages[page] = "\n".join(lines(body))
    return items, pages, truth


def test_found_pairs_equal_planted(spark, corpus):
    items, pages, truth = corpus
    documents = spark.createDataFrame([*pages.items(), (900, None), (901, ""), (902, " \n "), (5, pages[5])], "doc_id long, text string")
    asked = spark.createDataFrame([*items.items(), (90, None), (91, "")], "item_id long, text string")
    assert {(r[0], r[1]) for r in leaks.find_leaks(documents, asked).collect()} == truth


def test_brute_force_agrees(spark, corpus):
    """Every page against every item, without the latent search."""
    items, pages, truth = corpus
    coder = leaks.Coder()
    coded = {p: coder(t) for p, t in pages.items()}
    names = np.unique(np.concatenate([coder(n) for n in NAMES]))
    exact = set()
    for i, text_ in items.items():
        codes = coder(text_)
        rare = np.intersect1d(codes, names)
        exact |= {(p, i) for p, c in coded.items() if leaks.held_share(c, codes, rare) >= leaks.LEAST_HALF}
    assert exact == truth


def test_empty(spark, corpus):
    items, pages, _ = corpus
    no_pages = spark.createDataFrame([], "doc_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert rows(leaks.find_leaks(no_pages, spark.createDataFrame(list(items.items()), "item_id long, text string"))) == []
    assert rows(leaks.find_leaks(spark.createDataFrame(list(pages.items()), "doc_id long, text string"), no_items)) == []


def test_held_share():
    item = np.arange(40)
    assert leaks.held_share(np.r_[np.full(5, 99), item, np.full(5, 99)], item) == 1
    assert leaks.held_share(item[::-1].copy(), item) == 0
    assert leaks.held_share(item[:11], item) == 0
    assert leaks.held_share(np.zeros(0, int), item) == 0
    assert leaks.held_share(np.r_[item[20:], np.full(60, 99), item[:20]], item) == 0.5


def test_damaged_answers_do_not_drop_a_long_passage():
    item = np.arange(80)
    rare = np.array([3, 17, 31, 45, 59, 73])
    read = item.copy()
    read[rare[2:]] = 5000 + rare[2:]  # four of six answers misread
    mixed = np.concatenate([np.r_[read[i : i + 8], np.arange(9000 + i, 9008 + i)] for i in range(0, 80, 8)])  # another column between the lines
    assert leaks.held_share(mixed, item, rare) >= 0.9
    lost = mixed.copy()
    lost[np.isin(lost, rare)] = 7000  # none left: common phrases in the same order
    assert leaks.held_share(lost, item, rare) == 0


def test_passage_without_answers_goes_on_or_is_a_phrase():
    item, rare = np.arange(80), np.array([3, 10, 17, 24, 60])
    start = np.concatenate([np.r_[item[i : i + 8], np.arange(9000 + i, 9008 + i)] for i in range(0, 32, 8)])
    rest = np.concatenate([np.r_[item[i : i + 8], np.arange(9500 + i, 9508 + i)] for i in range(40, 56, 8)])
    assert leaks.held_share(np.r_[start, rest], item, rare) > 0.5
    assert leaks.held_share(np.r_[start, np.full(200, 9999), rest], item, rare) < 0.5


def test_items_in_blocks(spark, corpus, monkeypatch):
    items, pages, truth = corpus
    monkeypatch.setattr(leaks, "ITEM_WORDS", 300)
    documents = spark.createDataFrame(list(pages.items()), "doc_id long, text string")
    asked = spark.createDataFrame([(f"i{i}", t) for i, t in items.items()], "item_id string, text string")
    assert len(list(leaks.item_blocks(asked))) > 3
    assert {(r[0], int(r[1][1:])) for r in leaks.find_leaks(documents, asked).collect()} == truth


def test_no_word_is_cut_or_left_out():
    assert leaks.fold("constantinople") != leaks.fold("constantinian")
    counts = np.zeros(leaks.HASHES, np.int64)
    counts[5] = 100
    weights = leaks.Weights(counts, 100)
    passage, column, value = weights.rows(np.array([0, 0, 1]), np.array([5, 9, 77]), 2)
    assert len(column) == 3 and (abs(value[1:]) > 0).all() and np.isclose(value[2] ** 2, 1)
    columns, signs = leaks.feature_columns()
    assert columns.min() == 0 and columns.max() == leaks.FEATURES - 1 and abs(signs.mean()) < 0.01


def test_each_stage_keeps_all_that_an_exhaustive_search_finds(spark, corpus):
    items, pages, truth = corpus
    documents = spark.createDataFrame(list(pages.items()), "doc_id long, text string")
    coded = leaks.coded(documents, "doc_id").cache()
    counts, passages = leaks.passage_counts(coded)
    weights = leaks.Weights(counts, passages)
    basis = leaks.latent_basis(coded, weights)
    coder = leaks.Coder()
    texts = [(i, coder(t)) for i, t in items.items()]
    queries, of_query = leaks.item_passages(texts, weights, basis)
    rare = [leaks.rare_words(c, counts, passages) for _, c in texts]
    codes = [coder(t) for t in pages.values()]
    offsets = np.r_[0, np.cumsum([len(c) for c in codes])]
    near, held = set(), set()
    for some, hit in leaks.candidates(offsets, np.concatenate(codes), weights, basis, queries, of_query):
        near |= {(int(some[p]), texts[q][0]) for p, q in zip(*np.nonzero(hit))}
    enough = leaks.screened(offsets, np.concatenate(codes), np.arange(len(codes)), rare)
    held = {(int(p), texts[q][0]) for p, q in zip(*np.nonzero(enough))}
    assert truth <= near and truth <= held and len(near & held) < len(pages) * len(items) / 4
    coded.unpersist()


def test_very_long_pages(monkeypatch):
    rnd = np.random.default_rng(1)
    item = rnd.integers(0, 5000, 150)
    page = rnd.integers(0, 5000, 300_000)
    page[199_990 : 199_990 + 150] = item  # over the bound of two windows
    assert leaks.held_share(page, item) == 1
    short = np.r_[page[199_700:200_400]]
    want = leaks.passages_held(short, item)
    monkeypatch.setattr(leaks, "WINDOW", 37)
    assert leaks.passages_held(short, item) == want
    monkeypatch.setattr(leaks, "MOST_LISTED", 0)
    assert leaks.passages_held(short, item) == want
