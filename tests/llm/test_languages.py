import random

import pytest

from sedimenta.llm import languages
from tests.conftest import rows

# Invented sentences in each language.
PHRASES = {
    "en": "the old mayor bought a silver watch before the whole company and the children were singing in the street",
    "de": "der alte Bürgermeister kaufte eine silberne Uhr vor der ganzen Gesellschaft und die Kinder sangen auf der Straße",
    "fr": "le vieux maire a acheté une montre en argent devant toute la compagnie et les enfants chantaient dans la rue",
    "es": "el viejo alcalde compró un reloj de plata delante de toda la compañía y los niños cantaban en la calle",
    "pt": "o velho presidente comprou um relógio de prata diante de toda a companhia e as crianças cantavam na rua",
    "it": "il vecchio sindaco ha comprato un orologio d'argento davanti a tutta la compagnia e i bambini cantavano nella strada",
    "nl": "de oude burgemeester kocht een zilveren horloge voor het hele gezelschap en de kinderen zongen op straat",
    "sv": "den gamle borgmästaren köpte en silverklocka inför hela sällskapet och barnen sjöng på gatan",
    "ru": "старый мэр купил серебряные часы перед всем обществом и дети пели на улице",
}


def page(rnd, lang, count=60):
    words = PHRASES[lang].split()
    out = []
    while len(out) < count:
        start = rnd.randrange(len(words) - 6)
        out += words[start : start + 6]
    return "\n".join(" ".join(out[i : i + 6]) for i in range(0, len(out), 6))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(3)
    data, truth, n = [], set(), 0
    for lang in languages.LANGUAGES:
        for _ in range(25):
            data.append((n, page(rnd, lang), rnd.choice([lang, lang.upper() + "-XX", f" {lang} ", languages.CODES[lang].split()[1]])))
            n += 1
        for label in (None, "", "xx", "und", "en" if lang != "en" else "de"):
            data.append((n, page(rnd, lang), label))
            truth.add((n, lang))
            n += 1
        other = "fr" if lang != "fr" else "sv"
        mixed = "\n".join(a + "\n" + b for a, b in zip(page(rnd, lang).split("\n"), page(rnd, other).split("\n")))
        data.append((n, mixed, lang))
        truth |= {(n, lang), (n, other)}
        n += 1
        data.append((n, page(rnd, lang) + "\n" + page(rnd, other, 12), lang))  # too little of the other one
        n += 1
    data += [(n, None, "en"), (n + 1, "", "en"), (n + 2, " \n", None), (n + 3, "12 34 ❦ ❦", None), (0, data[0][1], data[0][2])]
    return data, truth


def test_mislabelled(spark, corpus):
    data, truth = corpus
    found = languages.mislabelled(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    got = found.collect()
    assert {(r[0], r[1]) for r in got} == truth and all(0 < r[2] <= 1 for r in got)


def test_repeats_of_a_page_are_not_added_up(spark, corpus):
    data, truth = corpus
    short = [r for r in data if r[1] and r[0] not in {d for d, _ in truth}]
    assert any("\n" in r[1] for r in short)
    again = data + [r for r in short for _ in range(3)]  # pages with too little of a second language, delivered four times
    got = languages.mislabelled(spark.createDataFrame(again, "doc_id long, text string, lang string")).collect()
    assert {(r[0], r[1]) for r in got} == truth
    rnd = random.Random(4)
    parts = [(5000, page(rnd, "en", 40) + "\n" + page(rnd, "fr", 12), "en") for _ in range(3)]  # other texts under one id, none with enough French
    got = languages.mislabelled(spark.createDataFrame(data + parts, "doc_id long, text string, lang string")).collect()
    assert {(r[0], r[1]) for r in got} == truth


def test_passages_cover_all_words(spark, corpus):
    data, _ = corpus
    tagged = languages.tag(spark.createDataFrame(data, "doc_id long, text string, lang string").dropDuplicates(["doc_id"])).groupBy("doc_id").agg({"words": "sum"})
    want = {(d, len([w for w in languages.split_words(t) if w != "\n"])) for d, t, _ in data if t}
    assert set(rows(tagged)) == {x for x in want if x[1]}


def test_held_out_accuracy(corpus):
    data, _ = corpus
    filters = languages.Filters.build(languages.fit_masks([(t, languages.label_index(l)) for _, t, l in data if t and languages.label_index(l) >= 0]))
    tagger = languages.Tagger(filters)
    rnd = random.Random(99)
    right = total = 0
    for i, lang in enumerate(languages.LANGUAGES):
        for _, chosen, _ in tagger.languages([page(rnd, lang, 30) for _ in range(10)]):
            right, total = right + (chosen == i).sum(), total + len(chosen)
    assert right / total > 0.98


def test_filters_and_labels():
    masks = {f"g{i}": 1 << (i % 9) for i in range(20_000)}
    filters = languages.Filters.build(masks)
    import zlib

    import numpy as np

    held = filters.masks(np.array([zlib.crc32(g.encode()) for g in masks], np.uint64))
    assert all(h & m for h, m in zip(held.tolist(), masks.values()))
    other = filters.masks(np.array([zlib.crc32(f"x{i}".encode()) for i in range(5000)], np.uint64))
    assert np.count_nonzero(other) < 50
    assert [languages.label_index(x) for x in (" EN ", "en-GB", "fr_FR", "deu", "ger", "xx", "", None, "e n", "english", "??")] == [0, 0, 2, 1, 1, -1, -1, -1, 0, -1, -1]


def test_empty_table(spark):
    assert languages.mislabelled(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
