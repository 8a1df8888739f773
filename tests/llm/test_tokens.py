import base64
import os
import random

import numpy as np
import pytest

from sedimenta.llm import tokens

PATH = tokens.vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(PATH)


def test_random_texts(encoder, reference):
    rnd = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", "1", "²", "½", "ß", "é", "'s", "'ll", "'S", "漢", "🙂", "\x1c", "\xad", "​", "．", "०", "Ⅷ", "_", "-", "\x85", "\xa0", "aaaa", "<|endoftext|>", "\r\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    offsets, ids = encoder(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [reference.encode_ordinary(t) for t in texts]


def test_long_piece_and_empty(encoder, reference):
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefghij") for _ in range(40_000))
    same = "a" * 30_001
    offsets, ids = encoder([long, None, "", "  ", same])
    got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert got == [reference.encode_ordinary(long), [], [], reference.encode_ordinary("  "), reference.encode_ordinary(same)]


def test_forgetting_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PIECES", 20)
    small = tokens.Encoder(PATH)
    texts = [f"word{i} other{i * 7} and{i % 5} \n" * 3 for i in range(60)]
    offsets, ids = small(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [reference.encode_ordinary(t) for t in texts]


def test_rank_queue():
    queue = tokens.RankQueue(60_000)
    rnd = random.Random(4)
    want = {}
    for position in range(500):
        rank = rnd.randrange(60_000)
        queue.push(rank, position)
        want.setdefault(rank, []).append(position)
    seen = {}
    while (rank := queue.first()) >= 0:
        assert not seen or rank > max(seen)
        seen[rank] = queue.take(rank)
    assert seen == want and queue.top == 0


def test_operator(spark, reference):
    data = [(1, "Hello  world's", "x"), (2, None, None), (3, "", None), (1, "Hello  world's", "x"), (None, " \n ", "y")]
    got = tokens.encode(spark.createDataFrame(data, "doc_id long, text string, ids string")).collect()
    assert sorted((r[0] or 0, list(r[1])) for r in got) == sorted((d[0] or 0, reference.encode_ordinary(d[1] or "")) for d in data)
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert np.asarray(got[0][1]).dtype.kind == "i"
