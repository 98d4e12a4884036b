import random

import pytest

from pagelathe.llm import bpe
from pagelathe.session import public_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def coder():
    return bpe.byte_pairs(public_path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def merged(ranks, data):
    """Plain merging: the lowest rank, leftmost, until nothing merges."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_pieces_against_plain_merging(coder):
    random.seed(4)
    for _ in range(400):
        data = bytes(random.choice(b"abeht \n\xc3\xa9\xe3") for _ in range(random.randrange(1, 40)))
        if data not in coder.ranks:
            assert coder.piece(data) == merged(coder.ranks, data)


@pytest.mark.parametrize("text", ["Hello world, it's   fine\n\n x", "<|endoftext|>", "a" * 20_000, "日本語のテキスト 😀👩‍👩‍👧", "​﻿  x", "é" * 999, " \t\r\n ", "١٢٣ ½ ﬁ", "don't WE'LL", "\x00\x07"])
def test_texts_against_the_public_library(coder, public, text):
    assert coder.encode(text) == public.encode(text, add_special_tokens=False).ids


def test_round_trip(coder):
    pieces = {r: b for b, r in coder.ranks.items()}
    text = "Round trip – größer, 東京 \n\tEnd"
    assert b"".join(pieces[i] for i in coder.encode(text)).decode() == text


def test_documents(spark):
    df = spark.createDataFrame([(1, "Hello", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello", "x"), (None, "a", "x")], "doc_id long, text string, ids string")
    rows = {(r.doc_id, tuple(r.ids)) for r in bpe.p6_ids(df).collect()}
    assert rows == {(1, (15496,)), (2, ()), (3, ()), (None, (64,))}
    assert bpe.p6_ids(df).count() == 5 and bpe.p6_ids(df.limit(0)).count() == 0
    assert sorted(r.n_tokens for r in bpe.encode_corpus(df, ids=False).collect()) == [0, 0, 1, 1, 1]
