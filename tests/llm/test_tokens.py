import base64
import random
from pathlib import Path

import pytest
import tiktoken

from trackloom.llm import tokens
from trackloom.llm.queries import TOKENIZER

TEXTS = [None, "", " ", "a", "Hello world", "  two  spaces\n\n\tand tabs ", "don't we'll I'VE", "Straße — “naïve” 東京 🙂🙂 ة", "x" * 5000, "ab" * 3000, "<|endoftext|>", "12345 678,90", " ​﻿", "é é", "\x00\x01", "aaaaaaab" * 50]


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(TOKENIZER.replace(".json", ".tiktoken")).open("rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PIECES, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_merging_by_rank(spark, other):
    rnd = random.Random(0)
    texts = TEXTS + ["".join(rnd.choice(" abcdeßñ'\n.,019🙂the") for _ in range(rnd.randint(1, 200))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _text string")
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode(df, ["doc_id", "_text"][:1], "text", TOKENIZER).collect()}
    assert got == {i: other.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_random_letters_back_up_often(other):
    v, rnd = tokens.vocabulary(TOKENIZER), random.Random(1)
    for _ in range(3000):
        piece = "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 40)))
        assert list(v.encode(piece.encode())) == other.encode_ordinary(piece)


def test_round_trip_and_empty(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    ids = tokens.encode(df, ["doc_id"], "text", TOKENIZER)
    assert {r["doc_id"]: r["text"] for r in tokens.decode(ids, ["doc_id"], "ids", TOKENIZER).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokens.encode(df.where("false"), ["doc_id"], "text", TOKENIZER).collect() == []
    with pytest.raises(ValueError):
        tokens.encode(ids, ["ids"], "text", TOKENIZER)
