import base64
import os
import random

import pytest

from trackloom.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.RANKS), reason="no vocabulary here")

TEXTS = [
    "",
    " ",
    "\n\n  \t x",
    "It's here, isn't it?  we'll see",
    "<|endoftext|> is plain <|im_start|>",
    "ÄÖÜ straße 从入口走到收银台 👍🏽 x² Ⅳ १२ ﻿ a​b",
    "a" * 5000,
    "ab" * 700 + "!?" * 900,
    " 　 mixed \r\n lines",
    "deadbeef" * 60,
]


@pytest.fixture(scope="module")
def theirs():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=encode.read_ranks(encode.RANKS), special_tokens={})


def test_ids_equal_an_independent_encoder(spark, theirs):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abcdeé 中文\n01 .,'sß👍") for _ in range(rng.randint(1, 400))) for _ in range(150)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(1000, None, 1), (1001, "twice", 1), (1001, "twice", 1)]
    got = encode.encoded(spark.createDataFrame(rows, "doc_id bigint, text string, ids int")).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    by_id = {r.doc_id: list(r.ids) for r in got}
    for i, t, _ in rows:
        assert by_id[i] == (theirs.encode_ordinary(t) if t else []), t


def test_round_trip(theirs):
    ranks = encode.read_ranks(encode.RANKS)
    back = {v: k for k, v in ranks.items()}
    words = encode.WordEncoder(ranks)
    for text in TEXTS:
        ids = encode.encode_text(text, words, {}, __import__("regex").compile(encode.PATTERN).findall)
        assert b"".join(back[i] for i in ids).decode() == text


def test_array_and_heap_agree():
    words = encode.WordEncoder(encode.read_ranks(encode.RANKS))
    rng = random.Random(2)
    for _ in range(300):
        word = bytes(rng.choice(b"abcdefgh tion\xe4\xb8\xad") for _ in range(rng.randint(2, 60)))
        assert words._by_array(word) == words._by_heap(word)


def test_ties_go_left(tmp_path):
    path = tmp_path / "ranks"
    tokens = [b"a", b"b", b"aa"]
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    words = encode.WordEncoder(encode.read_ranks(str(path)))
    assert words.encode(b"aaa") == [2, 0] and words.encode(b"aab") == [2, 1]


def test_empty_table(spark):
    assert encode.encoded(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
