from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidemark.llm.packing import Windows, pack, token_blocks
from tidemark.llm.token_counts import space_is_stable, token_counts

SCHEMA = "doc_id long, text string, doc string"


def odd_texts():
    random.seed(3)
    mixed = "".join(random.choice("ab'sé́ .<|endoftext|>\n1٣ཀ가") for _ in range(20_000))
    return [None, "", "a" * 50_000, "it's <|endoftext|> " * 3000, "x́ y " * 3000 + "<|startoftext|>" * 2000, "中文字" * 9000, "  " * 9000, "!?\n" * 9000, mixed, "word " * 9, "word " * 9]


@pytest.mark.parametrize("sizes", [{}, {"huge": 600, "size": 400, "overlap": 150}])
def test_token_counts(spark, sizes):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(None if i == 7 else i % 9, x, "clash") for i, x in enumerate(odd_texts())]
    got = sorted(map(tuple, token_counts(spark.createDataFrame(rows, SCHEMA), path, **sizes).collect()), key=str)
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x, _ in rows]
    assert got == sorted([(r[0], len((r[1] or "").encode()), k, k > 2048) for r, k in zip(rows, n, strict=True)], key=str)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_counts(empty, P.path("word_bpe_49k.json")).count() == 0
    assert pack(empty, P.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("fan_in", [64, 2])
def test_packing(spark, fan_in):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(None if i == 7 else i % 9, x, "clash") for i, x in enumerate(odd_texts())] + [(100 + i, "some words " * (i % 200), "") for i in range(300)]
    got = pack(spark.createDataFrame(rows, SCHEMA).repartition(7), path, open_windows=8, fan_in=fan_in).toPandas()
    expected = collections.Counter()
    for doc_id, x, _ in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        for i in range(0, len(ids), 2048):
            expected[doc_id, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes()), len(ids)] += 1
    assert collections.Counter((None if np.isnan(r[0]) else int(r[0]), *map(int, r[1:5])) for r in got.itertuples(index=False)) == expected
    ordered = got.sort_values(["sequence_id", "offset"])
    by = ordered.groupby("sequence_id")["length"]
    assert (ordered["offset"] == by.cumsum() - ordered["length"]).all() and by.sum().max() <= 2048


def test_full_pieces_take_no_slot():
    w = Windows(10, 2, 0)
    assert w.place((1, 0, 6, 0, 6)) == [] == w.place((2, 0, 7, 0, 7))
    assert w.place((3, 0, 10, 0, 10)) == [(3, 0, 10, 0, 10, 2, 0, False)]
    assert len(w.place((4, 0, 3, 0, 3))) == len(w.place((5, 0, 4, 0, 4))) == 2 and not w.left


def test_both_encoders_agree():
    """Ids by tiktoken, where packing takes them, are those of tokenizers, over all code points below U+0250."""
    path = P.path("byte_bpe_50k.json")
    t, r = Tokenizer.from_file(path), random.Random(4)
    points = [chr(c) for c in range(0x250)]
    for n in range(400):
        some = r.sample(points, 12) + [" ", " ", "\n", "a", "e", "1", "'s", "<|endoftext|>"]
        text = "".join(r.choice(some if n % 2 else points) for _ in range(r.randint(1, 300)))
        ids = [i for b in token_blocks(text, path) for i in b.tolist()]
        assert ids == t.encode(text, add_special_tokens=False).ids, text
    long = "some words and  more\n" * 30_000
    assert [i for b in token_blocks(long, path, 5000) for i in b.tolist()] == t.encode(long, add_special_tokens=False).ids


def test_stable_spaces():
    assert space_is_stable(P.path("word_bpe_49k.json")) and not space_is_stable(P.path("byte_bpe_50k.json"))
